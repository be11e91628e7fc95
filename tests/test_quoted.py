"""Quoted line ends over many splits, against Python's csv module."""

import csv
import io
import random

import pytest

from tagwright.sources import files as FS
from tagwright.sources.quoted import _lines, read_quoted

SCHEMA = "id int, text string, note string"


def rows(seed, n):
    rng = random.Random(seed)
    bits = ["word ", "\n", "\r\n", '"', '""', ",", "\t", "é", " ", "\n\n", "x" * 50, "'", "\\"]
    made = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30))) + "end", rng.choice(["a", "b\nc", "plain"])) for i in range(n)]
    made[n // 2] = (n // 2, "\n".join("a long record, over many splits " * 3 for _ in range(400)), "z")
    return made


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("sep, end", [(",", "\n"), ("\t", "\r\n")])
def test_one_foreign_file_in_many_tasks(spark, small_splits, tmp_path, sep, end):
    made = rows(len(end), 600)
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=sep, lineterminator=end)
    writer.writerow(["id", "text", "note"])
    writer.writerows(made)
    for k in range(2):      # two files, each with its header
        (tmp_path / f"part{k}.csv").write_bytes(out.getvalue().encode())
    assert _lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    got = [tuple(r) for r in read_quoted(spark, str(tmp_path), SCHEMA, sep).collect()]
    assert sorted(got) == sorted(made * 2)


def test_nulls_empty_texts_and_empty_lines(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,note\n1,,"x"\n\n2,"",y\n3,"\n",\n4,"no end of line","last"')
    got = sorted((tuple(r) for r in read_quoted(spark, str(tmp_path / "a.csv"), SCHEMA).collect()))
    assert got == [(1, None, "x"), (2, "", "y"), (3, "\n", None), (4, "no end of line", "last")]
    (tmp_path / "b.csv").write_text("")
    assert read_quoted(spark, str(tmp_path / "b.csv"), SCHEMA).collect() == []


def test_round_trip_with_the_plain_reader(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    FS.write_delimited(docs.coalesce(1), str(tmp_path / "docs"))
    schema = "doc_id bigint, text string, source string"
    one = FS.read_delimited(spark, str(tmp_path / "docs"), schema).collect()
    assert sorted(read_quoted(spark, str(tmp_path / "docs"), schema).collect()) == sorted(one) == sorted(docs.collect())


def test_query_writes_with_as_many_tasks_as_it_reads(spark, monkeypatch):
    """No task writes the whole table."""
    from tagwright.plans import QUERIES, io_queries
    from tagwright.session import scratch_path
    from tagwright.sources.tables import SCHEMAS
    rows = [(i, f'line "{i}"\nand, more', None if i % 3 else "en", "a", 1) for i in range(40)]
    base = scratch_path(spark, "quoted-table")
    spark.createDataFrame(rows, SCHEMAS["documents"]).repartition(8).write.parquet(f"{base}/documents.parquet")
    tasks = []
    write = io_queries.FS.write_delimited

    def counted(df, *args, **kw):
        tasks.append(df.rdd.getNumPartitions())
        write(df, *args, **kw)
    monkeypatch.setattr(io_queries.FS, "write_delimited", counted)
    got = QUERIES["scan_delimited_split"](spark, base).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(i, t, g) for i, t, g, _, _ in rows]
    assert tasks[0] > 1
