"""The pipeline: each stage on its predecessor's rows, its decisions in effect."""

import corpus_pipeline as P
from cases import SF, edge_docs, edge_rows
from tagwright.llm.decontaminate import decontaminate
from tagwright.llm.language import label_languages
from tagwright.llm.simhash import simhash_groups
from tagwright.session import materialize

SF1 = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "mix_sources", "token_records"]
    benchmark = spark.read.parquet(f"{SF1}/benchmark.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    stage = dict(P.STAGES)

    kept = materialize(stage["language_id"](spark, docs, SF1), "t1")
    assert kept.columns == columns and kept.count() >= 0.99 * docs.count()
    assert ids(kept) == ids(label_languages(docs).where("lang_pred <> 'und' AND score >= 0.3"))

    single = materialize(stage["simhash_dedup"](spark, kept, SF1), "t2")
    assert single.columns == columns
    assert ids(single) == ids(simhash_groups(kept).where("doc_id = component_id"))

    clean = materialize(stage["decontaminate"](spark, single, SF1), "t3")
    assert clean.columns == columns
    assert ids(clean) == ids(decontaminate(single, benchmark).where("NOT contaminated")) and clean.count() < single.count()

    mixed = materialize(stage["mix_sources"](spark, clean, SF1), "t4")
    assert mixed.columns == columns
    from collections import Counter
    assert set(Counter(ids(mixed)).values()) <= {1, 2} and set(ids(mixed)) <= set(ids(clean))

    tokens = stage["token_records"](spark, mixed, SF1)
    rows = sorted(map(tuple, tokens.collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == ids(mixed)
    assert [r[1] for r in rows][1:] == [r[1] + r[2] for r in rows][:-1]


def test_strange_rows_pass_all_stages(spark):
    docs = edge_docs(spark)
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "edge")
        assert docs.columns == edge_docs(spark).columns
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0
    empty = edge_docs(spark).limit(0)
    for _, stage in P.STAGES:
        empty = materialize(stage(spark, empty, SF), "edge")
        assert empty.count() == 0
    assert len(edge_rows()) > 0


def test_run(spark):
    assert P.run(spark, SF).count() > 0
