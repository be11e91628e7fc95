"""Delimited files with line ends inside quotes, read by many tasks.

A quoted field may hold line ends, so a reader that starts in the middle of a
file cannot tell whether a line begins a record: Spark's ``multiLine`` reader
gives a file to one task. But only the number of quotes before a place matters:
a place is inside quotes if it is odd. So

1. the file is scanned as plain lines, and each split's quotes are counted;
2. a running sum over a file's splits tells which splits begin inside quotes;
3. the lines are scanned again, each task joins the lines of a record knowing
   how its split begins; records that cross splits are put together from their
   pieces (two a split at most);
4. Spark's own CSV expression parses the records, with the options and the
   typing of its reader.

Tasks get the begins of splits inside quotes, 8 bytes for a split that is (of
``spark.sql.files.maxPartitionBytes`` each). Quoting must be that of RFC 4180:
quotes only around a field and doubled inside it. Files with bare quotes in
unquoted fields need ``read_delimited``.

Defined results: an unquoted empty field is null, a quoted one the empty text;
empty lines are no records; CR LF ends a record like LF, and stays as it is
inside quotes; every file's first record is its header and is left out; an
empty file gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

NOTHING = "\u0001"      # stands for unquoted empty fields only
COMPLETE, HEAD, TAIL = range(3)     # a record, the end of one that began before the split, the beginning of one that goes on


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")))


def _splits_inside(lines: DataFrame) -> dict[str, np.ndarray]:
    """Per file, where the splits begin that begin inside quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "begin").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("odd", F.sum("quotes").over(before) % 2 == 1).where("odd")
    found = inside.groupBy("file").agg(F.collect_list("begin").alias("begins")).collect()
    return {r["file"]: np.array(sorted(r["begins"]), np.int64) for r in found}


def read_quoted(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Typed read of CSV/TSV files with a header, split among tasks whatever
    their texts hold."""
    lines = _lines(spark, path)
    inside = _splits_inside(lines)
    pieces = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("kind", pa.int32()), ("value", pa.string())])

    def records(it):
        now, held, odd, opened = None, [], False, False      # opened: held begins with the record's first line
        out: list[tuple] = []

        def put(kind, value):
            out.append((*now, kind, value))

        def close():
            if held:
                put(TAIL if opened else HEAD, "\n".join(held))

        for batch in it:
            for value, file, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, begin) != now:
                    if now is not None:
                        close()
                    begins = inside.get(file, ())
                    at = np.searchsorted(begins, begin) if len(begins) else 0
                    now, held, odd = (file, begin), [], bool(at < len(begins) and begins[at] == begin)
                    opened = not odd
                held.append(value)
                odd ^= bool(value.count('"') & 1)
                if not odd:
                    put(COMPLETE if opened else HEAD, "\n".join(held))
                    held, opened = [], True
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), pieces, strict=True)], schema=pieces)
                out = []
        if now is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), pieces, strict=True)], schema=pieces)

    found = lines.mapInArrow(records, "file string, begin long, kind int, value string")
    numbered = found.withColumn("nr", F.monotonically_increasing_id())      # in order within a split
    rows = materialize(numbered, "records")
    # a piece belongs to the last beginning before it
    order = Window.partitionBy("file").orderBy("begin", "kind", "nr")
    crossing = rows.where(F.col("kind") != COMPLETE).withColumn("record", F.count_if(F.col("kind") == TAIL).over(order))
    joined = (crossing.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("begin", "nr", "value"))).alias("pieces"))
              .select("file", F.col("pieces")[0]["begin"].alias("begin"), F.col("pieces")[0]["nr"].alias("nr"),
                      F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value")))
    whole = rows.where(F.col("kind") == COMPLETE).select("file", "begin", "nr", "value").unionByName(joined)
    whole = whole.withColumn("value", F.regexp_replace("value", r"\r\z", "")).where("value <> ''")
    # the header is the first record of the file's first split
    first = whole.groupBy("file").agg(F.min(F.struct("begin", "nr")).alias("first")).select(F.col("file").alias("_file"), "first")
    body = (whole.join(first, F.col("file") == F.col("_file")).where(F.struct("begin", "nr") != F.col("first")))
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "nullValue": NOTHING}
    return body.select(F.from_csv("value", ddl, options).alias("r")).select("r.*")
