"""Typed scans of the input tables.

Every table is read with an explicit schema so that nothing is inferred and
Catalyst can prune columns and push filters straight into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS: dict[str, T.StructType] = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),  # wall-clock, no zone
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
}


SPREAD_CONF = "tagwright.spreadSingleSplit"
TEXT_COLUMNS = {"text", "html"}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Scan one table with its declared schema, projecting ``columns``.

    The projection reaches the scan as ``ReadSchema``; a two-column read of
    ``documents`` never touches the other three column chunks.
    The rows stay where the scan reads them; no shuffle is added. Only a
    session that sets ``SPREAD_CONF`` (the local one of tests and bench, whose
    tables are one file with one row group, which no scan can split, however
    many splits it plans) deals the texts of such a table over its cores.
    """
    reader = spark.read
    schema = SCHEMAS.get(name)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    if TEXT_COLUMNS & set(df.columns) and spark.conf.get(SPREAD_CONF, "false") == "true" and len(df.inputFiles()) == 1:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
