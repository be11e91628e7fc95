"""Registered queries for file sources and sinks (S1, S4-S6) and the
consolidated dictionary labels (D12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import lexicon as LX
from ..operators import split as SP
from ..session import materialize, scratch_path
from ..sources import files as FS
from ..sources.quoted import read_quoted
from ..sources.tables import read_table
from . import corpus_queries as CQ
from . import fixtures as FX
from . import scoring_queries as SQ
from . import sqlbits as SB
from .registry import masked, register


@register("scan_delimited", op="S1", sql="""
SELECT doc_id, text, lang FROM documents
""")
def q_scan_delimited(spark, sf):
    """Documents written as TSV (texts with newlines and quotes) and read
    back with a declared schema."""
    path = scratch_path(spark, "tsv")
    FS.write_delimited(read_table(spark, sf, "documents", ["doc_id", "text", "lang"]), path, "\t")
    return FS.read_delimited(spark, path, "doc_id bigint, text string, lang string", "\t")


@register("scan_delimited_split", op="S1 (split)", sql="""
SELECT doc_id, text, lang FROM documents
""")
def q_scan_delimited_split(spark, sf):
    """Documents as CSV files with line ends in quotes, read by as many tasks as
    the files have splits. The files are written by as many tasks as the table
    is read by."""
    path = scratch_path(spark, "quoted-csv")
    FS.write_delimited(read_table(spark, sf, "documents", ["doc_id", "text", "lang"]), path)
    return read_quoted(spark, path, "doc_id bigint, text string, lang string")


@register("sink_predictions", op="S5", sql=SQ.PREDS_SQL)
def q_sink_predictions(spark, sf):
    """Predictions written as CSV partitioned by method, read back."""
    path = scratch_path(spark, "preds")
    FS.write_delimited(SQ.predictions(spark, sf), path, partition_by=["method"])
    back = FS.read_delimited(spark, path, "doc_id bigint, prediction string, method string")
    return back.select("method", "doc_id", "prediction")


@register("scan_prediction_files", op="S4", sql=SQ.PREDS_SQL)
def q_scan_prediction_files(spark, sf):
    """One prediction file per method, found by name and read in one scan."""
    folder = scratch_path(spark, "tagged")
    FS.write_predictions(SQ.predictions(spark, sf), folder, "docs")
    return FS.read_prediction_files(spark, folder, "docs", "doc_id bigint, prediction string")


@register("sink_parquet", op="S6", sql=f"""
SELECT article_id, vintage, {SB.word_count('text')} AS num_words FROM ({CQ._sources_sql()})
WHERE {SB.word_count('text')} > 100
""")
def q_sink_parquet(spark, sf):
    """Consolidated texts written as Parquet partitioned by source, read back."""
    from ..operators.corpus import consolidate_text
    path = scratch_path(spark, "consolidated")
    FS.write_parquet(consolidate_text(CQ.sources_union(spark, sf)), path, ["vintage"])
    return spark.read.parquet(path).select("article_id", "vintage", "num_words")


# --- D12 -------------------------------------------------------------------------------
def _rule(text_col):
    return LX.all_dictionaries_rule(text_col, [FX.LEX_A, FX.LEX_B, FX.LEX_C])


@register("tagged_corpus_consolidation", op="D12", sql=f"""
WITH s AS (SELECT doc_id, quality, CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
           FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY {SB.md5_key(FX.SEED, 'doc_id')},
                 doc_id) - 1 AS rk, count(*) OVER () AS n FROM labels)),
t AS (SELECT s.doc_id, s.quality, s.split, d.text FROM s LEFT JOIN documents d ON s.doc_id = d.doc_id),
p AS (SELECT doc_id, CAST(({" AND ".join(
    f"regexp_matches({masked(SB.clean_sequence('text'))}, '{lx.ascii_pattern()}')"
    for lx in (FX.LEX_A, FX.LEX_B, FX.LEX_C))}) AS INTEGER) AS pred FROM t WHERE split = 'test'
      UNION ALL
      SELECT doc_id, CAST(({" AND ".join(
    f"regexp_matches({masked('text')}, '{lx.ascii_pattern()}')"
    for lx in (FX.LEX_A, FX.LEX_B, FX.LEX_C))}) AS INTEGER) FROM t WHERE split = 'train'),
m AS (SELECT doc_id, avg(pred) AS dict_label FROM p GROUP BY doc_id)
SELECT t.doc_id, t.quality AS human_label, m.dict_label FROM t LEFT JOIN m ON t.doc_id = m.doc_id
""")
def q_tagged_corpus_consolidation(spark, sf):
    """Train and test rows with their text; the test path tags cleaned text,
    the train path raw text (as the original); the mean dictionary label per
    article is attached to the human label."""
    lab = read_table(spark, sf, "labels", ["doc_id", "quality"])
    both = SP.train_test_split(lab, "doc_id", FX.SEED, FX.TEST_SHARE)
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    # one join; each row is tagged by the rule of its side, then averaged per article
    pred = F.when(F.col("split") == "test", _rule(TX.clean_sequence(F.col("text")))).otherwise(_rule(F.col("text")))
    t = materialize(both.join(docs, "doc_id", "left").select("doc_id", "quality", pred.alias("pred")), "tagged")
    mean = t.groupBy("doc_id").agg(F.avg("pred").alias("dict_label"))
    return t.select("doc_id", F.col("quality").alias("human_label")).join(mean, "doc_id", "left")
