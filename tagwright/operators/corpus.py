"""Corpus construction: union of sources, length filter, label joins, votes
(U1, C3-C10, J1-J4, A1-A4, A9, A10).

Everything here is relational: one shuffle per aggregate or join, map-side
partial aggregation, and broadcast only for tables whose size is bounded by
construction (category lists) or checked at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_column_once, word_count


# --- U1, C8, C9 ---------------------------------------------------------------
def union_sources(sources: Sequence[tuple[DataFrame, str]], key: str = "article_id",
                  text: str = "text", vintage: str = "vintage") -> DataFrame:
    """UNION ALL of per-source ``(id, text)`` tables aligned by position,
    each tagged with its source name (a parameter: names must match the
    label tables exactly). Ids become strings so that sources that number
    their articles as integers and as strings line up."""
    out = None
    for df, name in sources:
        a, b = df.columns[:2]
        part = df.select(F.col(a).cast("string").alias(key), F.col(b).alias(text),
                         F.lit(name).alias(vintage))
        out = part if out is None else out.unionByName(part)
    return out


def consolidate_text(df: DataFrame, text: str = "text", min_words: int = 100,
                     count_col: str = "num_words") -> DataFrame:
    """C3 + C4 + C5: word counts, keep texts of more than ``min_words`` words,
    drop rows with any null."""
    counted = with_column_once(df, count_col, word_count(F.col(text)).cast("bigint"))
    return counted.where(F.col(count_col) > min_words).dropna(how="any")


# --- C7 -------------------------------------------------------------------------
def coalesce_key(primary: Column, fallback: Column) -> Column:
    """``primary`` when present, else ``fallback`` as an integer string (a
    number that arrived as a float must not become "123.0")."""
    fb = F.when(fallback.cast("double") == F.floor(fallback.cast("double")),
                fallback.cast("double").cast("bigint").cast("string")).otherwise(
        fallback.cast("string"))
    return F.coalesce(primary.cast("string"), fb)


# --- C10 -------------------------------------------------------------------------
def category_codes(df: DataFrame, col: str) -> DataFrame:
    """The alphabetical code of each distinct value: ``value, code`` with
    code 0 for the smallest. The distinct values are few (the classes)."""
    from pyspark.sql import Window as W
    vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    # one row per class reaches the numbering window, whatever the table's size
    return vals.withColumn("code", (F.row_number().over(W.orderBy("value")) - 1).cast("int"))


def label_encode(df: DataFrame, col: str, out: str = "label",
                 codes: DataFrame | None = None) -> DataFrame:
    codes = codes if codes is not None else category_codes(df, col)
    m = codes.select(F.col("value").alias(col), F.col("code").alias(out))
    # no hint: Spark broadcasts the codes if it measures them to be small
    return df.join(m, col, "left")


def label_decode(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    m = codes.select(F.col("code").alias(col), F.col("value").alias(out))
    return df.join(m, col, "left")


# --- A1, A4 -------------------------------------------------------------------------
def majority_vote(votes: DataFrame, keys: Sequence[str], vote: str,
                  out: str = "label") -> DataFrame:
    """Mean vote per key: above one half -> 1, below -> 0, exactly one half
    -> tie, dropped. Compared as integers (2*sum vs count), so no rounding
    question arises; the aggregate is partial map-side, so a hot key costs
    one partial row per partition, not a giant group."""
    agg = votes.groupBy(*keys).agg(F.sum(F.col(vote).cast("bigint")).alias("_s"),
                                   F.count(F.col(vote)).alias("_n"))
    lab = (F.when(2 * F.col("_s") > F.col("_n"), F.lit(1))
           .when(2 * F.col("_s") < F.col("_n"), F.lit(0)))
    return agg.select(*keys, lab.alias(out)).where(F.col(out).isNotNull())


def vote_then_attach(votes: DataFrame, keys: Sequence[str], vote: str,
                     detail: DataFrame, one_row_per_article: bool = False,
                     out: str = "label") -> DataFrame:
    """A4: the voted label joined back to the distinct detail rows. Detail
    rows keep the per-coder vote, so a disputed article appears once per
    distinct vote unless ``one_row_per_article``."""
    lab = majority_vote(votes, keys, vote, out)
    det = detail.drop(vote) if one_row_per_article else detail
    return lab.join(det.distinct(), list(keys), "left")


# --- J3 ----------------------------------------------------------------------------
def join_left_then_drop(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join then drop rows with any null (also nulls that did not come
    from the join, as the original does)."""
    return left.join(right, list(on), "left").dropna(how="any")


# --- A9 ----------------------------------------------------------------------------
def equal_width_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max (last bin
    closed). Min and max are two driver-side scalars from one aggregate;
    bin numbers are computed with exact arithmetic on integer columns."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    x = F.col(col)
    if lo is None:
        b = F.lit(0)
    elif hi == lo:
        b = F.lit(0)
    else:
        b = F.least(F.floor((x - F.lit(lo)) * bins / F.lit(hi - lo)), F.lit(bins - 1))
    return (df.where(x.isNotNull()).select(b.cast("int").alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("n")))


# --- X8 ----------------------------------------------------------------------------
def duplicate_keys(df: DataFrame, key: str, out: str = "n_extra") -> DataFrame:
    """Keys that occur more than once, with the number of extra rows."""
    return (df.groupBy(key).agg((F.count("*") - 1).alias(out)).where(F.col(out) > 0))


def read_once(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row of each key, the first by ``order`` (then by the whole row,
    so that the choice does not depend on partitions). The limit of one row a
    key is applied in each partition before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order, F.xxhash64(*[F.col(c) for c in df.columns]))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn <= 1").drop("_rn")
