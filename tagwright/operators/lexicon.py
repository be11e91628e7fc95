"""Dictionary (lexicon) tagging, D3-D12.

All taggers are column expressions over one compiled pattern literal: they
run map-side inside whole-stage codegen, need no shuffle and scale with the
number of input partitions. Null text behaves as "no match".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import Lexicon, phrase_pattern
from ..functions.text import fold_blocks

SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
]))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def match_count(text, lex: Lexicon) -> Column:
    """Number of matches."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(lex.spark_pattern())), F.lit(0))


def has_match(text, lex: Lexicon) -> Column:
    """Found flag; stops at the first hit."""
    return F.coalesce(_col(text).rlike(lex.spark_pattern()), F.lit(False))


def match_spans(text, lex: Lexicon) -> Column:
    """``array<struct<term,start,end>>`` with code-point offsets, end exclusive.

    The text split on the same pattern yields the gaps between matches, so
    match i starts after gaps 0..i and matches 0..i-1. Matches and gaps are
    computed once (as the two arguments of one ``zip_with``; an expression
    referenced inside a lambda would be re-evaluated per element), then a left
    fold in blocks accumulates the offsets; nothing leaves the JVM, and the
    time is linear in the matches of a text.
    """
    t = _col(text)
    p = lex.spark_pattern()
    m = F.regexp_extract_all(t, F.lit(p), 0)
    g = F.split(t, p, -1)
    # g has one element more than m: zip_with pads m with a null there
    pairs = F.zip_with(m, g, lambda x, y: F.struct(x.alias("term"), F.length(y).alias("gap"),
                                                   F.length(x).alias("len")))

    def step(acc, pr):
        start = acc["off"] + pr["gap"]
        end = start + pr["len"]
        span = F.struct(pr["term"].alias("term"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        matched = pr["term"].isNotNull()
        return {"off": F.when(matched, end).otherwise(acc["off"])}, F.when(matched, span)

    out = fold_blocks(pairs, {"off": F.lit(0)}, step, "struct<term:string,start:int,end:int>")["out"]
    return F.coalesce(out, F.array().cast(SPAN_TYPE))


def match_spans_long(df: DataFrame, key: str, text: str, lex: Lexicon) -> DataFrame:
    """D3 in long form: one row ``key, i, term, start, end`` per match.

    Each (match, gap) pair becomes a row and the offsets are a running sum over
    a window partitioned by text, so the rows of a text with very many matches
    leave the row format."""
    t = F.col(text)
    p = lex.spark_pattern()
    m = F.regexp_extract_all(t, F.lit(p), 0)
    g = F.split(t, p, -1)
    pairs = F.zip_with(m, g, lambda x, y: F.struct(x.alias("term"), F.length(y).alias("gap"),
                                                   F.length(x).alias("len")))
    rows = df.select(F.col(key), F.posexplode_outer(pairs).alias("i", "pr")).where(
        F.col("pr.term").isNotNull())
    w = (Window.partitionBy(key).orderBy("i")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.sum(F.col("pr.gap") + F.col("pr.len")).over(w)
    return rows.select(F.col(key), F.col("i").cast("int").alias("i"),
                       F.col("pr.term").alias("term"),
                       (end - F.col("pr.len")).cast("int").alias("start"),
                       end.cast("int").alias("end"))


def tag_text(df: DataFrame, text: str, lex: Lexicon, search_type: str = "all",
             return_matches: bool = True, prefix: str | None = None) -> DataFrame:
    """``tag_text`` of the original tool as two columns ``<p>_found`` and
    ``<p>_matches`` (D3 all, D4 first, D5 flag only)."""
    prefix = prefix or lex.name
    t = F.col(text)
    if search_type == "all":
        spans = match_spans(t, lex)
        found = F.size(spans) > 0
        out = spans if return_matches else F.array().cast(SPAN_TYPE)
        if not return_matches:
            found = has_match(t, lex)
    elif search_type == "first":
        p = F.lit(lex.spark_pattern())
        pos = F.regexp_instr(t, p, 0)  # 1-based, 0 when absent
        found = F.coalesce(pos > 0, F.lit(False))
        first = F.regexp_substr(t, p)
        span = F.struct(first.alias("term"), (pos - 1).cast("int").alias("start"),
                        (pos - 1 + F.length(first)).cast("int").alias("end"))
        out = F.when(found & F.lit(return_matches), F.array(span)).otherwise(
            F.array().cast(SPAN_TYPE))
    else:
        raise ValueError(f"unknown search_type {search_type!r}")
    return df.withColumn(f"{prefix}_found", found).withColumn(f"{prefix}_matches", out)


def polarity(up_count: Column, down_count: Column,
             labels: tuple[str, str, str] = ("hawkish", "dovish", "neutral")) -> Column:
    """More up-terms -> labels[0]; fewer -> labels[1]; equal -> labels[2]."""
    return (F.when(up_count > down_count, F.lit(labels[0]))
            .when(up_count < down_count, F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def polarity_rule(df: DataFrame, text: str, up: Lexicon, down: Lexicon,
                  up_name: str = "num_hawkish", down_name: str = "num_dovish",
                  out: str = "prediction") -> DataFrame:
    """Two counts and the rule, in one projection over the raw text."""
    return (df.withColumn(up_name, match_count(text, up))
              .withColumn(down_name, match_count(text, down))
              .withColumn(out, polarity(F.col(up_name), F.col(down_name))))


def all_dictionaries_rule(text, lexicons: Sequence[Lexicon]) -> Column:
    """1 iff every lexicon has at least one match."""
    cond = None
    for lex in lexicons:
        c = has_match(text, lex)
        cond = c if cond is None else (cond & c)
    return cond.cast("int")


def phrase_terms_matched(text, terms: Sequence[str]) -> Column:
    """The phrases found (each needs whitespace on both sides), in list
    order; blank or null text gives an empty list.

    One literal pattern per phrase keeps every regex compiled once per task
    (a pattern taken from an array element would be recompiled per row)."""
    t = _col(text)
    hits = [F.when(t.rlike(phrase_pattern(term)), F.lit(term)) for term in terms]
    arr = F.array_compact(F.array(*hits))
    blank = t.isNull() | (F.trim(t) == "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(arr)


def phrase_label(text, terms: Sequence[str]) -> Column:
    return (F.size(phrase_terms_matched(text, terms)) > 0).cast("int")


def label_product(*labels: Column) -> Column:
    """The product of 0/1 labels."""
    out = labels[0]
    for c in labels[1:]:
        out = out * c
    return out


# Word tokens of terms and texts
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
