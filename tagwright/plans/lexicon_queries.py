"""Registered queries for dictionary tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import dictionary_table as DT
from ..operators import lexicon as LX
from ..sources import dictionaries as DS
from ..sources.tables import read_table
from ..session import scratch_path
from . import fixtures as FX
from . import sqlbits as SB
from .registry import masked, register


def _docs(spark, sf, cols=("doc_id", "text")):
    return read_table(spark, sf, "documents", list(cols))


def _cnt(lex, t="t"):
    return f"CAST(len(regexp_extract_all({t}, '{lex.ascii_pattern()}')) AS BIGINT)"


def _flag(lex, t="t"):
    return f"regexp_matches({t}, '{lex.ascii_pattern()}')"


MASKED_DOCS = f"SELECT doc_id, {masked('text')} AS t FROM documents"


# --- S2 -----------------------------------------------------------------------
@register("scan_parquet_projected", op="S2", sql="""
SELECT doc_id, text FROM documents
""")
def q_scan_parquet_projected(spark, sf):
    return _docs(spark, sf)


# --- D7, the flagship ------------------------------------------------------------
def polarity_per_doc(spark, sf):
    df = _docs(spark, sf)
    out = LX.polarity_rule(df, "text", FX.UP, FX.DOWN)
    return out.select("doc_id", F.col("num_hawkish").cast("bigint"),
                      F.col("num_dovish").cast("bigint"), "prediction")


POLARITY_SQL = f"""
WITH d AS ({MASKED_DOCS}),
c AS (SELECT doc_id, {_cnt(FX.UP)} AS num_hawkish, {_cnt(FX.DOWN)} AS num_dovish FROM d)
SELECT doc_id, num_hawkish, num_dovish,
  CASE WHEN num_hawkish > num_dovish THEN 'hawkish'
       WHEN num_hawkish < num_dovish THEN 'dovish' ELSE 'neutral' END AS prediction
FROM c
"""


@register("polarity_rule", op="D7", sql=POLARITY_SQL)
def q_polarity_rule(spark, sf):
    return polarity_per_doc(spark, sf)


@register("polarity_counts", op="D7", sql=f"""
SELECT prediction, count(*) AS n FROM ({POLARITY_SQL}) GROUP BY prediction
""")
def q_polarity_counts(spark, sf):
    return polarity_per_doc(spark, sf).groupBy("prediction").agg(F.count("*").alias("n"))


# --- D2, D5, D6 ------------------------------------------------------------------
ALL_LEX = [FX.UP, FX.DOWN, FX.LEX_A, FX.LEX_B, FX.LEX_C]


@register("dictionary_regex", op="D2", sql=f"""
WITH d AS ({MASKED_DOCS})
SELECT doc_id, {", ".join(f"{_flag(lx)} AS hit_{lx.name}" for lx in ALL_LEX)} FROM d
""")
def q_dictionary_regex(spark, sf):
    df = _docs(spark, sf)
    return df.select("doc_id", *[LX.has_match("text", lx).alias(f"hit_{lx.name}")
                                 for lx in ALL_LEX])


@register("match_count", op="D6", sql=f"""
WITH d AS ({MASKED_DOCS})
SELECT doc_id, {", ".join(f"{_cnt(lx)} AS n_{lx.name}" for lx in ALL_LEX)} FROM d
""")
def q_match_count(spark, sf):
    df = _docs(spark, sf)
    return df.select("doc_id", *[LX.match_count("text", lx).cast("bigint").alias(f"n_{lx.name}")
                                 for lx in ALL_LEX])


@register("tag_flag_only", op="D5", sql=f"""
WITH d AS ({MASKED_DOCS})
SELECT doc_id, {_flag(FX.LEX_A)} AS found, CAST(0 AS BIGINT) AS n_matches FROM d
""")
def q_tag_flag_only(spark, sf):
    df = LX.tag_text(_docs(spark, sf), "text", FX.LEX_A, "all", return_matches=False, prefix="a")
    return df.select("doc_id", F.col("a_found").alias("found"),
                     F.size("a_matches").cast("bigint").alias("n_matches"))


# --- D3: every match with its span ---------------------------------------------------
def _spans_sql(lex):
    p = lex.ascii_pattern()
    # match i starts after gaps 1..i and matches 1..i-1 (1-based lists)
    return f"""
WITH d AS ({MASKED_DOCS}),
s AS (SELECT doc_id, regexp_extract_all(t, '{p}') AS m,
             list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gl FROM d),
e AS (SELECT doc_id, m, gl, list_transform(m, lambda x: length(x)) AS ml FROM s)
SELECT doc_id, len(m) > 0 AS found, CAST(len(m) AS BIGINT) AS n_matches,
  array_to_string(list_transform(range(1, len(m) + 1), lambda i:
      m[i] || '@' || CAST(list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i-1]), 0) AS VARCHAR)
      || '-' || CAST(list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i-1]), 0) + ml[i] AS VARCHAR)),
      '|') AS spans
FROM e
"""


@register("tag_all", op="D3", sql=_spans_sql(FX.LEX_A))
def q_tag_all(spark, sf):
    df = LX.tag_text(_docs(spark, sf), "text", FX.LEX_A, "all", prefix="a")
    s = F.transform("a_matches", lambda x: F.concat(x["term"], F.lit("@"), x["start"].cast("string"),
                                                  F.lit("-"), x["end"].cast("string")))
    return df.select("doc_id", F.col("a_found").alias("found"),
                     F.size("a_matches").cast("bigint").alias("n_matches"),
                     F.array_join(s, "|").alias("spans"))


@register("tag_first", op="D4", sql=f"""
WITH d AS ({MASKED_DOCS}),
s AS (SELECT doc_id, regexp_matches(t, '{FX.LEX_B.ascii_pattern()}') AS found,
             regexp_extract(t, '{FX.LEX_B.ascii_pattern()}') AS term,
             length(string_split_regex(t, '{FX.LEX_B.ascii_pattern()}')[1]) AS st FROM d)
SELECT doc_id, found,
  CASE WHEN found THEN term END AS term,
  CASE WHEN found THEN CAST(st AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS start_pos
FROM s
""")
def q_tag_first(spark, sf):
    df = LX.tag_text(_docs(spark, sf), "text", FX.LEX_B, "first", prefix="b")
    first = F.element_at("b_matches", 1)
    return df.select("doc_id", F.col("b_found").alias("found"),
                     F.when(F.col("b_found"), first["term"]).alias("term"),
                     F.when(F.col("b_found"), first["start"]).otherwise(-1).cast("bigint")
                     .alias("start_pos"))


# --- D8 ------------------------------------------------------------------------------
ALL3_SQL = f"""
WITH d AS ({MASKED_DOCS})
SELECT doc_id, CAST(({_flag(FX.LEX_A)} AND {_flag(FX.LEX_B)} AND {_flag(FX.LEX_C)}) AS INTEGER)
  AS prediction FROM d
"""


@register("all_dictionaries_rule", op="D8", sql=ALL3_SQL)
def q_all_dictionaries_rule(spark, sf):
    df = _docs(spark, sf)
    return df.select("doc_id", LX.all_dictionaries_rule("text", [FX.LEX_A, FX.LEX_B, FX.LEX_C])
                     .alias("prediction"))


# --- D9, D10 ---------------------------------------------------------------------------
def _phrase_sql(terms, t="c"):
    ws = "\\s+"
    hits = ", ".join(
        f"CASE WHEN regexp_matches({t}, '{ws}{ws.join(term.split())}{ws}') "
        f"THEN '{term}' END" for term in terms)
    return (f"CASE WHEN {t} IS NULL OR trim({t}) = '' THEN [] "
            f"ELSE list_filter([{hits}], lambda x: x IS NOT NULL) END")


PHRASE_SQL = f"""
WITH d AS (SELECT doc_id, {SB.clean_delete_punct('text')} AS c FROM documents),
m AS (SELECT doc_id, {_phrase_sql(FX.PHRASES_A)} AS a, {_phrase_sql(FX.PHRASES_B)} AS b,
             {_phrase_sql(FX.PHRASES_C)} AS cc FROM d)
SELECT doc_id, array_to_string(a, ';') AS a_terms, array_to_string(b, ';') AS b_terms,
  array_to_string(cc, ';') AS c_terms,
  CAST(len(a) > 0 AS INTEGER) AS a_label, CAST(len(b) > 0 AS INTEGER) AS b_label,
  CAST(len(cc) > 0 AS INTEGER) AS c_label,
  CAST(len(a) > 0 AS INTEGER) * CAST(len(b) > 0 AS INTEGER) * CAST(len(cc) > 0 AS INTEGER)
  AS product_label
FROM m
"""


def phrase_labels(spark, sf):
    df = _docs(spark, sf).select("doc_id", TX.clean_delete_punct(F.col("text")).alias("c"))
    cols = []
    labels = []
    for nm, terms in (("a", FX.PHRASES_A), ("b", FX.PHRASES_B), ("c", FX.PHRASES_C)):
        arr = LX.phrase_terms_matched("c", terms)
        cols.append(F.array_join(arr, ";").alias(f"{nm}_terms"))
        lab = (F.size(arr) > 0).cast("int")
        cols.append(lab.alias(f"{nm}_label"))
        labels.append(lab)
    return df.select("doc_id", *cols, LX.label_product(*labels).alias("product_label"))


@register("phrase_terms_matched", op="D9", sql=PHRASE_SQL)
def q_phrase_terms_matched(spark, sf):
    return phrase_labels(spark, sf)


@register("label_product", op="D10", sql=f"""
SELECT product_label, count(*) AS n FROM ({PHRASE_SQL}) GROUP BY product_label
""")
def q_label_product(spark, sf):
    return phrase_labels(spark, sf).groupBy("product_label").agg(F.count("*").alias("n"))


# --- D1, S8: a dictionary table derived from the benchmark passages --------------------
def _term_table(spark, sf):
    """Every distinct word and adjacent word pair of ``benchmark``, lower
    case, with a ``part`` cell in the spellings the original files use."""
    b = read_table(spark, sf, "benchmark", ["text"])
    toks = F.regexp_extract_all(F.lower("text"), F.lit(LX.TOKEN_PATTERN), 0)
    b = b.select(toks.alias("toks"))
    words = b.select(TX.explode_values(F.col("toks"), "term"))
    pair_arr = F.when(F.size("toks") >= 2, F.transform(
        F.sequence(F.lit(1), F.size("toks") - 1),
        lambda i: F.concat_ws(" ", F.element_at("toks", i), F.element_at("toks", i + 1)))
    ).otherwise(F.array().cast("array<string>"))
    pairs = b.select(TX.explode_values(pair_arr, "term"))
    terms = words.unionByName(pairs).where(F.col("term").isNotNull()).distinct()
    h = F.length("term") % 4
    return terms.select("term", F.when(h == 0, "yes").when(h == 1, "no").when(h == 2, "1 ")
                        .otherwise("0").alias("part"))


TERM_TABLE_SQL = """
WITH b AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS toks FROM benchmark),
t AS (
  SELECT DISTINCT term FROM (
    SELECT unnest(toks) AS term FROM b
    UNION ALL
    SELECT unnest(list_transform(range(1, len(toks)),
                                 lambda i: concat_ws(' ', toks[i], toks[i + 1]))) AS term FROM b))
SELECT term, CASE length(term) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '1 '
  ELSE '0' END AS part FROM t
"""


@register("dictionary_load", op="S8", sql=f"""
SELECT term, CASE WHEN trim(part) IN ('0') THEN false ELSE length(trim(part)) > 0 END AS part
FROM ({TERM_TABLE_SQL})
""")
def q_dictionary_load(spark, sf):
    path = scratch_path(spark, "dictionary")
    _term_table(spark, sf).write.option("header", True).option("ignoreTrailingWhiteSpace", False) \
        .csv(path)
    return DS.read_dictionary_table(spark, path)


@register("dictionary_info", op="D1", sql=f"""
SELECT term, CAST(len(string_split_regex(trim(term), '\\s+')) = 1 AS BOOLEAN) AS is_single_word,
  CAST(length(term) AS BIGINT) AS length_order
FROM ({TERM_TABLE_SQL})
""")
def q_dictionary_info(spark, sf):
    t = _term_table(spark, sf)
    return t.select("term", TX.is_single_word(F.col("term")).alias("is_single_word"),
                    F.length("term").cast("bigint").alias("length_order"))


# --- D11: the benchmark vocabulary as a large dictionary --------------------------------
@register("large_dictionary_tag", op="D11", sql=f"""
WITH terms AS (SELECT term, bool_or(CASE WHEN trim(part) = '0' THEN false ELSE length(trim(part)) > 0 END) AS part,
                 NOT contains(term, ' ') AS single FROM ({TERM_TABLE_SQL}) GROUP BY term),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS tok,
        string_split_regex(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS gap FROM documents),
w AS (SELECT DISTINCT doc_id, unnest(tok) AS gram FROM d),
met AS (SELECT DISTINCT gram FROM (SELECT DISTINCT gram FROM w) x JOIN terms
        ON single AND part AND starts_with(gram, term)),
g AS (SELECT doc_id, gram FROM w
      UNION ALL
      SELECT doc_id, gram FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(tok)), lambda i:
          CASE WHEN regexp_full_match(gap[i + 1], '[- ]+') THEN tok[i] || ' ' || tok[i + 1] END)) AS gram
        FROM d WHERE len(tok) >= 2) WHERE gram IS NOT NULL),
h AS (SELECT DISTINCT doc_id FROM g WHERE gram IN (SELECT term FROM terms)
      UNION SELECT doc_id FROM w WHERE gram IN (SELECT gram FROM met))
SELECT doc_id, doc_id IN (SELECT doc_id FROM h) AS found FROM documents
""")
def q_large_dictionary_tag(spark, sf):
    terms = _term_table(spark, sf).select("term", DS.part_flag(F.col("part")).alias("part"))
    return DT.large_dictionary_tag(_docs(spark, sf), "doc_id", "text", terms)


# Every first word of a pair is a term itself, and the shorter term wins: so of
# each token the shortest beginning that is a term (of whole words, the token).
@register("large_dictionary_spans", op="D11 (spans)", sql=f"""
WITH terms AS (SELECT term, bool_or(CASE WHEN trim(part) = '0' THEN false ELSE length(trim(part)) > 0 END) AS part
               FROM ({TERM_TABLE_SQL}) WHERE NOT contains(term, ' ') GROUP BY term),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS tok,
        string_split_regex(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS gap FROM documents),
u AS (SELECT doc_id, unnest(tok) AS tok, unnest(gap[1:len(tok)]) AS gap, unnest(range(len(tok))) AS i FROM d),
p AS (SELECT doc_id, tok, sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i) - length(tok) AS start FROM u),
lens AS (SELECT DISTINCT length(term) AS n FROM terms WHERE part),
best AS (SELECT tok, min(length(term)) AS n FROM (
    SELECT tok, term FROM (SELECT DISTINCT tok FROM u) t JOIN lens ON n <= length(tok) JOIN terms ON part AND term = left(tok, n)
    UNION ALL SELECT tok, tok FROM (SELECT DISTINCT tok FROM u) t WHERE tok IN (SELECT term FROM terms)) GROUP BY tok),
m AS (SELECT doc_id, count(*) AS n, sum(best.n) AS chars, min(start) AS first, sum(start) AS starts FROM p JOIN best USING (tok) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_matches, CAST(coalesce(chars, 0) AS BIGINT) AS matched_chars,
  CAST(first AS INTEGER) AS first_start, CAST(starts AS BIGINT) AS sum_of_starts
FROM documents LEFT JOIN m ON m.doc_id = documents.doc_id
""")
def q_large_dictionary_spans(spark, sf):
    """Counts and spans of the whole term table."""
    terms = _term_table(spark, sf).select("term", DS.part_flag(F.col("part")).alias("part"))
    found = DT.large_dictionary_spans(_docs(spark, sf), "doc_id", "text", terms)
    # the spans of a text are added up where they are found
    any_span = F.size("spans") > 0
    row = found.select("doc_id", "n_matches",
                       F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("chars"),
                       F.array_min(F.transform("spans", lambda s: s["start"])).alias("first"),
                       F.when(any_span, F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["start"])).alias("starts"))
    return row.groupBy("doc_id", "n_matches").agg(F.sum("chars").alias("matched_chars"), F.min("first").alias("first_start"),
                                                  F.sum("starts").alias("sum_of_starts"))


# --- the flagship rule as a streaming job ------------------------------------------------
@register("stream_polarity_rule", op="D7 (stream)", sql=POLARITY_SQL)
def q_stream_polarity_rule(spark, sf):
    """Documents arriving as files are tagged incrementally by the same
    expressions; the appended sink equals the batch result."""
    from ..sources.tables import SCHEMAS, table_path
    from ..streaming.tagging import run_to_completion, stream_table
    src = stream_table(spark, table_path(sf, "documents"), SCHEMAS["documents"])

    def tag(df):
        out = LX.polarity_rule(df.select("doc_id", "text"), "text", FX.UP, FX.DOWN)
        return out.select("doc_id", F.col("num_hawkish").cast("bigint"),
                          F.col("num_dovish").cast("bigint"), "prediction")
    base = scratch_path(spark, "stream")
    return run_to_completion(src, tag, f"{base}/sink", f"{base}/checkpoint")



# --- D3 in long form -----------------------------------------------------------------
def _spans_long_sql(lex):
    p = lex.ascii_pattern()
    return f"""
WITH d AS ({MASKED_DOCS}),
s AS (SELECT doc_id, regexp_extract_all(t, '{p}') AS m,
             list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gl FROM d),
e AS (SELECT doc_id, m, gl, list_transform(m, lambda x: length(x)) AS ml FROM s),
x AS (SELECT doc_id, m, gl, ml, unnest(range(1, len(m) + 1)) AS k FROM e)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS i, m[k] AS term,
  CAST(list_sum(gl[1:k]) + coalesce(list_sum(ml[1:k-1]), 0) AS INTEGER) AS start,
  CAST(list_sum(gl[1:k]) + coalesce(list_sum(ml[1:k-1]), 0) + ml[k] AS INTEGER) AS "end"
FROM x
"""


@register("tag_all_long", op="D3 (long)", sql=_spans_long_sql(FX.LEX_A))
def q_tag_all_long(spark, sf):
    return LX.match_spans_long(_docs(spark, sf), "doc_id", "text", FX.LEX_A)
