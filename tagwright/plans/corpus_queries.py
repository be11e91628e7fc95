"""Registered queries for corpus construction, votes, joins and splits
(U1, C1-C11, J1-J4, A1-A10, X8, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import corpus as CO
from ..operators import split as SP
from ..sources.tables import read_table
from . import fixtures as FX
from . import sqlbits as SB
from .registry import register

SOURCE_NAMES = {"de": "historical", "en": "modern", "es": "midcentury",
                "fr": "historical_oversample"}


def _docs(spark, sf, cols=("doc_id", "text")):
    return read_table(spark, sf, "documents", list(cols))


# --- votes over events ------------------------------------------------------------
def votes(spark, sf):
    """One row per coder vote: key (user_id, day), vote 0/1."""
    ev = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    return ev.select("event_id", "user_id", F.to_date("ts").alias("day"),
                     F.col("event_type").isin(*FX.VOTE_TYPES).cast("int").alias("vote"))


def unique_ids(spark, sf):
    """Per-(user, day) ids, with duplicates (one row per 'view' event)."""
    ev = read_table(spark, sf, "events", ["ts", "user_id", "event_type"])
    day = F.to_date("ts")
    return ev.where(F.col("event_type") == "view").select(
        "user_id", day.alias("day"),
        F.concat(F.lit("v"), F.col("user_id").cast("string"), F.lit("_"),
                 day.cast("string")).alias("unique_id"))


VOTES_SQL = """SELECT event_id, user_id, CAST(ts AS DATE) AS day,
  CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS vote FROM events"""
UIDS_SQL = """SELECT user_id, CAST(ts AS DATE) AS day,
  'v' || CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS unique_id
  FROM events WHERE event_type = 'view'"""
VOTED_SQL = f"""SELECT user_id, day, CASE WHEN 2 * s > n THEN 1 ELSE 0 END AS label FROM (
  SELECT user_id, day, sum(vote) AS s, count(vote) AS n FROM ({VOTES_SQL}) GROUP BY user_id, day)
  WHERE 2 * s <> n"""


@register("majority_vote", op="A1", sql=VOTED_SQL)
def q_majority_vote(spark, sf):
    return CO.majority_vote(votes(spark, sf), ["user_id", "day"], "vote")


@register("group_mean", op="A2", sql=f"""
SELECT user_id, day, round(avg(vote), 6) AS mean_vote FROM ({VOTES_SQL}) GROUP BY user_id, day
""")
def q_group_mean(spark, sf):
    return votes(spark, sf).groupBy("user_id", "day").agg(
        F.round(F.avg("vote"), 6).alias("mean_vote"))


@register("drop_duplicates", op="A3", sql="""
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events
""")
def q_drop_duplicates(spark, sf):
    ev = read_table(spark, sf, "events", ["ts", "user_id", "event_type"])
    return ev.select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()


@register("vote_then_attach", op="A4", sql=f"""
SELECT l.user_id, l.day, l.label, d.vote FROM ({VOTED_SQL}) l
LEFT JOIN (SELECT DISTINCT user_id, day, vote FROM ({VOTES_SQL})) d
  ON l.user_id = d.user_id AND l.day = d.day
""")
def q_vote_then_attach(spark, sf):
    v = votes(spark, sf)
    return CO.vote_then_attach(v, ["user_id", "day"], "vote",
                               v.select("user_id", "day", "vote"))


MASTER_SQL = f"""SELECT m.event_id, m.user_id, m.day, m.vote, u.unique_id FROM ({VOTES_SQL}) m
LEFT JOIN (SELECT DISTINCT * FROM ({UIDS_SQL})) u ON m.user_id = u.user_id AND m.day = u.day"""


def master(spark, sf):
    return votes(spark, sf).join(unique_ids(spark, sf).distinct(), ["user_id", "day"], "left")


@register("join_left_multikey", op="J2", sql=MASTER_SQL)
def q_join_left_multikey(spark, sf):
    return master(spark, sf).select("event_id", "user_id", "day", "vote", "unique_id")


@register("coalesce_key", op="C7", sql=f"""
SELECT event_id, coalesce(unique_id, CAST(user_id AS VARCHAR)) AS article_id FROM ({MASTER_SQL})
""")
def q_coalesce_key(spark, sf):
    m = master(spark, sf)
    return m.select("event_id", CO.coalesce_key(F.col("unique_id"), F.col("user_id"))
                    .alias("article_id"))


@register("drop_any_null", op="C5", sql=f"""
SELECT * FROM ({MASTER_SQL}) WHERE unique_id IS NOT NULL
""")
def q_drop_any_null(spark, sf):
    return master(spark, sf).select("event_id", "user_id", "day", "vote", "unique_id") \
        .dropna(how="any")


@register("join_inner_multikey", op="J1", sql=f"""
SELECT l.user_id, l.day, l.label, u.unique_id FROM ({VOTED_SQL}) l
JOIN (SELECT DISTINCT * FROM ({UIDS_SQL})) u ON l.user_id = u.user_id AND l.day = u.day
""")
def q_join_inner_multikey(spark, sf):
    lab = CO.majority_vote(votes(spark, sf), ["user_id", "day"], "vote")
    return lab.join(unique_ids(spark, sf).distinct(), ["user_id", "day"], "inner")


# --- documents as four article sources -------------------------------------------------
def sources_union(spark, sf):
    """Documents as articles of several sources: the language names the source
    (others keep their own name). One scan."""
    d = _docs(spark, sf, ("doc_id", "text", "lang"))
    names = F.create_map(*[F.lit(x) for pair in SOURCE_NAMES.items() for x in pair])
    vintage = F.coalesce(names[F.coalesce("lang", F.lit(""))], F.col("lang"), F.lit("unknown"))
    return d.select(F.col("doc_id").cast("string").alias("article_id"), "text", vintage.alias("vintage"))


def _sources_sql():
    names = " ".join(f"WHEN '{lang}' THEN '{name}'" for lang, name in SOURCE_NAMES.items())
    return (f"SELECT CAST(doc_id AS VARCHAR) AS article_id, text, CASE lang {names} "
            "ELSE coalesce(lang, 'unknown') END AS vintage FROM documents")


@register("union_sources", op="U1", sql="""
SELECT CAST(doc_id AS VARCHAR) AS article_id, text, 'modern' AS vintage FROM documents
UNION ALL SELECT CAST(item_id AS VARCHAR), text, 'midcentury' FROM benchmark
UNION ALL SELECT CAST(page_id AS VARCHAR), html, 'historical' FROM pages
""")
def q_union_sources(spark, sf):
    return CO.union_sources([
        (_docs(spark, sf, ("doc_id", "text")), "modern"),
        (read_table(spark, sf, "benchmark", ["item_id", "text"]), "midcentury"),
        (read_table(spark, sf, "pages", ["page_id", "html"]), "historical")])


@register("constant_column", op="C9", sql="""
SELECT doc_id, 'modern' AS vintage FROM documents
""")
def q_constant_column(spark, sf):
    d = _docs(spark, sf, ("doc_id",))
    return d.select("doc_id", F.lit("modern").alias("vintage"))


@register("project_rename", op="C8", sql="""
SELECT doc_id AS article_number, lang AS vintage, n_chars AS length FROM documents
""")
def q_project_rename(spark, sf):
    d = _docs(spark, sf, ("doc_id", "lang", "n_chars", "source"))
    return (d.withColumnRenamed("doc_id", "article_number").withColumnRenamed("lang", "vintage")
             .withColumnRenamed("n_chars", "length").drop("source"))


@register("consolidate_text", op="C3+C4+C5", sql=f"""
SELECT article_id, vintage, {SB.word_count('text')} AS num_words FROM ({_sources_sql()})
WHERE {SB.word_count('text')} > 100 AND text IS NOT NULL
""")
def q_consolidate_text(spark, sf):
    return CO.consolidate_text(sources_union(spark, sf)).select("article_id", "vintage",
                                                                "num_words")


@register("word_count", op="C3", sql=f"""
SELECT doc_id, {SB.word_count('text')} AS num_words FROM documents
""")
def q_word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.word_count(F.col("text")).cast("bigint")
                                   .alias("num_words"))


@register("min_words_filter", op="C4", sql=f"""
SELECT doc_id FROM documents WHERE {SB.word_count('text')} > 100
""")
def q_min_words_filter(spark, sf):
    counted = TX.with_column_once(_docs(spark, sf), "n", TX.word_count(F.col("text")))
    return counted.where(F.col("n") > 100).select("doc_id")


@register("vintage_filter", op="C6", sql="""
SELECT doc_id, lang FROM documents WHERE lang = 'en'
""")
def q_vintage_filter(spark, sf):
    return _docs(spark, sf, ("doc_id", "lang")).where(F.col("lang") == "en")


@register("clean_sequence", op="C1", sql=f"""
SELECT doc_id, {SB.clean_sequence('text')} AS text_clean FROM documents
""")
def q_clean_sequence(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.clean_sequence(F.col("text")).alias("text_clean"))


@register("clean_delete_punct", op="C2", sql=f"""
SELECT doc_id, {SB.clean_delete_punct('text')} AS text_clean FROM documents
""")
def q_clean_delete_punct(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.clean_delete_punct(F.col("text"))
                                   .alias("text_clean"))


@register("strip_accents_ascii", op="C11", sql="""
SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g') AS folded
FROM documents
""")
def q_strip_accents_ascii(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.strip_accents_ascii(F.lower("text"))
                                   .alias("folded"))


@register("label_encode", op="C10", sql="""
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code,
  lang AS decoded FROM documents
""")
def q_label_encode(spark, sf):
    d = _docs(spark, sf, ("doc_id", "lang"))
    codes = CO.category_codes(d, "lang")
    enc = CO.label_encode(d, "lang", "code", codes)
    return CO.label_decode(enc, "code", codes, "decoded").select("doc_id", "lang", "code",
                                                                 "decoded")


@register("category_count", op="A10", sql="""
SELECT count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source FROM documents
""")
def q_category_count(spark, sf):
    d = _docs(spark, sf, ("lang", "source"))
    return d.agg(F.count_distinct("lang").alias("n_lang"),
                 F.count_distinct("source").alias("n_source"))


@register("word_count_histogram", op="A9", sql=f"""
WITH w AS (SELECT {SB.word_count('text')} AS x FROM documents),
s AS (SELECT min(x) AS lo, max(x) AS hi FROM w)
SELECT CAST(least(floor((x - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS n
FROM w, s GROUP BY 1
""")
def q_word_count_histogram(spark, sf):
    w = _docs(spark, sf).select(TX.word_count(F.col("text")).alias("x"))
    return CO.equal_width_histogram(w, "x", 10)


@register("join_left_then_drop", op="J3", sql="""
SELECT l.doc_id, l.quality, d.text, d.lang FROM labels l
LEFT JOIN documents d ON l.doc_id = d.doc_id
WHERE l.quality IS NOT NULL AND d.text IS NOT NULL AND d.lang IS NOT NULL
""")
def q_join_left_then_drop(spark, sf):
    lab = read_table(spark, sf, "labels", ["doc_id", "quality"])
    return CO.join_left_then_drop(lab, _docs(spark, sf, ("doc_id", "text", "lang")), ["doc_id"])


@register("join_left_renamed_keys", op="J4", sql="""
SELECT l.doc_id, d.doc_id AS article, l.quality, d.lang FROM labels l
LEFT JOIN documents d ON l.doc_id = d.doc_id
""")
def q_join_left_renamed_keys(spark, sf):
    lab = read_table(spark, sf, "labels", ["doc_id", "quality"])
    d = _docs(spark, sf, ("doc_id", "lang")).withColumnRenamed("doc_id", "article")
    return lab.join(d, lab["doc_id"] == d["article"], "left").select(
        "doc_id", "article", "quality", "lang")


@register("duplicate_ids", op="X8", sql="""
SELECT conv_id, count(*) - 1 AS n_extra FROM conversations GROUP BY conv_id HAVING count(*) > 1
""")
def q_duplicate_ids(spark, sf):
    return CO.duplicate_keys(read_table(spark, sf, "conversations", ["conv_id"]), "conv_id")


@register("read_once", op="X8", sql="""
SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id
""")
def q_read_once(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return CO.read_once(c, "conv_id", ["turn"])


# --- splits --------------------------------------------------------------------------
H = SB.md5_key(FX.SEED, "doc_id")


@register("train_test_split", op="A5", sql=f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {H}, doc_id) - 1 AS rk,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r
""")
def q_train_test_split(spark, sf):
    return SP.train_test_split(_docs(spark, sf, ("doc_id",)), "doc_id", FX.SEED, FX.TEST_SHARE)


STRAT_SQL = f"""
WITH d AS (SELECT doc_id, lang, {H} AS h FROM documents),
c AS (SELECT lang, count(*) AS n_s FROM d GROUP BY lang),
t AS (SELECT sum(n_s) AS n, CAST(ceil(sum(n_s) * 0.2) AS BIGINT) AS total FROM c),
q0 AS (SELECT lang, n_s * total // n AS q, n_s * total % n AS r, total FROM c, t),
q AS (SELECT lang, q + CASE WHEN row_number() OVER (ORDER BY r DESC, lang)
                               <= total - sum(q) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) - 1 AS rk
      FROM d)
SELECT r.doc_id, r.lang, CASE WHEN rk < quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN q ON r.lang = q.lang
"""


@register("stratified_split", op="A6", sql=STRAT_SQL)
def q_stratified_split(spark, sf):
    return SP.stratified_split(_docs(spark, sf, ("doc_id", "lang")), "doc_id", "lang",
                               FX.SEED, FX.TEST_SHARE)


@register("group_sample_n", op="A7", sql=f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang,
  row_number() OVER (PARTITION BY lang ORDER BY {H}, doc_id) AS rn FROM documents) WHERE rn <= 5
""")
def q_group_sample_n(spark, sf):
    return SP.group_sample_n(_docs(spark, sf, ("doc_id", "lang")), "lang", "doc_id", 5, FX.SEED)


@register("sample_n", op="A8", sql=f"""
SELECT doc_id FROM documents ORDER BY {H}, doc_id LIMIT 10
""")
def q_sample_n(spark, sf):
    return SP.sample_n(_docs(spark, sf, ("doc_id",)), "doc_id", 10, FX.SEED)


@register("stratified_folds", op="M8", sql=f"""
SELECT doc_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY {H}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels
""")
def q_stratified_folds(spark, sf):
    lab = read_table(spark, sf, "labels", ["doc_id", "quality"])
    return SP.stratified_folds(lab, "doc_id", "quality", FX.SEED, FX.N_FOLDS)
