"""Registered queries for model answers and method comparison
(L1-L7, J7, C12, C13, E1-E7, E9, J5, J6, J9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import corpus as CO
from ..operators import evaluate as EV
from ..operators import lexicon as LX
from ..operators import responses as RS
from ..operators import split as SP
from ..session import materialize, scratch_path
from ..sources.tables import read_table
from . import fixtures as FX
from . import sqlbits as SB
from .registry import masked, register

PROMPT_HEAD = ("Classify the following message as hawkish, dovish or neutral. "
               "Answer with one word.\nMessage: ")
PROMPT_TAIL = "\nAnswer:"
# budget for the test prose (the original's model limit is 16385 tokens)
PROMPT_LIMIT = 300


def _conv(spark, sf):
    return read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])


def _sq(s: str) -> str:
    return s.replace("'", "''").replace("\n", "' || chr(10) || '")


PROMPT_SQL = f"'{_sq(PROMPT_HEAD)}' || coalesce(text, '') || '{_sq(PROMPT_TAIL)}'"


@register("prompt_render", op="L1", sql=f"""
SELECT conv_id, turn, {PROMPT_SQL} AS prompt FROM conversations
""")
def q_prompt_render(spark, sf):
    c = _conv(spark, sf)
    return c.select("conv_id", "turn", RS.render_prompt(F.col("text"), PROMPT_HEAD, PROMPT_TAIL)
                    .alias("prompt"))


@register("prompt_budget", op="L2", sql=f"""
WITH p AS (SELECT conv_id, turn, {PROMPT_SQL} AS prompt FROM conversations)
SELECT conv_id, turn, {SB.word_count('prompt')} AS n_tokens,
  CASE WHEN {SB.word_count('prompt')} > {PROMPT_LIMIT} THEN 'too_long' ELSE 'ok' END AS status,
  CASE WHEN {SB.word_count('prompt')} > {PROMPT_LIMIT} THEN substring(prompt, 1, {PROMPT_LIMIT // 5})
  END AS short_prompt
FROM p
""")
def q_prompt_budget(spark, sf):
    c = _conv(spark, sf)
    b = RS.prompt_budget(RS.render_prompt(F.col("text"), PROMPT_HEAD, PROMPT_TAIL), PROMPT_LIMIT)
    return c.select("conv_id", "turn", b.alias("b")).select("conv_id", "turn", "b.*")


@register("score_with_model", op="L3", sql=f"""
SELECT conv_id, turn, '{{"n_words": ' || CAST({SB.word_count('text')} AS VARCHAR) || '}}' AS response
FROM conversations
""")
def q_score_with_model(spark, sf):
    """Answers of the stand-in scorer (a JSON word count) for every turn."""
    return RS.score_with_model(_conv(spark, sf), ["conv_id", "turn"], "text")


def _faulty_scorer():
    """The stand-in scorer, whose requests fail where a text's word count ends in 7
    and another text comes with it (so that the text succeeds alone)."""
    score = RS.word_count_scorer()

    def run(texts):
        if len(texts) > 1 and any(len((t or "").split()) % 10 == 7 for t in texts):
            raise OSError("request failed")
        return score(texts)
    return run


@register("score_resumable", op="L3 (resumed)", sql=f"""
SELECT conv_id, turn, '{{"n_words": ' || CAST({SB.word_count('text')} AS VARCHAR) || '}}' AS response, 'ok' AS status
FROM conversations
""")
def q_score_resumable(spark, sf):
    """Answers of a scorer whose requests fail at times, asked for in two runs:
    the second takes up what the first, over the user's turns, has kept."""
    store, keys = scratch_path(spark, "answers"), ["conv_id", "turn"]
    c = _conv(spark, sf)
    RS.score_resumable(c.where("role = 'user'"), keys, "text", store, _faulty_scorer, retries=0, wait=0)
    return RS.score_resumable(c, keys, "text", store, _faulty_scorer, retries=0, wait=0).drop("attempts")


@register("join_positional", op="J7", sql=f"""
SELECT conv_id, turn, role, {SB.word_count('text')} AS n_words FROM conversations
""")
def q_join_positional(spark, sf):
    """Answers are joined back on the carried key, never by position."""
    c = _conv(spark, sf)
    ans = RS.score_with_model(c, ["conv_id", "turn"], "text")
    parsed = ans.select("conv_id", "turn",
                        RS.parse_json_response(F.col("response"), "n_words", "bigint")["value"]
                        .alias("n_words"))
    return c.select("conv_id", "turn", "role").join(parsed, ["conv_id", "turn"], "left")


CLASSIFY_RULES = [("the", "the"), ("der", "der"), ("que", "que")]


@register("classify_response", op="L4", sql="""
SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'der') THEN 'der'
  WHEN contains(text, 'que') THEN 'que' END AS label FROM conversations
""")
def q_classify_response(spark, sf):
    c = _conv(spark, sf)
    return c.select("conv_id", "turn", RS.classify_response(F.col("text"), CLASSIFY_RULES)
                    .alias("label"))


def _fenced(col):
    return F.concat(F.lit("```json\n"), col, F.lit("\n```"))


@register("strip_json_fence", op="L5", sql="""
SELECT event_id, props AS cleaned, props AS cleaned_always FROM events
""")
def q_strip_json_fence(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "props"])
    f = _fenced(F.col("props"))
    return e.select("event_id", RS.strip_json_fence(f, True).alias("cleaned"),
                    RS.strip_json_fence(f, False).alias("cleaned_always"))


# answers of every kind: plain, with text after them, in single quotes, with a
# float, a string, another field, inside a list, and fenced
ANSWERS_SQL = """SELECT event_id, props, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN props || ' I think so'
  WHEN 2 THEN replace(props, '"', '''') WHEN 3 THEN '{"k": ' || json_extract_string(props, '$.k') || '.0}'
  WHEN 4 THEN '{"k": "' || json_extract_string(props, '$.k') || '"}' WHEN 5 THEN '{"q": 1}'
  WHEN 6 THEN '[' || props || ']' ELSE props END AS answer FROM events"""
PARSE_SQL = f"""SELECT event_id, CASE WHEN ok THEN TRY_CAST(TRY_CAST(json_extract_string(answer, '$.k') AS DOUBLE)
  AS INTEGER) END AS k, ok FROM (SELECT *, coalesce(json_valid(answer) AND json_type(CASE WHEN json_valid(answer)
  THEN answer END) = 'OBJECT' AND json_exists(CASE WHEN json_valid(answer) THEN answer END, '$.k'), false) AS ok
  FROM ({ANSWERS_SQL}))"""


def _answers(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "props"])
    p, k = F.col("props"), F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 8
    answer = (F.when(kind == 0, p).when(kind == 1, F.concat(p, F.lit(" I think so")))
              .when(kind == 2, F.replace(p, F.lit('"'), F.lit("'"))).when(kind == 3, F.concat(F.lit('{"k": '), k, F.lit(".0}")))
              .when(kind == 4, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).when(kind == 5, F.lit('{"q": 1}'))
              .when(kind == 6, F.concat(F.lit("["), p, F.lit("]"))).otherwise(_fenced(p)))
    return e.select("event_id", answer.alias("answer"))


def _parsed(spark, sf):
    r = RS.parse_json_response(RS.strip_json_fence(F.col("answer")), "k", "int")
    return _answers(spark, sf).select("event_id", r["value"].alias("k"), r["ok"].alias("ok"))


@register("parse_json_response", op="L6", sql=PARSE_SQL)
def q_parse_json_response(spark, sf):
    return _parsed(spark, sf)


@register("parse_success_rate", op="L7", sql=f"""
SELECT CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM ({PARSE_SQL})
GROUP BY 1
""")
def q_parse_success_rate(spark, sf):
    p = _parsed(spark, sf)
    return p.groupBy(F.when(F.col("ok"), "ok").otherwise("failed").alias("status")).agg(
        F.count("*").alias("n"))


@register("argmax", op="C12", sql="""
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax
FROM embeddings
""")
def q_argmax(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return e.select("vec_id", TX.argmax(F.col("embedding")).alias("argmax"))


def _truncate_sql(limit):
    return f"""
WITH L AS (SELECT least(512, {limit}) AS n FROM documents)
SELECT doc_id, CAST(least(len({SB.word_tokens('text')}), (SELECT n FROM L)) AS BIGINT) AS n_units,
  array_to_string({SB.word_tokens('text')}[1:(SELECT n FROM L)], ' ') AS truncated
FROM documents
"""


def _truncated(spark, sf, by):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return TX.truncate_length(d, "text", by=by).select("doc_id", "n_units", "truncated")


@register("truncate_length", op="C13", sql=_truncate_sql("length(max(text))"))
def q_truncate_length(spark, sf):
    return _truncated(spark, sf, "lexmax")


@register("truncate_length_longest", op="C13", sql=_truncate_sql("max(length(text))"))
def q_truncate_length_longest(spark, sf):
    return _truncated(spark, sf, "longest")


# --- method comparison on the labelled documents -----------------------------------
# quality 1 -> "high", 0 -> "low"; codes are alphabetical (high = 0, low = 1)
FILL = "low"
META_ROWS = [("dictionary", len(FX.LEX_A.terms) + len(FX.LEX_B.terms) + len(FX.LEX_C.terms),
              "Dictionary"), ("length", 1, "Word count"), ("constant", 0, "Constant")]


def truth_and_test(spark, sf):
    lab = read_table(spark, sf, "labels", ["doc_id", "quality"])
    lab = lab.select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("label"))
    test = SP.train_test_split(lab, "doc_id", FX.SEED, FX.TEST_SHARE).where(F.col("split") == "test")
    return test.select("doc_id", "label")


def predictions(spark, sf, test=None):
    """The three methods' answers in one pass over the texts: each test article
    emits a row per method that covers it."""
    test = test if test is not None else truth_and_test(spark, sf)
    d = read_table(spark, sf, "documents", ["doc_id", "text", "lang"]).join(
        test.select("doc_id"), "doc_id", "left_semi")
    rule = LX.all_dictionaries_rule("text", [FX.LEX_A, FX.LEX_B, FX.LEX_C])
    const = F.when(F.col("lang") == "fr", F.lit(None).cast("string")).otherwise("high")

    def answer(method, value):
        return F.struct(F.lit(method).alias("method"), value.alias("prediction"))
    rows = F.array(answer("dictionary", F.when(rule == 1, "high").otherwise("low")),
                   answer("length", F.when(TX.word_count(F.col("text")) > 100, "0").otherwise("1")),
                   F.when(F.col("lang") != "es", answer("constant", const)))
    out = d.select("doc_id", F.explode_outer(rows).alias("p")).where("p IS NOT NULL")
    return out.select("p.method", "doc_id", "p.prediction")


def codes_of(spark, sf, test=None):
    test = test if test is not None else truth_and_test(spark, sf)
    return CO.category_codes(test, "label")


def meta_table(spark):
    return spark.createDataFrame(META_ROWS, "method string, num_params bigint, clean_name string")


def normalized(spark, sf, test=None):
    """Normalised predictions. The raw ones are read by several aggregates, so
    they are written once (ids and short answers, no texts)."""
    test = test if test is not None else truth_and_test(spark, sf)
    raw = materialize(predictions(spark, sf, test), "predictions")
    return EV.normalize_predictions(raw, codes_of(spark, sf, test), fill=FILL)


def per_method_accuracy(spark, sf):
    test = materialize(truth_and_test(spark, sf), "truth")
    norm = materialize(normalized(spark, sf, test), "normalized")
    common = EV.common_keys(norm, ["doc_id"], n_methods=len(META_ROWS))
    j = common.join(test, "doc_id", "inner")
    return EV.accuracy(j, "prediction", "label", ["method"])


def scores(spark, sf):
    sc = EV.attach_metadata(per_method_accuracy(spark, sf), meta_table(spark))
    return sc.withColumn("error_rate", F.round(1 - F.col("correct") / F.col("total"), 6))


TEST_SQL = f"""SELECT doc_id, label FROM (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS label,
    row_number() OVER (ORDER BY {SB.md5_key(FX.SEED, 'doc_id')}, doc_id) - 1 AS rk,
    count(*) OVER () AS n FROM labels) WHERE rk < ceil(n * 0.2)"""


def _flag_sql(lex):
    return f"regexp_matches({masked('d.text')}, '{lex.ascii_pattern()}')"


PREDS_SQL = f"""SELECT 'dictionary' AS method, d.doc_id, CASE WHEN {_flag_sql(FX.LEX_A)} AND
    {_flag_sql(FX.LEX_B)} AND {_flag_sql(FX.LEX_C)} THEN 'high' ELSE 'low' END AS prediction
  FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM ({TEST_SQL}))
UNION ALL SELECT 'length', d.doc_id, CASE WHEN {SB.word_count('d.text')} > 100 THEN '0' ELSE '1' END
  FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM ({TEST_SQL}))
UNION ALL SELECT 'constant', d.doc_id, CASE WHEN d.lang = 'fr' THEN NULL ELSE 'high' END
  FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM ({TEST_SQL})) AND d.lang <> 'es'"""

NORM_SQL = f"""SELECT p.method, p.doc_id, coalesce(CASE WHEN coalesce(k.is_int, false) THEN
    (CASE TRY_CAST(p.prediction AS INTEGER) WHEN 0 THEN 'high' WHEN 1 THEN 'low' END)
    ELSE p.prediction END, '{FILL}') AS prediction
  FROM ({PREDS_SQL}) p JOIN (SELECT method, bool_and(CASE WHEN prediction IS NULL THEN NULL
    ELSE regexp_matches(prediction, '^-?[0-9]+$') END) AS is_int FROM ({PREDS_SQL}) GROUP BY method) k
  ON p.method = k.method"""

COMMON_SQL = f"""SELECT * FROM ({NORM_SQL}) WHERE doc_id IN (SELECT doc_id FROM ({NORM_SQL})
  GROUP BY doc_id HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM ({NORM_SQL})))"""

ACC_SQL = f"""SELECT method, CAST(sum(CASE WHEN c.prediction = t.label THEN 1 ELSE 0 END) AS BIGINT)
    AS correct, count(*) AS total FROM ({COMMON_SQL}) c JOIN ({TEST_SQL}) t ON c.doc_id = t.doc_id
  GROUP BY method"""

META_SQL = "(VALUES " + ", ".join(f"('{m}', {p}, '{c}')" for m, p, c in META_ROWS) + \
    ") AS m(method, num_params, clean_name)"

SCORES_SQL = f"""SELECT a.method, a.correct, a.total, round(a.correct / a.total, 6) AS accuracy,
    CAST(m.num_params AS BIGINT) AS num_params, m.clean_name,
    round(1 - a.correct / a.total, 6) AS error_rate
  FROM ({ACC_SQL}) a LEFT JOIN {META_SQL} ON a.method = m.method"""

DOMINATED_SQL = f"""SELECT *, coalesce(min(error_rate) OVER (ORDER BY num_params RANGE BETWEEN
  UNBOUNDED PRECEDING AND 1 PRECEDING) < error_rate, false) AS dominated FROM ({SCORES_SQL})"""


@register("accuracy", op="E1", sql=f"""
SELECT CAST(sum(CASE WHEN p.prediction = t.label THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  count(*) AS total,
  round(sum(CASE WHEN p.prediction = t.label THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM ({PREDS_SQL}) p JOIN ({TEST_SQL}) t ON p.doc_id = t.doc_id WHERE p.method = 'dictionary'
""")
def q_accuracy(spark, sf):
    test = truth_and_test(spark, sf)
    p = predictions(spark, sf, test).where(F.col("method") == "dictionary")
    return EV.accuracy(p.join(test, "doc_id"), "prediction", "label")


@register("normalize_predictions", op="E2", sql=NORM_SQL)
def q_normalize_predictions(spark, sf):
    return normalized(spark, sf).select("method", "doc_id", "prediction")


@register("join_predictions_all_methods", op="J5", sql=COMMON_SQL)
def q_join_predictions_all_methods(spark, sf):
    norm = materialize(normalized(spark, sf), "normalized")
    return EV.common_keys(norm, ["doc_id"], n_methods=len(META_ROWS)).select(
        "method", "doc_id", "prediction")


# every seventh article has a second answer of one method, every fifth of another
TWICE_SQL = f"""SELECT * FROM ({NORM_SQL}) UNION ALL SELECT method, doc_id, prediction || '?' FROM ({NORM_SQL})
  WHERE method = 'length' AND doc_id % 7 = 0 OR method = 'dictionary' AND doc_id % 5 = 0"""


@register("join_predictions_wide", op="J5 (wide)", sql=f"""
WITH p AS ({TWICE_SQL})
SELECT a.doc_id, a.prediction AS dictionary, b.prediction AS length, c.prediction AS constant
FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.method = 'length' JOIN p c ON a.doc_id = c.doc_id AND c.method = 'constant'
WHERE a.method = 'dictionary'
""")
def q_join_predictions_wide(spark, sf):
    """A column a method; articles with several answers of a method are multiplied."""
    norm = materialize(normalized(spark, sf).select("method", "doc_id", "prediction"), "normalized")
    again = norm.where("method = 'length' AND doc_id % 7 = 0 OR method = 'dictionary' AND doc_id % 5 = 0")
    both = norm.unionByName(again.withColumn("prediction", F.concat("prediction", F.lit("?"))))
    return EV.predictions_wide(both, ["doc_id"], ["dictionary", "length", "constant"])


@register("macro_metrics", op="E3", sql=f"""
WITH j AS (SELECT c.method, c.prediction AS p, t.label AS y FROM ({COMMON_SQL}) c
           JOIN ({TEST_SQL}) t ON c.doc_id = t.doc_id),
sup AS (SELECT method, y AS cls, count(*) AS support, sum(CASE WHEN p = y THEN 1 ELSE 0 END) AS tp
        FROM j GROUP BY method, y),
prd AS (SELECT method, p AS cls, count(*) AS n_pred FROM j WHERE p IS NOT NULL GROUP BY method, p),
cls AS (SELECT coalesce(s.method, q.method) AS method, coalesce(s.support, 0) AS support,
               coalesce(s.tp, 0) AS tp, coalesce(q.n_pred, 0) AS n_pred
        FROM sup s FULL OUTER JOIN prd q ON s.method = q.method AND s.cls = q.cls),
pr AS (SELECT method, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pp,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rr FROM cls)
SELECT m.method, m.macro_precision, m.macro_recall, m.macro_f1, a.accuracy FROM (
  SELECT method, round(avg(pp), 6) AS macro_precision, round(avg(rr), 6) AS macro_recall,
    round(avg(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0.0 END), 6) AS macro_f1
  FROM pr GROUP BY method) m
JOIN (SELECT method, round(avg(CASE WHEN p = y THEN 1 ELSE 0 END), 6) AS accuracy FROM j
      GROUP BY method) a ON m.method = a.method
""")
def q_macro_metrics(spark, sf):
    test = materialize(truth_and_test(spark, sf), "truth")
    norm = materialize(normalized(spark, sf, test), "normalized")
    common = EV.common_keys(norm, ["doc_id"], n_methods=len(META_ROWS))
    j = common.join(test, "doc_id", "inner")
    return EV.macro_metrics(j, "prediction", "label", ["method"])


@register("accuracy_by_method", op="E4", sql=f"""
SELECT method, correct, total, round(correct / total, 6) AS accuracy FROM ({ACC_SQL})
""")
def q_accuracy_by_method(spark, sf):
    return per_method_accuracy(spark, sf)


@register("error_rate", op="E5", sql=f"""
SELECT method, error_rate FROM ({SCORES_SQL})
""")
def q_error_rate(spark, sf):
    return scores(spark, sf).select("method", "error_rate")


@register("join_metadata", op="J6", sql=f"""
SELECT method, num_params, clean_name, accuracy FROM ({SCORES_SQL})
""")
def q_join_metadata(spark, sf):
    return scores(spark, sf).select("method", "num_params", "clean_name", "accuracy")


@register("dominated_flag", op="E6", sql=f"""
SELECT method, num_params, error_rate, dominated FROM ({DOMINATED_SQL})
""")
def q_dominated_flag(spark, sf):
    return EV.dominated_flag(materialize(scores(spark, sf), "scores")).select("method", "num_params", "error_rate",
                                                       "dominated")


@register("theta_self_join_dominance", op="J9", sql=f"""
SELECT method, dominated FROM ({DOMINATED_SQL})
""")
def q_theta_self_join_dominance(spark, sf):
    return EV.dominated_by_join(materialize(scores(spark, sf), "scores")).select("method", "dominated")


@register("pareto_frontier", op="E7", sql=f"""
SELECT method, num_params FROM ({DOMINATED_SQL}) WHERE NOT dominated
""")
def q_pareto_frontier(spark, sf):
    return EV.pareto_frontier(materialize(scores(spark, sf), "scores")).select("method", "num_params")


@register("scoreboard", op="E9", sql=f"""
SELECT method, clean_name, num_params, correct, total, accuracy, error_rate, dominated
FROM ({DOMINATED_SQL})
""")
def q_scoreboard(spark, sf):
    test = materialize(truth_and_test(spark, sf), "truth")
    sb = EV.scoreboard(materialize(predictions(spark, sf, test), "predictions"), test, ["doc_id"],
                       codes_of(spark, sf, test), meta_table(spark), fill=FILL,
                       n_methods=len(META_ROWS))
    return sb.select("method", "clean_name", "num_params", "correct", "total", "accuracy",
                     "error_rate", "dominated")
