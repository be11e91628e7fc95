"""The table side of model labelling: prompts, budget, scoring through an
injected scorer, and parsing of free-text or JSON answers (L1-L7, J7).

Scoring is the only step that leaves the JVM: ``mapInPandas`` hands Arrow
batches to a scorer built once per task (one client per partition), and the
row key travels with every answer, so answers are joined back by key -- never
by position.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count


def render_prompt(text: Column, head: str, tail: str = "") -> Column:
    """L1: fixed template around the text. ``concat``, not a format string:
    texts may hold ``%``."""
    return F.concat(F.lit(head), F.coalesce(text, F.lit("")), F.lit(tail))


def prompt_budget(prompt: Column, limit: int = 16385, chars_per_token: int = 5) -> Column:
    """L2: ``struct(n_tokens, status, short_prompt)``. Prompts over ``limit``
    tokens are not sent (status ``too_long``); the shortened prompt of
    ``limit // chars_per_token`` characters is computed for them. Tokens are
    blank-separated words."""
    n = word_count(prompt)
    over = n > limit
    return F.struct(n.cast("bigint").alias("n_tokens"),
                    F.when(over, "too_long").otherwise("ok").alias("status"),
                    F.when(over, F.substring(prompt, 1, limit // chars_per_token))
                    .alias("short_prompt"))


def ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers run the
    scorer without the package being installed on them (no ``--py-files``
    needed; user scorers from other modules are shipped the usual way)."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


ScorerFactory = Callable[[], Callable[[Sequence[str]], Sequence[str | None]]]


def word_count_scorer() -> Callable[[Sequence[str]], list[str]]:
    """Deterministic stand-in for a hosted model: answers a JSON object with
    the number of words of the prompt. Used by tests and the registered
    queries; real deployments inject a client factory instead."""
    def score(texts: Sequence[str]) -> list[str]:
        return [json.dumps({"n_words": len((t or "").split())}) for t in texts]
    return score


def score_with_model(df: DataFrame, keys: Sequence[str], text: str,
                     scorer_factory: ScorerFactory = word_count_scorer,
                     out: str = "response") -> DataFrame:
    """L3: call the scorer on Arrow batches, keys carried along.

    The factory runs once per task (so a network client is opened once per
    partition); batches are bounded by
    ``spark.sql.execution.arrow.maxRecordsPerBatch``."""
    keys = list(keys)
    schema = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes) + f", {out} string"
    ship_by_value()

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        score = scorer_factory()
        for pdf in batches:
            res = pdf[keys].copy()
            res[out] = list(score(pdf[text].tolist()))
            yield res

    return df.select(*keys, text).mapInPandas(run, schema)


def score_resumable(df: DataFrame, keys: Sequence[str], text: str, store: str, scorer_factory: ScorerFactory = word_count_scorer,
                    out: str = "response", retries: int = 2, wait: float = 1.0, batch: int = 16,
                    calls_per_second: float | None = None) -> DataFrame:
    """L3 that survives failures: answers are kept in ``store`` (Parquet, in a
    folder that all executors share), one row a key, and a run asks only for
    the rows of ``df`` that have no answer there yet. Returns ``keys, out,
    status, attempts`` for every row of ``df``.

    Rows go to the scorer in batches of ``batch``. A batch that raises is tried
    again ``retries`` times, after ``wait`` seconds, then twice that, and so
    on; then its rows are tried one by one, and a row that still fails gets
    status ``failed`` and a null answer (never that of another row). A null
    answer of the scorer counts as a failure of its row. Failed rows are not
    kept and are asked for again by the next run. ``calls_per_second`` bounds
    the calls of a task.

    A run is written ahead in slices of its keys (``SLICES_CONF``): a slice that
    is written stays answered if the run breaks off later, the slice at hand is
    asked for again. Keys that are equal (null counts as a value) share one
    answer; of rows that differ in text under one key, the least text is asked.
    """
    import os
    import time
    import uuid

    spark, keys = df.sparkSession, list(keys)
    types_of = dict(df.select(*keys).dtypes)
    ddl = ", ".join(f"`{k}` {types_of[k]}" for k in keys) + f", `{out}` string, status string, attempts int"
    ship_by_value()
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c

    def kept() -> DataFrame:
        """Answers of earlier runs, one a key."""
        try:
            rows = spark.read.schema(ddl).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(store)
        except Exception as e:  # noqa: BLE001 - a first run has no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], ddl)
        return rows.where("status = 'ok'").groupBy(*keys).agg(F.min(F.struct(out, "status", "attempts")).alias("a")).select(*keys, "a.*")

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        score, last = scorer_factory(), [0.0]

        def call(texts: list) -> list:
            if calls_per_second:
                time.sleep(max(0.0, last[0] + 1 / calls_per_second - time.monotonic()))
                last[0] = time.monotonic()
            answers = list(score(texts))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
            return answers

        def tried(texts: list) -> tuple[list, int]:
            for attempt in range(retries + 1):
                try:
                    return call(texts), attempt + 1
                except Exception:  # noqa: BLE001 - whatever a client raises
                    if attempt < retries:
                        time.sleep(wait * 2 ** attempt)
            return [None] * len(texts), retries + 1

        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k:k + batch]
                texts = [None if t is None or t != t else t for t in part[text].tolist()]
                answers, attempts = tried(texts)
                counts = [attempts] * len(texts)
                for i, a in enumerate(answers):
                    if a is None and len(texts) > 1:
                        (answers[i],), more = tried([texts[i]])
                        counts[i] += more
                res = part[keys].copy()
                res[out], res["attempts"] = answers, counts
                res["status"] = ["failed" if a is None else "ok" for a in answers]
                yield res[[*keys, out, "status", "attempts"]]

    once = df.select(*keys, text).groupBy(*keys).agg(F.min(text).alias(text))
    open_ = once.alias("l").join(kept().alias("r"), on, "left_anti").select(*[F.col(f"l.{k}") for k in keys], F.col(f"l.{text}"))
    # written ahead in slices: what a slice has answered stays answered if a later one breaks off
    path = os.path.join(store, f"run-{uuid.uuid4().hex[:12]}")
    slices = max(1, int(spark.conf.get(SLICES_CONF, "8")))
    slot = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slices))
    for s in range(slices):
        open_.where(slot == s).mapInPandas(run, ddl).write.parquet(os.path.join(path, f"slice={s}"))
    ran = spark.read.schema(ddl).option("recursiveFileLookup", "true").parquet(path).where("status <> 'ok'")
    answers = kept().unionByName(ran.dropDuplicates(keys))
    joined = df.alias("l").join(answers.alias("r"), on, "left")
    return joined.select(*[F.col(f"l.{k}") for k in keys], F.col(f"r.{out}"), F.col("r.status"), F.col("r.attempts"))


SLICES_CONF = "tagwright.scoring.slices"     # writes of a resumable run; each is kept as a whole


def classify_response(resp: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """L4: the first needle contained in the answer decides the label
    (case-sensitive, fixed precedence); none -> null."""
    out = None
    for needle, label in rules:
        cond = resp.contains(needle)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


FED_RULES = [("hawkish", "hawkish"), ("dovish", "dovish"), ("neutral", "neutral")]


def strip_json_fence(resp: Column, only_if_fenced: bool = True) -> Column:
    """Remove a leading ```json line and a closing fence."""
    stripped = F.replace(F.replace(resp, F.lit("```json\n"), F.lit("")), F.lit("\n```"), F.lit(""))
    if only_if_fenced:
        return F.when(resp.contains("```json"), stripped).otherwise(resp)
    return stripped


JSON_OPTIONS = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def parse_json_response(resp: Column, field: str, field_type: str = "int") -> Column:
    """``struct(value, ok, typed)`` for one field of a JSON answer.

    ``ok``: the whole answer is one valid JSON object (no text after it, no
    single quotes) that has the field, whatever the field's type. ``value``:
    the field as ``field_type``, also from a number or a string of that
    value (1.0 and "1" are the integer 1), else null; ``typed``: it is not
    null. The reader stops after the first JSON value, so the answer is read
    inside an array and inside an object: what is valid in both has nothing
    left over."""
    alone = F.from_json(F.concat(F.lit("["), resp, F.lit("]")), "array<string>", JSON_OPTIONS)
    fields = F.from_json(F.concat(F.lit('{"a":'), resp, F.lit("}")), "a map<string,string>", JSON_OPTIONS)["a"]
    ok = (F.size(alone) == 1) & alone[0].isNotNull() & F.map_contains_key(fields, F.lit(field))
    raw = fields[field]
    value = raw.try_cast(field_type)
    if field_type.lower() in ("tinyint", "smallint", "int", "integer", "bigint", "long"):
        number = raw.try_cast("double")
        value = F.coalesce(value, F.when(number == F.floor(number), number.try_cast(field_type)))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, value).alias("value"), ok.alias("ok"),
                    F.coalesce(ok & value.isNotNull(), F.lit(False)).alias("typed"))
