"""Hierarchical language identification (operator 8).

A text's family of languages is predicted first, then the language within it:
one-versus-one linear support vector machines at both levels, on hashed
2- and 3-byte grams of the lower-cased letters. A class wins by pairwise votes,
then by the sum of its margins.

Training reads a bounded sample, ``PER_CLASS`` labelled texts a class on
average, picked by a hash of id and text; each pair of classes is fitted in a
task of its own (dual coordinate descent, squared hinge loss). Languages
without an entry in ``FAMILIES`` are a family of their own.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and all texts if nothing could be learned; a single learned language is
predicted with score 1. Null ids hash like the empty text; repeated rows get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, batches, col, id_hash_mod, others

# Families of language codes.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz",
    "indic": "hi mr ne bn gu pa ur",
    "baltic": "lt lv",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

PER_CLASS = 600     # labelled texts a class to learn from, on average
DIMS = 2048         # hashed features
EPOCHS = 12
COST = 10.0
SHARPNESS = 6.0     # of the logistic curve from margin to score
MIN_SCORE = 0.3     # texts that score below are rejected by ``known_language``
UNKNOWN = "und"

_ASCII_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the hashed gram shares: a unit vector (zero if empty)."""
    clean = b" " + b" ".join(text.lower().encode("utf-8").translate(_ASCII_LETTERS).split()) + b" "
    b = np.frombuffer(clean, np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << 8
    three = two[:-1] | b[2:] << 16
    grams = np.concatenate((two, three | np.uint32(1 << 24)))
    slots = (grams * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
    count = np.bincount(slots, minlength=DIMS).astype(np.float32)
    total = count.sum()
    return np.sqrt(count / total) if total else count


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (bias last) of a linear SVM by dual coordinate descent."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = (x * x).sum(axis=1) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - slope / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Duel:
    """One-versus-one machines of the classes of one level."""

    def __init__(self, classes: Sequence[str], weights: dict[tuple[str, str], np.ndarray]):
        self.classes = sorted(classes)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows = [weights[self.classes[a], self.classes[b]] for a, b in self.pairs]
        self.weights = np.array(rows, np.float32).reshape(len(rows), DIMS + 1)

    def winner(self, x: np.ndarray) -> tuple[str, float]:
        """The class, and its smallest margin as a score between 0 and 1."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        least = np.full(len(self.classes), np.inf)
        for (a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            for c, own in ((a, m), (b, -m)):
                votes[c] += own > 0
                sums[c] += own
                least[c] = min(least[c], own)
        best = max(range(len(self.classes)), key=lambda c: (votes[c], sums[c], -c))
        return self.classes[best], float(1 / (1 + np.exp(-SHARPNESS * np.clip(least[best], -20, 20))))


class LanguageModel:
    def __init__(self, families: Duel, languages: dict[str, Duel]):
        self.families, self.languages = families, languages

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.families.winner(x)
        language, within = self.languages[family].winner(x)
        return language, sure * within


def train_language_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                         per_class: int = PER_CLASS) -> LanguageModel:
    """Fit on the labelled rows of ``docs``, a bounded sample a class."""
    labelled = docs.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    counts = labelled.groupBy(col(lang_col).alias("lang")).count().collect()    # one row a language
    languages = {r["lang"]: FAMILY_OF.get(r["lang"], r["lang"]) for r in counts}
    if not languages:
        return LanguageModel(Duel([], {}), {})
    members: dict[str, list[str]] = {}
    for lang, family in languages.items():
        members.setdefault(family, []).append(lang)
    pairs = [("family", a, b) for a, b in combinations(sorted(members), 2)]
    pairs += [("language", a, b) for m in members.values() for a, b in combinations(sorted(m), 2)]
    share = {r["lang"]: min(1.0, per_class / r["count"]) for r in counts}
    sampled = {r["lang"]: min(r["count"], per_class) for r in counts}
    among = {lang: min(1.0, per_class / sum(sampled[x] for x in members[f])) for lang, f in languages.items()}
    spark = docs.sparkSession
    plan = spark.createDataFrame([(lang, share[lang]) for lang in languages], "_lang string, _share double")
    luck = F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = (labelled.join(F.broadcast(plan), col(lang_col) == F.col("_lang"))    # one row a language
              .where(luck < F.col("_share")).select("_lang", col(text_col).alias("text"), (luck / F.col("_share")).alias("luck")))
    schema = pa.schema([("level", pa.string()), ("a", pa.string()), ("b", pa.string()), ("y", pa.int32()),
                        ("x", pa.binary())])

    def make(batch):
        rows = []
        for lang, text, luck in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not has_letter(text):
                continue
            x = features(text).astype("<f4").tobytes()
            family = languages[lang]
            if luck < among[lang]:      # a family learns from as many texts as a language may
                rows += [(*p, 1 if p[1] == family else -1, x) for p in pairs if p[0] == "family" and family in p[1:]]
            rows += [(*p, 1 if p[1] == lang else -1, x) for p in pairs if p[0] == "language" and lang in p[1:]]
        return dict(zip(schema.names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in schema.names}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"])     # the same order wherever it runs
        x = np.stack([np.frombuffer(v, "<f4") for v in group["x"]])
        w = fit_svm(x, group["y"].to_numpy(float))
        first = group.iloc[0]
        return pd.DataFrame({"level": [first["level"]], "a": [first["a"]], "b": [first["b"]],
                             "w": [w.astype("<f4").tobytes()]})

    fitted = (sample.mapInArrow(lambda it: batches(it, make, schema), "level string, a string, b string, y int, x binary")
              .groupBy("level", "a", "b").applyInPandas(fit, "level string, a string, b string, w binary").collect())
    zero = np.zeros(DIMS + 1, np.float32)
    weights = {(r["level"], r["a"], r["b"]): np.frombuffer(r["w"], "<f4") for r in fitted}

    def duel(level: str, classes: Sequence[str]) -> Duel:
        return Duel(classes, {(a, b): weights.get((level, a, b), zero) for a, b in combinations(sorted(classes), 2)})
    return LanguageModel(duel("family", list(members)), {f: duel("language", m) for f, m in members.items()})


def identify_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text",
                      keep: Sequence[str] | None = None) -> DataFrame:
    """The input columns (or ``keep``) and ``lang_pred, score``. No shuffle."""
    def make(texts):
        found = [model.predict(t) for t in texts.to_pylist()]
        return {"lang_pred": [p for p, _ in found], "score": [s for _, s in found]}
    return arrow_columns(docs, [col(text_col)], make, "lang_pred string, score double", keep)


def held_out(id_col: str = "doc_id"):
    """The rows that no model learns from: crc32 of the id as text, mod 3, is 1."""
    return id_hash_mod(id_col, 3) == 1


def label_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    keep: Sequence[str] | None = None) -> DataFrame:
    """Learn from the rows that are not held out, predict all rows: the input
    columns (or ``keep``), ``held_out, lang_pred, score``."""
    model = train_language_model(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    kept = others(docs, ["held_out", "lang_pred", "score"], keep)
    marked = docs.select(*[col(c) for c in dict.fromkeys([*kept, text_col])], held_out(id_col).alias("held_out"))
    return identify_language(marked, model, text_col=text_col, keep=[*kept, "held_out"])


def known_language(docs: DataFrame, *, min_score: float = MIN_SCORE, **columns) -> DataFrame:
    """The rows whose language is recognised, with their own columns."""
    return (label_languages(docs, **columns)
            .where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*[col(c) for c in docs.columns]))
