"""Quality classifier by ordinal cumulative-link regression (operator 4).

Documents have graded ratings 0 .. K-1. One weight vector over hashed text
features serves all grades, and ordered thresholds cut its score ``s``:
``P(grade > k) = sigmoid(s - threshold[k])``. The model gives a text's expected
grade and, for selection, the tail probability of the top grade.

Features are the different words of a text and their beginnings (lower-cased,
hashed into ``DIMS`` slots), and the steps that its shape (capitals, symbols, digits, repetition,
word length) reaches. The penalised likelihood is convex; a limited-memory
quasi-Newton method fits it on a bounded sample of ``SAMPLE`` rated texts on
average, picked by a hash of the id, in one task.

Ratings of ``labels``: toxic 0, of low quality 1, good 2 (``graded``).

Defined results: a null text is the empty text; ratings that are null are not
learned from, of several ratings of one id the lowest counts; without two
different grades to learn from all texts get the only (or lowest) grade with
certainty; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, batches, col, id_hash_mod, others, utf8
from .decontaminate import words_of
from .quality_rules import byte_counts, class_histogram, duplicate_lines

SAMPLE = 24_000
DIMS = 1 << 20
MIN_TEXTS = 3       # rated texts a word must occur in to get a weight
SHAPE_MASS = 3.0        # of each shape
PREFIXES = (4,)    # lengths of word beginnings, in bytes
WORD_MASS = 10.0    # length of the word part of a feature vector
PENALTY = 1e-4      # L2, on the mean loss
STEPS = 60          # of the optimiser
SELECT_AT = 0.5     # least probability of the top grade among kept texts

_SHAPES = ("upper", "digit", "mark", "symbol", "other", "unique", "length", "lines")
_LEVELS = 12


def _slot(name: bytes) -> int:
    return xxhash.xxh64_intdigest(name) & (DIMS - 1)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: its different words share a vector of
    length ``WORD_MASS``, so do their beginnings of each length, and each shape has ``SHAPE_MASS``
    in the slot of its level."""
    words = words_of(text)
    unique = set(words)
    slots, values = [], []
    for parts in (unique, *({b"^" + w[:n] for w in unique if len(w) > n} for n in PREFIXES)):
        slots += map(_slot, parts)
        values += [WORD_MASS / max(1, len(parts)) ** 0.5] * len(parts)
    h = class_histogram(byte_counts(text))
    total = max(1.0, float(h.sum()))
    n = max(1, len(words))
    lines = text.count(b"\n") + 1
    shape = (h[1] / total * 4, h[2] / total * 6, h[5] / total * 6, h[6] / total * 6, h[7] / total * 6,
             len(unique) / n if n > 30 else 1.0, sum(map(len, words)) / n / 16, duplicate_lines(text) / lines)
    for name, v in zip(_SHAPES, shape, strict=True):
        level = min(_LEVELS - 1, int(v * _LEVELS))
        slots.append(_slot(f" {name} {level}".encode()))
        values.append(SHAPE_MASS)
    return np.array(slots, np.int32), np.array(values, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def minimise(f: Callable, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a backtracking line search."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, coefficients = -slope, []
        for s, y, r in reversed(past):
            a = r * (s @ d)
            d = d - a * y
            coefficients.append(a)
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(coefficients), strict=True):
            d = d + (a - r * (y @ d)) * s
        size, gain = 1.0 if past else min(1.0, 1 / max(1e-12, np.abs(slope).sum())), float(slope @ d)
        for _ in range(30):
            new, new_slope = f(x + size * d)
            if new <= value + 1e-4 * size * gain:
                break
            size /= 2
        else:
            break
        s, y = size * d, new_slope - slope
        if s @ y > 1e-12:
            past = (past + [(s, y, 1 / (s @ y))])[-memory:]
        done = value - new < 1e-9 * max(1.0, abs(value))
        x, value, slope = x + s, new, new_slope
        if done:
            break
    return x


def fit_cumulative(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, dims: int = DIMS,
                   penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. Thresholds are a first one and the logarithms
    of the steps between them, so they stay in order."""
    at = np.concatenate([i for i, _ in rows])
    x = np.concatenate([v for _, v in rows]).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    slots, at, times = np.unique(at, return_inverse=True, return_counts=True)
    often = times >= MIN_TEXTS                          # rarer slots keep the weight 0
    if not often.all():
        kept = often[at]
        slots, at, x, owner = slots[often], (np.cumsum(often) - 1)[at[kept]], x[kept], owner[kept]
    k, n, m = n_grades - 1, len(rows), len(slots)
    lower, upper = grades - 1, grades                   # thresholds on either side of a grade

    def loss(z):
        w, t = z[:m], np.cumsum(np.concatenate((z[m:m + 1], np.exp(z[m + 1:]))))
        s = np.bincount(owner, w[at] * x, n)
        above = np.where(lower >= 0, _sigmoid(s - t[np.maximum(lower, 0)]), 1.0)     # P(grade >= y)
        beyond = np.where(upper < k, _sigmoid(s - t[np.minimum(upper, k - 1)]), 0.0)  # P(grade > y)
        p = np.maximum(above - beyond, 1e-12)
        da, db = above * (1 - above) / p / n, beyond * (1 - beyond) / p / n
        ds = -(da - db)
        dt = (np.bincount(np.maximum(lower, 0), np.where(lower >= 0, da, 0), k)
              - np.bincount(np.minimum(upper, k - 1), np.where(upper < k, db, 0), k))
        tail = np.cumsum(dt[::-1])[::-1]                # a step moves all thresholds after it
        slope = np.concatenate((np.bincount(at, ds[owner] * x, m) + penalty * w, tail[:1], tail[1:] * np.exp(z[m + 1:])))
        return -np.log(p).mean() + penalty / 2 * (w @ w), slope

    z = minimise(loss, np.concatenate((np.zeros(m), [-1.0], np.zeros(k - 1))), steps)
    weights = np.zeros(dims)
    weights[slots] = z[:m]
    return weights, np.cumsum(np.concatenate((z[m:m + 1], np.exp(z[m + 1:]))))


class QualityModel:
    """Shared weights and ordered thresholds; ``base`` is the lowest grade."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, base: int = 0):
        self.weights, self.thresholds, self.base = weights.astype(np.float32, copy=False), thresholds, base

    def tails(self, text: bytes) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        slots, values = features(text)
        return _sigmoid(float(self.weights[slots] @ values) - self.thresholds)


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, grade`` from the quality and toxic flags: 0 toxic, 1 low, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(col(id_col), grade.alias("grade"))


def train_quality(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  grade_col: str = "grade", sample: int = SAMPLE, where: Column | None = None) -> QualityModel:
    """Fit on the rated texts; ``where`` may hold rows out by id."""
    rated = ratings.where(col(grade_col).isNotNull() & col(id_col).isNotNull())
    rated = rated.where(where) if where is not None else rated
    rated = rated.groupBy(col(id_col).alias("_id")).agg(F.min(grade_col).cast("int").alias("_grade"))
    seen = rated.agg(F.count("*"), F.min("_grade"), F.max("_grade")).first()
    n, low, high = seen
    if not n or low == high:
        return QualityModel(np.zeros(DIMS), np.empty(0), low or 0)
    luck = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.join(rated.where(luck < sample / n), col(id_col) == F.col("_id")).select(
        (F.col("_grade") - low).alias("grade"), utf8(text_col).alias("text"))
    schema = pa.schema([("grade", pa.int32()), ("slots", pa.binary()), ("xs", pa.binary())])

    def make(batch):
        found = [features(t) for t in batch.column(1).to_pylist()]
        return {"grade": batch.column(0), "slots": [i.tobytes() for i, _ in found], "xs": [v.tobytes() for _, v in found]}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["grade", "slots"])
        rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32))
                for i, v in zip(group["slots"], group["xs"], strict=True)]
        weights, thresholds = fit_cumulative(rows, group["grade"].to_numpy(), high - low + 1)
        return pd.DataFrame({"w": [weights.astype("<f4").tobytes()], "t": [thresholds.astype("<f8").tobytes()]})

    # one group: the sample is bounded, whatever the number of ratings
    got = (texts.mapInArrow(lambda it: batches(it, make, schema), "grade int, slots binary, xs binary")
           .groupBy().applyInPandas(fit, "w binary, t binary").collect())
    if not got:
        return QualityModel(np.zeros(DIMS), np.empty(0), low)
    return QualityModel(np.frombuffer(got[0]["w"], "<f4"), np.frombuffer(got[0]["t"], "<f8"), low)


def grade_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", keep: Sequence[str] | None = None,
                  select_at: float = SELECT_AT) -> DataFrame:
    """The input columns (or ``keep``) and ``expected_grade, p_above_lowest,
    p_top, kept``. No shuffle; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.base))

    def make(texts):
        model = QualityModel(*shared.value)
        out = {c: [] for c in ("expected_grade", "p_above_lowest", "p_top", "kept")}
        for text in texts.to_pylist():
            tails = model.tails(text)
            first, top = (float(tails[0]), float(tails[-1])) if len(tails) else (0.0, 1.0)
            for c, v in zip(out, (model.base + float(tails.sum()), first, top, top >= select_at), strict=True):
                out[c].append(v)
        return out

    return arrow_columns(docs, [utf8(text_col)], make,
                         "expected_grade double, p_above_lowest double, p_top double, kept boolean", keep)


def held_out(id_col: str = "doc_id") -> Column:
    """Rated rows that the registered model does not learn from."""
    return id_hash_mod(id_col, 5) == 0


def classify_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     keep: Sequence[str] | None = None, sample: int = SAMPLE, select_at: float = SELECT_AT) -> DataFrame:
    """Learn from the rated rows that are not held out, grade all rows."""
    model = train_quality(docs, graded(labels, id_col), id_col=id_col, text_col=text_col, sample=sample,
                          where=~held_out(id_col))
    kept = others(docs, ["held_out"], keep)
    marked = docs.select(*[col(c) for c in dict.fromkeys([*kept, text_col])], held_out(id_col).alias("held_out"))
    return grade_quality(marked, model, text_col=text_col, keep=[*kept, "held_out"], select_at=select_at)
