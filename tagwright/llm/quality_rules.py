"""Quality rules by distribution divergence (operator 7).

Base rules count words, repeated lines and repeated word windows. Then two
histograms of a text are compared with references of each language of the
corpus by Jensen-Shannon divergence (base 2, 0 to 1): its character classes,
and its common words (those that make up at least ``COMMON`` of a language's
words, so at most ``1 / COMMON`` a language, and the rest as one bin). The
references are sums over all texts labelled with the language. A text is
dropped if it is far from every language in either histogram. Texts shorter
than a guard are not judged by that histogram: short samples are far from any
reference by chance.

A language tells texts apart by words as far as a text with none of its common
words is away from it. Where that is less than ``EMPTY``, its divergences are
scaled up to it, so such a text is far from every language; a language without
common words (unspaced scripts) is no reference for words. A text is not judged
by words if the language of its characters cannot tell texts apart (under
``WORDS_LIMIT``), and all that can are far from it in character classes.

Defined results: a null text has no words and fails the base rules; texts
without a language label count for no reference; without any labelled text
only the base rules judge; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, batches, col, materialize, utf8

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
COMMON = 0.005          # share of a language's words that makes a word common
CLASS_MIN_CHARS = 200   # guards: texts below these are not judged by the histogram
WORDS_MIN_WORDS = 100
COUNTED_AT_ONCE = 4096  # texts whose words are counted together
CLASS_LIMIT = 0.1      # largest divergence of a kept text from its nearest language
WORDS_LIMIT = 0.08
EMPTY = 2 * WORDS_LIMIT # least divergence of a text with none of a language's common words

_BLANK = b"\t\n\v\f\r "


def _classes() -> np.ndarray:
    """The character class of each byte: lower, upper, digit, blank, line
    end, sentence mark, symbol, other ASCII, first byte of a longer
    character; its further bytes have no class (-1)."""
    out = np.full(256, 7)
    out[ord("a"):ord("z") + 1] = 0
    out[ord("A"):ord("Z") + 1] = 1
    out[ord("0"):ord("9") + 1] = 2
    out[list(_BLANK)] = 3
    out[ord("\n")] = 4
    out[list(b".,;:!?'\"()-")] = 5
    out[list(SYMBOLS)] = 6
    out[0xC0:] = 8
    out[0x80:0xC0] = -1
    return out


N_CLASSES = 9


def class_histogram(byte_counts: np.ndarray) -> np.ndarray:
    classes = _classes()
    return np.bincount(classes[classes >= 0], byte_counts[classes >= 0], N_CLASSES)


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence in bits of histogram ``p`` from each row of ``q``."""
    p = p / p.sum()
    q = q / q.sum(axis=1, keepdims=True)
    m = (p + q) / 2

    def to_mean(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)
    return (to_mean(np.broadcast_to(p, m.shape)) + to_mean(q)) / 2


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside word windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids[:n]
    for j in range(1, window):          # number the windows, one word longer at a time
        key = key * len(seen) + ids[j:j + n]
        if j < window - 1:
            key = np.unique(key, return_inverse=True)[1] if len(seen) > 1 << 20 else key
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which] > 1)
    hit = np.zeros(len(words), bool)
    for j in range(window):
        hit[starts + j] = True
    return int(hit.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


class References:
    """Per-language histograms: character classes and common words."""

    def __init__(self, classes: dict[str, list[float]], words: dict[str, dict[bytes, float]]):
        self.languages = sorted(words)
        self.classes = np.array([classes[x] for x in self.languages], float).reshape(-1, N_CLASSES)
        self.vocabulary = [sorted(words[x]) for x in self.languages]
        self.words = [np.array([words[x][w] for w in v] + [1 - sum(words[x].values())])
                      for x, v in zip(self.languages, self.vocabulary, strict=True)]
        none = [np.append(np.zeros(len(v)), 1.0) for v in self.vocabulary]
        #: of a text with none of the common words
        self.empty = np.array([jensen_shannon(p, q[None, :])[0] for p, q in zip(none, self.words, strict=True)])

    def class_divergences(self, histogram: np.ndarray) -> np.ndarray:
        """From each language."""
        return jensen_shannon(histogram, self.classes) if len(self.classes) else np.zeros(1)

    def word_divergence(self, words: list[bytes], far: np.ndarray) -> float | None:
        """From the nearest language; None if the text is not judged by words.
        ``far``: its ``class_divergences``."""
        if not self.languages:
            return 0.0
        tell = self.empty >= WORDS_LIMIT
        if not tell[far.argmin()] and not (far[tell] <= CLASS_LIMIT).any():
            return None
        count = Counter(w.lower() for w in words)
        best = 1.0
        for vocabulary, reference, empty in zip(self.vocabulary, self.words, self.empty, strict=True):
            if not vocabulary:
                continue
            own = np.array([count[w] for w in vocabulary] + [0.0])
            own[-1] = len(words) - own.sum()
            best = min(best, float(jensen_shannon(own, reference[None, :])[0]) * max(1.0, EMPTY / empty))
        return best


def language_references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
                        common: float = COMMON) -> References:
    """Sum the histograms of all labelled texts, by language: one pass, counts
    combined per Arrow batch and then by a grouped sum. What comes back is
    bounded: the classes and at most ``1 / common`` words a language."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.binary()), ("n", pa.int64())])

    def make(batch):
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(text.lower().split())
            classes[lang] = classes.get(lang, 0) + class_histogram(byte_counts(text)).astype(np.int64)
        rows = [(x, "word", w, n) for x, c in words.items() for w, n in c.items()]
        rows += [(x, "words", b"", sum(c.values())) for x, c in words.items()]
        rows += [(x, "class", bytes([i]), int(n)) for x, h in classes.items() for i, n in enumerate(h)]
        return dict(zip(schema.names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in schema.names}

    labelled = docs.where(col(lang_col).isNotNull()).select(col(lang_col).cast("string"), utf8(text_col))
    slices = lambda it: (b.slice(k, COUNTED_AT_ONCE) for b in it for k in range(0, len(b), COUNTED_AT_ONCE))
    counts = (labelled.mapInArrow(lambda it: batches(slices(it), make, schema),
                                  "lang string, kind string, item binary, n long")
              .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    counts = materialize(counts, "language-counts")
    total = counts.where("kind = 'words'").select("lang", F.col("n").alias("total"))
    found = (counts.join(total, "lang").where((F.col("kind") == "class") | (F.col("kind") == "word") & (F.col("n") >= common * F.col("total")))
             .select("lang", "kind", "item", "n", "total").collect())
    classes: dict[str, list[float]] = {}
    words: dict[str, dict[bytes, float]] = {}
    for lang, kind, item, n, total in found:
        if kind == "class":
            classes.setdefault(lang, [0.0] * N_CLASSES)[item[0]] = float(n)
            words.setdefault(lang, {})
        elif total:
            words.setdefault(lang, {})[bytes(item)] = n / total
    return References(classes, {x: w for x, w in words.items() if sum(classes[x])})


def quality_rules(docs: DataFrame, references: References | None = None, *, text_col: str = "text",
                  lang_col: str = "lang", keep: Sequence[str] | None = None, class_limit: float = CLASS_LIMIT,
                  words_limit: float = WORDS_LIMIT) -> DataFrame:
    """Judge every text: the input columns (or ``keep``), the base counts
    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, the
    divergences (null where the text is not judged by them), ``base_failed`` and ``kept``.
    The references come from the same table unless given."""
    references = references or language_references(docs, text_col=text_col, lang_col=lang_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_divergence",
             "word_divergence", "base_failed", "kept"]

    def make(texts):
        out = {c: [] for c in names}
        for text in texts.to_pylist():
            words, count = text.split(), byte_counts(text)
            histogram = class_histogram(count)
            blanks = int(count[list(_BLANK)].sum())
            chars = int(histogram.sum()) - blanks
            repeat = repeated_words(words)
            failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
            far = references.class_divergences(histogram) if chars else None
            far_class = float(far.min()) if chars >= CLASS_MIN_CHARS else None
            far_word = references.word_divergence(words, far) if len(words) >= WORDS_MIN_WORDS else None
            kept = not (failed or (far_class or 0.0) > class_limit or (far_word or 0.0) > words_limit)
            row = (len(words), chars, int(count[list(SYMBOLS)].sum()), duplicate_lines(text), repeat, far_class,
                   far_word, failed, kept)
            for c, v in zip(names, row, strict=True):
                out[c].append(v)
        return out

    return arrow_columns(docs, [utf8(text_col)], make,
                         "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                         "class_divergence double, word_divergence double, base_failed boolean, kept boolean", keep)
