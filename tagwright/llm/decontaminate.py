"""Benchmark decontamination by winnowing (operator 10).

Words are runs of ASCII letters and digits and of any non-ASCII characters,
lower-cased in A-Z. Both sides are reduced to winnowed fingerprints: of every
``WINDOW - GRAM + 1`` consecutive word ``GRAM``-grams the one with the smallest
hash is kept, so every shared span of ``WINDOW`` words has a shared
fingerprint at the same place in both texts. Fingerprints are joined; every
hit names a diagonal (document position minus item position), on which the
words are compared and the match is extended to its full length. Items
shorter than ``WINDOW`` words are one window of their own length and are
winnowed at that length.

Defined results: null and wordless texts have no words, no hits and are not
contaminated; wordless items occur nowhere; repeated document rows get equal
results; repeated item rows count once; an item with a null id can hit but is
not listed among the item ids; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, batches, free_name, materialize, others, row_key, utf8

WINDOW = 13     # words of a match
OUTPUT = ["n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"]
GRAM = 7        # words of a hashed k-gram; WINDOW - GRAM + 1 grams a winnowing window

_LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER_WORDS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def winnow(hashes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed word grams: each run of ``span``
    words keeps its gram of smallest hash (the first of equal ones)."""
    if len(hashes) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(hashes) - gram + 1
    grams = np.full(n, span, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    per_window = np.lib.stride_tricks.sliding_window_view(grams, span - gram + 1)
    at = np.unique(per_window.argmin(axis=1) + np.arange(len(per_window)))
    return at, grams[at]


def _gram_of(span: int, window: int, gram: int) -> int:
    return gram if span == window else (span + 1) // 2


def _fingerprints(df: DataFrame, key: str, spans: list[int] | None, window: int, gram: int) -> DataFrame:
    """``key, pos, fp`` rows. ``spans``: the match lengths to winnow at; None:
    each text at its own length, ``window`` at most (the benchmark side)."""
    schema = pa.schema([(key, pa.int64()), ("pos", pa.int32()), ("fp", pa.int64())])

    def make(batch):
        keys, at, fps = [], [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = word_hashes(words_of(text))
            for span in [min(window, len(h))] if spans is None else spans:
                if span:
                    p, f = winnow(h, span, _gram_of(span, window, gram))
                    keys.append(np.full(len(p), k, np.int64))
                    at.append(p)
                    fps.append(f)
        if not keys:
            return {c: [] for c in schema.names}
        return {key: np.concatenate(keys), "pos": np.concatenate(at).astype(np.int32),
                "fp": np.concatenate(fps).view(np.int64)}

    return df.select(key, "bytes").mapInArrow(lambda it: batches(it, make, schema),
                                              f"{key} long, pos int, fp long")


def _matches(doc: list[bytes], items: list, window: int) -> tuple[np.ndarray, list]:
    """Words of ``doc`` that lie in a match, and ids of the items that match."""
    hit, found = np.zeros(len(doc), bool), []
    dh = word_hashes(doc) if items else None
    for item in items:
        iw = words_of(item["bytes"])
        ih, need, any_run = word_hashes(iw), min(window, len(iw)), False
        for diagonal in item["diagonals"]:
            lo, hi = max(0, -diagonal), min(len(iw), len(doc) - diagonal)
            if hi - lo < need:
                continue
            same = dh[lo + diagonal:hi + diagonal] == ih[lo:hi]
            for i in np.flatnonzero(same):      # words, not hashes, decide
                same[i] = doc[lo + diagonal + i] == iw[lo + i]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= need:
                    hit[lo + diagonal + a:lo + diagonal + b] = True
                    any_run = True
        if any_run:
            found.append(item["item_id"])
    return hit, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                  share: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Judge every row of ``docs`` against all items of ``benchmark``.

    Returns the input columns (or those of ``keep``) and ``n_words, n_hit, n_items, item_ids`` (sorted
    as strings), ``items_sha256, contaminated`` (some word is hit, and hit
    words are at least 1/``share`` of all); they replace input columns of
    these names. One shuffle of the fingerprint
    hits and one join of the texts with the few documents that have any; the
    join of fingerprints is broadcast only if Spark finds the written
    benchmark fingerprints small.
    """
    items = (benchmark.select(F.col(item_id_col).alias("item_id"), utf8(item_text_col).alias("bytes"))
             .distinct().withColumn("item_key", row_key("item_id", "bytes")))
    item_fp = materialize(_fingerprints(items, "item_key", None, window, gram)
                          .withColumnRenamed("pos", "item_pos"), "benchmark-fingerprints")
    # the distinct match lengths, ``window`` of them at most
    lengths = [r[0] for r in _lengths(items, window).distinct().collect()]
    texts = docs.select(row_key(id_col, text_col).alias("_key"), utf8(text_col).alias("bytes"))
    hits = (_fingerprints(texts, "_key", sorted(lengths), window, gram)
            .join(item_fp, "fp")
            .select("_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
            .groupBy("_key", "item_key").agg(F.collect_set("diagonal").alias("diagonals"))
            .join(items, "item_key")
            .groupBy("_key").agg(F.collect_list(F.struct("item_id", "bytes", "diagonals")).alias("items")))
    kept = others(docs, OUTPUT, keep)
    key, cand = free_name(docs.columns, "key"), free_name(docs.columns, "items")
    hits = hits.select(F.col("_key").alias(key), F.col("items").alias(cand))
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(hits, key, "left")

    def judge(texts, candidates):
        out = {c: [] for c in OUTPUT}
        for text, items in zip(texts.to_pylist(), candidates.to_pylist(), strict=True):
            doc = words_of(text)
            hit, found = _matches(doc, items or [], window)
            n_hit = int(hit.sum())
            ids = sorted({str(i) for i in found if i is not None})
            row = (len(doc), n_hit, len(set(found)), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(),
                   n_hit > 0 and share * n_hit >= len(doc))
            for c, v in zip(OUTPUT, row, strict=True):
                out[c].append(v)
        return out

    return arrow_columns(joined, [utf8(text_col), F.col(cand)], judge,
                         "n_words long, n_hit long, n_items long, item_ids array<string>, "
                         "items_sha256 string, contaminated boolean", kept)


def _lengths(items: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("n", pa.int32())])
    make = lambda b: {"n": [n for t in b.column(0).to_pylist() if (n := min(window, len(words_of(t))))]}
    return items.select("bytes").mapInArrow(lambda it: batches(it, make, schema), "n int")
