"""SimHash near-duplicate groups by pigeonhole blocks (operator 3).

A text's fingerprint has bit b set if more than half of its word shingles
have it set in their 64-bit hash. The 64 bits are cut into ``blocks`` blocks:
two fingerprints that differ in at most ``bits`` bits agree on at least
``blocks - bits`` whole blocks, so they meet under one of the choices of that
many blocks. Different fingerprints are joined on the chosen blocks' bits,
and the Hamming distance of those that meet is verified. The number of blocks
follows from the number of fingerprints alone, so that chance meetings stay
about as many as the fingerprints; every choice of it gives the same links.

A bucket of fingerprints that agree on the chosen blocks is cut into parts of
bounded size, each pair of parts is one small task, and of the links within
it only a spanning forest is returned: never all pairs of a group. Groups are
connected components, named by their smallest document id.

Defined results: null and wordless texts have fingerprint 0 and are linked
like any other; a text of fewer than ``shingle`` words is one shingle;
repeated rows share a group; null ids take part but name a group only if it
has no other id (its component id is then null); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, batches, col, materialize, row_key, utf8
from .graph import components

SHINGLE = 4         # words
BITS = 4            # largest distance of a link
HASH_SEED = 42
PART = 2048         # fingerprints of one bucket that one task compares with as many
_MAX_BLOCKS = 16
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        cuts = [(0, len(joined))]
    else:
        cuts = zip([0, *ends], [e - 1 for e in ends[shingle - 1:]])   # noqa: B905 - shingles end before words do
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], HASH_SEED) for a, b in cuts), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i:i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def block_masks(blocks: int, bits: int) -> list[int]:
    """Bit masks of every choice of ``blocks - bits`` blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]   # noqa: B905 - pairs of neighbours
    masks = [sum(c) for c in combinations(one, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, bits: int) -> int:
    """The fewest blocks at which ``n`` random fingerprints meet by chance at
    most about ``n`` times."""
    for blocks in range(bits + 1, _MAX_BLOCKS):
        if math.comb(blocks, bits) * n <= 2.0 ** (64 * (blocks - bits) / blocks + 1):
            return blocks
    return _MAX_BLOCKS


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket. A fingerprint that
    has been reached is never compared again, so a dense group costs little."""
    links = []
    rest = np.unique(fps).view(np.uint64)
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                reached = rest[near]
                links.extend(zip([int(x.view(np.int64))] * len(reached), reached.view(np.int64).tolist(), strict=True))
                frontier.extend(reached)
                rest = rest[~near]
    return links


def near_links(fingerprints: DataFrame, n: int, bits: int = BITS, part: int = PART) -> DataFrame:
    """Links ``u, v`` between different fingerprints (column ``fp``, distinct,
    ``n`` of them) at most ``bits`` apart, a spanning set of each component."""
    masks = block_masks(blocks_for(n, bits), bits)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("block"))
                                 for i, m in enumerate(masks)]))
    keyed = fingerprints.select("fp", choice.alias("c")).select("fp", "c.choice", "c.block")
    met = keyed.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(met, ["choice", "block"]).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .groupBy("choice", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
             .agg(F.collect_list("fp").alias("fps")))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def link(batch):
        fps = batch.column(0)
        links = [e for i in range(len(fps)) for e in forest(np.asarray(fps[i].values), bits)]
        return {"u": [u for u, _ in links], "v": [v for _, v in links]}

    return dealt.select("fps").mapInArrow(lambda it: batches(it, link, schema), "u long, v long").distinct()


def _groups(rows: DataFrame, bits: int, part: int) -> DataFrame:
    """``fp, component_id`` of all different fingerprints of ``rows``."""
    least = materialize(rows.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    links = near_links(least.select("fp"), least.count(), bits, part)
    roots = components(links)
    named = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.select("fp", "root").join(first, "root").select("fp", "component_id")


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, key, fp`` of every row, written once to the shared folder."""
    def make(texts):
        fps = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64)
        return {"fp": fps.view(np.int64)}

    rows = docs.select(col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), utf8(text_col).alias("bytes"))
    return materialize(arrow_columns(rows, [F.col("bytes")], make, "fp long", ["id", "key"]), "simhash")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   bits: int = BITS, part: int = PART) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 lowercase hex
    digits) and ``component_id``."""
    rows = _fingerprinted(docs, id_col, text_col, shingle)
    return rows.join(_groups(rows, bits, part), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  bits: int = BITS, part: int = PART, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (then of
    the smallest text hash; of repeated rows one)."""
    rows = _fingerprinted(docs, id_col, text_col, shingle)
    chosen = (rows.join(_groups(rows, bits, part).withColumnRenamed("component_id", "first"), "fp")
              .groupBy("first", F.when(F.col("first").isNull(), F.col("fp")).alias("nameless"))
              .agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("row"), F.count("*").alias("rows"))
              .select(F.col("row.key").alias("key")))
    chosen = materialize(chosen, "simhash-kept")
    kept = [col(c) for c in (docs.columns if keep is None else keep)]
    matched = docs.join(chosen, row_key(id_col, text_col) == chosen["key"], "left_semi").select(*kept)
    repeated = rows.join(chosen, "key", "left_semi").groupBy("key").count().where("count > 1").limit(1).count()
    return matched.dropDuplicates([id_col, text_col]) if repeated else matched
