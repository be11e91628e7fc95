"""Mixing sources to target weights by pivotal dependent rounding (operator 2).

Every source gets a target number of words; each of its documents is wanted
``target / source size`` times. The whole part of that number is taken
outright, the rest is a probability, and the probabilities of a source are
rounded dependently: two documents' probabilities are paired, and mass (expected
words) moves at random from one to the other until one of them is 0 or 1, so
that the words taken never change in sum. Documents go in descending order of
size; as long as the smaller ones share one probability, a document is paired
with their pool as a whole, so that it is small documents that are left over
and a source's words stay within about one of them of the target. A source is dealt by a hash of its
documents into buckets of bounded size; each bucket leaves one fractional
document at most, and these are paired on in a tree of groups of ``FAN_IN``
until one is left, which a last draw rounds.

All draws are hashes of the document and a seed: reruns agree, whatever the
partitioning.

Defined results: a null text has size 0, documents of size 0 are never
copied; null is a source like any other, last in order; rows equal in id,
source and text share their fractional copies, so that one of them at most is
rounded at random: they are numbered, and the first ones get the extra copies;
an empty table gives no rows. The number of sources is bounded by the mixing plan (a weight
each); their totals, one row a source, are solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, free_name, materialize, others, row_key

BUCKET = 2000       # documents rounded together in one group
FAN_IN = 256        # residuals rounded together in one node of the tree
_EPS = 1e-9
OUTPUT = ["size", "source_size", "target", "copies", "taken"]


def targets_for(sizes: Sequence[float], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Share ``share`` times the total size by weight; what exceeds ``cap``
    times a source's size is shared again among the others."""
    targets = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def _draw(seed: int, *keys: np.int64) -> float:
    return xxhash.xxh64_intdigest(b"".join(k.tobytes() for k in keys), seed) / 2.0 ** 64


def pool(p: np.ndarray, sizes: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """Pair each document, largest first, with the pool of all smaller ones,
    as long as these share one probability and can give or take the words
    that the document needs to become 0 or 1; they go on sharing one
    probability. The first documents of the result are then integral."""
    p = p.copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if not len(open_):
        return p
    # repeated rows may have a probability of their own; they are paired later
    common = np.sort(p[open_])[len(open_) // 2]
    open_ = open_[np.abs(p[open_] - common) <= _EPS]
    shared, rest = float(p[open_[0]]), float(sizes[open_].sum())
    for at, i in enumerate(open_):
        rest -= sizes[i]
        up, down = (1 - shared) * sizes[i], shared * sizes[i]   # words it would take from, or leave to, the pool
        if shared < _EPS or shared > 1 - _EPS or up > shared * rest or down > (1 - shared) * rest:
            p[open_[at:]] = shared
            break
        taken = _draw(seed, keys[i]) < shared
        p[i] = float(taken)
        shared += (-up if taken else down) / rest
    return p


def pivot(p: np.ndarray, sizes: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """Round the probabilities ``p`` pairwise, in order. All but at most one
    of the results are 0 or 1, the expected words ``sum(p * sizes)`` stay as
    they are, and each result's mean is its probability."""
    p = p.copy()
    held = -1
    for i in range(len(p)):
        if p[i] < _EPS or p[i] > 1 - _EPS:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        # words that can move to the held document, and away from it
        there = min((1 - p[held]) * sizes[held], p[i] * sizes[i])
        back = min(p[held] * sizes[held], (1 - p[i]) * sizes[i])
        moved = there if _draw(seed, keys[i], keys[held]) * (there + back) < back else -back
        p[held] += moved / sizes[held]
        p[i] -= moved / sizes[i]
        open_ = [j for j in (held, i) if _EPS < p[j] < 1 - _EPS]
        for j in (held, i):
            if j not in open_:
                p[j] = round(p[j])
        held = open_[0] if open_ else -1
    return p


def _round(seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        sizes, keys = group["size"].to_numpy(float), group["key"].to_numpy()
        group["p"] = pivot(pool(group["p"].to_numpy(), sizes, keys, seed), sizes, keys, seed)
        return group
    return run


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), *, share: float = 1.5, cap: float = 2.0,
                seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                keep: Sequence[str] | None = None, bucket: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """Decide how often the mix takes each row.

    ``weights`` repeat over the sources in code-point order, null last.
    Returns the input columns (or ``keep``) and ``size, source_size, target,
    copies, taken`` (``copies * size``). Only ids, sizes and sources are
    shuffled for the decision; texts join its result by key.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = row_key(id_col, source_col, text_col)
    units = materialize(docs.select(key.alias("key"), col(source_col).alias("source"), size.alias("size"))
                        .groupBy("key", "source", "size").agg(F.count("*").alias("rows")), "mix-units")
    # one row a source: totals, and the number of documents to round
    totals = (units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("n"), F.count("*").alias("docs"))
              .collect())
    totals.sort(key=lambda r: (r["source"] is None, str(r["source"]).encode("utf-8", "surrogatepass")))
    goal = targets_for([r["n"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, cap)
    plan = []
    for i, (r, t) in enumerate(zip(totals, goal, strict=True)):
        wanted = t / r["n"] if r["n"] else 0.0
        whole = math.floor(wanted + _EPS)
        plan.append((i, r["source"], r["n"], t, whole, max(0.0, wanted - whole), math.ceil(r["docs"] / bucket)))
    sources = spark.createDataFrame(plan, "nr int, source string, source_size long, target double, "
                                          "whole int, p double, buckets int")
    planned = (units.withColumn("source", F.col("source").cast("string")).alias("u")
               .join(sources.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
               # of all fractional copies of equal rows, the whole ones are theirs
               .withColumn("shared", F.when(F.col("size") > 0, F.col("p") * F.col("rows")).otherwise(0.0))
               .withColumn("more", F.floor(F.col("shared") + _EPS))
               .select("key", "nr", "size", "whole", "source_size", "target", "rows", "more",
                       F.greatest(F.lit(0.0), F.col("shared") - F.col("more")).alias("p"),
                       F.pmod(F.xxhash64("key", F.lit(seed)), F.col("buckets")).alias("bucket")))
    fields = "key long, nr int, size long, p double, bucket long"
    level = materialize(planned.select("key", "nr", "size", "p", "bucket").groupBy("nr", "bucket")
                        .applyInPandas(_round(seed), fields), "mix-rounded")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    decided = level.where(~open_)
    most = max([r[-1] for r in plan], default=0)
    step = 0
    while most > 1:         # the reduction tree: one row a bucket, then a group of buckets, ...
        step += 1
        level = materialize(level.where(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
                            .groupBy("nr", "bucket").applyInPandas(_round(seed + step), fields), "mix-residuals")
        decided = decided.unionByName(level.where(~open_))
        most = math.ceil(most / fan_in)
    draw = F.pmod(F.xxhash64("key", F.lit(seed), F.lit("last")), F.lit(1 << 40)) / float(1 << 40)
    decided = decided.unionByName(level.where(open_).withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0)))
    copies = (decided.select(F.col("key").alias("k"), F.col("p").cast("int").alias("extra"))
              .join(planned.select(F.col("key").alias("k"), "rows", "more", "whole", "source_size", "target"), "k")
              .withColumn("more", F.col("more") + F.col("extra")).drop("extra"))
    kept = others(docs, OUTPUT, keep)
    k, nth = (free_name(kept, name) for name in ("key", "nth"))
    out = docs.select(*[col(c) for c in kept], key.alias(k), size.alias("size"))
    if units.where("rows > 1").isEmpty():
        out = out.withColumn(nth, F.lit(1))
    else:
        out = _numbered(out, k, nth)
    each = F.col("whole") + (F.col(nth) <= F.col("more")).cast("int")
    return (out.join(copies, out[k] == copies["k"])
            .select(*kept, "size", "source_size", "target", F.when(F.col("size") > 0, each).otherwise(0).cast("long").alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))


def _numbered(rows: DataFrame, key: str, nth: str) -> DataFrame:
    """Rows of one key numbered from 1. A task numbers its own rows, and the
    counts of the tasks before it are added, so that no task sees all of them."""
    names = ["part", "order", "before", "k_of", "part_of"]
    part, order, before, k_of, part_of = (free_name([*rows.columns, nth], name) for name in names)
    rows = rows.withColumn(part, F.spark_partition_id()).withColumn(order, F.monotonically_increasing_id())
    rows = materialize(rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, part).orderBy(order))), "numbered")
    own = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = (rows.groupBy(key, part).agg(F.count("*").alias("n"))
              .select(F.col(key).alias(k_of), F.col(part).alias(part_of), F.coalesce(F.sum("n").over(own), F.lit(0)).alias(before)))
    return (rows.join(counts, (F.col(key) == F.col(k_of)) & (F.col(part) == F.col(part_of)))
            .withColumn(nth, F.col(nth) + F.col(before)).drop(k_of, part_of, part, order, before))


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
