"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (longs): ``root`` is
    the smallest node that can be reached.

    Each round hangs every node's larger neighbours on the smallest one it
    sees (large star), then every node's smaller neighbours likewise (small
    star), until no edge changes; the number of rounds grows with the
    logarithm of the longest path. Each step is a grouped minimum (combined
    before the shuffle) and a join, and each round's edges are written to the
    shared folder, so that a lost executor costs one round at most.
    """
    step = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                       .where("u > v").distinct(), "edges")
    seen = _state(step)
    for _ in range(max_rounds):
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = (large.join(least, large["u"] == least["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))))
        step = materialize(small.where("u > v").distinct(), "edges")
        now = _state(step)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return (step.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(step.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def _state(edges: DataFrame) -> tuple:
    """A digest of the edge set: count, and sum of edge hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
