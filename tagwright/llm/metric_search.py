"""Exact top-k search by inner product in an M-tree (operator 13).

Vectors are points of a metric space (Euclidean distance). The tree has a root,
routing nodes (``NODES`` pivots at most), leaf nodes under them (``LEAVES`` at
most), and pages of ``PAGE`` points. Pivots come from a bounded sample of
``SAMPLE`` rows; every row is indexed: it descends to the nearest routing node
and then to that node's nearest leaf, as an insertion into an M-tree does.
The points of a leaf are sorted by their distance from its pivot (the parent
distance) and cut into pages, and some pages make a bucket, the unit of
reading; a page keeps its points' parent distances, hence its covering radius
and the hole around the pivot, and its greatest norm. Of equal vectors, the
``k + 1`` of smallest id are points of the tree: no other copy can be among
the ``k`` best of any query.

Equal queries are searched once, for ``k + 1`` rows, of which each leaves out
itself. A search never computes more than the stored distances force it to. For a
query q and a point x below a pivot c, the triangle inequality gives
``d(q, x) >= |d(q, c) - d(c, x)|``, and ``2 q.x = |q|^2 + |x|^2 - d(q, x)^2``; so
distances from a node bound all scores below it. Queries are cut into blocks
of neighbours like the points. Best first: each block reads the bucket where
its queries lie, which gives every query a k-th score to beat; then blocks go
only to the leaves, buckets, pages and points whose bounds reach it, best
pages first, and the k-th scores rise on the way. Scores are exact; bounds
have a margin (``SLACK``) for rounding.

In Spark: the tree above the buckets is bounded and travels with the tasks;
buckets and blocks are tables, sorted by ranges, so that a leaf that holds a
third of all rows is many buckets in many tasks. Each task reads its bucket and then streams the blocks that come to it. Vectors
that the bounds cannot tell apart (evenly spread in many dimensions) are all
compared, in blocks.

Defined results: null vectors and vectors with null or non-finite components
(or 1024 times them) are neither queries nor candidates; shorter vectors count
as padded with zeros; a null id is never a query, and the last among ties;
repeated rows are rows of their own, as queries and as candidates; scores
beyond a long are ranked exactly (up to 37 digits) and returned as its ends;
an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import col, materialize, small_batches

SCALE = 1024
SAMPLE = 4096           # rows that pivots are taken from
NODES = 64              # routing nodes at most
LEAVES = 4096           # leaves at most
TREE_BYTES = 32 << 20   # of all pivots
PAGE = 512              # points of a page
BUCKET = 16             # pages of a bucket at most
BLOCK = 256             # queries of a block
SLACK = 1e-6            # of the squared norms
EXACT = float(1 << 53)
LONG, MOST = 2 ** 63, 10 ** 37

PACKED = "leaf int, lo double, hi double, norm double, keys array<struct<id:long,uid:long>>, apart array<double>, points binary"


def packed(components: np.ndarray) -> bytes:
    """Whole numbers as 4-byte integers if they all fit, else as doubles."""
    small = components.size == 0 or np.abs(components).max() < 2 ** 31
    return (b"i" + components.astype("<i4").tobytes()) if small else (b"f" + components.astype("<f8").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4" if data[:1] == b"i" else "<f8", offset=1).astype(np.float64)


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
        return np.sqrt(np.maximum(squares, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while they hold every whole number on
    the way, else in whole numbers of any size."""
    if not len(q) or not len(x) or norms(q).max() * norms(x).max() < EXACT:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return whole(q).dot(whole(x).T)


def bound(q_norm, apart, lo, hi, norm):
    """The greatest score of a query at distance ``apart`` from a pivot with
    points between ``lo`` and ``hi`` from it, of norm ``norm`` at most."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.maximum(0, np.maximum(apart - hi, lo - apart))
        room = q_norm * q_norm + norm * norm
        most = np.minimum((room - gap * gap) / 2, q_norm * norm) + SLACK * room
    return np.where(np.isnan(most), np.inf, most)       # too large for doubles: nothing is known


class Tree:
    """Routing nodes and leaves: pivots, and which leaves a node has."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dims = sample.shape[1]
        sample = np.unique(sample, axis=0)
        sample = sample[np.random.default_rng(3).permutation(len(sample))]
        self.leaf_pivots = sample[:max(1, min(leaves, len(sample)))]
        nodes = max(1, min(NODES, int(len(self.leaf_pivots) ** 0.5)))
        self.node_pivots = self.leaf_pivots[:nodes]
        at = distances(self.leaf_pivots, self.node_pivots).argmin(axis=1)
        self.members = [np.flatnonzero(at == k) for k in range(nodes)]

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and its distance from the leaf's pivot."""
        node = distances(x, self.node_pivots).argmin(axis=1)
        leaf, apart = np.zeros(len(x), np.int32), np.zeros(len(x))
        for k in np.unique(node):
            rows, own = np.flatnonzero(node == k), self.members[k]
            d = distances(x[rows], self.leaf_pivots[own])
            best = d.argmin(axis=1)
            leaf[rows], apart[rows] = own[best], d[np.arange(len(rows)), best]
        return leaf, apart


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, uid, dims, point``: the usable rows in whole numbers, written once
    (``uid`` tells repeated rows apart)."""
    scaled = F.transform(col(vector_col), lambda x: x.cast("double") * SCALE)
    usable = (rows.select(col(id_col).cast("long").alias("id"), scaled.alias("v"))
              .where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"))
    schema = T.StructType.fromDDL("id long, uid long, dims int, point binary")
    arrow = to_arrow_schema(schema)

    def pack(it):
        for batch in it:
            ids, uids, lists = batch.columns
            flat, ends = np.asarray(lists.flatten()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = np.floor(flat)
            points = [packed(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, uids, pa.array(np.diff(ends).astype(np.int32)), pa.array(points, pa.binary())], schema=arrow)

    return materialize(usable.select("id", F.monotonically_increasing_id().alias("uid"), "v").mapInArrow(pack, schema), "vectors")


def _matrix(points: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(points), dims))
    for row, p in zip(out, points, strict=True):
        v = unpacked(p)
        row[:len(v)] = v
    return out


def pages(points: DataFrame, tree: Tree, size: int) -> DataFrame:
    """Points of a leaf, by their distance from its pivot, ``size`` a row: the
    least and greatest distance, the greatest norm, ids, distances, vectors."""
    placed_schema = T.StructType.fromDDL("id long, uid long, leaf int, apart double, point binary")
    placed_arrow, page_schema = to_arrow_schema(placed_schema), T.StructType.fromDDL(PACKED)
    page_arrow, dims = to_arrow_schema(page_schema), tree.dims

    def place(it):
        for batch in it:
            leaf, apart = tree.descend(_matrix(batch["point"].to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["uid"], pa.array(leaf), pa.array(apart), batch["point"]], schema=placed_arrow)

    def cut(it):
        held: list = []

        def page():
            x = _matrix([r[4] for r in held], dims)
            row = [held[0][2], held[0][3], held[-1][3], float(norms(x).max()), [{"id": r[0], "uid": r[1]} for r in held],
                   [r[3] for r in held], packed(x)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, page_arrow, strict=True)], schema=page_arrow)

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == size or row[2] != held[0][2]):
                    yield page()
                    held = []
                held.append(row)
        if held:
            yield page()

    return (points.select("id", "uid", "point").mapInArrow(place, placed_schema)
            .repartitionByRange("leaf", "apart", "uid").sortWithinPartitions("leaf", "apart", "uid").mapInArrow(cut, page_schema))


class Best:
    """The k best (score, id, uid) of each query of a block so far."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor      # no score below its floor is wanted
        self.found: list[list] = [[] for _ in floor]

    def add(self, queries: np.ndarray, scores: np.ndarray, keys: list) -> None:
        """``scores``: one row a query of ``queries``, one column a key."""
        k = self.k
        if scores.shape[1] > k:
            least = np.sort(scores, axis=1)[:, -k] if scores.dtype == object else np.partition(scores, -k, axis=1)[:, -k]
            wanted = np.maximum(least, self.floor[queries])
        else:
            wanted = self.floor[queries]
        for row, q, w in zip(scores, queries.tolist(), wanted.tolist(), strict=True):
            new = [(int(row[j]), keys[j]["id"], keys[j]["uid"]) for j in np.flatnonzero(row >= w)]
            if new:
                ranked = sorted(self.found[q] + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
                self.found[q] = ranked[:k]
                if len(ranked) >= k:
                    self.floor[q] = max(self.floor[q], _below(self.found[q][-1][0]))


def _below(score: int) -> float:
    """A double that is no greater than the whole number."""
    f = float(score)
    return f if f <= score else float(np.nextafter(f, -np.inf))


def visit(bucket: list[tuple], pivot: np.ndarray, q: np.ndarray, best: Best) -> None:
    """Compare a block with a bucket of one leaf, most promising pages first."""
    apart, q_norm = distances(q, pivot[None])[:, 0], norms(q)
    reach = np.array([bound(q_norm, apart, lo, hi, norm) for lo, hi, norm, *_ in bucket])
    for p in np.argsort(-reach.max(axis=1)):
        alive = np.flatnonzero(reach[p] >= best.floor)
        if not len(alive):
            continue
        _, _, norm, keys, own, x = bucket[p]
        # points that some query may want, by their stored distances from the pivot
        wanted = (bound(q_norm[alive, None], apart[alive, None], own, own, norm) >= best.floor[alive, None]).any(axis=0)
        if wanted.any():
            some = np.flatnonzero(wanted)
            best.add(alive, products(q[alive], x[some]), keys if len(some) == len(keys) else [keys[j] for j in some])


FOUND = "block long, spot int, query long, vec_id long, vec_uid long, score decimal(38,0)"


def _compare(buckets: DataFrame, blocks: DataFrame, tree: Tree, k: int) -> DataFrame:
    """``blocks`` (with ``bucket`` and ``floors``) against their buckets: for
    each query (by its ``uid``) the ``k`` best of the bucket."""
    schema = T.StructType.fromDDL(FOUND.replace("decimal(38,0)", "string"))
    arrow, dims = to_arrow_schema(schema), tree.dims
    columns = ["bucket", "part", "block", "leaf", "lo", "hi", "norm", "keys", "apart", "points", "floors"]
    no_block, no_floors = F.lit(-1).cast("long").alias("block"), F.lit(None).cast("array<double>").alias("floors")
    read = blocks.select("bucket").distinct()
    dealt = (buckets.join(read, "bucket", "left_semi").select("*", no_block, no_floors, F.lit(0).alias("part")).select(columns)
             .unionByName(blocks.select("*", F.lit(1).alias("part")).select(columns))
             .repartition("bucket").sortWithinPartitions("bucket", "part"))

    def run(it):
        now, held, pivot = None, [], None
        for batch in (b.slice(j, 1) for b in it for j in range(len(b))):
            row = {c: batch[c][0].as_py() for c in columns}
            x = unpacked(row["points"]).reshape(len(row["keys"]), dims)
            if row["part"] == 0:
                if row["bucket"] != now:
                    now, held, pivot = row["bucket"], [], tree.leaf_pivots[row["leaf"]]
                held.append((row["lo"], row["hi"], row["norm"], row["keys"], np.array(row["apart"]), x))
                continue
            best = Best(k, np.array(row["floors"]))
            visit(held, pivot, x, best)
            out = [(row["block"], spot, key["uid"], i, u, str(max(-MOST, min(s, MOST)))) for spot, key in enumerate(row["keys"])
                   for s, i, u in best.found[spot]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema).withColumn("score", F.col("score").cast("decimal(38,0)"))


def _ranked(found: DataFrame, k: int, query: str = "query") -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "vec_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ahead(blocks: DataFrame, tree: Tree, leaves: dict[int, tuple]) -> DataFrame:
    """``block, leaf, near, far, q_norm, least``: the leaves where some query of a
    block may still find a score above its floor, and over those queries the
    range of distances from the pivot, the greatest norm and the least floor."""
    schema = T.StructType.fromDDL("block long, leaf int, near double, far double, q_norm double, least double")
    arrow, dims = to_arrow_schema(schema), tree.dims
    ids = sorted(leaves)
    pivots = tree.leaf_pivots[ids] if ids else np.zeros((0, dims))
    lo, hi, norm = (np.array([leaves[i][j] for i in ids]) for j in range(3))

    def run(it):
        for batch in (b.slice(j, 1) for b in it for j in range(len(b))):
            floors = np.array(batch["floors"][0].as_py())
            q = unpacked(batch["points"][0].as_py()).reshape(len(floors), dims)
            q_norm = norms(q)
            apart = distances(q, pivots)
            alive = bound(q_norm[:, None], apart, lo, hi, norm) >= floors[:, None]
            rows = [(batch["block"][0].as_py(), ids[j], float(apart[a, j].min()), float(apart[a, j].max()), float(q_norm[a].max()),
                     float(floors[a].min())) for j in np.flatnonzero(alive.any(axis=0)) for a in [alive[:, j]]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return blocks.select("block", "points", "floors").mapInArrow(run, schema)


def top_matches(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100,
                k: int = 10) -> DataFrame:
    """For each row whose id is divisible by ``every``: the ``k`` other rows with
    the greatest inner products, as ``query_id, rank, vec_id, score``."""
    spark = rows.sparkSession
    small_batches(spark)
    points = vectors(rows, id_col, vector_col)
    n, dims = points.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(0))).first()
    picked = points.select("uid", "point").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).collect()     # a bounded sample
    sample = _matrix([r["point"] for r in picked], dims)
    tree = Tree(sample if n else np.zeros((1, dims)), min(LEAVES, 1 + n // (2 * PAGE), 1 + TREE_BYTES // (8 * max(1, dims))))

    # copies beyond the k + 1 of smallest id cannot be found; equal queries are one
    copies = Window.partitionBy("point").orderBy(F.col("id").asc_nulls_last(), "uid")
    indexed = points.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    asked = points.where(F.col("id") % every == 0)
    queries = asked.groupBy("point").agg(F.min("uid").alias("uid"))
    size = max(1, min(BUCKET, n // (PAGE * 4 * spark.sparkContext.defaultParallelism)))
    paged = pages(indexed, tree, PAGE).withColumn("page", F.monotonically_increasing_id())
    paged = materialize(paged.withColumn("bucket", F.concat_ws(":", "leaf", F.col("page") - F.col("page") % size)), "pages")
    heads = materialize(paged.groupBy("bucket", "leaf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm")), "buckets")
    # one row a leaf, LEAVES at most
    leaves = {r["leaf"]: (r["lo"], r["hi"], r["norm"]) for r in
              heads.groupBy("leaf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm")).collect()}

    blocks = pages(queries.withColumn("id", F.lit(None).cast("long")), tree, BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(blocks.withColumn("floors", F.expr("transform(keys, x -> double('-Infinity'))")), "query-blocks")

    # first the bucket that lies nearest to the block, of its own leaf if that has any
    ends = heads.select("bucket", "leaf", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    gap = F.greatest(F.lit(0.0), F.col("b_lo") - F.col("hi"), F.col("lo") - F.col("b_hi"))
    home = materialize(blocks.select("block", "leaf", "lo", "hi").join(ends, "leaf")
                       .groupBy("block").agg(F.min_by("bucket", F.struct(gap.alias("gap"), "bucket")).alias("bucket")), "home-buckets")
    first = materialize(_compare(paged, blocks.join(home, "block"), tree, k + 1), "first-scores")

    # then wherever a score may still reach a query's least
    kth = (_ranked(first, k + 1).where(F.col("rank") == k + 1)
           .select("block", "spot", F.col("score").cast("double").alias("kth")))
    by_block = kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("spot", "kth"))).alias("kths"))    # BLOCK at most
    floors = F.expr("transform(keys, (x, i) -> coalesce(kths[i] - abs(kths[i]) * 1e-15D, double('-Infinity')))")
    blocks = materialize(blocks.drop("floors").join(by_block, "block", "left").withColumn("floors", floors).drop("kths"), "query-blocks")
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("hi"), F.col("lo") - F.col("far"))
    room = F.col("q_norm") * F.col("q_norm") + F.col("norm") * F.col("norm")
    pairs = (_ahead(blocks, tree, leaves).join(heads, "leaf").where((room - gap * gap) / 2 + SLACK * room >= F.col("least"))
             .select("block", "bucket").join(home, ["block", "bucket"], "left_anti"))
    rest = _compare(paged, blocks.join(materialize(pairs, "bucket-pairs"), "block"), tree, k + 1)
    found = _ranked(first.unionByName(rest), k + 1).drop("rank", "block", "spot")

    rows_asked = asked.join(queries.select("point", F.col("uid").alias("query")), "point").select("id", "uid", "query")
    score = F.least(F.greatest(F.col("score"), F.lit(-LONG).cast("decimal(38,0)")), F.lit(LONG - 1).cast("decimal(38,0)")).cast("long")
    return (_ranked(rows_asked.join(found, "query").where("uid <> vec_uid"), k, "uid")
            .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score")))
