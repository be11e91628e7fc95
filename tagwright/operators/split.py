"""Deterministic hash splits.

Row order comes from ``md5("<seed>:<key>")`` -- the same in Spark and in any
SQL engine, so a split can be checked independently and is stable across
runs, partitionings and executor losses.

A split needs no ranks: only the place in that order where it cuts. A
histogram over the first hex digits of the hash (map-side combined) finds the
bucket that holds the cut, and only rows of that bucket are looked at again,
with longer prefixes until few are left. Membership is then the map-only
filter ``order <= cut``: the payload is never shuffled or sorted.

Null keys and null strata are values like any other; no row is dropped. The
order is made total by a hash of the whole row, so rows that share a key have
a fixed order; rows equal in every column stay on one side together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DIGITS = 3              # hex digits that one histogram adds
SORTED_ROWS = 100_000   # rows of one bucket that are sorted in one task

Keys = Sequence[str] | str


def _names(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hash_key(key: Keys | Column, seed: int) -> Column:
    """``md5("<seed>:<key>")``; parts of a composite key are joined by ``|``,
    a null is the empty text."""
    cols = [key] if isinstance(key, Column) else [F.col(k) for k in _names(key)]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def _order(df: DataFrame, key: Keys, seed: int, unit: str) -> list[Column]:
    """The columns of the total order: hash, key and, for rows, a row hash."""
    cols = [hash_key(key, seed), *[F.col(k) for k in _names(key)]]
    if unit == "row":
        cols.append(F.xxhash64(*[F.col(c) for c in df.columns]))
    elif unit != "article":
        raise ValueError("split_unit is 'row' or 'article'")
    return cols


def _after(names: Sequence[str], cut: Sequence[Column]) -> Column:
    """``names > cut`` in the total order, nulls first."""
    out = F.lit(False)
    for n, c in reversed(list(zip(names, cut, strict=True))):
        x = F.col(n) if isinstance(n, str) else n
        greater = F.coalesce(x > c, x.isNotNull() & c.isNull())
        out = greater | (x.eqNullSafe(c) & out)
    return out


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def _cuts(ids: DataFrame, strata: list[str], order: list[str], quota: DataFrame) -> DataFrame:
    """The last test row of each stratum: ``strata..., order...`` for the
    strata whose ``quota`` (columns ``strata..., quota``) is above 0."""
    s = [f"_s{i}" for i in range(len(strata))]
    left = quota.where("quota > 0").select(*[F.col(c).alias(x) for c, x in zip(strata, s, strict=True)],
                                           F.lit("").alias("_prefix"), F.col("quota").alias("_left"))
    rows = ids
    for digits in range(DIGITS, 33, DIGITS):
        # rows of the bucket that holds the cut, by one more stretch of the hash
        b = rows.withColumn("_b", F.substring(order[0], 1, digits))
        hist = b.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
        upto = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_sum", F.sum("_c").over(upto))
        left = materialize(
            hist.join(left, _same(strata, s)).where((F.col("_sum") >= F.col("_left")) & (F.col("_sum") - F.col("_c") < F.col("_left")))
            .select(*s, F.col("_b").alias("_prefix"), (F.col("_left") - F.col("_sum") + F.col("_c")).alias("_left"),
                    F.col("_c").alias("_size")), "split-buckets")
        rows = ids.join(left.select(*s, F.col("_prefix").alias("_p")), _same(strata, s)
                        & (F.substring(order[0], 1, digits) == F.col("_p")), "left_semi")
        if (left.agg(F.max("_size")).first()[0] or 0) <= SORTED_ROWS:
            break
    w = Window.partitionBy(*strata).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = rows.withColumn("_r", F.row_number().over(w))
    return ranked.join(left.select(*s, "_left"), _same(strata, s)).where("_r = _left").select(*strata, *order)


def _split(df: DataFrame, key: Keys, strata: list[str], seed: int, quota, unit: str, out: str) -> DataFrame:
    """``quota(counts)`` maps ``strata..., n_s`` to ``strata..., quota``."""
    cols = _order(df, key, seed, unit)
    order = [f"_o{i}" for i in range(len(cols))]
    ids = df.select(*[F.col(c) for c in strata], *[c.alias(o) for c, o in zip(cols, order, strict=True)])
    if unit == "article":
        ids = ids.distinct()
    one = not strata
    if one:
        strata, ids = ["_all"], ids.withColumn("_all", F.lit(0))
    counts = materialize(ids.groupBy(*strata).agg(F.count("*").alias("n_s")), "split-counts")
    cuts = _cuts(ids, strata, order, quota(counts))
    if one:
        # a single cut is a literal of the filter: no join at all
        cut = cuts.drop("_all").collect()
        if not cut:
            return df.withColumn(out, F.lit("train"))
        types = dict(cuts.dtypes)
        values = [F.lit(cut[0][o]).cast(types[o]) for o in order]
        return df.withColumn(out, F.when(_after(cols, values), "train").otherwise("test"))
    # written, so that its size is known: Spark broadcasts it when it is small
    cuts = materialize(cuts, "split-cuts")
    renamed = cuts.select(*[F.col(c).alias(f"_c_{i}") for i, c in enumerate(cuts.columns)])
    s = renamed.columns[:len(strata)]
    values = [F.col(c) for c in renamed.columns[len(strata):]]
    joined = df.join(renamed, _same(strata, s), "left")
    test = values[0].isNotNull() & ~_after(cols, values)
    return joined.withColumn(out, F.when(test, "test").otherwise("train")).drop(*renamed.columns)


def _ceil_share(n: int, share: float) -> int:
    # exact ceil of share*n for decimal shares such as 0.2
    return math.ceil(Fraction(str(share)) * n)


def train_test_split(df: DataFrame, key: Keys, seed: int = 92, test_size: float = 0.2,
                     out: str = "split", split_unit: str = "row") -> DataFrame:
    """A5: the ``ceil(test_size * n)`` first in hash order are test. The unit is
    the row, or the article: all rows of one key, counted once."""
    def quota(counts: DataFrame) -> DataFrame:
        n = counts.agg(F.coalesce(F.sum("n_s"), F.lit(0))).first()[0]
        return counts.withColumn("quota", F.lit(_ceil_share(n, test_size)))
    return _split(df, key, [], seed, quota, split_unit, out)


def stratum_quotas(counts: DataFrame, strata: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """Largest remainders: ``ceil(test_size * n)`` test rows over the strata of
    ``counts`` (``strata..., n_s``). Each stratum gets the floor of its share;
    what is left goes to the largest remainders, ties to the stratum that
    sorts first as text. Exact in 38 digits, for any number of strata."""
    n = counts.agg(F.coalesce(F.sum("n_s"), F.lit(0))).first()[0]
    total = _ceil_share(int(n), test_size)
    big = F.col("n_s").cast("decimal(20,0)") * F.lit(total).cast("decimal(18,0)")
    shares = counts.withColumn("_q", F.expr(f"CAST(n_s AS DECIMAL(20,0)) * CAST({total} AS DECIMAL(18,0)) div {max(int(n), 1)}"))
    shares = materialize(shares.withColumn("_rest", big - F.col("_q").cast("decimal(19,0)") * F.lit(int(n)).cast("decimal(19,0)")),
                         "split-quotas")
    left = total - int(shares.agg(F.coalesce(F.sum("_q"), F.lit(0))).first()[0])
    names = [F.col(c).cast("string").asc_nulls_first() for c in strata]
    more = shares.orderBy(F.col("_rest").desc(), *names).limit(left).select(
        *[F.col(c).alias(f"_m{i}") for i, c in enumerate(strata)], F.lit(1).alias("_more"))
    return (shares.join(more, _same(strata, [f"_m{i}" for i in range(len(list(strata)))]), "left")
            .select(*strata, "n_s", (F.col("_q") + F.coalesce("_more", F.lit(0))).cast("bigint").alias("quota")))


def stratified_split(df: DataFrame, key: Keys, stratum: Keys, seed: int = 92, test_size: float = 0.2,
                     out: str = "split", split_unit: str = "row") -> DataFrame:
    """Per-stratum quotas, then the first in hash order of each stratum
    are test."""
    strata = _names(stratum)
    return _split(df, key, strata, seed, lambda counts: stratum_quotas(counts, strata, test_size), split_unit, out)


def rank_within(df: DataFrame, key: Keys, seed: int, strata: Sequence[str] = (),
                digits: int | None = None, out: str = "rank") -> DataFrame:
    """Add ``out``: 0-based position of the row inside its stratum in the
    total order. A histogram over hash prefixes gives each bucket's offset;
    only rows of one bucket are sorted together. Without ``digits`` the
    prefix is long enough for buckets of about ``SORTED_ROWS`` rows."""
    strata = list(strata)
    cols = _order(df, key, seed, "row")
    d = df.withColumn("_h", cols[0])
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, df.count() / SORTED_ROWS), 16)))
    d = d.withColumn("_b", F.substring("_h", 1, digits))
    hist = d.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_s{i}" for i in range(len(strata))]
    offs = hist.select(*[F.col(c).alias(x) for c, x in zip(strata, names, strict=True)], F.col("_b").alias("_b2"),
                       F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    wb = Window.partitionBy(*strata, "_b").orderBy("_h", *[c.asc_nulls_first() for c in cols[1:]])
    return (d.join(offs, _same([*strata, "_b"], [*names, "_b2"]))
             .withColumn(out, (F.col("_off") + F.row_number().over(wb) - 1).cast("bigint"))
             .drop("_h", "_b", "_b2", "_off", *names))


def stratified_folds(df: DataFrame, key: Keys, label: str, seed: int = 92,
                     n_folds: int = 5, out: str = "fold") -> DataFrame:
    """M8: fold = rank inside the class, modulo ``n_folds`` -- every fold
    gets the same class mix up to one row."""
    r = rank_within(df, key, seed, [label])
    return r.withColumn(out, (F.col("rank") % n_folds).cast("int")).drop("rank")


def group_sample_n(df: DataFrame, group: str, key: Keys, n: int, seed: int = 92) -> DataFrame:
    """``n`` rows per group, first in hash order. ``row_number() <= n``
    lets Spark apply a partial per-group limit before the shuffle, so a hot
    group ships at most ``n`` rows per map task."""
    w = Window.partitionBy(group).orderBy(hash_key(key, seed), *_names(key))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sample_n(df: DataFrame, key: Keys, n: int, seed: int = 92) -> DataFrame:
    """``n`` rows first in hash order (a top-k, no global sort)."""
    return df.orderBy(hash_key(key, seed), *_names(key)).limit(n)
