"""Helpers shared by the operators of this package.

Texts reach Python as UTF-8 bytes (``cast('binary')``): no decoding, and the
ASCII-only lower-casing and word rules of the operators are exact on bytes,
because no byte of a multi-byte character is below 0x80.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagwright.session import materialize, scratch_path  # noqa: F401 - re-used by the operators

# The package's functions travel to the Python workers by value: executors
# need the libraries, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = str(4 << 20)
ROWS_AT_ONCE = 1024     # rows that a Python task turns into Python objects at a time

#: Words of most operators: runs of anything but ASCII blanks. ``bytes.split()``
#: splits on exactly these bytes, so Python tasks need no regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python tasks: Spark's own default holds 64 MB
    of texts outside the heap, doubled as it grows, for each running task. A
    setting of the user's stays. Results do not depend on it."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Scan the named columns of one table (column pruning reaches the scan)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*columns)


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's identity and content. Rows that are equal in
    these columns share it, so repeated rows get equal results; nulls count
    as a value. Joins on it also compare the id (``same_row``)."""
    return F.xxhash64(*[F.col(c) for c in columns])


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def id_hash_mod(column: str, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def batches(rows: Iterator[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Apply ``make(batch) -> dict of columns`` to each Arrow batch."""
    for batch in rows:
        yield pa.RecordBatch.from_pydict(make(batch), schema=schema)


def worker_state(key, make: Callable, only: str | None = None):
    """An object that a Python worker process makes once and keeps from task
    to task (a cache, never data). ``only``: keep one object of this kind, that
    of the latest key. Functions that travel by value have no
    module of their own on the worker, so it hangs on the interpreter."""
    kept = sys.modules.setdefault("_tagwright_worker", type(sys)("_tagwright_worker")).__dict__
    slot = key if only is None else only
    if slot not in kept or kept[slot][0] != key:
        kept[slot] = key, make()
    return kept[slot][1]


def forget(key) -> None:
    """Drop what ``worker_state`` keeps under ``key``."""
    sys.modules.setdefault("_tagwright_worker", type(sys)("_tagwright_worker")).__dict__.pop(key, None)


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, or the first longer form of it that no taken column has
    (names that differ only in case are the same to Spark)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def others(df: DataFrame, own: Sequence[str], keep: Sequence[str] | None = None) -> list[str]:
    """The columns to carry: those of ``keep`` (all by default) that the
    operator does not itself return."""
    mine = {c.lower() for c in own}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in mine]


def arrow_columns(df: DataFrame, inputs: Sequence[Column], make: Callable[..., dict], ddl: str,
                  keep: Sequence[str] | None = None, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Carry the columns of ``keep`` and add those that ``make`` computes.

    ``make`` gets one Arrow array per input column and returns a list of
    values per column of ``ddl``; it runs on ``at_once`` rows at a time, in
    the partitions of ``df``, without a shuffle.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(ddl)
    kept = others(df, new.names, keep)
    schema = T.StructType([df.schema[c] for c in kept] + new.fields)
    arrow = to_arrow_schema(new)
    n = len(kept)

    def run(rows):
        for batch in (b.slice(k, at_once) for b in rows for k in range(0, len(b), at_once)):
            made = make(*batch.columns[n:])
            arrays = list(batch.columns[:n]) + [pa.array(made[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + list(arrow.names))

    taken: list[str] = []
    named = []
    for i, c in enumerate(inputs):
        taken.append(free_name(kept + taken, f"input_{i}"))
        named.append(c.alias(taken[-1]))
    return df.select(*[col(c) for c in kept], *named).mapInArrow(run, schema)
