"""Removal of repeated byte strings by a hash-compared suffix sort (operator 1).

Every byte that lies in a string of ``SPAN`` bytes that also starts anywhere
else, in the same document or another, is removed.

1. Anchors. Of all ``GRAM``-byte strings of a ``SPAN``-byte window the one of
   smallest hash (the first of equal ones) is its anchor, so equal windows have
   equal anchors at the same place. Neighbouring windows mostly share their
   anchor; a document becomes one row for each anchor with the run of window
   starts that it serves: an anchor hash (polynomial) and an independent hash
   of all bytes of the run.
2. Runs whose anchor and bytes occur twice or more are repeated as a whole;
   anchors that occur once are not repeated. Both follow from grouped counts.
3. What is left are runs whose anchor recurs in other surroundings: the ends
   of repeated passages. One run for each different surrounding is cut out of
   its text, and the runs of an anchor are suffix-sorted: those beginning at
   the anchor, and, read backwards, those ending there. The sort is a mergesort
   that compares by the longest common extension, found by binary search on
   prefix polynomial hashes; common prefixes of neighbours are then taken from
   the bytes themselves. Two windows are equal if and only if their parts after
   and before the anchor's start fall into the same classes of the two orders.
4. Anchors with more than ``GROUP`` different surroundings are not gathered in
   one task: their windows are counted by 128-bit hash instead.
5. Repeated runs are joined to the documents and merged into removed spans.

Defined results: a null text has no bytes; texts below ``SPAN`` bytes lose
nothing; repeated rows are copies of each other, like any other copies; an
empty table gives no rows. Rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, batches, col, free_name, materialize, others, row_key, utf8, worker_state

SPAN = 200          # bytes of a repeated string
GRAM = 64           # bytes of an anchor
GROUP = 4096        # different surroundings of an anchor that are sorted in one task
PIECE = 1 << 20     # window starts worked on at a time

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = np.uint64((1 << 24) - 1)    # low bits of a packed hash and place; PIECE + SPAN stays below
_SORT_BYTES = 4 << 20                   # surroundings sorted at a time


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:         # step is base ** done
        k = min(done, n - done)
        out[done:done + k] = out[:k] * np.uint64(step)
        done, step = done + k, step * step % (1 << 64)
    return out


def _letters() -> np.ndarray:
    """A hash of each byte value, so that equal steps between bytes differ."""
    return np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)


class Prefixes:
    """Prefix polynomial hashes of a byte string: hash of any part in one step."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        room = 1 << max(10, int(n).bit_length())
        powers = worker_state(("powers", room), lambda: (_powers(_BASE, room), _powers(_INVERSE, room)))
        letters = worker_state("letters", _letters)
        self.inverse = powers[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[buf] * powers[0][:n], out=self.sums[1:])

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima run up and down blocks."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1:width - 1 + n])


def anchors(text: bytes, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of the text: anchor hashes, first window starts, numbers of
    windows and distances from first start to anchor."""
    for begin in range(0, len(text) - span + 1, PIECE):
        buf = np.frombuffer(text, np.uint8, min(PIECE + span - 1, len(text) - begin), begin)
        at = np.arange(len(buf) - gram + 1)
        hashes = Prefixes(buf).part(at, at + gram)
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        packed = hashes & ~_POSITION | at.astype(np.uint64)
        place = (sliding_minimum(packed, span - gram + 1) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(first, len(place)))
        yield hashes[place[first]].view(np.int64), begin + first, count, place[first] - first


def _pack(start, count, distance):
    """A run of windows in one long; undone by the SQL and Python below."""
    return start << 20 | count << 10 | distance


def _anchor_rows(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """``anchor, body, row, run``: one row per run of windows."""
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "body", "row", "run")])

    def make(batch):
        parts = [[np.empty(0, np.int64)] for _ in schema]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for anchor, start, count, distance in anchors(text, span, gram):
                view, digest = memoryview(text), xxhash.xxh3_64_intdigest
                body = np.array([digest(view[a:b]) for a, b in zip(start.tolist(), (start + count + span - 1).tolist(), strict=True)],
                                np.uint64).view(np.int64)
                # the same bytes with the anchor elsewhere would not be the same run
                run = _pack(start, count, distance)
                for p, v in zip(parts, (anchor, body, np.full(len(anchor), row, np.int64), run), strict=True):
                    p.append(v)
        return {c: np.concatenate(p) for c, p in zip(schema.names, parts, strict=True)}

    return texts.select("row", "bytes").mapInArrow(
        lambda it: batches((b.slice(k, 256) for b in it for k in range(0, len(b), 256)), make, schema),
        "anchor long, body long, row long, run long")


def suffix_order(data: Prefixes, buf: np.ndarray, start: np.ndarray, length: np.ndarray,
                 group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort the strings ``buf[start:start + length]`` within each group
    (groups are consecutive). Returns the order, and the length of the common
    prefix of each string with the one before it in its group (-1 at the first)."""
    n = len(start)
    first = np.searchsorted(group, group, side="left")
    last = np.searchsorted(group, group, side="right")
    order = np.arange(n)

    def extension(x, y):
        """Longest common prefix by binary search on hashes of prefixes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(length[x], length[y])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = data.part(start[x], start[x] + middle) == data.part(start[y], start[y] + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(x, y, or_equal):
        k = extension(x, y)
        ended = (k == length[x]) | (k == length[y])
        end = len(buf) - 1
        less = buf[np.minimum(start[x] + k, end)] < buf[np.minimum(start[y] + k, end)]
        shorter = np.where(or_equal, length[x] <= length[y], length[x] < length[y])
        return np.where(ended, shorter, less)

    run = 1
    most = int((last - first).max(initial=1))
    while run < most:
        # each element looks for its rank in the neighbouring run of its pair
        inside = np.arange(n) - first
        left = inside // run % 2 == 0
        pair = first + inside // (2 * run) * (2 * run)
        other_low = np.where(left, np.minimum(pair + run, last), pair)
        other_high = np.where(left, np.minimum(pair + 2 * run, last), np.minimum(pair + run, last))
        low, high = other_low.copy(), other_high.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) >> 1
            # elements of the left run stand before equal ones of the right
            goes_on = before(order[middle], order[live], ~left[live])
            low[live] = np.where(goes_on, middle + 1, low[live])
            high[live] = np.where(goes_on, high[live], middle)
        own_low = np.where(left, pair, np.minimum(pair + run, last))
        place = pair + (np.arange(n) - own_low) + (low - other_low)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        run *= 2
    common = np.full(n, -1)
    inner = np.flatnonzero(np.arange(n) > first)
    x, y = order[inner - 1], order[inner]
    common[inner] = _common_bytes(buf, start[x], start[y], np.minimum(length[x], length[y]))
    return order, common


def _common_bytes(buf: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Lengths of common prefixes, byte by byte: what the hashes found is
    checked here, and only this counts."""
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        same = buf[x[live] + out[live]] == buf[y[live] + out[live]]
        out[live[same]] += 1
        live = live[same]
        live = live[out[live] < limit[live]]
    return out


def _classes(order: np.ndarray, common: np.ndarray, at_least: int) -> np.ndarray:
    """Class of each string: equal for strings that share ``at_least`` first bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < at_least)
    return out


def repeated_windows(groups: np.ndarray, runs: np.ndarray, texts: list[bytes], span: int) -> list[tuple[int, int, int]]:
    """Which windows of the runs occur in another run of the same group (groups
    are consecutive): ``(index of the run, first and last window)`` stretches."""
    count, distance = runs >> 10 & 1023, runs & 1023
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    forward = np.frombuffer(b"".join(texts), np.uint8)
    backward = np.frombuffer(b"".join(t[::-1] for t in texts), np.uint8)
    after, after_common = suffix_order(Prefixes(forward), forward, starts + distance, sizes - distance, groups)
    until, until_common = suffix_order(Prefixes(backward), backward, ends - distance, distance, groups)
    found = np.zeros((len(texts), int(count.max())), bool)
    window = np.zeros(len(texts), np.int64)
    for a in range(int((distance - count + 1).min()), int(distance.max()) + 1):     # bytes before the anchor
        window = distance - a
        on = np.flatnonzero((window >= 0) & (window < count))
        if len(on) < 2:
            continue
        pair = _classes(after, after_common, span - a)[on] * (len(texts) + 1) + _classes(until, until_common, a)[on]
        _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        hit = on[times[which] > 1]
        found[hit, window[hit]] = True
    out = []
    for i in np.flatnonzero(found.any(axis=1)):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], found[i].view(np.int8), [0]))))
        out += [(int(i), int(x), int(y) - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)]
    return out


def _cut_runs(texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of the wanted runs (``row, anchor, run, hot``): for hot
    anchors one row a window with its hashes, else one row a run."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "run", "hot", "single")).alias("runs"))
    schema = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("run", pa.int64()), ("single", pa.bool_()),
                        ("bytes", pa.binary()), ("window", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    joined = texts.join(lists.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"))

    def make(batch):
        rows = []
        for row, text, runs in zip(*(batch.column(c).to_pylist() for c in ("row", "bytes", "runs")), strict=True):
            for r in runs:
                start, count = r["run"] >> 20, r["run"] >> 10 & 1023
                if not r["hot"]:
                    rows.append((r["anchor"], row, r["run"], r["single"], text[start:start + count + span - 1], None, None, None))
                    continue
                for w in range(start, start + count):
                    h = xxhash.xxh3_128_intdigest(text[w:w + span])
                    rows.append((r["anchor"], row, r["run"], r["single"], None, w,
                                 (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
        return dict(zip(schema.names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in schema.names}

    return joined.mapInArrow(
        lambda it: batches((b.slice(k, 256) for b in it for k in range(0, len(b), 256)), make, schema),
        "anchor long, row long, run long, single boolean, bytes binary, window long, high long, low long")


def _sorted_matches(cut: DataFrame, span: int) -> DataFrame:
    """Suffix-sort the surroundings of each anchor: ``row, start, stop``."""
    dealt = cut.where("bytes IS NOT NULL").select("anchor", "row", "run", "single", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def solve(columns):
        anchor, row, run, single, texts = columns
        _, group = np.unique(anchor, return_inverse=True)
        rows = []
        for i, x, y in repeated_windows(group, run, texts, span):
            if single[i]:
                start = int(run[i] >> 20)
                rows.append((int(row[i]), start + x, start + y + span))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else
                                          [pa.array([], pa.int64())] * 3, schema=schema)

    def run_all(batches_in):
        held: list[tuple] = []      # whole groups are solved, the last one waits for its end
        size = 0
        for batch in batches_in:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= _SORT_BYTES and item[0] != held[-1][0]:
                    yield solve(_columns(held))
                    held, size = [], 0
                held.append(item)
                size += len(item[4])
        if held:
            yield solve(_columns(held))

    def _columns(items):
        anchor, row, run, single, texts = zip(*items, strict=True)
        return np.array(anchor), np.array(row), np.array(run), single, list(texts)

    return dealt.mapInArrow(run_all, "row long, start long, stop long")


def _hot_matches(cut: DataFrame, span: int) -> DataFrame:
    windows = cut.where("window IS NOT NULL").select("row", "single", "window", "high", "low")
    again = materialize(windows.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "hot-windows")
    return (windows.where("single").join(again, ["high", "low"])
            .select("row", F.col("window").alias("start"), (F.col("window") + span).alias("stop")))


def repeated_spans(texts: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``row, start, stop`` (byte places) of repeated strings, overlapping,
    for texts ``row, bytes``."""
    rows = _anchor_rows(texts, span, gram)
    # grouped tables are written before they are joined: a join straight on a
    # grouped sum could not split the rows of a hot anchor
    again = materialize(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
                        .select(F.col("anchor").alias("_anchor")), "recurring-anchors")
    rows = materialize(rows.join(again, F.col("anchor") == F.col("_anchor")).drop("_anchor"), "recurring-runs")
    bodies = materialize(rows.groupBy("anchor", "body", (F.col("run").bitwiseAND((1 << 20) - 1)).alias("shape"))
                         .agg(F.count("*").alias("n"), F.min(F.struct("row", "run")).alias("one")), "run-bodies")
    copies = bodies.where("n > 1").select(F.col("anchor").alias("_anchor"), F.col("body").alias("_body"), "shape")
    whole = rows.join(copies, (F.col("anchor") == F.col("_anchor")) & (F.col("body") == F.col("_body"))
                      & (F.col("run").bitwiseAND((1 << 20) - 1) == F.col("shape")))
    start = F.shiftright("run", 20)
    count = F.shiftright("run", 10).bitwiseAND(1023)
    whole = whole.select("row", start.alias("start"), (start + count + (span - 1)).alias("stop"))
    per_anchor = materialize(
        bodies.groupBy("anchor").agg(F.count("*").alias("bodies"), F.count_if(F.col("n") == 1).alias("single"))
        .where("bodies > 1 AND single > 0").select(F.col("anchor").alias("_anchor"), "bodies"), "anchor-bodies")
    wanted = (bodies.join(per_anchor, F.col("anchor") == F.col("_anchor"))
              .select("one.row", "anchor", "one.run", (F.col("bodies") > group).alias("hot"), (F.col("n") == 1).alias("single")))
    cut = materialize(_cut_runs(texts, wanted, span), "cut-runs")
    return whole.unionByName(_sorted_matches(cut, span)).unionByName(_hot_matches(cut, span))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM,
                   group: int = GROUP, keep: Sequence[str] | None = None, with_text: bool = True) -> DataFrame:
    """The input columns (or ``keep``) and ``n_bytes, n_removed, n_spans,
    kept_sha256``; with ``with_text`` also ``removed`` (spans of bytes) and
    ``kept_bytes`` (the text without them, which may end a character early)."""
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        ddl += ", removed array<struct<start: long, stop: long>>, kept_bytes binary"
    names = [f.split()[0] for f in ddl.split(", ") if not f.startswith("stop")]
    kept = others(docs, names, keep)
    row, data = free_name(kept, "row"), free_name(kept, "bytes")
    texts = docs.select(*[col(c) for c in kept], row_key(id_col, text_col).alias(row), utf8(text_col).alias(data))
    spans = repeated_spans(texts.select(F.col(row).alias("row"), F.col(data).alias("bytes")), span, gram, group)
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    key, found = free_name([*kept, row, data], "key"), free_name([*kept, row, data], "spans")
    spans = spans.select(F.col("row").alias(key), F.col("spans").alias(found))
    joined = texts.join(spans, texts[row] == spans[key], "left")

    def make(texts, spans):
        out = {c: [] for c in names}
        for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            merged: list[list[int]] = []
            for s in found or []:
                if merged and s["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["stop"])
                else:
                    merged.append([s["start"], s["stop"]])
            edges = [0, *(e for m in merged for e in m), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            values = [len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest()]
            if with_text:
                values += [[{"start": a, "stop": b} for a, b in merged], rest]
            for c, v in zip(names, values, strict=True):
                out[c].append(v)
        return out

    return arrow_columns(joined, [F.col(data), F.col(found)], make, ddl, kept)
