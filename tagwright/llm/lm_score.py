"""Language-model scoring by logistic context mixing (operator 9).

A text (A-Z lower-cased) is a string of bytes and an end symbol, coded bit by
bit, the highest first. Several predictors look up the next bit's probability
under a hashed context: the last one, two and three bytes, and the word so
far; each with the bits of the byte that are known already. Their logits are
added up with weights that the known bits select (the gate), and the result is
refined by a table of observed outcomes for the last byte and the mixed logit.
The text's bits make ``score`` (log10 of its probability), and
``bits_per_byte``.

* Counting covers all training texts. Their different words and word beginnings
  (with the bytes before) are numbered by a grouped sum; a task counts the
  symbols of its share and hands over its counter tables, of fixed size, which
  are added up in a tree.
* The gate's weights and the refining table are learned over all training
  texts, each symbol as often as it occurs and each bit predicted from counts
  without its own occurrence. The gate takes Newton steps on grouped sums, at
  most ``ROUNDS`` passes; then one pass counts the outcomes of the refining
  table.
* Scoring then leaves the model as it is, so a text's score does not depend on
  the order or place of its scoring. Costs are worked out once for each
  different word or word boundary that a task meets.

The base score (add-one smoothed unigrams) needs each word's count: words that
make up at least ``1 / FREQUENT`` of all tokens, so ``FREQUENT`` at most, are
broadcast, all others join the word counts (by 64-bit keys).

Defined results: a null text is the empty text, one end token; without
training texts all counts are 0 and every bit costs one bit; null ids hash
like the empty text; repeated rows are scored alike (and count as training
texts each); an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, batches, col, forget, free_name, id_hash_mod, materialize, others, utf8, worker_state

FREQUENT = 1_000_000
ROUNDS = 8                      # passes over the training texts to learn the gate, at most
SETTLED = 0.001                 # the passes end when the cost falls by less than this share
TABLE_BITS = (16, 18, 19, 20)   # counters of the predictors: 1, 2, 3 bytes, word so far
PART_BITS = 16                  # tables travel in parts of this size
FAN_IN = 32                     # tables added up in one node of the tree
TEXTS_AT_ONCE = 512
COUNTED_AT_ONCE = 2048
WORDS_AT_ONCE = 1 << 15
CACHE_WORDS = 180_000
AT_ONCE = 1 << 15               # symbols whose bits are predicted at a time
MIXED_AT_ONCE = 1 << 16         # symbols that the gate learns from at a time

N = len(TABLE_BITS)
END = 0xFF                      # no byte of UTF-8 text
HEAD = 3                        # symbols of a word that see the bytes before it
_END = bytes([END])
_START = _END * 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIOR = 0.4                    # added to both counts of a counter
_CLIP = 12.0
_PAIRS = [(i, j) for i in range(N) for j in range(i, N)]
_UPPER = np.triu_indices(N)     # the same, as an index
_SLOPES = 1 + N + len(_PAIRS)
_BUCKETS = 25                   # of the mixed logit in the refining table; odd, so that 0 is a centre


class Symbols:
    """Coded symbols with their contexts: the three bytes before (the last one
    lowest), a hash of the word so far, and the symbol."""

    def __init__(self, before: np.ndarray, word: np.ndarray, symbol: np.ndarray):
        self.before, self.word, self.symbol = before, word, symbol
        self._hashed: tuple[np.ndarray, ...] | None = None

    def __len__(self) -> int:
        return len(self.symbol)

    def pick(self, at) -> Symbols:
        return Symbols(self.before[at], self.word[at], self.symbol[at])

    def code(self) -> np.ndarray:
        """Equal for equal symbols under equal contexts."""
        return ((self.word + self.symbol + np.uint64(1)) * _MIX + self.before) * _MIX

    def slots(self, known: np.ndarray) -> list[np.ndarray]:
        """Each predictor's table slot, given the known bits (a leading 1 first)."""
        if self._hashed is None:
            self._hashed = ((self.before & np.uint64(0xFF)) << np.uint64(8), (self.before & np.uint64(0xFFFF)) * _MIX,
                            (self.before | np.uint64(1 << 32)) * _MIX, self.word * _MIX)
        k = known.astype(np.uint64)
        out = [(self._hashed[0] | k).view(np.int64)]
        for c, bits in zip(self._hashed[1:], TABLE_BITS[1:], strict=True):
            h = (c + k) * _MIX
            h ^= h >> np.uint64(31)
            h *= _MIX
            h >>= np.uint64(64 - bits)
            out.append(h.view(np.int64))
        return out


def bytes_of(values: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls (``to_pylist`` goes value by value)."""
    if not len(values):
        return []
    values = values.cast(pa.binary())       # offsets of 32 bits
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1]
    at = (ends - ends[0]).tolist()
    raw = data[int(ends[0]):int(ends[-1])].to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]      # noqa: B905 - neighbours


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word boundary of the texts, the code of the three bytes before
    and of up to ``HEAD`` symbols after it; the number of the text; and the
    word that begins there, with the blank or end symbol that ends it."""
    data = b"".join(t + _END for t in texts)
    buf = np.frombuffer(data + b"\0" * HEAD, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = buf[:-HEAD] == 32
    last[ends - 1] = True
    begins = np.flatnonzero(last) + 1
    begins = np.concatenate(([0], begins[:-1]))
    owner = np.searchsorted(ends, begins, side="right")
    inside = begins - np.concatenate(([0], ends[:-1]))[owner]
    code = np.zeros(len(begins), np.uint64)
    for j in range(3):
        code |= np.where(inside >= 3 - j, buf[begins - 3 + j], END).astype(np.uint64) << np.uint64(8 * (2 - j))
    going, length = np.ones(len(begins), bool), np.zeros(len(begins), np.uint64)
    for j in range(HEAD):
        s = buf[begins + j]
        code |= np.where(going, s, 0).astype(np.uint64) << np.uint64(24 + 8 * j)
        length += going
        going &= (s != 32) & (s != END)
    offsets = np.append(begins, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return code | length << np.uint64(24 + 8 * HEAD), owner, words


def heads_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the texts' word boundaries, and the numbers of the texts."""
    return cut(texts)[:2]


def head_symbols(codes: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """The symbols of head codes, and which code each belongs to."""
    before, word = codes & np.uint64(0xFFFFFF), np.zeros(len(codes), np.uint64)
    length = codes >> np.uint64(24 + 8 * HEAD)
    parts, owners = [], []
    for j in range(HEAD):
        symbol = codes >> np.uint64(24 + 8 * j) & np.uint64(0xFF)
        on = np.flatnonzero(length > j)
        parts.append((before[on], word[on], symbol[on]))
        owners.append(on)
        before = (before << np.uint64(8) | symbol) & np.uint64(0xFFFFFF)
        word = (word + symbol + np.uint64(1)) * _MIX
    return Symbols(*map(np.concatenate, zip(*parts, strict=True))), np.concatenate(owners)


def tail_nodes(words: list[bytes]) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """The symbols after the head of words that have their ending symbol. Words
    that begin alike and follow each other share them: of each word's symbols,
    the word and the place of the shared one. Contexts lie within the word."""
    buf = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    hashes, live = np.zeros(len(words), np.uint64), np.arange(len(words))
    new = np.zeros(len(words), bool)        # begins unlike the word before it
    parts, owners, places, n = [], [], [], 0
    for j in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > j]
        at = starts[live] + j
        symbol = buf[at]
        differs = np.ones(len(live), bool)
        differs[1:] = (symbol[1:] != symbol[:-1]) | (live[1:] != live[:-1] + 1)
        new[live] |= differs
        if j >= HEAD:
            first = new[live]
            one, at = live[first], at[first]
            before = [buf[at - k].astype(np.uint64) << np.uint64(8 * k - 8) for k in (1, 2, 3)]
            parts.append((before[0] | before[1] | before[2], hashes[one], symbol[first].astype(np.uint64)))
            owners.append(live)
            places.append(n - 1 + np.cumsum(first))
            n += len(one)
        hashes[live] = (hashes[live] + symbol + np.uint64(1)) * _MIX
    if not parts:
        none, nowhere = np.empty(0, np.uint64), np.empty(0, np.int64)
        return Symbols(none, none, none), nowhere, nowhere
    return Symbols(*map(np.concatenate, zip(*parts, strict=True))), np.concatenate(owners), np.concatenate(places)


def tail_symbols(words: list[bytes]) -> tuple[Symbols, np.ndarray]:
    """The symbols after the head of words (with the one that ends them), and
    which word each belongs to."""
    symbols, of, place = tail_nodes(_ended(words))
    return symbols.pick(place), of


def words_of(text: bytes) -> list[bytes]:
    """The text cut at blanks. The blank belongs to the word before it; the
    last word, which the end symbol ends, is marked with that symbol."""
    out = text.split(b" ")
    out[-1] += _END
    return out


def _ended(words: list[bytes]) -> list[bytes]:
    return [w if w[-1:] == _END else w + b" " for w in words]


def _equal(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal codes together, and where each new one begins."""
    order = np.argsort(code)
    code = code[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))


class Counts:
    """Bit counters of all predictors: zeros and ones seen under each slot."""

    def __init__(self):
        self.seen = [np.zeros((2, 1 << b), np.int64) for b in TABLE_BITS]

    def add(self, symbols: Symbols, times: np.ndarray) -> None:
        """Count symbols ``times`` times; equal contexts are added up first."""
        # predictors that see three bytes at most
        code = symbols.before << np.uint64(8) | symbols.symbol
        order, cut = _equal(code)
        if len(cut):
            self._bits(symbols.pick(order[cut]), np.add.reduceat(times[order], cut), range(N - 1))
        code = (symbols.word + symbols.symbol + np.uint64(1)) * _MIX
        order, cut = _equal(code)
        if len(cut):
            self._bits(symbols.pick(order[cut]), np.add.reduceat(times[order], cut), range(N - 1, N))

    def _bits(self, symbols: Symbols, times: np.ndarray, predictors) -> None:
        for known, bit in bits_of(symbols.symbol):
            slots = symbols.slots(known)
            for k in predictors:
                np.add.at(self.seen[k].reshape(-1), slots[k] + (bit << TABLE_BITS[k]), times)


def bits_of(symbol: np.ndarray):
    """The known bits (a leading 1 first) and the next bit, for all eight bits."""
    s = symbol.astype(np.int64)
    for b in range(8):
        yield (1 << b) | s >> (8 - b), s >> (7 - b) & 1


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def merged(symbols: Symbols, times: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Equal symbols under equal contexts once, with the sum of their times."""
    order, first = _equal(symbols.code())
    return (symbols.pick(order[first]), np.add.reduceat(times[order], first)) if len(first) else (symbols, times)


def logits_left(counts: list[np.ndarray]) -> list[np.ndarray]:
    """Each counter's logit without one zero, and without one one."""
    out = []
    for zeros, ones in counts:
        fewer = [np.maximum(n - 1, 0) + _PRIOR for n in (zeros, ones)]
        out.append(np.log(np.concatenate(((ones + _PRIOR) / fewer[0], fewer[1] / (zeros + _PRIOR)))))
    return out


class Mixer:
    """Gate weights by known bits, and the refining table by last byte."""

    def __init__(self):
        self.weights = np.full((256, N), 0.3)
        centres = squash((np.arange(_BUCKETS) + 0.5) / _BUCKETS * 2 * _CLIP - _CLIP)
        self.refine = np.stack([(1 - centres) * 4, centres * 4])[:, None, :].repeat(256, axis=1)

    @staticmethod
    def bucket(logit: np.ndarray) -> np.ndarray:
        return np.clip(((logit + _CLIP) * (_BUCKETS / (2 * _CLIP))).astype(np.int64), 0, _BUCKETS - 1)

    def _each(self, symbols: Symbols, left: list[np.ndarray]):
        """Of all eight bits: known bits, bit, the predictors' logits from the
        counts without this occurrence, and the mixed logit."""
        for known, bit in bits_of(symbols.symbol):
            x = np.empty((N, len(symbols)))
            logit = np.zeros(len(symbols))
            for k, (table, slot) in enumerate(zip(left, symbols.slots(known), strict=True)):
                np.take(table, slot + (bit << TABLE_BITS[k]), out=x[k], mode="clip")
                logit += self.weights[:, k].take(known) * x[k]
            yield known, bit, x, np.clip(logit, -_CLIP, _CLIP, out=logit)

    def slopes(self, symbols: Symbols, times: np.ndarray, left: list[np.ndarray]) -> np.ndarray:
        """Sums by known bits over symbols that occur ``times`` times: the cost
        in nats, its gradient, and the upper half of its second derivatives."""
        out = np.zeros((_SLOPES, 256))
        order = np.argsort(symbols.symbol.astype(np.uint8), kind="stable")  # so are the known bits, then
        symbols, times = symbols.pick(order), times[order].astype(float)
        for known, bit, x, logit in self._each(symbols, left):
            odds = np.exp(np.where(bit == 1, -logit, logit))        # of the other bit
            wrong = odds / (1 + odds)
            bend = times * wrong
            rows = np.empty((1 + N, len(symbols)))
            np.multiply(bend, 1 - 2 * bit, out=rows[0])
            bend *= 1 - wrong
            np.multiply(x, bend, out=rows[1:])
            first = np.flatnonzero(np.diff(known, prepend=0))
            at = known[first]
            out[0, at] = np.add.reduceat(times * np.log1p(odds), first)
            for k, i, j in zip(at, first, [*first[1:], len(known)], strict=True):
                sums = rows[:, i:j] @ x[:, i:j].T
                out[1:1 + N, k] = sums[0]
                out[1 + N:, k] = sums[1:][_UPPER]
        return out

    def outcomes(self, symbols: Symbols, times: np.ndarray, left: list[np.ndarray]) -> np.ndarray:
        """How often each bit followed, by bit, last byte and bucket."""
        out = np.zeros(self.refine.size)
        last = (symbols.before & np.uint64(0xFF)).astype(np.int64)
        for _, bit, _, logit in self._each(symbols, left):
            out += np.bincount((bit * 256 + last) * _BUCKETS + self.bucket(logit), times, len(out))
        return out.reshape(self.refine.shape)

    def fit(self, gather) -> None:
        """Learn from all symbols. ``gather`` sums what this mixer's method of
        that name gives for them. Each value of the known bits has weights of
        its own: a Newton step, or half the way back where the last one did
        not lower the cost. Weights are rounded, so that they do not depend on
        the order of the sums."""
        kept, lowest, step = self.weights, np.full(256, np.inf), np.zeros((256, N))
        for _ in range(ROUNDS):
            sums, before = gather("slopes"), lowest.sum()
            better = sums[0] <= lowest + 1e-9 * np.abs(sums[0])
            kept, lowest = np.where(better[:, None], self.weights, kept), np.where(better, sums[0], lowest)
            if lowest.sum() >= before * (1 - SETTLED):
                break
            second = np.zeros((256, N, N))
            for (i, j), row in zip(_PAIRS, sums[1 + N:], strict=True):
                second[:, i, j] = second[:, j, i] = row
            # a slight pull to the first weights, for known bits that hardly occur
            pull = sums[1:1 + N].T + (self.weights - 0.3)
            newton = -np.linalg.solve(second + np.eye(N), pull[:, :, None])[:, :, 0]
            step = np.where(better[:, None], newton, step / 2)
            self.weights = np.round(kept + step, 6)
        self.weights = kept
        self.refine = self.refine + gather("outcomes")

    def learn(self, symbols: Symbols, counts: list[np.ndarray], at_once: int = 1 << 14) -> None:
        """Learn from symbols at hand."""
        left = logits_left(counts)

        def gather(what):
            return sum(getattr(self, what)(part, np.ones(len(part)), left)
                       for part in (symbols.pick(slice(i, i + at_once)) for i in range(0, len(symbols), at_once)))
        self.fit(gather)


class Model:
    """Everything that scoring needs; of fixed size."""

    def __init__(self, logits: list[np.ndarray], mixer: Mixer):
        self.logits, self.weights = logits, mixer.weights.T.astype(np.float32).copy()
        # share of zeros and of ones observed, by bit, last byte and bucket
        self.refined = (mixer.refine / mixer.refine.sum(axis=0)).astype(np.float32).ravel()

    @staticmethod
    def of(counts: list[np.ndarray], mixer: Mixer) -> Model:
        return Model([stretch((t[1] + _PRIOR) / (t.sum(axis=0) + 2 * _PRIOR)).astype(np.float32) for t in counts], mixer)

    def bits(self, symbols: Symbols) -> np.ndarray:
        """Bits that each symbol costs. Equal contexts are worked out once."""
        order, first = _equal(symbols.code())
        out = np.empty(len(order))
        out[order] = np.repeat(self.each(symbols.pick(order[first])), np.diff(np.append(first, len(order))))
        return out

    def each(self, symbols: Symbols) -> np.ndarray:
        """Bits that each symbol costs, worked out one by one."""
        return np.concatenate([np.empty(0), *(self._bits(symbols.pick(slice(i, i + AT_ONCE))) for i in range(0, len(symbols), AT_ONCE))])

    def _bits(self, symbols: Symbols) -> np.ndarray:
        likely = np.ones(len(symbols))      # product of twice each bit's probability
        last = (symbols.before & np.uint64(0xFF)).astype(np.int64) * _BUCKETS
        for known, bit in bits_of(symbols.symbol):
            logit = np.zeros(len(symbols), np.float32)
            for w, table, slot in zip(self.weights, self.logits, symbols.slots(known), strict=True):
                logit += w.take(known) * table.take(slot)
            np.clip(logit, -_CLIP, _CLIP, out=logit)
            # half the mixed probability, half what was observed at such a logit
            seen = self.refined[bit * (256 * _BUCKETS) + last + Mixer.bucket(logit)]
            likely *= squash(np.where(bit == 1, logit, -logit)) + seen
        return 8 - np.log2(likely)


class Scorer:
    """Bits of whole texts, and their unigram logs. Everything about a word is
    worked out once and kept in one row; a text is then a list of rows.
    ``known``: log10(count + 1) of the frequent words."""

    def __init__(self, model: Model, known: dict[bytes, float]):
        self.model, self.known = model, known
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.tail = np.empty(0)                     # bits after the head
        self.logs = np.empty(0)                     # of its frequent words
        self.tokens = np.empty((2, 0), np.int64)    # all its words, the frequent ones
        self.keys = np.empty(0, np.int64)           # of the other words, row by row
        self.first = np.empty(0, np.int64)          # place of a row's first key

    def _learn(self, new: list[bytes]) -> None:
        new.sort()                                  # words that begin alike share their symbols
        symbols, of, place = tail_nodes(new)
        words = [w[:-1] for w in new]
        logs = list(map(self.known.get, words))
        tokens = np.ones((2, len(new)), np.int64)
        tokens[1] = rare = np.array([x is None for x in logs], np.int64)
        odd = {i: words[i].rstrip(_END).split() for i in _odd(words)}
        for i, own in odd.items():
            seen = [x for x in map(self.known.get, own) if x is not None]
            logs[i], tokens[0, i], rare[i] = sum(seen), len(own), len(own) - len(seen)
        tokens[1] = tokens[0] - rare
        others = [w for i in np.flatnonzero(rare).tolist()
                  for w in ([x for x in odd[i] if x not in self.known] if i in odd else [words[i]])]
        self.rows.update(zip(new, range(len(self.tail), len(self.tail) + len(new)), strict=True))
        self.tail = np.append(self.tail, np.bincount(of, self.model.each(symbols)[place], len(new)))
        self.logs = np.append(self.logs, [x or 0.0 for x in logs])
        self.tokens = np.append(self.tokens, tokens, axis=1)
        self.first = np.append(self.first, len(self.keys) + np.cumsum(rare) - rare)
        self.keys = np.append(self.keys, word_keys(others))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """Of each text: its bits, the logs of its frequent words, the numbers
        of all and of frequent words, and the keys of its other words."""
        codes, owner, words = cut(texts)
        order, first = _equal(codes)
        symbols, of = head_symbols(codes[order[first]])
        cost = np.bincount(of, self.model.bits(symbols), len(first))
        head = np.empty(len(codes))
        head[order] = np.repeat(cost, np.diff(np.append(first, len(order))))
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        found = words.dictionary_encode()
        different = bytes_of(found.dictionary)
        new = [w for w in different if w not in self.rows]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.rows.__getitem__, different), np.int64, len(different))[found.indices.to_numpy()]
        n = len(texts)
        bits = np.bincount(owner, head + self.tail[rows], n)
        logs = np.bincount(owner, self.logs[rows], n)
        tokens = np.stack([np.bincount(owner, t[rows], n) for t in self.tokens]).astype(np.int64)
        odd = rows[self.tokens[0][rows] > self.tokens[1][rows]]
        times = self.tokens[0][odd] - self.tokens[1][odd]
        ends = np.cumsum(times)
        flat = self.keys[np.arange(times.sum()) + np.repeat(self.first[odd] - ends + times, times)].tolist()
        ends = np.cumsum(tokens[0] - tokens[1]).tolist()
        return bits, logs, tokens, [flat[a:b] for a, b in zip([0, *ends], ends)]    # noqa: B905 - neighbours


def word_keys(words: list[bytes]) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for the words: rare words travel and join
    as 64-bit keys."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)


def _odd(words: list[bytes]) -> list[int]:
    """Places of words that are no token as they stand: empty, with a blank
    other than the space, or with the end mark."""
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    odd = np.flatnonzero(((buf >= 9) & (buf <= 13)) | (buf == END))
    return sorted({*np.searchsorted(ends, odd, side="right").tolist(), *(i for i, w in enumerate(words) if not w)})


def _slices(rows, at_once: int):
    return (batch.slice(k, at_once) for batch in rows for k in range(0, len(batch), at_once))


def _count(train: DataFrame) -> DataFrame:
    """One pass over the training texts: their words as they are cut, and the
    codes of their word boundaries, with their numbers in a part of the texts."""
    schema = pa.schema([("word", pa.binary()), ("code", pa.int64()), ("n", pa.int64())])

    def run(rows):
        forget("lm")        # a scorer that this worker may still hold
        for batch in _slices(rows, COUNTED_AT_ONCE):
            codes, _, words = cut([t.lower() for t in bytes_of(batch.column(0))])
            heads, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(heads), pa.binary()), pa.array(heads.view(np.int64)),
                                              pa.array(n, pa.int64())], schema=schema)
            found = words.dictionary_encode()
            n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
            different = [w.removesuffix(b" ") for w in bytes_of(found.dictionary)]
            yield pa.RecordBatch.from_arrays([pa.array(different, pa.binary()), pa.nulls(len(different), pa.int64()),
                                              pa.array(n, pa.int64())], schema=schema)

    return train.mapInArrow(run, "word binary, code long, n long")


def _tokens(items: DataFrame) -> DataFrame:
    """The tokens of the words as they are cut: without end marks, cut at other
    blanks; the end token is the one word with a byte that no text has."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def make(batch):
        words, n = bytes_of(batch.column(0)), batch.column(1).to_pylist()
        odd = _odd(words)
        out = [(x, n[i]) for i in odd for x in (*words[i].rstrip(_END).split(), *([_END] if words[i].endswith(_END) else []))]
        for i in reversed(odd):
            del words[i], n[i]
        return {"word": words + [x for x, _ in out], "n": n + [m for _, m in out]}

    return items.where("word IS NOT NULL").select("word", "n").mapInArrow(
        lambda rows: batches(_slices(rows, WORDS_AT_ONCE), make, schema), "word binary, n long")


def _symbols(rows):
    """The symbols of words and word boundaries, and how often each occurs:
    equal ones that follow each other, as in sorted words, once."""
    for batch in _gathered(rows, WORDS_AT_ONCE):
        words, codes, n = batch.column("word"), batch.column("code"), batch.column("n").to_numpy()
        at_word = words.is_valid().to_numpy(zero_copy_only=False)
        symbols, of = head_symbols(codes.filter(words.is_null()).to_numpy().view(np.uint64))
        yield merged(symbols, n[~at_word][of])
        symbols, of, place = tail_nodes(_ended(bytes_of(words.drop_null())))
        times = np.zeros(len(symbols), np.int64)
        np.add.at(times, place, n[at_word][of])
        yield symbols, times


def _gathered(rows, at_least: int):
    """Batches put together until they have enough rows."""
    held, n = [], 0
    for batch in rows:
        held.append(batch)
        n += len(batch)
        if n >= at_least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tables(items: DataFrame) -> DataFrame:
    """Each task's counter tables in parts."""
    def run(rows):
        counts, some = Counts(), False
        for symbols, times in _symbols(rows):
            counts.add(symbols, times)
            some = True
        if some:
            task, data = TaskContext.get().partitionId(), _parts(counts.seen)
            for part, d in enumerate(data):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "task": [task], "data": [d]})

    return items.select("word", "code", "n").mapInArrow(run, "part int, task long, data binary")


def _parts(tables: list[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(t[:, k:k + (1 << PART_BITS)]).astype("<i8").tobytes()
            for t in tables for k in range(0, t.shape[1], 1 << PART_BITS)]


def _whole(parts: dict[int, bytes]) -> list[np.ndarray]:
    tables, at = [], 0
    for bits in TABLE_BITS:
        n = 1 << max(0, bits - PART_BITS)
        blank = np.zeros((2, 1 << PART_BITS), "<i8").tobytes()
        tables.append(np.concatenate([np.frombuffer(parts.get(at + k, blank), "<i8").reshape(2, -1) for k in range(n)], axis=1))
        at += n
    return tables


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(group["data"].iloc[0], "<i8").copy()
    for d in group["data"].iloc[1:]:
        total += np.frombuffer(d, "<i8")
    return pd.DataFrame({"part": group["part"].iloc[:1], "task": group["task"].iloc[:1], "data": [total.tobytes()]})


def _sum_tables(tables: DataFrame) -> list[np.ndarray]:
    """Add up the tasks' tables, ``FAN_IN`` at a time."""
    last = tables.agg(F.max("task")).first()[0]
    while last:
        tables = tables.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("part", "task").applyInPandas(
            _add, "part int, task long, data binary")
        last //= FAN_IN
        if last:
            tables = materialize(tables, "lm-tables")
    return _whole({r["part"]: bytes(r["data"]) for r in tables.select("part", "data").collect()})


def _learn_mixer(items: DataFrame, counts: list[np.ndarray]) -> Mixer:
    """Learn the gate and the refining table over all training texts."""
    mixer, shared = Mixer(), items.sparkSession.sparkContext.broadcast(logits_left(counts))

    def gather(what):
        held = mixer.weights

        def run(rows):
            mixer, total = Mixer(), 0
            mixer.weights = held
            for symbols, times in _symbols(rows):
                for i in range(0, len(symbols), MIXED_AT_ONCE):
                    part = slice(i, i + MIXED_AT_ONCE)
                    total = total + getattr(mixer, what)(symbols.pick(part), times[part], shared.value)
            found = np.ravel(total)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "sum": found[at].astype(float)})

        sums = items.select("word", "code", "n").mapInArrow(run, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum"))
        total = np.zeros((_SLOPES, 256) if what == "slopes" else mixer.refine.shape)
        for r in sums.collect():
            total.reshape(-1)[r["at"]] = r["sum"]
        return total

    mixer.fit(gather)
    shared.destroy()
    return mixer


def held_out(id_col: str = "doc_id") -> Column:
    """Texts that the model does not learn from: crc32 of the id as text, mod 7, is 2."""
    return id_hash_mod(id_col, 7) == 2


def lm_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None,
             train_on: Column | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Learn from the rows of ``train_on`` (those not held out by default),
    score all rows: the input columns (or ``keep``) and ``held_out, n_tokens,
    n_known, train_tokens, base_score, score, bits_per_byte``."""
    spark = docs.sparkSession
    chosen = ~held_out(id_col) if train_on is None else train_on
    counted = _count(docs.where(chosen).select(utf8(text_col)))
    # sorted, so that words that begin alike share the work on their symbols
    items = materialize(counted.groupBy("word", "code").agg(F.sum("n").alias("n")).sort("word", "code"), "lm-items")
    words = materialize(_tokens(items).groupBy("word").agg(F.sum("n").alias("n"))
                        .withColumn("key", F.xxhash64("word")), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = words.where(F.col("word") == F.lit(_END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most ``frequent`` words can make up so large a share each
    often = words.where(F.col("n") * frequent >= total)
    known = {bytes(r["word"]): math.log10(r["n"] + 1) for r in often.collect()}
    counts = _sum_tables(materialize(_tables(items), "lm-tables"))
    mixer = _learn_mixer(items, counts)
    model = Model.of(counts, mixer)
    shared = spark.sparkContext.broadcast((known, model.logits, mixer.weights, mixer.refine))
    version = uuid.uuid4().hex
    end_log, denominator = math.log10(end + 1), math.log10(total + distinct + 1)

    own = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kept = others(docs, own, keep)
    rare, row = free_name([*kept, *own], "rare"), free_name([*kept, *own], "row")

    def make(texts):
        known, logits, weights, refine = shared.value
        mixer = Mixer()
        mixer.weights, mixer.refine = weights, refine
        scorer = worker_state(("lm", version), lambda: Scorer(Model(logits, mixer), known), only="lm")
        texts = [t.lower() for t in bytes_of(texts)]
        bits, logs, (all_, frequent_), rest = scorer.score(texts)
        return {"n_tokens": all_ + 1, "n_known": frequent_ + (end > 0), "score": -bits * math.log10(2),
                "base_score": logs + end_log - (all_ + 1) * denominator,
                "bits_per_byte": bits / np.maximum(1, [len(t) for t in texts]), rare: rest}

    scored = arrow_columns(docs.withColumn("held_out", held_out(id_col)), [utf8(text_col)], make,
                           "n_tokens long, n_known long, base_score double, score double, bits_per_byte double, "
                           f"{rare} array<long>", [*kept, "held_out"], TEXTS_AT_ONCE)
    scored = materialize(scored.withColumn(row, F.monotonically_increasing_id()), "lm-scored")
    more = (scored.select(F.col(row).alias("_row"), F.explode(rare).alias("_word"))
            .join(words.select("key", "n"), F.col("_word") == F.col("key"))
            .groupBy("_row").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 1)).alias("_logs")))
    return (scored.join(more, scored[row] == more["_row"], "left")
            .select(*[col(c) for c in kept], "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("base_score") + F.coalesce("_logs", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte"))
