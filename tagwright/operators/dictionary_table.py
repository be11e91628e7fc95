"""Dictionaries as tables: flags, counts and spans of any number of terms.

A lexicon of a few terms is one regular expression; a table of terms is joined
instead. A term can only match a text that has all of the term's word tokens
(the last one, of a term that may start a longer word, as the beginning of a
token). So each term waits under the one of its tokens that the fewest terms
share, its anchor; texts send out their different tokens that some term waits
for (a bitmap of fixed size tells, whose false hits only cost work), and the
join gives each text its few candidate terms.

A candidate is then tried where its first token stands, with the very pattern
that a lexicon would use for it, and of all matches those are kept that a
left-to-right scan of the whole lexicon keeps: leftmost first, the shorter term
at one place, none inside another. So flags, counts and spans equal those of a
lexicon of the same escaped terms, whatever characters they hold.

In Spark, a dictionary of up to ``AT_HAND`` characters in all goes to every
task, as a small side of a join does, and the texts are matched where they are
read: one pass, no shuffle. A text's token is looked up once for each of its
spellings; a term of several tokens is tried only where its first two stand.
Larger dictionaries are never collected: one pass over the texts for their
tokens, one shuffle of hits (never of all tokens), one join of the texts with
their candidates; only the bitmap's words are collected. No join has a hint.

Defined results: null texts have no match; empty terms match nowhere; of terms
with several rows both kinds count; rows that are equal in key and text get
equal results; without terms nothing is found.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.patterns import Lexicon
from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

AT_HAND = 16_000_000    # characters of the terms of a dictionary that every task gets
SPELLINGS = 200_000     # different tokens of texts that a task keeps the matches of
BITS = 24               # of the bitmap of anchors: 2 MB
ROWS_AT_ONCE = 256
WORD = re.compile(r"\w+")
SPANS = "array<struct<term:string,start:int,end:int>>"


def fold(token: str) -> str:
    """Tokens that match ignoring case have one form (others may share it)."""
    return token.replace("İ", "i").replace("ı", "i").casefold()


def term_pattern(term: str, part: bool) -> re.Pattern:
    return re.compile(Lexicon((term,), (part,), escape=True).body(), re.IGNORECASE)


def term_tokens(term: str, part: bool) -> tuple[list[str], int | None, bool]:
    """A term's tokens, the first one's offset or None, and whether the last one
    may be the beginning of a longer token."""
    single = len(term.split()) == 1
    tokens = [(m.start(), m.end(), fold(m.group())) for m in WORD.finditer(term)]
    opens = bool(tokens) and part and single and tokens[-1][1] == len(term)     # the last token may go on
    # a first token behind a blank stands at no fixed place
    offset = tokens[0][0] if tokens and " " not in term[:tokens[0][0]] else None
    return [t for *_, t in tokens], offset, opens


class Dictionary:
    """Terms (``(term, part)``), and the spans that a left-to-right scan for all
    of them keeps."""

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.anywhere: list[tuple[str, bool]] = []      # terms whose first token stands at no fixed place
        self.words: dict[str, list] = {}                # terms that are one token
        self.starts: dict[str, list] = {}               # those that may go on
        self.whole: dict[str, list] = {}                # other terms by the first token, if it must be whole
        self.begins: dict[str, list] = {}
        self.patterns: dict[tuple[str, bool], re.Pattern] = {}      # made when they are first tried
        self.seen: dict[str, tuple] = {}                # matches of a token's spelling
        for term, part in terms:
            tokens, offset, opens = term_tokens(term, part)
            if offset is None:
                self.anywhere.append((term, part))
            elif WORD.fullmatch(term):
                (self.starts if opens else self.words).setdefault(tokens[0], []).append((term, part))
            else:
                # the next token, where it must be whole
                second = tokens[1] if len(tokens) > 2 or (len(tokens) == 2 and not opens) else None
                (self.begins if opens and len(tokens) == 1 else self.whole).setdefault(tokens[0], []).append((offset, term, part, second))
        self.ways = {k[:n] for d in (self.starts, self.begins) for k in d for n in range(1, len(k) + 1)}
        # with terms as long as their folded forms, a longer beginning is a longer term
        self.even = all(len(term) == len(k) for k, same in self.starts.items() for term, _ in same)

    def pattern(self, term: str, part: bool) -> re.Pattern:
        found = self.patterns.get((term, part))
        if found is None:
            found = self.patterns[term, part] = term_pattern(term, part)
        return found

    def _of(self, token: str) -> tuple:
        """What a token's spelling decides: the match that is kept of the terms
        that are one token, as (length of the term, of the match); other terms
        to try; others to try by the next token."""
        key, own = fold(token), None
        alone, tries = [*self.words.get(key, ())], [*self.whole.get(key, ())]
        for n in range(1, len(key) + 1):
            start = key[:n]
            if start not in self.ways:
                break
            tries += self.begins.get(start, ())
            if own is None or not self.even:
                own = self._shortest(token, self.starts.get(start, ()), own)
        own = self._shortest(token, alone, own)
        others, by_next = [], {}
        for offset, term, part, second in tries:
            if second is not None:
                by_next.setdefault(second, []).append((offset, term, part))
            else:
                others.append((offset, term, part))
        if len(self.seen) >= SPELLINGS:
            self.seen.clear()
        self.seen[token] = found = (own, others, by_next) if own or others or by_next else ()
        return found

    def _shortest(self, token: str, terms, own: tuple | None) -> tuple | None:
        for term, part in terms:
            m = self.pattern(term, part).match(token) if own is None or len(term) <= own[0] else None
            if m is not None and (own is None or (len(term), m.end()) < own):
                own = (len(term), m.end())
        return own

    def spans(self, text: str, any_one: bool = False) -> list[tuple[str, int, int]]:
        """The spans that are kept; with ``any_one``, some span if there is one."""
        found, waiting = [], None
        for term, part in self.anywhere:
            at, pattern = 0, self.pattern(term, part)
            while (m := pattern.search(text, at)) is not None:
                found.append((m.start(), len(term), m.end()))
                at = m.start() + 1
        if self.words or self.starts or self.whole or self.begins:
            seen = self.seen
            for token in WORD.finditer(text):
                spelling = token.group()
                if waiting:
                    s, by_next = waiting
                    self._try(text, s, by_next.get(fold(spelling), ()), found)
                    waiting = None
                about = seen.get(spelling)
                if about is None:
                    about = self._of(spelling)
                if about:
                    own, others, by_next = about
                    s = token.start()
                    if own:
                        found.append((s, own[0], s + own[1]))
                    if others:
                        self._try(text, s, others, found)
                    if by_next:
                        waiting = (s, by_next)
                if any_one and found:
                    break
        out, free = [], 0
        for start, _, end in sorted(found):
            if start >= free:
                out.append((text[start:end], start, end))
                free = end
        return out

    def _try(self, text: str, s: int, tries, found: list) -> None:
        for offset, term, part in tries:
            if offset <= s and (m := self.pattern(term, part).match(text, s - offset)) is not None:
                found.append((s - offset, len(term), m.end()))


def term_spans(text: str, candidates: list[tuple[str, bool]]) -> list[tuple[str, int, int]]:
    """The spans that a left-to-right scan for all candidates keeps."""
    return Dictionary(candidates).spans(text)


def _slot(unit: str) -> int:
    return crc32(unit.encode()) & ((1 << BITS) - 1)


def _anchors(terms: DataFrame) -> DataFrame:
    """``unit, term, part``: each term under the token that fewest terms share.
    Units are whole tokens (``w``), beginnings (``b``), or nothing, for terms
    without a token."""
    schema = to_arrow_schema(T.StructType.fromDDL("unit string, term string, part boolean"))

    def units(it):
        for batch in it:
            rows = []
            for term, part in zip(batch["term"].to_pylist(), batch["part"].to_pylist(), strict=True):
                tokens, _, opens = term_tokens(term, part)
                whole = tokens[:-1] if opens else tokens
                rows += [(u, term, part) for u in {"w" + t for t in whole} or {"b" + tokens[0] if opens else ""}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = terms.mapInArrow(units, "unit string, term string, part boolean")
    shared = rows.groupBy("unit").agg(F.count("*").alias("n"))
    least = rows.join(shared, "unit").groupBy("term", "part").agg(F.min(F.struct("n", "unit")).alias("least"))
    return least.select("least.unit", "term", "part")


def large_dictionary_spans(df: DataFrame, key: str, text: str, terms: DataFrame, at_hand: int = AT_HAND,
                           any_one: bool = False) -> DataFrame:
    """``key, n_matches, spans`` of every row of ``df`` for a table of terms
    (``term`` and, optionally, a boolean ``part``). ``any_one``: a text may be
    left at its first match, as a flag needs no more."""
    part = F.coalesce(F.col("part"), F.lit(False)) if "part" in terms.columns else F.lit(False)
    wanted = terms.select(F.trim("term").alias("term"), part.alias("part")).where("term <> ''").distinct()
    out = T.StructType([df.schema[key], *T.StructType.fromDDL(f"n_matches long, spans {SPANS}").fields])
    arrow = to_arrow_schema(out)

    def answer(keys, spans: list[list[tuple]]) -> pa.RecordBatch:
        flat = [s for row in spans for s in row]
        ends = np.cumsum([0] + [len(row) for row in spans])
        columns = list(zip(*flat, strict=True)) or [(), (), ()]
        kind = arrow.field("spans").type
        structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs).cast(kind)
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(ends), pa.int64()), lists], schema=arrow)

    # a character more for each term: there are not many short ones either
    wanted = materialize(wanted, "terms")
    if (wanted.agg(F.sum(F.length("term") + 1)).first()[0] or 0) <= at_hand:
        rows = wanted.toArrow()
        pairs = df.sparkSession.sparkContext.broadcast(list(zip(*(rows[c].to_pylist() for c in ("term", "part")), strict=True)))

        def scan(it):
            dictionary = Dictionary(pairs.value)
            for batch in (b.slice(k, ROWS_AT_ONCE) for b in it for k in range(0, len(b), ROWS_AT_ONCE)):
                yield answer(batch["key"], [dictionary.spans(own, any_one) if own else [] for own in batch["text"].to_pylist()])

        return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, out)
    anchors = materialize(_anchors(wanted), "anchors")
    bits = np.zeros(1 << BITS - 5, np.uint32)
    # at most one row a 32-bit word of the bitmap
    words = (anchors.select(F.crc32(F.col("unit").cast("binary")).bitwiseAND(F.lit((1 << BITS) - 1)).alias("slot")).distinct()
             .groupBy(F.expr("slot div 32").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits")).toArrow())
    if not len(words):
        return df.select(key, F.lit(0).cast("long").alias("n_matches"), F.array().cast(SPANS).alias("spans"))
    bits[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    begin_lengths = [r[0] for r in anchors.where("unit LIKE 'b%'").select(F.length("unit") - 1).distinct().collect()]     # a few numbers
    tokenless = bool(bits[_slot("") >> 5] >> (_slot("") & 31) & 1)
    hit_schema = to_arrow_schema(T.StructType.fromDDL("row long, unit string"))

    def hits(it):
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in it for k in range(0, len(b), ROWS_AT_ONCE)):
            rows, units = [], []
            for row, own in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                keys = {fold(t) for t in set(WORD.findall(own))}
                tried = {"w" + k for k in keys}
                tried.update("b" + k[:n] for n in begin_lengths for k in keys if len(k) >= n)
                if tokenless:
                    tried.add("")
                hit = [u for u in tried if bits[(s := _slot(u)) >> 5] >> (s & 31) & 1]
                rows += [row] * len(hit)
                units += hit
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(units, pa.string())], schema=hit_schema)

    row = F.xxhash64(F.col(key), F.col(text))
    sent = df.where(F.col(text).isNotNull()).select(row.alias("row"), F.col(text).alias("text")).mapInArrow(hits, "row long, unit string")
    lists = (sent.distinct().join(anchors, "unit").groupBy("row").agg(F.collect_set(F.struct("term", "part")).alias("candidates")))
    def match(it):
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in it for k in range(0, len(b), ROWS_AT_ONCE)):
            spans = []
            for own, candidates in zip(batch["text"].to_pylist(), batch["candidates"].to_pylist(), strict=True):
                spans.append(term_spans(own, [(c["term"], c["part"]) for c in candidates]) if candidates and own else [])
            yield answer(batch["key"], spans)

    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"), row.alias("row"))
    return texts.join(lists, "row", "left").select("key", "text", "candidates").mapInArrow(match, out)


def large_dictionary_tag(df: DataFrame, key: str, text: str, terms: DataFrame, at_hand: int = AT_HAND) -> DataFrame:
    """``key, found``: whether any term of the table matches."""
    return large_dictionary_spans(df, key, text, terms, at_hand, any_one=True).select(key, (F.col("n_matches") > 0).alias("found"))
