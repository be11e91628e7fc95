"""Scalar text functions as native column expressions.

Each one reproduces a Python string idiom of the original scripts with
JVM-side functions only, so it stays inside whole-stage codegen. Where Java
and Python character classes differ the class is spelled out.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\s`` (and ``str.split()``) also treats U+001C..U+001F as blanks;
# Java's Unicode ``\s`` does not.
WS_CLASS = r"[\s\x{1C}-\x{1F}]"
WS_RUN = "(?U)" + WS_CLASS + "+"

# --- fixed value: ASCII punctuation without '-' and "'" (the set used by both cleaners)
PUNCTUATION = string.punctuation.replace("-", "").replace("'", "")


@lru_cache(maxsize=1)
def digit_chars() -> str:
    """Every character for which Python's ``str.isdigit`` is true: decimal
    digits of all scripts plus superscripts, subscripts, circled digits, ...
    (derived from the Unicode database on the driver, once)."""
    return "".join(chr(cp) for cp in range(sys.maxunicode + 1)
                   if chr(cp).isdigit() and not 0xD800 <= cp <= 0xDFFF)


def clean_sequence(text: Column) -> Column:
    """Lower case; punctuation -> one blank; delete digits; collapse
    blank runs to one blank (no strip). The two character mappings are
    ``translate`` calls (a hash lookup per character); only the blank runs
    need a regular expression."""
    t = F.lower(text)
    t = F.translate(t, PUNCTUATION, " " * len(PUNCTUATION))
    t = F.translate(t, digit_chars(), "")
    return F.regexp_replace(t, WS_RUN, " ")


def clean_delete_punct(text: Column) -> Column:
    """Null or "" -> ""; lower case; punctuation deleted; digits kept."""
    return F.coalesce(F.translate(F.lower(text), PUNCTUATION, ""), F.lit(""))


def whitespace_tokens(text: Column) -> Column:
    """``str.split()``: tokens between blank runs, no empty tokens."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS_RUN, -1), lambda x: x != "")


def word_count(text: Column) -> Column:
    """``len(text.split())``."""
    return F.size(whitespace_tokens(text))


def is_single_word(term: Column) -> Column:
    """``len(term.split()) == 1``."""
    return word_count(term) == 1


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Accent folding tables generated from the Unicode database: for every
    character, the ASCII part of its NFKD form. One-character results feed a
    ``translate``; longer ones (ligatures, fractions, circled numbers, unit
    squares, ...) a per-character lookup. Both are built once on the driver
    (about 1,700 and 450 entries of the Basic Multilingual Plane)."""
    src, dst, multi = [], [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if folded == ch or not folded:
            continue
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        else:
            multi.append((ch, folded))
    return "".join(src), "".join(dst), tuple(multi)


def strip_accents_ascii(text: Column) -> Column:
    """C11: NFKD then drop what is not ASCII (``strip_accents='ascii'``).

    Characters that fold to several letters are rare: one scan for their
    class decides whether the per-character lookup runs at all (``CASE
    WHEN`` evaluates lazily), so ordinary rows pay one translate and one
    regex replace."""
    src, dst, multi = _fold_tables()
    t = text
    if multi:
        keys = F.array(*[F.lit(k) for k, _ in multi])
        vals = F.array(*[F.lit(v) for _, v in multi])

        def fold_char(c):
            pos = F.array_position(keys, c)
            return F.when(pos > 0, F.element_at(vals, pos.cast("int"))).otherwise(c)
        per_char = F.array_join(F.transform(F.split(t, "", -1), fold_char), "")
        # guard: translate (a hash lookup per character) maps every such
        # character to a marker; a regex class of hundreds of scattered
        # ranges would be tested range by range
        marker = "\u0001"
        keys_str = "".join(k for k, _ in multi)
        hit = F.translate(t, keys_str, marker * len(keys_str)).contains(marker)
        t = F.when(hit, per_char).otherwise(t)
    t = F.translate(t, src, dst)
    return F.regexp_replace(t, r"[^\x00-\x7F]", "")


def argmax(arr: Column) -> Column:
    """0-based index of the largest element, first one on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def longest_units(df, text: str, by: str = "lexmax", cap: int = 512) -> int:
    """The length limit of a set of texts, ``cap`` at most: the characters
    of its longest text (``by="longest"``) or of the one that sorts last
    (``by="lexmax"``, as the original takes it). One aggregate."""
    best = {"longest": F.max(F.length(text)), "lexmax": F.length(F.max(text))}[by]
    return min(cap, df.agg(best).first()[0] or 0)


def truncate_length(df, text: str, out: str = "truncated", n_out: str = "n_units", by: str = "lexmax", cap: int = 512):
    """Each text cut to its first ``longest_units`` tokens, and their number."""
    n = longest_units(df, text, by, cap)
    toks = whitespace_tokens(F.col(text))
    return df.withColumns({n_out: F.least(F.size(toks), F.lit(n)).cast("bigint"),
                           out: F.array_join(F.slice(toks, 1, n), " ")})


def explode_values(arr: Column, name: str):
    """``explode`` without the filter Catalyst infers from it.

    For ``explode(expr)`` the optimiser adds ``size(expr) > 0`` below the
    generator -- and pushes it through exchanges -- so an expensive array
    expression (tokenising a whole text) would run twice, once before any
    repartitioning. ``explode_outer`` infers nothing; the null row it emits
    for an empty array is dropped by the caller with :func:`drop_null`."""
    return F.explode_outer(arr).alias(name)


def with_column_once(df, name: str, expr: Column):
    """Add ``expr`` as ``name`` so that it is evaluated once per row even when
    later filtered on.

    A filter on a projected alias is rewritten by Catalyst into a filter on
    the expression itself and pushed below the projection (and below any
    exchange), so an expensive expression -- a regex over a whole text --
    runs twice, the first time before the rows were spread over the cores.
    A filter on a generator's output cannot move below the generator, so a
    one-element ``explode_outer`` keeps the single evaluation in place."""
    return df.select("*", F.explode_outer(F.array(expr)).alias(name))


def once(c: Column, fn) -> Column:
    """``fn`` of a value that may be used several times in it: the value is
    computed once, as the element of a one-element array."""
    return F.transform(F.array(c), fn)[0]


FOLD_BLOCK = 256


def fold_blocks(items: Column, state: dict[str, Column], step, item_type: str) -> Column:
    """A left fold that keeps some items: the struct of the last state and of
    ``out``, the array of what was kept. ``step(acc, x)`` returns the new state
    (by name) and the value to keep, null to keep nothing.

    Appending to an array copies it, so one fold over ``m`` items takes ``m^2``
    steps. Here the items are folded in blocks of ``FOLD_BLOCK`` with an array
    each, and the arrays are joined at the end: the copying is linear in the
    items, and in their blocks squared."""
    names, empty = list(state), F.array().cast(f"array<{item_type}>")

    def inner(acc: Column, x: Column) -> Column:
        new, kept = step(acc, x)
        out = F.when(kept.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], kept))
        return F.struct(*[new[n].alias(n) for n in names], out.alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        begin = F.struct(*[acc[n].alias(n) for n in names], empty.alias("out"))
        return once(F.aggregate(block, begin, inner), lambda r: F.struct(
            *[r[n].alias(n) for n in names], F.array_append(acc["out"], r["out"]).alias("out")))

    def whole(a: Column) -> Column:
        last = F.greatest(F.floor((F.size(a) - 1) / FOLD_BLOCK), F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(a, i * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))
        begin = F.struct(*[c.alias(n) for n, c in state.items()], F.array().cast(f"array<array<{item_type}>>").alias("out"))
        return F.when(a.isNotNull(), F.aggregate(blocks, begin, outer, lambda acc: F.struct(
            *[acc[n].alias(n) for n in names], F.flatten(acc["out"]).alias("out"))))

    return once(items, whole)
