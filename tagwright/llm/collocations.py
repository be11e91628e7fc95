"""Phrase collocations by best-first branch and bound (operator 12).

Phrases of two to ``MAX_WORDS`` words that occur ``min_count`` times or more in
a language are scored by their weakest cut, ``1000 a n / (l r)``, floored
(``a, l, r``: occurrences of the phrase and of the parts before and after the
cut, ``n``: all words), and each language's ``top`` are returned. A phrase
inside a longer one that occurs as often is left out.

The search tree grows phrases word by word from frequent words. A prefix
bounds everything below it: an extension occurs no more often than its prefix,
so below ``min_count`` nothing grows; and as ``r >= a`` at the cut after any
prefix, its score is at most ``1000 n / l``, least for the first word. Roots
are expanded in the order of that bound, in rounds of ``SHARES`` of a
language's words; after each round the score of its last wanted phrase is a
floor, and a language is settled when no unexpanded root's bound reaches it
(equal scores included).

In Spark: words are counted once; texts become runs of the 64-bit codes of
frequent words (nothing else can occur in a phrase or hide one), written once.
A round reads the runs three times: two-word phrases from the round's roots,
longer ones from the two-word prefixes that are frequent, and the right parts
that their cuts ask for. Counts are grouped sums with map-side combining; which
word, prefix or part is wanted travels to the tasks as a bitmap of fixed size,
whose false hits only cost work. A phrase is inside an equally frequent longer
one if all its occurrences have the same neighbour on one side, which the same
sums tell. Floors and frontiers stay in tables; the driver sees one count a
round. Words that share a code within a language are given other codes.

Defined results: null texts have no words; null languages are ``und``; A-Z are
lower-cased; repeated rows count again; ties rank by occurrences, then by the
phrase in byte order; scores are exact whole numbers; an empty table gives no
rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import col, materialize, small_batches, utf8

TOP, MIN_COUNT, MAX_WORDS = 2000, 100, 5
SHARES = (0.125, 0.5, 1.0)  # of a language's words that roots may stand for by the end of each round
BITS = 26                   # of a bitmap: 8 MB
HELD = 1 << 18              # different words that a task counts before it sends them on
CODES = [f"c{i}" for i in range(1, MAX_WORDS + 1)]
KEY = ["lang", *CODES]

# Piece ends (made full stops), blanks, lower case.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, and a full stop wherever a piece ends."""
    return text.translate(_CLEAN).replace(b".", b" . ").split()


def code_of(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed) or 1


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(columns, schema, strict=True)], schema=schema)


def _same(value: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, pa.string()), n)


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, word, f`` of ``lang, bytes``."""
    schema = to_arrow_schema(T.StructType.fromDDL("lang string, word binary, f long"))

    def count(it):
        held: dict[str, Counter] = {}

        def out():
            for lang, counter in held.items():
                counter.pop(b".", None)
                yield _batch([_same(lang, len(counter)), list(counter), list(counter.values())], schema)
            held.clear()

        for batch in it:
            for lang, text in zip(batch["lang"].to_pylist(), batch["bytes"], strict=True):
                held.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    return texts.mapInArrow(count, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def coded(words: DataFrame, min_count: int) -> tuple[DataFrame, dict]:
    """The frequent words with their codes, and the words with another code
    than their plain one: those that would share it with a word of their
    language (of a billion words less than one in expectation)."""
    seeds: dict[tuple[str, bytes], int] = {}

    def with_code(df: DataFrame) -> DataFrame:
        fields = [f for f in df.schema.fields]
        schema = T.StructType([*fields, T.StructField("c1", T.LongType())])
        arrow = to_arrow_schema(schema)

        def add(it):
            for b in it:
                codes = [code_of(w, seeds.get((la, w), 42)) for la, w in zip(b["lang"].to_pylist(), b["word"].to_pylist(), strict=True)]
                yield _batch([*b.columns, pa.array(np.array(codes, np.uint64).view(np.int64))], arrow)
        return df.mapInArrow(add, schema)

    for seed in range(43, 60):
        plain = F.xxhash64(F.col("word").cast("string")) if seed == 43 else None
        codes = words.withColumn("c1", F.when(plain == 0, 1).otherwise(plain)) if seed == 43 else with_code(words)
        shared = codes.groupBy("lang", "c1").agg(F.count("*").alias("n")).where("n > 1")
        clash = codes.join(shared, ["lang", "c1"], "left_semi").orderBy("lang", "c1", "word").select("lang", "word", "c1").collect()
        if not clash:
            return codes.where(F.col("f") >= min_count), seeds
        before = None
        for r in clash:     # all but the first of each code move on
            if (r["lang"], r["c1"]) == before:
                seeds[r["lang"], bytes(r["word"])] = seed
            before = r["lang"], r["c1"]
    raise RuntimeError("words share codes under every seed")


# -- bitmaps ---------------------------------------------------------------

def slots(lang: str, codes: list[np.ndarray]) -> np.ndarray:
    """Bitmap places of phrases (one array a word)."""
    h = np.full(len(codes[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for c in codes:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(64 - BITS)


class Bitmap:
    """Which phrases are wanted, with false hits; ``BITS`` bound its size."""

    def __init__(self, phrases: DataFrame, width: int):
        schema = to_arrow_schema(T.StructType.fromDDL("slot long"))

        def place(it):
            for b in it:
                langs = np.array(b["lang"].to_pylist(), object)
                cols = [b[f"c{i + 1}"].to_numpy().view(np.uint64) for i in range(width)]
                for lang in set(langs):
                    own = langs == lang
                    yield _batch([slots(lang, [c[own] for c in cols]).astype(np.int64)], schema)

        found = phrases.select("lang", *CODES[:width]).mapInArrow(place, "slot long")
        rows = (found.groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
                .toArrow())     # 2 ** (BITS - 6) rows at most
        self.bits = np.zeros(1 << BITS - 6, np.uint64)
        self.bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def encode(texts: DataFrame, frequent: Bitmap, seeds: dict) -> DataFrame:
    """``lang, runs``: codes of neighbouring frequent words, 0 where a run ends
    and before and after all; words alone are left out."""
    schema = to_arrow_schema(T.StructType.fromDDL("lang string, runs binary"))

    def run(it):
        known: dict[str, dict[bytes, int]] = {}
        for batch in it:
            langs, out = [], []
            for lang, text in zip(batch["lang"].to_pylist(), batch["bytes"], strict=True):
                words = words_of(text.as_py())
                codes = known.setdefault(lang, {b".": 0})
                if len(codes) > HELD:
                    codes = known[lang] = {b".": 0}
                new = list(set(words).difference(codes))
                if new:
                    plain = np.array([code_of(w, seeds.get((lang, w), 42)) for w in new], np.uint64)
                    codes.update(zip(new, np.where(frequent.has(slots(lang, [plain])), plain, np.uint64(0)).tolist(), strict=True))
                x = np.zeros(len(words) + 2, np.uint64)
                x[1:-1] = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
                full = x != 0
                x[1:-1][~(full[:-2] | full[2:])] = 0        # no neighbour
                full = x != 0
                full[1:] |= full[:-1]                       # one 0 after a run
                full[0] = True
                x = x[full]
                if len(x) > 2:
                    langs.append(lang)
                    out.append(x.tobytes())
            if out:
                yield _batch([langs, out], schema)

    return texts.mapInArrow(run, "lang string, runs binary")


# -- counting ----------------------------------------------------------------

def count_phrases(runs: DataFrame, lengths: range, wanted: dict[int, Bitmap], min_count: int,
                  growing: bool = True) -> DataFrame:
    """``lang, c1.., a, hidden`` of the phrases of these lengths that occur
    ``min_count`` times. ``wanted``: by number of words, a bitmap of the
    beginnings to grow from, or (not ``growing``) of the phrases themselves.
    ``hidden``: one and the same word stands before, or after, every
    occurrence."""
    ddl = f"lang string, {', '.join(f'{c} long' for c in CODES)}, before long, after long"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def count(it):
        for batch in it:
            by_lang: dict[str, list] = {}
            for lang, x in zip(batch["lang"].to_pylist(), batch["runs"], strict=True):
                by_lang.setdefault(lang, []).append(np.frombuffer(x.as_py(), np.uint64))
            for lang, parts in by_lang.items():
                x = np.concatenate([*parts, np.zeros(MAX_WORDS + 1, np.uint64)])
                at = np.flatnonzero(x)
                for m in range(1, lengths[-1] + 1):     # positions where m words stand
                    if m > 1:
                        at = at[x[at + (m - 1)] != 0]
                    if m not in lengths and m not in wanted:
                        continue
                    words = [x[at + j] for j in range(m)]
                    if m in wanted:
                        hit = wanted[m].has(slots(lang, words))
                        keep = at[hit]
                        at = keep if growing else at
                        words = [x[keep + j] for j in range(m)]
                    else:
                        keep = at
                    if m in lengths and len(keep):
                        none = np.zeros(len(keep), np.uint64)
                        cols = [*words, *[none] * (MAX_WORDS - m), x[keep - 1], x[keep + m]]
                        yield _batch([_same(lang, len(keep)), *[pa.array(c.view(np.int64)) for c in cols]], schema)

    sides = [F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1")]
    return (runs.mapInArrow(count, ddl).groupBy(*KEY).agg(F.count("*").alias("a"), *sides).where(F.col("a") >= min_count)
            .withColumn("hidden", F.expr(f"c{MAX_WORDS} = 0 AND (b0 = b1 AND b0 <> 0 OR a0 = a1 AND a0 <> 0)"))
            .select(*KEY, "a", "hidden"))


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, n, left, right)]
    top = (wide[0] * wide[1]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)"))


def _part(first: int, last: int) -> list[Column]:
    """Codes of a phrase's words first..last (from 0) as a phrase of its own."""
    return [F.col(CODES[first + j]) if first + j < last else F.lit(0).cast("long") for j in range(MAX_WORDS)]


def _cuts(phrases: DataFrame) -> DataFrame:
    """A row a cut: ``k`` words before it, the codes of both parts."""
    def part(first: int, last: int) -> Column:
        return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(_part(first, last), 1)])
    options = [F.when(F.col(f"c{m}") != 0 if m == MAX_WORDS else (F.col(f"c{m}") != 0) & (F.col(f"c{m + 1}") == 0),
                      F.array(*[F.struct(F.lit(k).alias("k"), part(0, k).alias("l"), part(k, m).alias("r")) for k in range(1, m)]))
               for m in range(2, MAX_WORDS + 1)]
    return phrases.withColumn("cut", F.explode(F.coalesce(*options))).select("*", "cut.*").drop("cut")


def _counted(cuts: DataFrame, counts: DataFrame, side: str) -> DataFrame:
    """``cuts`` with the count of one part, as ``f_<side>``."""
    named = counts.select(F.col("lang").alias("_lang"), F.struct(*CODES).alias("_phrase"), F.col("a").alias(f"f_{side}"))
    return cuts.join(named, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).drop("_lang", "_phrase")


def mine_phrases(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", top: int = TOP,
                 min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top``
    phrases."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), utf8(text_col).alias("bytes"))
    words = materialize(count_words(texts), "words")
    frequent, seeds = coded(words, min_count)
    frequent = materialize(frequent, "frequent-words")
    none = [F.lit(0).cast("long").alias(c) for c in CODES[1:]]
    single = frequent.select("lang", "c1", *none, F.col("f").alias("a"))
    runs = materialize(encode(texts, Bitmap(frequent, 1), seeds), "word-runs")

    # roots by powers of two of their occurrences: a few rows a language
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    steps = frequent.groupBy("lang", F.floor(F.log2("f")).alias("step")).agg(F.sum("f").alias("tokens"), F.max("f").alias("most"))
    up_to = F.sum("tokens").over(Window.partitionBy("lang").orderBy("step"))
    steps = materialize(steps.withColumn("up_to", up_to).join(totals, "lang"), "frontier")
    state = steps.groupBy("lang", "n").agg(F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("floor"))
    found = None
    for share in SHARES:
        # the best roots that are left, as far as this round's share and the floor go; one step at least
        reach = F.expr("CASE WHEN floor > 0 THEN cast(1000 * cast(n AS decimal(20,0)) / floor AS long) ELSE 9223372036854775807 END")
        ahead = steps.drop("n").join(state, "lang").where("most > done").withColumn("reach", reach)
        ahead = ahead.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("step")))
        goal = F.max(F.when((F.col("nth") == 1) | (F.col("up_to") <= share * F.col("n")) | F.lit(share >= 1), F.col("most")))
        goals = materialize(ahead.groupBy("lang", "n", "done", "floor").agg(F.least(goal, F.max("reach")).alias("goal"))
                            .where("goal > done"), "goals")
        roots = materialize(frequent.join(goals, "lang").where("f > done AND f <= goal").select("lang", "c1"), "roots")
        if roots.isEmpty():
            break
        two = materialize(count_phrases(runs, range(2, 3), {1: Bitmap(roots, 1)}, min_count)
                          .join(roots, ["lang", "c1"], "left_semi"), "two-words")
        longer = materialize(count_phrases(runs, range(3, MAX_WORDS + 1), {2: Bitmap(two, 2)}, min_count)
                             .join(roots, ["lang", "c1"], "left_semi"), "longer-phrases")
        phrases = two.unionByName(longer)
        known = single.unionByName(phrases.select(*KEY, "a"))
        cuts = _counted(_cuts(phrases), known, "l").join(state.select("lang", "n", "floor"), "lang")
        # the cut's left part bounds the score; right parts are counted where that reaches the floor
        cuts = materialize(cuts.where(F.col("hidden") == F.lit(False)), "cuts")
        weak = cuts.groupBy(*KEY).agg(F.max(exact_score(F.col("a"), F.col("n"), F.col("f_l"), F.col("a")) < F.col("floor")).alias("weak"))
        cuts = cuts.join(weak.where("NOT weak"), KEY, "left_semi")
        asked = materialize(cuts.where("r.c2 <> 0").select("lang", "r.*").distinct(), "right-parts")
        by_length = {m: asked.where(f"c{m} <> 0 AND c{m + 1} = 0") for m in range(2, MAX_WORDS)}
        parts = materialize(count_phrases(runs, range(2, MAX_WORDS), {m: Bitmap(df, m) for m, df in by_length.items()}, min_count, growing=False)
                            .join(asked, KEY, "left_semi"), "part-counts")
        scored = _counted(cuts, single.unionByName(parts.select(*KEY, "a")), "r")
        scored = scored.withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("f_l"), F.col("f_r")))
        best = F.min(F.struct("score", "k", F.col("f_l").alias("l"), F.col("f_r").alias("r"))).alias("best")
        scored = scored.groupBy(*KEY, "a", "n").agg(best).select(*KEY, "a", "n", "best.score", "best.l", "best.r")
        found = scored if found is None else found.unionByName(scored)
        # the score of each language's last wanted phrase; what is below it is out
        order = Window.partitionBy("lang").orderBy(F.desc("score"))
        last = found.withColumn("at", F.row_number().over(order)).where(F.col("at") == top).select("lang", F.col("score").alias("last"))
        found = materialize(found.join(last, "lang", "left").where("last IS NULL OR score >= last").drop("last"), "best-phrases")
        last = found.withColumn("at", F.row_number().over(order)).where(F.col("at") == top).select("lang", F.col("score").alias("floor"))
        state = materialize(state.drop("floor").join(goals.select("lang", "goal"), "lang", "left").join(last, "lang", "left")
                            .select("lang", "n", F.coalesce(F.greatest("goal", "done"), "done").alias("done"), F.coalesce("floor", F.lit(0)).alias("floor")),
                            "frontier")
    ddl = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
    if found is None:
        return docs.sparkSession.createDataFrame([], ddl).withColumn("rank", F.col("rank").cast("long"))
    # words of the phrases that are left
    spelled = found.select("*", F.posexplode(F.array(*CODES)).alias("at", "code")).where("code <> 0")
    spelled = spelled.join(frequent.select("lang", F.col("c1").alias("code"), "word"), ["lang", "code"])
    texts_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))), lambda w: w["word"]), " ")
    rows = spelled.groupBy(*KEY, "a", "l", "r", "n", "score").agg(texts_of.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
