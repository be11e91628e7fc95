"""Brute-force equivalence with Python's own string semantics on seeded
random fixtures: the regex-based operators must give exactly what
``re``/``str`` give (spans included)."""

import random
import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from tagwright.functions import text as TX
from tagwright.functions.patterns import Lexicon
from tagwright.operators import lexicon as LX

ALPHABET = list("abcdeghilnorstu") + list("ÄäÉéèñöüß") + [" ", " ", " ", "-", "\n", "\t", ".",
                                                          ",", "'", "²", "3", "_", " "] + \
    ["İ", "Σ", "ς", "ﬁ", "①", "Ⅻ", "½", "\u00a0", "\u2003", "\x1c", "ǆ", "e\u0301", "٣", "‿"]
WORDS = ["er", "the", "in", "an", "and", "he", "rate", "hike", "cut", "ease", "tion",
         "über", "été", "white", "house", "tight"]


def random_texts(rng, n=300):
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            if rng.random() < 0.5:
                w = rng.choice(WORDS)
                parts.append(w.upper() if rng.random() < 0.2 else w)
            else:
                parts.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 6))))
            parts.append(rng.choice([" ", " ", "-", "  ", "\n", "é", ""]))
        out.append("".join(parts))
    return out


def random_lexicon(rng, i):
    terms = rng.sample(WORDS, rng.randint(1, 5))
    if rng.random() < 0.5:
        terms.append(f"{rng.choice(WORDS)} {rng.choice(WORDS)}")
    return Lexicon(tuple(terms), tuple(rng.random() < 0.4 for _ in terms),
                   ignore_case=rng.random() < 0.8, name=f"r{i}")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_python_re(spark, seed):
    rng = random.Random(seed)
    texts = random_texts(rng)
    lexes = [random_lexicon(rng, i) for i in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for lx in lexes:
        df = LX.tag_text(df, "text", lx, "all")
        df = df.withColumn(f"{lx.name}_n", LX.match_count("text", lx))
        df = df.withColumn(f"{lx.name}_flag", LX.has_match("text", lx))
    rows = df.orderBy("id").collect()
    for r in rows:
        for lx in lexes:
            want = [(m.group(0), m.start(), m.end()) for m in lx.python_pattern().finditer(r.text)]
            got = [(m.term, m.start, m.end) for m in r[f"{lx.name}_matches"]]
            assert got == want, (lx.body(), r.text)
            assert r[f"{lx.name}_n"] == len(want)
            assert r[f"{lx.name}_flag"] == bool(want)


# input, expected text after cleaning (written by hand)
CLEANED = [
    ("", ""), ("Plain words", "plain words"), ("A_b-c's 12² x,,y", "a b-c's x y"), ("x\x1cy", "x y"), ("①②③ ٣", " "),
    ("Rates, up: 3.5%!", "rates up "), ("  two  blanks ", " two blanks "), ("line\n\tend", "line end"),
    ("ÄÖÜ (ß) É", "äöü ß é"), ("it's well-known", "it's well-known"), ("1 2 3", " "), ("a1b2", "ab"), ("$5 & <tag>", " tag "),
    ("half ½ Ⅻ", "half ½ ⅻ"), ("\u00a0nbsp\u2003em", " nbsp em"), ("...", " "), ("ΣΑΣ", "σας"), ("“quoted”", "“quoted”"),
    ("tab\tX", "tab x"), ("under_score", "under score"), ("10-year", "-year"), ("don't--stop", "don't--stop"),
]


def test_clean_sequence_table(spark):
    df = spark.createDataFrame(CLEANED, "t string, expected string")
    for r in df.select("t", "expected", TX.clean_sequence(F.col("t")).alias("got")).collect():
        assert r.got == r.expected, repr(r.t)


def py_fold(s):
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


@pytest.mark.parametrize("seed", [7, 8])
def test_cleaners_equal_python(spark, seed):
    rng = random.Random(seed)
    texts = random_texts(rng, 200) + ["A_b-c's 12² x,,y", "x\x1cy", "①②③ ٣"]
    punct = string.punctuation.replace("-", "").replace("'", "")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", TX.word_count(F.col("t")).alias("wc"),
        TX.clean_delete_punct(F.col("t")).alias("c2"),
        TX.strip_accents_ascii(F.lower(F.col("t"))).alias("fold"))
    for r in df.collect():
        assert r.wc == len(r.t.split()), repr(r.t)
        assert r.c2 == r.t.lower().translate(str.maketrans("", "", punct))
        assert r.fold == py_fold(r.t.lower()), repr(r.t)


def test_long_spans_equal_python_re(spark):
    rng = random.Random(11)
    texts = random_texts(rng, 150)
    lex = random_lexicon(rng, 9)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in LX.match_spans_long(df, "id", "text", lex).collect():
        got.setdefault(r.id, []).append((r.i, r.term, r.start, r.end))
    for i, t in enumerate(texts):
        want = [(k, m.group(0), m.start(), m.end())
                for k, m in enumerate(lex.python_pattern().finditer(t))]
        assert sorted(got.get(i, [])) == want, (lex.body(), t)
