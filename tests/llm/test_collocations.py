"""Operator 12 against all phrases of a fixture."""

import random
import re
from collections import Counter

import pytest

from cases import CLASHING, edge_docs, edge_rows, empty_docs
from tagwright.llm import collocations as C


def brute(rows, top, least):
    """rows: (text, lang)."""
    counts = {}
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            own.update(w[i:i + k] for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for g, f in own.items() if len(g) == 1)
        candidates = {g: f for g, f in own.items() if len(g) > 1 and f >= least}
        hidden = {g[i:i + k] for g, f in candidates.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)
                  if own[g[i:i + k]] <= f}
        rows = []
        for g, a in candidates.items():
            if g not in hidden:
                score, k = min((1000 * a * n // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s)
                for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df, top, least):
    return sorted(tuple(r) for r in C.mine_phrases(df, top=top, min_count=least).collect())


def prose(seed, n):
    """Words of very different frequencies, with set phrases, copies and ties."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    phrases = [" ".join(rng.choices(words[100:], k=rng.randrange(2, 8))) for _ in range(15)]
    copy = " ".join(rng.choices(words, weights, k=30))
    for _ in range(n):
        parts = rng.choices(words, weights, k=rng.randrange(0, 40))
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(phrases))
        text = "".join(p + rng.choice([" "] * 12 + [", ", ".", "\t", "\n", " ; ", "\r\n", "  "]) for p in parts)
        yield rng.choice([text, text, copy, text.upper()]), rng.choice(["en", "en", "en", "de", None])


@pytest.mark.parametrize("top, least", [(10, 3), (10 ** 6, 4)])
def test_all_phrases(spark, top, least):
    rows = list(prose(top, 400))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert found(df, top, least) == brute(rows, top, least)


def test_edge_rows(spark):
    rows = [(r[1], r[2]) for r in edge_rows()]
    expected = brute(rows, 50, 3)
    assert len(expected) > 30
    assert found(edge_docs(spark), 50, 3) == expected
    assert set(CLASHING) <= set(edge_docs(spark).columns)


def test_no_rows(spark):
    assert found(empty_docs(spark), 5, 2) == []
    assert found(spark.createDataFrame([(None, None), ("", "en"), ("one", "en"), ("one. two", None)], "text string, lang string"), 5, 2) == []


def test_one_round_is_enough_for_rare_words(spark, monkeypatch):
    """Roots whose bound is under the floor are never expanded, nor needed."""
    rows = list(prose(2, 300))
    expanded = []
    count = C.count_phrases

    def spy(runs, lengths, wanted, *a, **k):
        if 1 in wanted:
            expanded.append(sum(bin(int(b)).count("1") for b in wanted[1].bits))
        return count(runs, lengths, wanted, *a, **k)

    monkeypatch.setattr(C, "count_phrases", spy)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, 3, 3) == brute(rows, 3, 3)
    languages = {}
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.lower()):
            languages.setdefault(lang or "und", Counter()).update(re.findall("[^\x20\x09]+", piece))
    everything = sum(f >= 3 for own in languages.values() for f in own.values())
    assert 0 < sum(expanded) < everything


def test_words_that_share_a_code(spark, monkeypatch):
    """Where words of a language share a code, all but one get another, and
    results stay right."""
    rows = list(prose(9, 120))
    df = spark.createDataFrame(rows, "text string, lang string")
    plain, hashed = C.F.xxhash64, C.code_of
    few = 1 << 5        # codes of 5 bits under the first seed
    monkeypatch.setattr(C, "code_of", lambda word, seed: hashed(word, seed) % few + 1 if seed == 42 else hashed(word, seed))
    unsigned = lambda c: plain(c).bitwiseAND(C.F.lit(few - 1)) + 1
    monkeypatch.setattr(C.F, "xxhash64", unsigned)
    codes, seeds = C.coded(C.count_words(df.select(C.F.coalesce("lang", C.F.lit("und")).alias("lang"), C.utf8().alias("bytes"))), 3)
    assert len(seeds) > 100
    assert codes.groupBy("lang", "c1").count().where("count > 1").count() == 0
    assert found(df, 40, 3) == brute(rows, 40, 3)


def test_exact_scores(spark):
    cases = [(10 ** 15, 10 ** 16, 10 ** 15, 10 ** 15), (3, 7, 2, 5), (99, 10 ** 13, 101, 10 ** 10), (10 ** 12 + 1, 10 ** 14 + 7, 10 ** 12 + 3, 10 ** 13)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = df.select("a", "n", "l", "r", C.exact_score(*[C.F.col(c) for c in "anlr"]).alias("s")).collect()
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got)
