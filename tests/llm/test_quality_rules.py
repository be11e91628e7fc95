"""Operator 7: base rules against brute force, divergence by hand, labels."""

import re

import numpy as np

from cases import SF, documents, edge_docs, edge_rows, empty_docs
from tagwright.llm.quality_rules import References, jensen_shannon, language_references, quality_rules, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def base(df):
    return [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            for r in df.collect()]


def test_driver_documents(spark):
    docs = documents(spark)
    got = quality_rules(docs)
    assert base(got) == [brute(r["text"]) for r in got.collect()]
    assert got.where("base_failed AND kept").count() == 0


def test_edge_rows(spark):
    got = quality_rules(edge_docs(spark))
    rows = got.collect()
    assert sorted(base(got)) == sorted(brute(r[1]) for r in edge_rows()) and len(rows) == len(edge_rows())
    assert {"key", "n", "word"} <= set(got.columns)
    assert all(r["class_divergence"] is None for r in rows if r["word_chars"] < 200)


def test_empty_table_and_no_labels(spark):
    assert quality_rules(empty_docs(spark)).collect() == []
    docs = documents(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert quality_rules(docs).where("kept = base_failed").count() == 0


def test_labels_agree(spark):
    """Good documents that pass the base rules are kept, bad ones mostly not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules(docs).join(labels, "doc_id")
    good = got.where("quality = 1 AND NOT base_failed")
    bad = got.where("quality = 0 AND n_words >= 100")
    assert good.where("kept").count() >= 0.99 * good.count()
    assert bad.where("NOT kept").count() >= 0.9 * bad.count()


def test_divergence():
    p, q = np.array([1.0, 0, 3]), np.array([[2.0, 0, 6], [0, 5, 0], [1, 1, 2]])
    got = jensen_shannon(p, q)
    assert abs(got[0]) < 1e-12 and abs(got[1] - 1) < 1e-12
    a, b = np.array([.25, 0, .75]), np.array([.25, .25, .5])
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
    assert abs(got[2] - (kl(a) + kl(b)) / 2) < 1e-12


def test_references_cover_all_documents(spark):
    docs = documents(spark)
    ref = language_references(docs)
    for k, lang in enumerate(ref.languages):
        words = [w for r in docs.where(f"lang = '{lang}'").collect() for w in WORD.findall((r["text"] or ""))]
        low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w).encode() for w in words]
        common = sorted(w for w in set(low) if low.count(w) >= 0.005 * len(low))
        assert ref.vocabulary[k] == common
        assert np.allclose(ref.words[k][:-1], [low.count(w) / len(low) for w in common])
    assert isinstance(ref, References)


def test_repeated_words_with_many_different_words():
    words = [str(i).encode() for i in range(1_200_000)] * 2
    assert repeated_words(words[:1_200_010]) == 20


def test_labels_without_common_words_keep_no_junk(spark):
    """An unspaced script, and a label of a few texts in which every word is
    new, judge nobody else's words and are not dropped by others' words."""
    rng = np.random.default_rng(3)
    common = "the of and to in a is that for it was on are as with his they at be this".split()
    new = lambda n, abc, size: ["".join(rng.choice(list(abc), size)) for _ in range(n)]
    latin, han = "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0x4E00, 0x5200)]

    def english(words, share):
        return " ".join(str(rng.choice(common)) if rng.random() < share else w for w in new(words, latin, 5))
    rows = [("good", english(300, 0.6), "en") for _ in range(60)]
    rows += [("junk", english(300, 0.0), None) for _ in range(10)]
    rows += [("han", " ".join(new(150, han, 12)), "zh") for _ in range(20)]
    rows += [("thin", english(400, 0.1), "thin") for _ in range(20)]      # under 15 % common words
    rows += [("few", english(300, 0.0), "few") for _ in range(3)]
    for labels in ({"en", "zh"}, {"en", "few"}, {"en", "thin"}, {"en", "zh", "thin", "few"}):
        docs = spark.createDataFrame([(k, t, x if x in labels else None) for k, t, x in rows if x is None or x in labels],
                                     "kind string, text string, lang string")
        got = quality_rules(docs).collect()
        assert not any(r["base_failed"] for r in got)
        kept = {k: np.mean([r["kept"] for r in got if r["kind"] == k]) for k in {r["kind"] for r in got}}
        assert kept["junk"] == 0 and kept["good"] == 1, (labels, kept)
        assert kept.get("han", 1) == 1 and kept.get("thin", 1) >= 0.8, (labels, kept)
