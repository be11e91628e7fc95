"""Operator 10 against all windows."""

import hashlib
import re

from cases import SF, documents, edge_docs, edge_rows, empty_docs
from tagwright.llm.decontaminate import decontaminate, winnow, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(0, len(w) - 12) or bool(w)):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()),
                  key=repr)


def test_driver_documents(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert any(r[-1] for r in expected)
    assert rows_of(decontaminate(docs, items)) == expected


def test_edge_rows_and_short_items(spark):
    rows = edge_rows()
    w = words(rows[4][1])
    items = [(1, " ".join(w[5:30])), (2, " ".join(w[5:18])), (3, " ".join(w[40:47])), (4, "x"), (5, None), (6, ""), (7, "..."),
             (None, " ".join(w[20:40])), (4, "x"), (8, "ÉTÉ à la"), (9, " ".join(w[0:12]) + " elsewhere"), (10, "ab ab ab ab")]
    df = spark.createDataFrame(items, "item_id long, text string")
    expected = brute([r[:2] for r in rows], items)
    got = decontaminate(edge_docs(spark), df)
    assert rows_of(got) == expected
    assert {"_key", "items", "key", "n_chars"} <= set(got.columns)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(empty_docs(spark), items).collect() == []
    got = decontaminate(edge_docs(spark), items.limit(0))
    assert got.where("contaminated OR n_hit > 0").count() == 0 and got.count() == len(edge_rows())


def test_every_shared_window_has_a_shared_fingerprint():
    import random
    rng = random.Random(2)
    text = [rng.choice("abcdefgh") for _ in range(400)]
    whole = set(zip(*[x.tolist() for x in winnow(word_hashes([t.encode() for t in text]), 13, 7)], strict=True))
    for k in range(0, 380):
        part = [t.encode() for t in text[k:k + 13]]
        at, fp = winnow(word_hashes(part), 13, 7)
        assert (k + at[0], fp[0]) in whole
