"""Operator 1 against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cases import documents, edge_docs, edge_rows, empty_docs
from tagwright.llm.suffix_dedup import Prefixes, remove_repeats, suffix_order


def brute(texts, span):
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df, key="doc_id"):
    return sorted((tuple(r) for r in df.select(key, "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_driver_documents(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    expected = brute([(r["text"] or "").encode() for r in rows], 200)
    assert rows_of(remove_repeats(docs)) == sorted(((r["doc_id"], *e) for r, e in zip(rows, expected, strict=True)), key=repr)


def test_edge_rows(spark):
    rows = edge_rows()
    expected = brute([(r[1] or "").encode() for r in rows], 200)
    got = remove_repeats(edge_docs(spark))
    assert rows_of(got) == sorted(((r[0], *e) for r, e in zip(rows, expected, strict=True)), key=repr)
    assert {"key", "row", "bytes", "spans", "lang"} <= set(got.columns)
    for r in got.collect():
        text = (r["text"] or "").encode()
        assert len(r["kept_bytes"]) == len(text) - sum(s["stop"] - s["start"] for s in r["removed"])


def test_empty_table(spark):
    assert remove_repeats(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("group", [4096, 1])      # 1: every recurring anchor takes the hot way
def test_random_texts_with_short_spans(spark, group):
    rng = random.Random(5)
    pool = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    texts = [b"".join(rng.choice(pool) for _ in range(rng.randrange(0, 8))).decode() for _ in range(120)]
    texts += ["a" * 70, "a" * 31, "ab" * 40, "x" + "a" * 30 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    expected = sorted(((i, *e) for i, e in enumerate(brute([t.encode() for t in texts], 20))), key=repr)
    assert rows_of(remove_repeats(docs, span=20, gram=6, group=group, with_text=False)) == expected


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    group = np.sort(np.array([rng.randrange(9) for _ in texts]))
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length) - length
    buf = np.frombuffer(b"".join(texts), np.uint8)
    order, common = suffix_order(Prefixes(buf), buf, start, length, group)
    for g in set(group.tolist()):
        inside = np.flatnonzero(group == g)
        found = [texts[i] for i in order[inside]]
        assert found == sorted(texts[i] for i in inside)
        for k, i in enumerate(inside):
            if k:
                a, b = found[k - 1], found[k]
                assert common[i] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            else:
                assert common[i] == -1
