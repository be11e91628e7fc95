"""Operator 3 against all pairs."""

import re

import numpy as np
import xxhash

from cases import documents, edge_docs, edge_rows, empty_docs
from tagwright.llm.graph import components
from tagwright.llm.simhash import block_masks, blocks_for, fingerprint, near_links, simhash_dedup, simhash_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(rows):
    """(id, fingerprint) -> component of each row."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def compare(df, rows):
    rows = [(i, brute_fingerprint(t)) for i, t in rows]
    expected = sorted(((i, format(f, "016x"), c) for (i, f), c in zip(rows, brute_components(rows), strict=True)), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == expected


def test_driver_documents(spark):
    docs = documents(spark)
    compare(simhash_groups(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_rows(spark):
    compare(simhash_groups(edge_docs(spark)), [r[:2] for r in edge_rows()])


def test_empty_table(spark):
    assert simhash_groups(empty_docs(spark)).collect() == []
    assert simhash_dedup(empty_docs(spark)).collect() == []


def test_one_document_of_each_group_stays(spark):
    docs = edge_docs(spark)
    rows = [(r[0], brute_fingerprint(r[1])) for r in edge_rows()]
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    groups = brute_components(rows)
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({g for g in groups if g is not None})
    assert kept.where("doc_id = 7").count() <= 1


def test_links_of_random_fingerprints(spark):
    """Clusters of close fingerprints, parts so small that buckets are split."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(25):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 9)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = near_links(df, len(fps), part=5)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    for r in links.collect():
        assert ((r["u"] ^ r["v"]) & ((1 << 64) - 1)).bit_count() <= 4
    expected = brute_components([(f - (1 << 64) if f >> 63 else f, f) for f in fps])
    for f, c in zip(fps, expected, strict=True):
        f = f - (1 << 64) if f >> 63 else f
        assert roots.get(f, f) == c


def test_blocks():
    for n in (1, 10 ** 4, 10 ** 7, 10 ** 10):
        blocks = blocks_for(n, 4)
        masks = block_masks(blocks, 4)
        assert all((m & ((1 << 64) - 1)).bit_count() >= 64 // blocks for m in masks)
        # whatever four bits differ, some choice of blocks leaves them out
        for bits in ((0, 1, 2, 3), (0, 20, 40, 63), (12, 13, 50, 51)):
            flipped = sum(1 << b for b in bits)
            assert any(not m & flipped for m in masks)
    assert blocks_for(10 ** 10, 4) > blocks_for(10 ** 4, 4)


def test_chain_components(spark):
    """A long path: the smallest node is found whatever the diameter."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)], "u long, v long")
    assert {r["root"] for r in components(edges).collect()} == {0}


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(text.encode()) == brute_fingerprint(text)
