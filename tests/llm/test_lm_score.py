"""Operator 9: base score against counts, the model as a distribution and
against a plain rendering of its rule, held-out gain, strange rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cases import documents, edge_docs, edge_rows, empty_docs
from tagwright.llm import lm_score as M


def low(text):
    return (text or "").encode().lower()


def check_base(df, rows):
    train = [low(t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in t.split())
    count[None] = len(train)
    total, distinct = sum(count.values()), sum(n > 0 for n in count.values())
    got = sorted(((r["doc_id"], low(r["text"]), r) for r in df.collect()), key=lambda x: (repr(x[0]), x[1]))
    assert len(got) == len(rows)
    for i, text, r in got:
        tokens = text.split() + [None]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base)
        assert r["score"] < 0


def test_driver_documents(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = M.lm_score(docs)
    check_base(got, rows)
    check_base(M.lm_score(docs, frequent=50), rows)     # almost all words take the join
    held = [r for r in got.collect() if r["held_out"]]
    # far below the 8 bits of a byte, and below an order-0 byte model
    data = b"".join(low(r["text"]) for r in held)
    flat = -sum(n * math.log2(n / len(data)) for n in Counter(data).values()) / len(data)
    assert sum(-r["score"] / math.log10(2) for r in held) / len(data) < 0.8 * flat


def test_edge_rows_and_empty(spark):
    check_base(M.lm_score(edge_docs(spark)), [r[:2] for r in edge_rows()])
    assert {"rare", "word", "n"} <= set(M.lm_score(edge_docs(spark)).columns)
    assert M.lm_score(empty_docs(spark)).collect() == []


def test_no_training_text(spark):
    docs = documents(spark)
    from pyspark.sql import functions as F
    got = M.lm_score(docs, train_on=F.lit(False)).first()
    assert got["train_tokens"] == 0 and got["n_known"] == 0 and abs(got["base_score"]) < 1e-9
    n = len(low(got["text"]))
    assert abs(got["bits_per_byte"] * n / (n + 1) - 8) < 0.01      # the end symbol is coded, too


def model_of(texts):
    counts = M.Counts()
    for t in texts:
        heads, n = np.unique(M.heads_of([t])[0], return_counts=True)
        symbols, of = M.head_symbols(heads)
        counts.add(symbols, n[of])
        symbols, of = M.tail_symbols(M.words_of(t))
        counts.add(symbols, np.ones(len(symbols), np.int64))
    return counts, M.Model.of(counts.seen, M.Mixer())


TEXTS = [b"the cat sat on the mat", b"a cat  at the mat\nsat", b"", b" ", "été là".encode(), b"x" * 30]


def symbols_of(text):
    """Every symbol of a text with its three bytes before and word so far, one at a time."""
    past, word = [255] * 3, 0
    for s in [*text, 255]:
        yield past[-3] << 16 | past[-2] << 8 | past[-1], word, s
        past.append(s)
        word = 0 if s == 32 else (word + s + 1) * int(M._MIX) % (1 << 64)


def test_a_text_is_all_its_symbols():
    _, model = model_of(TEXTS)
    scorer = M.Scorer(model, {})
    whole = scorer.score(TEXTS)[0]
    for text, bits in zip(TEXTS, whole, strict=True):
        before, word, symbol = (np.array(x, np.uint64) for x in zip(*symbols_of(text), strict=True))
        # within a word, only its own bytes count; at its beginning those before
        assert abs(model.bits(M.Symbols(before, word, symbol)).sum() - bits) < 1e-6
    assert np.allclose(scorer.score(TEXTS[::-1])[0][::-1], whole)      # remembered costs change nothing


def test_counts_are_those_of_every_bit():
    counts, _ = model_of(TEXTS)
    for k in range(M.N):
        assert counts.seen[k].sum() == 8 * sum(len(t) + 1 for t in TEXTS)


def test_symbols_are_a_distribution():
    _, model = model_of(TEXTS)
    every = np.arange(256, dtype=np.uint64)
    for before, word in ((0x746865, 12345), (0xFFFFFF, 0), (0x20, 7)):
        bits = model.bits(M.Symbols(np.full(256, before, np.uint64), np.full(256, word, np.uint64), every))
        assert abs((2.0 ** -bits).sum() - 1) < 1e-4


def test_learning_helps():
    texts = [b"one two three four five six seven " * 20, b"six five four three two one " * 20]
    counts, model = model_of(texts)
    mixer = M.Mixer()
    symbols, _ = M.head_symbols(M.heads_of(texts)[0])
    mixer.learn(symbols, counts.seen, 64)
    learned = M.Model.of(counts.seen, mixer)
    assert learned.bits(symbols).sum() < model.bits(symbols).sum()


def test_gate_and_refinement_learn_from_every_training_text(spark):
    """1,500 texts of one script, three of another: all bits of all of them are
    outcomes in the refining table, and the sums over partitions are the plain ones."""
    texts = [f"one two three four five {i}".encode() for i in range(1500)] + ["это редкий текст".encode()] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text binary").repartition(7)
    items = M.materialize(M._count(docs).groupBy("word", "code").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"), "test-items")
    counts = M._sum_tables(M._tables(items))
    mixer = M._learn_mixer(items, counts)
    seen = mixer.refine - M.Mixer().refine
    assert abs(seen.sum() - 8 * sum(len(t) + 1 for t in texts)) < 1e-3
    rare = {b for b in "это редкий текст".encode() if b >= 0x80}
    assert all(seen[:, b].sum() > 0 for b in rare)
    heads, tails = M.head_symbols(M.heads_of(texts)[0])[0], M.tail_symbols([w for t in texts for w in M.words_of(t)])[0]
    plain = M.Mixer()
    plain.learn(M.Symbols(*(np.concatenate([getattr(p, f) for p in (heads, tails)]) for f in ("before", "word", "symbol"))), counts)
    assert np.allclose(plain.weights, mixer.weights, atol=1e-4) and np.allclose(plain.refine, mixer.refine, atol=2)


def test_symbols_shared_by_words_are_worked_out_once():
    """Sorted words share the symbols of their common beginnings, so a pass of
    the gate takes each symbol under its context once, with all its times."""
    texts = [f"the thing thingness thinning {i} thing{i}".encode() for i in range(300)]
    count = Counter(w for t in texts for w in M.words_of(t))
    codes, n = np.unique(M.heads_of(texts)[0], return_counts=True)
    words = sorted(count)
    batch = pa.RecordBatch.from_pydict({"word": pa.array([None] * len(codes) + words, pa.binary()),
                                        "code": pa.array(codes.view(np.int64).tolist() + [None] * len(words), pa.int64()),
                                        "n": pa.array(n.tolist() + [count[w] for w in words], pa.int64())})
    got = Counter()
    for symbols, times in M._symbols(batch.slice(k, 100) for k in range(0, len(batch), 100)):
        keys = list(zip(symbols.before.tolist(), symbols.word.tolist(), symbols.symbol.tolist(), strict=True))
        assert len(set(keys)) == len(keys)
        got.update(dict(zip(keys, times.tolist(), strict=True)))
    assert sum(got.values()) == sum(len(t) + 1 for t in texts)
    every = [M.head_symbols(M.heads_of(texts)[0])[0], M.tail_symbols([w for t in texts for w in M.words_of(t)])[0]]
    assert got == Counter(x for s in every for x in zip(s.before.tolist(), s.word.tolist(), s.symbol.tolist(), strict=True))


def test_slopes_are_those_of_the_cost():
    counts, _ = model_of(TEXTS)
    symbols, of = M.head_symbols(M.heads_of(TEXTS)[0])
    symbols, times = M.merged(symbols, np.ones(len(of), np.int64))
    mixer, plain = M.Mixer(), np.zeros((M._SLOPES, 256))
    for before, word, symbol, n in zip(symbols.before, symbols.word, symbols.symbol, times, strict=True):
        for known, bit in M.bits_of(np.array([symbol])):
            slots = M.Symbols(np.array([before]), np.array([word]), np.array([symbol])).slots(known)
            x = []
            for table, slot in zip(counts.seen, slots, strict=True):
                seen = table[:, slot[0]].copy()
                seen[bit[0]] -= 1                       # without this occurrence
                x.append(math.log((seen[1] + M._PRIOR) / (seen[0] + M._PRIOR)))
            p = 1 / (1 + math.exp(-0.3 * sum(x)))
            rows = [-math.log(p if bit[0] else 1 - p), *((p - bit[0]) * a for a in x),
                    *(p * (1 - p) * x[i] * x[j] for i, j in M._PAIRS)]
            plain[:, known[0]] += n * np.array(rows)
    assert np.allclose(mixer.slopes(symbols, times, M.logits_left(counts.seen)), plain)


def test_a_text_is_cut_where_python_cuts_it():
    texts = [b"", b" ", b"  x", b"one two\tthree", "\u00e9t\u00e9 l\u00e0 ".encode(), b"\xff a\xff b", b"last"]
    codes, owner, words = M.cut(texts)
    assert M.bytes_of(words) == [w for t in texts for w in [x + b" " for x in t.split(b" ")[:-1]] + [t.split(b" ")[-1] + M._END]]
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in t.split(b" ")]
    assert M.bytes_of(words.slice(3, 4)) == M.bytes_of(words)[3:7] and M.bytes_of(words[:0]) == []
    for i, t in enumerate(texts):       # a text's codes do not depend on its neighbours
        assert codes[owner == i].tolist() == M.heads_of([t])[0].tolist()
