"""Operator 5: exact round trip, frames, index, and the piece encoder against
the tokenizer itself."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cases import documents, edge_docs, edge_rows, empty_docs
from tagwright.llm.queries import tokenizer_path
from tagwright.llm.tokens import PieceEncoder, frame, masked, read_at, scan_records, token_round_trip, unframe, write_tokens
from tagwright.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    """``(id, start, n, crc)`` in ascending id order (one order of equal ids)."""
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_driver_documents(spark):
    docs = documents(spark)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, token_round_trip(docs, tokenizer_path).collect())) == expected(rows)


def test_edge_rows(spark):
    rows = edge_rows()
    got = sorted(map(tuple, token_round_trip(edge_docs(spark), tokenizer_path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((repr(r[0]), r[2], r[3]) for r in got) == sorted((repr(r[0]), r[2], r[3]) for r in expected(r[:2] for r in rows))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()


def test_empty_table(spark):
    assert token_round_trip(empty_docs(spark), tokenizer_path).collect() == []


def test_files_and_shuffled_reads(spark):
    docs, path = documents(spark), scratch_path(spark, "tokens-test")
    write_tokens(docs, path, tokenizer_path, file_bytes=50_000)
    index = spark.read.parquet(f"{path}/index")
    assert index.select("file").distinct().count() > 3
    whole = {r["id"]: r["ids"] for r in scan_records(spark, path, with_ids=True).collect()}
    wanted = index.where("id % 3 = 1")
    some = {r["id"]: r["ids"] for r in read_at(spark, path, wanted).collect()}
    assert some == {i: ids for i, ids in whole.items() if i % 3 == 1}
    tokenizer = Tokenizer.from_file(PATH)
    for r in docs.limit(20).collect():
        assert tokenizer.decode(whole[r["doc_id"]][:-1], skip_special_tokens=False) == r["text"]


def test_frames():
    data = frame(b"one") + b"\n" + frame(b"") + b"\n"
    body, at = unframe(data, 0)
    assert body == b"one" and unframe(data, at) == (b"", len(data))
    assert struct.unpack_from("<Q", data)[0] == 3
    assert masked(zlib.crc32(b"one")) != zlib.crc32(b"one")
    for k in range(len(frame(b"one"))):
        broken = bytearray(frame(b"one"))
        broken[k] ^= 1
        with pytest.raises(ValueError):
            unframe(bytes(broken), 0)


def test_piece_encoder_equals_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(PATH), PieceEncoder(PATH)
    rng = random.Random(1)
    bits = [" ", " ", " ", "\n", "\t", "\f", "ab", "the", "\u3000", "\xa0", "\u2003", "\u0301", "é", "'", "'s", "1", ",", ".", "ß", "日",
            "ª", "!", "?", " \n", "\r\n", "\x00", "\x1c", "\x85", "<|endoftext|>", "ǆ", "ʰ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    texts += ["", " ", "'s 't  's", "x" * 5000, "a<|endoftext|> b  <|endoftext|>"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
