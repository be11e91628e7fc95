"""Token-ID output as length-delimited binary records (operator 5).

One record per document, in ascending id order over the files::

    u64 n                  length of the payload, little-endian
    u32 masked crc32 of the eight length bytes
    payload                u8 flags (1: null id, 2: 32-bit token ids), i64 id, token ids
    u32 masked crc32 of the payload
    byte 0x0A              ends the record (the text writer's separator; not a delimiter)

The mask rotates the checksum right by 15 bits and adds a constant, so that
checksums of data that holds checksums stay strong. Files are written by
Spark's own file writer (a text sink passes the bytes through unchanged), so
task retries and lost executors leave no partial file, and any file system
that Spark can reach will do. The separate index (Parquet: file, part, offset,
length, n_tokens, id) is read off the written files and serves shuffled reads:
a reader takes any subset or order of records by offset.

Defined results: a null text is encoded as the empty text (only the end id);
null ids come first; rows with the same id are ordered by text hash; an empty
table gives no records. Texts are encoded whole.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, col, scratch_path, worker_state

FILE_BYTES = 64 << 20       # text bytes a file holds at most on average
CACHE_PIECES = 500_000      # pieces remembered by a Python worker; then it starts anew
TEXTS_AT_ONCE = 128
MARKS = r"[!-&(-/:-@\[-`{-~]{1,8}"    # ASCII marks but the apostrophe: a pre-token of their own after a word
LATIN = 0x250        # letters below are read as such by every Unicode version
_HEAD, _ID = "<QI", "<Bq"
NULL_ID, WIDE = 1, 2


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return (length + masked(zlib.crc32(length)).to_bytes(4, "little") + payload
            + masked(zlib.crc32(payload)).to_bytes(4, "little"))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the place of the next record;
    raises ValueError where a checksum fails."""
    n, crc = struct.unpack_from(_HEAD, data, at)
    if masked(zlib.crc32(data[at:at + 8])) != crc:
        raise ValueError(f"record at {at}: bad length checksum")
    body = data[at + 12:at + 12 + n]
    if len(body) != n or masked(zlib.crc32(body)).to_bytes(4, "little") != data[at + 12 + n:at + 16 + n]:
        raise ValueError(f"record at {at}: bad payload checksum")
    return body, at + 17 + n


class PieceEncoder:
    """Whole-text encoding through remembered pieces.

    A byte-level tokenizer splits texts so that a blank followed by a
    non-blank character always begins a new word, whatever stands before it.
    Texts are cut there, each different piece goes through the tokenizer
    once, and a text's ids are the ids of its pieces. A new piece of Latin
    letters only is a single pre-token and goes straight to the tokenizer's
    merge model; punctuation marks after it and a line end between two words
    are pre-tokens of their own.
    Other new pieces, and texts that contain an added token, pass the whole
    tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        from tokenizers.pre_tokenizers import ByteLevel
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # how the tokenizer writes the bytes of each Latin letter, and of a blank
        self.written = {c: alphabet(chr(c))[0][0] for c in range(LATIN) if chr(c).isalpha()}
        self.blank = alphabet(" ")[0][0]
        letters = "[" + "".join(map(chr, self.written)) + "]+"
        self.is_word = re.compile(letters).fullmatch
        self.is_marked = re.compile(f"({letters})({MARKS})").fullmatch
        self.marks: dict[str, bytes] = {}
        self.line_end = self._ids("\n")
        self.later: dict[str, bytes] = {}   # piece after a blank -> its ids as 32-bit integers
        self.first: dict[str, bytes] = {}   # piece that begins a text

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, blank: str) -> bytes:
        """A word of Latin letters: a single pre-token."""
        written = word if word.isascii() else word.translate(self.written)
        return array("I", [t.id for t in self.merge(blank + written)]).tobytes()

    def _learn(self, piece: str, after_blank: bool) -> bytes:
        """The ids of a new piece without leading white space, remembered."""
        known, blank = (self.later, self.blank) if after_blank else (self.first, "")
        if self.is_word(piece):
            ids = self._word(piece, blank)
        elif m := self.is_marked(piece):
            word, marks = m.groups()
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word, blank)
            if marks not in self.marks:
                self.marks[marks] = self._ids(marks)
            ids += self.marks[marks]
        else:
            lines = piece.split("\n")      # a line end between two words is a pre-token, too
            if len(lines) > 1 and all(p and not p[0].isspace() and not p[-1].isspace() for p in lines):
                parts = [known.get(lines[0]) or self._learn(lines[0], after_blank)]
                parts += [self.first.get(p) or self._learn(p, False) for p in lines[1:]]
                ids = self.line_end.join(parts)
            else:
                ids = self._ids((" " if after_blank else "") + piece)
        known[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return [self._encode(t) for t in texts]

    def _encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._ids(text)
        if max(len(self.later), len(self.first)) > CACHE_PIECES:
            self.later.clear()
            self.first.clear()
        pieces = text.split(" ")
        known = self.later
        missing = [p for p in pieces[1:] if p not in known]
        if any(not p or p[0].isspace() for p in missing):   # a longer blank run stays within one piece
            joined = pieces[:1]
            for p in pieces[1:]:
                if p and not p[0].isspace():
                    joined.append(p)
                else:
                    joined[-1] += " " + p
            pieces, missing = joined, [p for p in joined[1:] if p not in known]
        for p in missing:
            if p not in known:
                self._learn(p, True)
        head = pieces[0]
        pieces[0] = ""
        known[""] = self.first.get(head) or self._learn(head, False)        # joined first; no piece after a blank is empty
        out = b"".join(map(known.__getitem__, pieces))
        del known[""]
        return out


def encode_records(tokenizer_path: Callable[[], str], end_id: int | None):
    """An Arrow batch function: (id, text) -> framed records."""
    schema = pa.schema([("record", pa.binary())])

    def run(rows):
        path = tokenizer_path()
        encoder = worker_state(("encoder", path), lambda: PieceEncoder(path))
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")

        def make(batch):
            out = []
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += tail
                if not wide:
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                flags = (NULL_ID if i is None else 0) | (WIDE if wide else 0)
                out.append(frame(struct.pack(_ID, flags, i or 0) + ids))
            return {"record": out}

        parts = (batch.slice(k, TEXTS_AT_ONCE) for batch in rows for k in range(0, len(batch), TEXTS_AT_ONCE))
        return batches(parts, make, schema)
    return run


def decode(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, i = struct.unpack_from(_ID, payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=struct.calcsize(_ID))
    return None if flags & NULL_ID else i, ids.astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: Callable[[], str], *, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int | None = 0, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` into ``path/records`` and index them in ``path/index``.

    ``tokenizer_path`` gives the tokenizer file's place on the machine that
    asks. One shuffle: texts are dealt by id ranges, one file a range. The
    index is made by reading the written files back, all checksums verified.
    """
    spark = docs.sparkSession
    texts = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / file_bytes))
    ordered = (texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "id", "tie")
               .sortWithinPartitions("id", "tie").select("id", "text"))
    (ordered.mapInArrow(encode_records(tokenizer_path, end_id), "record binary")
     .select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\n").text(f"{path}/records"))
    scan_records(spark, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
            .select("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("part"), "content"))


def scan_records(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every record of the files, checksums verified: file, part, offset,
    length, id, before (ids of the records before it in the file), n_tokens,
    ids_crc32 and, if asked for, the ids."""
    fields = [("file", pa.string()), ("part", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
              ("id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(fields)

    def run(rows):
        for batch in rows:
            for f, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, at, before = [], 0, 0
                while at < len(data):
                    payload, nxt = unframe(data, at)
                    i, ids = decode(payload)
                    row = (f, part, at, nxt - at, i, before, len(ids), zlib.crc32(ids.tobytes()))
                    found.append((*row, ids.tolist()) if with_ids else row)
                    at, before = nxt, before + len(ids)
                columns = list(zip(*found, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)],
                                                 schema=schema)

    ddl = ("file string, part long, offset long, length long, id long, before long, n_tokens long, ids_crc32 long"
           + (", ids array<long>" if with_ids else ""))
    return _files(spark, path).mapInArrow(run, ddl)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every record's place, checksum and ``start``, the number of ids before
    it, as read off the files. The running sum over files sees one row a file."""
    records = spark.read.parquet(f"{path}/index")
    totals = records.groupBy("file", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return records.join(base, "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of the index rows ``wanted`` (any subset, in any grouping),
    cut out by offset: id, ids."""
    places = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("at"))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def make(batch):
        got = [decode(unframe(data, at)[0]) for data, ats in
               zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for at in ats]
        return {"id": [i for i, _ in got], "ids": [ids.tolist() for _, ids in got]}

    return (_files(spark, path).join(places, "file").select("content", "at")
            .mapInArrow(lambda rows: batches(rows, make, schema), "id long, ids array<long>"))


def token_round_trip(docs: DataFrame, tokenizer_path: Callable[[], str], path: str | None = None,
                     **options) -> DataFrame:
    """Write the token files (into the shared scratch folder by default) and
    read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, **options)
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
