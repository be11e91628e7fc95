"""Conversation structure repair by weighted interval parsing (operator 11).

A conversation is legal if its role initials read ``(s?(ua)+)?``. Rows are kept
(K, no cost), given another role (R), deleted (D), and rows without text are
inserted (I); the cheapest edits that make it legal are found, among equally
cheap ones those whose letters come first in ASCII.

The repair grammar is in Chomsky normal form: nonterminal ``[p, q]`` derives
the spans of rows that lead from place ``p`` of a legal conversation to place
``q``, by the rules ``[p, q] -> [p, r] [r, q]``, and, for one row, by its edits
with any insertions before and after it (the insertion closure). A span's cell
holds the least ``(cost, audit)`` per nonterminal; cells are combined bottom-up
by span length. Cutting a span anywhere gives the same cell, because the rules
hold for every ``r`` and equally cheap audits of a span never begin one
another (they have as many letters that stand for rows, so one that begins
another has fewer insertions and costs less). So each span needs one cut, and
spans of 1, 2, 4, ... rows, joined with their neighbours, are the whole chart.

In Spark: rows, without their texts, are sorted by ranges of conversation and
turn; each task parses the spans that lie in its range; spans of conversations
that cross a range are joined in a tree of ``FAN`` at a time. So a
conversation of any length is parsed by many tasks. Texts move once, to be
written in order behind their conversation's audit, one row at a time.

Defined results: null roles and texts count as one blank; null conversation
ids are one conversation; rows are taken by turn, nulls first, rows of one
turn by role and then by the SHA-256 of their text; equal rows of a
conversation are duplicates of the first; roles keep their case, an empty role
has no initial and is not legal; a row that occurs 0 times (``times_col``)
names its conversation only; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ROWS_AT_ONCE, col, materialize, small_batches

# The places of a legal conversation, what each role's initial
# leads to, the places where it may end, the roles to give or insert, costs.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

BLANKS = " \t\n\x0b\f\r"
FAN = 32        # spans of one conversation that are joined at once

#: Nonterminals that derive anything: no place leads back to the first two.
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q >= USER or (p, q) == (START, SYSTEM)]
_AT = {pair: i for i, pair in enumerate(PAIRS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in PAIRS]

Cell = list     # per nonterminal (cost, audit), or None


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for cuts in RULES:
        best = None
        for i, j in cuts:
            x, y = left[i], right[j]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                if best is None or cost < best[0]:
                    best = cost, x[1] + y[1]
                elif cost == best[0] and (audit := x[1] + y[1]) < best[1]:
                    best = cost, audit
        out.append(best)
    return out


def _either(x, y):
    return min((z for z in (x, y) if z is not None), default=None)


def _closure() -> Cell:
    """Any insertions and nothing else."""
    once = [(0, "") if p == q else None for p, q in PAIRS]
    for (p, initial), q in STEP.items():
        if initial in "ua":
            once[_AT[p, q]] = _either(once[_AT[p, q]], (INSERT, "I"))
    cell = once
    while (more := join(cell, once)) != cell:
        cell = more
    return cell


NOTHING = _closure()


def row_cell(initial: str, delete: bool, truncated: bool) -> Cell:
    """One row: deleted, kept or given a role, with insertions around it."""
    cell: Cell = [(DELETE, "D") if p == q else None for p, q in PAIRS]
    if not delete:
        extra = TRUNCATED if truncated else 0
        for (p, i), q in STEP.items():
            if i == initial:
                cell[_AT[p, q]] = _either(cell[_AT[p, q]], (extra, "K"))
            if i in "ua":
                cell[_AT[p, q]] = _either(cell[_AT[p, q]], (REROLE + extra, "R"))
    return join(join(NOTHING, cell), NOTHING)


def join_all(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, shorter ones first."""
    while len(cells) > 1:
        cells = [join(*cells[k:k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0] if cells else NOTHING


def repeated(cell: Cell, times: int) -> Cell:
    """The cell of ``times`` equal spans in a row."""
    out = NOTHING
    while times:
        if times & 1:
            out = join(out, cell)
        cell, times = (join(cell, cell) if times > 1 else cell), times >> 1
    return out


def whole(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a conversation."""
    return min(x for q in ENDS if (x := cell[_AT[START, q]]) is not None)


class Span:
    """Counts and cell of neighbouring rows of one conversation."""

    __slots__ = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "cell")

    def __init__(self, **values):
        for name in self.__slots__:
            setattr(self, name, values.get(name))

    @staticmethod
    def of_row(turn, initial: str, fault: str, fresh: bool, times: int, leaf) -> Span | None:
        """``times`` equal rows; all but the first of fresh ones are duplicates."""
        if not times:
            return None
        fault = fault if fault == "blank" or fresh else "duplicate"
        cell = leaf(initial, fault in ("blank", "duplicate"), fault == "truncated")
        rest = times - 1
        if rest:
            again = leaf(initial, True, False)
            cell = join(cell, repeated(again, rest))
        blank = times if fault == "blank" else 0
        return Span(blank=blank, duplicate=0 if blank else rest + (fault == "duplicate"),
                    truncated=int(fault == "truncated"), illegal=rest * (initial + initial not in LEGAL_PAIRS),
                    first=initial, last=initial, low=turn, high=turn, turns=int(turn is not None), cell=cell)

    @staticmethod
    def joined(spans: list[Span]) -> Span | None:
        """Spans in order as one: None if there is none."""
        if len(spans) < 2:
            return spans[0] if spans else None
        pairs = list(zip(spans, spans[1:], strict=False))
        lows = [s.low for s in spans if s.low is not None]
        highs = [s.high for s in spans if s.high is not None]
        return Span(blank=sum(s.blank for s in spans), duplicate=sum(s.duplicate for s in spans),
                    truncated=sum(s.truncated for s in spans),
                    illegal=sum(s.illegal for s in spans) + sum(a.last + b.first not in LEGAL_PAIRS for a, b in pairs),
                    first=spans[0].first, last=spans[-1].last, low=min(lows, default=None), high=max(highs, default=None),
                    turns=sum(s.turns for s in spans) - sum(a.high is not None and a.high == b.low for a, b in pairs),
                    cell=join_all([s.cell for s in spans]))


COUNTS = "blank long, duplicate long, truncated long, illegal long"
SPAN_DDL = f"{COUNTS}, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"
DONE_DDL = f"gaps long, {COUNTS}, cost long, audit string"
DONE = [part.split()[0] for part in DONE_DDL.split(", ")]


def _span_values(s: Span | None) -> list:
    if s is None:
        return [0, 0, 0, 0, None, None, None, None, 0, None, None]
    return [s.blank, s.duplicate, s.truncated, s.illegal, s.first, s.last, s.low, s.high, s.turns,
            [-1 if x is None else x[0] for x in s.cell], ["" if x is None else x[1] for x in s.cell]]


def _span_of(values: list) -> Span | None:
    *own, costs, audits = values
    if costs is None:
        return None
    names = Span.__slots__[:-1]
    return Span(**dict(zip(names, own, strict=True)),
                cell=[None if c < 0 else (c, a) for c, a in zip(costs, audits, strict=True)])


def _done_values(s: Span | None) -> list:
    if s is None:
        return [0, 0, 0, 0, 0, *whole(NOTHING)]
    gaps = 0 if s.low is None else s.high - s.low + 1 - s.turns
    return [gaps, s.blank, s.duplicate, s.truncated, s.illegal, *whole(s.cell)]


def _named(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, times_col: str | None) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(" "))
    return rows.select(col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"),
                       F.coalesce(col(role_col), F.lit(" ")).alias("role"), text.alias("text"),
                       F.unhex(F.sha2(text, 256)).alias("digest"),
                       (F.lit(1) if times_col is None else col(times_col)).cast("long").alias("times"))


def _fault(text: Column) -> Column:
    ended = F.rtrim(text, F.lit(BLANKS))
    return (F.when(ended == "", "blank").when(F.substring(ended, -1, 1).isin(".", "!", "?"), "")
            .otherwise("truncated"))


def audit_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text", times_col: str | None = None) -> DataFrame:
    """One row a conversation: its id, ``gaps`` (missing turn numbers), rows by
    first fault (``blank, duplicate, truncated``), ``illegal`` (neighbouring
    roles that may not meet), ``cost`` and ``audit`` of the cheapest repair."""
    spark = rows.sparkSession
    small_batches(spark)
    named = _named(rows, conv_col, turn_col, role_col, text_col, times_col)
    # equal rows are counted before they move; texts stay behind
    counted = materialize(named.groupBy("conv", "turn", "role", "digest", _fault(F.col("text")).alias("fault"))
                          .agg(F.sum("times").alias("times")), "conversation-rows")
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    again = (counted.where("times > 0 AND fault <> 'blank'").groupBy("conv", "role", "digest")
             .agg(F.count("*").alias("seen"), F.min(order).alias("earliest")).where("seen > 1")
             .select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "earliest"))
    marked = (counted.join(again, counted["conv"].eqNullSafe(again["_conv"]) & (F.col("role") == F.col("_role"))
                           & (F.col("digest") == F.col("_digest")), "left")
              .select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "fault", "times",
                      (F.col("earliest").isNull() | F.col("earliest").eqNullSafe(order)).alias("fresh")))
    ranged = marked.repartitionByRange("conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")

    conv = T.StructField("conv", rows.schema[conv_col].dataType)
    edge = T.StructType([conv, *T.StructType.fromDDL("turn long, role string, digest binary").fields,
                         *T.StructType.fromDDL(SPAN_DDL).fields, *T.StructType.fromDDL(DONE_DDL.replace(COUNTS, "x long")).fields])
    edge = T.StructType([f for f in edge.fields if f.name != "x"])
    arrow = to_arrow_schema(edge)

    def parse(it):
        leaves: dict = {}

        def leaf(*key):
            if key not in leaves:
                leaves[key] = row_cell(*key)
            return leaves[key]

        def packed(conv, key, spans, inside):
            s = Span.joined(spans)
            if inside:
                done = _done_values(s)
                return [conv, *key, *done[1:5], *[None] * 7, done[0], *done[5:]]
            return [conv, *key, *_span_values(s), None, None, None]

        now, key, spans, first, out = None, None, [], True, []
        for batch in it:
            for c, turn, role, digest, initial, fault, times, fresh in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key is None or c != now:
                    if key is not None:
                        out.append(packed(now, key, spans, not first))
                        first = False
                    now, key, spans = c, (turn, role, digest), []
                span = Span.of_row(turn, initial, fault, fresh, times, leaf)
                if span is not None:
                    spans.append(span)
                if len(spans) > ROWS_AT_ONCE:       # a long conversation's spans stay few
                    spans = [Span.joined(spans)]
            if len(out) > ROWS_AT_ONCE:
                yield _batch(out, arrow)
                out = []
        if key is not None:
            out.append(packed(now, key, spans, False))
        if out:
            yield _batch(out, arrow)

    parsed = materialize(ranged.mapInArrow(parse, edge), "conversation-spans")
    inside = parsed.where("audit IS NOT NULL").select("conv", *DONE)
    crossing = _joined_spans(parsed.where("audit IS NULL").drop("gaps", "cost", "audit"), conv)
    return inside.unionByName(crossing).select(F.col("conv").alias(conv_col), *DONE)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def _joined_spans(spans: DataFrame, conv: T.StructField) -> DataFrame:
    """Spans at the ends of ranges (two a task at most) as whole conversations:
    a tree of joins of ``FAN`` neighbouring spans. A window numbers a
    conversation's spans, which are no more than the tasks that parsed it."""
    from pyspark.sql import Window
    order = Window.partitionBy("conv").orderBy("turn", "role", "digest")
    names = [f.name for f in T.StructType.fromDDL(SPAN_DDL)]
    slots = spans.withColumn("slot", F.row_number().over(order) - 1)
    span_schema = T.StructType([conv, T.StructField("slot", T.LongType()), *T.StructType.fromDDL(SPAN_DDL).fields])
    done_schema = T.StructType([conv, *T.StructType.fromDDL(DONE_DDL).fields])
    span_arrow, done_arrow = to_arrow_schema(span_schema), to_arrow_schema(done_schema)

    def joined(group: pa.Table) -> Span | None:
        rows = sorted(zip(*(group[c].to_pylist() for c in ["slot", *names]), strict=True), key=lambda r: r[0])
        return Span.joined([s for r in rows if (s := _span_of(list(r[1:]))) is not None])

    def up(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch([[group["conv"][0].as_py(), key[1].as_py(), *_span_values(joined(group))]], span_arrow)])

    def end(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch([[group["conv"][0].as_py(), *_done_values(joined(group))]], done_arrow)])

    now = slots.select("conv", F.col("slot").cast("long").alias("slot"), *names)
    while True:
        now = materialize(now, "crossing-spans")
        top = now.agg(F.max("slot")).first()[0]
        if top is None or top < FAN:
            break
        now = now.groupBy("conv", F.expr(f"slot div {FAN}").alias("slot_up")).applyInArrow(up, span_schema)
    return now.groupBy("conv").applyInArrow(end, done_schema)


def repaired_rows(rows: DataFrame, audits: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text", times_col: str | None = None) -> DataFrame:
    """The repaired conversations, as ``audits`` has them: the conversation's
    id, ``position`` (from 1), ``edit`` (K, R or I), ``turn`` (null where
    inserted), ``role, text``. Each conversation's rows stand together and in
    order; a task holds one audit and a batch of rows at a time."""
    spark = rows.sparkSession
    small_batches(spark)
    named = _named(rows, conv_col, turn_col, role_col, text_col, times_col).where("times > 0")
    lists = audits.where("audit <> ''").select(
        col(conv_col).alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
        F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("times"))
    dealt = (lists.unionByName(named).withColumn("kind", F.when(F.col("times") == 0, 0).otherwise(1))
             .repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest"))
    schema = T.StructType([T.StructField(conv_col, rows.schema[conv_col].dataType),
                           *T.StructType.fromDDL("position long, edit string, turn long, role string, text string").fields])
    arrow = to_arrow_schema(schema)

    def write(it):
        out: list[list] = []
        audit, at, place, position = "", 0, START, 0

        def put(conv, edit, turn, role, text):
            nonlocal place, position
            place, position = STEP[place, role[:1]], position + 1
            out.append([conv, position, edit, turn, role, text])

        def inserted(conv):
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(conv, "I", None, _role_after(place), "")
                at += 1

        for batch in (b.slice(k, ROWS_AT_ONCE) for b in it for k in range(0, len(b), ROWS_AT_ONCE)):
            for conv, kind, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    audit, at, place, position = text, 0, START, 0
                    continue
                inserted(conv)
                for _ in range(times):
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        put(conv, edit, turn, role if edit == "K" else _role_after(place), text)
                    inserted(conv)
            if out:
                yield _batch(out, arrow)
                out = []

    return dealt.select("conv", "kind", "turn", "role", "text", "times").mapInArrow(write, schema)


def _role_after(place: int) -> str:
    return "assistant" if place == USER else "user"


def conversation_digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` lines, read in the
    order that ``repaired_rows`` leaves in its partitions (no shuffle)."""
    schema = T.StructType([repaired.schema[conv_col], T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def digest(it):
        now, sha = None, None
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in it for k in range(0, len(b), ROWS_AT_ONCE)):
            out = []
            for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 1:
                    if sha is not None:
                        out.append([now, sha.hexdigest()])
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if out:
                yield _batch(out, arrow)
        if sha is not None:
            yield _batch([[now, sha.hexdigest()]], arrow)

    return repaired.select(col(conv_col), "position", "role", "text").mapInArrow(digest, schema)


def repair_conversations(rows: DataFrame, *, conv_col: str = "conv_id", **columns) -> DataFrame:
    """``audit_conversations`` and ``repaired_sha256``, the digest of the
    repaired conversation (of nothing if no row is left)."""
    audits = materialize(audit_conversations(rows, conv_col=conv_col, **columns), "conversation-audits")
    digests = conversation_digests(repaired_rows(rows, audits, conv_col=conv_col, **columns), conv_col)
    digests = digests.select(col(conv_col).alias("_conv"), "repaired_sha256")
    return (audits.join(digests, audits[conv_col].eqNullSafe(digests["_conv"]), "left").drop("_conv")
            .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))))


def damage(rows: DataFrame) -> DataFrame:
    """The contract's test damage to ``conv_id, turn, role, text``, by crc32 of
    ``conv_id:turn`` mod 20: 0 drops the row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes it the user's; ``times`` says how
    often a row occurs afterwards."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    lot = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(role).alias("role"),
                       F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("times"))
