"""Operator 11 against exhaustive edits and the whole chart of spans."""

import hashlib
import random
import re
import zlib

import __spark_entry__ as E
from cases import SF
from tagwright.llm import conversation_repair as R

LEGAL = re.compile(r"(s?(ua)+)?")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """{conv: damaged rows in order} of the contract."""
    out = {}
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if lot == 4 else role, text)] * {0: 0, 3: 2}.get(lot, 1))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(v, key=order) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Every edit of every row with up to two insertions anywhere, by initials so far."""
    best = {"": (0, "", ())}

    def put(into, initials, value):
        if initials not in into or value < into[initials]:
            into[initials] = value

    def with_insertions(states):
        for _ in range(2):
            for k, (c, a, lines) in list(states.items()):
                for name in ("user", "assistant"):
                    if any(LEGAL.fullmatch(k + name[0] + end) for end in ("", "a")):
                        put(states, short(k + name[0]), (c + 5, a + "I", (*lines, f"{name}:")))
        return states

    def short(k):
        return k if len(k) <= 3 else "ua" if k[-1] == "a" else "uau"      # the same continuations

    for (_, role, text), mark in zip(rows, marks, strict=True):
        into = {}
        for k, (c, a, lines) in with_insertions(best).items():
            put(into, k, (c + 2, a + "D", lines))
            if mark in ("blank", "duplicate"):
                continue
            extra = 5 * (mark == "truncated")
            for kind, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                if name and any(LEGAL.fullmatch(k + name[0] + end) for end in ("", "a", "ua")):
                    put(into, short(k + name[0]), (c + price + extra, a + kind, (*lines, f"{name}:{text}")))
        best = into
    return min(v for k, v in with_insertions(best).items() if LEGAL.fullmatch(k))


def expected(rows):
    out = []
    for conv, own in damaged(rows).items():
        marks = faults(own)
        turns = [t for t, *_ in own if t is not None]
        cost, audit, lines = cheapest(own, marks)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def strained(seed=5):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t\n", "What?", None, "a.\n ", "b!", "c", "é…", ".", "nul \x00."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "ubuntu"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts))
            for c in range(120) for t in range(rng.randrange(1, 9)) for _ in range(1 + (rng.random() < 0.15))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(9)]
    rows += [(900, t, rng.choice(roles[:5]), f"{t}{rng.choice(texts)}") for t in range(700)]       # a long conversation
    rows += [(901, 3, "user", "the same.")] * 300 + [(902, None, None, None)] * 5
    rows += [(903, 10 ** 12, "user", "far."), (903, -5, "assistant", "near.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, times long")


def repaired(df):
    rows = R.damage(df.select("conv_id", "turn", "role", "text"))
    return sorted((tuple(r) for r in R.repair_conversations(rows, times_col="times").select(COLUMNS).collect()), key=repr)


def test_driver_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = E.queries()["op11_repair_conversations"](spark, SF).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected([tuple(r) for r in rows])


def test_strained_rows(spark):
    assert repaired(frame(spark, strained())) == expected(strained())


def test_conversations_over_many_ranges(spark, monkeypatch):
    """One conversation cut into many spans, joined in several rounds."""
    monkeypatch.setattr(R, "FAN", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [r for r in strained(6) if r[0] in (900, 901, 3, None)]
        assert repaired(frame(spark, rows)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_without_damage_and_other_names(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "Thread long, audit long, kind string, body string, extra string")
    names = {"conv_col": "Thread", "turn_col": "audit", "role_col": "kind", "text_col": "body"}
    audits = R.audit_conversations(df, **names)
    assert [tuple(r) for r in audits.collect()] == [(1, 0, 0, 0, 1, 1, 3, "RKD")]
    audits = spark.createDataFrame([(1, "KIKD")], "Thread long, audit string")
    out = R.repaired_rows(df, audits, **names).collect()
    assert [tuple(r) for r in out] == [(1, 1, "K", 0, "system", "Be kind."), (1, 2, "I", None, "user", ""),
                                       (1, 3, "K", 1, "assistant", "Hello.")]


def test_empty_table(spark):
    assert repaired(frame(spark, [])) == []


def test_every_cut_gives_the_same_cell():
    """The whole chart: each span has one cell, wherever it is cut."""
    rng = random.Random(1)
    for _ in range(30):
        leaves = [R.row_cell(rng.choice("suax"), *rng.choice([(False, False), (True, False), (False, True)])) for _ in range(9)]
        chart = {(i, i + 1): leaf for i, leaf in enumerate(leaves)}
        for n in range(2, 10):
            for i in range(10 - n):
                cells = [R.join(chart[i, k], chart[k, i + n]) for k in range(i + 1, i + n)]
                assert all(c == cells[0] for c in cells)
                chart[i, i + n] = cells[0]
        assert R.join_all(leaves) == chart[0, 9]
        assert R.repeated(leaves[0], 5) == R.join_all([leaves[0]] * 5)
