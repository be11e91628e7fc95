"""Scoring that is broken off and run again."""

import json
import os
import uuid

import pytest

from tagwright.operators import responses as RS


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def asked(log):
    return [json.loads(line) for name in os.listdir(log) for line in open(os.path.join(log, name))]


def logging_scorer(log, broken=(), bad=()):
    """Answers with the text's length; raises a fatal error on ``broken`` texts and
    an ordinary one on ``bad`` texts; writes down every call."""
    def factory():
        name = os.path.join(log, uuid.uuid4().hex)

        def score(texts):
            if any(t in broken for t in texts):
                raise SystemExit("worker lost")
            with open(name, "a") as f:
                f.writelines(json.dumps(t) + "\n" for t in texts)
            if any(t in bad for t in texts):
                raise OSError("request failed")
            return [str(len(t or "")) for t in texts]
        return score
    return factory


def table(spark, n=60):
    return spark.createDataFrame([(i, f"text {i}") for i in range(n)] + [(None, "no key")], "id int, text string")


def test_a_broken_run_is_taken_up(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    df = table(spark)
    with pytest.raises(Exception):
        RS.score_resumable(df, ["id"], "text", store, logging_scorer(str(log), broken={"text 33"}), wait=0)
    before = asked(log)
    got = RS.score_resumable(df, ["id"], "text", store, logging_scorer(str(log)), wait=0)
    assert rows_of(got.select("id", "response", "status")) == sorted(((r["id"], str(len(r["text"])), "ok") for r in df.collect()), key=repr)
    done = asked(log)
    assert 0 < len(before) < 61 and len(done) < 61 + 20      # only the slice that broke is asked again
    RS.score_resumable(df, ["id"], "text", store, logging_scorer(str(log)), wait=0).collect()
    assert len(asked(log)) == len(done)                      # nothing is left to ask


def test_failed_rows_do_not_take_other_answers(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    df = table(spark, 30)
    bad = {"text 3", "text 17"}
    got = RS.score_resumable(df, ["id"], "text", store, logging_scorer(str(log), bad=bad), retries=1, wait=0)
    for r in got.join(df, "id").collect():
        assert (r["response"], r["status"]) == ((None, "failed") if r["text"] in bad else (str(len(r["text"])), "ok"))
        assert r["attempts"] >= (2 if r["text"] in bad else 1)
    again = RS.score_resumable(df, ["id"], "text", store, logging_scorer(str(log)), wait=0)
    assert again.where("status = 'ok'").count() == 31


def test_repeated_keys_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, None, "yy"), (2, None, None)], "id int, part string, text string")
    got = RS.score_resumable(df, ["id", "part"], "text", str(tmp_path / "s"), wait=0)
    assert got.count() == 4 and got.where("status = 'ok'").count() == 4
    assert RS.score_resumable(df.limit(0), ["id"], "text", str(tmp_path / "e"), wait=0).collect() == []
