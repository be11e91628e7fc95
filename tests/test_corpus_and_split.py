"""Votes, splits, quotas."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagwright.operators import corpus as CO
from tagwright.operators import split as SP

SF = "/root/testdata/sf0.01"


def test_majority_vote_edges(spark):
    v = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (2, 0), (3, 0)], "k int, v int")
    got = {r.k: r.label for r in CO.majority_vote(v, ["k"], "v").collect()}
    assert got == {2: 1, 3: 0}


def test_vote_then_attach(spark):
    v = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "k int, v int")
    assert CO.vote_then_attach(v, ["k"], "v", v).count() == 2
    assert CO.vote_then_attach(v, ["k"], "v", v, one_row_per_article=True).count() == 1


def test_quotas_largest_remainder(spark):
    rows = [("de", 129), ("en", 620), ("es", 106), ("fr", 145)]
    q = SP.stratum_quotas(spark.createDataFrame(rows, "lang string, n_s long"), ["lang"], 0.2)
    assert {r.lang: r.quota for r in q.collect()} == {"de": 26, "en": 124, "es": 21, "fr": 29}
    rows = [(None, 10 ** 11 + 1), ("x", 7), ("y", 10 ** 10)]
    q = SP.stratum_quotas(spark.createDataFrame(rows, "s string, n_s long"), ["s"], 0.3)
    n = sum(r[1] for r in rows)
    assert sum(r.quota for r in q.collect()) == -(-3 * n // 10)
    many = spark.range(150_000).selectExpr("id AS s", "1L AS n_s")
    assert SP.stratum_quotas(many, ["s"], 0.2).agg(F.sum("quota")).first()[0] == 30_000


def test_splits_keep_nulls_and_ties(spark):
    rows = [(i if i % 5 else None, None if i % 4 == 0 else f"s{i % 3}", i % 2) for i in range(60)] + [(7, "s1", 1)] * 3
    d = spark.createDataFrame(rows, "k int, s string, y int")
    t = SP.train_test_split(d, "k", test_size=0.3)
    assert t.count() == len(rows) and t.where("split = 'test'").count() in range(19, 23)
    assert sorted(map(repr, (r[:3] for r in t.collect()))) == sorted(map(repr, rows))
    again = SP.train_test_split(d.repartition(7), "k", test_size=0.3)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, t.collect()))
    st = SP.stratified_split(d, ["k", "y"], "s")
    assert st.count() == len(rows) and st.where("s IS NULL AND split = 'test'").count() >= 2
    assert SP.stratified_folds(d, "k", "s").count() == len(rows)
    assert SP.rank_within(d, "k", 92, ["s"], digits=1).where("s IS NULL").count() == 15
    whole = SP.train_test_split(d, "k", test_size=0.3, split_unit="article")
    sides = whole.groupBy("k").agg(F.count_distinct("split").alias("n"))
    assert sides.where("n > 1").count() == 0
    keys = len({r[0] for r in rows})
    assert whole.where("split = 'test'").select("k").distinct().count() == -(-3 * keys // 10)
    assert SP.train_test_split(d.limit(0), "k").collect() == []
    assert SP.stratified_split(d.limit(0), "k", "s").collect() == []


def test_cut_is_refined_beyond_one_histogram(spark, monkeypatch):
    monkeypatch.setattr(SP, "SORTED_ROWS", 1)
    monkeypatch.setattr(SP, "DIGITS", 1)
    d = spark.range(700).selectExpr("id AS k", "id % 3 AS s")
    for t, n in ((SP.train_test_split(d, "k"), 140), (SP.stratified_split(d, "k", "s"), 140)):
        w = Window.orderBy(SP.hash_key("k", 92), "k")
        assert t.where("split = 'test'").count() == n
    plain = d.withColumn("r", F.row_number().over(w))
    j = SP.train_test_split(d, "k").join(plain, ["k", "s"])
    assert j.where("(r <= 140) <> (split = 'test')").count() == 0


def test_split_does_not_shuffle_the_payload(spark):
    d = spark.range(50).selectExpr("id AS k", "id % 2 AS s", "repeat('x', 100) AS payload")
    plan = SP.train_test_split(d, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = SP.stratified_split(d, "k", "s")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_stratified_split_at_sf001(spark):
    from tagwright.sources.tables import read_table
    d = read_table(spark, SF, "documents", ["doc_id", "lang"])
    s = SP.stratified_split(d, "doc_id", "lang", 92, 0.2)
    got = {r.lang: r.n for r in s.where("split = 'test'").groupBy("lang").agg(
        F.count("*").alias("n")).collect()}
    assert got == {"de": 26, "en": 124, "es": 21, "fr": 29}


def test_rank_within_equals_plain_window(spark):
    from tagwright.sources.tables import read_table
    d = read_table(spark, SF, "documents", ["doc_id", "lang"])
    r = SP.rank_within(d, "doc_id", 92, ["lang"], digits=1)
    w = Window.partitionBy("lang").orderBy(SP.hash_key("doc_id", 92), "doc_id")
    plain = d.withColumn("rank2", F.row_number().over(w) - 1)
    j = r.join(plain, ["doc_id", "lang"])
    assert j.where("rank <> rank2").count() == 0 and j.count() == d.count()


def test_votes_at_sf001(spark):
    from tagwright.plans import QUERIES
    got = {r.label: r.n for r in QUERIES["majority_vote"](spark, SF).groupBy("label").agg(
        F.count("*").alias("n")).collect()}
    assert got == {1: 1149, 0: 2096}


def test_histogram_no_rows_lost(spark):
    from tagwright.plans import QUERIES
    h = QUERIES["word_count_histogram"](spark, SF)
    assert h.agg(F.sum("n")).first()[0] == 1000
    assert {r.bin for r in h.collect()} <= set(range(10))
