"""Model answers, metrics and dominance."""

from pyspark.sql import functions as F

from tagwright.operators import evaluate as EV
from tagwright.operators import responses as RS


def test_classify_response(spark):
    df = spark.createDataFrame([("hawkish or dovish",), ("Dovish",), ("none",)], "r string")
    got = [r.x for r in df.select(RS.classify_response(F.col("r"), RS.FED_RULES).alias("x"))
           .collect()]
    assert got == ["hawkish", None, None]


def test_parse_json_response(spark):
    cases = [('```json\n{"EPU": 1}\n```', 1, True), ('{"EPU": 1', None, False), (None, None, False),
             ('{"EPU": 1} I think so', None, False), ("{'EPU': 1}", None, False), ('{"EPU": 1.0}', 1, True),
             ('{"EPU": "1"}', 1, True), ('{"EPU": "x"}', None, True), ('{"EPU": 1.5}', None, True), ('{"EPU": null}', None, True),
             ('[{"EPU": 1}]', None, False), ('{"A": {"EPU": 1}}', None, False), ('', None, False), ('  {"EPU": 0}\n', 0, True),
             ('{"EPU": 1}] foo [', None, False), ('{"EPU": 1}} {', None, False), ('{"EPU": 1}, {"EPU": 2}', None, False),
             ('"{\\"EPU\\": 1}"', None, False), ('{"EPU": 1,}', None, False), ('null', None, False), ('x {"EPU": 1}', None, False)]
    df = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(cases)], "i int, r string")
    p = RS.parse_json_response(RS.strip_json_fence(F.col("r")), "EPU")
    got = {r.i: r for r in df.select("i", p.alias("p")).select("i", "p.*").collect()}
    for i, (answer, value, ok) in enumerate(cases):
        assert (got[i].value, got[i].ok, got[i].typed) == (value, ok, value is not None), answer


def test_accuracy_counts_null_as_wrong(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a")], "p string, y string")
    r = EV.accuracy(df, "p", "y").first()
    assert (r.correct, r.total) == (1, 2)


def test_normalize_predictions(spark):
    preds = spark.createDataFrame(
        [("m1", 1, "0"), ("m1", 2, "1"), ("m1", 3, "2"), ("m2", 1, "0"), ("m2", 2, None),
         ("m3", 1, "dovish"), ("m3", 2, None)], "method string, k int, prediction string")
    codes = spark.createDataFrame([(0, "dovish"), (1, "hawkish"), (2, "neutral")],
                                  "code int, value string")
    got = {(r.method, r.k): r.prediction for r in
           EV.normalize_predictions(preds, codes, fill="neutral").collect()}
    assert got == {("m1", 1): "dovish", ("m1", 2): "hawkish", ("m1", 3): "neutral",
                   ("m2", 1): "dovish", ("m2", 2): "neutral",
                   ("m3", 1): "dovish", ("m3", 2): "neutral"}


def test_dominance_strict(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.4), ("c", 2, 0.5), ("d", 3, 0.3)],
                               "method string, num_params bigint, error_rate double")
    got = {r.method: r.dominated for r in EV.dominated_flag(df).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": False}
    got2 = {r.method: r.dominated for r in EV.dominated_by_join(df).collect()}
    assert got2 == got


# Published scoreboard of the 3-class study: accuracy and parameter counts
# (fixed values), and the published dominance flags.
GOLDEN = [
    ("Claude-3.5", 0.7309236947791165, 500000000000, True),
    ("Dictionary", 0.4497991967871486, 1, False),
    ("DistilBert", 0.8112449799196787, 66000000, False),
    ("Gemini 1.5", 0.6987951807228916, 600000000000, True),
    ("Gemma-2-9B", 0.678714859437751, 9000000000, True),
    ("GPT-3.5", 0.6626506024096386, 175000000000, True),
    ("GPT-4o", 0.7429718875502008, 1000000000000, True),
    ("Logistic Regression", 0.7991967871485943, 1200, False),
    ("Llama-3-8B", 0.7228915662650602, 8000000000, True),
]


def test_golden_dominance(spark):
    df = spark.createDataFrame([(n, a, p) for n, a, p, _ in GOLDEN],
                               "method string, accuracy double, num_params bigint")
    df = df.withColumn("error_rate", 1 - F.col("accuracy"))
    got = {r.method: r.dominated for r in EV.dominated_flag(df).collect()}
    assert got == {n: d for n, _, _, d in GOLDEN}
    assert {r.method for r in EV.pareto_frontier(df).collect()} == {
        "Dictionary", "DistilBert", "Logistic Regression"}


def test_macro_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")],
                               "p string, y string")
    r = EV.macro_metrics(df, "p", "y").first()
    # classes a, b, c: precision 0.5, 1, 0; recall 1, 1/3, 0
    assert r.macro_precision == round(1.5 / 3, 6)
    assert r.macro_recall == round((1 + 1 / 3) / 3, 6)
    assert r.accuracy == 0.5


def test_scorer_keeps_keys(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "k int, text string")
    got = {r.k: r.response for r in RS.score_with_model(df, ["k"], "text").collect()}
    assert got == {1: '{"n_words": 3}', 2: '{"n_words": 0}'}


def test_prediction_folder_golden_shape(spark, tmp_path):
    """Files shaped like the published prediction files: one string-valued
    method, one integer-coded method, one with a missing answer."""
    from tagwright.sources.files import read_prediction_files
    rows = {"dictionary": "ID,prediction\n80_3,neutral\n81_0,hawkish\n82_1,dovish\n",
            "lr": "ID,prediction\n80_3,2\n81_0,1\n82_1,0\n",
            "gemma-2-9b-it": "ID,prediction\n80_3,neutral\n81_0,\n82_1,dovish\n"}
    for name, body in rows.items():
        (tmp_path / f"fed_tagged_{name}.csv").write_text(body)
    (tmp_path / "fed_compare.csv").write_text("ignored\n")
    preds = read_prediction_files(spark, str(tmp_path), "fed", "ID string, prediction string")
    preds = preds.withColumnRenamed("ID", "id")
    codes = spark.createDataFrame([(0, "dovish"), (1, "hawkish"), (2, "neutral")],
                                  "code int, value string")
    norm = EV.normalize_predictions(preds, codes, fill="neutral")
    got = {(r.method, r.id): r.prediction for r in norm.collect()}
    assert got[("lr", "80_3")] == "neutral" and got[("lr", "82_1")] == "dovish"
    assert got[("gemma-2-9b-it", "81_0")] == "neutral"
    assert len(got) == 9
    truth = spark.createDataFrame([("80_3", "neutral"), ("81_0", "hawkish"), ("82_1", "dovish")],
                                  "id string, label string")
    acc = {r.method: r.correct for r in EV.accuracy(
        EV.common_keys(norm, ["id"]).join(truth, "id"), "prediction", "label", ["method"]).collect()}
    assert acc == {"dictionary": 3, "lr": 3, "gemma-2-9b-it": 2}


def test_default_stop_words_are_removed(spark):
    from tagwright.operators import features as FE
    df = spark.createDataFrame([("The cat and the Hat-Trick café",)], "t string")
    assert df.select(FE.tokens(F.col("t")).alias("x")).first().x == ["cat", "hat-trick", "cafe"]
    assert df.select(FE.tokens(F.col("t"), ()).alias("x")).first().x[0] == "the"


def test_dominance_of_fractional_sizes_and_ties(spark):
    rows = [("a", 1.0, 0.5), ("b", 1.5, 0.6), ("c", 1.5, 0.4), ("d", 2.0, 0.4), ("e", None, 0.9), ("f", 2.5, None), ("g", 0.5, 0.7)]
    df = spark.createDataFrame(rows, "method string, num_params double, error_rate double")
    expected = {m: any(q is not None and p is not None and q < p and f is not None and e is not None and f < e
                       for _, q, f in rows) for m, p, e in rows}
    for flagged in (EV.dominated_flag(df), EV.dominated_by_join(df)):
        assert {r.method: r.dominated for r in flagged.collect()} == expected


def test_scoreboard_scans_the_texts_once(spark):
    from tagwright.plans import scoring_queries as SQ
    df = SQ.predictions(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1


def test_wide_predictions_multiply_duplicate_keys(spark):
    """Equal to the chain of inner joins, duplicate and null keys included."""
    import itertools
    import random
    rng = random.Random(2)
    methods = ["a", "b", "c", "d"]
    rows = [(rng.choice(methods), rng.choice([None, *range(12)]), rng.choice(["x", "y", "z", None])) for _ in range(150)]
    rows += [("other", 1, "w"), ("a", 99, "alone")]
    df = spark.createDataFrame(rows, "method string, id int, prediction string")
    expected = []
    for key in range(12):
        own = [[p for m, k, p in rows if (m, k) == (name, key)] for name in methods]
        expected += [(key, *combination) for combination in itertools.product(*own)]
    got = [tuple(r) for r in EV.predictions_wide(df, ["id"], methods).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected)) and len(got) > 300
    assert EV.predictions_wide(df.limit(0), ["id"], methods).collect() == []
