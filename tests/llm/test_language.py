"""Operator 8: held-out accuracy, margins, strange rows."""

import numpy as np

from cases import documents, edge_docs, edge_rows, empty_docs
from tagwright.llm.language import FAMILY_OF, features, fit_svm, known_language, label_languages, train_language_model


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = label_languages(docs)
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert got.where("score < 0 OR score > 1").count() == 0
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.select("doc_id", "held_out").collect())


def test_predictions_use_the_text_only(spark):
    docs = documents(spark)
    first = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in label_languages(docs).collect()}
    # held-out rows get other labels and sources: nothing may change
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'zz' ELSE lang END AS lang",
                              "'other' AS source").repartition(5)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in label_languages(changed).collect()} == first


def test_edge_rows(spark):
    got = label_languages(edge_docs(spark))
    rows = got.collect()
    assert len(rows) == len(edge_rows()) and {"key", "word"} <= set(got.columns)
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr", "de")
    kept = known_language(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert kept.where("text IS NULL").count() == 0


def test_empty_unlabelled_and_single_language(spark):
    assert label_languages(empty_docs(spark)).collect() == []
    docs = documents(spark)
    none = label_languages(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert none.where("lang_pred <> 'und' OR score <> 0").count() == 0
    one = label_languages(docs.selectExpr("doc_id", "text", "'xx' AS lang"))
    assert one.where("lang_pred <> 'xx' OR score <> 1").count() == 0


def test_machine_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.sign(x @ [1, -2, 0, .5, 0] + .3)
    w = fit_svm(x, y, cost=100)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_features_and_families():
    assert abs(np.linalg.norm(features("Some Words")) - 1) < 1e-6
    assert np.array_equal(features("SOME, words!"), features("some words"))
    assert FAMILY_OF["en"] == FAMILY_OF["de"] != FAMILY_OF["fr"] == FAMILY_OF["es"]


def test_rare_families_are_learned(spark):
    """Four languages of a family with two texts each, all drawn late: below the
    bound nothing is thinned, so the family is predicted."""
    words = {"hi": "नमस्ते दुनिया", "mr": "आहे आणि", "ne": "छ हुन्छ", "bn": "আমি তুমি", "en": "the house and water"}
    rows = [(i, f"{w} {w} {i}", x) for x, w in words.items() for i in range(40)]
    luck = "pmod(xxhash64(doc_id, text), 1 << 30) / double(1 << 30) AS luck"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", luck)
    late = docs.where("lang <> 'en' AND luck >= 0.3").selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY luck DESC) AS nr")
    few = late.where("nr <= 2").drop("nr").unionByName(docs.where("lang = 'en'"))
    model = train_language_model(few)
    assert {FAMILY_OF[model.predict(f"{words[x]} {words[x]}")[0]] for x in ("hi", "mr", "ne", "bn")} == {"indic"}
    assert model.predict("the water and the house")[0] == "en"
