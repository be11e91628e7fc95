"""Registered queries for bag of words and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classify as CL
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import paths as PA
from ..operators import split as SP
from ..session import materialize, scratch_path
from ..sources import files as FS
from ..sources.tables import read_table
from . import fixtures as FX
from . import sqlbits as SB
from .registry import register


def doc_tokens(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", FE.tokens(F.col("text"), FX.STOP_WORDS).alias("tokens"))


def split_docs(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id"])
    return SP.train_test_split(d, "doc_id", FX.SEED, FX.TEST_SHARE)


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in FX.STOP_WORDS) + "]"
TOKENS_SQL = (r"list_filter(regexp_extract_all(regexp_replace(strip_accents(lower(coalesce(text, ''))), "
              r"'[^\x00-\x7F]', '', 'g'), '\w+(?:-\w+)*'), lambda w: NOT list_contains("
              + STOP_SQL + ", w))")
SPLIT_SQL = f"""SELECT doc_id, CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {SB.md5_key(FX.SEED, 'doc_id')}, doc_id) - 1 AS rk,
  count(*) OVER () AS n FROM documents)"""
TOK_SQL = f"SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents"
VOCAB_SQL = f"""SELECT term, count(*) AS n FROM (
  SELECT unnest(t.tokens) AS term FROM ({TOK_SQL}) t JOIN ({SPLIT_SQL}) s ON t.doc_id = s.doc_id
  WHERE s.split = 'train') GROUP BY term ORDER BY n DESC, term LIMIT {FX.VOCAB_SIZE}"""


@register("bow_tokenize", op="M1", sql=f"""
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens
FROM ({TOK_SQL})
""")
def q_bow_tokenize(spark, sf):
    t = doc_tokens(spark, sf)
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


def split_tokens(spark, sf, part: str):
    """Tokens of one side of the split: the split (ids only) is joined first
    so that only that side's texts are tokenised."""
    d = read_table(spark, sf, "documents", ["doc_id", "text"]).join(
        split_docs(spark, sf).where(F.col("split") == part), "doc_id", "left_semi")
    return d.select("doc_id", FE.tokens(F.col("text"), FX.STOP_WORDS).alias("tokens"))


def train_vocab(spark, sf):
    return FE.vocabulary(split_tokens(spark, sf, "train"), "tokens", FX.VOCAB_SIZE)


@register("vocabulary_topk", op="M2", sql=VOCAB_SQL)
def q_vocabulary_topk(spark, sf):
    return train_vocab(spark, sf)


DTM_SQL = f"""SELECT t.doc_id, w.term, count(*) AS n FROM (
  SELECT doc_id, unnest(tokens) AS term FROM ({TOK_SQL})) t
  JOIN ({SPLIT_SQL}) s ON t.doc_id = s.doc_id AND s.split = 'test'
  JOIN ({VOCAB_SQL}) w ON t.term = w.term GROUP BY t.doc_id, w.term"""


def test_dtm(spark, sf, binary=False):
    vocab = train_vocab(spark, sf)
    return FE.document_term_long(split_tokens(spark, sf, "test"), "doc_id", vocab, binary=binary)


@register("document_term_matrix", op="M3", sql=DTM_SQL)
def q_document_term_matrix(spark, sf):
    return test_dtm(spark, sf)


@register("document_term_binary", op="M4", sql=f"""
SELECT doc_id, term, CAST(least(n, 1) AS BIGINT) AS n FROM ({DTM_SQL})
""")
def q_document_term_binary(spark, sf):
    return test_dtm(spark, sf, binary=True)


# --- labelled documents for the models ---------------------------------------------
def labelled(spark, sf):
    """Labelled documents with tokens. Ids are split first; only labelled texts
    are joined and tokenised, and no token array passes a shuffle."""
    lab = read_table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    ids = lab.join(read_table(spark, sf, "documents", ["doc_id"]), "doc_id", "left_semi")
    ids = SP.train_test_split(ids.select("doc_id"), "doc_id", FX.SEED, FX.TEST_SHARE).join(lab, "doc_id")
    d = read_table(spark, sf, "documents", ["doc_id", "text"]).join(ids, "doc_id", "inner")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return d.select("doc_id", "quality", FE.tokens(F.col("text"), FX.STOP_WORDS).alias("tokens"),
                    F.col("quality").cast("double").alias("label"), grade.cast("double").alias("grade"), "split")


@register("regularization_grid", op="M5", sql=f"""
WITH n AS (SELECT count(*) AS n_train FROM labels
           WHERE doc_id IN (SELECT doc_id FROM documents)
             AND doc_id NOT IN (SELECT doc_id FROM (
               SELECT doc_id, row_number() OVER (ORDER BY {SB.md5_key(FX.SEED, 'doc_id')}, doc_id) - 1
               AS rk, count(*) OVER () AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))
               WHERE rk < ceil(n * 0.2))),
g AS (SELECT CAST(range AS INTEGER) AS i, pow(10.0, -2.0 + range * (4.0 / 24)) AS cs FROM range(25))
SELECT i, round(cs, 10) AS cs, round(1 / cs, 10) AS c, round(cs / (SELECT n_train FROM n), 10)
  AS reg_param FROM g
""")
def q_regularization_grid(spark, sf):
    n_train = labelled(spark, sf).where(F.col("split") == "train").count()
    return FE.grid_table(spark, n_train, 25)


LABELLED_SQL = f"""SELECT doc_id, quality, CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, quality, row_number() OVER (ORDER BY {SB.md5_key(FX.SEED, 'doc_id')}, doc_id) - 1 AS rk,
  count(*) OVER () AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))"""
LABELLED_VOCAB_SQL = f"""SELECT term FROM (SELECT unnest(t.tokens) AS term FROM ({TOK_SQL}) t
  JOIN ({LABELLED_SQL}) s ON t.doc_id = s.doc_id WHERE s.split = 'train') GROUP BY term
  ORDER BY count(*) DESC, term LIMIT {FX.VOCAB_SIZE}"""


class _Fitted:
    """Features and models of one session and data folder: the model queries
    share one fit."""

    def __init__(self, spark, sf):
        # written tables cut the lineage: every optimiser iteration then
        # re-reads compact features instead of re-running tokenisation
        self.data = materialize(labelled(spark, sf), "labelled")
        train = self.data.where(F.col("split") == "train")
        self.vocab = FE.vocabulary_list(FE.vocabulary(train, "tokens", FX.VOCAB_SIZE))
        self.vec = FE.vectorizer(self.vocab)
        folds = SP.stratified_folds(self.vec.transform(train).drop("tokens"), "doc_id", "quality", FX.SEED, FX.N_FOLDS)
        self.train = materialize(folds.select("doc_id", "quality", "label", "grade", "features", "fold"), "features")
        self.rows = self.train.select("doc_id", "quality", "grade", "fold")
        self.terms = materialize(self.long(train), "train-terms")
        self.blocks = PA.feature_blocks(self.train, key="doc_id")
        self.grades = PA.feature_blocks(self.train, label="grade", key="doc_id")
        self.test = self.data.where(F.col("split") == "test")
        self.n_train = self.train.count()
        self.cs = FE.regularization_grid(25)
        self._one = self._cv = None

    def long(self, rows):
        """``doc_id, term, n`` of the vocabulary's terms."""
        vocab = rows.sparkSession.createDataFrame([(t,) for t in self.vocab], "term string")
        return FE.document_term_long(rows, "doc_id", vocab)

    def one(self):
        """Weights of the middle penalty on all training rows, near the optimum."""
        if self._one is None:
            self._one = PA.fit_paths(self.blocks, len(self.vocab), self.cs[12:13], [PA.ALL], max_iter=1000, tol=1e-5, slack=0.01).weights[:, 0]
        return self._one

    def cv(self):
        """25 penalties on all folds and on all rows: models, fold scores, the best penalty."""
        if self._cv is None:
            self._cv = PA.grid_search(self.blocks, len(self.vocab), self.cs, FX.N_FOLDS, FX.MAX_ITER)
        return self._cv

    def best(self):
        paths, _, i = self.cv()
        return paths.weights[:, FX.N_FOLDS * len(self.cs) + i]


_FITS: dict = {}


def fitted(spark, sf) -> _Fitted:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        _FITS[key] = _Fitted(spark, sf)
    return _FITS[key]


# A fitted model has no SQL form. What SQL can say of it is checked instead:
# the optimality conditions of the penalised loss, recomputed from long counts
# by joins and sums (number of violations: 0), rows and folds, the grid, and
# counts of right answers against those of the saved predictions.
@register("lr_l1_fit", op="M6", sql=f"""
SELECT (SELECT count(*) FROM ({LABELLED_VOCAB_SQL})) AS n_features,
  (SELECT count(*) FROM ({LABELLED_SQL}) WHERE split = 'train') AS n_train, CAST(0 AS BIGINT) AS violations
""")
def q_lr_l1_fit(spark, sf):
    f = fitted(spark, sf)
    bad = PA.optimality_violations(f.terms, f.rows, "doc_id", "quality", PA.weights_table(spark, f.one(), f.vocab), f.cs[12])
    return spark.createDataFrame([(len(f.vocab), f.n_train, bad)], "n_features bigint, n_train bigint, violations bigint")


@register("lr_three_classes", op="M6", sql=f"""
WITH g AS (SELECT CASE WHEN toxic = 1 THEN 0 WHEN l.quality = 0 THEN 1 ELSE 2 END AS grade
           FROM ({LABELLED_SQL}) s JOIN labels l ON s.doc_id = l.doc_id WHERE s.split = 'train')
SELECT CAST(grade AS INTEGER) AS class, count(*) AS n_train, CAST(0 AS BIGINT) AS violations FROM g GROUP BY grade
""")
def q_lr_three_classes(spark, sf):
    """Three classes as three binary L1 models, fitted in the same passes, each
    held to its optimality conditions."""
    f = fitted(spark, sf)
    n = {int(r["grade"]): r["count"] for r in f.train.groupBy("grade").count().collect()}
    paths = PA.fit_paths(f.grades, len(f.vocab), f.cs[12:13], [PA.ALL], max_iter=1000, tol=1e-5, slack=0.01, classes=sorted(map(float, n)))
    rows = []
    for b, c in enumerate(sorted(n)):
        own = f.rows.select("doc_id", (F.col("grade") == float(c)).cast("int").alias("own"))
        rows.append((c, n[c], PA.optimality_violations(f.terms, own, "doc_id", "own", PA.weights_table(spark, paths.weights[:, b], f.vocab),
                                                       f.cs[12])))
    return spark.createDataFrame(rows, "class int, n_train bigint, violations bigint")


GRID_SQL = f"""SELECT CAST(range AS INTEGER) AS i, pow(10.0, -2.0 + range * (4.0 / 24)) AS cs,
  (SELECT count(*) FROM ({LABELLED_SQL}) WHERE split = 'train') AS n FROM range(25)"""
FOLD_SQL = f"""SELECT fold, count(*) AS n FROM (SELECT CAST((row_number() OVER (PARTITION BY quality ORDER BY
  {SB.md5_key(FX.SEED, 'doc_id')}, doc_id) - 1) % {FX.N_FOLDS} AS INTEGER) AS fold FROM ({LABELLED_SQL}) WHERE split = 'train') GROUP BY fold"""


def _saved_predictions(spark, f):
    """Each penalty's predictions for the rows that its fold left out, written
    as prediction files and read back: ``i, doc_id, prediction``."""
    paths = f.cv()[0]
    said = PA.fold_predictions(f.blocks, paths, range(FX.N_FOLDS * len(f.cs)))
    folder = scratch_path(spark, "fold-predictions")
    FS.write_predictions(said.select(F.expr(f"cast(model % {len(f.cs)} as string)").alias("method"), F.col("key").alias("doc_id"), "prediction"),
                         folder, "folds")
    back = FS.read_prediction_files(spark, folder, "folds", "doc_id bigint, prediction int")
    return back.select(F.col("method").cast("int").alias("i"), "doc_id", "prediction")


@register("lr_grid_cv", op="M7", sql=f"""
SELECT i, round(cs / g.n, 10) AS reg_param, fold, f.n AS n_scored, CAST(0 AS BIGINT) AS miscounted,
  CAST(0 AS BIGINT) AS unsolved FROM ({GRID_SQL}) g, ({FOLD_SQL}) f
""")
def q_lr_grid_cv(spark, sf):
    """25 penalties on 5 folds: the rows that each model is scored on, right
    answers that differ from those of the saved predictions, and whether the
    model did not meet the end test in time."""
    f = fitted(spark, sf)
    paths, scores, _ = f.cv()
    k = len(f.cs)
    unsolved = spark.createDataFrame([(b % k, int(paths.folds[b]), int(not paths.finished[b])) for b in range(FX.N_FOLDS * k)],
                                   "i int, fold int, unsolved bigint")
    recount = (_saved_predictions(spark, f).join(f.rows, "doc_id").groupBy("i", "fold")
               .agg(F.count_if(F.col("prediction") == F.col("quality")).alias("again")))
    penalties = FE.grid_table(spark, f.n_train, k).select("i", "reg_param")
    return (scores.join(recount, ["i", "fold"], "left").join(unsolved, ["i", "fold"]).join(penalties, "i")
            .select("i", "reg_param", "fold", F.col("n").alias("n_scored"),
                    F.abs(F.col("correct") - F.coalesce("again", F.lit(0))).alias("miscounted"), "unsolved"))


@register("cv_curve", op="E8", sql=f"""
SELECT i, round(1 / cs, 10) AS c, n AS n_scored, CAST(0 AS BIGINT) AS wrong_means FROM ({GRID_SQL})
""")
def q_cv_curve(spark, sf):
    """The curve over C: mean fold accuracy of each penalty, held against the
    saved predictions of its folds."""
    f = fitted(spark, sf)
    curve = f.cv()[1].groupBy("i").agg(F.sum("n").alias("n_scored"), F.avg(F.col("correct") / F.col("n")).alias("mean"))
    folds = (_saved_predictions(spark, f).join(f.rows, "doc_id").groupBy("i", "fold")
             .agg(F.avg((F.col("prediction") == F.col("quality")).cast("int")).alias("accuracy")))
    again = folds.groupBy("i").agg(F.avg("accuracy").alias("again"))
    grid = FE.grid_table(spark, f.n_train, len(f.cs)).select("i", "c")
    return curve.join(again, "i").join(grid, "i").select("i", "c", "n_scored", (F.abs(F.col("mean") - F.col("again")) > 1e-12).cast("bigint").alias("wrong_means"))


@register("lr_predict", op="M9", sql=f"""
SELECT doc_id, CAST(quality AS INTEGER) AS label, true AS as_weighed FROM ({LABELLED_SQL}) WHERE split = 'test'
""")
def q_lr_predict(spark, sf):
    """Predictions of the best model for the test articles, saved as a
    prediction file and read back, against the sign of the weighted counts."""
    f = fitted(spark, sf)
    rows = f.vec.transform(f.test).select("doc_id", "label", F.lit(0).alias("fold"), "features")
    said = PA.fold_predictions(PA.feature_blocks(rows, key="doc_id"), _one_model(f))
    folder = scratch_path(spark, "lr-predictions")
    FS.write_predictions(said.select(F.lit("lr").alias("method"), F.col("key").alias("doc_id"), "prediction"), folder, "labelled")
    back = FS.read_prediction_files(spark, folder, "labelled", "doc_id bigint, prediction int").where("method = 'lr'")
    weighed = PA.margins(f.long(f.test), f.test.select("doc_id", "label"), "doc_id", PA.weights_table(spark, f.best(), f.vocab))
    return weighed.join(back, "doc_id", "left").select(
        "doc_id", F.col("label").cast("int").alias("label"), F.col("prediction").eqNullSafe((F.col("margin") > 0).cast("int")).alias("as_weighed"))


def _one_model(f):
    best = f.best()[:, None]
    return PA.Paths(best, np.array([f.cs[f.cv()[2]]]), np.array([PA.ALL]), 0, np.ones(1, bool), np.zeros_like(best))


@register("lr_accuracy", op="M9", sql=f"""
SELECT count(*) AS total, true AS beats_constant FROM ({LABELLED_SQL}) WHERE split = 'test'
""")
def q_lr_accuracy(spark, sf):
    """Test accuracy of the best model against always answering the majority
    class of the training rows (three standard errors allowed)."""
    f = fitted(spark, sf)
    weighed = PA.margins(f.long(f.test), f.test.select("doc_id", "label"), "doc_id", PA.weights_table(spark, f.best(), f.vocab))
    acc = EV.accuracy(weighed.withColumn("prediction", (F.col("margin") > 0).cast("double")), "prediction", "label")
    constant = f.train.agg(F.round(F.avg("label")).alias("c")).first()["c"]
    base = f.test.agg(F.avg((F.col("label") == constant).cast("int")).alias("b")).first()["b"]
    slack = 3 * F.sqrt(F.lit(0.25) / F.col("total"))
    return acc.select("total", (F.col("accuracy") + slack >= F.lit(base)).alias("beats_constant"))


@register("top_coefficients", op="M10", sql=f"""
WITH v AS (SELECT count(*) AS n FROM ({LABELLED_VOCAB_SQL}))
SELECT side, least(25, n) AS n_terms, CAST(0 AS BIGINT) AS misplaced, true AS sparse FROM v, (VALUES ('top'), ('bottom')) t(side)
""")
def q_top_coefficients(spark, sf):
    """The 25 largest and smallest weights: none left out is larger or smaller,
    and the penalty sets a share of all weights to zero."""
    f = fitted(spark, sf)
    top = CL.top_coefficients(PA.weights_table(spark, f.one(), f.vocab), 25)
    w = sorted(f.one()[:-1].tolist())
    k = min(25, len(w))
    wrong = F.when(F.col("side") == "top", F.col("weight") < w[-k]).otherwise(F.col("weight") > w[k - 1])
    return top.groupBy("side").agg(F.count("*").alias("n_terms"), F.count_if(wrong).alias("misplaced")).withColumn(
        "sparse", F.lit(0 < w.count(0.0) < len(w)))


@register("model_save_load", op="S7", sql=f"""
SELECT count(*) AS n_test, CAST(0 AS BIGINT) AS differences FROM ({LABELLED_SQL}) WHERE split = 'test'
""")
def q_model_save_load(spark, sf):
    """Vocabulary and model saved and loaded: predictions and probabilities
    equal those in memory."""
    f = fitted(spark, sf)
    stages = CL.fitted_pipeline(f.vec, CL.l1_logistic(FE.reg_params(f.cs, f.n_train)[12], max_iter=30).fit(f.train))
    path = scratch_path(spark, "model")
    CL.save_pipeline(stages, path)
    raw = f.data.where(F.col("split") == "test")

    def scored(model, suffix):
        return model.transform(raw).select("doc_id", F.col("prediction").alias(f"p{suffix}"),
                                           F.col("probability").cast("string").alias(f"q{suffix}"))
    both = scored(stages, 1).join(scored(CL.load_pipeline(path), 2), "doc_id")
    same = F.col("p1").eqNullSafe(F.col("p2")) & F.col("q1").eqNullSafe(F.col("q2"))
    return both.agg(F.count("*").alias("n_test"), F.count_if(~same).alias("differences"))


@register("embedding_classifier", op="M11", sql=f"""
SELECT ceil(count(*) * 0.2) AS n_test, count(DISTINCT label) AS n_classes, CAST(0 AS BIGINT) AS violations FROM embeddings
""")
def q_embedding_classifier(spark, sf):
    """Softmax regression on the vectors: test rows scored, classes, and
    violations of the first-order conditions of its fit."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    e = materialize(SP.stratified_split(e, "vec_id", "label", FX.SEED, FX.TEST_SHARE), "embedded")
    e = CL.embedding_features(e).withColumn("label_d", F.col("label").cast("double"))
    m = CL.embedding_classifier(max_iter=200, reg_param=1e-3, label="label_d").fit(e.where(F.col("split") == "train"))
    bad = CL.softmax_violations(e.where(F.col("split") == "train"), m, "label_d", 1e-3)
    pred = m.transform(e.where(F.col("split") == "test"))
    classes = e.select("label").distinct().count()
    return pred.agg(F.count("prediction").cast("double").alias("n_test")).select(
        "n_test", F.lit(classes).cast("bigint").alias("n_classes"), F.lit(bad).cast("bigint").alias("violations"))
