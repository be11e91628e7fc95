"""Models of Spark ML: L1 logistic regression, its vocabulary and model as one
saved pipeline, coefficients, and a classifier on precomputed embeddings
(M6, M10, M11, S7).

Spark ML fits with distributed L-BFGS / OWL-QN: every iteration is one
``treeAggregate`` over the sparse features. Many fits of one table (penalties,
folds, classes) go through :mod:`.paths` instead, one pass a step for all.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def l1_logistic(reg_param: float = 0.0, max_iter: int = 200, tol: float = 1e-4,
                features: str = "features", label: str = "label",
                family: str = "auto") -> LogisticRegression:
    """M6: L1-penalised logistic regression with intercept. Spark does not
    penalise the intercept (liblinear does); features are not standardised."""
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=reg_param,
                              elasticNetParam=1.0, standardization=False, maxIter=max_iter,
                              tol=tol, fitIntercept=True, family=family)


def top_coefficients(weights: DataFrame, k: int = 25) -> DataFrame:
    """The top and bottom ``k`` terms by weight of a ``term, weight`` table
    (one row a term of the vocabulary)."""
    terms = weights.where(F.col("term").isNotNull())
    top = terms.orderBy(F.desc("weight"), "term").limit(k).withColumn("side", F.lit("top"))
    bottom = terms.orderBy(F.asc("weight"), "term").limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def softmax_violations(train: DataFrame, model: LogisticRegressionModel, label: str, penalty: float,
                       slack: float = 2e-3) -> int:
    """Weights of a ridge-penalised softmax fit whose slope is off zero by more
    than ``slack``; features are standardised in the penalty."""
    p = vector_to_array(F.col("_p"))
    k = model.numClasses
    rows = (model.setProbabilityCol("_p").setPredictionCol("_y").setRawPredictionCol("_r").transform(train)
            .select(p.alias("p"), F.col(label).cast("int").alias("y"), vector_to_array(model.getFeaturesCol()).alias("x")))
    ex = rows.select("p", "y", F.posexplode("x").alias("j", "x"))
    sums = ex.groupBy("j").agg(F.stddev("x").alias("s"), *[
        F.avg((F.col("p")[c] - (F.col("y") == c).cast("int")) * F.col("x")).alias(f"g{c}") for c in range(k)]).collect()
    w = model.coefficientMatrix.toArray()
    for name in ("probability", "prediction", "rawPrediction"):
        model.clear(getattr(model, f"{name}Col"))
    return sum(abs(r[f"g{c}"] + penalty * w[c, r["j"]] * r["s"] ** 2) > slack for r in sums for c in range(k))


def embedding_features(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    """Precomputed vectors (``array<float>``) as ML vectors."""
    return df.withColumn(out, array_to_vector(F.col(col)))


def embedding_classifier(max_iter: int = 50, reg_param: float = 0.0,
                         features: str = "features", label: str = "label") -> LogisticRegression:
    """Multinomial logistic regression on embeddings (stands in for
    fine-tuning a small language model)."""
    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                              maxIter=max_iter, regParam=reg_param)


def fitted_pipeline(*stages) -> PipelineModel:
    """Fitted stages as one model."""
    return PipelineModel(stages=list(stages))


def save_pipeline(model: PipelineModel, path: str) -> None:
    """Persist fitted stages (vocabulary and model)."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
