"""Embedding pairs, retrieval and models as data jobs (MLlib does the fitting)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.core import col
from plumbline.operators.aggregate import r_squared
from plumbline.operators.ranking import spearman

EPS = 1e-8


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def fit_projection(df: DataFrame, vector: str, k: int) -> DenseMatrix:
    """Principal axes; only the dims x k matrix is returned to the driver."""
    v = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).pc


def project(df: DataFrame, vector: str, axes: DenseMatrix, out: str) -> DataFrame:
    """Project without centring (as the published pipeline applies its axes)."""
    m = axes.toArray()
    cols = F.array(*[F.array(*[F.lit(float(x)) for x in m[:, j]]) for j in range(m.shape[1])])
    return df.withColumn(out, F.transform(cols, lambda a: dot(a, F.col(vector))))


def pair_features(u, v) -> Column:
    """u, v, |u - v|, u * v, then cosine, three norms, two projections on the difference and their gap."""
    u, v = col(u), col(v)
    diff = F.zip_with(u, v, lambda a, b: a - b)
    un, vn, dn = norm(u), norm(v), norm(diff)
    pu, pv = dot(u, diff) / (dn + EPS), dot(v, diff) / (dn + EPS)
    return F.concat(u, v, F.transform(diff, lambda x: F.abs(x)), F.zip_with(u, v, lambda a, b: a * b), F.array(dot(u, v) / (un * vn + EPS), un, vn, dn, pu, pv, pu - pv))


def train_relevance(pairs: DataFrame, features: str, label: str, trees: int = 20, depth: int = 5, seed: int = 42):
    """Three-class model (0 relevant, 1 superfluous, 2 noise) on pair features."""
    d = pairs.withColumn("_f", array_to_vector(F.col(features).cast("array<double>")))
    return RandomForestClassifier(featuresCol="_f", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(d)


def relevance_gate(pairs: DataFrame, model, features: str, threshold: float = 0.5) -> DataFrame:
    """Probability of the superfluous class and the action it implies."""
    d = model.transform(pairs.withColumn("_f", array_to_vector(F.col(features).cast("array<double>"))))
    p = vector_to_array("probability")[1]
    out = d.withColumn("p_superfluous", p).drop("_f", "rawPrediction", "probability", "prediction")
    go = F.col("p_superfluous") < threshold
    return out.withColumns({"action": F.when(go, "PROCEED").otherwise("RE_ENCODE"), "confidence": F.when(go, 1 - F.col("p_superfluous")).otherwise(F.col("p_superfluous"))})


def label_matches(top: DataFrame, relevant: float = 0.5, noise: float = 0.2) -> DataFrame:
    """R at or above the first bound, N below the second, S between."""
    s = F.col("cosine")
    return top.withColumn("label", F.when(s >= relevant, "R").when(s < noise, "N").otherwise("S"))


# ---- cross-validation, transfer, importances ---------------------------------------------------

def _estimator(kind: str, task: str, depth: int, iters: int):
    if task == "classification":
        return LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01) if kind != "gbt" else RandomForestClassifier(featuresCol="features", labelCol="label", maxDepth=depth, numTrees=iters, seed=42)
    return {"ridge": LinearRegression(featuresCol="features", labelCol="label", regParam=1.0, elasticNetParam=0.0), "gbt": GBTRegressor(featuresCol="features", labelCol="label", maxDepth=depth, maxIter=iters, seed=42)}[kind]


def _pipeline(kind: str, task: str, features: list[str], depth: int, iters: int) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="features"), _estimator(kind, task, depth, iters)])


def oof_predictions(df: DataFrame, key: str, fold: str, folds: list, features: list[str], target: str, kind: str = "ridge", task: str = "regression", depth: int = 4, iters: int = 10) -> DataFrame:
    """One fit per fold on the other folds, predictions on the fold; the fold list is short."""
    out = []
    d = df.withColumn("label", F.col(target).cast("double"))
    for f in folds:
        model = _pipeline(kind, task, features, depth, iters).fit(d.filter(F.col(fold) != f))
        p = model.transform(d.filter(F.col(fold) == f))
        score = vector_to_array("probability")[1] if task == "classification" else F.col("prediction")
        out.append(p.select(key, F.col(fold).alias("fold"), F.lit(kind).alias("solver"), F.col("label").alias("y_true"), score.alias("y_pred")))
    return reduce(lambda a, b: a.unionByName(b), out)


def importance_by_group(df: DataFrame, group: str, groups: list, features: list[str], target: str, depth: int = 4, trees: int = 10) -> DataFrame:
    """Normalised importances of one tree ensemble per group (scenario)."""
    rows = []
    for g in groups:
        m = _pipeline("gbt", "regression", features, depth, trees).fit(df.filter(F.col(group) == g).withColumn("label", F.col(target).cast("double")))
        imp = m.stages[-1].featureImportances.toArray()
        rows += [(g, f, float(x)) for f, x in zip(features, imp)]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"{group} {kind}, feature string, importance double")


def importance_stability(imp: DataFrame, group: str) -> DataFrame:
    """Rank correlation of the importances of every two groups (groups and features are few)."""
    a, b = imp.select("feature", F.col(group).alias("group_a"), F.col("importance").alias("ia")), imp.select("feature", F.col(group).alias("group_b"), F.col("importance").alias("ib"))
    return spearman(a.join(b, "feature").filter(F.col("group_a") < F.col("group_b")), ["group_a", "group_b"], "ia", "ib", 3)


def transfer_matrix(df: DataFrame, group: str, groups: list, features: list[str], target: str, kind: str = "ridge", depth: int = 4, iters: int = 10) -> DataFrame:
    """R2 and RMSE of every train group on every test group: one fit per group, one pass over all rows."""
    d = df.withColumn("label", F.col(target).cast("double"))
    out = []
    for g in groups:
        model = _pipeline(kind, "regression", features, depth, iters).fit(d.filter(F.col(group) == g))
        p = model.transform(d)
        e = F.col("label") - F.col("prediction")
        out.append(p.groupBy(F.col(group).alias("test")).agg(r_squared("label", "prediction").alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n")).withColumn("train", F.lit(g)))
    return reduce(lambda a, b: a.unionByName(b), out)


def score_batch(df: DataFrame, model, out: str = "score") -> DataFrame:
    """Batch scoring with a fitted pipeline."""
    return model.transform(df).withColumnRenamed("prediction", out).drop("_raw", "features", "rawPrediction", "probability")


def cluster_regions(df: DataFrame, features: list[str], k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Clusters on standardised features and coordinates, and their silhouette."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")])
    c = pipe.fit(df).transform(df)
    s = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(c)
    summary = c.agg(F.count_distinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_units")).withColumn("silhouette", F.lit(float(s)))
    return c.drop("_raw", "features"), summary
