"""Learned audits on feature arrays: out-of-fold logistic regression, one-class distance, stacking."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import dims
from curata.functions.seeded import unit
from curata.operators.metrics import auroc, quantile_cutoff
from curata.session import written


def standardised(rows: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """``rows`` with features (x - mean) / (deviation + 1e-8), population deviations, of ``by`` (of themselves if None)."""
    v = (rows if by is None else by).select(array_to_vector("features").alias("v"))
    s = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
    n = max(1, s["count"])
    mean = s["mean"].toArray()
    scale = np.sqrt(s["variance"].toArray() * (n - 1) / n) + 1e-8
    pair = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(d)).alias("d")) for m, d in zip(mean, scale)))
    return rows.withColumn("features", F.zip_with("features", pair, lambda x, p: (x - p["m"]) / p["d"]))


def out_of_fold(rows: DataFrame, key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """``rows`` (key, label, features) with score: each predicted by a model fitted without its fold; classes weigh alike."""
    rows = written(rows.select(key, "label", "features"))  # every fit reads them several times, and features may be costly
    marked = standardised(rows).withColumn("fold", F.floor(unit(seed, F.col(key)) * folds).cast("int")).withColumn("v", array_to_vector("features"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2 * max(1, counts.get(1, 0)))).otherwise(total / (2 * max(1, counts.get(0, 0))))
    marked = marked.withColumn("weight", weight)
    def fold(k: int) -> DataFrame:
        model = LogisticRegression(featuresCol="v", labelCol="label", weightCol="weight", regParam=1.0 / max(1, total), maxIter=50).fit(marked.where(F.col("fold") != k))
        return model.transform(marked.where(F.col("fold") == k)).select(key, "label", vector_to_array("probability")[1].alias("score"))

    # the folds' fits are chains of short jobs, so they run side by side
    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(fold), range(folds)))
    return reduce(DataFrame.unionByName, parts)


def shortcut_audit(rows: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """AUROC of the out-of-fold scores and its verdict."""
    scores = out_of_fold(rows, key)
    return auroc(scores, by or []).withColumn("verdict", dims.verdict(F.col("auroc")))


def ledoit_wolf(n: int, cross: np.ndarray, fourth: float) -> np.ndarray:
    """Covariance of n centred rows, shrunk to a multiple of the identity by the Ledoit-Wolf coefficient.

    ``cross`` is the sum of the rows' outer products, ``fourth`` that of their squared squared norms.
    """
    d = len(cross)
    cov = cross / n
    mu = np.trace(cov) / d
    spread = (np.sum(cov * cov) - 2 * mu * np.trace(cov) + d * mu * mu) / d  # of the covariance about its target
    noise = (fourth / n - np.sum(cov * cov)) / (n * d)  # of the covariance about the true one
    share = 0.0 if spread <= 0 else min(1.0, max(0.0, noise) / spread)
    return (1 - share) * cov + share * mu * np.eye(d)


def one_class(rows: DataFrame, key: str) -> DataFrame:
    """key and score d / (d + median): squared Mahalanobis distances to the rows with label 0, whose features are
    standardised and have a Ledoit-Wolf covariance; the median is theirs.

    Sums of products are added up by Spark; what reaches the driver has the size of the features squared.
    """
    def moments(batches):
        for p in batches:
            x = np.stack(p["features"].to_numpy())
            yield pd.DataFrame({"n": [len(x)], "ss": [(x.T @ x).ravel()], "q": [float((np.sum(x * x, axis=1) ** 2).sum())]})

    rows = written(rows.select(key, "label", F.col("features").cast("array<double>").alias("features")))
    z = standardised(rows, rows.where("label = 0"))
    parts = z.where("label = 0").select("features").mapInPandas(moments, "n long, ss array<double>, q double")
    add = lambda c: F.aggregate(F.collect_list(c), F.array().cast("array<double>"), lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda p, q: p + q)))
    # two levels, so that no task collects the parts of all tasks
    level = parts.groupBy(F.pmod(F.xxhash64("q"), F.lit(64)).alias("g")).agg(F.sum("n").alias("n"), F.sum("q").alias("q"), add("ss").alias("ss"))
    m = level.agg(F.sum("n").alias("n"), F.sum("q").alias("q"), add("ss").alias("ss")).first()
    d = int(round(len(m["ss"]) ** 0.5))
    precision = np.linalg.pinv(ledoit_wolf(m["n"], np.array(m["ss"]).reshape(d, d), m["q"]))

    @F.pandas_udf("double")
    def distance(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy())
        return pd.Series(np.maximum(0, np.einsum("ij,jk,ik->i", x, precision, x)))

    measured = z.withColumn("d", distance(F.col("features")))
    median = quantile_cutoff(measured.select("label", F.col("d").alias("score")), [], 0.5).first()["cutoff"] + 1e-8
    return measured.select(key, "label", (F.col("d") / (F.col("d") + float(median))).alias("score"))


def _members(scores: DataFrame, key: str, members: list[str]) -> DataFrame:
    """One row for each key with the members' scores as features; missing ones are 0.5."""
    wide = scores.groupBy(key, "label").pivot("model", members).agg(F.first("score"))
    return wide.select(key, F.col("label").cast("double").alias("label"), F.array(*(F.coalesce(F.col(f"`{m}`"), F.lit(0.5)) for m in members)).alias("features"))


def stack(scores: DataFrame, key: str, members: list[str], seed: int = 0) -> DataFrame:
    """Member scores (key, label, model, score) to out-of-fold scores of a logistic regression over them."""
    return out_of_fold(_members(scores, key, members), key, seed=seed)


def stack_choice(scores: DataFrame, key: str, members: list[str], seed: int = 0, held: float = 0.3) -> DataFrame:
    """learner, auroc on held-out keys and chosen: a logistic regression and boosted trees over the members' scores, and
    the best member by itself; the first of equals is chosen."""
    rows = written(_members(scores, key, members)).withColumn("v", array_to_vector("features")).withColumn("held", unit(seed, F.col(key)) < held)
    train, test = rows.where("NOT held"), rows.where("held")
    learners = {"logistic": LogisticRegression(featuresCol="v", labelCol="label", maxIter=50), "trees": GBTClassifier(featuresCol="v", labelCol="label", maxDepth=3, maxIter=20, seed=seed)}
    told = None
    for name, learner in learners.items():
        one = learner.fit(train).transform(test).select(F.lit(name).alias("learner"), "label", vector_to_array("probability")[1].alias("score"))
        told = one if told is None else told.unionByName(one)
    for k, m in enumerate(members):
        told = told.unionByName(test.select(F.lit(f"member {m}").alias("learner"), "label", F.col("features")[k].alias("score")))
    table = auroc(told, ["learner"])
    best = table.agg(F.max_by("learner", F.struct("auroc", F.col("learner").isin(*learners).cast("int"), "learner")).alias("best"))
    return table.join(best, how="cross").select("learner", "auroc", (F.col("learner") == F.col("best")).alias("chosen"))
