"""Rows that are skipped, counted by reason in the pass that drops them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def skipping(rows: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Rows for which no reason holds, and an observation of how many there were of each kind.

    The first reason that holds counts; a reason that is null does not hold. Counts are there once an action ran over
    the rows, as the plan itself makes them: the source is read once. A task that runs again after a loss may count its
    rows again, so write the rows once and read them from there.
    """
    seen = Observation(f"skips-{uuid.uuid4().hex}")
    reason = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        reason = F.when(holds, name).otherwise(reason)
    counts = [F.count_if(F.col("__reason") == name).alias(name) for name in reasons]
    marked = rows.withColumn("__reason", reason).observe(seen, F.count_if(F.col("__reason").isNull()).alias("kept"), *counts)
    return marked.where(F.col("__reason").isNull()).drop("__reason"), seen


def counts(spark: SparkSession, seen: Observation) -> DataFrame:
    """reason and n, kept rows among them, of an observation whose action has run."""
    return spark.createDataFrame(sorted(seen.get.items()), "reason string, n long")


def excluding(rows: DataFrame, excluded: DataFrame, key: str = "path") -> DataFrame:
    """``rows`` with __excluded: whether the key is on the list; a path counts in its normal form."""
    from curata.functions.paths import normpath

    listed = excluded.select(normpath(F.col(key)).alias("__listed")).distinct().withColumn("__excluded", F.lit(True))
    joined = rows.join(listed, normpath(F.col(key)) == F.col("__listed"), "left").drop("__listed")
    return joined.withColumn("__excluded", F.coalesce("__excluded", F.lit(False)))
