"""Quality gates: DataFrames of verdicts, and their severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import dims

#: Severity of a verdict; 2 fails a build.
SEVERITY = {"PASS": 0, "OK": 0, "SKIP": 0, "CHECK": 1, "CAVEAT": 1, "WARN": 1, "FAIL": 2}


def class_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col("label") == 0).alias("reals"), F.count_if(F.col("label") == 1).alias("fakes"))


def bucket_balance(rows: DataFrame, max_ratio: float = 1.5, min_rows: int = 200) -> DataFrame:
    """split, bucket, counts, ratio and verdict: FAIL where a bucket of ``min_rows`` lacks a class or is skewed; test warns."""
    counts = class_counts(rows, ["split", "bucket"])
    most, least = F.greatest("reals", "fakes"), F.least("reals", "fakes")
    ok = (most + least < min_rows) | ((least > 0) & (most <= max_ratio * least))
    return counts.select("*", F.try_divide(most.cast("double"), least.cast("double")).alias("ratio"), F.when(ok, "OK").when(F.col("split") == "test", "WARN").otherwise("FAIL").alias("verdict"))


def native_size(rows: DataFrame, low: float = 0.8, high: float = 1.25, eval_set: bool = False) -> DataFrame:
    """bucket, counts, upper median of ``long`` and verdict; one-class and skewed buckets fail, whatever their size."""
    from curata.operators.order_statistics import upper_median

    middle = upper_median(rows, ["bucket"], "long").select(F.col("bucket").alias("__bucket"), F.col("value").alias("median_long"))
    counts = class_counts(rows, ["bucket"]).join(middle, F.col("bucket").eqNullSafe(F.col("__bucket")), "left").drop("__bucket")
    ratio = F.try_divide(F.col("reals").cast("double"), F.col("fakes").cast("double"))
    fine = (F.col("reals") > 0) & (F.col("fakes") > 0) & ratio.between(low, high)
    return counts.select("*", F.when(fine, "PASS").otherwise("CAVEAT" if eval_set else "FAIL").alias("verdict"))


def subject_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return class_counts(rows, [*by, "subject"])


def one_sided(rows: DataFrame, by: list[str], min_rows: int = 200, share: float = 0.1) -> DataFrame:
    """Subjects with ``min_rows`` of one class and less than ``share`` of that in the other."""
    big, small = F.greatest("reals", "fakes"), F.least("reals", "fakes")
    return subject_counts(rows, by).where((F.col("subject") != "other") & (big >= min_rows) & (small < share * big))


def concentration(rows: DataFrame, by: list[str], what: str, share: float = 0.7) -> DataFrame:
    """The largest value of ``what`` in each group, with its share of the group, where that is ``share`` or more."""
    counts = rows.groupBy(*by, what).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max_by(F.struct(F.col(what), F.col("n")), F.struct(F.col("n"), F.col(what))).alias("t"), F.sum("n").alias("total"))
    return top.select(*by, F.col(f"t.{what}").alias(what), F.col("t.n").alias("n"), (F.col("t.n") / F.col("total")).alias("share")).where(F.col("share") >= share)


def bucket_content(rows: DataFrame, min_bucket: int = 500, min_subject: int = 200) -> DataFrame:
    """bucket, n, one_sided, notes and verdict: WARN if a subject is one-sided, or both classes come from one source."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    subjects = subject_counts(rows, ["bucket"]).join(sizes, "bucket")
    both = F.col("reals") + F.col("fakes")
    bad = subjects.where((F.col("subject") != "other") & (both >= F.greatest(F.lit(min_subject), F.col("n") * 0.1)) & (F.least("reals", "fakes") == 0)).groupBy("bucket").agg(F.count("*").alias("one_sided"))
    origin = rows.withColumn("origin", F.when(F.col("label") == 0, F.col("source")).otherwise(F.col("generator")))
    notes = concentration(origin, ["bucket", "label"], "origin").groupBy("bucket").agg(F.count("*").alias("notes"))
    out = sizes.join(bad, "bucket", "left").join(notes, "bucket", "left").fillna(0, ["one_sided", "notes"])
    return out.withColumn("verdict", F.when(F.col("n") < min_bucket, "SKIP").when((F.col("one_sided") > 0) | (F.col("notes") == 2), "WARN").otherwise("PASS"))


def label_conflicts(rows: DataFrame, key: str = "key") -> DataFrame:
    return rows.groupBy(key).agg(F.count_distinct("label").alias("labels")).where("labels > 1")


def split_leaks(rows: DataFrame, key: str = "key") -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("split")), "+").alias("splits"), F.count_distinct("split").alias("n")).where("n > 1").drop("n")


def provenance(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (orig, source, label) with truth, rule and state: agrees, disagrees or unresolved."""
    known = targets.groupBy("image_path").agg(F.min(F.when(F.trim("target") == "0", 0).otherwise(1)).alias("target"))
    # without an orig, the path tells
    place = F.coalesce(F.nullif(F.col("orig"), F.lit("")), F.col("path")) if "path" in rows.columns else F.col("orig")
    joined = rows.withColumn("__place", place).join(known, dims.norm_path(F.col("__place")) == F.col("image_path"), "left").drop("image_path")
    told = joined.withColumn("p", dims.provenance(F.coalesce("source", F.lit("")), F.coalesce("__place", F.lit("")), F.col("target"))).drop("__place").select("*", "p.truth", "p.rule").drop("p", "target")
    return told.withColumn("state", F.when(F.col("truth").isNull(), "unresolved").when(F.col("truth") == F.col("label"), "agrees").otherwise("disagrees"))


def top_n(rows: DataFrame, by: list[str], what: str, n: int) -> DataFrame:
    """The n most frequent values of ``what`` in each group; ties by value."""
    counts = rows.groupBy(*by, what).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), what))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def corpus_audit(rows: DataFrame, near: DataFrame, max_near: float = 0.005) -> DataFrame:
    """gate and verdict: unreadable or flat files, duplicates over splits or labels, near-duplicate share of val and test.

    ``rows`` has path, split, label, sha256 and flat; ``near`` the paths with a near duplicate in training.
    """
    first = rows.agg(F.count_if(F.col("sha256").isNull() | F.coalesce("flat", F.lit(False))).alias("bad"))
    verdict = lambda c: F.when(c, "FAIL").otherwise("PASS").alias("verdict")
    files = first.select(F.lit("files").alias("gate"), verdict(F.col("bad") > 0))
    from curata.operators.dedup import duplicate_groups

    dups = duplicate_groups(rows).agg(F.count_if((F.col("splits") > 1) | (F.col("labels") > 1)).alias("bad")).select(F.lit("duplicates").alias("gate"), verdict(F.col("bad") > 0))
    shares = rows.where("split IN ('val', 'test')").join(near.select("path", F.lit(1).alias("hit")).distinct(), "path", "left").groupBy("split").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return files.unionByName(dups).unionByName(shares.select(F.concat(F.lit("near-duplicates "), F.col("split")).alias("gate"), verdict(F.col("share") > max_near)))


def severity(verdicts: DataFrame) -> DataFrame:
    """The worst verdict of all gates: 0 pass, 1 warn, 2 fail."""
    level = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return verdicts.agg(F.max(level[F.col("verdict")]).alias("severity"), F.count("*").alias("gates"))


def enforce(verdicts: DataFrame) -> None:
    """Raise if a gate failed."""
    found = severity(verdicts).first()
    if found["severity"] == 2:
        raise RuntimeError("a quality gate failed")
