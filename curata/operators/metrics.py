"""Detector metrics over long score tables (.., label 0/1, score).

All curves come from one table of distinct scores with the numbers of both labels at and below each. It is built without
a window over a whole group: scores fall into BINS bins, running sums inside a bin are windows of their own, and the sums
of the bins before are added. So one group (or no group at all) is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.session import written

BINS = 4096

# The conditions of the grid in order, the stacks by depth, and families of conditions.
GRID = ["clean", "jpeg_q90", "jpeg_q70", "jpeg_q50", "jpeg_q30", "blur_s0.5", "blur_s1.0", "blur_s2.0", "resize_0.5x", "resize_0.25x", "noise_s0.02", "noise_s0.05", "noise_s0.10", "jitter_20", "crop_80"]
EXTRA = ["chain_repost", "jpeg_twice", "blur1_jpeg70", "noise05_jpeg70", "crop80_resize05", "stack1_rand", "stack2_rand", "stack3_rand", "stack4_rand", "stack5_rand", "stack6_rand"]
FAMILIES = {
    "JPEG compression": ["jpeg_q90", "jpeg_q70", "jpeg_q50", "jpeg_q30"],
    "Gaussian blur": ["blur_s0.5", "blur_s1.0", "blur_s2.0"],
    "Resize -> upscale": ["resize_0.5x", "resize_0.25x"],
    "Gaussian noise": ["noise_s0.02", "noise_s0.05", "noise_s0.10"],
    "Colour jitter": ["jitter_20"],
    "Centre crop": ["crop_80"],
}


def _bin(score: Column) -> Column:
    """A number that rises with the score: BINS to the unit, and 64 for each doubling beyond it, as for logits."""
    above, below = F.lit(BINS) + F.floor(F.log2(score) * 64), F.lit(-1) - F.floor(F.log2(1 - score) * 64)
    return F.when(score > 1, above).when(score < 0, below).otherwise(F.floor(score * BINS))


def counted(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos and neg: the numbers of both labels at each distinct score."""
    flat = scores.where("score IS NOT NULL AND label IN (0, 1)").select(*by, "label", F.col("score").cast("double").alias("score"))
    return flat.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def _met(by: list[str], prefix: str = "__") -> Column:
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return match


def curve(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos, neg, below_pos, below_neg (at smaller scores), p and n (of the group), for each distinct score."""
    return curve_of(counted(scores, by), by)


def curve_of(counts: DataFrame, by: list[str]) -> DataFrame:
    at = counts.withColumn("bin", _bin(F.col("score")))
    bins = at.groupBy(*by, "bin").agg(F.sum("pos").alias("bin_pos"), F.sum("neg").alias("bin_neg"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("bin").alias("__bin"), *(F.coalesce(F.sum(f"bin_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in ("pos", "neg")), F.sum("bin_pos").over(whole).alias("p"), F.sum("bin_neg").over(whole).alias("n"))
    inside = Window.partitionBy(*by, "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    run = at.select(*by, "score", "pos", "neg", "bin", *(F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"in_{k}") for k in ("pos", "neg")))
    return run.join(bins, (F.col("bin") == F.col("__bin")) & _met(by)).select(*by, "score", "pos", "neg", (F.col("in_pos") + F.col("before_pos")).alias("below_pos"), (F.col("in_neg") + F.col("before_neg")).alias("below_neg"), "p", "n")


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def auroc_of(table: DataFrame, by: list[str]) -> DataFrame:
    area = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") * F.lit(0.5)))
    return table.groupBy(*by).agg(F.try_divide(area, (F.first("p") * F.first("n")).cast("double")).alias("auroc"))


def auroc(scores: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve with ties as one half; null for a group of one class."""
    return auroc_of(curve(scores, by), by)


def roc(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, tpr and fpr of ``score >= threshold`` at each distinct score, and (null, 0, 0) for none."""
    t = curve(scores, by)
    points = t.select(*by, F.col("score").alias("threshold"), _ratio(F.col("p") - F.col("below_pos"), F.col("p")).alias("tpr"), _ratio(F.col("n") - F.col("below_neg"), F.col("n")).alias("fpr"))
    start = t.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(start)


def youden(scores: DataFrame, by: list[str]) -> DataFrame:
    """by and cutoff, the threshold with the largest tpr - fpr, the highest of equals; null for one class."""
    return _youden(curve(scores, by), by)


def _youden(t: DataFrame, by: list[str]) -> DataFrame:
    tpr, fpr = _ratio(F.col("p") - F.col("below_pos"), F.col("p")), _ratio(F.col("n") - F.col("below_neg"), F.col("n"))
    best = F.max_by("score", F.struct(tpr - fpr, F.col("score")))
    return t.where("p > 0 AND n > 0").groupBy(*by).agg(best.alias("cutoff"))


def fpr_at_tpr(scores: DataFrame, by: list[str], tpr: float = 0.95) -> DataFrame:
    return roc(scores, by).where(F.col("tpr") >= tpr).groupBy(*by).agg(F.min("fpr").alias("fpr_at_tpr"))


def quantile_cutoff(scores: DataFrame, by: list[str], fa: float = 0.01) -> DataFrame:
    """by and cutoff: the score of reals above which the share ``fa`` of them lies, linearly interpolated."""
    return quantile_of(counted(scores.where("label = 0"), by), by, fa)


def quantile_of(counts: DataFrame, by: list[str], fa: float) -> DataFrame:
    """As quantile_cutoff(), from distinct scores with their numbers: only the bins that hold the two places are ranked."""
    at = counts.where("neg > 0").select(*by, "score", "neg", _bin(F.col("score")).alias("bin"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("k").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = at.groupBy(*by, "bin").agg(F.sum("neg").alias("k")).select("*", before.alias("before"), F.sum("k").over(whole).alias("n"))
    place = (F.col("n") - 1) * F.lit(1 - fa)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("k"))
    held = bins.withColumns({"low": low, "high": high, "part": place - low}).where(holds(F.col("low")) | holds(F.col("high")))
    held = held.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("bin").alias("__bin"), "before", "low", "high", "part")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy(*by, "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = at.join(held, (F.col("bin") == F.col("__bin")) & _met(by)).withColumn("below", F.col("before") + inside)
    of = lambda p: F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("neg")), F.col("score")))
    return t.groupBy(*by).agg((of(F.col("low")) * (1 - F.first("part")) + of(F.col("high")) * F.first("part")).alias("cutoff"))


def confusion(scores: DataFrame, by: list[str], cutoff: Column) -> DataFrame:
    """Counts and rates of ``score >= cutoff``; rates without rows are null."""
    hit, fake = F.col("score") >= cutoff, F.col("label") == 1
    counts = scores.groupBy(*by).agg(F.count_if(hit & fake).alias("tp"), F.count_if(~hit & fake).alias("fn"), F.count_if(hit & ~fake).alias("fp"), F.count_if(~hit & ~fake).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    recall, fpr = _ratio(tp, tp + fn), _ratio(fp, fp + tn)
    return counts.select("*", recall.alias("recall"), fpr.alias("fpr"), _ratio(tp, tp + fp).alias("precision"), ((recall + 1 - fpr) / 2).alias("balanced_acc"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def against_reals(scores: DataFrame, by: list[str], what: str) -> DataFrame:
    """AUROC of the fakes with each value of ``what`` against all reals of the group; the reals are not replicated."""
    at = curve(scores, by).select(*(F.col(c).alias(f"__{c}") for c in by), F.col("score").alias("__score"), (F.col("below_neg") + F.col("neg") * F.lit(0.5)).alias("beaten"), "n")
    fakes = scores.where("label = 1").groupBy(*by, what, F.col("score").cast("double").alias("score")).agg(F.count("*").alias("k"))
    match = F.col("score") == F.col("__score")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    area = F.sum(F.col("k") * F.col("beaten"))
    return fakes.join(at, match).groupBy(*by, what).agg(F.sum("k").alias("fakes"), F.try_divide(area, F.sum("k") * F.first("n").cast("double")).alias("auroc"))


def by_generator(scores: DataFrame, by: list[str]) -> DataFrame:
    """AUROC of each generator's fakes against all reals of the group."""
    return against_reals(scores.where("label = 0 OR generator != ''"), by, "generator")


def condition_report(scores: DataFrame, by: list[str], cutoff: Column | None = None) -> DataFrame:
    """by, auroc, fpr_at_tpr95, n, and rates at a cut-off."""
    out = auroc(scores, by).join(fpr_at_tpr(scores, by).withColumnRenamed("fpr_at_tpr", "fpr_at_tpr95"), by, "left").join(scores.groupBy(*by).agg(F.count("*").alias("n")), by)
    return out if cutoff is None else out.join(confusion(scores, by, cutoff).select(*by, "recall", "fpr", "balanced_acc", "accuracy"), by)


def summary(report: DataFrame, by: list[str], clean: str = "clean") -> DataFrame:
    """Mean, minimum and worst condition of AUROC over the conditions other than clean; nulls are left out."""
    rest = report.where(F.col("cond") != clean)
    return rest.groupBy(*by).agg(F.avg("auroc").alias("mean_auroc"), F.min("auroc").alias("min_auroc"), F.expr("min_by(cond, if(auroc IS NULL, NULL, struct(auroc, cond)))").alias("worst_cond"), F.max("fpr_at_tpr95").alias("worst_fpr"))


def cutoffs(scores: DataFrame, fa: float = 0.01, fixed: float = 0.5) -> DataFrame:
    """policy, cond and cutoff for the policies fixed, clean, pooled, per_condition and youden_clean.

    All come from one count of distinct scores by condition: the pooled group is its sum, and the quantiles of all
    groups are found together.
    """
    counts = written(counted(scores, ["cond"]))
    pooled = counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select(F.lit(True).alias("pooled"), F.lit(None).cast("string").alias("cond"), "score", "pos", "neg")
    found = written(quantile_of(counts.select(F.lit(False).alias("pooled"), "cond", "score", "pos", "neg").unionByName(pooled), ["pooled", "cond"], fa))
    best = _youden(curve_of(counts.where("cond = 'clean'").drop("cond"), []), [])
    conds = counts.select("cond").distinct()
    one = lambda name, table: conds.join(table).select(F.lit(name).alias("policy"), "cond", "cutoff")  # noqa: E731  one row joins
    return (
        conds.select(F.lit("fixed").alias("policy"), "cond", F.lit(fixed).alias("cutoff"))
        .unionByName(one("clean", found.where("NOT pooled AND cond = 'clean'").select("cutoff")))
        .unionByName(one("pooled", found.where("pooled").select("cutoff")))
        .unionByName(found.where("NOT pooled").select(F.lit("per_condition").alias("policy"), "cond", "cutoff"))
        .unionByName(one("youden_clean", best))
    )


def families() -> list[tuple[str, str]]:
    return [(c, f) for f, conds in FAMILIES.items() for c in conds]


def depth(cond: Column) -> Column:
    """0 for clean, k for stack k, null otherwise."""
    return F.when(cond == "clean", 0).when(cond.rlike("^stack[1-6]_rand$"), F.substring(cond, 6, 1).cast("int"))


def condition_order(cond: Column) -> list[Column]:
    """Keys to sort conditions by: clean first, the grid's next, then others, each by name."""
    return [(cond != "clean").cast("int"), (~cond.isin(*GRID)).cast("int"), cond]
