"""Reports over long score tables (.., cond, label 0/1, score): slices, families, pools, generators, models and errors.

Each report is a DataFrame of a few rows. Cut-offs are tables of few rows that are joined; rows of scores are never
replicated to form a slice, and slices that lack reals are measured against the curve of all reals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import dims
from curata.operators import curate, metrics


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by``, where nulls are equal; one-row tables join to all rows if ``by`` is empty."""
    if not by:
        return left.join(right, how="cross")
    other = right.select(*(F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in right.columns))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    return left.join(other, match, how).drop(*(f"__{c}" for c in by))


def at_cutoff(scores: DataFrame, by: list[str], cutoff: Column) -> DataFrame:
    """by, n, reals, fakes, caught and flagged: the shares of fakes and of reals at or above the cut-off."""
    hit = (F.col("score") >= cutoff).cast("double")
    share = lambda label: F.avg(F.when(F.col("label") == label, hit))
    return scores.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("reals"), F.count_if(F.col("label") == 1).alias("fakes"), share(1).alias("caught"), share(0).alias("flagged"))


def rated(scores: DataFrame, by: list[str], cutoff: Column) -> DataFrame:
    """``at_cutoff`` with the AUROC of each group."""
    return _same(at_cutoff(scores, by, cutoff), metrics.auroc(scores, by), by)


def with_cutoff(scores: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``scores`` with the cutoff of their group; groups are few."""
    return _same(scores, table, by)


def confusion_slices(scores: DataFrame, slice_by: str, fa: float = 0.01, least: int = 20, borrow: int = 10) -> DataFrame:
    """name, n, auroc, tp, fn, fp, tn, recall, fpr and own_cutoff of each slice at one cut-off over all reals.

    Slices of fewer than ``least`` rows are left out; a slice with fewer than ``borrow`` reals is judged against all reals.
    """
    cut = metrics.quantile_cutoff(scores, [], fa)
    marked = with_cutoff(scores, cut, []).withColumn("name", F.col(slice_by))
    own = metrics.confusion(marked.where("name IS NOT NULL"), ["name"], F.col("cutoff")).select("name", "tp", "fn", "fp", "tn")
    own = own.where(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn") >= least)
    whole = metrics.confusion(marked, [], F.col("cutoff")).select(F.col("fp").alias("all_fp"), F.col("tn").alias("all_tn")).join(cut, how="cross")
    named = marked.where("name IS NOT NULL")
    inside = _same(metrics.auroc(named, ["name"]), metrics.quantile_cutoff(named, ["name"], fa).withColumnRenamed("cutoff", "in_cutoff"), ["name"], "left")
    outside = metrics.against_reals(marked.where("name IS NOT NULL OR label = 0"), [], "name").select("name", F.col("auroc").alias("out_auroc"))
    rows = _same(_same(own, inside, ["name"], "left"), outside, ["name"], "left").join(whole, how="cross")
    lent = F.col("fp") + F.col("tn") < borrow
    pick = lambda a, b: F.when(lent, F.col(a)).otherwise(F.col(b))
    out = rows.select("name", "tp", "fn", pick("all_fp", "fp").alias("fp"), pick("all_tn", "tn").alias("tn"), pick("out_auroc", "auroc").alias("auroc"), pick("cutoff", "in_cutoff").alias("own_cutoff"), lent.alias("borrowed"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return out.select("name", (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n"), "borrowed", "auroc", "tp", "fn", "fp", "tn", ratio("tp", "fn").alias("recall"), ratio("fp", "tn").alias("fpr"), "own_cutoff")


def deployment_slices(scores: DataFrame, seed: int | str, fa: float = 0.01) -> DataFrame:
    """slice (clean, augmented, mix), cutoff, auroc and the confusion at each slice's own cut-off.

    The mix is all clean rows and as many augmented ones, chosen in seeded order.
    """
    keyed = scores.select("cond", "label", "score", F.concat_ws("|", "path", "cond").alias("key"))
    clean, augmented = keyed.where("cond = 'clean'"), keyed.where("cond != 'clean'")
    mixed = curate.mix_half(clean, augmented, seed, "key")
    parts = [(n, t.select(F.lit(n).alias("slice"), "label", "score")) for n, t in (("clean", clean), ("augmented", augmented), ("mix", mixed))]
    rows = reduce(DataFrame.unionByName, (t for _, t in parts))
    cut = metrics.quantile_cutoff(rows, ["slice"], fa)
    table = metrics.confusion(with_cutoff(rows, cut, ["slice"]), ["slice"], F.col("cutoff")).select("slice", "tp", "fn", "fp", "tn", "recall", "fpr")
    return _same(_same(table, cut, ["slice"]), metrics.auroc(rows, ["slice"]), ["slice"])


def families(scores: DataFrame, fa: float = 0.01) -> DataFrame:
    """family, conds, and mean and worst of AUROC, caught and flagged over its conditions, at the cut-off of clean reals.

    Families are those of the grid, every other condition by itself, and ``all transformed``.
    """
    cut = metrics.quantile_cutoff(scores.where("cond = 'clean'"), [], fa)
    table = rated(with_cutoff(scores, cut, []), ["cond"], F.col("cutoff"))
    family = F.create_map(*(F.lit(x) for pair in metrics.families() for x in pair))
    groups = F.array_compact(F.array(F.coalesce(family[F.col("cond")], F.col("cond")), F.when(F.col("cond") != "clean", F.lit("all transformed"))))
    rows = table.withColumn("family", F.explode(groups))
    return rows.groupBy("family").agg(F.count("*").alias("conds"), F.avg("auroc").alias("mean_auroc"), F.min("auroc").alias("worst_auroc"), F.avg("caught").alias("mean_caught"), F.min("caught").alias("worst_caught"), F.avg("flagged").alias("mean_flagged"), F.max("flagged").alias("worst_flagged"))


def pooled(scores: DataFrame, group: str, cutoff: float) -> DataFrame:
    """group, n, weight, fakes, reals, auroc, caught and flagged of each group, and of all as ``POOLED``: one ranking."""
    whole = rated(scores, [], F.lit(cutoff)).withColumn("group", F.lit("POOLED"))
    rows = rated(scores, [group], F.lit(cutoff)).withColumnRenamed(group, "group").unionByName(whole)
    total = scores.agg(F.count("*").alias("total"))
    return rows.join(total, how="cross").select("group", "n", (F.col("n") / F.col("total")).alias("weight"), "fakes", "reals", "auroc", "caught", "flagged")


def model_card(scores: DataFrame, external: DataFrame, fa: float = 0.01, fixed: float = 0.15) -> DataFrame:
    """model, policy (rule, fixed), cutoff, and rates on external rows, on clean and on transformed ones of ``scores``.

    The rule's cut-off leaves a share ``fa`` of the model's external reals above it. Both tables have a column model.
    """
    rule = metrics.quantile_cutoff(external, ["model"], fa).select("model", F.lit("rule").alias("policy"), "cutoff")
    cut = rule.unionByName(rule.select("model", F.lit("fixed").alias("policy"), F.lit(fixed).alias("cutoff")))
    key = ["model", "policy"]
    outer = at_cutoff(_same(external, cut, ["model"]), key, F.col("cutoff")).select(*key, F.col("caught").alias("external_caught"), F.col("flagged").alias("external_flagged"))
    conds = at_cutoff(_same(scores, cut, ["model"]), [*key, "cond"], F.col("cutoff"))
    over = lambda f, c, clean: f(F.when((F.col("cond") == "clean") if clean else (F.col("cond") != "clean"), F.col(c)))
    rates = conds.groupBy(*key).agg(over(F.max, "caught", True).alias("clean_caught"), over(F.max, "flagged", True).alias("clean_flagged"), over(F.avg, "caught", False).alias("mean_caught"), over(F.avg, "flagged", False).alias("mean_flagged"), over(F.max, "flagged", False).alias("worst_flagged"))
    return cut.join(outer, key).join(_same(rule.select("model"), metrics.auroc(external, ["model"]), ["model"]), "model").join(rates, key, "left")


def generators(scores: DataFrame, cutoff: float) -> DataFrame:
    """generator, fakes, and AUROC against all reals and catch rate: clean, and mean and worst over other conditions."""
    area = metrics.by_generator(scores, ["cond"])
    caught = scores.where("label = 1 AND generator != ''").groupBy("cond", "generator").agg(F.avg((F.col("score") >= cutoff).cast("double")).alias("caught"))
    both = area.join(caught, ["cond", "generator"])
    clean = lambda c: F.max(F.when(F.col("cond") == "clean", F.col(c)))
    rest = lambda f, c: f(F.when(F.col("cond") != "clean", F.col(c)))
    return both.groupBy("generator").agg(F.max("fakes").alias("fakes"), *(x for c in ("auroc", "caught") for x in (clean(c).alias(f"clean_{c}"), rest(F.avg, c).alias(f"mean_{c}"), rest(F.min, c).alias(f"worst_{c}"))))


def bucket_spread(scores: DataFrame, fa: float = 0.01) -> DataFrame:
    """One row: best and worst bucket by AUROC, their spread, and the span of the buckets' own cut-offs."""
    rows = scores.where("bucket IS NOT NULL")
    table = metrics.auroc(rows, ["bucket"]).join(metrics.quantile_cutoff(rows, ["bucket"], fa), "bucket").where("auroc IS NOT NULL")
    key = F.struct("auroc", "bucket")
    return table.agg(F.max_by("bucket", key).alias("best"), F.min_by("bucket", key).alias("worst"), (F.max("auroc") - F.min("auroc")).alias("spread"), F.min("cutoff").alias("low_cutoff"), F.max("cutoff").alias("high_cutoff"), (F.max("cutoff") - F.min("cutoff")).alias("cutoff_span"))


def size_matched(scores: DataFrame, seed: int | str, fa: float = 0.01) -> DataFrame:
    """bucket (and ``pooled``), n of a set with as many reals as fakes in each bucket, its AUROC, and that of all rows."""
    kept = curate.balanced(scores.where("bucket IS NOT NULL"), seed).where("kept")
    cut = metrics.quantile_cutoff(kept, [], fa)
    each = rated(with_cutoff(kept, cut, []), ["bucket"], F.col("cutoff"))
    whole = rated(with_cutoff(kept, cut, []), [], F.col("cutoff")).withColumn("bucket", F.lit("pooled"))
    before = metrics.auroc(scores.where("bucket IS NOT NULL"), ["bucket"]).unionByName(metrics.auroc(scores, []).withColumn("bucket", F.lit("pooled"))).withColumnRenamed("auroc", "unmatched")
    return each.unionByName(whole).join(before, "bucket").select("bucket", "n", "auroc", "caught", "unmatched")


def external(scores: DataFrame, trained: DataFrame, fa: float = 0.01) -> DataFrame:
    """kind, name, n, auroc and caught at the cut-off of the set's own reals: each generator with whether training saw it,
    the means over generators that it saw and that it did not, and all fakes as ``POOLED``."""
    cut = metrics.quantile_cutoff(scores, [], fa)
    rows = with_cutoff(scores, cut, [])
    caught = rows.where("label = 1 AND generator != ''").groupBy("generator").agg(F.avg((F.col("score") >= F.col("cutoff")).cast("double")).alias("caught"))
    seen = trained.select(dims.norm_generator(F.col("generator")).alias("__g")).where("__g != ''").distinct()
    each = metrics.by_generator(scores, []).join(caught, "generator").join(seen, dims.norm_generator(F.col("generator")) == F.col("__g"), "left")
    each = each.select(F.when(F.col("__g").isNotNull(), "TRAINED").otherwise("unseen").alias("kind"), F.col("generator").alias("name"), F.col("fakes").alias("n"), "auroc", "caught")
    means = each.groupBy("kind").agg(F.count("*").alias("n"), F.avg("auroc").alias("auroc"), F.avg("caught").alias("caught")).select("kind", F.lit("mean").alias("name"), "n", "auroc", "caught")
    whole = rated(rows, [], F.col("cutoff")).select(F.lit("all").alias("kind"), F.lit("POOLED").alias("name"), F.col("fakes").alias("n"), "auroc", "caught")
    return each.unionByName(means).unionByName(whole)


def worst(scores: DataFrame, manifest: DataFrame, cutoff: float, k: int = 20) -> DataFrame:
    """kind, path, orig and pred of the k most confident mistakes of either kind; ties by path."""
    fp = scores.where((F.col("label") == 0) & (F.col("score") >= cutoff)).orderBy(F.desc("score"), "path").limit(k)
    fn = scores.where((F.col("label") == 1) & (F.col("score") < cutoff)).orderBy("score", "path").limit(k)
    both = fp.select(F.lit("false_positive").alias("kind"), "path", "score").unionByName(fn.select(F.lit("false_negative").alias("kind"), "path", "score"))
    found = curate.with_orig(both.select("path").distinct(), manifest)
    return both.join(found, "path").select("kind", "path", "orig", F.round("score", 4).alias("pred"))


def rules_auroc(votes: DataFrame, rules: list[str]) -> DataFrame:
    """rule and auroc of each way to join crop scores, of one row (label, .. rules) for each image."""
    return metrics.auroc(votes.unpivot(["label"], rules, "rule", "score"), ["rule"])


def provenance_detail(told: DataFrame, examples: int = 5) -> DataFrame:
    """section, key, n and examples: rows by rule, disagreements by (split, source, generator), unresolved by (split, source).

    Examples are the first paths in seeded order: a bounded number of rows in each section and key.
    """
    sections = (
        ("rule", F.lit(True), F.col("rule")),
        ("disagrees", F.col("state") == "disagrees", F.concat_ws("|", "split", "source", "generator")),
        ("unresolved", F.col("state") == "unresolved", F.concat_ws("|", "split", "source")),
    )
    tagged = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("section"), k.alias("key"))) for n, c, k in sections)))
    rows = told.select("path", F.explode(tagged).alias("t")).select("path", "t.*")
    counts = rows.groupBy("section", "key").agg(F.count("*").alias("n"))
    few = curate.ranked(rows, ["section", "key"], 0, most=F.lit(examples)).where(F.col("rn") <= examples)
    shown = few.groupBy("section", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "path"))), lambda x: x["path"]), " ").alias("examples"))
    return counts.join(shown, ["section", "key"])
