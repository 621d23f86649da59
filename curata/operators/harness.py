"""Whole evaluations and builds, each from its tables to one result: the harness, generator tests, manifests, data state."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.seeded import order_key
from curata.operators import curate, dedup, metrics
from curata.operators.order_statistics import order_statistic
from curata.session import written


def _long(table: DataFrame, section: str, name: Column, values: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(f"`{v}`").cast("double").alias("value")) for v in values))).alias("p")
    return table.select(F.lit(section).alias("section"), name.alias("name"), pairs).select("section", "name", "p.metric", "p.value")


def evaluate(scores: DataFrame, threshold: float | None = None, k: int = 20, clean: str = "clean") -> DataFrame:
    """section, name, metric and value of a whole evaluation of scores (path, label, generator, cond, score).

    ``condition``: AUROC, tpr, fpr and accuracy of each condition at one threshold: the given one, else Youden's on the
    clean scores. ``summary``: the threshold, the clean values, means and worst values over the other conditions (null if
    there are none), and the condition of the worst AUROC. ``generator``: AUROC of a generator's fakes against all reals and
    their share at or above the threshold, clean, mean and worst. ``false_positive`` and ``false_negative``: the k most
    confident mistakes on clean scores, ties by path.
    """
    scores = written(scores.where("score IS NOT NULL AND label IN (0, 1)").select("path", "label", F.coalesce("generator", F.lit("")).alias("generator"), "cond", F.col("score").cast("double").alias("score")))
    if threshold is None:
        found = metrics.youden(scores.where(F.col("cond") == clean), []).first()
        threshold = found["cutoff"] if found else None
    cut = F.lit(threshold).cast("double")
    rated = metrics.confusion(scores, ["cond"], cut).select("cond", F.col("recall").alias("tpr"), "fpr", F.col("accuracy").alias("acc"))
    table = written(metrics.auroc(scores, ["cond"]).join(rated, "cond"))
    of_condition = _long(table, "condition", F.col("cond"), ["auroc", "tpr", "fpr", "acc"])

    rest, own = F.col("cond") != clean, F.col("cond") == clean
    over = lambda f, c, which: f(F.when(which, F.col(c)))
    summary = table.agg(
        F.max(cut).alias("threshold"),
        *(over(F.max, c, own).alias(f"clean_{c}") for c in ("auroc", "tpr", "fpr")),
        *(over(F.avg, c, rest).alias(f"mean_{c}") for c in ("auroc", "tpr", "fpr")),
        over(F.min, "auroc", rest).alias("worst_auroc"), over(F.min, "tpr", rest).alias("worst_tpr"), over(F.max, "fpr", rest).alias("worst_fpr"),
    )
    told = _long(summary, "summary", F.lit("all"), summary.columns)
    worst = table.where(rest & F.col("auroc").isNotNull()).orderBy("auroc", "cond").limit(1)
    told = told.unionByName(worst.select(F.lit("summary").alias("section"), F.col("cond").alias("name"), F.lit("worst_condition").alias("metric"), F.col("auroc").alias("value")))

    caught = scores.where("label = 1 AND generator != ''").groupBy("cond", "generator").agg(F.avg((F.col("score") >= cut).cast("double")).alias("catch"))
    by = metrics.by_generator(scores, ["cond"]).join(caught, ["cond", "generator"])
    each = by.groupBy("generator").agg(*(over(f, c, w).alias(f"{n}_{c}") for c in ("auroc", "catch") for n, f, w in (("clean", F.max, own), ("mean", F.avg, rest), ("worst", F.min, rest))))
    of_generator = _long(each, "generator", F.col("generator"), [c for c in each.columns if c != "generator"])

    at = scores.where(own)
    fp = at.where((F.col("label") == 0) & (F.col("score") >= cut)).orderBy(F.desc("score"), "path").limit(k)
    fn = at.where((F.col("label") == 1) & (F.col("score") < cut)).orderBy("score", "path").limit(k)
    wrong = _long(fp, "false_positive", F.col("path"), ["score"]).unionByName(_long(fn, "false_negative", F.col("path"), ["score"]))
    return of_condition.unionByName(told).unionByName(of_generator).unionByName(wrong)


def generator_sets(scores: DataFrame, threshold: float = 0.5, fas: Iterable[float] = (0.01, 0.05)) -> DataFrame:
    """section, name, metric and value for scored folders (set, label, score, size).

    ``set``: number, median, mean, share at or above the threshold, and for sets of fakes the AUROC against the reals of
    all sets; ``size``: the most frequent size of a set, its number as the value, ties by name. ``pooled``: all fakes
    against all reals; and at each rate of false alarms the reals' quantile, the share of fakes caught there, and the set
    with the smallest share.
    """
    rows = written(scores.where("score IS NOT NULL").select("set", "label", F.col("score").cast("double").alias("score"), "size"))
    middle = order_statistic(rows, ["set"], "score", F.floor((F.col("n") + 1) / 2)).withColumnRenamed("value", "low")
    middle = middle.join(order_statistic(rows, ["set"], "score", F.floor(F.col("n") / 2) + 1), "set").select("set", ((F.col("low") + F.col("value")) / 2).alias("median"))
    plain = rows.groupBy("set").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.avg((F.col("score") >= threshold).cast("double")).alias("over")).join(middle, "set")
    area = metrics.against_reals(rows, [], "set").select("set", "auroc")
    of_set = _long(plain, "set", F.col("set"), ["n", "median", "mean", "over"]).unionByName(_long(area, "set", F.col("set"), ["auroc"]))
    sizes = rows.groupBy("set", "size").agg(F.count("*").alias("n")).groupBy("set").agg(F.min_by(F.struct("size", "n"), F.struct((-F.col("n")).alias("m"), F.col("size"))).alias("t"))
    out = of_set.unionByName(sizes.select(F.lit("size").alias("section"), F.col("set").alias("name"), F.col("t.size").alias("metric"), F.col("t.n").cast("double").alias("value")))
    rate = lambda label, cut: F.avg(F.when(F.col("label") == label, (F.col("score") >= cut).cast("double")))
    pooled = rows.agg(rate(1, threshold).alias("catch"), rate(0, threshold).alias("false_alarms")).join(metrics.auroc(rows, []))
    out = out.unionByName(_long(pooled, "pooled", F.lit("all"), ["auroc", "catch", "false_alarms"]))
    for fa in fas:
        cut = metrics.quantile_cutoff(rows, [], fa)  # one row
        fakes = written(rows.where("label = 1").join(cut).withColumn("hit", (F.col("score") >= F.col("cutoff")).cast("double")))
        whole = fakes.agg(F.max("cutoff").alias(f"cutoff_{fa}"), F.avg("hit").alias(f"catch_{fa}"))
        least = fakes.groupBy("set").agg(F.avg("hit").alias(f"worst_{fa}")).orderBy(f"`worst_{fa}`", "set").limit(1)
        out = out.unionByName(_long(whole, "pooled", F.lit("all"), whole.columns)).unionByName(_long(least, "pooled", F.col("set"), [f"worst_{fa}"]))
    return out


def labelled_manifest(listed: DataFrame, disk: DataFrame, source: str, seed: int | str, per_group: int, held: set[str] = frozenset(), forbidden: set[str] = frozenset(), official: dict[str, str] = {}, tenths: tuple[int, int] = (1, 1)) -> DataFrame:
    """path, label, generator, source and split of the files on disk that label tables (list, image_path, is_fake) name.

    Rows of forbidden lists go, and those of a list whose path has its ``official`` mark (in lower case); a path is resolved by its longest suffix, and goes if no file or
    several have it; a file that is named twice counts once, in the order of lists. Of each (label, generator) at most
    ``per_group`` stay, in seeded order; fakes of ``held`` generators are test only; of the others the first tenths of
    all are test, the next val, the rest train, in whole numbers.
    """
    rows = listed.where(~F.lower("list").isin(*sorted(forbidden))) if forbidden else listed
    for name, mark in official.items():
        rows = rows.where(~((F.lower("list") == name) & F.lower("image_path").contains(mark)))
    found = dedup.suffix_join(rows.select(F.col("image_path").alias("path")).distinct(), disk).where("status = 'resolved'").select(F.col("path").alias("image_path"), "match")
    label = F.coalesce(F.col("is_fake").cast("int"), F.lit(1))
    named = rows.join(found, "image_path").select(F.col("match").alias("path"), label.alias("label"), F.when(label == 1, F.lower("list")).otherwise("").alias("generator"), "list")
    rows = written(curate.first_wins(named, ["path"], ["list", "label"]).select("path", "label", "generator", F.lit(source).alias("source")))
    kept = written(curate.stratified_sample(rows, ["label", "generator"], per_group, seed))
    hold = (F.col("label") == 1) & F.col("generator").isin(*sorted(held)) if held else F.lit(False)
    n = F.col("n")
    test = F.floor(n * tenths[0] / 10)
    rest = curate.cut(kept.where(~hold), [], order_key(f"{seed}|split", F.col("path")), lambda strata: strata.withColumns({"__test": test, "__seen": test + F.floor(n * tenths[1] / 10)}))
    split = F.when(F.col("__test"), "test").when(F.col("__seen"), "val").otherwise("train")
    return rest.withColumn("split", split).drop("__test", "__seen").unionByName(kept.where(hold).withColumn("split", F.lit("test")))


def data_state(rows: DataFrame, n: int = 10) -> DataFrame:
    """section, split, key and n: the state of a manifest (split, label, generator, source, bucket) as one table.

    ``label`` and ``bucket``: rows of each; ``top_generator`` and ``top_source``: the n most frequent values of a split,
    ties by name; ``only_test``: generators of test that train does not have, with their rows in test.
    """
    count = lambda section, key, part=rows: part.groupBy("split", key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "split", "key", "n")
    from curata.operators.audit import top_n

    fakes = rows.where("label = 1")
    tops = [top_n(part, ["split"], c, n).select(F.lit(f"top_{c}").alias("section"), "split", F.col(c).alias("key"), "n") for part, c in ((fakes, "generator"), (rows, "source"))]
    unseen = fakes.where("split = 'test'").select("generator").exceptAll(fakes.where("split = 'test'").select("generator").join(fakes.where("split = 'train'").select("generator").distinct(), "generator"))
    only = unseen.groupBy(F.col("generator").alias("key")).agg(F.count("*").alias("n")).select(F.lit("only_test").alias("section"), F.lit("test").alias("split"), "key", "n")
    out = count("label", F.col("label").cast("string")).unionByName(count("bucket", F.coalesce("bucket", F.lit("none"))))
    for t in (*tops, only):
        out = out.unionByName(t)
    return out
