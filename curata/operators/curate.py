"""Corpus building: deduplication on keys, caps, splits, balance, allocation, held-out sets."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from curata.functions import dims
from curata.functions.seeded import order_key
from curata.operators.skips import excluding
from curata.session import written


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A minimum over structs: combined before the shuffle, so a hot key is no problem."""
    rest = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(first.alias("__first")).select(*key, "__first.*").select(*rows.columns)


def _placed(rows: DataFrame, stratum: list[str], seed: int | str, key: str = "path", most: Column | None = None) -> DataFrame:
    """``rows`` with rn, the seeded rank within a stratum, and __n, the stratum's size; with ``most`` only ranks up to it
    matter. A stratum is not a window of its own, but 4096 bins of the seeded order are: ranks in a bin are added to the
    number of rows in the bins before, so a stratum that is a third of the corpus is spread over many tasks."""
    order = order_key(seed, F.col(key))
    marked = rows.withColumn("__bin", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    whole = Window.partitionBy(*(f"__{c}" for c in stratum))
    bins = marked.groupBy(*(F.col(c).alias(f"__{c}") for c in stratum), F.col("__bin").alias("__at")).agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(whole.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("__before", before).withColumn("__n", F.sum("__k").over(whole)).drop("__k")
    match = F.col("__bin") == F.col("__at")
    for c in stratum:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = marked.join(bins, match)
    if most is not None:
        met = met.where(F.col("__before") < most)  # whole bins are behind the last rank that is asked for
    inside = F.row_number().over(Window.partitionBy(*stratum, "__bin").orderBy(order, F.col(key)))
    return met.withColumn("rn", (inside + F.col("__before")).cast("long")).drop("__bin", "__at", "__before", *(f"__{c}" for c in stratum))


def ranked(rows: DataFrame, stratum: list[str], seed: int | str, key: str = "path", most: Column | None = None) -> DataFrame:
    """``rows`` with rn, the seeded rank within a stratum."""
    return _placed(rows, stratum, seed, key, most).drop("__n")


#: Input files of so many bytes together are few rows: ranking them all is quicker than to look for the last ones.
FEW_BYTES = 64 << 20


def _few(rows: DataFrame) -> bool:
    """Whether the files that a plan reads are small, by their sizes; other inputs have no known size."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())) < FEW_BYTES


def _by_rank(rows: DataFrame, stratum: list[str], order: Column, limits: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """What cut() gives, by ranking all rows: for few rows. Strata are counted once, so that steps that follow each other
    do not read their rows twice as often each."""
    limited = limits(written(rows.groupBy(*stratum).agg(F.count("*").alias("n"))))
    asked = [c for c in limited.columns if c not in (*stratum, "n")]
    named = limited.select(*(F.col(c).alias(f"__l{k}") for k, c in enumerate(stratum)), *asked)
    match = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__l{k}")) for k, c in enumerate(stratum)), F.lit(True))
    ranked_ = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*stratum).orderBy(order, F.col(key))))
    met = ranked_.join(named, match, "left").withColumns({c: F.coalesce(F.col("__rn") <= F.col(c), F.lit(False)) for c in asked})
    return met.drop("__rn", *(f"__l{k}" for k in range(len(stratum))))


def cut(rows: DataFrame, stratum: list[str], order: Column, limits: Callable[[DataFrame], DataFrame], key: str = "path", few: bool | None = None) -> DataFrame:
    """``rows`` with columns that say whether a row is among the first of its stratum in the order of (order, key).

    ``order`` is a hexadecimal text, as order_key() gives; ``limits`` gets the strata with their numbers of rows n, and
    adds a column for each question: how many rows are the first ones (null: none). Rows are counted in 4096 bins of the
    order; only those of the bin that holds a limit are ranked, and the last of the first ones, a row for each stratum,
    decides for all others by comparison. So no row moves but those bins', and no stratum is a window of its own. Exactly
    as many rows are first as asked for, rows with repeated keys among them. Where the inputs are known to be small files
    (``few``), all rows are ranked instead, with the same result.
    """
    if _few(rows) if few is None else few:
        return _by_rank(rows, stratum, order, limits, key)
    names = [f"__s{k}" for k in range(len(stratum))]
    marked = rows.select(*(F.col(c).alias(n) for c, n in zip(stratum, names)), F.conv(F.substring(order, 1, 3), 16, 10).cast("int").alias("__bin"), order.alias("__o"), F.col(key).alias("__k"))
    bins = marked.groupBy(*names, "__bin").agg(F.count("*").alias("__c"))
    same = lambda left, right: reduce(and_, (F.col(f"{left}{n}").eqNullSafe(F.col(f"{right}{n}")) for n in names), F.lit(True))
    strata = bins.groupBy(*names).agg(F.sum("__c").alias("n"))
    limited = limits(strata.toDF(*stratum, "n"))
    asked = [c for c in limited.columns if c not in (*stratum, "n")]
    limited = limited.select(*(F.col(c).alias(f"l{n}") for c, n in zip(stratum, names)), *(F.when(F.col(c).isNotNull(), F.least(F.col(c), F.col("n"))).cast("long").alias(c) for c in asked))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*names).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = bins.withColumn("__before", before).join(limited, same("", "l"))
    needs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), (F.col(c) - F.col("__before")).alias("need")) for c in asked)))
    held = told.select(*(F.col(n).alias(f"h{n}") for n in names), F.col("__bin").alias("h__bin"), "__c", needs.alias("q")).where("q.need BETWEEN 1 AND __c").select("*", "q.name", "q.need")
    whole = Window.partitionBy(*names, "name")
    ranks = {"__rn": F.row_number().over(whole.orderBy("__o", "__k")), "__rank": F.rank().over(whole.orderBy("__o", "__k")), "__ties": F.count("*").over(Window.partitionBy(*names, "name", "__o", "__k"))}
    last = marked.join(held, same("", "h") & (F.col("__bin") == F.col("h__bin"))).withColumns(ranks).where(F.col("__rn") == F.col("need"))
    edge = F.struct(F.col("__o").alias("o"), F.col("__k").alias("k"), (F.col("need") - F.col("__rank") + 1).alias("room"), F.col("__ties").alias("ties"))
    found = last.groupBy(*(F.col(n).alias(f"e{n}") for n in names)).agg(*(F.max(F.when(F.col("name") == c, edge)).alias(f"__edge{i}") for i, c in enumerate(asked)))
    ends = [F.col(f"__edge{i}") for i in range(len(asked))]
    tied = reduce(or_, (F.coalesce(e["ties"] > e["room"], F.lit(False)) for e in ends))
    seen = Observation(f"cut-{uuid.uuid4().hex}")
    edges = written(found.observe(seen, F.count_if(tied).alias("tied")))  # a row for each stratum; Spark joins it by its size
    match = reduce(and_, (F.col(c).eqNullSafe(F.col(f"e{n}")) for c, n in zip(stratum, names)), F.lit(True))
    met = rows.join(edges, match, "left")
    place = F.struct(order.alias("o"), F.col(key).alias("k"))
    end = lambda e: F.struct(e["o"].alias("o"), e["k"].alias("k"))
    aside = [f"e{n}" for n in names] + [f"__edge{i}" for i in range(len(asked))]
    within = {c: F.coalesce(place <= end(e), F.lit(False)) for c, e in zip(asked, ends)}
    if not seen.get["tied"]:
        return met.withColumns(within).drop(*aside)
    # rows that repeat the order and key of a last one, of which only some have room: they are told apart by all they hold
    at_end = reduce(or_, (F.coalesce((place == end(e)) & (e["ties"] > e["room"]), F.lit(False)) for e in ends))
    alike = Window.partitionBy(*(F.col(c) for c in stratum), order, F.col(key)).orderBy(F.xxhash64(*rows.columns))
    ranked_ = met.where(at_end).withColumn("__nth", F.row_number().over(alike))
    some = ranked_.withColumns({c: F.coalesce((place < end(e)) | ((place == end(e)) & (F.col("__nth") <= e["room"])), F.lit(False)) for c, e in zip(asked, ends)})
    return met.where(~at_end).withColumns(within).drop(*aside).unionByName(some.drop(*aside, "__nth"))


def first_of(rows: DataFrame, stratum: list[str], n: Column, seed: int | str, key: str = "path") -> DataFrame:
    """The first ``n`` rows of each stratum in seeded order; n may depend on the stratum and its size n."""
    return cut(rows, stratum, order_key(seed, F.col(key)), lambda strata: strata.withColumn("__in", n), key).where("__in").drop("__in")


def stratified_sample(rows: DataFrame, stratum: list[str], n: int, seed: int | str, key: str = "path") -> DataFrame:
    return first_of(rows, stratum, F.lit(n), seed, key)


def source_cap(rows: DataFrame, caps: dict[str, int], seed: int | str, key: str = "path") -> DataFrame:
    """At most caps[source] rows of each capped source, chosen in seeded order; other sources are whole."""
    if not caps:
        return rows
    cap = F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))
    return first_of(rows, ["source"], F.coalesce(cap[F.col("source")].cast("long"), F.col("n")), seed, key)


def first_n(rows: DataFrame, group: list[str], n: int, order: list[str]) -> DataFrame:
    """The first n rows of each group in scan order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def seeded_limit(rows: DataFrame, n: int, seed: int | str, key: str = "path") -> DataFrame:
    return rows.orderBy(order_key(seed, F.col(key)), key).limit(n)


def split(rows: DataFrame, group: list[str], seed: int | str, key: str = "path", tenths: tuple[int, int] = (8, 1)) -> DataFrame:
    """``rows`` with split: per group the first tenths train, the next val, the rest test, in seeded order.

    Sizes are whole tenths of the group's size, rounded down, in whole numbers.
    """
    n = F.col("n")
    train = F.floor(n * tenths[0] / 10)
    told = cut(rows, group, order_key(seed, F.col(key)), lambda strata: strata.withColumns({"__train": train, "__seen": train + F.floor(n * tenths[1] / 10)}), key)
    return told.withColumn("split", F.when(F.col("__train"), "train").when(F.col("__seen"), "val").otherwise("test")).drop("__train", "__seen")


def balance_sizes(rows: DataFrame, cap: int = 0, equal: int = 0, min_bucket: int = 50) -> DataFrame:
    """bucket and keep: how many rows of each class a bucket keeps.

    That is the smaller class; with ``equal`` all buckets of ``min_bucket`` rows or more keep the least of these numbers
    (at most ``equal`` if positive, -1 is no limit) and smaller buckets none; ``cap`` bounds each.
    """
    return _keep(rows.groupBy("bucket", "label").agg(F.count("*").alias("n")), cap, equal, min_bucket).select(F.col("bucket").alias("__bucket"), "keep")


def _keep(counts: DataFrame, cap: int, equal: int, min_bucket: int) -> DataFrame:
    """As balance_sizes(), from rows (bucket, label, n)."""
    of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
    sizes = counts.groupBy("bucket").agg(F.least(of(0), of(1)).alias("n"))
    n = F.col("n")
    if equal:
        common = sizes.where(n >= min_bucket).agg(F.min("n").alias("common"))  # one row
        sizes = sizes.join(common)
        limit = F.col("common") if equal < 0 else F.least(F.col("common"), F.lit(equal))
        n = F.when(n < min_bucket, 0).otherwise(F.least(n, limit))
    if cap > 0:
        n = F.least(n, F.lit(cap))
    return sizes.select("bucket", n.cast("long").alias("keep"))


def balanced(rows: DataFrame, seed: int | str, key: str = "path", cap: int = 0, equal: int = 0, min_bucket: int = 50) -> DataFrame:
    """``rows`` with kept: in each bucket both classes keep as many rows, chosen in seeded order."""
    def limits(strata: DataFrame) -> DataFrame:
        keep = _keep(strata, cap, equal, min_bucket).select(F.col("bucket").alias("__bucket"), F.col("keep").alias("kept"))
        return strata.join(keep, F.col("bucket").eqNullSafe(F.col("__bucket"))).drop("__bucket")

    return cut(rows, ["bucket", "label"], order_key(seed, F.col(key)), limits, key)


def balanced_parts(rows: DataFrame, parts: dict[str, tuple[int | str, int, int, int]], key: str = "path") -> DataFrame:
    """As balanced(), for several values of split at once, each with its own (seed, cap, equal, min_bucket); rows of other
    splits are not kept."""
    order = F.lit(None).cast("string")
    for name, (seed, *_) in parts.items():
        order = F.when(F.col("split") == name, order_key(seed, F.col(key))).otherwise(order)

    def limits(strata: DataFrame) -> DataFrame:
        keep = None
        for name, (_, cap, equal, min_bucket) in parts.items():
            one = _keep(strata.where(F.col("split") == name), cap, equal, min_bucket).select(F.lit(name).alias("__split"), F.col("bucket").alias("__bucket"), F.col("keep").alias("kept"))
            keep = one if keep is None else keep.unionByName(one)
        return strata.join(keep, (F.col("split") == F.col("__split")) & F.col("bucket").eqNullSafe(F.col("__bucket")), "left").drop("__split", "__bucket")

    return cut(rows, ["split", "bucket", "label"], order, limits, key)


def levelled(available: DataFrame, by: list[str], cap: int) -> DataFrame:
    """``available`` (by, group, available: one row a group) with picks: ``cap`` of each ``by`` spread evenly over its
    groups, small ones giving all they have.

    In the order of their sizes, a group is whole if it has no more than an even share of what the groups before it left;
    the others get the same number, and what is left over goes to the last of them, one each.
    """
    all_of = Window.partitionBy(*by)
    order = all_of.orderBy("available", "group")
    before = F.coalesce(F.sum("available").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(all_of) - F.row_number().over(order) + 1
    told = available.withColumn("__whole", F.col("available") <= F.floor((F.lit(cap) - before) / left))
    some = F.count_if(~F.col("__whole")).over(all_of)
    spent = F.coalesce(F.sum(F.when(F.col("__whole"), F.col("available"))).over(all_of), F.lit(0))
    rest = F.greatest(F.lit(cap) - spent, F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*by, "__whole").orderBy("available", "group"))
    picks = F.when(F.col("__whole"), F.col("available")).otherwise(F.floor(rest / some) + (nth > some - rest % some).cast("long"))
    return told.withColumn("picks", picks.cast("long")).drop("__whole")


def allocate(available: DataFrame, cap: int) -> DataFrame:
    """group, available and picks: ``cap`` picks spread evenly over groups, small groups giving all they have."""
    return levelled(available.select("group", "available"), [], cap)


def hold_out_school(rows: DataFrame, generators: list[str]) -> DataFrame:
    """Rows without the fakes of some generators, but for those in the test split."""
    return rows.where(~((F.col("label") == 1) & F.col("generator").isin(*generators)) | (F.col("split") == "test"))


def route(rows: DataFrame, test_sources: set[str] = frozenset(), test_generators: set[str] = dims.TEST_ONLY) -> Column:
    """``test`` for sources and generators that training must not see, else ``split``."""
    hit = F.lit(False)
    if test_sources:
        hit = hit | F.col("source").isin(*sorted(test_sources))
    if test_generators:
        hit = hit | F.col("generator").isin(*sorted(test_generators))  # whatever the label
    return F.when(F.coalesce(hit, F.lit(False)), "test").otherwise("split")


def build_corpus(manifests: list[DataFrame], excluded: DataFrame | None = None, seed: int = 0, caps: dict[str, int] = dims.SOURCE_CAPS, test_sources: set[str] = frozenset(), test_generators: set[str] = dims.TEST_ONLY, cap: int = 45_000, equal: int = 0, min_bucket: int = 50) -> DataFrame:
    """Manifests in order to one table with bucket and split (train, val, test).

    Rows without a size and excluded paths go; the first row of each source file stays; capped sources are thinned; held
    out rows become test; other (source, generator) groups are split 80/10/10; train and val are balanced by bucket, and
    what is over joins test.
    """
    rows = None
    for k, m in enumerate(manifests):
        one = m.withColumn("__source_order", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.where("long > 0")
    if excluded is not None:
        rows = excluding(rows, excluded).where("NOT __excluded").drop("__excluded")
    rows = rows.withColumn("__key", dims.source_key(F.col("orig"), F.col("path")))
    rows = first_wins(rows, ["__key"], ["__source_order", "path"]).drop("__key", "__source_order")
    # each step reads its rows several times, so they are written once
    rows = written(rows.withColumn("bucket", dims.bucket(F.col("long"))))
    rows = source_cap(rows, caps, seed + 7)
    routed = rows.withColumn("__route", route(rows, test_sources, test_generators))
    parts = split(routed.where("__route = 'split'"), ["source", "generator"], seed)
    rules = {"train": (seed + 100, cap, equal, min_bucket), "val": (seed + 101, max(1, cap // 8) if cap else 0, max(1, equal // 8) if equal > 0 else equal, max(1, min_bucket // 8))}
    told = balanced_parts(parts, rules).withColumn("split", F.when(F.col("kept"), F.col("split")).otherwise("test")).drop("kept")
    held = routed.where("__route = 'test'").withColumn("split", F.lit("test"))
    return told.unionByName(held).drop("__route")


def disjoint_benchmark(candidates: DataFrame, training: DataFrame, per_generator: int, order: list[str]) -> DataFrame:
    """Candidates that share neither a generator (in normal form, omni_ prefix aside) nor bytes with training, capped."""
    seen = training.where("label = 1").select(F.explode(F.array(dims.norm_generator(F.col("generator")), dims.norm_generator(F.regexp_replace("generator", "^omni_", "")))).alias("__g")).distinct()
    fresh = candidates.join(seen, (F.col("label") == 1) & (dims.norm_generator(F.col("generator")) == F.col("__g")), "left_anti")
    fresh = fresh.join(training.select("sha256").where("sha256 IS NOT NULL").distinct(), "sha256", "left_anti")
    return first_n(fresh, ["generator"], per_generator, order)


def scores_by_condition(scores: DataFrame, manifest: DataFrame) -> DataFrame:
    """cond, n, matched and total_long: scores of each condition with the manifest row of their normalised path."""
    right = manifest.select(dims.norm_path(F.col("path")).alias("p"), "long")
    joined = scores.join(right, dims.norm_path(F.col("path")) == F.col("p"), "left")
    return joined.groupBy("cond").agg(F.count("*").alias("n"), F.count("long").alias("matched"), F.sum("long").alias("total_long"))


def with_orig(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and orig, the manifest's source file of the path; empty if it has none."""
    return rows.join(manifest.select("path", "orig"), "path", "left").select("path", F.coalesce("orig", F.lit("")).alias("orig"))


def drop_reasons(probe: DataFrame, training: DataFrame, near: DataFrame) -> DataFrame:
    """``probe`` with reason: unreadable, byte-identical or near-duplicate, the first that holds; null rows are kept.

    ``near`` has the paths of probe rows with a near duplicate in training.
    """
    same = training.select("sha256").where("sha256 IS NOT NULL").distinct().withColumn("__same", F.lit(True))
    close = near.select("path").distinct().withColumn("__near", F.lit(True))
    marked = probe.join(same, "sha256", "left").join(close, "path", "left")
    reason = F.when(F.col("sha256").isNull(), "unreadable").when(F.col("__same"), "byte-identical").when(F.col("__near"), "near-duplicate")
    return marked.withColumn("reason", reason).drop("__same", "__near")


def edit_eval(rows: DataFrame, trained: list[DataFrame], test: DataFrame, seed: int | str) -> DataFrame:
    """Rows of no training set, reals only from ``test``, with as many reals as fakes in each bucket."""
    seen = trained[0].select("orig")
    for t in trained[1:]:
        seen = seen.union(t.select("orig"))
    free = rows.join(seen.distinct(), "orig", "left_anti")
    reals = free.where("label = 0").join(test.select("orig").distinct(), "orig", "left_semi")
    return balanced(reals.unionByName(free.where("label = 1")), seed).where("kept").drop("kept")


def mix_half(clean: DataFrame, augmented: DataFrame, seed: int | str, key: str = "path") -> DataFrame:
    """Clean rows and as many augmented ones, first in seeded order (fewer if there are not as many)."""
    want = clean.agg(F.count("*").alias("__want"))  # one row
    picked = cut(augmented, [], order_key(seed, F.col(key)), lambda strata: strata.join(want), key)
    return clean.unionByName(picked.where("__want").drop("__want"))


def require(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """``rows``, failing on the first one without the condition."""
    return rows.where(F.coalesce(F.assert_true(condition, message).isNull(), F.lit(True)))
