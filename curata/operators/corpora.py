"""Variants of a corpus: merges, repairs, rebuilds, allocations, and the contract that a corpus must keep."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import dims
from curata.functions.seeded import order_key
from curata.operators import audit, curate
from curata.session import written


@dataclass(frozen=True)
class Contract:
    """What train and val must keep. ``from_json`` reads it from a document with the same names."""

    holdout_generators: frozenset[str] = frozenset(dims.HOLD_OUT)
    partial_edit_generators: frozenset[str] = frozenset(dims.PARTIAL_EDITS)
    bucket_ratio_min: float = 0.8
    bucket_ratio_max: float = 1.25
    min_bucket: int = 50
    class_balance: bool = True
    no_file_in_two_splits: bool = True

    @classmethod
    def from_json(cls, text: str) -> Contract:
        import json

        held = {k: frozenset(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}
        unknown = set(held) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"no such clause: {sorted(unknown)}")
        return cls(**held)


def _verdict(name: str, rows: DataFrame) -> DataFrame:
    """check, bad and verdict from one row with bad."""
    return rows.select(F.lit(name).alias("check"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"), F.when(F.col("bad") > 0, "FAIL").otherwise("PASS").alias("verdict"))


def contract(rows: DataFrame, terms: Contract) -> DataFrame:
    """check, bad (rows, splits, buckets or files that break it) and verdict, for a manifest with split and bucket."""
    dev = rows.where("split IN ('train', 'val')")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias("bad")
    counted = dev.agg(
        count(F.col("generator").isin(*sorted(terms.holdout_generators))).alias("holdout"),
        count(F.col("generator").isin(*sorted(terms.partial_edit_generators))).alias("edits"),
        count(dims.forbidden_slice(F.col("orig"))).alias("slices"),
    )
    out = [_verdict(n, counted.select(F.col(c).alias("bad"))) for n, c in (("held-out generators", "holdout"), ("partial edits", "edits"), ("forbidden slices", "slices"))]
    if terms.class_balance:
        out.append(_verdict("class balance", audit.class_counts(dev, ["split"]).agg(count(F.col("reals") != F.col("fakes")))))
    sized = audit.class_counts(dev.where("bucket IS NOT NULL"), ["split", "bucket"]).where(F.col("reals") + F.col("fakes") >= terms.min_bucket)
    ratio = F.try_divide(F.col("reals").cast("double"), F.col("fakes").cast("double"))
    out.append(_verdict("bucket balance", sized.agg(count((F.col("reals") == 0) | (F.col("fakes") == 0) | ~ratio.between(terms.bucket_ratio_min, terms.bucket_ratio_max)))))
    if terms.no_file_in_two_splits:
        keyed = rows.select(dims.source_key(F.col("orig"), F.col("path")).alias("key"), "split")
        out.append(_verdict("one split a file", audit.split_leaks(keyed).agg(F.count("*").alias("bad"))))
    return reduce(DataFrame.unionByName, out)


def gates(rows: DataFrame, targets: DataFrame, eval_set: bool = False, shortcut: DataFrame | None = None, canary: DataFrame | None = None) -> DataFrame:
    """gate and verdict of all gates: provenance, buckets, native size and content of the training split, and, where
    their tables (auroc) are given, the shortcut and the canary audit. ``audit.enforce`` turns a FAIL into an error."""
    worst = lambda table, name: table.agg(F.max(F.when(F.col("verdict") == "FAIL", 3).when(F.col("verdict").isin("WARN", "CHECK", "CAVEAT"), 2).when(F.col("verdict").isin("PASS", "OK"), 1).otherwise(0)).alias("v")).select(F.lit(name).alias("gate"), F.when(F.col("v") == 3, "FAIL").when(F.col("v") == 2, F.lit("CAVEAT") if name == "native size" else F.lit("WARN")).when(F.col("v") == 1, "PASS").otherwise("SKIP").alias("verdict"))
    train = rows if eval_set else rows.where("split = 'train'")
    told = audit.provenance(rows, targets).select(F.when(F.col("state") == "disagrees", "FAIL").otherwise("PASS").alias("verdict"))
    parts = [
        worst(told, "label provenance"),
        worst(audit.bucket_balance(rows), "bucket balance"),
        worst(audit.native_size(train, eval_set=eval_set), "native size"),
        worst(audit.bucket_content(train), "content in buckets"),
    ]
    if shortcut is not None:
        parts.append(shortcut.select(F.lit("shortcut").alias("gate"), F.when(F.col("auroc") <= 0.6, "PASS").when(F.col("auroc") <= 0.65, "CAVEAT").otherwise("FAIL").alias("verdict")))
    if canary is not None:
        parts.append(canary.agg(F.max("auroc").alias("auroc")).select(F.lit("canary").alias("gate"), F.when(F.col("auroc") <= 0.65, "PASS").otherwise("CAVEAT").alias("verdict")))
    return reduce(DataFrame.unionByName, parts)


def repair(rows: DataFrame, bad_generators: set[str], seed: int | str) -> DataFrame:
    """A corpus (split, bucket) without bogus rows, repeated source files and leaks, balanced again.

    Of each file one row stays: a training row, else a validation row, which joins test if the file is also in training;
    what the balance leaves over joins test; test rows of files that training or validation kept go.
    """
    sound = rows.where(~dims.bogus(F.col("label"), F.col("source"), F.col("generator"), bad_generators))
    # ranks read their rows twice, so each step's rows are written once
    train = written(curate.first_wins(sound.where("split = 'train'"), ["orig"], ["path"]))
    val = sound.where("split = 'val'")
    seen = train.select("orig")
    moved = val.join(seen, "orig", "left_semi")
    val = val.join(seen, "orig", "left_anti")
    even = [curate.balanced(t, s).withColumn("split", F.when(F.col("kept"), F.lit(n)).otherwise("test")).drop("kept") for t, s, n in ((train, f"{seed}train", "train"), (val, f"{seed}val", "val"))]
    placed = written(even[0].unionByName(even[1]))
    dev = placed.where("split != 'test'")
    test = sound.where("split = 'test'").unionByName(moved.withColumn("split", F.lit("test")).select(*sound.columns)).unionByName(placed.where("split = 'test'").select(*sound.columns))
    test = curate.first_wins(test.join(dev.select("orig").distinct(), "orig", "left_anti"), ["orig"], ["path"])
    return dev.select(*sound.columns).unionByName(test.select(*sound.columns))


def merge(base: DataFrame, extra: DataFrame, seed: int | str, held: Column, tenths: tuple[int, int] = (8, 1), by: list[str] | None = None) -> DataFrame:
    """``base`` with the rows of ``extra`` (both with split): of these, rows of the forbidden slice go, ``held`` rows join
    test, and the others are split within ``by`` (all together if empty)."""
    free = extra.drop("split").where(~dims.official_slice(F.col("orig")))
    hold = F.coalesce(held, F.lit(False))
    parts = curate.split(free.where(~hold), by or [], seed, tenths=tenths).unionByName(free.where(hold).withColumn("split", F.lit("test")))
    return base.unionByName(parts.select(*base.columns))


def merge_sources(base: DataFrame, extra: DataFrame, seed: int, test_only: set[str], only: set[str] | None = None) -> DataFrame:
    """``base`` with the rows of ``extra`` (path, source, label, bucket), split by source and balanced by bucket.

    Only the sources ``only`` are taken, if given; sources in ``test_only`` join test whole.
    """
    if only:
        extra = extra.where(F.col("source").isin(*sorted(only)))
    held = F.coalesce(F.col("source").isin(*sorted(test_only)), F.lit(False)) if test_only else F.lit(False)
    parts = written(curate.split(extra.drop("split").where(~held), ["source"], seed))
    rules = {name: (seed + s, 0, 0, 50) for name, s in (("train", 100), ("val", 101))}
    even = curate.balanced_parts(parts, rules).withColumn("split", F.when(F.col("kept"), F.col("split")).otherwise("test")).drop("kept")
    whole = [even, extra.drop("split").where(held).withColumn("split", F.lit("test"))]
    return base.unionByName(reduce(DataFrame.unionByName, (t.select(*base.columns) for t in whole)))


def rebuild(old: DataFrame, reals: DataFrame, cap: int, seed: int | str) -> DataFrame:
    """The fakes of ``old`` with at most ``cap`` of other ``reals``, chosen in seeded order."""
    fresh = curate.first_of(reals, [], F.lit(cap), seed)
    return old.where("label = 1").unionByName(fresh.select(*old.columns))


def fill(rows: DataFrame, cap: int, seed: int | str) -> DataFrame:
    """``cap`` rows of each label, spread evenly over its groups in seeded order; small groups give all they have."""
    def limits(strata: DataFrame) -> DataFrame:
        quota = curate.levelled(strata.withColumnRenamed("n", "available"), ["label"], cap)
        return quota.withColumnsRenamed({"available": "n", "picks": "__picked"})

    picked = curate.cut(rows, ["label", "group"], order_key(seed, F.col("path")), limits)
    return picked.where("__picked").drop("__picked")


def edit_route(rows: DataFrame, seed: int | str, share: float, generators: set[str] = dims.PARTIAL_EDITS) -> DataFrame:
    """``rows`` with route: of each (source, generator) of partial edits a ``share`` may train (``split``), in seeded
    order and rounded down, and the rest is ``test``; other rows are ``split``."""
    edit = F.coalesce(F.col("generator").isin(*sorted(generators)), F.lit(False))
    n = F.floor(F.col("n") * min(1.0, share))
    placed = curate.cut(rows.where(edit), ["source", "generator"], order_key(seed, F.col("path")), lambda strata: strata.withColumn("__free", n))
    routed = placed.withColumn("route", F.when(F.col("__free"), "split").otherwise("test")).drop("__free")
    return routed.unionByName(rows.where(~edit).withColumn("route", F.lit("split")).select(*routed.columns))


def condition_subset(scores: DataFrame, conditions: list[str]) -> DataFrame:
    """Scores of some conditions, of which clean must be one."""
    if "clean" not in conditions:
        raise ValueError("a subset of conditions needs clean")
    return scores.where(F.col("cond").isin(*conditions))


def membership(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` with split: val if their key is in ``ids``, else train."""
    known = ids.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct()
    return rows.drop("split").join(known, F.col(key) == F.col("__key"), "left").withColumn("split", F.when(F.col("__key").isNotNull(), "val").otherwise("train")).drop("__key")
