"""Byte-level and perceptual duplicates of manifests, and lookup of paths by their longest suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.hashes import hamming, pieces, trivial


def duplicate_groups(rows: DataFrame, key: str = "sha256") -> DataFrame:
    """key, n, splits, labels, signature (the splits, joined) of every key with two rows or more."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.count_distinct("label").alias("labels"), F.array_join(F.array_sort(F.collect_set("split")), " + ").alias("signature")).where("n > 1")


def extra_copies(rows: DataFrame, key: str = "sha256") -> DataFrame:
    """split and copies: rows beyond the first of each key within a split."""
    return rows.where(F.col(key).isNotNull()).groupBy("split", key).agg((F.count("*") - 1).alias("k")).groupBy("split").agg(F.sum("k").alias("copies"))


def signatures(rows: DataFrame, key: str = "sha256") -> DataFrame:
    return duplicate_groups(rows, key).where("splits > 1").groupBy("signature").agg(F.count("*").alias("groups"))


def drop_list(rows: DataFrame, near: DataFrame, key: str = "sha256", keep_train: bool = False) -> DataFrame:
    """Paths to drop: members of groups that span splits or contradict in label, and near duplicates."""
    bad = duplicate_groups(rows, key).where("splits > 1 OR labels > 1").select(key)
    hit = rows.join(bad, key, "left_semi")
    if keep_train:
        hit = hit.where("split != 'train'")
    return hit.select("path").union(near.select("path")).distinct()


def near_pairs(probe: DataFrame, train: DataFrame, max_distance: int = 4) -> DataFrame:
    """probe_id, train_id and distance of all pairs of hashes within ``max_distance``, exactly.

    Such hashes agree in one of max_distance + 1 pieces, so an equi-join on pieces finds them; a pair is kept only at
    its first common piece, which saves a distinct over candidates. Flat images' hashes (all zeros or ones) are left out.
    """
    one = probe.where(~trivial(F.col("dhash"))).select(F.col("id").alias("probe_id"), F.col("dhash").alias("a"), F.explode(pieces(F.col("dhash"), max_distance)).alias("p"))
    two = train.where(~trivial(F.col("dhash"))).select(F.col("id").alias("train_id"), F.col("dhash").alias("b"), F.explode(pieces(F.col("dhash"), max_distance)).alias("p"))
    found = one.join(two, "p").withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= max_distance)
    first = F.array_position(F.zip_with(pieces(F.col("a"), max_distance), pieces(F.col("b"), max_distance), lambda x, y: x["v"] == y["v"]), True) - 1
    return found.where(F.col("p.i") == first).select("probe_id", "train_id", "distance")


def near_pairs_brute(probe: DataFrame, train: DataFrame, max_distance: int = 4) -> DataFrame:
    """The definition of near_pairs(): every probe with every training hash. For checks on small tables only."""
    one = probe.where(~trivial(F.col("dhash"))).select(F.col("id").alias("probe_id"), F.col("dhash").alias("a"))
    two = train.where(~trivial(F.col("dhash"))).select(F.col("id").alias("train_id"), F.col("dhash").alias("b"))
    return one.crossJoin(two).withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= max_distance).select("probe_id", "train_id", "distance")


def near_by_prefix(probe: DataFrame, train: DataFrame, shift: int = 40, max_distance: int = 2) -> DataFrame:
    """Probe ids with a training hash within ``max_distance`` whose prefix is equal but for the lowest bit.

    Misses pairs that differ elsewhere in the prefix; near_pairs() does not.
    """
    prefix: Column = F.shiftrightunsigned(F.col("dhash"), shift)
    one = probe.select("id", F.col("dhash").alias("a"), F.explode(F.array(prefix, prefix.bitwiseXOR(F.lit(1).cast("long")))).alias("p"))
    two = train.select(F.col("dhash").alias("b"), prefix.alias("p"))
    return one.join(two, "p").where(hamming(F.col("a"), F.col("b")) <= max_distance).select("id").distinct()


def nearest(pairs: DataFrame) -> DataFrame:
    """The nearest training hash of each probe; the smaller id of equals."""
    return pairs.groupBy("probe_id").agg(F.min_by(F.struct("train_id", "distance"), F.struct("distance", "train_id")).alias("m")).select("probe_id", "m.*")


def nearest_by_hash(probe: DataFrame, train: DataFrame, max_distance: int = 4) -> DataFrame:
    """nearest(near_pairs()), by distinct hashes: copies are not multiplied by each other."""
    asked = probe.select(F.col("dhash").alias("id"), "dhash").distinct()
    known = train.groupBy("dhash").agg(F.min("id").alias("id"))
    found = nearest(near_pairs(asked, known, max_distance)).withColumnRenamed("probe_id", "dhash")
    return probe.join(found, "dhash").select(F.col("id").alias("probe_id"), "train_id", "distance")


def near_counts(probe: DataFrame, train: DataFrame, max_distance: int = 4) -> DataFrame:
    """distance and the number of near_pairs() at it, by distinct hashes."""
    one, two = (x.groupBy("dhash").agg(F.count("*").alias(n)) for x, n in ((probe, "n"), (train, "k")))
    met = near_pairs(one.select(F.col("dhash").alias("id"), "dhash"), two.select(F.col("dhash").alias("id"), "dhash"), max_distance)
    named = met.join(one.withColumnRenamed("dhash", "probe_id"), "probe_id").join(two.withColumnRenamed("dhash", "train_id"), "train_id")
    return named.groupBy("distance").agg(F.sum(F.col("n") * F.col("k")).alias("pairs"))


def near_train(rows: DataFrame, max_distance: int = 4) -> DataFrame:
    """path of the val and test rows whose dhash is within ``max_distance`` of a training row's."""
    probe = rows.where("split IN ('val', 'test')").select(F.col("path").alias("id"), "dhash")
    train = rows.where("split = 'train'").select(F.col("path").alias("id"), "dhash")
    return nearest_by_hash(probe, train, max_distance).select(F.col("probe_id").alias("path")).distinct()


def suffixes(path: Column) -> Column:
    """All suffixes of a path in whole components, the longest first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "/"))).otherwise(F.array().cast("array<string>"))


def suffix_join(probe: DataFrame, disk: DataFrame) -> DataFrame:
    """path, match and status: each probe path looked up by its longest suffix that some disk path ends with.

    ``ambiguous`` if several do, ``missing`` if none does. Suffixes are counted before they meet probes, so a frequent
    one (a base name in each folder) is one row, not a row for each path.
    """
    ends = disk.select(F.col("path").alias("full"), F.explode(suffixes(F.col("path"))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("hits"), F.min("full").alias("full"))
    tries = probe.select("path", F.posexplode(suffixes(F.col("path"))).alias("cut", "suffix"))
    best = tries.join(ends, "suffix").groupBy("path").agg(F.min_by(F.struct("hits", "full"), "cut").alias("m"))
    status = F.when(F.col("m").isNull(), "missing").when(F.col("m.hits") > 1, "ambiguous").otherwise("resolved")
    return probe.select("path").distinct().join(best, "path", "left").select("path", F.when(F.col("m.hits") == 1, F.col("m.full")).alias("match"), status.alias("status"))


def cosine_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """Pairs of one label with cosine of at least ``least``, in double precision; for small classes."""
    v = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = v.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    a, b = v.toDF("a_id", "label", "x", "nx"), v.toDF("b_id", "label", "y", "ny")
    return a.join(b, "label").where("a_id < b_id").withColumn("cosine", dot(F.col("x"), F.col("y")) / F.col("nx") / F.col("ny")).where(F.col("cosine") >= least).select("a_id", "b_id", "label", "cosine")


def best_rows(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")
