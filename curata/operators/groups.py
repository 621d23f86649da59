"""Groups of near copies: links between distinct hashes, and their connected components by star contraction."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.hashes import hamming, trivial
from curata.session import dropped, written

#: Ways to cut 64 bits: the fewest blocks whose keys tell so many hashes apart that a key has about one.
BLOCKS = range(5, 13)


def blocks_for(hashes: int, max_distance: int) -> int:
    """Number of blocks to cut a hash into: the more hashes, the longer the keys must be, and the more tables there are."""
    fitting = [m for m in BLOCKS if m > max_distance and (1 << _bits(m, max_distance)) >= hashes and comb(m, max_distance) <= 800]
    return min(fitting, default=max((m for m in BLOCKS if m > max_distance and comb(m, max_distance) <= 800), default=max_distance + 1))


def _bits(blocks: int, max_distance: int) -> int:
    return 64 // blocks * (blocks - max_distance)


def _cut(h: Column, blocks: int) -> list[Column]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)) for a, b in zip(edges, edges[1:])]


def near_links(hashes: DataFrame, max_distance: int, blocks: int | None = None) -> DataFrame:
    """a, b and distance of all pairs a < b of the distinct ``hashes`` (dhash) within ``max_distance``, exactly.

    Of ``blocks`` blocks, a pair differs in ``max_distance`` at most, so it agrees in all of some choice of the others.
    Each choice is a key of its own; a pair is kept only at its first common choice, without a distinct over candidates.
    """
    if blocks is None:
        blocks = blocks_for(hashes.count(), max_distance)
    chosen = list(combinations(range(blocks), blocks - max_distance))
    # the parts stay bits at their places, so a key is the hash under a mask
    masks = [sum(((1 << (64 * (k + 1) // blocks - 64 * k // blocks)) - 1) << (64 * k // blocks) for k in c) for c in chosen]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("dhash").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    rows = hashes.select("dhash", F.explode(keys).alias("k")).select("dhash", "k.choice", "k.key")
    met = rows.withColumnRenamed("dhash", "a").join(rows.withColumnRenamed("dhash", "b"), ["choice", "key"]).where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    agree = F.concat_ws(",", *(F.when(p == 0, F.lit(str(k))) for k, p in enumerate(_cut(differ, blocks))))
    first = F.array_join(F.slice(F.split(agree, ","), 1, blocks - max_distance), ",")
    named = F.element_at(F.array(*(F.lit(",".join(map(str, c))) for c in chosen)), F.col("choice") + 1)
    near = met.withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= max_distance)
    return near.where(first == named).select("a", "b", "distance")


def components(links: DataFrame) -> DataFrame:
    """node and component, its smallest node, for every node of ``links`` (a, b).

    Star contraction: in each round every node points to the neighbour, or itself, that a hash seeded by the round puts
    first; pointers are followed to their ends by doubling, and each such tree becomes one node. A node stays one only
    if it precedes all its neighbours, so each round leaves half of a component's nodes at most, a third of a chain's.
    Minima are combined before the shuffle, and a node with very many links is joined, never gathered. What a round
    gives is written to the shared folder, so a lost executor costs one round.
    """
    edges = written(links.select("a", "b").where("a <> b"))
    named = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node")))
    turn = 0
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("n"))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        parent = written(least.select(F.col("a").alias("n"), F.least(F.col("m"), order(F.col("a")))["n"].alias("p")))
        while True:
            up = parent.select(F.col("n").alias("p"), F.col("p").alias("q"))
            after = written(parent.join(up, "p").select("n", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            dropped(parent)
            parent = after.select("n", "p")
            parent.written_path = after.written_path
            if after.where("moved").isEmpty():
                break
        to = lambda c: parent.select(F.col("n").alias(c), F.col("p").alias(f"{c}_"))
        renamed = edges.join(to("a"), "a").join(to("b"), "b").where("a_ <> b_")
        fewer = written(renamed.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct())
        moved = written(named.join(parent.select(F.col("n").alias("at"), "p"), "at", "left").select("node", F.coalesce("p", "at").alias("at")))
        dropped(edges, named, parent)
        edges, named, turn = fewer, moved, turn + 1
    dropped(edges)
    least = named.groupBy("at").agg(F.min("node").alias("component"))
    return named.join(least, "at").select("node", "component")


def near_groups(rows: DataFrame, max_distance: int = 4) -> DataFrame:
    """One row for each of ``rows`` (id, dhash): id, group_id, group_rows, copies and links.

    Rows with one hash are copies of each other; hashes within ``max_distance`` are linked, and a group is what links
    connect. group_id is the smallest id of the group, group_rows its number of rows, copies the number of rows with
    the row's hash, links the number of other hashes linked to it. So the result has as many rows as the table, however
    many copies there are. Hashes of flat images (no bit set, or all) and null ones link with nothing: such a row is a
    group of its own.
    """
    rows = written(rows.select("id", "dhash"))  # read three times, and a hash may be costly
    hashed = F.col("dhash").isNotNull() & ~trivial(F.col("dhash"))
    classes = written(rows.where(hashed).groupBy("dhash").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    links = written(near_links(classes.select("dhash"), max_distance))
    degree = links.select(F.explode(F.array("a", "b")).alias("dhash")).groupBy("dhash").agg(F.count("*").alias("links"))
    held = components(links).withColumnRenamed("node", "dhash")
    placed = classes.join(held, "dhash", "left").join(degree, "dhash", "left").withColumn("component", F.coalesce("component", "dhash"))
    groups = placed.groupBy("component").agg(F.min("least").alias("group_id"), F.sum("copies").alias("group_rows"))
    table = placed.join(groups, "component").select("dhash", "group_id", "group_rows", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    one = F.lit(1).cast("long")
    alone = rows.where(~hashed | F.col("dhash").isNull()).select("id", F.col("id").alias("group_id"), one.alias("group_rows"), one.alias("copies"), F.lit(0).cast("long").alias("links"))
    return rows.where(hashed).select("id", "dhash").join(table, "dhash").select("id", "group_id", "group_rows", "copies", "links").unionByName(alone)


def near_classes(probe: DataFrame, train: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` of distinct hashes (probe_id, train_id: the hashes; distance) as pairs of classes, and the classes' rows.

    A class is what rows of a side share a hash; its id is their smallest id. Rows of kind ``pair`` give two classes
    within the distance and how many rows stand behind each; rows of kind ``probe`` and ``train``, one for each row of
    that side, give the row's id and its class. Joined, they are all pairs of rows, but copies are never multiplied by
    each other. A null hash has no class.
    """
    long, text = F.lit(None).cast("long"), lambda kind: F.lit(kind).alias("kind")
    one = probe.groupBy("dhash").agg(F.min("id").alias("probe_id"), F.count("*").alias("probe_rows"))
    two = train.groupBy("dhash").agg(F.min("id").alias("train_id"), F.count("*").alias("train_rows"))
    named = pairs.withColumnsRenamed({"probe_id": "a", "train_id": "b"}).join(one.withColumnRenamed("dhash", "a"), "a").join(two.withColumnRenamed("dhash", "b"), "b")
    columns = ["id", "probe_id", "train_id", "distance", "probe_rows", "train_rows"]
    linked = named.withColumn("id", long).select(text("pair"), *columns)
    asked = probe.join(one, "dhash", "left").withColumns({"train_id": long, "distance": long.cast("int"), "train_rows": long}).select(text("probe"), *columns)
    known = train.join(two, "dhash", "left").withColumns({"probe_id": long, "distance": long.cast("int"), "probe_rows": long}).select(text("train"), *columns)
    return linked.unionByName(asked).unionByName(known)
