"""Operator 10: near-duplicates by MinHash with tensored banding.

A document's set are its distinct word shingles (A-Z lower-cased, words split at ASCII white space; with fewer words the
whole sequence is the one shingle; no word, no set). COLLECTIONS small collections of HALF minhashes each are computed,
and every pair of collections makes the key of one table. So 14 * 3 minhashes stand for 91 tables of 6 each, which would
otherwise take 546. A pair of similarity s is a candidate unless fewer than two collections agree: at s = 0.8 that
misses 0.07 % of pairs, at 0.85 less than 0.01 %.

Equal sets are collapsed first, so copies never meet in a table. In a table, documents do not meet pairwise either: each
is compared with the bucket's hub, its smallest id. Pairs are verified on the full sets, and links make components.
What is left are rows whose component differs from the hub's: a second round compares them with every such hub. The third
round takes the buckets that still hold two components or more, and gathers what they connect into clusters. Within a
cluster, documents of different components and of sizes that allow the similarity are compared in cells of two blocks of
BLOCK documents (or BLOCK_GRAMS shingles), with an inverted index, so pairs are counted but never listed. A large group of near copies is thus one
component after a few comparisons each, and no pair that shares a table goes unchecked unless it is linked already. The
third round's work grows with the square of a cluster's size, spread over its cells.

Keys that a large group of copies shares (its set, its hub) are dealt to SALT tasks where rows are joined by them, and
pairs are made distinct before.

A row with a null id links with nothing: its component is null, and it is kept. Rows that share an id are one node; each
has its own number of shingles, and the smallest of their sets (as a sorted list) is the one that is verified. Null and
empty texts and those of white space have no set. A long text is hashed in parts and makes a cell of its own. An empty
table gives an empty result. Only doc_id and text are read, so other columns cannot clash; survivors() returns them as they
were. Nothing of all documents reaches the driver; the broadcast filter of ids has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import IdFilter, components, mix64, settled, shards, ship, staged, tidy
from curata.llm.kernels import blocks, column_bytes, row_starts, words

#: Collections, and minhashes in each; tables are the pairs of collections.
COLLECTIONS, HALF = 14, 3
_K = COLLECTIONS * HALF
#: Documents of a cluster in one block; a cell compares two blocks.
BLOCK = 1024
#: Shingles of a block, about.
BLOCK_GRAMS = 1_000_000
#: Rows that a large group's key joins are dealt to so many keys.
SALT = 16
#: Multipliers (odd) and offsets of the hash functions, from the splitmix sequence.
_MULTIPLY = mix64(np.arange(1000, 1000 + _K, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(5000, 5000 + _K, dtype=np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after another, and n + 1 positions where rows begin."""
    n = len(offsets) - 1
    h, row = words(raw, offsets)
    begin = row_starts(row, n)
    count = np.diff(begin)
    width = np.minimum(count, size)  # of the shingles of each row
    made = np.maximum(count - size + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), made)
    first = np.repeat(begin[:-1], made) + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    gram = np.zeros(len(owner), np.uint64)
    for k in range(size):
        more = width[owner] > k
        at = first[more] + k
        gram[more] = mix64(gram[more] * np.uint64(0x9E3779B97F4A7C15) + h[at] + np.uint64(k + 1))
    order = np.lexsort((gram, owner)) if n > 1 else np.argsort(gram)
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], row_starts(owner[new], n)


def halves(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(rows, COLLECTIONS) hashes of each row's collections of minhashes; rows without shingles are to be left out."""
    n = len(begin) - 1
    least = np.empty((n, _K), np.uint64)
    for i in range(0, n, 64):  # a few rows at a time stay in the processor's cache
        stop = min(n, i + 64)
        part = grams[begin[i] : begin[stop]]
        at = begin[i:stop] - begin[i]
        for k in range(_K):
            x = part * _MULTIPLY[k] + _ADD[k]
            x ^= x >> np.uint64(31)
            least[i:stop, k] = np.minimum.reduceat(x, at)
    out = np.zeros((n, COLLECTIONS), np.uint64)
    for k in range(HALF):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k::HALF])
    return out


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set) and the collections' hashes, of every row."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for block in blocks(batches, 1 << 20):
            raw, offsets = column_bytes(block.column(1))
            grams, begin = shingle_sets(raw, offsets, size)
            n = np.diff(begin)
            full = np.flatnonzero(n)
            hashes = np.zeros((len(n), COLLECTIONS), np.uint64)
            if len(full):
                hashes[full] = halves(grams, np.append(begin[full], len(grams)))
            whole = [xxh3_128_digest(grams[a:b].tobytes()) for a, b in zip(begin, begin[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * COLLECTIONS + 1, COLLECTIONS, dtype=np.int32)), pa.array(hashes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n), pa.array(whole, pa.binary()), lists], ["doc_id", "n_shingles", "set_hash", "halves"])

    return _texts(documents).mapInArrow(tidy(run), "doc_id long, n_shingles long, set_hash binary, halves array<long>")


def full_sets(documents: DataFrame, size: int) -> DataFrame:
    """doc_id and its set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1 << 20):
            raw, offsets = column_bytes(block.column(1))
            grams, begin = shingle_sets(raw, offsets, size)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(grams.view(np.int64)))], ["doc_id", "grams"])

    return _texts(documents).mapInArrow(tidy(run), "doc_id long, grams array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hi, lo) whose sets are similar enough, by exact counts."""
    sizes = sets.select("doc_id", F.size("grams").alias("n"))
    near = pairs.join(sizes.toDF("hi", "a"), "hi").join(sizes.toDF("lo", "b"), "lo").where(f"100 * least(a, b) >= {percent} * greatest(a, b)").select("hi", "lo", "a", "b")
    both = near.join(sets.toDF("hi", "x"), "hi").join(sets.toDF("lo", "y"), "lo").withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.where(f"100 * common >= {percent} * (a + b - common)").select("hi", "lo")


def _across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (hi, lo) between documents of different components that share a bucket: one at least for each document and
    component that have any. ``rows`` is (bucket, doc_id, component).

    A document is of the size class floor(log n) to a base just above 100 / percent, so similar enough ones are of the
    same class or of neighbouring ones: each is filed under its own class and the next, where it is a guest.
    """
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last").select("bucket", "first")
    rows = staged(rows.join(mixed, "bucket"), "open")
    clusters = components(rows.select(F.col("component").alias("hi"), F.col("first").alias("lo")))
    members = rows.select("component", "doc_id").distinct().join(clusters.toDF("component", "cluster"), "component", "left").withColumn("cluster", F.coalesce("cluster", "component"))
    n = F.size("grams").cast("double")
    sizes = sets.select("doc_id", n.alias("n"), F.floor(F.ln(n) / float(np.log(101 / percent))).alias("class"))
    filed = members.join(sizes, "doc_id").withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("class", F.col("class") + F.col("guest"))
    filed = staged(filed, "filed")
    cuts = filed.groupBy("cluster", "class").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("cuts"))
    cells = filed.join(cuts, ["cluster", "class"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cells.select("cluster", "class", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "guest", "component", "doc_id").join(sets, "doc_id")
    keys = ["cluster", "class", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: set[tuple[int, int]] = set()
        cell: list[tuple] = []

        def close() -> None:
            if len({r[6] for r in cell}) < 2:  # one component only
                return
            part, guest, component, docs = (np.array([r[k] for r in cell]) for k in range(4, 8))
            size = np.array([len(r[8]) for r in cell])
            every = np.concatenate([r[8] for r in cell])
            order = np.argsort(every, kind="stable")
            owner, every = np.repeat(np.arange(len(cell)), size)[order], every[order]
            for k, (*_, i, j, own, is_guest, comp, doc, grams) in enumerate(cell):
                low, high = np.searchsorted(every, grams, "left"), np.searchsorted(every, grams, "right")
                n = high - low
                where = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                common = np.bincount(owner[where], minlength=len(cell))
                near = (100 * common >= percent * (size + size[k] - common)) & (component != comp) & (docs < doc)
                if is_guest:
                    near &= guest == 0  # two guests meet in their own class
                if i != j:
                    near &= part != own
                near = np.flatnonzero(near)
                _, first = np.unique(component[near], return_index=True)
                links.update((doc, int(docs[x])) for x in near[first])

        for batch in batches:
            for *key, grams in zip(*(batch.column(k).to_pylist() for k in range(8)), batch.column(8)):
                if cell and cell[0][:4] != tuple(key[:4]):
                    close()
                    cell.clear()
                cell.append((*key, grams.values.to_numpy()))
        if cell:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(links)], pa.int64()) for k in range(2)], ["hi", "lo"])

    ordered = cells.select(*keys, "part", "guest", "component", "doc_id", "grams").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(tidy(compare), "hi long, lo long")


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` (.., doc_id) with the component that each document has so far."""
    return rows.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _salted(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int").alias("salt")


def _to_all_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def near_components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    return settled(lambda: _near_components(documents, size, percent), "components")


def _near_components(documents: DataFrame, size: int, percent: int) -> DataFrame:
    found = staged(sketches(documents, size), "sketches")
    some = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = staged(some.groupBy("set_hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("most")), "sets_of")
    several = _to_all_salts(first.where("lo < most").select("set_hash", "lo"))
    copies = some.select("set_hash", F.col("doc_id").alias("hi"), _salted("doc_id")).join(several, ["set_hash", "salt"]).where("hi > lo").select("hi", "lo").distinct()
    chosen = some.join(first.select("set_hash", F.col("lo").alias("doc_id")), ["set_hash", "doc_id"], "left_semi").select("doc_id", "halves")
    # the tables: a bucket's key is made of two collections and which two they are
    key = "flatten(transform(sequence(0, {0} - 2), i -> transform(sequence(i + 1, {0} - 1), j -> xxhash64(i, j, halves[i], halves[j]))))".format(COLLECTIONS)
    tables = chosen.repartition(shards(documents.sparkSession), "doc_id").select("doc_id", F.explode(F.expr(key)).alias("bucket"))
    hubs = tables.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).where("hub < most").select("bucket", "hub")
    rows = staged(tables.join(hubs, "bucket"), "buckets")
    members = rows.select("doc_id").distinct()
    sets = full_sets(IdFilter.build(members, "doc_id").thin(_texts(documents), "doc_id"), size).join(members, "doc_id", "left_semi")
    sets = staged(sets.groupBy("doc_id").agg(F.min("grams").alias("grams")), "sets")

    tried = staged(rows.where("doc_id > hub").groupBy(F.col("doc_id").alias("hi")).agg(F.min("hub").alias("lo")), "pairs")
    links = staged(_verified(tried, sets, percent), "links")
    comps = components(links)
    hub = _labelled(rows.select(F.col("hub").alias("doc_id")).distinct(), comps).select(F.col("doc_id").alias("hub"), F.col("component").alias("other"))
    meets = _labelled(rows.where("doc_id > hub").select("doc_id", "hub").distinct(), comps)
    pairs = meets.select("*", _salted("doc_id")).join(_to_all_salts(hub), ["hub", "salt"]).where("component != other").select(F.col("doc_id").alias("hi"), F.col("hub").alias("lo"))
    more = staged(_verified(pairs.join(tried, ["hi", "lo"], "left_anti"), sets, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = components(links)
    more = staged(_across(_labelled(rows, comps).where("doc_id != hub").select("bucket", "doc_id", "component"), sets, percent), "links")
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    all_of_set = copies.select(F.col("hi").alias("doc_id"), F.col("lo")).join(comps.select(F.col("node").alias("lo"), "component"), "lo", "left").select("doc_id", F.coalesce("component", "lo").alias("component_id"))
    own = comps.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    known = all_of_set.unionByName(own).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return found.select("doc_id", "n_shingles").join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def dedup(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return near_components(documents, size, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def survivors(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one document of each component, all columns as they were; rows without an id stay."""
    dropped = near_components(documents, size, percent).where("doc_id > component_id").select(F.col("doc_id").alias("__id")).distinct()
    names = [f"c{k}" for k in range(len(documents.columns))]  # a column may have any name
    own = names[[c.lower() for c in documents.columns].index("doc_id")]
    return documents.toDF(*names).join(dropped, F.col(own).cast("long") == F.col("__id"), "left_anti").toDF(*documents.columns)
