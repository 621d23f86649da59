"""Operator 8: near-duplicates of embeddings by spherical-cap filters with structured random product codes.

Vectors are compared within one label and one dimension. Identical vectors are collapsed first and count by their number.
Each vector is rotated at random and cut into BLOCKS blocks; each block has a code of random unit directions, and a
filter is one direction of each block's code. A vector is decoded to the list of all filters whose direction it exceeds
the cap height with: one height for all vectors and filters, at which a vector has LIST filters on average. The list is
made by walking each block's directions from the best one down, as long as the rest can still reach the height, so the
work follows the list and not the number of filters. Several such codes are used, each with its own rotation.

The number of filters follows from the largest label's size, so that a filter holds about BUCKET vectors at any size of
the table, and the number of codes grows with its logarithm, which keeps the recall: pairs just at cosine 0.93 share a
filter with probability 0.99 and more for 50 to 10 million vectors a label (measured, see the README).

Filters with the same first directions and neighbouring last ones make a cell, sized for about CELL vectors; vectors that
have filters in a cell are verified there against each other, by cosine in double precision. Only ids travel to cells
until the cells with one vector are gone; then each vector is fetched once a cell. A pair may meet in several cells, but
is counted in the smallest of them only, so links are counted right without listing pairs; each cell emits a count for
each vector and one edge to the smallest id it is connected to. A cell over SPLIT vectors is cut into a grid, so that no
task holds a large one, however many vectors are alike.

Vectors that are null, empty, zero or hold null or non-finite components, vectors without a label, and rows without an id
link with nothing; a null vec_id has a null component and is kept. Very large and very small components are scaled before
norms are taken. Rows that share an id are rows each, and one node of the components. Cosines at the threshold link. An
empty table gives an empty result. Only columns vec_id, label and embedding are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log10, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.common import components, drop_staged, settled, ship, staged, tidied_table, tidy

BLOCKS, LIST, BUCKET, CELL, SPLIT = 2, 12, 8.0, 512, 1024
#: Caps are not made higher, however many vectors there are: a pair would share too few of them.
HIGHEST = 0.6
#: Rows of one vector are dealt to so many keys when results go back to them.
SALT = 8


def codes_for(vectors: int) -> int:
    """How many codes are used for so many vectors."""
    return max(3, ceil(log10(max(1, vectors))) - 1)


def _caps(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of the sphere in ``dim`` dimensions that a cap of each has."""
    angle = np.linspace(0, np.pi, 100_001)
    if dim == 1:
        return angle, np.where(angle < np.pi, 0.5, 1.0)
    area = np.append(0, np.cumsum(np.sin((angle[1:] + angle[:-1]) / 2) ** (dim - 2)))
    return angle, area / area[-1]


def cap_height(dim: int, share: float) -> float:
    angle, area = _caps(dim)
    return float(np.cos(np.interp(share, area, angle)))


def cap_share(dim: int, height: float) -> float:
    angle, area = _caps(dim)
    return float(np.interp(np.arccos(height), angle, area))


class ProductCode:
    """Filters for vectors of ``dim`` components, ``vectors`` of which a label has at most."""

    def __init__(self, dim: int, vectors: int, number: int):
        r = np.random.default_rng(7919 * number + dim)
        blocks = min(BLOCKS, max(1, dim // 8))  # in few dimensions, sums of blocks' directions would not spread
        wanted = min(LIST * max(1.0, vectors / BUCKET), LIST / cap_share(dim, HIGHEST))
        self.directions = max(2, ceil(wanted ** (1 / blocks)))
        self.height = min(HIGHEST, cap_height(dim, min(1.0, LIST / self.directions**blocks)))
        self.rotation = np.linalg.qr(r.standard_normal((dim, dim)))[0]
        self.edges = [dim * b // blocks for b in range(blocks + 1)]
        self.codes = []
        for a, b in zip(self.edges, self.edges[1:]):
            code = r.standard_normal((b - a, self.directions))
            self.codes.append(code / np.maximum(np.linalg.norm(code, axis=0), 1e-12) * sqrt((b - a) / dim))
        self.width = max(1, min(self.directions, int(CELL / BUCKET)))
        self.cells = self.directions ** (blocks - 1) * ceil(self.directions / self.width)

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of each filter whose cap holds the row's unit vector."""
        turned = units @ self.rotation
        scores = [turned[:, a:b] @ code for (a, b), code in zip(zip(self.edges, self.edges[1:]), self.codes)]
        best = [s.max(axis=1) for s in scores]
        row, number, total = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
        for k, s in enumerate(scores):
            rest = sum(best[k + 1 :], np.zeros(len(units)))  # what the blocks behind can add at most
            order = np.argsort(-s, axis=1)
            falling = np.take_along_axis(s, order, 1)
            need = self.height - total - rest[row]
            # how many directions of this block reach what is needed, by bisection in each row
            low, high = np.zeros(len(row), np.int64), np.full(len(row), self.directions)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                enough = falling[row, np.minimum(mid, self.directions - 1)] >= need
                low, high = np.where(open_ & enough, mid + 1, low), np.where(open_ & ~enough, mid, high)
            place = np.arange(int(low.sum())) - np.repeat(np.cumsum(low) - low, low)
            row, number, total = (np.repeat(x, low) for x in (row, number, total))
            number = number * self.directions + order[row, place]
            total = total + falling[row, place]
        return row, number

    def keys(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the cells that each row has filters in, without repeats."""
        row, number = self.decode(units)
        cell = number // self.directions * ceil(self.directions / self.width) + number % self.directions // self.width
        both = np.unique(np.stack([row, cell], axis=1), axis=0) if len(row) else np.empty((0, 2), np.int64)
        return both[:, 0], both[:, 1]


def _filters(largest: int, schema: T.StructType):
    """Rows (rep, mult, a, b, label, vector) to these with dim, unit (the vector's direction) and keys, its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for batch in batches:
            sizes = batch.column(5).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == dim))
                m = rows.column(5).flatten().to_numpy().reshape(-1, dim)
                m = m / np.abs(m).max(axis=1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                if dim not in codes:
                    codes[dim] = [ProductCode(dim, largest, k) for k in range(codes_for(largest))]
                found, before = [], 0
                for code in codes[dim]:
                    row, cell = code.keys(m)
                    found.append((row, cell + before))
                    before += code.cells
                row, cell = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((cell, row))
                offsets = np.searchsorted(row[order], np.arange(len(rows) + 1)).astype(np.int32)
                unit = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.ravel()))
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell[order]))
                yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array([dim] * len(rows), pa.int32()), unit, keys], schema.names)

    return tidy(run)


def _verify(threshold: float):
    """Links within a cell or a part of its grid: rows (rep, n, lo)."""

    def run(rows: pa.Table) -> pa.Table:
        none = pa.table({k: pa.array([], pa.int64()) for k in ("rep", "a", "n", "lo")})
        if len(rows) < 2:
            return none
        i, j, this = (rows.column(c)[0].as_py() for c in ("i", "j", "key"))
        m = rows.column("unit").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        linked = m @ m.T >= threshold
        np.fill_diagonal(linked, False)
        if i != j:
            part = rows.column("part").to_numpy()
            linked &= part[:, None] != part
        at = np.flatnonzero(linked.any(axis=1))
        if not len(at):
            return none
        linked = linked[np.ix_(at, at)]
        rep, a, mult = (rows.column(c).to_numpy()[at] for c in ("rep", "a", "mult"))
        keys = rows.column("keys").combine_chunks().take(pa.array(at))
        owner, cells = np.repeat(np.arange(len(at)), keys.value_lengths().to_numpy()), keys.flatten().to_numpy()
        owner, cells = owner[cells < this], cells[cells < this]  # a pair that shares one of these was counted there
        names, index = np.unique(cells, return_inverse=True)
        member = np.zeros((len(at), max(1, len(names))), np.float32)
        member[owner, index] = 1
        counted = linked & ~((member @ member.T) > 0)
        ids, label = np.unique(rep, return_inverse=True)
        while True:  # smallest neighbour, again and again
            least = np.minimum(label, np.where(linked, label, len(ids)).min(axis=1))
            if (least == label).all():
                break
            label = least
        return pa.table({"rep": pa.array(rep), "a": pa.array(a), "n": pa.array(counted @ mult, pa.int64()), "lo": pa.array(ids[label])})

    return tidied_table(run)


def dedup(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    return settled(lambda: _dedup(vectors, threshold), "embeddings")


def _dedup(vectors: DataFrame, threshold: float) -> DataFrame:
    spark = vectors.sparkSession
    ship(spark)
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0") & ~odd & F.exists("vector", lambda x: x != 0), F.lit(False))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", doubles.alias("vector")).withColumn("usable", usable)
    # two hashes stand for a vector with its label once equal ones have been collapsed; zeros of either sign are equal
    hashed = F.transform("vector", lambda x: x + 0.0)
    marks = [F.xxhash64("label", hashed).alias("a"), F.xxhash64(F.lit(1), "label", hashed).alias("b")]
    rows = every.where("usable").select("vec_id", "label", "vector", *marks)
    reps = staged(rows.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("a").alias("a"), F.first("b").alias("b")).select("rep", "mult", "a", "b", "label", "vector"), "vectors")
    largest = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    schema = T.StructType([*reps.schema.fields[:5], T.StructField("dim", T.IntegerType()), T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("keys", T.ArrayType(T.LongType()))])
    lists = staged(reps.mapInArrow(_filters(largest, schema), schema), "filters")
    drop_staged(reps)
    placed = lists.select("label", "dim", F.explode("keys").alias("key"), "rep", "a", "b")
    sizes = placed.groupBy("label", "dim", "key").agg(F.count("*").alias("size")).where("size > 1")
    cells = placed.join(sizes, ["label", "dim", "key"]).withColumn("cuts", F.ceil(F.col("size") / SPLIT).cast("int")).withColumn("part", F.pmod(F.xxhash64("a", "key"), F.col("cuts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "a", "b")
    cells = staged(cells, "cells")
    filled = cells.join(lists, ["rep", "a", "b"]).select("label", "dim", "key", "i", "j", "part", "rep", "a", "mult", "unit", "keys")
    found = staged(filled.groupBy("label", "dim", "key", "i", "j").applyInArrow(_verify(threshold), "rep long, a long, n long, lo long"), "links")
    drop_staged(cells)
    comps = components(found.select(F.col("rep").alias("hi"), "lo"))
    linked = found.groupBy("rep", "a").agg(F.sum("n").alias("n"))
    known = lists.select("rep", "a", "b", "mult").join(linked, ["rep", "a"], "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select("a", "b", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = rows.select("vec_id", "a", "b", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)).cast("int").alias("salt")).join(salted, ["a", "b", "salt"]).select("vec_id", "n_links", "component_id")
    alone = every.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
