"""Order statistics of groups of any size: by repeated refinement of histograms, and samples of the smallest keys, drawn orders."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curata.session import dropped, written

BINS = 1024


def _bin(x: Column, low: Column, high: Column, kind: T.DataType, bins: int) -> Column:
    """A bin that grows with x, and never holds both ends: they have bins of their own, others lie between."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        share = (x / 2 - low / 2) / (high / 2 - low / 2)
    else:
        wide = kind if isinstance(kind, T.DecimalType) else T.DecimalType(38, 0)
        share = (x.cast(wide) - low.cast(wide)).cast("double") / (high.cast(wide) - low.cast(wide)).cast("double")
    # of infinite ends no share is known: what is between them shares a bin until they are gone
    inner = F.when(F.isnan(share) | share.isNull(), 0.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    return F.when(x == low, 0).when(x == high, bins).otherwise(F.floor(inner * (bins - 2)).cast("int") + 1)


def order_statistic(rows: DataFrame, by: list[str], column: str, rank: Column, bins: int = BINS) -> DataFrame:
    """by and value: in each group the value of ``column`` with 1-based ``rank``, an expression of n, the group's size.

    Each pass counts the values of what is left in bins, and goes on with the bin that holds the rank, until one value is
    left; two passes settle a million different integers. A task holds counts of bins, never a group's values, and counts
    are combined before the shuffle, so a group may hold any share of the rows. Nulls are left out, NaN is the largest
    number. A group without a value has none; a rank below 1 or above n gives null.
    """
    kind = rows.schema[column].dataType
    names = [f"__g{k}" for k in range(len(by))]
    values = rows.where(F.col(column).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, names)), F.col(column).alias("__x"))
    asked = values.groupBy(*names).agg(F.count("*").alias("n"), F.min("__x").alias("__low"), F.max("__x").alias("__high")).withColumn("__k", rank.cast("long"))
    state = written(asked.withColumn("__k", F.when(F.col("__k").between(1, F.col("n")), F.col("__k"))).drop("n"))
    made = [state]
    done = None
    while True:
        settled = F.col("__k").isNull() | (F.col("__low") == F.col("__high"))
        ended = state.where(settled).select(*names, F.when(F.col("__k").isNotNull(), F.col("__low")).alias("value"))
        done = ended if done is None else done.unionByName(ended)
        open_ = state.where(~settled)
        if open_.isEmpty():
            break
        side = open_.select(*(F.col(g).alias(f"{g}s") for g in names), "__low", "__high", "__k")
        match = F.lit(True)
        for g in names:
            match = match & F.col(g).eqNullSafe(F.col(f"{g}s"))
        met = values.join(side, match & (F.col("__x") >= F.col("__low")) & (F.col("__x") <= F.col("__high")))
        counted = met.groupBy(*(F.col(f"{g}s").alias(g) for g in names), "__k", _bin(F.col("__x"), F.col("__low"), F.col("__high"), kind, bins).alias("__bin"))
        found = counted.agg(F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
        # a window over the bins of a group
        upto = F.sum("__n").over(Window.partitionBy(*names).orderBy("__bin"))
        held = found.withColumn("__upto", upto).where((F.col("__upto") >= F.col("__k")) & (F.col("__upto") - F.col("__n") < F.col("__k")))
        state = written(held.select(*names, "__low", "__high", (F.col("__k") - F.col("__upto") + F.col("__n")).alias("__k")))
        made.append(state)
    out = written(done.select(*(F.col(g).alias(c) for g, c in zip(names, by)), "value"))
    dropped(*made)
    return out


def upper_median(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """by and value: the middle value, the upper one of two."""
    return order_statistic(rows, by, column, F.floor(F.col("n") / 2) + 1)


def bottom_k(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """The k rows with the smallest ``key``, a hexadecimal text of 15 digits or more, as orderBy(key).limit(k) has them.

    The k-th smallest number in the keys' first 15 digits is found by histograms; rows below it are kept where they are,
    so nothing is sorted and no row moves, whatever k is. Only rows that share that number are put in order. Null keys
    are left out; rows with one whole key are interchangeable.
    """
    number = F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    marked = rows.withColumn("__number", number).withColumn("__key", key)
    least = F.least(F.lit(k).cast("long"), F.col("n"))
    edge = order_statistic(marked.select("__number"), [], "__number", least).first()["value"]
    if edge is None:  # no rows, or none asked for
        return rows.limit(0)
    below = marked.where(F.col("__number") < edge)
    ties = marked.where(F.col("__number") == edge).orderBy("__key").limit(k - below.count())
    return below.unionByName(ties).drop("__number", "__key")


def shuffle_buffer(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """``rows`` in an order drawn as a stream goes by: a task keeps ``size`` rows, and each new one takes the place of a
    drawn one, which leaves. Memory is bounded by ``size``, nothing is shuffled between tasks, and a task that runs again
    gives the same order, as its draws follow from the seed and its partition."""

    def run(batches: Iterator) -> Iterator:
        import random

        import pyarrow as pa
        from pyspark import TaskContext

        draw = random.Random(f"{seed}|{TaskContext.get().partitionId()}")
        held: list = []
        names = None
        for batch in batches:
            names, out = batch.schema, []
            for row in batch.to_pylist():
                if len(held) < size:
                    held.append(row)
                    continue
                at = draw.randrange(size) if size else None
                out.append(row if at is None else held[at])
                if at is not None:
                    held[at] = row
            if out:
                yield pa.RecordBatch.from_pylist(out, names)
        draw.shuffle(held)
        for k in range(0, len(held), 10_000):
            yield pa.RecordBatch.from_pylist(held[k : k + 10_000], names)

    return rows.mapInArrow(run, rows.schema)
