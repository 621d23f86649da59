"""Deterministic randomness: orders and draws that depend on a seed and a key, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *key: Column) -> Column:
    """A key to sort by in seeded order; add the key itself behind it to break ties."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)).cast("binary"))


def unit(seed: int | str, *key: Column) -> Column:
    """A number in [0, 1) with 32 bits."""
    return F.conv(F.substring(order_key(seed, *key), 1, 8), 16, 10).cast("double") / 4294967296.0


def choose(u: Column, weighted: list[tuple[str, float]]) -> Column:
    """The value whose share of the cumulated weights holds ``u``."""
    total, reached, out = sum(w for _, w in weighted), 0.0, None
    for value, weight in weighted:
        reached += weight
        hit = u < reached / total
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(weighted[-1][0]))


def integer(seed: int | str, low: Column | int, high: Column | int, *key: Column) -> Column:
    """A whole number from low to high, both included."""
    lo, hi = ((F.lit(x) if isinstance(x, int) else x).cast("long") for x in (low, high))
    return (lo + F.floor(unit(seed, *key) * (hi - lo + 1))).cast("long")


def shuffled(values: Column, seed: int | str, *key: Column) -> Column:
    """An array in an order drawn for the key; its first k values are a sample of k without replacement."""
    place = lambda x, i: F.struct(order_key(seed, *key, i.cast("string")).alias("k"), x.alias("v"))
    return F.transform(F.array_sort(F.transform(values, place)), lambda x: x["v"])


def pick(values: list[str], seed: int | str, *key: Column) -> Column:
    """One of some values, all as likely."""
    return F.get(F.array(*(F.lit(v) for v in values)), integer(seed, 0, len(values) - 1, *key).cast("int"))


def phrase(parts: list[list[str]], seed: int | str, *key: Column, sep: str = ", ") -> Column:
    """One value of each part, drawn for the key and joined: a planned prompt."""
    return F.concat_ws(sep, *(pick(p, f"{seed}:{i}", *key) for i, p in enumerate(parts)))
