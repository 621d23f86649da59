"""Scores of crops to scores of images, and the small language of model specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of the vote specification.
KEYS = {"k": "topk", "g": "grid", "n": "n_sizes", "a": "alpha", "L": "long", "r": "rand", "s": "seed", "t": "tile", "f": "logit"}


@dataclass(frozen=True)
class Spec:
    """A model: a base name with optional weights, below wrappers from the outside in."""

    base: str
    weights: str | None = None
    wrappers: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = field(default=())


def parse_spec(text: str) -> Spec:
    """``vote(k=3,L=320)+noise+name:weights`` to a Spec; unknown wrappers or keys are errors."""
    wrappers = []
    while "+" in text.split(":", 1)[0]:
        head, text = text.split("+", 1)
        found = re.fullmatch(r"(vote|noise|std)(?:\(([^)]*)\))?", head)
        if not found or (found[1] != "vote" and found[2] is not None):
            raise ValueError(f"no wrapper {head!r}")
        options = []
        for item in filter(None, (found[2] or "").split(",")):
            key, sep, value = item.partition("=")
            if not sep or key.strip() not in KEYS:
                raise ValueError(f"no vote option {item!r}")
            name = KEYS[key.strip()]
            options.append((name, float(value) if name == "alpha" else int(value)))
        wrappers.append((found[1], tuple(options)))
    base, _, weights = text.partition(":")
    if not base:
        raise ValueError("a specification needs a model")
    return Spec(base, weights or None, tuple(wrappers))


def vote(crops: DataFrame, by: list[str], topk: int = 0, alpha: float = 0.0, logit: bool = False) -> DataFrame:
    """by and vote: the mean of the topk best crop scores (all if 0), in log odds if ``logit``, plus alpha times the
    population deviation of all crops. The crops of one image are few."""
    s = F.sort_array(F.collect_list(F.col("score").cast("double")), asc=False)
    held = crops.groupBy(*by).agg(s.alias("s"), F.stddev_pop("score").alias("sd"))
    top = F.slice("s", 1, topk) if topk > 0 else F.col("s")
    if logit:
        eps = 1e-4
        top = F.transform(top, lambda x: F.ln((x + eps) / (1 - x + eps)))
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    if logit:
        mean = 1 / (1 + F.exp(-mean))
    return held.select(*by, (mean + alpha * F.col("sd")).alias("vote"))


def rules(crops: DataFrame, by: list[str]) -> DataFrame:
    """Mean, size_mean, area, median, top3 and trim10 of crop scores (x0, y0, x1, y1, score) for each image."""
    score, side = F.col("score").cast("double"), F.col("x1") - F.col("x0")
    rows = crops.select(*by, score.alias("s"), side.alias("side"), (side * (F.col("y1") - F.col("y0"))).cast("double").alias("area"))
    per_size = rows.groupBy(*by, "side").agg(F.avg("s").alias("m")).groupBy(*by).agg(F.avg("m").alias("size_mean"))
    held = rows.groupBy(*by).agg(F.avg("s").alias("mean"), (F.sum(F.col("s") * F.col("area")) / F.sum("area")).alias("area"), F.median("s").alias("median"), F.sort_array(F.collect_list("s")).alias("all"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    n, k = F.size("all"), F.floor(F.size("all") * 0.1).cast("int")
    top = F.slice(F.reverse("all"), 1, 3)
    trimmed = F.slice("all", k + 1, n - 2 * k)
    return held.select(*by, "mean", "area", "median", (total(top) / F.size(top)).alias("top3"), (total(trimmed) / F.size(trimmed)).alias("trim10")).join(per_size, by)


def coverage(crops: DataFrame, by: list[str]) -> DataFrame:
    """pixel score (mean over covered pixels of the mean score of the boxes there), and least, most and mean coverage.

    Pixels are not made: boxes cut the plane into cells between consecutive coordinates, of which an image has few.
    """
    box = F.struct("x0", "y0", "x1", "y1", F.col("score").cast("double").alias("s"))
    held = crops.groupBy(*by).agg(F.collect_list(box).alias("b"))
    axis = lambda a, b: F.array_sort(F.array_distinct(F.concat(F.transform("b", lambda x: x[a]), F.transform("b", lambda x: x[b]))))
    cut = held.select(*by, "b", axis("x0", "x1").alias("xs"), axis("y0", "y1").alias("ys"))
    cells = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.struct(F.get(a, i - 1).alias("lo"), F.get(a, i).alias("hi")))
    grid = cut.select(*by, "b", F.explode(cells(F.col("xs"))).alias("x"), "ys").select(*by, "b", "x", F.explode(cells(F.col("ys"))).alias("y"))
    over = F.filter("b", lambda b: (b["x0"] <= F.col("x.lo")) & (b["x1"] >= F.col("x.hi")) & (b["y0"] <= F.col("y.lo")) & (b["y1"] >= F.col("y.hi")))
    area = ((F.col("x.hi") - F.col("x.lo")) * (F.col("y.hi") - F.col("y.lo"))).cast("double")
    one = grid.select(*by, area.alias("area"), over.alias("o")).where(F.size("o") > 0).select(*by, "area", F.size("o").alias("n"), (F.aggregate("o", F.lit(0.0), lambda a, b: a + b["s"]) / F.size("o")).alias("m"))
    return one.groupBy(*by).agg((F.sum(F.col("m") * F.col("area")) / F.sum("area")).alias("pixel"), F.min("n").alias("least"), F.max("n").alias("most"), (F.sum(F.col("n") * F.col("area")) / F.sum("area")).alias("mean_cover"))


def weighted_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Binary cross entropy of (label, score, weight), weighted."""
    p = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col("score").cast("double")))
    loss = -F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return rows.groupBy(*by).agg((F.sum(F.col("weight") * loss) / F.sum("weight")).alias("loss"))


def decided(score: Column, threshold: float = 0.5) -> Column:
    """struct(pred, label): the rounded score for show, and the decision by the exact one."""
    return F.struct(F.bround(score, 6).alias("pred"), (score >= threshold).cast("int").alias("label"))
