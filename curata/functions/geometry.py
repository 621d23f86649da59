"""Crop geometry as array expressions: size ladders, grids, tiles, canvases, projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions import seeded

CROP_MIN, CROP_MAX, LONG = 112, 176, 320


def snap(size: Column, step: int) -> Column:
    """Rounded down to a multiple of ``step``, which is the least result."""
    return F.greatest(F.lit(step), (F.floor(size / step) * step).cast("int")) if step > 1 else size.cast("int")


def clamp_size(size: Column, w: Column, h: Column) -> Column:
    return F.greatest(F.lit(8), F.least(size, w, h))


def size_ladder(cmin: int = CROP_MIN, cmax: int = CROP_MAX, n: int = 3, step: int = 1) -> Column:
    """Distinct sizes from cmin to cmax in n rungs, each rounded and snapped; one rung is cmax."""
    rungs = F.sequence(F.lit(0), F.lit(n - 1)) if n > 1 and cmin < cmax else F.array(F.lit(0))
    span, last = (cmax - cmin, cmin) if n > 1 and cmin < cmax else (0, cmax)
    size = lambda k: snap(F.bround(F.lit(float(last)) + k * F.lit(span / max(1, n - 1))).cast("int"), step)
    return F.array_sort(F.array_distinct(F.transform(rungs, size)))


def _boxes(xs: Column, ys: Column, c: Column) -> Column:
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x0"), y.alias("y0"), (x + c).alias("x1"), (y + c).alias("y1")))))


def grid_boxes(w: Column, h: Column, size: Column, grid: int = 3, step: int = 1) -> Column:
    """Evenly spaced boxes in rows; equal coordinates once."""
    c = snap(clamp_size(size, w, h), step)
    axis = lambda side: F.array_sort(F.array_distinct(F.array(*(F.bround(t * (side - c) / max(1, grid - 1)).cast("int") for t in range(grid)))))
    return _boxes(axis(w), axis(h), c)


def tile_boxes(w: Column, h: Column, size: Column, m: int = 1, step: int = 1) -> Column:
    """m * m shifted partitions into squares, with the last tile of an axis at its far edge."""
    c = snap(clamp_size(size, w, h), step)

    def axis(side: Column) -> Column:
        starts = [F.bround(o * c / m).cast("int") for o in range(m)]
        runs = [F.when(s + c <= side, F.sequence(s, side - c, c)).otherwise(F.array().cast("array<int>")) for s in starts]
        return F.array_sort(F.array_distinct(F.concat(*runs, F.array(side - c))))

    return _boxes(axis(w), axis(h), c)


def canvas(w: Column, h: Column, long: int = LONG, cmin: int = CROP_MIN) -> Column:
    """struct(w, h) after shrinking the long side to ``long``, then enlarging the short side to ``cmin``."""
    big = F.greatest(w, h)
    shrink = (big > long) if long else F.lit(False)
    scale = F.lit(float(long)) / big
    w1 = F.when(shrink, F.greatest(F.lit(1), F.bround(w * scale).cast("int"))).otherwise(w)
    h1 = F.when(shrink, F.greatest(F.lit(1), F.bround(h * scale).cast("int"))).otherwise(h)
    grow = F.least(w1, h1) < cmin
    up = F.lit(float(cmin)) / F.least(w1, h1)
    w2 = F.when(grow, F.greatest(F.lit(cmin), F.bround(w1 * up).cast("int"))).otherwise(w1)
    h2 = F.when(grow, F.greatest(F.lit(cmin), F.bround(h1 * up).cast("int"))).otherwise(h1)
    return F.struct(w2.alias("w"), h2.alias("h"))


def vote_boxes(w: Column, h: Column, cmin: int = CROP_MIN, cmax: int = CROP_MAX, n_sizes: int = 3, grid: int = 3, step: int = 1, tile: int = 0) -> Column:
    """All boxes of all ladder sizes on a canvas."""
    one = (lambda s: tile_boxes(w, h, s, tile, step)) if tile else (lambda s: grid_boxes(w, h, s, grid, step))
    return F.flatten(F.transform(size_ladder(cmin, cmax, n_sizes, step), one))


def project_box(box: Column, w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """A box on a w * h canvas as it lies on another one: leading edges down, trailing edges up, inside."""
    return F.struct(
        F.greatest(F.lit(0), F.floor(box["x0"] * to_w / w)).cast("int").alias("x0"),
        F.greatest(F.lit(0), F.floor(box["y0"] * to_h / h)).cast("int").alias("y0"),
        F.least(to_w, F.ceil(box["x1"] * to_w / w)).cast("int").alias("x1"),
        F.least(to_h, F.ceil(box["y1"] * to_h / h)).cast("int").alias("y1"),
    )


def pick_grid(w: Column, h: Column) -> Column:
    return F.least(F.lit(7), F.greatest(F.lit(3), F.ceil(F.least(w, h) / 224))).cast("int")


def random_box(w: Column, h: Column, seed: int | str, *key: Column, cmin: int = CROP_MIN, cmax: int = CROP_MAX, step: int = 1) -> Column:
    """A square of drawn size (from cmin to cmax, snapped, and no longer than a side) at a drawn place."""
    size = snap(seeded.integer(f"{seed}:size", min(cmin, cmax), max(cmin, cmax), *key).cast("int"), step)
    c = clamp_size(size, w, h)
    x, y = (seeded.integer(f"{seed}:{n}", 0, F.greatest(F.lit(0), side - c), *key).cast("int") for n, side in (("x", w), ("y", h)))
    return F.struct(x.alias("x0"), y.alias("y0"), (x + c).alias("x1"), (y + c).alias("y1"))
