"""Crop geometry against the same rules in plain Python, over many sizes."""

import math

import pytest
from pyspark.sql import functions as F

from curata.functions import geometry as g

SIZES = [(1, 1), (37, 61), (64, 900), (333, 127), (512, 512), (801, 640), (2048, 95), (4000, 3001)]


def pictures(spark):
    return spark.createDataFrame(SIZES, "w int, h int")


def shrunk_and_grown(w, h, long, least):
    if max(w, h) > long:
        w, h = (max(1, round(x * (long / max(w, h)))) for x in (w, h))
    if min(w, h) < least:
        w, h = (max(least, round(x * (least / min(w, h)))) for x in (w, h))
    return w, h


@pytest.mark.parametrize("long, least", [(320, 112), (200, 64)])
def test_canvas(spark, long, least):
    got = pictures(spark).select("w", "h", g.canvas(F.col("w"), F.col("h"), long, least).alias("c")).collect()
    assert {(r["w"], r["h"]): tuple(r["c"]) for r in got} == {(w, h): shrunk_and_grown(w, h, long, least) for w, h in SIZES}


@pytest.mark.parametrize("tile", [0, 1, 2])
def test_boxes_lie_inside_and_cover(spark, tile):
    got = pictures(spark).where("w >= 64 AND h >= 64").select("w", "h", g.vote_boxes(F.col("w"), F.col("h"), 48, 96, 4, 3, 8, tile).alias("b")).collect()
    for r in got:
        boxes = [tuple(b) for b in r["b"]]
        assert boxes and all(0 <= x0 < x1 <= r["w"] and 0 <= y0 < y1 <= r["h"] and x1 - x0 == y1 - y0 for x0, y0, x1, y1 in boxes)
        assert {x1 - x0 for x0, _, x1, _ in boxes} == {min(size, r["w"], r["h"]) // 8 * 8 for size in (48, 64, 80, 96)}
        # corners are always covered
        assert min(b[0] for b in boxes) == min(b[1] for b in boxes) == 0
        assert max(b[2] for b in boxes) == r["w"] and max(b[3] for b in boxes) == r["h"]
        if tile == 1:  # a partition leaves no column out
            xs = {x for x0, _, x1, _ in boxes for x in range(x0, x1)}
            assert xs == set(range(r["w"]))


def test_projection(spark):
    cases = [((3, 5, 40, 41), (90, 70), (450, 210)), ((0, 0, 7, 9), (10, 10), (33, 25)), ((5, 1, 10, 10), (10, 10), (4, 3))]
    for box, (w, h), (tw, th) in cases:
        column = g.project_box(F.struct(*(F.lit(v).alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1")))), F.lit(w), F.lit(h), F.lit(tw), F.lit(th))
        x0, y0, x1, y1 = box
        want = (math.floor(x0 * tw / w), math.floor(y0 * th / h), min(tw, math.ceil(x1 * tw / w)), min(th, math.ceil(y1 * th / h)))
        assert tuple(spark.range(1).select(column.alias("x")).first()["x"]) == want


@pytest.mark.parametrize("least, most, n, step", [(100, 190, 4, 1), (90, 91, 5, 1), (64, 64, 3, 16), (60, 200, 1, 16), (50, 211, 6, 20)])
def test_ladder(spark, least, most, n, step):
    rungs = [least + k * (most - least) / (n - 1) for k in range(n)] if n > 1 and least < most else [most]
    want = sorted({max(step, round(x) // step * step) for x in rungs})
    assert spark.range(1).select(g.size_ladder(least, most, n, step).alias("x")).first()["x"] == want


def test_density(spark):
    got = [r[0] for r in pictures(spark).select(g.pick_grid(F.col("w"), F.col("h"))).collect()]
    assert got == [min(7, max(3, -(-min(s) // 224))) for s in SIZES]
