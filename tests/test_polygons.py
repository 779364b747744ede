"""Covers of polygons against a test of every tile's centre."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import polygons


def inside(edges, px, py):
    n = 0
    for x1, y1, x2, y2 in edges:
        if (y1 <= py) != (y2 <= py):
            side = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
            n += side > 0 if y2 > y1 else side < 0
    return n % 2 == 1


def ring(rng, n):
    return [(rng.randrange(polygons.SIDE // 2) * 2 + 1, rng.randrange(polygons.SIDE // 2) * 2 + 1) for _ in range(n)]


@pytest.mark.parametrize("zmax", [0, 1, 5])
def test_cover_equals_centres(spark, zmax):
    rng = random.Random(zmax)
    rings = {("tri", 0): ring(rng, 3), ("star", 0): ring(rng, 9), ("star", 1): ring(rng, 4), ("hole", 0): [(1001, 1001), (16_000_001, 1001), (16_000_001, 16_000_001), (1001, 16_000_001)], ("hole", 1): [(4_000_001, 4_000_001), (12_000_001, 4_000_001), (12_000_001, 12_000_001), (4_000_001, 12_000_001)], ("line", 0): ring(rng, 2), (None, 0): ring(rng, 5), ("dot", 0): ring(rng, 1)}
    rows = [(r, k, i, x, y) for (r, k), vs in rings.items() for i, (x, y) in enumerate(vs)] + [("tri", 0, 99, None, 5)]
    e = polygons.edges(spark.createDataFrame(rows, "region string, ring int, i int, x long, y long"), "region", ["ring"], "i")
    covered = polygons.cover(e, zmax).cache()
    got = {(r["region"], r["x"], r["y"]) for r in polygons.at_zoom(covered, zmax).collect()}
    half = polygons.SIDE >> (zmax + 1)
    for region in {r for r, _ in rings}:
        own = [(*vs[k - 1], *vs[k]) for (r, _), vs in rings.items() if r == region for k in range(len(vs))]
        want = {(region, x, y) for x in range(1 << zmax) for y in range(1 << zmax) if inside(own, (2 * x + 1) * half, (2 * y + 1) * half)}
        assert {t for t in got if t[0] == region} == want
    assert {(r["region"], r["tiles"]) for r in polygons.counted(covered, zmax).collect()} == {(r, sum(t[0] == r for t in got)) for r, _, _ in got}
    # Nothing is told twice, and what lies inside is told whole.
    assert polygons.at_zoom(covered, zmax).count() == len(got)
    if zmax == 5:
        assert covered.where("region = 'hole'").agg(F.min("z")).first()[0] <= 3 and covered.where("region = 'hole'").count() < sum(t[0] == "hole" for t in got) / 2


def test_union_and_subtraction(spark):
    parts = spark.createDataFrame([(3, 1, 1, 1), (3, 1, 1, 1), (3, 2, 1, 1), (3, 2, 1, -1), (4, 2, 1, 1), (3, 5, 5, -1)], "z int, x long, y long, sign int")
    assert sorted(tuple(r) for r in polygons.combined(parts).collect()) == [(3, 1, 1), (4, 2, 1)]


def test_empty_and_bounds(spark):
    e = spark.createDataFrame([], "region string, x1 long, y1 long, x2 long, y2 long")
    assert polygons.cover(e, 4).collect() == []
    with pytest.raises(ValueError, match="zmax"):
        polygons.cover(e, 24)
