"""Polygons as tiles, by refinement of a quadtree.

From zoom to zoom only tiles that an edge crosses are split; a tile that none crosses is in or out as a whole and stays as
it is. What is in is told by the even-odd rule, so several rings, holes and rings that cross themselves need no order. A tile knows its
edges and whether its centre is in; a child's centre differs from that by the edges crossed on the way from one centre to the other, all of which
are the parent's, so no task ever holds a polygon: rows are (tile, edge), as many as the outline is long in tiles.

Coordinates are whole numbers from 0 to SIDE - 1 of the map's square, x east and y south, as a tile's are. Tests are in whole numbers and exact. A vertex
belongs to the half-open side (at or before); a centre on an edge counts by the same rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The map's square has 2 ** BITS places a side.
BITS = 24
SIDE = 1 << BITS


def edges(vertices: DataFrame, region: str, ring: list[str], order: str) -> DataFrame:
    """(region, x1, y1, x2, y2) of rings of vertices (region, ring's columns, order, x, y), each closed from its last vertex to its first. Vertices without a place are left out; a ring meets in one window."""
    w = Window.partitionBy(region, *ring).orderBy(order)
    v = vertices.where("x is not null and y is not null")
    v = v.withColumns({"_lx": F.lag("x").over(w), "_ly": F.lag("y").over(w)})
    last = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = v.withColumns({"_lx": F.coalesce("_lx", F.last("x").over(last)), "_ly": F.coalesce("_ly", F.last("y").over(last))})
    return v.select(region, *(F.col(a).cast("bigint").alias(b) for a, b in (("_lx", "x1"), ("_ly", "y1"), ("x", "x2"), ("y", "y2")))).where("x1 <> x2 or y1 <> y2")


def _right_of(x: Column, y: Column) -> Column:
    """Whether the edge crosses the line y (as a half-open span of y) right of x."""
    up = F.col("y2") > F.col("y1")
    side = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (x - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return ((F.col("y1") <= y) != (F.col("y2") <= y)) & F.when(up, side > 0).otherwise(side < 0)


def _below(x: Column, y: Column) -> Column:
    """Whether the edge crosses the line x beyond y."""
    up = F.col("x2") > F.col("x1")
    side = (F.col("y2") - F.col("y1")) * (x - F.col("x1")) - (y - F.col("y1")) * (F.col("x2") - F.col("x1"))
    return ((F.col("x1") <= x) != (F.col("x2") <= x)) & F.when(up, side > 0).otherwise(side < 0)


def _touches(x0: Column, y0: Column, size: int) -> Column:
    """Whether the edge meets the closed square at (x0, y0)."""
    x3, y3 = x0 + size, y0 + size
    box = (F.greatest("x1", "x2") >= x0) & (F.least("x1", "x2") <= x3) & (F.greatest("y1", "y2") >= y0) & (F.least("y1", "y2") <= y3)
    side = lambda x, y: F.signum(((F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))).cast("double"))
    corners = [side(x, y) for x in (x0, x3) for y in (y0, y3)]
    return box & ~(reduce(lambda a, b: a & b, [c > 0 for c in corners]) | reduce(lambda a, b: a & b, [c < 0 for c in corners]))


def _kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut, where the session has a folder for checkpoints; without one the levels stay one plan."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def cover(outline: DataFrame, zmax: int, region: str = "region") -> DataFrame:
    """(region, z, x, y): tiles whose centre at zoom zmax is in, told whole as far up as no edge crosses them. outline: (region, x1, y1, x2, y2)."""
    if not 0 <= zmax < BITS:
        raise ValueError(f"zmax must be from 0 to {BITS - 1}")
    half = lambda z: 1 << (BITS - z - 1)
    centre = F.lit(half(0)).cast("bigint")
    rows = outline.select(region, F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), "x1", "y1", "x2", "y2")
    odd = outline.groupBy(region).agg((F.count_if(_right_of(centre, centre)) % 2 == 1).alias("in"))
    tiles = odd.select(region, F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), "in")
    done = None
    for z in range(zmax):
        # Children of tiles that an edge crosses, each with its parent's edges.
        step, size = half(z + 1), 2 * half(z + 1)
        kids = rows.select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("k"))
        px, py = (F.col(c) * 4 * step + 2 * step for c in "xy")
        nx, ny = (2 * F.col(c) + F.col(f"k.{k}") for c, k in (("x", "a"), ("y", "b")))
        cx, cy = nx * 2 * step + step, ny * 2 * step + step
        # Along the parent's line y, then along the child's line x.
        crossed = (_right_of(px, py) != _right_of(cx, py)).cast("int") + (_below(cx, py) != _below(cx, cy)).cast("int")
        kids = _kept(kids.select(region, nx.alias("x"), ny.alias("y"), "x1", "y1", "x2", "y2", crossed.alias("crossed"), _touches(nx * size, ny * size, size).alias("touch"), F.col("x").alias("_px"), F.col("y").alias("_py")))
        told = kids.groupBy(region, "x", "y", "_px", "_py").agg((F.sum("crossed") % 2 == 1).alias("turn"), F.max("touch").alias("split"))
        above = tiles.select(F.col(region).alias("_r"), F.col("x").alias("_qx"), F.col("y").alias("_qy"), "in")
        told = told.join(above, F.col(region).eqNullSafe(F.col("_r")) & (F.col("_px") == F.col("_qx")) & (F.col("_py") == F.col("_qy")))
        told = _kept(told.select(region, "x", "y", (F.col("in") != F.col("turn")).alias("in"), "split"))
        whole = told.where("in" if z + 1 == zmax else "in and not split").select(region, F.lit(z + 1).alias("z"), "x", "y")
        done = whole if done is None else done.union(whole)
        tiles, rows = told.where("split").drop("split"), kids.where("touch").select(region, "x", "y", "x1", "y1", "x2", "y2")
    return done if done is not None else tiles.where("in").select(region, F.lit(0).alias("z"), "x", "y")


def at_zoom(covered: DataFrame, zmax: int, region: str = "region") -> DataFrame:
    """(region, x, y): the tiles of zoom zmax that lie in those covered, spelled out."""
    n = F.pow(F.lit(2), zmax - F.col("z")).cast("bigint")
    each = covered.withColumn("n", n).withColumn("dx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    each = each.withColumn("dy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return each.select(region, (F.col("x") * F.col("n") + F.col("dx")).alias("x"), (F.col("y") * F.col("n") + F.col("dy")).alias("y"))


def counted(covered: DataFrame, zmax: int, region: str = "region") -> DataFrame:
    """(region, tiles): how many tiles of zoom zmax are covered, without spelling them out."""
    return covered.groupBy(region).agg(F.sum(F.pow(F.lit(4.0), zmax - F.col("z")).cast("bigint")).alias("tiles"))


def combined(parts: DataFrame) -> DataFrame:
    """(z, x, y) that some part (z, x, y, sign) of sign 1 has and none of sign -1, by zoom."""
    return parts.groupBy("z", "x", "y").agg(F.min("sign").alias("least"), F.max("sign").alias("most")).where("least > 0 and most > 0").select("z", "x", "y")
