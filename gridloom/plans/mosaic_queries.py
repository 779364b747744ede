"""Queries over pixels across tiles: halos, viewports, blocks and images drawn into tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import mosaics
from gridloom.plans.tile_queries import read

DIM, ZOOM, VIEW, IMAGE = 8, 12, 12, 8
_hash = lambda *cs: F.concat(*(F.unhex(F.sha2(F.col(c).cast("string"), 256)) for c in cs))


def _tiles(spark, d) -> DataFrame:
    """Customers as tiles of 8 x 8 pixels, packed side by side in a patch 64 tiles wide that starts at the world's western edge; every ninth is missing."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").where(k % 9 > 0).select(F.lit(ZOOM).alias("z"), (k % 64).alias("x"), F.floor(k / 64).alias("y"), _hash("c_name", "c_mktsegment").alias("body"))


def halo_bytes(spark, d):
    """Each tile with a border of one pixel from its neighbours: hash of the buffer, and neighbours missing."""
    return mosaics.with_halo(_tiles(spark, d), DIM, 1).select("x", "y", F.sha2("buffer", 256).alias("sha256"), "missing")


def viewport_bytes(spark, d):
    """For each supplier the middle of four tiles, as a watch shows it: hash of its pixels, and tiles missing."""
    k = F.col("s_suppkey")
    off = (2 * DIM - VIEW) // 2
    v = read(spark, d, "supplier").select(k.alias("view"), F.lit(ZOOM).alias("z"), (k * 5 % 63 * DIM + off).alias("left"), (F.floor(k * 5 / 63) % 20 * DIM + off).alias("top"), F.lit(VIEW).alias("width"), F.lit(VIEW).alias("height"))
    return mosaics.viewports(_tiles(spark, d), v, DIM).select(F.col("view").alias("s_suppkey"), F.sha2("buffer", 256).alias("sha256"), "missing")


def block_slices(spark, d):
    """Parts as rendered blocks of 2 x 2 tiles of 4 x 4 pixels, sliced by the buffer's stride: hash of each tile."""
    b = read(spark, d, "part").select("p_partkey", _hash("p_name", "p_type").alias("body"), F.lit(2).alias("cols"), F.lit(2).alias("rows"))
    return mosaics.sliced(b, 4, channels=1).select("p_partkey", "tx", "ty", F.sha2("tile", 256).alias("sha256"))


def image_tiles(spark, d):
    """Suppliers as images of 8 x 8 pixels pinned to the map by six coefficients, drawn into the four tiles of zoom 1: hash and pixels covered."""
    k = F.col("s_suppkey")
    affn = F.array(*((v).cast("double") for v in (k % 200 - 150, F.lit(10) + k % 17, k % 3, 60 - k % 40, F.lit(0) - k % 2, F.lit(-8) - k % 5)))
    i = read(spark, d, "supplier").select("s_suppkey", F.lit(IMAGE).alias("width"), F.lit(IMAGE).alias("height"), _hash("s_name", "s_nationkey").alias("body"), affn.alias("affn"))
    four = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 1) for y in (0, 1))))
    t = i.select("s_suppkey", F.lit(1).alias("z"), four.alias("t")).select("s_suppkey", "z", "t.x", "t.y")
    return mosaics.drawn_tiles(i, t, "s_suppkey", DIM).select("s_suppkey", "x", "y", F.sha2("body", 256).alias("sha256"), "covered")


QUERIES = {f.__name__: f for f in (halo_bytes, viewport_bytes, block_slices, image_tiles)}
_TILES = f"""t AS (SELECT c_custkey % 64 AS x, c_custkey // 64 AS y, sha256(c_name) || sha256(c_mktsegment) AS h FROM customer WHERE c_custkey % 9 > 0),
  p AS (SELECT x * {DIM} + i.range % {DIM} AS gx, y * {DIM} + i.range // {DIM} AS gy, substr(h, i.range * 2 + 1, 2) AS v FROM t, range({DIM * DIM}) i)"""
_W = DIM << ZOOM
SQL = {
    "halo_bytes": f"""WITH {_TILES}, b AS (SELECT x, y, j.range AS j, ((x * {DIM} + j.range % {DIM + 2} - 1) % {_W} + {_W}) % {_W} AS gx, y * {DIM} + j.range // {DIM + 2} - 1 AS gy FROM t, range({(DIM + 2) ** 2}) j),
      s AS (SELECT b.x, b.y, sha256(unhex(string_agg(coalesce(v, 'ff'), '' ORDER BY j))) AS sha256 FROM b LEFT JOIN p USING (gx, gy) GROUP BY ALL),
      n AS (SELECT a.x, a.y, count(*) AS k FROM t a JOIN t b ON abs(a.y - b.y) <= 1 AND ((a.x - b.x + {1 << ZOOM} + 1) % {1 << ZOOM}) <= 2 GROUP BY ALL)
      SELECT s.x, s.y, sha256, CAST(9 - k AS INTEGER) AS missing FROM s JOIN n USING (x, y)""",
    "viewport_bytes": f"""WITH {_TILES}, w AS (SELECT s_suppkey, s_suppkey * 5 % 63 AS tx, (s_suppkey * 5 // 63) % 20 AS ty FROM supplier),
      b AS (SELECT s_suppkey, j.range AS j, tx * {DIM} + 2 + j.range % {VIEW} AS gx, ty * {DIM} + 2 + j.range // {VIEW} AS gy FROM w, range({VIEW**2}) j),
      n AS (SELECT s_suppkey, CAST(4 - count(t.x) AS INTEGER) AS missing FROM w LEFT JOIN t ON t.x - w.tx BETWEEN 0 AND 1 AND t.y - w.ty BETWEEN 0 AND 1 GROUP BY 1)
      SELECT s_suppkey, sha256(unhex(string_agg(coalesce(v, 'ff'), '' ORDER BY j))) AS sha256, any_value(missing) AS missing FROM b LEFT JOIN p USING (gx, gy) JOIN n USING (s_suppkey) GROUP BY 1""",
    "block_slices": """SELECT p_partkey, CAST(tx.range AS INTEGER) AS tx, CAST(ty.range AS INTEGER) AS ty, sha256(unhex(array_to_string(list_transform([0, 1, 2, 3], lambda r: substr(h, CAST(((ty.range * 4 + r) * 8 + tx.range * 4) * 2 + 1 AS BIGINT), 8)), ''))) AS sha256
      FROM (SELECT p_partkey, sha256(p_name) || sha256(p_type) AS h FROM part), range(2) tx, range(2) ty""",
    "image_tiles": f"""WITH i AS (SELECT s_suppkey, sha256(s_name) || sha256(CAST(s_nationkey AS VARCHAR)) AS h, (s_suppkey % 200 - 150)::DOUBLE AS a, (10 + s_suppkey % 17)::DOUBLE AS b, (s_suppkey % 3)::DOUBLE AS c, (60 - s_suppkey % 40)::DOUBLE AS d, (0 - s_suppkey % 2)::DOUBLE AS e, (-8 - s_suppkey % 5)::DOUBLE AS f FROM supplier),
      q AS (SELECT i.*, tx.range AS x, ty.range AS y, j.range AS j, (tx.range * {DIM} + j.range % {DIM} + 0.5::DOUBLE) / {2 * DIM} * 360 - 180 - a AS dlon,
        degrees(atan(sinh(pi() * (1 - 2 * (ty.range * {DIM} + j.range // {DIM} + 0.5::DOUBLE) / {2 * DIM})))) - d AS dlat FROM i, range(2) tx, range(2) ty, range({DIM * DIM}) j),
      r AS (SELECT *, floor((dlon * f - dlat * c) / (b * f - c * e)) AS col, floor((dlat * b - dlon * e) / (b * f - c * e)) AS line FROM q)
      SELECT s_suppkey, x, y, sha256(unhex(string_agg(CASE WHEN inside THEN substr(h, CAST((line * {IMAGE} + col) * 2 + 1 AS BIGINT), 2) ELSE 'ff' END, '' ORDER BY j))) AS sha256, CAST(count(*) FILTER (inside) AS INTEGER) AS covered
      FROM (SELECT *, col BETWEEN 0 AND {IMAGE - 1} AND line BETWEEN 0 AND {IMAGE - 1} AS inside FROM r) GROUP BY ALL""",
}
