"""Queries over tile keys, regions, layouts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import codec, geo
from gridloom.operators import tiles


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _pts(key: str, table: str, more: str = "") -> str:
    return f"""SELECT {key} AS id, ((({key} * {tiles.LON_STEP}) % 360000000) - 180000000) / 1e6 AS lon,
       ((({key} * {tiles.LAT_STEP}) % 170000000) - 85000000) / 1e6 AS lat{more} FROM {table}"""


def _x(lon: str, z: str) -> str:
    return f"CAST(greatest(0, least(floor((greatest(-180.0::DOUBLE, least(180.0::DOUBLE, {lon})) + 180) / 360 * pow(2.0, {z})), pow(2.0, {z}) - 1)) AS BIGINT)"


def _y(lat: str, z: str) -> str:
    return f"CAST(greatest(0, least(floor((1 - asinh(tan(radians(greatest(-{geo.MAX_LAT}::DOUBLE, least({geo.MAX_LAT}::DOUBLE, {lat}))))) / pi()) / 2 * pow(2.0, {z})), pow(2.0, {z}) - 1)) AS BIGINT)"


def tile_assign(spark, d):
    return tiles.assign(tiles.points(read(spark, d, "orders"), "o_orderkey").withColumn("z", F.lit(12))).select("id", "z", "x", "y")


def tile_density(spark, d):
    """Points per tile of a pyramid: zooms 0 to 6."""
    return tiles.pyramid(tiles.density(tiles.assign(tiles.points(read(spark, d, "orders"), "o_orderkey").withColumn("z", F.lit(6)))), 0)


_DENSITY = f"""SELECT CAST(z AS INTEGER) AS z, {_x("lon", "z")} AS x, {_y("lat", "z")} AS y, count(*) AS n
FROM ({_pts("o_orderkey", "orders")}) p, (SELECT unnest(range(0, 7)) AS z) zs GROUP BY ALL"""


def mercator_inverse(spark, d):
    t = tile_assign(spark, d)
    return t.select("id", geo.micro(geo.tile_lon(F.col("x"), F.col("z"))).alias("lon_micro"), geo.micro(geo.tile_lat(F.col("y"), F.col("z"))).alias("lat_micro"), geo.micro_text(geo.micro(geo.tile_lon(F.col("x"), F.col("z")))).alias("lon_text"), geo.flip_row(F.col("y"), F.col("z")).alias("y_flipped"))


def _regions(spark, d):
    """A region for each nation: the box within 60 km of its first customer's point."""
    c = read(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k"))
    p = tiles.points(c.select("c_nationkey", "k"), "k").join(c, F.col("id") == F.col("k"))
    return p.select(F.col("c_nationkey").alias("region"), *(v.alias(k) for k, v in geo.radius_box(F.col("lon"), F.col("lat"), 60.0).items()))


_REGIONS = f"""SELECT region, lon - 60.0::DOUBLE / {geo.KM_PER_DEGREE}::DOUBLE / cos(radians(lat)) AS min_lon, lat - 60.0::DOUBLE / {geo.KM_PER_DEGREE}::DOUBLE AS min_lat,
  lon + 60.0::DOUBLE / {geo.KM_PER_DEGREE}::DOUBLE / cos(radians(lat)) AS max_lon, lat + 60.0::DOUBLE / {geo.KM_PER_DEGREE}::DOUBLE AS max_lat
  FROM ({_pts("k", "(SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY c_nationkey)", ", c_nationkey AS region")})"""
_EXTENTS = f"""SELECT *, x1 - x0 + 1 AS nx, y1 - y0 + 1 AS ny FROM (
  SELECT region, CAST(z AS INTEGER) AS z, {_x("min_lon", "z")} AS x0, {_x("max_lon", "z")} AS x1, {_y("max_lat", "z")} AS y0, {_y("min_lat", "z")} AS y1
  FROM ({_REGIONS}), (SELECT unnest(range(8, 13)) AS z))"""


def region_tile_counts(spark, d):
    e = tiles.extents(_regions(spark, d), 8, 12)
    return e.groupBy("region").agg(F.sum(F.col("nx") * F.col("ny")).cast("bigint").alias("tiles"), F.max("nx").alias("widest"), F.max(geo.grid_level(F.col("z"), F.lit(128))).alias("top_level"))


def bbox_enumerate(spark, d):
    return tiles.enumerate_tiles(tiles.extents(_regions(spark, d), 8, 12)).select("region", "z", "x", "y")


def _index(spark, d):
    """Documents as tiles: a pack for each source, keys from doc_id, lengths from the UTF-8 bodies."""
    k = F.col("doc_id")
    return read(spark, d, "documents").select(F.col("source").alias("pack_id"), (18 + F.pmod(k, F.lit(3))).cast("int").alias("z"), F.pmod(k * 7919, F.lit(1 << 18)).alias("x"), k.alias("y"), F.octet_length("text").cast("bigint").alias("length"))


_INDEX = "SELECT source AS pack_id, CAST(18 + doc_id % 3 AS INTEGER) AS z, (doc_id * 7919) % 262144 AS x, doc_id AS y, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents"
_LAYOUT = f"""SELECT pack_id, z, x, y, length, CAST(ceil((292 + 20 * count(*) OVER (PARTITION BY pack_id)) / 4.0) * 4
  + coalesce(sum(ceil(length / 4.0) * 4) OVER (PARTITION BY pack_id ORDER BY z, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM ({_INDEX})"""


def layout_offsets(spark, d):
    return tiles.layout(_index(spark, d)).select("pack_id", "z", "x", "y", "length", "offset")


def zoom_directory(spark, d):
    return tiles.zoom_directory(_index(spark, d))


def index_bytes(spark, d):
    """Each tile's 20-byte index entry, as hex."""
    t = tiles.layout(_index(spark, d))
    h = F.concat(F.lpad(F.hex("z"), 2, "0"), F.lit("000000"), *(codec.le_hex(F.col(c), 4) for c in ("x", "y", "offset", "length")))
    return t.select("pack_id", "y", h.alias("entry"))


def _le(v: str) -> str:
    h = f"printf('%08X', {v})"
    return " || ".join(f"substr({h}, {k}, 2)" for k in (7, 5, 3, 1))


def tile_lookup(spark, d):
    """Customers' tiles in the index of orders at zoom 6, with what they hold."""
    z = F.lit(6)
    keys = tiles.assign(tiles.points(read(spark, d, "customer"), "c_custkey").withColumn("z", z)).select("id", "z", "x", "y")
    index = tiles.density(tiles.assign(tiles.points(read(spark, d, "orders"), "o_orderkey").withColumn("z", z)))
    return tiles.lookup(keys, index).select("id", "x", "y", "n")


def _run(spark, d, where):
    o = tiles.assign(tiles.points(read(spark, d, "orders").where(where), "o_orderkey").withColumn("z", F.lit(5)))
    return o.groupBy("z", "x", "y").agg(F.sum("id").alias("h"))


def run_diff(spark, d):
    return tiles.compare_runs(_run(spark, d, "o_orderstatus <> 'P'"), _run(spark, d, "o_orderpriority <> '5-LOW'"), ["z", "x", "y"], "h")


def _run_sql(where: str) -> str:
    return f"SELECT x, y, sum(id) AS h FROM (SELECT id, {_x('lon', '5')} AS x, {_y('lat', '5')} AS y FROM ({_pts('o_orderkey', 'orders')} WHERE {where})) GROUP BY x, y"


def order_violations(spark, d):
    """Events of a user whose value isn't above that of the one before."""
    return tiles.order_violations(read(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "event_id", ["value"]).select("event_id", "user_id")


def duplicate_keys(spark, d):
    """Tile keys that several orders claim."""
    t = tile_assign(spark, d).withColumns({"z": F.lit(6), "x": F.floor(F.col("x") / 64), "y": F.floor(F.col("y") / 64)})
    return t.groupBy("z", "x", "y").agg(F.count("*").alias("n")).where("n > 1")


def shift_search(spark, d):
    """Lineitem as small images, one a part of ten orders, against themselves moved by (1, 0) with some pixels changed."""
    code = F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(64)).cast("int")
    px = read(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 40).alias("image"), F.pmod("l_orderkey", F.lit(40)).cast("int").alias("gx"), F.col("l_linenumber").alias("gy"), code.alias("code"))
    px = px.groupBy("image", "gx", "gy").agg(F.min("code").alias("code"))
    b = px.select("image", (F.col("gx") + 1).alias("gx"), "gy", F.when(F.col("code") == 5, 6).otherwise(F.col("code")).alias("code"))
    return tiles.shift_search(px, b, "image")


_PX = "SELECT l_orderkey // 40 AS image, CAST(l_orderkey % 40 AS INTEGER) AS gx, l_linenumber AS gy, min(CAST((l_partkey * 7 + l_suppkey) % 64 AS INTEGER)) AS code FROM lineitem GROUP BY ALL"


def rate_schedule(spark, d):
    """When each event's request may go out, per host: never sooner than the interval after the one before.

    The recurrence t = max(arrival, last + interval) is n * interval plus a running maximum. Both go in two levels, by
    hours, so that a busy host isn't one task: numbers and maxima within an hour, and those of the hours before."""
    e = read(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(64)).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrive"))
    e = tiles.numbered(e.withColumn("hour", F.floor(F.col("arrive") / 3_600_000_000)), ["host"], ["arrive", "event_id"], "hour", "n").withColumn("slack", F.col("arrive") - F.col("n") * 250_000)
    hours = e.groupBy("host", "hour").agg(F.max("slack").alias("most"))
    hours = hours.select("host", "hour", F.max("most").over(Window.partitionBy("host").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.max("slack").over(Window.partitionBy("host", "hour").orderBy("arrive", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = tiles.with_group(e.withColumn("inside", inside), hours, ["host", "hour"])
    return e.select("event_id", "host", (F.col("n") * 250_000 + F.greatest("inside", "before")).cast("bigint").alias("send"))


QUERIES = {f.__name__: f for f in (tile_assign, tile_density, mercator_inverse, region_tile_counts, bbox_enumerate, layout_offsets, zoom_directory, index_bytes, tile_lookup, run_diff, order_violations, duplicate_keys, shift_search, rate_schedule)}
_ASSIGN = f"SELECT id, 12 AS z, {_x('lon', '12')} AS x, {_y('lat', '12')} AS y FROM ({_pts('o_orderkey', 'orders')})"
SQL = {
    "tile_assign": _ASSIGN,
    "tile_density": _DENSITY,
    "mercator_inverse": f"""WITH t AS ({_ASSIGN}), m AS (SELECT id, y, CAST(round_even((x / 4096.0::DOUBLE * 360 - 180) * 1e6, 0) AS INTEGER) AS lon_micro,
        CAST(round_even(degrees(atan(sinh(pi() * (1 - 2 * y / 4096.0::DOUBLE)))) * 1e6, 0) AS INTEGER) AS lat_micro FROM t)
      SELECT id, lon_micro, lat_micro, CASE WHEN lon_micro < 0 THEN '-' ELSE '' END || (abs(lon_micro) // 1000000) || '.' || lpad(CAST(abs(lon_micro) % 1000000 AS VARCHAR), 6, '0') AS lon_text, 4095 - y AS y_flipped FROM m""",
    "region_tile_counts": f"SELECT region, CAST(sum(nx * ny) AS BIGINT) AS tiles, max(nx) AS widest, max(z + 1) AS top_level FROM ({_EXTENTS}) GROUP BY region",
    "bbox_enumerate": f"SELECT region, z, unnest(generate_series(x0, x1)) AS x, y FROM (SELECT *, unnest(generate_series(y0, y1)) AS y FROM ({_EXTENTS}))",
    "layout_offsets": _LAYOUT,
    "zoom_directory": f"""SELECT pack_id, z, CAST(292 + 20 * coalesce(sum(n) OVER (PARTITION BY pack_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_offset, n
      FROM (SELECT pack_id, z, count(*) AS n FROM ({_INDEX}) GROUP BY pack_id, z)""",
    "index_bytes": f"""SELECT pack_id, y, printf('%02X', z) || '000000' || {_le("x")} || {_le("y")} || {_le('"offset"')} || {_le("length")} AS entry FROM ({_LAYOUT})""",
    "tile_lookup": f"""SELECT k.id, k.x, k.y, n FROM (SELECT id, {_x("lon", "6")} AS x, {_y("lat", "6")} AS y FROM ({_pts("c_custkey", "customer")})) k
      LEFT JOIN (SELECT {_x("lon", "6")} AS x, {_y("lat", "6")} AS y, count(*) AS n FROM ({_pts("o_orderkey", "orders")}) GROUP BY ALL) i ON i.x = k.x AND i.y = k.y""",
    "run_diff": f"""WITH a AS ({_run_sql("o_orderstatus <> 'P'")}), b AS ({_run_sql("o_orderpriority <> '5-LOW'")}),
      s AS (SELECT count(*) FILTER (a.h IS NOT NULL AND b.h IS NOT NULL) AS common, count(*) FILTER (b.h IS NULL) AS missing_b, count(*) FILTER (a.h IS NULL) AS missing_a,
            count(*) FILTER (a.h <> b.h) AS differing FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y)
      SELECT *, round(differing * 100.0::DOUBLE / common, 6) AS percent FROM s""",
    "order_violations": """SELECT event_id, user_id FROM (SELECT event_id, user_id, value, lag(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
      WHERE v0 >= value""",
    "duplicate_keys": f"SELECT 6 AS z, x // 64 AS x, y // 64 AS y, count(*) AS n FROM ({_ASSIGN}) GROUP BY ALL HAVING count(*) > 1",
    "shift_search": f"""WITH a AS ({_PX}), b AS (SELECT image, gx + 1 AS gx, gy, CASE WHEN code = 5 THEN 6 ELSE code END AS code FROM a),
      m AS (SELECT image, dx, dy, gx + dx AS gx, gy + dy AS gy, code FROM a, (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS dx), (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS dy)),
      s AS (SELECT m.image, dx, dy, count(*) AS n, round(count(*) FILTER (m.code <> b.code) * 100.0::DOUBLE / count(*), 6) AS pct FROM m JOIN b ON m.image = b.image AND m.gx = b.gx AND m.gy = b.gy GROUP BY ALL)
      SELECT image, dx, dy, pct, n FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY pct, dy, dx) AS r FROM s) WHERE r = 1""",
    "rate_schedule": """WITH e AS (SELECT event_id, user_id % 64 AS host, epoch_us(ts) AS arrive FROM events), n AS (SELECT *, row_number() OVER w - 1 AS n FROM e WINDOW w AS (PARTITION BY host ORDER BY arrive, event_id))
      SELECT event_id, host, n * 250000 + max(arrive - n * 250000) OVER (PARTITION BY host ORDER BY arrive, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS send FROM n""",
}
