"""Queries that complete others: whole orders, strict profiles, disagreements over colours, overriding notices, learned breakdowns and grids as lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import geo, pixels
from gridloom.operators import estimate, tiles
from gridloom.plans.build_queries import _SRC, _sources
from gridloom.plans.colour_queries import _MODEL, _modelled, _used
from gridloom.plans.pixel_queries import _CODE, _PX, _px
from gridloom.plans.study_queries import MOST_CELLS
from gridloom.plans.tile_queries import _EXTENTS, _INDEX, _index, _regions, read


def codes_by_lightness(spark, d):
    """All codes in use from dark to light, with the share of pixels up to each. At most 64 rows meet in the windows."""
    c = _modelled(_used(spark, d)).select("code", "n", F.round("l", 6).alias("l"))
    w = Window.orderBy("l", "code")
    return c.select("code", F.row_number().over(w).alias("place"), F.round(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


def strict_profile(spark, d):
    """Tiles of packs by what a core reader and a strict one say to how they are packed: the core knows two ways, the strict one none but plain."""
    t = _index(spark, d).withColumn("how", F.pmod("y", F.lit(4)))
    said = F.array(F.struct(F.lit("core").alias("profile"), F.when(F.col("how") > 1, "compression").otherwise("ok").alias("said")), F.struct(F.lit("strict").alias("profile"), F.when(F.col("how") > 1, "compression").when(F.col("how") == 1, "compression_strict").otherwise("ok").alias("said")))
    return t.select("pack_id", F.explode(said).alias("s")).groupBy("pack_id", "s.profile", "s.said").agg(F.count("*").alias("n"))


def colour_disagreement(spark, d):
    """Colours of pixels whose two-bit code by thresholds isn't that by truncation: of all distinct ones and of pixels, by how many channels differ."""
    c = _px(spark, d).groupBy("r", "g", "b").agg(F.count("*").alias("n"))
    differ = sum((pixels.two_bit(F.col(k)) != F.shiftright(k, 6)).cast("int") for k in "rgb")
    c = c.groupBy(differ.alias("channels")).agg(F.count("*").alias("colours"), F.sum("n").alias("pixels"))  # four rows
    every = Window.partitionBy()
    return c.select("channels", "colours", "pixels", F.round(F.col("colours") * 100.0 / F.sum("colours").over(every), 6).alias("percent"))


def notice_overrides(spark, d):
    """Each pack's notices, one a source in layer order, where a source's own setting takes the place of its notice, and an empty one silences it (extension)."""
    s = _sources(spark, d)
    own = F.when(F.col("layer") % 7 == 0, F.concat(F.lit("set "), F.col("layer").cast("string"))).when(F.col("layer") % 11 == 0, "")
    s = s.withColumn("said", F.coalesce(own, "notice")).where("said <> ''")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "said"))), lambda x: x["said"]), "\n")
    return s.groupBy("pack").agg(F.sha2(told, 256).alias("notice_sha256"), F.count("*").alias("lines"))


def learned_breakdown(spark, d):
    """Seconds that each level of a region would take at the rate that a user's own builds have taught, of the user whose number the region has."""
    rate = estimate.learned_rate(read(spark, d, "events"), "user_id", "event_id", "value", F.col("value") >= 10)
    e = tiles.extents(_regions(spark, d), 8, 12).select("region", "z", (F.col("nx") * F.col("ny") * 16_384 / 1e6).alias("mpx"))
    return e.join(rate, F.col("region") == F.col("user_id"), "left").select("region", "z", F.round(F.col("mpx") * F.coalesce("rate", F.lit(estimate.MS_PER_MPX)) / 1000, 6).alias("seconds"), F.col("rate").isNotNull().alias("learned"))


def grid_coordinates(spark, d):
    """The grid that a region is drawn with: its coarsest level, the coordinates of its lines, none where that level has too many cells."""
    z = F.col("z")
    e = tiles.extents(_regions(spark, d), 8, 12)
    e = e.groupBy("region").agg(F.min_by(F.struct("z", "x0", "x1", "y0", "y1", "nx", "ny"), "z").alias("e")).select("region", "e.*")
    few = F.col("nx") * F.col("ny") <= MOST_CELLS
    line = lambda of, a, b: F.when(few, F.transform(F.sequence(F.col(a), F.col(b) + 1), lambda k: F.round(of(k, z), 6) + 0.0))
    e = e.select("region", F.when(few, z).alias("z"), line(geo.tile_lon, "x0", "x1").alias("lons"), line(geo.tile_lat, "y0", "y1").alias("lats"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 4)
    return e.select("region", "z", F.size("lons").alias("columns"), F.size("lats").alias("rows"), F.get("lons", F.lit(0)).alias("west"), F.get("lats", F.lit(0)).alias("north"), total("lons").alias("lon_sum"), total("lats").alias("lat_sum"))


QUERIES = {f.__name__: f for f in (codes_by_lightness, strict_profile, colour_disagreement, notice_overrides, learned_breakdown, grid_coordinates)}
_BITS = f"SELECT r, g, b, n, code & 3 AS cr, (code >> 2) & 3 AS cg, (code >> 4) & 3 AS cb FROM (SELECT r, g, b, count(*) AS n, any_value(CAST({_CODE} AS INTEGER)) AS code FROM ({_PX}) GROUP BY r, g, b)"
SQL = {
    "codes_by_lightness": f"WITH m AS (SELECT code, n, round(l, 6) AS l FROM ({_MODEL})) SELECT code, CAST(row_number() OVER w AS INTEGER) AS place, round(sum(n) OVER w * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM m WINDOW w AS (ORDER BY l, code ROWS UNBOUNDED PRECEDING)",
    "strict_profile": f"""WITH t AS (SELECT pack_id, y % 4 AS how FROM ({_INDEX})) SELECT pack_id, profile, said, count(*) AS n FROM (SELECT pack_id, 'core' AS profile, CASE WHEN how > 1 THEN 'compression' ELSE 'ok' END AS said FROM t
      UNION ALL SELECT pack_id, 'strict', CASE WHEN how > 1 THEN 'compression' WHEN how = 1 THEN 'compression_strict' ELSE 'ok' END FROM t) GROUP BY ALL""",
    "colour_disagreement": f"""SELECT channels, colours, pixels, round(colours * 100.0::DOUBLE / sum(colours) OVER (), 6) AS percent FROM (SELECT CAST((cr <> r >> 6)::INT + (cg <> g >> 6)::INT + (cb <> b >> 6)::INT AS INTEGER) AS channels, count(*) AS colours, CAST(sum(n) AS BIGINT) AS pixels FROM ({_BITS}) GROUP BY 1)""",
    "notice_overrides": f"""WITH s AS ({_SRC}), o AS (SELECT pack, layer, CASE WHEN layer % 7 = 0 THEN 'set ' || layer WHEN layer % 11 = 0 THEN '' ELSE notice END AS said FROM s)
      SELECT pack, sha256(string_agg(said, chr(10) ORDER BY layer)) AS notice_sha256, count(*) AS lines FROM o WHERE said <> '' GROUP BY pack""",
    "learned_breakdown": f"""WITH r AS (SELECT user_id, round(greatest(10.0::DOUBLE, list_reduce(list_prepend(313.0::DOUBLE, list(value ORDER BY event_id)), lambda a, v: (a + v) / 2)), 6) AS rate FROM events WHERE value >= 10 GROUP BY user_id)
      SELECT region, z, round(nx * ny * 16384 / 1e6::DOUBLE * coalesce(rate, 313.0::DOUBLE) / 1000, 6) AS seconds, rate IS NOT NULL AS learned FROM ({_EXTENTS}) LEFT JOIN r ON user_id = region""",
    "grid_coordinates": f"""WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY z) AS k FROM ({_EXTENTS})) WHERE k = 1),
      l AS (SELECT region, CASE WHEN nx * ny <= {MOST_CELLS} THEN z END AS z, CASE WHEN nx * ny <= {MOST_CELLS} THEN list_transform(range(x0, x1 + 2), lambda v: round(v / pow(2.0::DOUBLE, z) * 360 - 180, 6)) END AS lons,
        CASE WHEN nx * ny <= {MOST_CELLS} THEN list_transform(range(y0, y1 + 2), lambda v: round(degrees(atan(sinh(pi() * (1 - 2 * v / pow(2.0::DOUBLE, z))))), 6)) END AS lats FROM e)
      SELECT region, z, CAST(len(lons) AS INTEGER) AS columns, CAST(len(lats) AS INTEGER) AS rows, lons[1] AS west, lats[1] AS north, round(list_sum(lons), 4) AS lon_sum, round(list_sum(lats), 4) AS lat_sum FROM l""",
}
