"""Queries over sources, headers of requests, freshness, sizes of builds, layers and styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import geo, web
from gridloom.operators import estimate, tiles
from gridloom.plans import policy_queries
from gridloom.plans.policy_queries import _HOST
from gridloom.plans.tile_queries import _EXTENTS, _regions, _x, _y, read

#: Coded share of raw bytes by zoom (others OTHER_RATIO), share of the grid that is land from zoom 8 on, bytes a second that a device verifies.
RATIOS = {10: 0.45, 11: 0.38, 12: 0.303, 13: 0.196, 14: 0.144, 15: 0.090, 16: 0.060, 17: 0.045, 18: 0.035}
OTHER_RATIO, LAND, VERIFY, RAW = 0.06, 0.148, 2.9e6, 128 * 128
#: Style rules in order: layer, kinds that match, and what the others get; null kinds match nothing.
STYLE = (("green", ("forest", "scrub", "park", "wood"), "#D0EDCD"), ("pale", ("grassland", "farmland", "barren"), "#E9F6E8"), ("major", ("highway", "major_road"), "#383838"), ("minor", ("medium_road", "minor_road"), "#874149"))


def source_router(spark, d):
    """Pages' addresses as source arguments, some of another kind: which source each names."""
    k = F.col("page_id")
    arg = F.when(k % 7 == 0, "synthetic").when(k % 7 == 1, F.concat(F.lit("ftp://h/"), k.cast("string"))).when(k % 7 == 2, F.upper(F.lit("synthetic"))).otherwise(F.col("url"))
    kind = F.when(arg == "synthetic", "synthetic").when(arg.startswith("http://") | arg.startswith("https://"), "url").otherwise("unknown")
    return read(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def synthetic_tiles(spark, d):
    """Suppliers as made-up sources: a grid of 4 x 4 tiles at zoom 2, rows outer, with a digest of each tile's pattern."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.posexplode(F.expr("flatten(transform(sequence(0, 3), y -> transform(sequence(0, 3), x -> struct(x, y))))")).alias("seq", "t"))
    pattern = F.concat(F.lit("2/"), F.col("t.x").cast("string"), F.lit("/"), F.col("t.y").cast("string"), F.lit("/"), F.col("k").cast("string"))
    return s.select("k", "seq", "t.x", "t.y", F.sha2(pattern, 256).alias("sha256"))


def auth_parts(spark, d):
    """Customers' names as request headers and query pairs, some of them broken: names, values, and which kinds a request has (values never leave it)."""
    k, n = F.col("c_custkey"), F.col("c_name")
    header = F.when(k % 5 == 0, n).when(k % 5 == 1, F.concat(F.lit(" : "), n)).otherwise(F.concat(F.lit(" X-"), n, F.lit(" :  a:"), n, F.lit(" ")))
    pair = F.when(k % 4 == 0, n).otherwise(F.concat(F.lit(" k"), (k % 3).cast("string"), F.lit(" = v="), n))
    c = read(spark, d, "customer").select("c_custkey", web.split_once(header, ":").alias("h"), web.split_once(pair, "=", trim_value=False).alias("q"))
    kinds = F.array_join(F.array_compact(F.array(F.when(F.col("h").isNotNull(), "header"), F.when(F.col("q").isNotNull(), "query"))), ",")
    return c.select("c_custkey", F.col("h.name").alias("header"), F.col("h.value").alias("header_value"), F.col("q.name").alias("pair"), F.col("q.value").alias("pair_value"), kinds.alias("kinds"))


def freshness(spark, d):
    """Pages by host as fetched tiles: newest Last-Modified of those that tell one, and whether to warn that none does."""
    k = F.col("page_id")
    told = F.when(k % 4 == 0, None).when(k % 4 == 1, "yesterday").otherwise(F.date_format(F.timestamp_seconds(1_600_000_000 + k * 86_413), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    p = read(spark, d, "pages").select(web.host(F.col("url")).alias("host"), (k % 11 != 5).alias("ok"), web.http_date(told).alias("at"))
    p = p.where("ok").groupBy("host").agg(F.count("*").alias("fetched"), F.coalesce(F.max("at"), F.lit(0)).cast("bigint").alias("newest"))
    return p.withColumn("warn", (F.col("fetched") > 0) & (F.col("newest") == 0))


def odd_dates(spark, d):
    """Dates as servers write them: days that a month hasn't roll over, a second may be 60, what follows is ignored; other months, years and times give none."""
    k = F.col("o_orderkey")
    month = F.get(F.array(*map(F.lit, (*web.MONTHS, "Foo"))), (k % 13).cast("int"))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    text = F.concat(F.lit("Xyz, "), two(1 + k % 32), F.lit(" "), month, F.lit(" "), (1969 + k % 60).cast("string"), F.lit(" "), two(k % 25), F.lit(":"), two(k % 60), F.lit(":"), two(k % 62), F.when(k % 2 == 0, " GMT").otherwise(" UTC and more"))
    return read(spark, d, "orders").select("o_orderkey", web.http_date(text).alias("unix"))


def host_rates(spark, d):
    """Requests a second by host: an override first, if it is a rate at all; then none on loopback, then the policy."""
    k = F.sum("page_id") % 7
    p = read(spark, d, "pages").groupBy(web.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), k.alias("k"))
    rate = F.when(F.col("k") == 0, float("nan")).when(F.col("k") == 1, 0.0).when(F.col("k") == 2, float("inf")).when(F.col("k") == 3, 8.0)
    good = rate.isNotNull() & ~F.isnan(rate) & (rate > 0) & (rate < float("inf"))
    return p.select("host", "pages", F.when(rate.isNotNull() & ~good, "bad_rate").alias("issue"), web.interval_us(F.col("host"), F.when(good, F.floor(1e6 / rate))).cast("bigint").alias("interval_us"))


def tile_fractions(spark, d):
    """Customers' points in fractions of tiles, with the coordinates as a picker rounds them and both ways to whole micro-degrees."""
    c = tiles.points(read(spark, d, "customer"), "c_custkey")
    z, up = F.lit(9), lambda v, k: F.floor(v * k + 0.5) / k
    return c.select("id", F.round(geo.tile_x_frac(F.col("lon"), z), 6).alias("fx"), F.round(geo.tile_y_frac(F.col("lat"), z), 6).alias("fy"), up(F.col("lon"), 1e6).alias("lon6"), up(F.col("lat"), 1e5).alias("lat5"), geo.micro(F.col("lon") + 5e-7).alias("even"), geo.micro(F.col("lon") + 2.5e-7, "away").alias("away"))


def corner_boxes(spark, d):
    """Boxes from two dragged corners, their rings as text, and whether they leave the grid's world."""
    a, b = tiles.points(read(spark, d, "supplier"), "s_suppkey"), F.col("id")
    c = a.withColumns({"lon2": ((b * 7919) % 360 - 180).cast("double"), "lat2": ((b * 104729) % 178 - 89).cast("double")})
    box = [F.least("lon", "lon2"), F.least("lat", "lat2"), F.greatest("lon", "lon2"), F.greatest("lat", "lat2")]
    micro = [geo.micro(v).alias(k) for v, k in zip(box, ("west", "south", "east", "north"), strict=True)]
    c = c.select("id", *micro)
    at = lambda x, y: F.concat_ws(" ", geo.micro_text(F.col(x)), geo.micro_text(F.col(y)))
    ring = F.concat_ws(", ", at("west", "south"), at("east", "south"), at("east", "north"), at("west", "north"), at("west", "south"))
    w = geo.WORLD_MICRO
    return c.select("id", ring.alias("ring"), ((F.col("south") < w[1]) | (F.col("north") > w[3])).alias("beyond"))


def dim_texts(spark, d):
    """Parts' sizes as tile sizes: powers of two from 32 to 1024 only."""
    size = F.when(F.col("p_partkey") % 3 == 0, F.expr("shiftleft(1L, cast(p_size % 13 as int))")).otherwise(F.col("p_size") * 16).cast("int")
    return read(spark, d, "part").groupBy(size.alias("dim")).agg(F.count("*").alias("n")).withColumn("valid", geo.tile_dim_valid(F.col("dim")))


def _ratio(z):
    return F.coalesce(*(F.when(z == k, v) for k, v in RATIOS.items()), F.lit(OTHER_RATIO))


def region_sizes(spark, d):
    """Each region's pack over zooms 8 to 12 at the measured ratios, raw, and how long a device takes to verify it."""
    e = tiles.extents(_regions(spark, d), 8, 12).withColumn("n", F.col("nx") * F.col("ny"))
    e = e.groupBy("region").agg(F.sum("n").cast("bigint").alias("tiles"), F.sum(F.col("n") * RAW * _ratio(F.col("z"))).alias("body"))
    size = 292 + 20 * F.col("tiles") + F.col("body") + 4
    return e.select("region", "tiles", F.round(size, 3).alias("bytes"), (F.col("tiles") * RAW).alias("raw"), F.round(size / VERIFY, 6).alias("verify_s"))


def planet_archive(spark, d):
    """Tiles of the whole grid by zoom with the share that points of orders fill, and bytes of an archive of its land, with totals up to each zoom. Seventeen rows meet in the window."""
    seen = tiles.pyramid(tiles.density(tiles.assign(tiles.points(read(spark, d, "orders"), "o_orderkey").withColumn("z", F.lit(16)))), 0).groupBy("z").agg(F.count("*").alias("filled"))
    whole = F.pow(F.lit(4.0), F.col("z"))
    land = F.when(F.col("z") < 8, whole).otherwise(whole * LAND)
    s = seen.select("z", "filled", land.alias("tiles"), (land * RAW * _ratio(F.col("z"))).alias("bytes"))
    return s.select("z", "filled", F.round("tiles", 3).alias("tiles"), F.round(F.col("bytes") / 1e6, 3).alias("mb"), F.round(F.sum("bytes").over(Window.orderBy("z")) / 1e6, 3).alias("mb_so_far"))


def human_durations(spark, d):
    """Regions' builds as people read them: size, time, verdict and why."""
    p = estimate.plan(tiles.extents(_regions(spark, d), 8, 12), "region")
    return p.select("region", estimate.human_bytes(F.col("pack")).alias("size"), estimate.human_duration(F.col("seconds")).alias("time"), "verdict", estimate.reason(F.col("verdict"), F.col("block_n")).alias("reason"))


def learned_sizes(spark, d):
    """Events as finished builds by user: the packed share learned from those that were compressed and long enough."""
    e = read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, "none").otherwise("rle8").alias("how"), "value", (F.col("event_id") % 97 / 100.0).alias("share"))
    return estimate.learned_rate(e, "user_id", "event_id", "share", (F.col("value") >= 10) & (F.col("how") != "none"), start=estimate.PACKED, floor=0.0)


def run_rates(spark, d):
    """Events as passes over levels: tiles a second and coded share by pass and level, and over a pass."""
    e = read(spark, d, "events").select(F.col("event_type").alias("pass"), (F.col("user_id") % 5).alias("level"), (F.col("event_id") % 50 + 1).alias("tiles"), F.col("value").alias("ms"), (F.col("event_id") % 900).alias("coded"))
    s = e.groupingSets([[F.col("pass"), F.col("level")], [F.col("pass")]], "pass", "level").agg(F.sum("tiles").alias("tiles"), F.sum("ms").alias("ms"), F.sum("coded").alias("coded"))
    return s.select("pass", "level", "tiles", F.round(F.when(F.col("ms") > 0, F.col("tiles") / (F.col("ms") / 1000)), 4).alias("tiles_a_second"), F.round(F.col("coded") * 100.0 / (F.col("tiles") * 1024), 6).alias("percent"))


def _sources(spark, d) -> DataFrame:
    """Suppliers as sources of a nation's pack: zooms, axis, kind, tiles and a notice each."""
    k = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, ("url", "dir", "mbtiles"))), (k % 3).cast("int"))
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("pack"), k.alias("layer"), (k % 4).alias("zmin"), (k % 4 + k % 3).alias("zmax"), F.when(k % 5 < 2, "tms").otherwise("xyz").alias("axis"), kind.alias("kind"), (k % 6).alias("identity"), (k % 100).alias("tiles"), F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("(c) "), F.col("s_name"))).alias("notice"))


def zoom_layers(spark, d):
    """Which of a pack's sources give each zoom, in layer order, and which lies on top (extension: several sources a pack)."""
    s = _sources(spark, d).withColumn("z", F.explode(F.sequence("zmin", "zmax")))
    return s.groupBy("pack", "z").agg(F.count("*").alias("sources"), F.max("layer").alias("top"), F.sum("tiles").alias("tiles"))


def axis_majority(spark, d):
    """A pack's axis: that of its source with most tiles, xyz on a tie; and a row of each source, turned over where its own axis is the other (extension)."""
    s = _sources(spark, d)
    most = lambda a: F.coalesce(F.max(F.when(F.col("axis") == a, F.col("tiles"))), F.lit(-1))
    own = s.groupBy("pack").agg(F.when(most("tms") > most("xyz"), "tms").otherwise("xyz").alias("chosen"))
    j = s.join(own, "pack")  # a row a pack
    y = F.when(F.col("axis") == F.col("chosen"), F.col("tiles") % 2).otherwise(geo.flip_row(F.col("tiles") % 2, F.lit(3)))
    return j.select("pack", "layer", "chosen", y.cast("bigint").alias("y"))


def source_conflicts(spark, d):
    """Sources named twice in a pack, and each pack's notices, one a source, in layer order (extension)."""
    s = _sources(spark, d)
    twice = s.groupBy("pack", "kind", "identity", "zmin", "zmax").agg(F.count("*").alias("n")).where("n > 1").groupBy("pack").agg(F.count("*").alias("duplicates"))
    notes = s.groupBy("pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("notice").isNotNull(), F.struct("layer", "notice")))), lambda x: x["notice"]), "\n").alias("notice"))
    return notes.join(twice, "pack", "left").select("pack", F.sha2("notice", 256).alias("notice_sha256"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


def style_layers(spark, d):
    """Parts as features through the style's rules: every layer whose kinds match and whose zoom is reached, lines only where they are asked for, in the order they are painted."""
    kinds = [k for _, ks, _ in STYLE for k in ks] + ["other"]
    k = F.col("p_partkey")
    f = read(spark, d, "part").select(F.when(k % 10 == 0, None).otherwise(F.get(F.array(*map(F.lit, kinds)), (k % len(kinds)).cast("int"))).alias("kind"), (k % 3 == 0).alias("line"), (10 + F.col("p_size") % 5).alias("z"))
    match = lambda ks: F.coalesce(F.col("kind").isin(*ks), F.lit(False))
    rows = [F.when(match(ks) & (F.col("line") if name in ("major", "minor") else F.lit(True)), F.struct(F.lit(i).alias("place"), F.lit(name).alias("layer"), F.lit(c).alias("colour"))) for i, (name, ks, c) in enumerate(STYLE)]
    rest = F.when(~match(STYLE[0][1]) & (F.col("z") >= 12), F.struct(F.lit(len(STYLE)).alias("place"), F.lit("rest").alias("layer"), F.lit("#D7D7D7").alias("colour")))
    return f.select(F.explode(F.array_compact(F.array(*rows, rest))).alias("l")).groupBy("l.place", "l.layer", "l.colour").agg(F.count("*").alias("n"))


def region_algebra(spark, d):
    """Tiles at zoom 10 of each nation's box, with those of the next nation's box added and taken away (extension): counts of the union, the overlap and the rest."""
    t = tiles.enumerate_tiles(tiles.extents(_regions(spark, d), 10, 10)).select("region", "x", "y")
    other = t.select((F.col("region") - 1).alias("region"), "x", "y")
    both = t.withColumn("own", F.lit(1)).unionByName(other.withColumn("own", F.lit(0))).groupBy("region", "x", "y").agg(F.max("own").alias("a"), F.min("own").alias("b"))
    return both.groupBy("region").agg(F.count("*").alias("either"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("both"), F.count_if(F.col("b") == 1).alias("only_own"))


def corner_affine(spark, d):
    """Parts as images pinned by their four corners: the six coefficients from pixels to degrees by least squares, which for the corners of a rectangle is a closed form (extension)."""
    k = F.col("p_partkey")
    w, h = (64 + F.col("p_size")).cast("double"), (32 + k % 50).cast("double")
    lon = [(k % 300 - 150).cast("double") + v for v in (F.lit(0.0), F.lit(2.0), F.lit(2.0) + (k % 7) / 10.0, F.lit(0.0) - (k % 3) / 10.0)]
    lat = [(k % 100 - 50).cast("double") - v for v in (F.lit(0.0), (k % 4) / 10.0, F.lit(1.5), F.lit(1.5) + (k % 5) / 10.0)]
    # Corners from the north west, clockwise: an edge's slope is the mean of the two sides that run along it.
    along = lambda v: ((v[1] - v[0]) + (v[2] - v[3])) / (2 * w)
    down = lambda v: ((v[3] - v[0]) + (v[2] - v[1])) / (2 * h)
    start = lambda v: (v[0] + v[1] + v[2] + v[3]) / 4 - along(v) * w / 2 - down(v) * h / 2
    return read(spark, d, "part").select("p_partkey", *((F.round(f(v), 9) + 0.0).alias(f"{name}_{axis}") for axis, v in (("lon", lon), ("lat", lat)) for name, f in (("start", start), ("along", along), ("down", down))))


def build_settings(spark, d):
    """Customers' builds: flags over a file's settings, flags that a file forbids, and styles given to sources that aren't drawn (extension): what holds, by issue."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select((k % 3 == 0).alias("file"), F.when(k % 4 == 0, k % 20).alias("zoom_flag"), F.when(k % 3 == 0, F.lit(9)).alias("zoom_file"), (k % 5 == 0).alias("source_flag"), (k % 7 == 0).alias("style"), F.get(F.array(*map(F.lit, ("url", "pbf", "style", "mbtiles"))), (k % 4).cast("int")).alias("kind"))
    issue = F.when(F.col("file") & F.col("source_flag"), "conflict").when(F.col("style") & ~F.col("kind").isin("pbf", "style"), "style_on_pixels")
    return c.groupBy(issue.alias("issue"), F.coalesce("zoom_flag", "zoom_file", F.lit(12)).alias("zoom")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (source_router, synthetic_tiles, auth_parts, freshness, odd_dates, host_rates, tile_fractions, corner_boxes, dim_texts, region_sizes, planet_archive, human_durations, learned_sizes, run_rates, zoom_layers, axis_majority, source_conflicts, style_layers, region_algebra, corner_affine, build_settings)}


def _points(key: str, table: str) -> str:
    return f"SELECT {key} AS id, ((({key} * {tiles.LON_STEP}) % 360000000) - 180000000) / 1e6::DOUBLE AS lon, ((({key} * {tiles.LAT_STEP}) % 170000000) - 85000000) / 1e6::DOUBLE AS lat FROM {table}"


def _ratio_sql(z: str) -> str:
    return f"(CASE {z} {' '.join(f'WHEN {k} THEN {v}::DOUBLE' for k, v in RATIOS.items())} ELSE {OTHER_RATIO}::DOUBLE END)"


def _micro_sql(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || (abs({v}) // 1000000) || '.' || lpad(CAST(abs({v}) % 1000000 AS VARCHAR), 6, '0'))"


_WEST, _SOUTH, _EAST, _NORTH = (_micro_sql(c) for c in ("west", "south", "east", "north"))
_KINDS = [k for _, ks, _ in STYLE for k in ks] + ["other"]
_IN = lambda ks: "(" + ", ".join(f"'{k}'" for k in ks) + ")"
_SRC = """SELECT s_nationkey AS pack, s_suppkey AS layer, s_suppkey % 4 AS zmin, s_suppkey % 4 + s_suppkey % 3 AS zmax, CASE WHEN s_suppkey % 5 < 2 THEN 'tms' ELSE 'xyz' END AS axis, ['url', 'dir', 'mbtiles'][s_suppkey % 3 + 1] AS kind,
  s_suppkey % 6 AS identity, s_suppkey % 100 AS tiles, CASE WHEN s_suppkey % 4 <> 0 THEN '(c) ' || s_name END AS notice FROM supplier"""
SQL = {
    "source_router": "SELECT CASE page_id % 7 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' ELSE CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'url' WHEN url = 'synthetic' THEN 'synthetic' ELSE 'unknown' END END AS kind, count(*) AS n FROM pages GROUP BY 1",
    "synthetic_tiles": "SELECT s_suppkey AS k, CAST(t AS INTEGER) AS seq, CAST(t % 4 AS INTEGER) AS x, CAST(t // 4 AS INTEGER) AS y, sha256('2/' || (t % 4) || '/' || (t // 4) || '/' || s_suppkey) AS sha256 FROM supplier, (SELECT unnest(range(16)) AS t)",
    "auth_parts": """SELECT c_custkey, CASE WHEN c_custkey % 5 > 1 THEN 'X-' || c_name END AS header, CASE WHEN c_custkey % 5 > 1 THEN 'a:' || c_name END AS header_value, CASE WHEN c_custkey % 4 <> 0 THEN 'k' || (c_custkey % 3) END AS pair, CASE WHEN c_custkey % 4 <> 0 THEN ' v=' || c_name END AS pair_value,
      concat_ws(',', CASE WHEN c_custkey % 5 > 1 THEN 'header' END, CASE WHEN c_custkey % 4 <> 0 THEN 'query' END) AS kinds FROM customer""",
    "freshness": f"""SELECT host, count(*) AS fetched, coalesce(max(t), 0) AS newest, coalesce(max(t), 0) = 0 AS warn FROM (SELECT {_HOST} AS host, CASE WHEN page_id % 4 > 1 THEN 1600000000 + page_id * 86413 END AS t FROM pages WHERE page_id % 11 <> 5) GROUP BY host""",
    "odd_dates": """SELECT o_orderkey, CASE WHEN k % 32 < 31 AND k % 13 < 12 AND k % 60 > 0 AND k % 25 < 24 AND k % 62 < 61 THEN CAST(epoch(make_date(1969 + k % 60, 1 + k % 13, 1)) AS BIGINT) + k % 32 * 86400 + k % 25 * 3600 + k % 60 * 60 + k % 62 END AS unix FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    "host_rates": f"""SELECT host, pages, CASE WHEN k < 3 THEN 'bad_rate' END AS issue, CASE WHEN k = 3 THEN 125000 WHEN host = 'localhost' OR host LIKE '%.localhost' THEN 0 WHEN host = 'openstreetmap.org' OR host LIKE '%.openstreetmap.org' THEN 500000 ELSE 250000 END AS interval_us
      FROM (SELECT {_HOST} AS host, count(*) AS pages, sum(page_id) % 7 AS k FROM pages GROUP BY 1)""",
    "tile_fractions": f"""SELECT id, round((lon + 180) / 360 * 512, 6) AS fx, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512, 6) AS fy, floor(lon * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS lon6, floor(lat * 1e5::DOUBLE + 0.5::DOUBLE) / 1e5::DOUBLE AS lat5,
      CAST(round_even((lon + 5e-7::DOUBLE) * 1e6::DOUBLE, 0) AS INTEGER) AS even, CAST(round((lon + 2.5e-7::DOUBLE) * 1e6::DOUBLE) AS INTEGER) AS away FROM ({_points('c_custkey', 'customer')})""",
    "corner_boxes": f"""WITH c AS (SELECT *, CAST((id * 7919) % 360 - 180 AS DOUBLE) AS lon2, CAST((id * 104729) % 178 - 89 AS DOUBLE) AS lat2 FROM ({_points('s_suppkey', 'supplier')})),
      m AS (SELECT id, CAST(round_even(least(lon, lon2) * 1e6::DOUBLE, 0) AS BIGINT) AS west, CAST(round_even(least(lat, lat2) * 1e6::DOUBLE, 0) AS BIGINT) AS south, CAST(round_even(greatest(lon, lon2) * 1e6::DOUBLE, 0) AS BIGINT) AS east, CAST(round_even(greatest(lat, lat2) * 1e6::DOUBLE, 0) AS BIGINT) AS north FROM c)
      SELECT id, {_WEST} || ' ' || {_SOUTH} || ', ' || {_EAST} || ' ' || {_SOUTH} || ', ' || {_EAST} || ' ' || {_NORTH} || ', ' || {_WEST} || ' ' || {_NORTH} || ', ' || {_WEST} || ' ' || {_SOUTH} AS ring, south < {geo.WORLD_MICRO[1]} OR north > {geo.WORLD_MICRO[3]} AS beyond FROM m""",
    "dim_texts": "SELECT dim, count(*) AS n, dim IN (32, 64, 128, 256, 512, 1024) AS valid FROM (SELECT CAST(CASE WHEN p_partkey % 3 = 0 THEN pow(2, p_size % 13) ELSE p_size * 16 END AS INTEGER) AS dim FROM part) GROUP BY dim",
    "region_sizes": f"""WITH e AS (SELECT region, CAST(sum(nx * ny) AS BIGINT) AS tiles, sum(nx * ny * {RAW} * {_ratio_sql('z')}) AS body FROM ({_EXTENTS}) GROUP BY region)
      SELECT region, tiles, round(296 + 20 * tiles + body, 3) AS bytes, tiles * {RAW} AS raw, round((296 + 20 * tiles + body) / {VERIFY}::DOUBLE, 6) AS verify_s FROM e""",
    "planet_archive": f"""WITH p AS (SELECT {_x('lon', '16')} AS x, {_y('lat', '16')} AS y FROM ({_points('o_orderkey', 'orders')})), f AS (SELECT z, count(DISTINCT (x >> (16 - z)) * 65536 + (y >> (16 - z))) AS filled FROM p, (SELECT CAST(unnest(range(17)) AS INTEGER) AS z) GROUP BY z),
      t AS (SELECT z, filled, pow(4.0::DOUBLE, z) * CASE WHEN z < 8 THEN 1::DOUBLE ELSE {LAND}::DOUBLE END AS tiles FROM f), b AS (SELECT *, tiles * {RAW} * {_ratio_sql('z')} AS bytes FROM t)
      SELECT z, filled, round(tiles, 3) AS tiles, round(bytes / 1e6::DOUBLE, 3) AS mb, round(sum(bytes) OVER (ORDER BY z) / 1e6::DOUBLE, 3) AS mb_so_far FROM b""",
    "learned_sizes": """SELECT user_id, round(greatest(0.0::DOUBLE, list_reduce(list_prepend(0.055::DOUBLE, list(event_id % 97 / 100.0::DOUBLE ORDER BY event_id)), lambda a, v: (a + v) / 2)), 6) AS rate FROM events WHERE value >= 10 AND event_id % 4 <> 0 GROUP BY user_id""",
    "run_rates": """SELECT event_type AS pass, user_id % 5 AS level, CAST(sum(event_id % 50 + 1) AS BIGINT) AS tiles, round(CASE WHEN sum(value) > 0 THEN sum(event_id % 50 + 1) / (sum(value) / 1000) END, 4) AS tiles_a_second, round(sum(event_id % 900) * 100.0::DOUBLE / (sum(event_id % 50 + 1) * 1024), 6) AS percent
      FROM events GROUP BY GROUPING SETS ((event_type, user_id % 5), (event_type))""",
    "zoom_layers": f"SELECT pack, z, count(*) AS sources, max(layer) AS top, CAST(sum(tiles) AS BIGINT) AS tiles FROM (SELECT *, unnest(generate_series(zmin, zmax)) AS z FROM ({_SRC})) GROUP BY pack, z",
    "axis_majority": f"""WITH s AS ({_SRC}), m AS (SELECT pack, CASE WHEN coalesce(max(tiles) FILTER (axis = 'tms'), -1) > coalesce(max(tiles) FILTER (axis = 'xyz'), -1) THEN 'tms' ELSE 'xyz' END AS chosen FROM s GROUP BY pack)
      SELECT pack, layer, chosen, CASE WHEN axis = chosen THEN tiles % 2 ELSE 7 - tiles % 2 END AS y FROM s JOIN m USING (pack)""",
    "source_conflicts": f"""WITH s AS ({_SRC}), t AS (SELECT pack, count(*) AS n FROM (SELECT pack FROM s GROUP BY pack, kind, identity, zmin, zmax HAVING count(*) > 1) GROUP BY pack)
      SELECT pack, sha256(coalesce(string_agg(notice, chr(10) ORDER BY layer), '')) AS notice_sha256, coalesce(any_value(t.n), 0) AS duplicates FROM s LEFT JOIN t USING (pack) GROUP BY pack""",
    "style_layers": "WITH f AS (SELECT CASE WHEN p_partkey % 10 <> 0 THEN [" + ", ".join(f"'{k}'" for k in _KINDS) + f"][p_partkey % {len(_KINDS)} + 1] END AS kind, p_partkey % 3 = 0 AS line, 10 + p_size % 5 AS z FROM part), l AS ("
    + " UNION ALL ".join(f"SELECT {i} AS place, '{n}' AS layer, '{c}' AS colour FROM f WHERE kind IN {_IN(ks)}" + (" AND line" if n in ("major", "minor") else "") for i, (n, ks, c) in enumerate(STYLE))
    + f" UNION ALL SELECT {len(STYLE)}, 'rest', '#D7D7D7' FROM f WHERE (kind IS NULL OR kind NOT IN {_IN(STYLE[0][1])}) AND z >= 12) SELECT CAST(place AS INTEGER) AS place, layer, colour, count(*) AS n FROM l GROUP BY ALL",
}
_SIZE = "CASE WHEN pack < 1024 THEN pack || ' B' WHEN pack < 1048576 THEN CAST((pack * 2 + 1024) // 2048 AS VARCHAR) || ' KB' WHEN pack < 10485760 THEN CAST((pack * 20 + 1048576) // 2097152 // 10 AS VARCHAR) || '.' || CAST((pack * 20 + 1048576) // 2097152 % 10 AS VARCHAR) || ' MB' WHEN pack < 1073741824 THEN CAST((pack * 2 + 1048576) // 2097152 AS VARCHAR) || ' MB' ELSE CAST((pack * 20 + 1073741824) // 2147483648 // 10 AS VARCHAR) || '.' || CAST((pack * 20 + 1073741824) // 2147483648 % 10 AS VARCHAR) || ' GB' END"
_WHY = "CASE verdict WHEN 'empty' THEN 'choose an area' WHEN 'refuse_total' THEN 'too much memory at once' WHEN 'refuse_column' THEN 'too tall' WHEN 'refuse_pack' THEN 'pack too large' WHEN 'heavy' THEN 'large build' END"
SQL["human_durations"] = f"""SELECT region, {_SIZE} AS size, CASE WHEN seconds < 1 THEN '<1 s' WHEN seconds < 90 THEN CAST(floor(seconds + 0.5) AS BIGINT) || ' s' WHEN seconds < 3600 THEN CAST(floor(seconds / 60 + 0.5) AS BIGINT) || ' min'
  ELSE (CAST(floor(seconds / 360 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(seconds / 360 + 0.5) AS BIGINT) % 10) || ' h' END AS time, verdict,
  concat_ws('; ', {_WHY}, CASE WHEN verdict IN ('ok', 'heavy') AND block_n < 16 THEN 'blocks of ' || block_n END) AS reason FROM ({policy_queries.SQL["estimate_plan"]})"""
SQL["region_algebra"] = f"""WITH t AS (SELECT region, unnest(generate_series(x0, x1)) AS x, y FROM (SELECT *, unnest(generate_series(y0, y1)) AS y FROM ({_EXTENTS}) WHERE z = 10)), o AS (SELECT region - 1 AS region, x, y FROM t),
  j AS (SELECT coalesce(t.region, o.region) AS region, t.x AS tx, o.x AS ox FROM t FULL JOIN o ON t.region = o.region AND t.x = o.x AND t.y = o.y)
  SELECT region, count(*) AS either, count(*) FILTER (tx IS NOT NULL AND ox IS NOT NULL) AS both, count(*) FILTER (ox IS NULL) AS only_own FROM j GROUP BY region"""
SQL["corner_affine"] = """WITH c AS (SELECT p_partkey, CAST(64 + p_size AS DOUBLE) AS w, CAST(32 + p_partkey % 50 AS DOUBLE) AS h, CAST(p_partkey % 300 - 150 AS DOUBLE) AS x, CAST(p_partkey % 100 - 50 AS DOUBLE) AS y, p_partkey AS k FROM part),
  v AS (SELECT *, x AS x0, x + 2 AS x1, x + (2.0::DOUBLE + k % 7 / 10.0::DOUBLE) AS x2, x + (0.0::DOUBLE - k % 3 / 10.0::DOUBLE) AS x3, y AS y0, y - k % 4 / 10.0::DOUBLE AS y1, y - 1.5::DOUBLE AS y2, y - (1.5::DOUBLE + k % 5 / 10.0::DOUBLE) AS y3 FROM c),
  s AS (SELECT *, ((x1 - x0) + (x2 - x3)) / (2 * w) AS ax, ((x3 - x0) + (x2 - x1)) / (2 * h) AS dx, ((y1 - y0) + (y2 - y3)) / (2 * w) AS ay, ((y3 - y0) + (y2 - y1)) / (2 * h) AS dy FROM v)
  SELECT p_partkey, round((x0 + x1 + x2 + x3) / 4 - ax * w / 2 - dx * h / 2, 9) + 0 AS start_lon, round(ax, 9) + 0 AS along_lon, round(dx, 9) + 0 AS down_lon, round((y0 + y1 + y2 + y3) / 4 - ay * w / 2 - dy * h / 2, 9) + 0 AS start_lat, round(ay, 9) + 0 AS along_lat, round(dy, 9) + 0 AS down_lat FROM s"""
SQL["build_settings"] = """SELECT CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'conflict' WHEN c_custkey % 7 = 0 AND c_custkey % 4 NOT IN (1, 2) THEN 'style_on_pixels' END AS issue,
  CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 20 WHEN c_custkey % 3 = 0 THEN 9 ELSE 12 END AS zoom, count(*) AS n FROM customer GROUP BY ALL"""
