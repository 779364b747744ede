"""Queries over files and byte streams in their formats, polygons as tiles, and style rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import chunked, codec, style
from gridloom.operators import polygons
from gridloom.plans.tile_queries import read
from gridloom.sources import pack_source, pack_writer, packs, pmtiles
from gridloom.sources.ranged import scratch

CHUNK, RANGE = 997, 1 << 16


def _tiles(spark, d, group: str) -> DataFrame:
    """Documents as tiles of zoom 20, grouped by source."""
    k = F.col("doc_id")
    return read(spark, d, "documents").where("text is not null and text <> '' and doc_id is not null").select(F.col("source").alias(group), F.lit(20).alias("z"), (k * 7919 % (1 << 20)).alias("x"), k.alias("y"), F.lit(0).alias("compression"), F.encode("text", "UTF-8").alias("body"))


def pack_scan(spark, d):
    """Documents in pack files by source, written by the tasks that build them, and of these the tiles of the map's western half, read by the format's own filters."""
    folder = scratch(spark, "packs")
    made = packs.build_packs(_tiles(spark, d, "pack_id"), most_bytes=4 << 20)

    def put(frames):
        for t in frames:
            for pack_id, part, data in zip(t["pack_id"], t["part"], t["pack"], strict=True):
                packs.write_pack_file(bytes(data), f"{folder}/{'none' if pack_id is None else pack_id}-{part}.pack")
            yield t[["part"]].rename(columns={"part": "n"})

    made.mapInPandas(put, "n int").agg(F.count("*")).collect()
    pack_source.register(spark)
    t = spark.read.format("tilepack").option("bodies", "true").load(folder).where((F.col("z") == 20) & (F.col("x") < 1 << 19))
    return t.select(F.regexp_extract("path", r"([^/]+)-\d+\.pack$", 1).alias("pack_id"), "x", "y", "length", F.sha2("body", 256).alias("sha256"))


def pmtiles_roundtrip(spark, d):
    """Documents as archives by source, and what their directories list: tile ids along the curve, and lengths."""
    made = pmtiles.build_archives(_tiles(spark, d, "archive_id").drop("compression"), most_bytes=4 << 20, leaf=64)
    made = made.withColumn("k", F.concat_ws("/", F.coalesce("archive_id", F.lit("none")), F.col("part").cast("string")))
    t = pmtiles.read_tiles(made, "k", "archive")
    return t.select(F.regexp_replace("k", r"/\d+$", "").alias("archive_id"), "x", "y", F.col("id").alias("tile_id"), "length", "issue")


def pack_ranges(spark, d):
    """Ranges of bodies of documents' packs by source, as a writer of many tasks makes them: where they start, their bytes and hash."""
    r = pack_writer.pack_ranges(_tiles(spark, d, "pack_id"), range_bytes=RANGE).where("kind = 'bodies'")
    return r.select("pack_id", "start", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"))


def chunked_rle(spark, d):
    """Documents run-length coded, cut in chunks anywhere, decoded chunk by chunk and put together."""
    t = read(spark, d, "documents").where("text is not null and doc_id is not null").select(F.col("doc_id").alias("stream"), codec.rle8_encode(F.encode("text", "UTF-8")).alias("data"))
    at = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / CHUNK).cast("int")))
    c = t.select("stream", "data", at.alias("seq")).select("stream", "seq", F.substring("data", F.col("seq") * CHUNK + 1, F.lit(CHUNK)).alias("data"))
    got = chunked.decode_chunks(c).withColumn("h", F.struct("seq", F.hex("body").alias("h")))
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda x: x["h"]), ""))
    return got.groupBy("stream").agg(F.sha2(whole, 256).alias("sha256"), F.sum(F.octet_length("body")).alias("bytes"), F.max_by("finished", "seq").alias("finished")).withColumnRenamed("stream", "doc_id")


ZOOM = 6


def _outline(spark, d) -> DataFrame:
    """Customers as vertices of rings, two for each nation: odd places of the map's square, as centres of tiles are even."""
    k = F.col("c_custkey")
    at = lambda a, b: (k * a + F.col("c_nationkey") * b) % (1 << 23) * 2 + 1
    v = read(spark, d, "customer").where(k % 5 == 0).select(F.col("c_nationkey").alias("region"), (k % 2).alias("ring"), k.alias("i"), at(7_368_787, 104_729).alias("x"), at(5_754_853, 1_299_709).alias("y"))
    return polygons.edges(v, "region", ["ring"], "i")


def polygon_cover(spark, d):
    """Tiles of zoom 6 in nations' polygons, by refinement: a tile that no edge crosses is told whole."""
    return polygons.at_zoom(polygons.cover(_outline(spark, d), ZOOM), ZOOM)


def polygon_regions(spark, d):
    """Tiles of zoom 6 in the polygons of even nations and none of odd ones, by row of tiles."""
    covered = polygons.at_zoom(polygons.cover(_outline(spark, d), ZOOM), ZOOM)
    parts = covered.select(F.lit(ZOOM).alias("z"), "x", "y", F.when(F.col("region") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return polygons.combined(parts).groupBy("y").agg(F.count("*").alias("tiles"), F.min("x").alias("west"), F.max("x").alias("east"))


#: A style as text: matches with several labels and a default, nested conditions, zoom bounds, steps and interpolated widths.
STYLE = json.dumps({"layers": [
    {"id": "ground", "type": "background"},
    {"id": "metal", "type": "fill", "source-layer": "part", "filter": ["match", ["get", "metal"], ["TIN", "NICKEL"], True, False], "paint": {"width": ["match", ["get", "class"], "SMALL", 1, ["LARGE", "ECONOMY"], 2, 3]}},
    {"id": "polished", "type": "line", "source-layer": "part", "minzoom": 8, "filter": ["all", ["==", ["get", "finish"], "POLISHED"], ["any", [">=", ["get", "size"], 25], ["!", ["has", "brand"]]]], "paint": {"width": ["step", ["zoom"], 1, 10, 2.5, 14, 4]}},
    {"id": "labels", "type": "symbol", "source-layer": "part", "maxzoom": 15, "filter": ["case", ["in", ["get", "class"], ["literal", ["PROMO", "STANDARD"]]], ["<", ["get", "size"], 30], ["==", ["geometry-type"], "Point"]], "paint": {"width": ["interpolate", ["linear"], ["zoom"], 5, 1, 13, 9]}},
]})


def style_features(spark, d):
    """Parts as map features through a style read as JSON: which layers draw each, in order, and how wide."""
    k, words = F.col("p_partkey"), F.split("p_type", " ")
    of = lambda **c: F.map_from_arrays(F.array(*map(F.lit, c)), F.array(*(v.cast("string") for v in c.values())))
    props = of(**{"class": F.get(words, 0), "finish": F.get(words, 1), "metal": F.get(words, 2), "size": F.when(k % 7 > 0, F.col("p_size")), "brand": F.when(k % 3 > 0, F.col("p_brand"))})
    t = read(spark, d, "part").select("p_partkey", F.when(k % 11 > 0, "part").alias("source_layer"), (5 + k % 12).cast("double").alias("zoom"), F.get(F.array(*map(F.lit, ("Point", "LineString", "Polygon"))), (k % 3).cast("int")).alias("geometry"), props.alias("properties"))
    return style.drawn(t, STYLE, paint="width").select("p_partkey", "place", "layer", F.round(F.col("paint").cast("double"), 6).alias("width"))


QUERIES = {f.__name__: f for f in (pack_scan, pmtiles_roundtrip, pack_ranges, chunked_rle, polygon_cover, polygon_regions, style_features)}


def _curve_sql(z: int) -> str:
    """Ids along the curve, a level a step, of table t (x, y)."""
    steps = [f"h{z} AS (SELECT *, x AS hx, y AS hy, {(4**z - 1) // 3}::BIGINT AS tile_id FROM t)"]
    for k in range(z - 1, -1, -1):
        s = 1 << k
        rx, ry = f"((hx >> {k}) & 1)", f"((hy >> {k}) & 1)"
        lx, ly = f"(hx & {s - 1})", f"(hy & {s - 1})"
        fx, fy = (f"CASE WHEN {ry} = 0 AND {rx} = 1 THEN {s - 1} - {v} ELSE {v} END" for v in (lx, ly))
        steps.append(f"h{k} AS (SELECT * REPLACE (CASE WHEN {ry} = 0 THEN {fy} ELSE {fx} END AS hx, CASE WHEN {ry} = 0 THEN {fx} ELSE {fy} END AS hy, tile_id + {s * s}::BIGINT * xor(3 * {rx}, {ry}) AS tile_id) FROM h{k + 1})")
    return ",\n".join(steps)


_T = "t AS (SELECT source, (doc_id * 7919) % 1048576 AS x, doc_id AS y, encode(text) AS body FROM documents WHERE text <> '')"
_EDGES = """v AS (SELECT c_nationkey AS region, c_custkey % 2 AS ring, c_custkey AS i, (c_custkey * 7368787 + c_nationkey * 104729) % 8388608 * 2 + 1 AS x, (c_custkey * 5754853 + c_nationkey * 1299709) % 8388608 * 2 + 1 AS y FROM customer WHERE c_custkey % 5 = 0),
      e AS (SELECT region, coalesce(lag(x) OVER w, last(x) OVER a) AS x1, coalesce(lag(y) OVER w, last(y) OVER a) AS y1, x AS x2, y AS y2 FROM v
        WINDOW w AS (PARTITION BY region, ring ORDER BY i), a AS (PARTITION BY region, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
      g AS (SELECT a.range AS x, b.range AS y, (2 * a.range + 1) * 131072 AS cx, (2 * b.range + 1) * 131072 AS cy FROM range(64) a, range(64) b),
      c AS (SELECT region, g.x, g.y FROM g JOIN e ON (y1 <= cy) <> (y2 <= cy) AND CASE WHEN y2 > y1 THEN (x2 - x1) * (cy - y1) - (cx - x1) * (y2 - y1) > 0 ELSE (x2 - x1) * (cy - y1) - (cx - x1) * (y2 - y1) < 0 END GROUP BY ALL HAVING count(*) % 2 = 1)"""
SQL = {
    "pack_scan": f"WITH {_T} SELECT coalesce(source, 'none') AS pack_id, x, y, octet_length(body) AS length, sha256(body) AS sha256 FROM t WHERE x < 524288",
    "pmtiles_roundtrip": f"WITH {_T}, {_curve_sql(20)}\nSELECT coalesce(source, 'none') AS archive_id, x, y, tile_id, octet_length(body) AS length, CAST(NULL AS VARCHAR) AS issue FROM h0",
    "pack_ranges": f"""WITH {_T}, s AS (SELECT *, (octet_length(body) + 3) // 4 * 4 AS size FROM t),
      p AS (SELECT *, (292 + 20 * count(*) OVER (PARTITION BY source) + 3) // 4 * 4 + coalesce(sum(size) OVER (PARTITION BY source ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s)
      SELECT source AS pack_id, CAST(min(pos) AS BIGINT) AS start, CAST(sum(size) AS BIGINT) AS bytes, sha256(unhex(string_agg(hex(body) || repeat('00', CAST(size - octet_length(body) AS INTEGER)), '' ORDER BY pos))) AS sha256 FROM p GROUP BY source, pos // {RANGE}""",
    "chunked_rle": "SELECT doc_id, sha256(encode(text)) AS sha256, octet_length(encode(text)) AS bytes, true AS finished FROM documents WHERE text IS NOT NULL",
    "polygon_cover": f"WITH {_EDGES} SELECT region, x, y FROM c",
    "polygon_regions": f"WITH {_EDGES} SELECT y, count(*) AS tiles, min(x) AS west, max(x) AS east FROM (SELECT x, y FROM c GROUP BY x, y HAVING min(region % 2) = 0 AND max(region % 2) = 0) GROUP BY y",
    "style_features": """WITH f AS (SELECT p_partkey, p_partkey AS k, (5 + p_partkey % 12)::DOUBLE AS zoom, string_split(p_type, ' ') AS w, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS size FROM part WHERE p_partkey % 11 > 0)
      SELECT p_partkey, 0 AS place, 'metal' AS layer, CASE WHEN w[1] = 'SMALL' THEN 1.0 WHEN w[1] IN ('LARGE', 'ECONOMY') THEN 2.0 ELSE 3.0 END::DOUBLE AS width FROM f WHERE k % 3 = 2 AND w[3] IN ('TIN', 'NICKEL')
      UNION ALL SELECT p_partkey, 1, 'polished', CASE WHEN zoom >= 14 THEN 4 WHEN zoom >= 10 THEN 2.5 ELSE 1 END::DOUBLE FROM f WHERE k % 3 > 0 AND zoom >= 8 AND w[2] = 'POLISHED' AND (coalesce(size >= 25, false) OR k % 3 = 0)
      UNION ALL SELECT p_partkey, 2, 'labels', CASE WHEN zoom <= 5 THEN 1 WHEN zoom >= 13 THEN 9 ELSE zoom - 4 END::DOUBLE FROM f WHERE zoom < 15 AND CASE WHEN w[1] IN ('PROMO', 'STANDARD') THEN coalesce(size < 30, false) ELSE k % 3 = 0 END""",
}
