"""Queries over pack headers, directories, descriptors, names, reports and the rules that gate tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import codec, identity
from gridloom.operators import digests, rules, tiles
from gridloom.plans.pixel_queries import _uuid
from gridloom.plans.tile_queries import _INDEX, _LAYOUT, _index, _le, read

DIM = 16


def _packs(spark, d) -> DataFrame:
    """A row a pack: tiles, zooms, bytes, UUID and the directory of its zooms (24 entries at most)."""
    placed = tiles.layout(_index(spark, d))
    p = placed.groupBy("pack_id").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.max(F.col("offset") + tiles.align4(F.col("length"))).cast("bigint").alias("end"))
    zooms = tiles.zoom_directory(placed).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("z", "first_offset", "n"))).alias("zooms"))
    return tiles.with_group(p, zooms, ["pack_id"]).withColumn("uuid", codec.uuid5_hex(F.col("pack_id")))


def header_bytes(spark, d):
    """Each pack's whole header as hex: front, directory of 24 zooms, and where the extensions start."""
    p, u = _packs(spark, d), lambda v, k: codec.le_hex(F.lit(v) if isinstance(v, int) else v, k)
    slot = lambda z: F.get(F.filter("zooms", lambda s: s["z"] == z), F.lit(0))
    entries = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda z: F.concat(u(F.coalesce(slot(z)["first_offset"], F.lit(0)), 4), u(F.coalesce(slot(z)["n"], F.lit(0)), 4)))
    box = [v % (1 << 32) for v in (-180_000_000, -85_000_000, 180_000_000, 85_000_000)]
    front = [F.hex(F.lit(b"RAWT")), F.lit("01000000"), F.upper(F.replace("uuid", F.lit("-"), F.lit(""))), F.lit("00" * 32), F.lit("01010101"), u(DIM, 2), u(F.col("zmin"), 1), u(F.col("zmax"), 1), *(u(v, 4) for v in box), u(1_700_000_000, 8), u(F.col("n"), 4), u(292, 4)]
    return p.select("pack_id", F.concat(*front, F.array_join(entries, ""), u(F.col("end"), 4)).alias("header"))


def inspect_lines(spark, d):
    """Each pack's report, line by line; zooms without tiles are left out."""
    p = _packs(spark, d)
    line = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    head = F.array(line("size: ", F.col("end") + 4, " bytes"), line("format_version: 1.0"), line("pack_uuid: ", F.col("uuid")), line(f"tile_dim_px: {DIM}"), line("zoom_range: ", F.col("zmin"), "-", F.col("zmax")), line("tile_count: ", F.col("n")))
    zooms = F.transform("zooms", lambda s: line("  zoom ", s["z"], ": ", s["n"], " tile(s)"))
    return p.select("pack_id", F.posexplode(F.concat(head, zooms, F.array(F.lit("extensions: 0 section(s)")))).alias("line_no", "line"))


def directory_check(spark, d):
    """Declared directories, some of them wrong, against the entries: zooms whose count or first offset isn't so."""
    real = tiles.zoom_directory(_index(spark, d))
    wrong = F.octet_length("pack_id") % 3
    told = real.select("pack_id", "z", (F.col("n") + F.when((F.col("z") == 19) & (wrong == 0), 1).otherwise(0)).alias("n"), (F.col("first_offset") + F.when((F.col("z") == 20) & (wrong != 1), 20).otherwise(0)).alias("first_offset"))
    return rules.directory_mismatches(told.where((F.col("z") != 18) | (wrong != 2)), real, "pack_id").groupBy("pack_id", "rule").agg(F.count("*").alias("n"))


def extension_bounds(spark, d):
    """Suppliers as pack headers: which rules the start of the extensions breaks, by rule."""
    k = F.col("s_suppkey")
    h = read(spark, d, "supplier").select((292 + 20 * (k % 9)).alias("index_end"), (300 + k * 7 % 400).alias("ext"), (500 + k % 200).alias("size"))
    bad = {"before_blob": F.col("ext") < tiles.align4(F.col("index_end")), "alignment": F.col("ext") % 4 != 0, "beyond_file": F.col("ext") > F.col("size") - 4}
    found = F.array_compact(F.array(*(F.when(v, F.lit(name)) for name, v in bad.items())))
    return h.select(F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def length_offenders(spark, d):
    """Each pack's first uncompressed tile whose length isn't the tile size's, with what was expected, and how many there are."""
    t = _index(spark, d).withColumns({"compression": F.pmod("y", F.lit(2)), "length": F.when(F.pmod("y", F.lit(3)) == 0, DIM * DIM).otherwise(F.col("length"))})
    t = t.where((F.col("compression") == 0) & (F.col("length") != DIM * DIM))
    return t.groupBy("pack_id").agg(F.min_by(F.struct("y", "length"), F.struct("z", "x", "y")).alias("f"), F.count("*").alias("n")).select("pack_id", "f.y", "f.length", F.lit(DIM * DIM).alias("expected"), "n")


def tile_gates(spark, d):
    """Documents offered as tiles: what a writer says to each, by its first failing rule. Of a key's repeats all but the first are duplicates, one row a key meets another only in its own group."""
    k = F.col("doc_id")
    t = read(spark, d, "documents").select("source", k.alias("seq"), (k % 27).cast("int").alias("z"), (k % 50).alias("x"), (k % 4).alias("y"), F.octet_length("text").alias("length"))
    early = F.when((F.col("z") < 2) | (F.col("z") > 25), "zoom_out_of_range").when(F.col("z") >= 24, "zoom_too_high").when(F.col("length") >= 30_000, "tile_too_large")
    t = t.withColumn("early", early)
    key = ["source", "z", "x", "y"]
    j = tiles.with_group(t, t.where("early is null").groupBy(*key).agg(F.min("seq").alias("first")), key, "left")
    said = F.coalesce("early", F.when(F.col("seq") > F.col("first"), "duplicate"), F.lit("ok"))
    return j.groupBy("source", said.alias("said")).agg(F.count("*").alias("n"))


def builder_gates(spark, d):
    """Orders pushed as tiles by customer: pixel bytes, zoom, then order against the last key that was accepted; a running maximum of keys tells it without state."""
    k = F.col("o_orderkey")
    t = read(spark, d, "orders").select("o_custkey", k.alias("seq"), (2 + k % 5).alias("z"), (k * 7 % 64).alias("x"), (768 + F.when(k % 31 == 0, 1).otherwise(0)).alias("bytes"))
    early = F.when(F.col("bytes") != 768, "length").when(F.col("z") > 5, "zoom")
    t = t.withColumns({"early": early, "key": F.when(early.isNull(), F.col("z") * 64 + F.col("x"))})
    t = tiles.maxima_before(t, ["o_custkey"], "seq", "key", "before")
    t = t.withColumn("said", F.coalesce("early", F.when(F.col("key") <= F.col("before"), "out_of_order"), F.lit("ok")))
    return t.groupBy("said").agg(F.count("*").alias("n"))


def decoded_gates(spark, d):
    """Parts as decoded tiles: whether their size is the declared one, and the bytes of one pixel, null outside."""
    k = F.col("p_partkey")
    w, h = 256 + F.when(k % 9 == 0, 1).otherwise(0), 256 - F.when(k % 11 == 0, 6).otherwise(0)
    t = read(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"), (k * 13 % 300).alias("px"), (k * 29 % 300).alias("py"))
    at = F.when((F.col("px") < F.col("w")) & (F.col("py") < F.col("h")), (F.col("py") * F.col("w") + F.col("px")) * 3)
    return t.select("p_partkey", (F.col("w") * F.col("h") * 3).cast("bigint").alias("bytes"), at.cast("bigint").alias("pixel_at"), F.when((F.col("w") != 256) | (F.col("h") != 256), "dimension").alias("issue"))


def descriptor_uuids(spark, d):
    """Suppliers as pack descriptors of two sources: canonical text and the UUID it gives."""
    k = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, (*identity.FILE_KINDS, "synthetic"))), (k % 7).cast("int"))
    source = lambda kind, h, f, t, auth, a, b: F.struct(kind.alias("kind"), h.alias("content_hash"), f.alias("fixture_version"), t.alias("template"), auth.alias("auth"), a.alias("zmin"), b.alias("zmax"))
    none, no_auth = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    auth = F.when(k % 4 == 0, F.array(F.lit("query"), F.lit("header"), F.lit("query"))).when(k % 4 == 1, F.array(F.lit("header"))).otherwise(F.expr("array()").cast("array<string>"))
    one = source(kind, F.sha2(F.col("s_name"), 256), k % 5, none, no_auth, k % 3, 3 + k % 4)
    two = source(F.lit("url"), none, k * 0, F.concat(F.lit('https://t.example/"q"\\'), F.col("s_name"), F.lit("/{z}/{x}/{y}\t")), auth, k % 2, 3 + k % 5)
    text = identity.descriptor_json({
        "affn": F.when(k % 6 == 0, F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.lower(F.lpad(F.hex(k * 1000 + i), 16, "0")))), "bbox": [F.col("s_nationkey") * v for v in (-1000, -2000, 3000, 4000)],
        "pixel_format": 1 + k % 2, "projection": 1 + 2 * (k % 2), "quantiser_version": F.lit(1), "sources": F.array(two, one), "style_hash": F.when(k % 5 == 0, F.sha2(F.concat(F.col("s_name"), F.lit("style")), 256)),
        "addressing": F.lit(1), "axis": 1 + k % 2, "tile_dim": F.lit(256), "zmin": k % 2, "zmax": 3 + k % 5,
    })
    return read(spark, d, "supplier").select("s_suppkey", text.alias("canonical")).withColumn("uuid", codec.uuid5_hex(F.col("canonical")))


def descriptor_rules(spark, d):
    """Descriptors against the builders that use them: the first field that doesn't agree, by field."""
    k = F.col("s_suppkey")
    said = F.when(k % 13 == 0, "empty").when(k % 7 == 0, "tile_dim_px").when((k % 5 == 0) | (k % 11 == 0), "zoom_range").when(k % 3 == 0, "pixel_format").when(F.get(F.array(*map(F.lit, identity.VERSIONS.values())), (k % 3).cast("int")) != 1, "quantiser_version")
    return read(spark, d, "supplier").groupBy(F.coalesce(said, F.lit("ok")).alias("field")).agg(F.count("*").alias("n"))


def uuid_texts(spark, d):
    """Customers' identities written in many ways and read again: the usual form, or null."""
    k, u = F.col("c_custkey"), codec.uuid5_hex(F.col("c_name"))
    text = F.when(k % 6 == 0, F.upper(u)).when(k % 6 == 1, F.replace(u, F.lit("-"), F.lit(""))).when(k % 6 == 2, F.substring(u, 1, 35)).when(k % 6 == 3, F.lit("00000000-0000-0000-0000-000000000000")).when(k % 6 == 4, F.concat(F.substring(u, 1, 35), F.lit("g"))).otherwise(u)
    return read(spark, d, "customer").select("c_custkey", identity.uuid_text(text).alias("uuid"))


def name_sections(spark, d):
    """Names with their language tags as NAME sections, some cut short, and what is read back."""
    k = F.col("n_nationkey")
    n = read(spark, d, "nation").join(read(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name"), "n_nationkey")
    p = identity.name_payload(F.when(k % 3 == 0, "").when(k % 3 == 1, "el-GR").otherwise("de"), F.concat(F.col("s_name"), F.lit(" Θεσσαλονίκη")))
    cut = F.when(F.col("s_suppkey") % 10 == 0, F.substring(p, 1, 0)).when(F.col("s_suppkey") % 10 == 1, F.substring(p, 1, 2)).otherwise(p)
    return n.select("s_suppkey", F.hex(cut).alias("payload"), identity.read_name(cut).alias("r")).select("s_suppkey", "payload", "r.language", "r.name", "r.issue")


def body_checksums(spark, d):
    """CRC-32 of each pack's bodies as they lie behind each other, padding included, from the bodies' own checksums. DuckDB has no CRC-32; tests hold it against zlib."""
    placed = tiles.layout(_index(spark, d))
    end = placed.groupBy("pack_id").agg(F.max(F.col("offset") + tiles.align4(F.col("length"))).cast("bigint").alias("end"))
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    padded = F.rpad(body, tiles.align4(F.octet_length(body)).cast("int"), F.lit(b"\0"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("y"), F.crc32(padded).alias("crc"))
    parts = tiles.with_group(placed, end, ["pack_id"]).select("pack_id", "y", (F.col("end") - F.col("offset") - tiles.align4(F.col("length"))).cast("bigint").alias("after")).join(docs, "y")
    return tiles.with_group(digests.joined_crc32(parts, "pack_id", "crc", "after"), end, ["pack_id"]).select("pack_id", "end", "crc")


QUERIES = {f.__name__: f for f in (header_bytes, inspect_lines, directory_check, extension_bounds, length_offenders, tile_gates, builder_gates, decoded_gates, descriptor_uuids, descriptor_rules, uuid_texts, name_sections, body_checksums)}

_END = "max(\"offset\" + (length + 3) // 4 * 4)"
_PACKS = f"SELECT pack_id, count(*) AS n, min(z) AS zmin, max(z) AS zmax, CAST({_END} AS BIGINT) AS fin, {_uuid('pack_id')} AS uuid FROM ({_LAYOUT}) GROUP BY pack_id"
_DIR = f"""SELECT pack_id, z, CAST(292 + 20 * coalesce(sum(n) OVER (PARTITION BY pack_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_offset, n FROM (SELECT pack_id, z, count(*) AS n FROM ({_INDEX}) GROUP BY pack_id, z)"""
_BOX = "".join(f"{v % (1 << 32):08X}"[i : i + 2] for v in (-180_000_000, -85_000_000, 180_000_000, 85_000_000) for i in (6, 4, 2, 0))
_AUTH = """CASE s_suppkey % 4 WHEN 0 THEN '["header","query"]' WHEN 1 THEN '["header"]' ELSE '[]' END"""
_WRONG = "octet_length(encode(pack_id)) % 3"
SQL = {
    "header_bytes": f"""WITH p AS ({_PACKS}), d AS ({_DIR}), s AS (SELECT p.pack_id, string_agg({_le("coalesce(first_offset, 0)")} || {_le("coalesce(d.n, 0)")}, '' ORDER BY k) AS slots FROM p CROSS JOIN (SELECT unnest(range(24)) AS k) LEFT JOIN d ON d.pack_id = p.pack_id AND d.z = k GROUP BY p.pack_id)
      SELECT pack_id, '5241575401000000' || upper(replace(uuid, '-', '')) || repeat('00', 32) || '010101011000' || printf('%02X', zmin) || printf('%02X', zmax) || '{_BOX}' || '00F1536500000000' || {_le("n")} || '24010000' || slots || {_le("fin")} AS header FROM p JOIN s USING (pack_id)""",
    "inspect_lines": f"""WITH p AS ({_PACKS}), d AS ({_DIR}), z AS (SELECT pack_id, list('  zoom ' || z || ': ' || n || ' tile(s)' ORDER BY z) AS zs FROM d GROUP BY pack_id),
      l AS (SELECT pack_id, ['size: ' || (fin + 4) || ' bytes', 'format_version: 1.0', 'pack_uuid: ' || uuid, 'tile_dim_px: {DIM}', 'zoom_range: ' || zmin || '-' || zmax, 'tile_count: ' || n] || zs || ['extensions: 0 section(s)'] AS ls FROM p JOIN z USING (pack_id))
      SELECT pack_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line FROM l""",
    "directory_check": f"""WITH d AS ({_DIR}) SELECT pack_id, rule, count(*) AS n FROM (SELECT pack_id, 'count' AS rule FROM d WHERE z = 19 AND {_WRONG} = 0 OR z = 18 AND {_WRONG} = 2
      UNION ALL SELECT pack_id, 'offset' FROM d WHERE z = 20 AND {_WRONG} <> 1 OR z = 18 AND {_WRONG} = 2) GROUP BY ALL""",
    "extension_bounds": """WITH h AS (SELECT 292 + 20 * (s_suppkey % 9) AS e, 300 + s_suppkey * 7 % 400 AS x, 500 + s_suppkey % 200 AS n FROM supplier) SELECT rule, count(*) AS n FROM (
      SELECT 'before_blob' AS rule FROM h WHERE x < (e + 3) // 4 * 4 UNION ALL SELECT 'alignment' FROM h WHERE x % 4 <> 0 UNION ALL SELECT 'beyond_file' FROM h WHERE x > n - 4) GROUP BY rule""",
    "length_offenders": f"""WITH t AS (SELECT pack_id, z, x, y, CASE WHEN y % 3 = 0 THEN {DIM * DIM} ELSE length END AS length FROM ({_INDEX}) WHERE y % 2 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY z, x, y) AS r, count(*) OVER (PARTITION BY pack_id) AS n FROM t WHERE length <> {DIM * DIM})
      SELECT pack_id, y, length, {DIM * DIM} AS expected, n FROM o WHERE r = 1""",
    "tile_gates": """WITH t AS (SELECT source, doc_id AS seq, doc_id % 27 AS z, doc_id % 50 AS x, doc_id % 4 AS y, octet_length(encode(text)) AS n FROM documents),
      e AS (SELECT *, CASE WHEN z < 2 OR z > 25 THEN 'zoom_out_of_range' WHEN z >= 24 THEN 'zoom_too_high' WHEN n >= 30000 THEN 'tile_too_large' END AS early FROM t),
      k AS (SELECT *, row_number() OVER (PARTITION BY source, z, x, y, early IS NULL ORDER BY seq) AS r FROM e) SELECT source, coalesce(early, CASE WHEN r > 1 THEN 'duplicate' ELSE 'ok' END) AS said, count(*) AS n FROM k GROUP BY ALL""",
    "builder_gates": """WITH t AS (SELECT o_custkey, o_orderkey AS seq, 2 + o_orderkey % 5 AS z, o_orderkey * 7 % 64 AS x, o_orderkey % 31 = 0 AS odd FROM orders), e AS (SELECT *, CASE WHEN odd THEN 'length' WHEN z > 5 THEN 'zoom' END AS early FROM t),
      k AS (SELECT *, CASE WHEN early IS NULL THEN z * 64 + x END AS key FROM e), m AS (SELECT *, max(key) OVER (PARTITION BY o_custkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k)
      SELECT coalesce(early, CASE WHEN key <= was THEN 'out_of_order' ELSE 'ok' END) AS said, count(*) AS n FROM m GROUP BY 1""",
    "decoded_gates": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 257 ELSE 256 END AS w, CASE WHEN p_partkey % 11 = 0 THEN 250 ELSE 256 END AS h, p_partkey * 13 % 300 AS px, p_partkey * 29 % 300 AS py FROM part)
      SELECT p_partkey, CAST(w * h * 3 AS BIGINT) AS bytes, CASE WHEN px < w AND py < h THEN CAST((py * w + px) * 3 AS BIGINT) END AS pixel_at, CASE WHEN w <> 256 OR h <> 256 THEN 'dimension' END AS issue FROM t""",
    "descriptor_uuids": f"""WITH s AS (SELECT *, s_suppkey AS k, ['dir', 'geotiff', 'mbtiles', 'pbf', 'pmtiles', 'style', 'synthetic'][s_suppkey % 7 + 1] AS kind FROM supplier),
      a AS (SELECT *, CASE WHEN kind = 'synthetic' THEN '{{"fixture_version":' || (k % 5) || ',"kind":"synthetic"}}' ELSE '{{"content_hash":"' || sha256(s_name) || '","kind":"' || kind || '","zoom_max":' || (3 + k % 4) || ',"zoom_min":' || (k % 3) || '}}' END AS one,
        '{{"auth_kinds":' || {_AUTH} || ',"kind":"url","template":"https://t.example/\\"q\\"\\\\' || s_name || '/{{z}}/{{x}}/{{y}}\\t","zoom_max":' || (3 + k % 5) || ',"zoom_min":' || (k % 2) || '}}' AS two,
        CASE WHEN kind = 'synthetic' THEN 0 ELSE (k % 3) * 100 + 3 + k % 4 END AS w1, (k % 2) * 100 + 3 + k % 5 AS w2 FROM s),
      c AS (SELECT s_suppkey, '{{"affn":' || CASE WHEN k % 6 = 0 THEN '[' || array_to_string(list_transform(range(6), lambda i: '"' || printf('%016x', k * 1000 + i) || '"'), ',') || ']' ELSE 'null' END
        || ',"bbox":[' || (s_nationkey * -1000) || ',' || (s_nationkey * -2000) || ',' || (s_nationkey * 3000) || ',' || (s_nationkey * 4000) || '],"format_version":[1,0],"pixel_format":' || (1 + k % 2) || ',"projection":' || (1 + 2 * (k % 2)) || ',"quantiser_version":1,"sources":['
        || CASE WHEN w1 <= w2 THEN one || ',' || two ELSE two || ',' || one END || '],"style_hash":' || CASE WHEN k % 5 = 0 THEN '"' || sha256(s_name || 'style') || '"' ELSE 'null' END
        || ',"tile_addressing_scheme":1,"tile_axis_convention":' || (1 + k % 2) || ',"tile_dim_px":256,"zoom_range":[' || (k % 2) || ',' || (3 + k % 5) || ']}}' AS canonical FROM a) SELECT s_suppkey, canonical, {_uuid("canonical")} AS uuid FROM c""",
    "descriptor_rules": """SELECT CASE WHEN s_suppkey % 13 = 0 THEN 'empty' WHEN s_suppkey % 7 = 0 THEN 'tile_dim_px' WHEN s_suppkey % 5 = 0 OR s_suppkey % 11 = 0 THEN 'zoom_range' WHEN s_suppkey % 3 = 0 THEN 'pixel_format' WHEN s_suppkey % 3 = 2 THEN 'quantiser_version' ELSE 'ok' END AS field, count(*) AS n FROM supplier GROUP BY 1""",
    "uuid_texts": f"SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 1, 5) THEN {_uuid('c_name')} END AS uuid FROM customer",
    "name_sections": """WITH p AS (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'el-GR' ELSE 'de' END AS tag, s_name || ' Θεσσαλονίκη' AS name FROM supplier),
      b AS (SELECT *, printf('%02X', octet_length(encode(tag))) || hex(encode(tag)) || hex(encode(name)) AS h FROM p)
      SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN '' WHEN 1 THEN substr(h, 1, 4) ELSE h END AS payload, CASE WHEN s_suppkey % 10 > 1 THEN tag WHEN s_suppkey % 10 = 1 AND tag = '' THEN '' END AS language,
        CASE WHEN s_suppkey % 10 > 1 THEN name WHEN s_suppkey % 10 = 1 AND tag = '' THEN substr(name, 1, 1) END AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'PayloadEmpty' WHEN s_suppkey % 10 = 1 AND tag <> '' THEN 'TagExceedsPayload' END AS issue FROM b""",
}
