"""Queries over pixels, palettes, byte bodies and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import codec, pixels
from gridloom.plans.tile_queries import read


def _px(spark: SparkSession, d: str, *more) -> DataFrame:
    """Lineitem as pixels of tiles, one tile a 64 orders."""
    of = lambda c, k: F.pmod(F.col(c) * k, F.lit(256)).cast("int")
    return read(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 64).alias("tile"), of("l_partkey", 7).alias("r"), of("l_suppkey", 11).alias("g"), of("l_orderkey", 13).alias("b"), *more)


_PX = "SELECT l_orderkey // 64 AS tile, CAST(l_partkey * 7 % 256 AS INTEGER) AS r, CAST(l_suppkey * 11 % 256 AS INTEGER) AS g, CAST(l_orderkey * 13 % 256 AS INTEGER) AS b FROM lineitem"


_PX_AT = _PX.replace(" FROM lineitem", ", l_orderkey, l_linenumber FROM lineitem")


def _q(c: str) -> str:
    return f"(CASE WHEN {c} <= 42 THEN 0 WHEN {c} <= 127 THEN 1 WHEN {c} <= 212 THEN 2 ELSE 3 END)"


_CODE = f"(192 + {_q('b')} * 16 + {_q('g')} * 4 + {_q('r')})"


def quantise_pixels(spark, d):
    """Pixels by code and 16-bit colour, with the code's channels."""
    p = _px(spark, d).select(pixels.abgr2222(F.col("r"), F.col("g"), F.col("b")).alias("code"), pixels.rgb565(F.col("r"), F.col("g"), F.col("b")).alias("c565"))
    p = p.groupBy("code", "c565").agg(F.count("*").alias("n"))
    return p.select("code", "c565", "n", *(c.alias(k) for k, c in pixels.unpacked(F.col("code")).items()))


def palette_histogram(spark, d):
    """Pixels by nearest slot with their share: each distinct colour is snapped once, then weighted."""
    colours = _px(spark, d).groupBy("r", "g", "b").agg(F.count("*").alias("n"))
    h = colours.withColumn("slot", pixels.nearest_slot(F.col("r"), F.col("g"), F.col("b"))).groupBy("slot").agg(F.sum("n").alias("n"), F.count("*").alias("colours"))
    return h.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def code_coverage(spark, d):
    """Codes by frequency, with the share that the most frequent ones cover up to each. At most 64 rows meet in the window."""
    h = _px(spark, d).groupBy(pixels.abgr2222(F.col("r"), F.col("g"), F.col("b")).alias("code")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "code")
    return h.select("code", "n", F.row_number().over(w).alias("rank"), F.round(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("covered"))


def tile_codes(spark, d):
    """Distinct codes of each tile, of all pixels and of every 97th place only, and its darkest code's share."""
    code = pixels.abgr2222(F.col("r"), F.col("g"), F.col("b"))
    # A tile's pixels stand in the order of orders and their lines, eight places an order.
    p = _px(spark, d, (F.col("l_orderkey") % 64 * 8 + F.col("l_linenumber") - 1).alias("at")).withColumn("code", code)
    return p.groupBy("tile").agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"), F.count_distinct(F.when(F.pmod("at", F.lit(97)) == 0, F.col("code"))).alias("sampled_codes"), F.round(F.count_if(F.col("code") == 192) / F.count("*"), 6).alias("darkest"))


def lut_restyle(spark, d):
    """Codes through a lookup table that inverts them (identity where it has no entry), and spread of the result by tile."""
    lut = spark.range(192, 256, 2).select(F.col("id").cast("int").alias("code"), (447 - F.col("id")).cast("int").alias("to"))
    p = _px(spark, d).select("tile", pixels.abgr2222(F.col("r"), F.col("g"), F.col("b")).alias("code")).groupBy("tile", "code").agg(F.count("*").alias("n"))
    p = p.join(F.broadcast(lut), "code", "left").withColumn("out", F.coalesce("to", "code"))  # the table has 32 rows
    return p.groupBy("tile").agg(F.sum(F.col("out") * F.col("n")).alias("total"), F.min("out").alias("least"), F.max("out").alias("most"), F.count_distinct("out").alias("codes"))


def luminance_stats(spark, d):
    """Mean, percentiles and contrast to white of luminance by tile."""
    p = _px(spark, d).withColumn("y", F.round(pixels.luminance(F.col("r"), F.col("g"), F.col("b")), 9))
    s = p.groupBy("tile").agg(F.round(F.avg("y"), 6).alias("mean"), F.round(F.percentile("y", 0.05), 6).alias("p5"), F.round(F.percentile("y", 0.95), 6).alias("p95"), F.max("y").alias("top"))
    return s.select("tile", "mean", "p5", "p95", F.round(pixels.contrast(F.lit(1.0), F.col("top")), 6).alias("contrast"))


def pair_distance(spark, d):
    """Lab distances between all pairs of codes in use: at most 64 a side."""
    used = _px(spark, d).select(pixels.abgr2222(F.col("r"), F.col("g"), F.col("b")).alias("code")).distinct()
    ch = {k: v * 85 for k, v in pixels.unpacked(F.col("code")).items()}
    c = used.select("code", *(v.alias(k) for k, v in pixels.lab(ch["cr"], ch["cg"], ch["cb"]).items()))
    j = c.alias("p").join(c.alias("q"), F.col("p.code") < F.col("q.code"))
    diff = lambda k: F.pow(F.col(f"p.{k}") - F.col(f"q.{k}"), F.lit(2))
    return j.select(F.col("p.code").alias("c1"), F.col("q.code").alias("c2"), F.round(F.sqrt(diff("l") + diff("a") + diff("b")), 4).alias("distance"))


def ciede2000_pairs(spark, d):
    """CIEDE2000 of the same pairs."""
    used = _px(spark, d).select(pixels.abgr2222(F.col("r"), F.col("g"), F.col("b")).alias("code")).distinct()
    ch = {k: v * 85 for k, v in pixels.unpacked(F.col("code")).items()}
    c = used.select("code", *(v.alias(k) for k, v in pixels.lab(ch["cr"], ch["cg"], ch["cb"]).items()))
    j = c.alias("p").join(c.alias("q"), F.col("p.code") < F.col("q.code"))
    j = j.select(F.col("p.code").alias("c1"), F.col("q.code").alias("c2"), *(F.col(f"{s}.{k}").alias(f"{k}{i}") for i, s in enumerate("pq", 1) for k in "lab"))
    return pixels.with_ciede2000(j, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").select("c1", "c2", F.round("de", 4).alias("de"))


def _bodies(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))


def rle_sizes(spark, d):
    """Each whole body's run-length coded size, and proof that it decodes."""
    e = _bodies(spark, d).withColumns({"enc": codec.rle8_encode("body"), "raw": F.length("body").cast("bigint")})
    e = e.withColumn("back", codec.rle8_decode("enc", F.col("raw")))
    return e.select("doc_id", "raw", F.length("enc").cast("bigint").alias("rle"), F.col("back.body").eqNullSafe(F.col("body")).alias("exact"))


_RLE = """WITH b AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
 c AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS v FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2)) AS i FROM b)),
 g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id, v ORDER BY i) AS isl, v FROM c),
 r AS (SELECT doc_id, min(i) AS st, count(*) AS n FROM g GROUP BY doc_id, v, isl),
 s AS (SELECT doc_id, st, CASE WHEN n % 128 >= 3 THEN 2 * (n // 128) + 2 ELSE 2 * (n // 128) END AS cost, CASE WHEN n % 128 >= 3 THEN 0 ELSE n % 128 END AS lit, n FROM r),
 k AS (SELECT *, sum(CASE WHEN cost > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY st ROWS UNBOUNDED PRECEDING) AS grp FROM s),
 l AS (SELECT doc_id, grp, sum(cost) AS cost, sum(lit) AS lit FROM k GROUP BY doc_id, grp),
 z AS (SELECT doc_id, sum(cost + lit + ceil(lit / 128.0)) AS rle FROM l GROUP BY doc_id)
 SELECT b.doc_id, CAST(octet_length(encode(t)) AS BIGINT) AS raw, CAST(coalesce(rle, 0) AS BIGINT) AS rle, true AS exact FROM b LEFT JOIN z ON z.doc_id = b.doc_id"""


def rle_rollup(spark, d):
    """Raw and coded totals by language and over all."""
    e = _bodies(spark, d).select("lang", F.length("body").cast("bigint").alias("raw"), F.length(codec.rle8_encode("body")).cast("bigint").alias("rle"))
    e = e.rollup("lang").agg(F.count("*").alias("bodies"), F.sum("raw").alias("raw"), F.sum("rle").alias("rle"))
    return e.withColumn("percent", F.round(F.col("rle") * 100.0 / F.col("raw"), 6))


def deflate_sizes(spark, d):
    return _bodies(spark, d).select("doc_id", F.length("body").cast("bigint").alias("raw"), codec.deflated_size("body").alias("deflated"), F.crc32("body").alias("crc"))


def body_hashes(spark, d):
    return _bodies(spark, d).select("doc_id", F.sha2("body", 256).alias("sha256"), codec.uuid5_hex(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("uuid"), codec.fnv1a(F.transform(F.split(F.col("doc_id").cast("string"), ""), lambda c: F.ascii(c).cast("bigint"))).alias("fnv"))


_UUID = f"sha1(from_hex('{codec.NAMESPACE}') || encode({{}}))"


def _uuid(name: str) -> str:
    h = _UUID.format(name)
    variant = f"substr('89ab89ab89ab89ab', CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def canonical_identity(spark, d):
    """Suppliers as pack descriptors: canonical text and the UUID it gives. Keys stand in one order, nulls are written."""
    s = read(spark, d, "supplier")
    box = F.concat_ws(",", *(F.col("s_nationkey") * k for k in (-1000, -2000, 3000, 4000)))
    text = F.concat(F.lit('{"affn":null,"bbox":['), box, F.lit('],"kind":'), codec.json_string(F.concat_ws("\n", F.col("s_name"), F.lit('"q"\\'))), F.lit(',"zoom":['), F.pmod("s_suppkey", F.lit(5)).cast("string"), F.lit(","), (F.pmod("s_suppkey", F.lit(5)) + 3).cast("string"), F.lit("]}"))
    return s.select("s_suppkey", text.alias("canonical"), codec.uuid5_hex(text).alias("uuid"))


_CANON = """'{"affn":null,"bbox":[' || (s_nationkey * -1000) || ',' || (s_nationkey * -2000) || ',' || (s_nationkey * 3000) || ',' || (s_nationkey * 4000) || '],"kind":"' || s_name || '\\n\\"q\\"\\\\","zoom":[' || (s_suppkey % 5) || ',' || (s_suppkey % 5 + 3) || ']}'"""
QUERIES = {f.__name__: f for f in (quantise_pixels, palette_histogram, code_coverage, tile_codes, lut_restyle, luminance_stats, pair_distance, ciede2000_pairs, rle_sizes, rle_rollup, deflate_sizes, body_hashes, canonical_identity)}


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


_SNAP = "list_aggregate([" + ", ".join(f"((r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b})) * 8 + {i}" for i, (_, r, g, b) in enumerate(pixels.SLOTS)) + "], 'min') % 8"
_F3 = lambda t: f"(CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE (24389.0::DOUBLE / 27 * {t} + 16) / 116 END)"
SQL = {
    "quantise_pixels": f"""SELECT code, c565, n, code & 3 AS cr, (code >> 2) & 3 AS cg, (code >> 4) & 3 AS cb, code >> 6 AS ca FROM (
      SELECT CAST({_CODE} AS INTEGER) AS code, CAST((r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) AS INTEGER) AS c565, count(*) AS n FROM ({_PX}) GROUP BY ALL)""",
    "palette_histogram": f"""SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM (
      SELECT CAST({_SNAP} AS INTEGER) AS slot, CAST(sum(n) AS BIGINT) AS n, count(*) AS colours FROM (SELECT r, g, b, count(*) AS n FROM ({_PX}) GROUP BY ALL) GROUP BY slot)""",
    "code_coverage": f"""SELECT code, n, CAST(row_number() OVER (ORDER BY n DESC, code) AS INTEGER) AS rank, round(sum(n) OVER (ORDER BY n DESC, code ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / sum(n) OVER (), 6) AS covered
      FROM (SELECT CAST({_CODE} AS INTEGER) AS code, count(*) AS n FROM ({_PX}) GROUP BY code)""",
    "tile_codes": f"""SELECT tile, count(*) AS n, count(DISTINCT code) AS codes, count(DISTINCT code) FILTER ((l_orderkey % 64 * 8 + l_linenumber - 1) % 97 = 0) AS sampled_codes, round(count(*) FILTER (code = 192) / count(*)::DOUBLE, 6) AS darkest
      FROM (SELECT *, {_CODE} AS code FROM ({_PX_AT})) GROUP BY tile""",
    "lut_restyle": f"""SELECT tile, CAST(sum(o) AS BIGINT) AS total, min(o) AS least, max(o) AS most, count(DISTINCT o) AS codes FROM (
      SELECT tile, CAST(CASE WHEN code % 2 = 0 THEN 447 - code ELSE code END AS INTEGER) AS o FROM (SELECT tile, {_CODE} AS code FROM ({_PX}))) GROUP BY tile""",
    "luminance_stats": f"""SELECT tile, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.05), 6) AS p5, round(quantile_cont(y, 0.95), 6) AS p95, round(1.05::DOUBLE / (max(y) + 0.05), 6) AS contrast
      FROM (SELECT tile, round(0.2126 * {_lin("r")} + 0.7152 * {_lin("g")} + 0.0722 * {_lin("b")}, 9) AS y FROM ({_PX})) GROUP BY tile""",
    "pair_distance": f"""WITH u AS (SELECT DISTINCT CAST({_CODE} AS INTEGER) AS code FROM ({_PX})), k AS (SELECT code, {_lin("((code & 3) * 85)")} AS lr, {_lin("(((code >> 2) & 3) * 85)")} AS lg, {_lin("(((code >> 4) & 3) * 85)")} AS lb FROM u),
      x AS (SELECT code, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS x, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS y, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS z FROM k),
      f AS (SELECT code, {_F3("x")} AS fx, {_F3("y")} AS fy, {_F3("z")} AS fz FROM x), l AS (SELECT code, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f)
      SELECT p.code AS c1, q.code AS c2, round(sqrt(pow(p.l - q.l, 2) + pow(p.a - q.a, 2) + pow(p.b - q.b, 2)), 4) AS distance FROM l p JOIN l q ON p.code < q.code""",
    "rle_sizes": _RLE,
    "rle_rollup": f"""SELECT lang, count(*) AS bodies, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(rle) AS BIGINT) AS rle, round(sum(rle) * 100.0::DOUBLE / sum(raw), 6) AS percent
      FROM ({_RLE}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ROLLUP (lang)""",
    "body_hashes": f"""SELECT doc_id, sha256(encode(coalesce(text, ''))) AS sha256, {_uuid("'doc:' || doc_id")} AS uuid,
      CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS BIGINT) AS fnv FROM documents""",
    "canonical_identity": f"SELECT s_suppkey, canonical, {_uuid('canonical')} AS uuid FROM (SELECT s_suppkey, {_CANON} AS canonical FROM supplier)",
}
