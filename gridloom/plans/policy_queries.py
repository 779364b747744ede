"""Queries over URLs, dates, attributions, pages, packs, rules, estimates and measured runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import web
from gridloom.operators import estimate, rules, tiles
from gridloom.plans.tile_queries import _EXTENTS, _LAYOUT, _index, _regions, read
from gridloom.sources import packs


def host_policy(spark, d):
    """Pages by host with the host's least interval between requests."""
    p = read(spark, d, "pages").select(web.host(F.col("url")).alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("pages")).select("host", "pages", web.interval_us(F.col("host")).alias("interval_us"), web.is_loopback(F.col("host")).alias("loopback"))


def url_expand(spark, d):
    """Page URLs as tile templates, filled in and with a key added."""
    t = F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("/{z}/{x}/{y}.png"))
    k = F.col("page_id")
    return read(spark, d, "pages").select("page_id", web.with_query(web.expand(t, F.pmod(k, F.lit(20)), k * 3, k * 5), F.lit("key"), k.cast("string")).alias("url"), F.size(web.missing_placeholders(F.col("url"))).alias("missing"))


def http_dates(spark, d):
    """Order dates as HTTP dates and back to seconds."""
    o = read(spark, d, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("text"))
    return o.select("o_orderkey", web.http_date(F.col("text")).alias("unix"), web.retry_after(F.col("text"), F.lit(800_000_000)).alias("wait"))


def attribution_check(spark, d):
    """Texts by whether they could stand as a one-line attribution."""
    return read(spark, d, "documents").select(web.attribution_issue(F.col("text")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", web.html_text(F.col("html")).alias("text")).select("page_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def pack_roundtrip(spark, d):
    """Documents written into packs, a pack for each source, and read back."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = read(spark, d, "documents")
    t = docs.select(F.col("source").alias("pack_id"), F.lit(20).alias("z"), F.pmod(F.col("doc_id") * 7919, F.lit(1 << 20)).alias("x"), F.col("doc_id").alias("y"), F.lit(0).alias("compression"), body.alias("body"))
    back = packs.read_packs(packs.build_packs(t))
    return back.select("pack_id", "z", "x", "y", "length", F.sha2("body", 256).alias("sha256"))


def _headers(spark, d):
    """Suppliers as pack headers, some of them wrong."""
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(
        k.alias("pack_id"), F.when(k % 11 == 0, "RAWX").otherwise("RAWT").alias("magic"), F.lit(1).alias("major"), (k % 13 == 0).alias("uuid_zero"), (k % 17 != 0).alias("parent_zero"), (k % 4).alias("projection"), (k % 3).alias("addressing"), (k % 5).alias("axis"), F.when(k % 7 == 0, 1).otherwise(0).alias("minor"),
        (k % 4).alias("pixel_format"), (k % 5 * 32).alias("tile_dim"), (k % 6).alias("zmin"), (k % 9).alias("zmax"),
        (F.col("s_nationkey") * 1000).alias("min_lon"), (F.col("s_nationkey") * 900 + 500).alias("max_lon"), F.lit(-5).alias("min_lat"), F.lit(5).alias("max_lat"),
    )


def rule_report(spark, d):
    """Every rule that a header fails."""
    return rules.issues(_headers(spark, d), "pack_id")


def header_first_issue(spark, d):
    """The same headers read to the first failing rule only, by rule."""
    return rules.issues(_headers(spark, d), "pack_id", strict=False, fail_fast=True).groupBy("rule").agg(F.count("*").alias("n"))


def index_report(spark, d):
    """The documents' index, entries numbered by doc_id, which breaks the key order; some have flags, an odd offset, or an end behind the extensions."""
    t = tiles.layout(_index(spark, d))
    n = t.groupBy("pack_id").agg(F.count("*").alias("n"), F.max(F.col("offset") + tiles.align4(F.col("length"))).cast("bigint").alias("end"))
    t = tiles.with_group(t, n, ["pack_id"]).withColumns({"seq": F.col("y"), "flags": (F.pmod("y", F.lit(50)) == 7).cast("int"), "start": tiles.align4(292 + 20 * F.col("n"))})
    shift = F.when(F.pmod("y", F.lit(40)) == 3, 2).when(F.pmod("y", F.lit(60)) == 9, F.col("end") - F.col("offset") - F.col("length") + 4).when(F.pmod("y", F.lit(70)) == 1, -F.col("offset")).otherwise(0)
    return rules.index_issues(t.withColumn("offset", F.col("offset") + shift), "pack_id", "start", "end").groupBy("pack_id", "rule").agg(F.count("*").alias("n"))


def estimate_plan(spark, d):
    return estimate.plan(tiles.extents(_regions(spark, d), 8, 12), "region")


def work_done(spark, d):
    e = tiles.extents(_regions(spark, d), 8, 12).withColumns({"tiles": F.col("nx") * F.col("ny"), "ms": (F.col("nx") * F.col("ny") * 5).cast("double")})
    return estimate.work_done(e, "region", "z", "tiles", "ms", F.lit(100))


def learned_rates(spark, d):
    """Event values as build rates by user; values under 10 don't count."""
    return estimate.learned_rate(read(spark, d, "events"), "user_id", "event_id", "value", F.col("value") >= 10)


def run_totals(spark, d):
    """Events as measured runs: totals by type and level, by type, and over all."""
    e = read(spark, d, "events").withColumn("level", F.pmod("user_id", F.lit(5)))
    return e.rollup("event_type", "level").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max("value").alias("worst"))


def upper_medians(spark, d):
    """Count, upper median of the descending order, best and worst value by type."""
    return estimate.upper_medians(read(spark, d, "events"), "event_type", "value")


def archive_cost(spark, d):
    """What regions' tiles take stored, and cost by provider: a fixed grid of three providers."""
    e = tiles.extents(_regions(spark, d), 8, 12).groupBy("region").agg(F.sum(F.col("nx") * F.col("ny")).cast("bigint").alias("tiles"))
    provider = F.explode(F.array(*(F.struct(F.lit(n).alias("provider"), F.lit(p).alias("cents")) for n, p in (("a", 6), ("b", 15), ("c", 23)))))
    bytes_ = 296 + 20 * F.col("tiles") + F.floor(F.col("tiles") * 16384 * 6 / 100)
    return e.select("region", bytes_.cast("bigint").alias("bytes"), provider.alias("p")).select("region", "bytes", "p.provider", F.round(F.col("bytes") * F.col("p.cents") / 1e6, 6).alias("cost"))


QUERIES = {f.__name__: f for f in (host_policy, url_expand, http_dates, attribution_check, html_text, pack_roundtrip, rule_report, header_first_issue, index_report, estimate_plan, work_done, learned_rates, run_totals, upper_medians, archive_cost)}


def _strip_sql(c: str) -> str:
    for tag in web.SILENT:
        c = rf"regexp_replace({c}, '(?is)<{tag}\b.*?</{tag}\s*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]*>', chr(10), 'g')"
    for name, ch in web.ENTITIES:
        c = f"replace({c}, '{name}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return c


_HOST = "lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':.*$', ''))"
SQL = {
    "host_policy": f"""SELECT host, pages, CASE WHEN host = 'localhost' OR host LIKE '%.localhost' THEN 0 WHEN host = 'openstreetmap.org' OR host LIKE '%.openstreetmap.org' THEN 500000 ELSE 250000 END AS interval_us,
      host = 'localhost' OR host LIKE '%.localhost' AS loopback FROM (SELECT {_HOST} AS host, count(*) AS pages FROM pages GROUP BY 1)""",
    "url_expand": r"SELECT page_id, regexp_replace(url, '\?.*$', '') || '/' || (page_id % 20) || '/' || (page_id * 3) || '/' || (page_id * 5) || '.png?key=' || page_id AS url, 3 AS missing FROM pages",
    "http_dates": "SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS unix, greatest(0, CAST(floor(epoch(o_orderdate)) AS BIGINT) - 800000000) AS wait FROM orders",
    "attribution_check": r"""SELECT CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN c = '' THEN NULL WHEN c = chr(10) THEN 'lf' WHEN c = chr(13) THEN 'cr' WHEN c = chr(133) THEN 'nel' WHEN c = chr(8232) THEN 'ls'
      WHEN c = chr(8233) THEN 'ps' WHEN c = chr(127) THEN 'del' ELSE 'c0' END AS issue, count(*) AS n FROM (SELECT text, regexp_extract(text, '([\x{0}-\x{1f}\x{7f}\x{85}\x{2028}\x{2029}])', 1) AS c FROM documents) GROUP BY 1""",
    "html_text": f"""SELECT page_id, length(t) AS n_chars, sha256(t) AS sha256 FROM (SELECT page_id, array_to_string(list_filter(list_transform(string_split({_strip_sql("html")}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS t FROM pages)""",
    "pack_roundtrip": "SELECT source AS pack_id, 20 AS z, (doc_id * 7919) % 1048576 AS x, doc_id AS y, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(encode(text)) AS sha256 FROM documents",
    "rule_report": """WITH h AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), r AS (
      SELECT k, 'magic' AS rule, 'error' AS severity FROM h WHERE k % 11 = 0 UNION ALL SELECT k, 'uuid', 'error' FROM h WHERE k % 13 = 0 UNION ALL SELECT k, 'pixel_format', 'error' FROM h WHERE k % 4 NOT IN (1, 2)
      UNION ALL SELECT k, 'parent', 'error' FROM h WHERE k % 17 = 0 UNION ALL SELECT k, 'projection', 'error' FROM h WHERE k % 4 NOT IN (1, 3) UNION ALL SELECT k, 'addressing', 'error' FROM h WHERE k % 3 = 0
      UNION ALL SELECT k, 'axis', 'error' FROM h WHERE k % 5 NOT IN (1, 2) UNION ALL SELECT k, 'addressing_strict', 'error' FROM h WHERE k % 3 = 2
      UNION ALL SELECT k, 'tile_dim', 'error' FROM h WHERE k % 5 = 0 UNION ALL SELECT k, 'zoom_range', 'error' FROM h WHERE k % 9 < k % 6 UNION ALL SELECT k, 'minor', 'warning' FROM h WHERE k % 7 = 0
      UNION ALL SELECT k, 'pixel_format_strict', 'error' FROM h WHERE k % 4 = 2 UNION ALL SELECT k, 'bbox', 'error' FROM h WHERE n * 1000 >= n * 900 + 500) SELECT k AS pack_id, rule, severity FROM r""",
    "header_first_issue": """SELECT rule, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'magic' WHEN s_suppkey % 13 = 0 THEN 'uuid' WHEN s_suppkey % 17 = 0 THEN 'parent' WHEN s_suppkey % 4 NOT IN (1, 2) THEN 'pixel_format'
      WHEN s_suppkey % 4 NOT IN (1, 3) THEN 'projection' WHEN s_suppkey % 3 = 0 THEN 'addressing' WHEN s_suppkey % 5 NOT IN (1, 2) THEN 'axis' WHEN s_suppkey % 5 = 0 THEN 'tile_dim' WHEN s_suppkey % 9 < s_suppkey % 6 THEN 'zoom_range' END AS rule FROM supplier) WHERE rule IS NOT NULL GROUP BY rule""",
    "index_report": f"""WITH p AS ({_LAYOUT}), e AS (SELECT *, count(*) OVER (PARTITION BY pack_id) AS n, max("offset" + (length + 3) // 4 * 4) OVER (PARTITION BY pack_id) AS fin FROM p),
      t AS (SELECT pack_id, z, x, y, length, fin, (292 + 20 * n + 3) // 4 * 4 AS start, "offset" + CASE WHEN y % 40 = 3 THEN 2 WHEN y % 60 = 9 THEN fin - "offset" - length + 4 WHEN y % 70 = 1 THEN -"offset" ELSE 0 END AS o FROM e),
      l AS (SELECT *, lag((z, x, y)) OVER (PARTITION BY pack_id ORDER BY y) AS was FROM t),
      r AS (SELECT pack_id, 'order' AS rule FROM l WHERE was >= (z, x, y) UNION ALL SELECT pack_id, 'flags' FROM t WHERE y % 50 = 7 UNION ALL SELECT pack_id, 'bounds' FROM t WHERE o < start OR o + length > fin UNION ALL SELECT pack_id, 'alignment' FROM t WHERE o % 4 <> 0)
      SELECT pack_id, rule, count(*) AS n FROM r GROUP BY ALL""",
    "estimate_plan": f"""WITH e AS (SELECT region, b AS block, nx, ny, ceil(nx / b::DOUBLE) * ceil(ny / b::DOUBLE) AS renders, b * ny * 16384 AS col FROM ({_EXTENTS}), (SELECT unnest([16, 8, 4, 2, 1]) AS b)),
      p AS (SELECT region, block, CAST(sum(nx * ny) AS BIGINT) AS tiles, CAST(sum(renders) AS BIGINT) AS renders, max(col) AS col FROM e GROUP BY ALL),
      c AS (SELECT *, coalesce(max(CASE WHEN col <= {128 << 20} THEN block END) OVER w, min(block) OVER w) AS chosen FROM p WINDOW w AS (PARTITION BY region)),
      s AS (SELECT region, block, tiles, renders, col, CAST(round(tiles * (16384 * 0.055::DOUBLE)) AS BIGINT) AS pack, round((tiles * (16384 / 1e6::DOUBLE) * 313 + renders * 210.0::DOUBLE + 2500) / 1000, 3) AS seconds FROM c WHERE block = chosen)
      SELECT region, CAST(block AS INTEGER) AS block_n, tiles, renders, col AS column_bytes, pack, seconds, CASE WHEN tiles = 0 THEN 'empty' WHEN 2 * col + 2 * pack > {384 << 20} THEN 'refuse_total' WHEN col > {384 << 20} THEN 'refuse_column'
        WHEN pack > {256 << 20} THEN 'refuse_pack' WHEN 2 * col + 2 * pack > {192 << 20} OR pack > {96 << 20} OR seconds > 300 THEN 'heavy' ELSE 'ok' END AS verdict FROM s""",
    "work_done": f"""SELECT region, round(sum(CASE WHEN t > 0 THEN least(greatest((100 - b) / t::DOUBLE, 0), 1) * t * 5 ELSE 0 END), 6) AS work FROM (
      SELECT region, nx * ny AS t, coalesce(sum(nx * ny) OVER (PARTITION BY region ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({_EXTENTS})) GROUP BY region""",
    "learned_rates": """SELECT user_id, round(greatest(10.0::DOUBLE, list_reduce(list_prepend(313.0::DOUBLE, list(value ORDER BY event_id)), lambda a, v: (a + v) / 2)), 6) AS rate FROM events WHERE value >= 10 GROUP BY user_id""",
    "run_totals": "SELECT event_type, user_id % 5 AS level, count(*) AS n, round(sum(value), 3) AS total, max(value) AS worst FROM events GROUP BY ROLLUP (event_type, level)",
    "upper_medians": """SELECT event_type, max(n) AS n, max(value) FILTER (k = n // 2 + 1) AS middle, max(value) AS worst, min(value) AS best FROM (
      SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""",
    "archive_cost": f"""SELECT region, bytes, provider, round(bytes * cents / 1e6::DOUBLE, 6) AS cost FROM (SELECT region, CAST(296 + 20 * sum(nx * ny) + (sum(nx * ny) * 16384 * 6) // 100 AS BIGINT) AS bytes FROM ({_EXTENTS}) GROUP BY region),
      (VALUES ('a', 6), ('b', 15), ('c', 23)) p(provider, cents)""",
}
