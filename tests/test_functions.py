"""Golden vectors and properties of the column functions."""

import random
import zlib

from pyspark.sql import functions as F

from gridloom.functions import codec, geo, pixels, web


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_mercator_points(spark):
    cases = [(0.0, 0.0, 5, 16, 16), (-0.1278, 51.5074, 10, 511, 340), (-74.006, 40.7128, 10, 301, 385), (151.2093, -33.8688, 10, 942, 614), (139.6917, 35.6895, 12, 3637, 1612)]
    df = spark.createDataFrame([c[:3] for c in cases], "lon double, lat double, z int")
    got = df.select(geo.tile_x(F.col("lon"), F.col("z")), geo.tile_y(F.col("lat"), F.col("z"))).collect()
    assert [tuple(r) for r in got] == [c[3:] for c in cases]


def test_micro_rounding(spark):
    assert one(spark, geo.micro(F.lit(1.5e-6))) == 2 and one(spark, geo.micro(F.lit(5e-7))) == 0
    assert one(spark, geo.micro(F.lit(5e-7), "away")) == 1 and one(spark, geo.micro_text(F.lit(-127800))) == "-0.127800"


def test_parsers(spark):
    assert one(spark, geo.box_issue(F.lit("1,2,3"))) == "parts" and one(spark, geo.box_issue(F.lit("3,1,2,2"))) == "order" and one(spark, geo.box_issue(F.lit("1,1,2,2"))) is None
    assert one(spark, geo.zoom_range(F.lit("3-5"))) == (3, 5) and one(spark, geo.zoom_range(F.lit("7"))) == (7, 7) and one(spark, geo.zoom_range(F.lit("5-24"))) is None


def test_quantisers(spark):
    got = [one(spark, pixels.two_bit(F.lit(v))) for v in (0, 42, 43, 127, 128, 212, 213, 255)]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3]
    assert one(spark, pixels.abgr2222(F.lit(255), F.lit(0), F.lit(0))) == 0xC3 and one(spark, pixels.rgb565(F.lit(255), F.lit(255), F.lit(255))) == 0xFFFF


def test_ciede2000(spark):
    # Published check values of the formula.
    cases = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082), (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669)]
    rows = spark.createDataFrame([c[:6] for c in cases], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    got = pixels.with_ciede2000(rows, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").select("de").collect()
    assert [round(r[0], 4) for r in got] == [c[6] for c in cases]


def test_rle8():
    h = bytes.fromhex
    for raw, enc in (("AA", "00AA"), ("AABB", "01AABB"), ("AAAAAA", "82AA"), ("00" * 128, "FF00"), ("00" * 129, "FF000000"), ("AAAABBBBBBCC", "01AAAA82BB00CC")):
        assert codec.rle8(h(raw)).hex().upper() == enc
    assert codec.unrle8(h("04AABBCC"), 5) == (None, "UnexpectedEnd") and codec.unrle8(h("82AA"), 2) == (None, "OutputLengthMismatch") and codec.unrle8(h("00AA"), 5) == (None, "OutputLengthMismatch") and codec.unrle8(h("82"), 3) == (None, "UnexpectedEnd")
    assert codec.unrle8(h("82AA"), 2, lenient=True) == (b"\xaa\xaa", None)
    rnd = random.Random(7)
    for _ in range(300):
        x = b"".join(bytes([rnd.randrange(3)]) * rnd.randrange(1, 140) for _ in range(rnd.randrange(12)))
        assert codec.unrle8(codec.rle8(x), len(x)) == (x, None)


def test_hashes(spark):
    import uuid

    assert one(spark, codec.uuid5_hex(F.lit("abc"))) == str(uuid.uuid5(uuid.UUID(codec.NAMESPACE), "abc"))
    assert one(spark, codec.fnv1a(F.array(F.lit(97).cast("bigint")))) == 0xE40C292C
    assert one(spark, F.crc32(F.lit(b"123456789"))) == 0xCBF43926 == zlib.crc32(b"123456789")
    assert one(spark, codec.json_string(F.lit('a"\\\n\x01é'))) == '"a\\"\\\\\\n\\u0001é"'


def test_web(spark):
    hosts = {"https://u:p@Ex.com:80/a": "ex.com", "http://[::1]:3/": "::1", "HTTP://A?x": "a", "nope": None}
    assert {u: one(spark, web.host(F.lit(u))) for u in hosts} == hosts
    dates = {"Sun, 06 Nov 1994 08:49:37 GMT": 784111777, "Thu, 01 Jan 1970 00:00:00 GMT": 0, "Mon, 01 Jan 2024 00:00:00 GMT": 1704067200, "Mon, 01 Foo 2024 00:00:00 GMT": None}
    assert {t: one(spark, web.http_date(F.lit(t))) for t in dates} == dates
    assert [one(spark, web.attribution_issue(F.lit(t))) for t in ("ok", "", "a\r\n", "a\u0085", "a\x7f", "\x02")] == [None, "empty", "cr", "nel", "del", "c0"]
    assert [one(spark, web.is_loopback(F.lit(h))) for h in ("localhost", "a.localhost", "127.0.0.1", "127.0.0.256", "example.com")] == [True, True, True, False, False]
    assert tuple(one(spark, web.split_once(F.lit(" X-Key :  a:b "), ":"))) == ("X-Key", "a:b") and tuple(one(spark, web.split_once(F.lit(" k = v=1 "), "=", trim_value=False))) == ("k", " v=1 ")
