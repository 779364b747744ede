"""Packs, layouts, estimates and streams."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import estimate, tiles
from gridloom.sources import packs
from gridloom.streaming import ingest

META = {"uuid": bytes(range(1, 17)), "pixel_format": 1, "tile_dim": 128, "zmin": 0, "zmax": 4, "bbox": (-180_000_000, -85_000_000, 180_000_000, 85_000_000), "timestamp": 1_700_000_000}


def body(z, x, y):
    return bytes([z]) + x.to_bytes(4, "little") + y.to_bytes(4, "little") + bytes((73 * z + 7 * x + 13 * y + 31 * i) % 256 for i in range(7))


def test_pack_round_trip_and_damage():
    t = [(4, x, y, 0, body(4, x, y)) for x in range(5) for y in range(5)]
    data = packs.build_pack(META, t[::-1], [(b"ATTR", b"b"), (b"ATTR", b"a")])
    p = packs.open_pack(data)
    assert [(e[0], e[4], e[5]) for e in p["entries"]] == [k[:3] for k in t] and p["extensions"] == [(b"ATTR", b"a"), (b"ATTR", b"b")]
    assert all(data[e[6] : e[6] + e[7]] == body(*k[:3]) and e[6] % 4 == 0 for e, k in zip(p["entries"], t, strict=True))
    with pytest.raises(ValueError, match="CrcMismatch"):
        packs.open_pack(data[:500] + bytes([data[500] ^ 1]) + data[501:])
    with pytest.raises(ValueError, match="DuplicateTile"):
        packs.build_pack(META, [t[0], t[0]])


def test_packs_in_spark(spark, tmp_path):
    rows = [("a", 2, x, 1, 0, body(2, x, 1)) for x in range(4)] + [("b", 3, 1, 1, 0, b"")]
    made = packs.build_packs(spark.createDataFrame(rows, "pack_id string, z int, x long, y long, compression int, body binary"), most_bytes=60)
    back = packs.read_packs(made).select("pack_id", "z", "x", "y", "body").collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in back) == sorted((r[0], r[1], r[2], r[3], r[5]) for r in rows)
    path = str(tmp_path / "one.pack")
    packs.write_pack_file(bytes(made.first()["pack"]), path)
    assert packs.read_packs(packs.pack_files(spark, path), ("path",)).where("issue is null").count() > 0
    assert packs.read_packs(spark.createDataFrame([("x", b"short")], "pack_id string, pack binary"), ("pack_id",)).first()["issue"] == "TooShort"


def test_layout_is_the_plain_prefix_sum(spark):
    rows = [(None, 9, (k * 37) % 512, k, k % 11) for k in range(200)]  # a null pack is a pack
    got = {(r["x"], r["y"]): r["offset"] for r in tiles.layout(spark.createDataFrame(rows, "pack_id string, z int, x long, y long, length long")).collect()}
    at = 292 + 20 * len(rows)
    at += -at % 4
    for _, _, x, y, n in sorted(rows, key=lambda r: r[1:4]):
        assert got[x, y] == at
        at += n + -n % 4


def test_learned_rate_folds(spark):
    b = spark.createDataFrame([("u", 1, 100.0), ("u", 2, 50.0), ("u", 3, 5.0)], "g string, k int, v double")
    assert estimate.learned_rate(b, "g", "k", "v", F.col("v") >= 10).first()["rate"] == ((313 + 100) / 2 + 50) / 2


def test_ordered_ingest_stream(spark, tmp_path):
    schema = "pack_id string, seq long, z int, x long, y long"
    spark.createDataFrame([("a", 1, 1, 0, 0), ("a", 2, 1, 1, 0), ("a", 3, 1, 0, 5), ("b", 4, 0, 0, 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.ordered_ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ingested").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["pack_id"], r["x"], r["accepted"]) for r in spark.table("ingested").collect()) == [("a", 0, False), ("a", 0, True), ("a", 1, True), ("b", 0, True)]


#: The first tiles' digests of the published grid, keyed by (z, x, y).
GRID = {
    (4, 0, 0): "8d2e0504c8152c1cc7b139739a757ed391f7d72bfda2f086d08ecbece55b566d", (4, 0, 1): "0bc2ca5e09aac9c2abbe6c5496b8e77b81e3b06bda780a17abb2128d1347a72b",
    (4, 0, 2): "132da46724bb358663fa913ffd5db2bba7d3c3b727d27cf2a94470b475c3657b", (4, 0, 3): "fa9446cafc91d3829d0169d3d80d96de1b902f78193a058fd95f5e7e05adea5f",
}


def test_published_digests_through_a_pack(spark):
    data = packs.build_pack(META, [(4, x, y, 0, body(4, x, y)) for y in range(5) for x in range(5)])
    rows = packs.read_packs(spark.createDataFrame([("g", data)], "pack_id string, pack binary"), ("pack_id",)).select("z", "x", "y", F.sha2("body", 256).alias("h")).collect()
    got = {(r["z"], r["x"], r["y"]): r["h"] for r in rows}
    assert len(got) == 25 and {k: got[k] for k in GRID} == GRID


def test_zooms_and_extensions_of_a_pack():
    pixel = bytes([0xC3, 0xCC, 0xF0, 0xFF])
    meta = META | {"tile_dim": 2, "zmax": 1}
    data = packs.build_pack(meta, [(0, 0, 0, 0, pixel)] + [(1, x, y, 0, pixel) for y in range(2) for x in range(2)])
    p = packs.open_pack(data)
    assert p["slots"][:3] == [(292, 1), (312, 4), (0, 0)] and not p["extensions"]
    # Without extensions their offset is still where the bodies end.
    assert int.from_bytes(data[288:292], "little") == len(data) - 4 == 292 + 5 * 24
    odd = bytearray(data)
    odd[288:292] = len(data).to_bytes(4, "little")
    odd[-4:] = packs.zlib.crc32(bytes(odd[:-4])).to_bytes(4, "little")
    with pytest.raises(ValueError, match="ExtensionsOffsetOutOfBounds"):
        packs.open_pack(bytes(odd))
    for bad, what in (([(3, 0, 0, 0, b"")], "ZoomOutOfRange"), ([(0, 0, 0, 0, b""), (0, 0, 0, 0, b"")], "DuplicateTile")):
        with pytest.raises(ValueError, match=what):
            packs.build_pack(meta, bad)
    with pytest.raises(ValueError, match="InvalidMetadata"):
        packs.build_pack(meta | {"parent": b"\1" * 16}, [])
    assert packs.read_name(packs.name_payload("Θ", "el")) == ("el", "Θ")
    for payload, what in ((b"", "PayloadEmpty"), (b"\5ab", "TagExceedsPayload"), (b"\1\xff", "InvalidUtf8")):
        with pytest.raises(ValueError, match=what):
            packs.read_name(payload)


def _streamed(spark, tmp_path, rows, schema, make, name):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_request_schedule_stream(spark, tmp_path):
    rows = [[("h", 1, 0), ("h", 2, 10), ("g", 3, 5)], [("h", 4, 300), ("h", 5, 1000)]]
    got = {r["seq"]: r["send_us"] for r in _streamed(spark, tmp_path, rows, "host string, seq long, arrive_us long", lambda s: ingest.request_schedule(s, 250), "sent")}
    assert got == {1: 0, 2: 250, 3: 5, 4: 500, 5: 1000}


def test_running_checksum_stream(spark, tmp_path):
    import zlib

    rows = [[("a", 1, b"one"), ("b", 3, b"x"), ("a", 2, b"two")], [("a", 4, b"three")]]
    got = {(r["pack_id"], r["seq"]): (r["tiles"], r["bytes"], r["crc"]) for r in _streamed(spark, tmp_path, rows, "pack_id string, seq long, body binary", ingest.running_checksum, "checked")}
    assert got == {("a", 1): (1, 3, zlib.crc32(b"one")), ("a", 2): (2, 6, zlib.crc32(b"onetwo")), ("a", 4): (3, 11, zlib.crc32(b"onetwothree")), ("b", 3): (1, 1, zlib.crc32(b"x"))}


def test_windowed_counts(spark):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([(t(1), 3), (t(9), 3), (t(11), 3), (t(11), 4)], "ts timestamp, z int")
    assert sorted((r["z"], r["n"]) for r in ingest.tile_counts(rows).collect()) == [(3, 1), (3, 2), (4, 1)]


def test_measurements(spark, tmp_path):
    import json

    from gridloom.sources.measurements import read_measurements

    rows = [{"level": 13, "strategy": "block", "tiles": 16, "rleBytes": 5}, {"pass": 1, "label": "a", "passNetwork": {"h": {"requests": 2, "bytes": 9}, "g": {"requests": 1, "bytes": 1}}}, {"level": 14, "tiles": 42}]
    (tmp_path / "out.json").write_text(json.dumps(rows, indent=1))
    runs, nets = read_measurements(spark, str(tmp_path / "out.json"))
    assert sorted((r["level"], r["tiles"]) for r in runs.collect()) == [(13, 16), (14, 42)]
    assert sorted(tuple(r) for r in nets.collect()) == [(1, "a", "g", 1, 1), (1, "a", "h", 2, 9)]


def test_index_rules_across_spans(spark):
    from gridloom.operators import rules

    rows = [("p", k, 1, k - 3 if k in (4, 7) else k, 0, 0, 300 + 4 * k, 4, 300, 900) for k in range(12)]
    df = spark.createDataFrame(rows, "g string, seq long, z int, x long, y long, flags int, offset long, length long, s long, e long")
    for span in (1, 2, 5, 100):
        assert sorted((r["seq"], r["rule"]) for r in rules.index_issues(df, "g", "s", "e", rows=span).collect()) == [(4, "order"), (7, "order")]


def test_image_files(spark, tmp_path):
    from gridloom.functions import png
    from gridloom.sources.images import image_files

    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(2, 2, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    colours = [0xFF0000, 0x00FF00, 0x0000FF, 0xFFFFFF]
    for k, c in enumerate(colours):
        image.setRGB(k % 2, k // 2, c)
    for kind in ("png", "jpg"):
        jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(tmp_path / f"colours.{kind}")))
    clear = jvm.java.awt.image.BufferedImage(1, 1, jvm.java.awt.image.BufferedImage.TYPE_INT_ARGB)
    clear.setRGB(0, 0, 0x01102030)
    jvm.javax.imageio.ImageIO.write(clear, "png", jvm.java.io.File(str(tmp_path / "clear.png")))
    (tmp_path / "grey.png").write_bytes(png.write_grey(b"abcd", 2))
    (tmp_path / "none.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["rgb888"] and bytes(r["rgb888"]), r["error"]) for r in image_files(spark, str(tmp_path)).collect()}
    rgb = b"".join(c.to_bytes(3, "big") for c in colours)
    assert got["colours.png"] == (2, 2, rgb, None) and got["grey.png"] == (2, 2, b"aaabbbcccddd", None)
    assert got["clear.png"] == (1, 1, b"\x10\x20\x30", None) and got["none.png"] == (None, None, None, "DecodeFailed")
    assert got["colours.jpg"][:2] == (2, 2) and len(got["colours.jpg"][2]) == 12


def test_orders_and_maxima_across_spans(spark):
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.randrange(30)) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    bad, most = set(), {}
    for g in ("a", "b", None):
        own = [(k, v) for h, k, v in rows if h == g]
        bad |= {k for (_, a), (k, b) in zip(own, own[1:], strict=False) if a >= b}
        most |= {k: max((v for _, v in own[:i]), default=None) for i, (k, _) in enumerate(own)}
    for span in (1, 7, 1000):
        assert {r["k"] for r in tiles.order_violations(df, ["g"], "k", ["v"], span).collect()} == bad
        assert {r["k"]: r["m"] for r in tiles.maxima_before(df, ["g"], "k", "v", "m", span).collect()} == most
