"""The panel model against published figures, and identities, names and rules against plain Python."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import codec, identity, panel, pixels
from gridloom.plans import colour_queries


@pytest.fixture(scope="module")
def codes(spark):
    return colour_queries._modelled(spark.createDataFrame([(c,) for c in panel.CODES], "code int")).cache()


def test_published_separability(codes):
    j = codes.alias("p").join(codes.alias("q"), F.col("p.code") < F.col("q.code"))
    j = j.select(*(F.col(f"{s}.{k}").alias(f"{k}{i}") for i, s in enumerate("pq", 1) for k in "lab"))
    de = np.array([r[0] for r in pixels.with_ciede2000(j, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").select("de").collect()])
    # The study's figures.
    assert len(de) == 2016 and [round(float(x), 2) for x in (de.min(), np.median(de), de.max())] == [5.24, 28.54, 66.01]


def test_published_threshold_figures(spark):
    t = panel.thresholds()
    g = spark.range(256).select(F.col("id").cast("int").alias("grey"))
    v = F.col("grey")
    g = g.withColumns({"fixed": pixels.two_bit(v), "own": F.when(v < t[0], 0).when(v < t[1], 1).when(v < t[2], 2).otherwise(3), **dict(zip(("l1", "a1", "b1"), panel.srgb_lab(v, v, v), strict=True))})
    means = []
    for name in ("fixed", "own"):
        lab = panel.lab_of(panel.xyz_of(F.col(name), F.col(name), F.col(name)), panel.WHITE)
        d = g.withColumns(dict(zip(("l2", "a2", "b2"), lab, strict=True)))
        means.append(round(pixels.with_ciede2000(d, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").agg(F.avg("de")).first()[0], 2))
    assert g.where("fixed <> own").count() == 151 and means == [16.24, 6.65]


def test_models_agree(codes):
    for r in codes.collect():
        k = panel.CODES.index(r["code"])
        assert np.allclose([r["X"], r["Y"], r["Z"]], panel.CODE_XYZ[k]) and np.allclose([r["l"], r["a"], r["b"]], panel.CODE_LAB[k], atol=1e-9)


def test_nearest_against_plain_search(spark):
    rnd = np.random.default_rng(1)
    rows = [tuple(map(float, x)) for x in rnd.normal((60, 0, 0), (25, 20, 20), (200, 3))]
    got = spark.createDataFrame(rows, "l double, a double, b double").select("l", "a", "b", panel.nearest([F.col(k) for k in "lab"]).alias("code")).collect()
    for r in got:
        far = ((panel.CODE_LAB - np.array(r[:3])) ** 2).sum(1)
        assert far[panel.CODES.index(r["code"])] <= far.min() + 1e-9


def test_descriptor_text_is_json_in_order(spark):
    src = "struct<kind:string,content_hash:string,fixture_version:int,template:string,auth:array<string>,zmin:int,zmax:int>"
    rows = [(1, [("url", None, None, 'https://x/"a"\\{z}\n', ["query", "header", "query"], 2, 5), ("synthetic", None, 7, None, None, None, None), ("dir", "ab" * 32, None, None, None, 2, 4)], None), (2, [("style", "cd" * 32, None, None, None, 0, 3)], "ef" * 32)]
    df = spark.createDataFrame(rows, f"k int, sources array<{src}>, style string")
    zero = F.lit(None).cast("array<string>")
    d = {"affn": zero, "bbox": [F.lit(v) for v in (-1, -2, 3, 4)], "pixel_format": F.lit(1), "projection": F.lit(1), "quantiser_version": F.lit(1), "sources": F.col("sources"), "style_hash": F.col("style"), "addressing": F.lit(1), "axis": F.lit(1), "tile_dim": F.lit(256), "zmin": F.lit(0), "zmax": F.lit(5)}
    for r in df.select("k", identity.descriptor_json(d).alias("t")).withColumn("u", codec.uuid5_hex(F.col("t"))).collect():
        own = json.loads(r["t"])
        assert list(own) == sorted(own) and len(own) == 12
        assert json.dumps(own, separators=(",", ":"), ensure_ascii=False) == r["t"] and str(uuid.uuid5(uuid.UUID(codec.NAMESPACE), r["t"])) == r["u"]
        assert [s["kind"] for s in own["sources"]] == (["synthetic", "dir", "url"] if r["k"] == 1 else ["style"])
        if r["k"] == 1:
            assert own["sources"][2]["auth_kinds"] == ["header", "query"] and own["sources"][2]["template"] == 'https://x/"a"\\{z}\n' and own["style_hash"] is None


def test_uuid_texts(spark):
    u = "5146db8e-0859-561c-8580-45c6154e890d"
    cases = {u: u, u.upper(): u, u.replace("-", ""): u, u[:-1]: None, "0" * 32: None, u[:-1] + "g": None, "": None}
    got = {r["t"]: r["u"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", identity.uuid_text(F.col("t")).alias("u")).collect()}
    assert got == cases


def test_names(spark):
    cases = [(b"", "PayloadEmpty", None, None), (b"\x05ab", "TagExceedsPayload", None, None), (b"\x02elx", None, "el", "x"), (b"\x00", None, "", ""), (b"\x01\xffx", "InvalidUtf8", None, None)]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, p binary").select("k", identity.read_name(F.col("p")).alias("r")).collect()
    assert {r["k"]: (r["r"]["issue"], r["r"]["language"], r["r"]["name"]) for r in rows} == {k: c[1:] for k, c in enumerate(cases)}
    made = spark.range(1).select(identity.name_payload(F.lit("el-GR"), F.lit("Αθήνα")).alias("a"), identity.name_payload(F.lit("x" * 256), F.lit("n")).alias("b")).first()
    assert bytes(made["a"]) == b"\x05el-GR" + "Αθήνα".encode() and made["b"] is None


def test_joined_checksums(spark):
    import random
    import zlib

    from gridloom.operators import digests

    rnd = random.Random(4)
    rows, want = [], {}
    for g in ("a", "b", None):
        parts = [rnd.randbytes(rnd.choice([0, 1, 3, 4, 1000, 70_000])) for _ in range(25)]
        after = sum(map(len, parts))
        want[g] = zlib.crc32(b"".join(parts))
        for p in parts:
            after -= len(p)
            rows.append((g, zlib.crc32(p), after))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, c long, n long").repartition(5)
    assert {r["g"]: r["crc"] for r in digests.joined_crc32(df, "g", "c", "n").collect()} == want
    assert digests.joined_crc32(df.where("false"), "g", "c", "n").count() == 0


def test_body_checksums_query(spark):
    import os
    import zlib
    from collections import defaultdict

    from gridloom.plans import pack_queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    tiles = defaultdict(list)
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        body = (r["text"] or "").encode()
        tiles[r["source"]].append((18 + r["doc_id"] % 3, r["doc_id"] * 7919 % (1 << 18), r["doc_id"], body + bytes(-len(body) % 4)))
    want = {s: zlib.crc32(b"".join(t[3] for t in sorted(ts, key=lambda t: t[:3]))) for s, ts in tiles.items()}
    assert {r["pack_id"]: r["crc"] for r in pack_queries.body_checksums(spark, d).collect()} == want
