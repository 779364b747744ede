"""Pixels across tiles against whole pictures."""

import random
import struct

import numpy as np
import pytest

from gridloom.operators import mosaics

DIM, Z = 6, 2


@pytest.fixture(scope="module")
def level(spark):
    """A world of 4 x 4 tiles of three channels, two of them missing and one of another size."""
    rng = np.random.default_rng(1)
    world = rng.integers(0, 255, (4 * DIM, 4 * DIM, 3), np.uint8)
    rows = []
    for x in range(4):
        for y in range(4):
            body = world[y * DIM : (y + 1) * DIM, x * DIM : (x + 1) * DIM].tobytes()
            if (x, y) in ((1, 1), (3, 2)):
                world[y * DIM : (y + 1) * DIM, x * DIM : (x + 1) * DIM] = mosaics.NONE
                if x == 3:
                    rows.append((Z, x, y, b"short"))
            else:
                rows.append((Z, x, y, body))
    return spark.createDataFrame(rows, "z int, x long, y long, body binary"), world


def around(world, top, left, h, w):
    """A window of the picture; x wraps, y beyond the edge is filled."""
    out = np.full((h, w, 3), mosaics.NONE, np.uint8)
    for k in range(h):
        if 0 <= top + k < len(world):
            out[k] = world[top + k, np.arange(left, left + w) % world.shape[1]]
    return out.tobytes()


@pytest.mark.parametrize("halo", [1, 4, 6])
def test_halos(spark, level, halo):
    tiles, world = level
    got = mosaics.with_halo(tiles, DIM, halo, 3).collect()
    assert len(got) == 14
    for r in got:
        assert bytes(r["buffer"]) == around(world, r["y"] * DIM - halo, r["x"] * DIM - halo, DIM + 2 * halo, DIM + 2 * halo)
        near = {((r["x"] + a) % 4, r["y"] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} - {(1, 1), (3, 2)}
        assert r["missing"] == 9 - sum(0 <= y < 4 for _, y in near)
    with pytest.raises(ValueError):
        mosaics.with_halo(tiles, DIM, 7)


def test_viewports(spark, level):
    tiles, world = level
    rng = random.Random(2)
    views = [(k, Z, rng.randrange(-9, 30), rng.randrange(-9, 30), rng.randrange(1, 20), rng.randrange(1, 20)) for k in range(40)] + [(99, Z, 0, 0, 0, 5), (98, Z, 1000, 3, 4, 4)]
    got = {r["view"]: bytes(r["buffer"]) for r in mosaics.viewports(tiles, spark.createDataFrame(views, "view long, z int, left int, top int, width int, height int"), DIM, 3).collect()}
    assert got == {k: around(world, y, x, h, w) for k, _, x, y, w, h in views}


def test_blocks(spark):
    rng = np.random.default_rng(3)
    block = rng.integers(0, 255, (2 * DIM, 3 * DIM, 4), np.uint8)
    df = spark.createDataFrame([(1, block.tobytes(), 3, 2), (2, b"bad", 3, 2), (3, None, 1, 1)], "id int, body binary, cols int, rows int")
    got = {(r["id"], r["tx"], r["ty"]): r["tile"] and bytes(r["tile"]) for r in mosaics.sliced(df, DIM).collect()}
    assert got == {(1, x, y): block[y * DIM : (y + 1) * DIM, x * DIM : (x + 1) * DIM].tobytes() for x in range(3) for y in range(2)} | {(2, -1, -1): None, (3, -1, -1): None}


def test_affn_payload():
    c = (1.5, -2.0, 0.25, 60.0, 0.0, -1e-9)
    assert mosaics.affn_payload(c) == struct.pack("<6d", *c) and mosaics.read_affn(mosaics.affn_payload(c)) == c
    for bad in ((1.0,) * 5, (1.0,) * 5 + (float("nan"),)):
        with pytest.raises(ValueError):
            mosaics.affn_payload(bad)
    with pytest.raises(ValueError, match="AffnLength"):
        mosaics.read_affn(b"x")


def test_images_without_an_inverse_cover_nothing(spark):
    images = spark.createDataFrame([(1, 2, 2, b"abcd", [0.0, 1.0, 2.0, 0.0, 2.0, 4.0]), (2, 2, 2, b"abc", [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (3, 1, 1, b"z", [-180.0, 360.0, 0.0, 86.0, 0.0, -172.0])], "id int, width int, height int, body binary, affn array<double>")
    tiles = spark.createDataFrame([(k, 0, 0, 0) for k in (1, 2, 3, 4)], "id int, z int, x long, y long")
    got = {r["id"]: (bytes(r["body"]), r["covered"]) for r in mosaics.drawn_tiles(images, tiles, "id", 4).collect()}
    assert got == {1: (b"\xff" * 16, 0), 2: (b"\xff" * 16, 0), 3: (b"z" * 16, 16)}


def test_image_descriptors(spark):
    import json

    from pyspark.sql import functions as F

    from gridloom.plans.report_queries import image_descriptor

    c = [10.0, 0.5, 0.0, 50.0, 0.0, -0.25]
    row = spark.range(1).select(image_descriptor(F.lit("ab" * 32), [F.lit(v) for v in c], F.lit(4), F.lit(8), F.lit(1)).alias("d")).first()[0]
    d = json.loads(row)
    assert d["affn"] == [struct.pack(">d", v).hex() for v in c] and d["bbox"] == [10_000_000, 48_000_000, 12_000_000, 50_000_000]
    assert d["sources"] == [{"content_hash": "ab" * 32, "kind": "image"}] and (d["projection"], d["tile_addressing_scheme"], d["tile_dim_px"]) == (3, 2, 8)
    assert list(d) == sorted(d)
