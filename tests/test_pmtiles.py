"""Hilbert ids, directories and archives of single-file pyramids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import hilbert
from gridloom.sources import pmtiles


def test_ids_of_the_first_zooms():
    # Published ids of the format: fixed values.
    assert [int(hilbert.ids(*t)) for t in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0), (12, 3423, 1763))] == [0, 1, 2, 3, 4, 5, 19078479]


def test_ids_both_ways():
    for z in range(6):
        x, y = (v.ravel() for v in np.meshgrid(np.arange(1 << z), np.arange(1 << z)))
        i = hilbert.ids(np.full(len(x), z), x, y)
        assert sorted(i) == list(range((4**z - 1) // 3, (4 ** (z + 1) - 1) // 3))
        # Neighbours on the curve are neighbours on the map.
        o = np.argsort(i)
        assert (np.abs(np.diff(x[o])) + np.abs(np.diff(y[o])) == 1).all()
    rng = np.random.default_rng(1)
    z = rng.integers(0, 32, 5000)
    x, y = (rng.integers(0, 1 << 31, 5000) & ((1 << z) - 1) for _ in range(2))
    assert all((a == b).all() for a, b in zip(hilbert.tiles(hilbert.ids(z, x, y)), (z, x, y), strict=True))
    assert hilbert.ids([3, -1, 32, 2], [8, 0, 0, 1], [0, 0, 0, -1]).tolist() == [-1] * 4


def test_numbers_of_seven_bits():
    values = np.array([0, 1, 127, 128, 300, 2**21, 2**35 - 1, 2**63 - 1, 2**64 - 1], np.uint64)
    assert (pmtiles.unvarints(pmtiles.varints(values)) == values).all()
    assert pmtiles.varints(np.array([0, 1, 127, 128, 300])) == bytes([0, 1, 127, 0x80, 1, 0xAC, 2])
    for bad, what in ((b"", "Truncated"), (b"\x80", "Truncated"), (b"\xff" * 11 + b"\1", "TooLong")):
        with pytest.raises(ValueError, match=what):
            pmtiles.unvarints(bad)


def test_directories():
    rng = np.random.default_rng(2)
    ids = np.cumsum(rng.integers(1, 900, 400))
    run, length = rng.integers(0, 3, 400), rng.integers(1, 5000, 400)
    offset = np.where(rng.random(400) < 0.6, np.concatenate(([0], np.cumsum(length)[:-1])), rng.integers(0, 10**9, 400))
    got = pmtiles.read_directory(pmtiles.write_directory(ids, run, offset, length))
    assert all((a == b).all() for a, b in zip(got, (ids, run, offset, length), strict=True))
    for bad, what in ((pmtiles.varints(np.array([2, 1, 1, 1, 1])), "DirectoryLength"), (pmtiles.varints(np.array([1, 1, 1, 1, 0])), "FirstOffset"), (pmtiles.varints(np.array([2, 1, 0, 1, 1, 1, 1, 1, 0])), "DirectoryOrder")):
        with pytest.raises(ValueError, match=what):
            pmtiles.read_directory(bad)


def some_tiles(n, seed):
    rng = random.Random(seed)
    keys = {(z, rng.randrange(1 << z), rng.randrange(1 << z)) for z in (0, 3, 7, 7, 7, 14) for _ in range(n)}
    return [(*k, b"sea" if rng.random() < 0.5 else bytes(rng.choices(range(256), k=rng.randint(1, 20)))) for k in keys]


@pytest.mark.parametrize(("leaf", "how"), [(4096, pmtiles.GZIP), (50, pmtiles.GZIP), (7, pmtiles.NONE)])
def test_files_come_back_by_ranges(spark, tmp_path, leaf, how):
    made = {"a": some_tiles(120, 1), "b": some_tiles(40, 2)}
    for name, tiles in made.items():
        (tmp_path / f"{name}.pmtiles").write_bytes(pmtiles.build_archive(tiles, how, leaf))
    (tmp_path / "bad.pmtiles").write_bytes(b"PMTiles\x02" + bytes(200))
    (tmp_path / "none.pmtiles").write_bytes(pmtiles.build_archive([], how))
    got = pmtiles.with_bodies(pmtiles.read_tiles(pmtiles.archive_files(spark, str(tmp_path)))).collect()
    for name, tiles in made.items():
        assert sorted((r["z"], r["x"], r["y"], bytes(r["body"])) for r in got if r["path"].endswith(f"/{name}.pmtiles")) == sorted(tiles)
    assert [(r["path"].rsplit("/", 1)[-1], r["issue"], r["z"]) for r in got if r["issue"]] == [("bad.pmtiles", "BadMagic", None)]
    head = pmtiles.read_header((tmp_path / "a.pmtiles").read_bytes())
    assert head["tiles"] == len(made["a"]) > head["entries"] or head["entries"] >= head["bodies"]


def test_archives_of_a_column(spark):
    tiles = [(g, *t) for g, seed in (("g", 3), (None, 4)) for t in some_tiles(30, seed)]
    df = spark.createDataFrame(tiles, "archive_id string, z int, x long, y long, body binary")
    made = pmtiles.build_archives(df, most_bytes=2000, leaf=9).withColumn("k", F.concat(F.coalesce("archive_id", F.lit("-")), F.lit("/"), F.col("part")))
    assert made.count() > 2
    got = pmtiles.read_tiles(made, "k", "archive")
    back = sorted((r["k"][0], r["z"], r["x"], r["y"], r["length"]) for r in got.collect())
    assert back == sorted((t[0] or "-", *t[1:4], len(t[4])) for t in tiles)
    broken = made.select("k", F.expr("substring(archive, 1, 140)").alias("archive"))
    assert {r["issue"] is None for r in pmtiles.read_tiles(broken, "k", "archive").collect()} == {False}


def test_runs_and_shared_bodies():
    tiles = [(4, x, y, b"sea") for x in range(16) for y in range(16)] + [(0, 0, 0, b"land")]
    h = pmtiles.read_header(pmtiles.build_archive(tiles))
    assert (h["tiles"], h["entries"], h["bodies"], h["data_size"]) == (257, 2, 2, 7)
    for bad in ([(1, 2, 0, b"x")], [(1, 0, 0, b"x")] * 2, [(1, 0, 0, b"")]):
        with pytest.raises(ValueError):
            pmtiles.build_archive(bad)


def test_held_archives_pass_by_directory(spark):
    """Python is given headers and directories only: the plan's Arrow steps have no column with an archive's bytes."""
    tiles = [(8, k % 200, k // 200, bytes([k % 251]) * 900) for k in range(600)]
    good = pmtiles.build_archive(tiles, leaf=50)
    rows = [("good", good), ("cut", good[:200]), ("head", good[:40]), ("magic", b"x" * 300), ("far", good[:8] + b"\xff" * 16 + good[24:]), ("none", None)]
    df = spark.createDataFrame(rows, "k string, archive binary")
    made = pmtiles.read_tiles(df, "k", "archive")
    got = made.collect()
    assert sorted((r["x"], r["y"], r["length"]) for r in got if r["k"] == "good") == sorted((x, y, 900) for _, x, y, _ in tiles)
    assert {r["k"]: r["issue"] for r in got if r["k"] != "good" and r["issue"]} == {"cut": "TooShort", "head": "TooShort", "magic": "BadMagic", "far": "TooShort", "none": "TooShort"}
    steps = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow roots(" in line or "MapInArrow leaves(" in line]
    assert steps and not any("archive#" in s.split(")#")[0] for s in steps)
