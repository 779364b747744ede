"""The pack format as a data source: what is planned, read and pushed."""

import pytest
from pyspark.sql import functions as F

from gridloom.sources import pack_source, packs

META = {"uuid": bytes(range(1, 17)), "pixel_format": 1, "tile_dim": 4, "zmin": 0, "zmax": 9, "bbox": (-180_000_000, -85_000_000, 180_000_000, 85_000_000), "timestamp": 0}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("packs")
    tiles = {}
    for name, span in (("a", 12), ("b/c", 5)):
        rows = [(z, x, y, 0, bytes([z, x, y, 7]) * 4 if (x + y) % 5 else b"odd") for z in (3, 5, 9) for x in range(span) for y in range(span)]
        (at / f"{name}.pack").parent.mkdir(exist_ok=True)
        (at / f"{name}.pack").write_bytes(packs.build_pack(META, rows[::-1]))
        tiles[name] = rows
    (at / "empty.pack").write_bytes(packs.build_pack(META, []))
    (at / "_hidden").write_bytes(b"x")
    (at / "d.pack.partial").write_bytes(b"x")
    return at, tiles


def load(spark, path, **options):
    pack_source.register(spark)
    reader = spark.read.format("tilepack")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(path))


def test_all_entries_and_bodies(spark, files):
    at, tiles = files
    got = load(spark, at, bodies="true", entries="7").collect()
    assert sorted((r["z"], r["x"], r["y"], r["compression"], bytes(r["body"])) for r in got) == sorted(t for rows in tiles.values() for t in rows)
    assert {r["path"].rsplit("/", 1)[-1] for r in got} == {"a.pack", "c.pack"} and all(r["issue"] is None for r in got)
    assert load(spark, f"file://{at}/a.pack").count() == 432 and "body" not in load(spark, at).columns


@pytest.mark.parametrize("where", ["z = 5", "z = 5 and x = 3", "z = 5 and x = 3 and y = 4", "z >= 5 and x > 2 and x <= 4", "z in (3, 9) and y < 2", "x = 11 and y = 11", "z = 4", "z > 9", "z = 3 and x in (1, 4) and y >= 3", "z < 5 or x = 2", "x is null", "z = 5 and length = 3"])
def test_filters_equal_those_after_a_full_read(spark, files, where):
    at, _ = files
    key = lambda d: sorted((r["path"], r["seq"]) for r in d.collect())
    every = spark.createDataFrame(load(spark, at).collect(), load(spark, at).schema)
    assert key(load(spark, at, entries="10").where(where)) == key(every.where(where))


def test_filters_are_pushed_and_partitions_pruned(spark, files):
    at, _ = files
    found = load(spark, at, entries="10").where("z = 5 and x = 3 and y > 1")
    said = lambda d: d._jdf.queryExecution().executedPlan().toString()
    # What the source takes over is no filter of Spark's any more.
    assert "> 1" not in said(found) and "= 5" not in said(found) and "= 3" in said(load(spark, at).where("z = 5 and length = 3"))
    reader = pack_source.PackReader({"path": str(at), "entries": "10"})
    whole = len(reader.partitions())
    left = list(reader.pushFilters([pack_source.EqualTo(("z",), 5), pack_source.EqualTo(("x",), 3), pack_source.GreaterThan(("length",), 2)]))
    assert [f.attribute for f in left] == [("length",)]
    parts = reader.partitions()
    assert len(parts) < whole / 10 and sum(p.last - p.first for p in parts) == 12 + 5
    assert found.rdd.getNumPartitions() <= len(parts) + 1


def test_issues(spark, tmp_path):
    rows = [(3, k, 0, 0, b"12345678" * (1 + k % 2)) for k in range(4)]
    good = packs.build_pack(META, rows)
    (tmp_path / "good.pack").write_bytes(good)
    (tmp_path / "magic.pack").write_bytes(b"NOPE" + good[4:])
    (tmp_path / "short.pack").write_bytes(good[:100])
    far = bytearray(good)
    far[292 + 12 : 292 + 16] = (1 << 20).to_bytes(4, "little")
    (tmp_path / "far.pack").write_bytes(bytes(far))
    got = load(spark, tmp_path, mode="permissive", lengths="true", bodies="true").groupBy(F.element_at(F.split("path", "/"), -1).alias("f"), "issue").count().collect()
    assert {(r["f"], r["issue"]): r["count"] for r in got} == {("good.pack", "TileLength"): 2, ("good.pack", None): 2, ("magic.pack", "BadMagic"): 1, ("short.pack", "TooShort"): 1, ("far.pack", "TileOutOfBounds"): 1, ("far.pack", "TileLength"): 1, ("far.pack", None): 2}
    with pytest.raises(Exception, match="BadMagic"):
        load(spark, tmp_path / "magic.pack").collect()
    with pytest.raises(Exception, match="TileOutOfBounds"):
        load(spark, tmp_path / "far.pack").collect()
    with pytest.raises(Exception, match="nowhere"):
        load(spark, tmp_path / "nowhere").collect()
