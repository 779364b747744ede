"""A pack written by many tasks has the bytes of one built whole."""

import random

import pytest

from gridloom.sources import pack_writer, packs

SCHEMA = "pack_id string, z int, x long, y long, compression int, body binary"


def rows(pack, n, seed):
    rng = random.Random(seed)
    keys = {(rng.choice((0, 4, 4, 9)), 0, 0) if k == 0 else (rng.choice((4, 9)), rng.randrange(16), rng.randrange(16)) for k in range(n)}
    return [(pack, *k, rng.randrange(2), rng.choice((None, b"", rng.randbytes(rng.randrange(1, 90))))) for k in keys]


def whole(tiles, extensions=()):
    z = [t[1] for t in tiles]
    return packs.build_pack({**pack_writer.META, "zmin": min(z), "zmax": max(z)}, [(*t[1:5], t[5] or b"") for t in tiles], extensions)


@pytest.mark.parametrize("extensions", [[], [(b"NAME", packs.name_payload("many", "en")), (b"ATTR", b"abc")]])
def test_bytes_equal_those_of_a_pack_built_whole(spark, tmp_path, extensions):
    made = {"a": rows("a", 300, 1), "b/x": rows("b/x", 1, 2), None: rows(None, 60, 3)}
    df = spark.createDataFrame([t for ts in made.values() for t in ts], SCHEMA).repartition(5)
    ranges = pack_writer.pack_ranges(df, extensions=extensions, range_bytes=512, index_rows=7)
    ranges.write.parquet(str(tmp_path / "ranges"))
    ranges = spark.read.parquet(str(tmp_path / "ranges"))
    assert ranges.where("kind = 'bodies' and pack_id = 'a'").count() > 5 and ranges.where("kind = 'index' and pack_id = 'a'").count() > 5
    paths = pack_writer.write_packs(ranges, str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["a.pack", "b_x.pack", "none.pack"]
    for k, name in (("a", "a"), ("b/x", "b_x"), (None, "none")):
        data = (tmp_path / "out" / f"{name}.pack").read_bytes()
        assert data == whole(made[k], extensions)
        assert len(packs.open_pack(data)["entries"]) == len(made[k])
    assert not list((tmp_path / "out").glob("*.partial"))
    # A run after one that failed writes the same file.
    (tmp_path / "out" / "a.pack.partial").write_bytes(b"x" * 10**6)
    pack_writer.write_packs(ranges, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.pack").read_bytes() == whole(made["a"], extensions)


def test_rules(spark):
    t = rows("a", 20, 4)
    with pytest.raises(Exception, match="DuplicateTile"):
        pack_writer.pack_ranges(spark.createDataFrame([*t, t[0]], SCHEMA)).collect()
    with pytest.raises(Exception, match="ZoomTooHigh"):
        pack_writer.pack_ranges(spark.createDataFrame([("a", 24, 0, 0, 0, b"x")], SCHEMA)).collect()
    with pytest.raises(Exception, match="ZoomOutOfRange"):
        pack_writer.pack_ranges(spark.createDataFrame(t, SCHEMA), {**pack_writer.META, "zmin": 5, "zmax": 9}).collect()
    assert pack_writer.pack_ranges(spark.createDataFrame([], SCHEMA)).collect() == []
