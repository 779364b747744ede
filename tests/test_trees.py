"""Directory trees of tiles."""

import pytest

from gridloom.sources import trees


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for z, x, y in ((0, 0, 0), (2, 1, 3), (2, 3, 0), (5, 31, 7)):
        (at / f"{z}/{x}").mkdir(parents=True, exist_ok=True)
        (at / f"{z}/{x}/{y}.png").write_bytes(bytes([z, x, y]))
    for odd in ("2/4/0.png", "31/1/1.png", "top.png", "2/1/a.png", "2/1/3.txt"):
        (at / odd).parent.mkdir(parents=True, exist_ok=True)
        (at / odd).write_bytes(b"odd")
    return at


@pytest.mark.parametrize("axis", ["tms", "xyz"])
def test_tiles_and_issues(spark, tree, axis):
    rows = trees.tile_tree(spark, str(tree), axis=axis).collect()
    flip = lambda z, y: (1 << z) - 1 - y if axis == "tms" else y
    assert sorted((r["z"], r["x"], r["y"], bytes(r["body"])) for r in rows if r["issue"] is None) == sorted((z, x, flip(z, y), bytes([z, x, y])) for z, x, y in ((0, 0, 0), (2, 1, 3), (2, 3, 0), (5, 31, 7)))
    assert sorted(r["issue"] for r in rows if r["issue"]) == ["OutOfRange", "Path", "Path", "Zoom"]


def test_zooms_and_bytes_left_unread(spark, tree):
    t = trees.tile_tree(spark, str(tree), zooms=(2, 5)).where("issue is null")
    assert {r["z"] for r in t.collect()} == {2, 5}
    assert "content" not in t.select("z", "x", "y")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        trees.tile_tree(spark, str(tree), axis="up")
