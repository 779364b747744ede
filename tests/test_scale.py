"""Groups of any size and values of any shape: no hot task, no quadratic scan."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions import web
from gridloom.operators import estimate, tiles


@pytest.mark.parametrize("kind", ["outlier", "repeated", "two", "spread"])
def test_upper_medians_are_exact(spark, kind):
    rng = random.Random(kind)
    n = {"two": 2}.get(kind, 30_001)
    values = [rng.gauss(0, 1) for _ in range(n)]
    if kind == "outlier":
        values[7], values[8] = 1e18, -1e300
    if kind == "repeated":
        values = [0.25 if rng.random() < 0.6 else v for v in values]
    rows = [("a", v) for v in values] + [(None, 3.0), (None, None), ("one", -1.0)]
    got = {r["g"]: (r["n"], r["middle"], r["worst"], r["best"]) for r in estimate.upper_medians(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v").collect()}
    down = sorted(values, reverse=True)
    assert got == {"a": (n, down[n // 2], down[0], down[-1]), None: (1, 3.0, 3.0, 3.0), "one": (1, -1.0, -1.0, -1.0)}


def test_only_values_near_the_middle_are_put_in_order(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.when(F.col("id") == 5, 1e18).otherwise(F.col("id") % 50_000 * 1.0).alias("v"))
    out = estimate.upper_medians(df, "g", "v")
    assert out.first()["middle"] == sorted([k % 50_000 for k in range(200_000) if k != 5] + [1e18], reverse=True)[100_000]
    # The sum over an order sees distinct values between the bounds, not the group.
    near = df.agg(F.percentile_approx("v", [0.5 - 2 / 50_000, 0.5 + 2 / 50_000], 50_000)).first()[0]
    assert df.where(F.col("v").between(*near)).select("v").distinct().count() < 50


def test_learned_rates_keep_few_builds_a_task(spark):
    b = spark.range(10_000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("k"), (F.floor(F.col("id") / 2) % 97 + 5.0).alias("v"))
    out = estimate.learned_rate(b, "g", "k", "v", F.col("v") >= 10)
    rate = 313.0
    for k in range(5000):
        rate = (rate + k % 97 + 5.0) / 2 if k % 97 + 5 >= 10 else rate
    assert [r["rate"] for r in out.collect()] == pytest.approx([rate] * 2, abs=1e-6)
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_a_regional_pack_is_spread(spark):
    """A city at zoom 17, a single column, and the same column twice: windows hold a share of the pack."""
    city = [("c", 17, 70_000 + k % 60, 45_000 + k // 60, k % 9) for k in range(3600)]
    column = [("d", 12, 9, k, 5) for k in range(1000)]
    rows = city + column
    df = spark.createDataFrame(rows, "pack_id string, z int, x long, y long, length long")
    got = {(r["pack_id"], r["x"], r["y"]): r["offset"] for r in tiles.layout(df, 256).collect()}
    for pack in "cd":
        own = sorted(r for r in rows if r[0] == pack)
        at = 292 + 20 * len(own)
        at += -at % 4
        for _, _, x, y, n in own:
            assert got[pack, x, y] == at
            at += n + -n % 4
    kept = tiles.with_group
    seen = []

    def watched(left, right, keys, how="inner"):
        if "_in" in left.columns:
            seen.append(left.groupBy("pack_id", "_part").count().agg(F.max("count")).first()[0])
        return kept(left, right, keys, how)

    tiles.with_group = watched
    try:
        tiles.layout(df, 256)
    finally:
        tiles.with_group = kept
    assert seen and seen[0] <= 16  # 3600 / 256 rows, give or take a row a column


def test_text_of_pages_with_unclosed_elements(spark):
    page = "<script x " * 100_000 + "<p>shown</p>" + "<" * 200_000
    rows = [(page,), ("<script>a</script >kept<STYLE>b</style><svg <b>still</b>",), (None,), ("a<b",), ("x</script><script>y",)]
    start = time.time()
    got = [r[0] for r in spark.createDataFrame(rows, "html string").coalesce(1).select(web.html_text(F.col("html"))).collect()]
    assert time.time() - start < 20
    assert got[1:] == ["kept\nstill", None, "a<b", "x\ny"] and "shown" in got[0]


def test_all_entities(spark):
    rows = [("<p>&eacute;&#233;&#xe9; &amp;lt; &nbsp;|&notit; &unknown;</p>",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "html string").select(web.html_text(F.col("html"), True)).collect()]
    assert got == ["ééé &lt; \xa0|¬it; &unknown;", None]


def test_shift_search_follows_pixels_not_extents(spark):
    """Two far pixels made a matrix of the whole extent; gaps, single sides and codes that are null are met too."""
    far = 2_000_000_000
    a = [("far", -far, -far, 1), ("far", far, far, 2), ("far", 7, 7, 3), ("alone", 0, 0, 1), ("tie", 0, 0, 4), ("null", 0, 0, None), ("null", 1, 0, 5)]
    b = [("far", -far + 1, -far - 2, 1), ("far", far + 1, far - 2, 2), ("far", 7, 7, 9), ("other", 0, 0, 1), ("tie", 1, 0, 4), ("tie", 0, 1, 4), ("null", 0, 0, 3), ("null", 1, 0, 5)]
    kind = "image string, gx long, gy long, code int"
    got = {r["image"]: tuple(r)[1:] for r in tiles.shift_search(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "image").collect()}
    # A null code is met but doesn't differ, so nothing does at (0, 0), the first such offset.
    assert got == {"far": (1, -2, 0.0, 2), "tie": (1, 0, 0.0, 1), "null": (0, 0, 0.0, 2)}


def test_shift_search_equals_every_pair(spark):
    rng = random.Random(5)
    px = lambda: {(i, rng.randrange(9), rng.randrange(7)): rng.randrange(3) for i in range(600) for _ in range(rng.randrange(1, 20))}
    a, b = px(), px()
    want = {}
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            met = {}
            for (i, x, y), c in a.items():
                if (i, x + dx, y + dy) in b:
                    met.setdefault(i, []).append(c != b[i, x + dx, y + dy])
            for i, d in met.items():
                want[i] = min(want.get(i, (101,)), (round(sum(d) * 100.0 / len(d), 6), dy, dx, len(d)))
    df = lambda p: spark.createDataFrame([(*k, c) for k, c in p.items()], "image long, gx int, gy int, code int")
    got = {r["image"]: (r["pct"], r["dy"], r["dx"], r["n"]) for r in tiles.shift_search(df(a), df(b), "image").collect()}
    assert got == want


def test_shift_step_costs_some_images_at_a_time():
    """Columns of numbers were made for a whole batch; they are now made for some images, however many a batch holds."""

    def peak(n):
        lists = pa.array([[{"side": k % 2, "gx": k // 2, "gy": 0, "code": k % 7} for k in range(200)]] * n, pa.list_(pa.struct([(c, pa.int32()) for c in ("side", "gx", "gy", "code")])))
        tracemalloc.start()
        got = tiles._best_shifts(lists, [(0, 0), (0, 1)])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got["n"]) == n and set(got["n"].tolist()) == {100}
        return most

    peak(1)
    assert peak(10 * tiles.SOME_IMAGES) < 1.15 * peak(tiles.SOME_IMAGES)
