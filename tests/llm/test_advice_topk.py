"""op3 with many rows of a query's own vec_id."""

from collections import defaultdict

import numpy as np

from gridloom.llm import topk_search


def test_repeated_rows_of_a_query(spark):
    rnd = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rnd.normal(size=40)]) for k in range(120)]
    rows += [(50, [9 * x for x in rows[50][1]])] * 9 + [(7, rows[7][1])] * 3
    got = defaultdict(list)
    for block in (1 << 20, 4096):
        got.clear()
        for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_bytes=block, pilot=30).orderBy("query_id", "rank", "vec_id").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        ints = [(k, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for k, v in rows]
        for q in (0, 50, 100):
            v = min(x for k, x in ints if k == q)
            want = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), c) for c, x in ints if c != q)[:5]
            assert got[q] == [(c, -s) for s, c in want]


def _brute(rows, every=50, k=5):
    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = {}
    for q in sorted({i for i, _ in ints if i % every == 0}):
        v = min(x for i, x in ints if i == q)
        out[q] = [(c, -s) for s, c in sorted((-sum(a * b for a, b in zip(v, x, strict=False)), c) for c, x in ints if c != q)[:k]]
    return out


def _got(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(got)


def test_components_of_any_size(spark):
    rnd = np.random.default_rng(9)
    for size in (1e6, 2e6, 3e6):
        rows = [(k, [float(x) for x in np.round(rnd.normal(size=20) * size)]) for k in range(150)]
        assert _got(topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pilot=40)) == _brute(rows)
    # Sums on the way beyond 64 bits; the scores are not.
    rows = [(0, [2.0**40, 2.0**40, 1.0]), (1, [2.0**20, -(2.0**20), 3.0]), (2, [2.0**21, -(2.0**21), 7.0])]
    assert _got(topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == _brute(rows)


def test_floors_lose_nothing(spark):
    rows = [(k, [float(k % 7), float(k % 3), 1.0]) for k in range(400)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    assert _got(topk_search.search(docs, pilot=60, block_bytes=1600)) == _brute(rows)
    assert topk_search.search(docs.where("false")).count() == 0


def test_huge_components_and_scores(spark):
    huge = [(0, [1e306, 1.0, 0.0]), (1, [0.0, 5.0, 1.0]), (2, [0.0, 6.0, 0.0]), (3, [1e300, 9.0, 0.0]), (4, [-1e300, 9.0, 0.0]), (5, [0.0, 4.0, 1e307]), (50, [0.0, 2.0, 0.0])]
    got = _got(topk_search.search(spark.createDataFrame(huge, "vec_id long, embedding array<double>")))
    # 256 times 1e306 and 1e307 is no double: these rows take no part.
    assert got == {50: [(3, 512 * 2304), (4, 512 * 2304), (2, 512 * 1536), (1, 512 * 1280)]}
    rows = [(0, [2.0**60, 1.0]), (1, [2.0**60, 2.0]), (2, [-(2.0**60), 3.0]), (3, [2.0**61, 0.0]), (4, [0.0, 7.0]), (5, [2.0**500, 0.0])]
    got = _got(topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    top = 2**63 - 1
    assert got == {0: [(1, top), (3, top), (5, top), (4, 256 * 7 * 256), (2, -top)]}
    rows = [(k, [1e200 * (k % 5 - 2), float(k), 3.0]) for k in range(1, 80)] + [(100, [0.0, 2.0, 1.0])]
    assert _got(topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pilot=20, block_bytes=600))[100] == [(79 - j, 256 * 256 * (2 * (79 - j) + 3)) for j in range(5)]
