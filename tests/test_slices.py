"""What Python holds of a batch is bounded by bytes, not by the batch."""

import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.functions import chunked, codec, pixels, png, slices


def test_slices_keep_rows_and_bounds():
    rows = [b"a" * 10, None, b"", b"b" * 95, b"c" * 300, b"d" * 50, b"e" * 50, b"f"]
    whole = pa.array([b"x", *rows], pa.binary()).slice(1)
    got = list(slices.slices([(whole, pa.array(range(8))), (pa.array([], pa.binary()), pa.array([], pa.int64()))], 100))
    assert [len(a) for a, _ in got] == [3, 1, 1, 2, 1, 0]
    assert [v for a, _ in got for v in a.to_pylist()] == rows and [v for _, b in got for v in b.to_pylist()] == list(range(8))
    lists = pa.array([[b"a" * 60, b"b" * 30], [], [b"c" * 20], [b"d"]], pa.list_(pa.binary()))
    assert [len(a) for (a,) in slices.slices([(lists,)], 100)] == [2, 2]


def _pieces(udf, *columns):
    """Numbers of rows that a column function gives at a time for one batch."""
    return [len(x) for x in udf.func(iter([columns if len(columns) > 1 else columns[0]]))]


def test_png_pixels_come_in_slices(spark):
    files = pa.array([png.write_grey(bytes([k % 251]) * 640_000, 64) for k in range(3)] + [png.write_grey(bytes(range(256)) * 1600, 64)] * 4 + [None, b"x"], pa.binary())
    noise = [png.write_grey(random.Random(k).randbytes(640_000), 64) for k in range(4)]
    assert _pieces(png.decoded, files) == [9]
    assert _pieces(png.decoded, pa.array(noise, pa.binary())) == [1, 1, 1, 1]
    assert _pieces(png.grey_png, pa.array([b"a" * 640_000] * 5, pa.binary()), pa.array([64] * 5)) == [1] * 5
    df = spark.createDataFrame([(k, b"ab" * (320 * (k + 1))) for k in range(40)], "k int, b binary").coalesce(1)
    got = df.select("k", png.decoded(png.grey_png("b", F.lit(64))).alias("p")).select("k", "p.*").collect()
    assert [(r["k"], r["width"], r["height"], bytes(r["rgb888"]), r["error"]) for r in sorted(got)] == [(k, 64, 10 * (k + 1), b"aaabbb" * (320 * (k + 1)), None) for k in range(40)]


def test_run_lengths_come_in_slices(spark):
    texts = [random.Random(k).randbytes(400_000) for k in range(6)]
    coded = [codec.rle8(t) for t in texts]
    assert _pieces(codec.rle8_encode, pa.array(texts, pa.binary())) == [2, 2, 2]
    assert _pieces(codec.rle8_decode, pa.array(coded, pa.binary()), pa.array([400_000] * 6)) == [2, 2, 2]
    assert _pieces(chunked._effect, pa.array(coded, pa.binary())) == [2, 2, 2]
    spans = pa.array([[c[:200_000], c[200_000:]] for c in coded], pa.list_(pa.binary()))
    effects = pa.array([[chunked.effect(c[:200_000]).tolist(), chunked.effect(c[200_000:]).tolist()] for c in coded], pa.list_(pa.list_(pa.int32())))
    got = list(chunked._given.func(iter([(spans, effects, pa.array([0] * 6, pa.int32()))])))
    assert [len(g) for g in got] == [2, 2, 2]
    assert [b"".join(p["body"] for p in span) for g in got for span in g.to_pylist()] == texts


def test_codes_come_in_slices():
    rgb = [random.Random(k).randbytes(300_000) for k in range(9)]
    got = list(pixels.quantised.func(iter([pa.array([*rgb, None, b"ab", b""], pa.binary())])))
    assert [len(g) for g in got] == [3, 3, 6]
    told = [r for g in got for r in g.to_pylist()]
    two = lambda v: sum(v > t for t in pixels.THRESHOLDS)
    assert told[0]["codes"] == bytes(192 + two(b) * 16 + two(g) * 4 + two(r) for r, g, b in zip(*(rgb[0][k::3] for k in range(3)), strict=True))
    assert [(r["codes"], r["issue"]) for r in told[9:]] == [(None, None), (None, "length"), (b"", None)]


def test_deflated_sizes_stay_in_arrow():
    rows = [random.Random(k).randbytes(1000) for k in range(3)]
    got = codec.deflated_size.func(pa.array([*rows, None, b""], pa.binary()))
    assert got.to_pylist() == [*(len(zlib.compress(r, 9)) for r in rows), None, 8] and got.type == pa.int64()
