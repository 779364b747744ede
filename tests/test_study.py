"""PNG files, ordered digests and box texts against plain Python."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, png
from gridloom.operators import digests
from gridloom.plans import study_queries


def _file(rows: list[bytes], width: int, depth: int, colour: int, palette: bytes = b"") -> bytes:
    head = struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)
    parts = [(b"IHDR", head)] + [(b"PLTE", palette)] * bool(palette) + [(b"IDAT", zlib.compress(b"".join(rows))), (b"IEND", b"")]
    return png.MAGIC + b"".join(png._chunk(k, v) for k, v in parts)


def _filtered(px: np.ndarray, bpp: int) -> list[bytes]:
    """Rows by every filter in turn, sample by sample."""
    out = []
    for y, row in enumerate(px.astype(int)):
        up = px[y - 1].astype(int) if y else np.zeros_like(row)
        line = [y % 5]
        for x, v in enumerate(row):
            a, b, c = row[x - bpp] if x >= bpp else 0, up[x], up[x - bpp] if x >= bpp else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - [0, a, b, (a + b) // 2, paeth][y % 5]) % 256)
        out.append(bytes(line))
    return out


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_png_filters_and_colours(colour):
    n = png.SAMPLES[colour]
    px = np.random.default_rng(colour).integers(0, 256, (11, 7 * n), dtype=np.uint8)
    w, h, rgb = png.read_rgb(_file(_filtered(px, n), 7, 8, colour))
    own = px.reshape(11, 7, n)
    want = own[:, :, :3] if n >= 3 else np.repeat(own[:, :, :1], 3, axis=2)
    assert (w, h, rgb) == (7, 11, want.tobytes())


def test_png_palette_and_low_depth():
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    assert png.read_rgb(_file([bytes([0, 0b00011011])], 4, 2, 3, palette)) == (4, 1, palette)
    assert png.read_rgb(_file([bytes([0, 0b10100000])], 3, 1, 0)) == (3, 1, bytes([255] * 3 + [0] * 3 + [255] * 3))


def test_png_rows_of_bad_files(spark):
    good = png.write_grey(b"abcd", 2)
    rows = spark.createDataFrame([(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:20]), (6, good[:45])], "id int, b binary")
    got = {r["id"]: (r["p"]["width"], r["p"]["error"]) for r in rows.select("id", png.decoded("b").alias("p")).collect()}
    assert got == {1: (2, None), 2: (None, "Empty"), 3: (None, "Empty"), 4: (None, "DecodeFailed"), 5: (None, "DecodeFailed"), 6: (None, "DecodeFailed")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_png_query_keeps_every_byte(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in study_queries.png_pixels(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        data = (text or "").encode()
        data += b" " * (max(1, -(-len(data) // 64)) * 64 - len(data))
        assert got[doc_id]["sha256"] == hashlib.sha256(bytes(np.repeat(np.frombuffer(data, np.uint8), 3))).hexdigest()
        assert got[doc_id]["error"] is None


def test_ordered_digest_follows_order_and_content(spark):
    h = [hashlib.sha256(bytes([k])).hexdigest() for k in range(7)]
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    want = sha(sha(sha(h[0], h[1]), sha(h[2], h[3])), sha(sha(h[4], h[5]), sha(h[6])))
    rows = [("a", k, h[k]) for k in (3, 6, 0, 1, 5, 2, 4)] + [("b", k, h[k]) for k in (1, 0)] + [("c", 0, h[1]), ("c", 1, h[0]), (None, 0, h[0]), ("a", 9, None)]
    got = {r[0]: r[1] for r in digests.ordered_digest(spark.createDataFrame(rows, "g string, k long, h string"), "g", "k", "h", fan=2).collect()}
    assert got["a"] == want and got["b"] != got["c"] and set(got) == {"a", "b", "c", None}
    assert digests.ordered_digest(spark.createDataFrame([], "g string, k long, h string"), "g", "k", "h").count() == 0


def test_box_issue(spark):
    cases = {"-3.4,54.3,-2.8,54.8": None, " 1 , 2 ,3, 4 ": None, "1,2,3": "parts", "": "parts", "1,2,3,4,5": "parts", "1,x,3,4": "number", "1,NaN,3,4": "number", "-181,2,3,4": "lon", "1,-91,3,4": "lat", "3,2,3,4": "order", "1,4,3,2": "order"}
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r[0]: r[1] for r in rows.select("t", geo.box_issue(F.col("t"))).collect()}
    assert got == cases | {None: "parts"}
