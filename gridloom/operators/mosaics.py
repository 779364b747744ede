"""Pixels across tiles: edges exchanged with neighbours, viewports cut over tiles, blocks sliced into tiles, images drawn into tiles.

Bodies are rows of pixels, one byte a channel. A tile sends each neighbour the strip that borders on it, so a tile meets at most nine pieces and no task
holds a level; viewports and blocks meet as many tiles as they span. Tiles that aren't there are `fill`; x wraps round the world, y doesn't."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = 0xFF


def _pixels(body: bytes | None, height: int, width: int, channels: int) -> np.ndarray | None:
    """A body as rows of pixels; None if its length is another."""
    if body is None or len(body) != height * width * channels:
        return None
    return np.frombuffer(body, np.uint8).reshape(height, width, channels)


def _width(z: str = "z") -> Column:
    return F.pow(F.lit(2.0), z).cast("bigint")


def with_halo(tiles: DataFrame, dim: int, halo: int, channels: int = 1, fill: int = NONE) -> DataFrame:
    """(z, x, y, buffer, missing): each tile with `halo` pixels of its neighbours round it, and how many of the eight aren't there. tiles: (z, x, y, body), one row a key; a body of another size counts as not there."""
    if not 0 < halo <= dim:
        raise ValueError("halo must be from 1 to dim")
    side = dim + 2 * halo

    @F.pandas_udf(T.BinaryType())
    def strip(body: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        out = []
        for b, p, q in zip(body, dx, dy, strict=True):
            px = _pixels(b, dim, dim, channels)
            cut = {-1: slice(0, halo), 0: slice(0, dim), 1: slice(dim - halo, dim)}  # what a neighbour on the other side needs
            out.append(None if px is None else px[cut[q], cut[p]].tobytes())
        return pd.Series(out, dtype=object)

    @F.pandas_udf(T.BinaryType())
    def joined(pieces: pd.Series) -> pd.Series:
        out = []
        for ps in pieces:
            buffer = np.full((side, side, channels), fill, np.uint8)
            span = {-1: (dim + halo, halo), 0: (halo, dim), 1: (0, halo)}
            for p in ps:
                (x, w), (y, h) = span[p["dx"]], span[p["dy"]]
                buffer[y : y + h, x : x + w] = _pixels(p["strip"], h, w, channels)
            out.append(buffer.tobytes())
        return pd.Series(out, dtype=object)

    step = lambda name: F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias(name)
    sent = tiles.select("z", "x", "y", "body", step("dx")).select("*", step("dy"))
    sent = sent.select("z", F.pmod(F.col("x") + F.col("dx"), _width()).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "dx", "dy", strip("body", "dx", "dy").alias("strip"))
    met = sent.where("strip is not null").groupBy("z", "x", "y").agg(F.collect_list(F.struct("dx", "dy", "strip")).alias("pieces"), F.max((F.col("dx") == 0) & (F.col("dy") == 0)).alias("own"))
    return met.where("own").select("z", "x", "y", joined("pieces").alias("buffer"), (9 - F.size("pieces")).alias("missing"))


def viewports(tiles: DataFrame, views: DataFrame, dim: int, channels: int = 1, fill: int = NONE) -> DataFrame:
    """(views' columns, buffer, missing): the pixels of each view (view, z, left, top, width, height, in pixels of its zoom), cut over the tiles that it spans. Views without pixels are empty."""
    near = lambda c: F.floor(F.col(c) / dim).cast("bigint")
    to = lambda a, n: F.floor((F.col(a) + F.col(n) - 1) / dim).cast("bigint")
    some = views.where("width > 0 and height > 0").withColumn("tx", F.explode(F.sequence(near("left"), to("left", "width")))).withColumn("ty", F.explode(F.sequence(near("top"), to("top", "height"))))
    some = some.withColumn("_x", F.pmod(F.col("tx"), _width()))
    held = tiles.select(F.col("z").alias("_z"), F.col("x").alias("_tx"), F.col("y").alias("_ty"), F.when(F.octet_length("body") == dim * dim * channels, F.col("body")).alias("body"))
    met = some.join(held, (F.col("z") == F.col("_z")) & (F.col("_x") == F.col("_tx")) & (F.col("ty") == F.col("_ty")), "left")
    pieces = met.groupBy(*views.columns).agg(F.collect_list(F.struct("tx", "ty", "body")).alias("pieces"))

    @F.pandas_udf(T.BinaryType())
    def cut(left: pd.Series, top: pd.Series, width: pd.Series, height: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for x0, y0, w, h, ps in zip(left, top, width, height, pieces, strict=True):
            buffer = np.full((h, w, channels), fill, np.uint8)
            for p in ps:
                px = _pixels(p["body"], dim, dim, channels)
                if px is not None:
                    ax, ay = p["tx"] * dim - x0, p["ty"] * dim - y0  # where the tile starts in the view
                    ys, xs = slice(max(0, ay), min(h, ay + dim)), slice(max(0, ax), min(w, ax + dim))
                    buffer[ys, xs] = px[ys.start - ay : ys.stop - ay, xs.start - ax : xs.stop - ax]
            out.append(buffer.tobytes())
        return pd.Series(out, dtype=object)

    made = pieces.select(*views.columns, cut("left", "top", "width", "height", "pieces").alias("buffer"), F.size(F.filter("pieces", lambda p: p["body"].isNull())).alias("missing"))
    return made.unionByName(views.where("not (width > 0 and height > 0)").select("*", F.lit(b"").alias("buffer"), F.lit(0).alias("missing")))


def sliced(blocks: DataFrame, dim: int, channels: int = 4) -> DataFrame:
    """(blocks' columns without body, tx, ty, tile): blocks (body, cols, rows) of several tiles as one buffer, sliced by its stride. A buffer of another size gives no tiles (tile null, tx and ty -1)."""
    kind = T.ArrayType(T.StructType([T.StructField("tx", T.IntegerType()), T.StructField("ty", T.IntegerType()), T.StructField("tile", T.BinaryType())]))

    @F.pandas_udf(kind)
    def cut(body: pd.Series, cols: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for b, c, r in zip(body, cols, rows, strict=True):
            px = _pixels(b, r * dim, c * dim, channels)
            out.append([{"tx": -1, "ty": -1, "tile": None}] if px is None else [{"tx": x, "ty": y, "tile": px[y * dim : (y + 1) * dim, x * dim : (x + 1) * dim].tobytes()} for x in range(c) for y in range(r)])
        return pd.Series(out, dtype=object)

    return blocks.withColumn("_t", F.explode(cut("body", "cols", "rows"))).select(*(c for c in blocks.columns if c != "body"), "_t.*")


def affn_payload(c: tuple[float, ...]) -> bytes:
    """What an AFFN section holds: the six coefficients lon0, lon/px, lon/py, lat0, lat/px, lat/py as little-endian doubles."""
    if len(c) != 6 or not all(np.isfinite(c)):
        raise ValueError("six finite coefficients are needed")
    return struct.pack("<6d", *c)


def read_affn(payload: bytes) -> tuple[float, ...]:
    if len(payload) != 48:
        raise ValueError("AffnLength")
    c = struct.unpack("<6d", payload)
    if not all(np.isfinite(c)):
        raise ValueError("AffnNotFinite")
    return c


@F.pandas_udf(T.StringType())
def double_bits(c: pd.Series) -> pd.Series:
    """A double's 64 bits as hex, high ones first; null for null."""
    return c.map(lambda v: struct.pack(">d", v).hex(), na_action="ignore")


def drawn_tiles(images: DataFrame, tiles: DataFrame, key: str, dim: int, channels: int = 1, fill: int = NONE) -> DataFrame:
    """(key, z, x, y, body, covered): images (key, width, height, body, affn array of six) drawn into tiles (key, z, x, y) by nearest neighbour.

    Each pixel's centre is taken back to the image: latitude and longitude by the Mercator inverse, then the inverse of the affine map. Pixels outside the image are `fill`;
    covered counts the others. An image without an inverse, or of another size than it says, covers nothing."""

    @F.pandas_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("covered", T.IntegerType())]))
    def draw(body: pd.Series, width: pd.Series, height: pd.Series, affn: pd.Series, z: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for b, w, h, c, k, tx, ty in zip(body, width, height, affn, z, x, y, strict=True):
            px, buffer, good = _pixels(b, h, w, channels), np.full((dim, dim, channels), fill, np.uint8), None
            det = float(c[1]) * float(c[5]) - float(c[2]) * float(c[4])
            if px is not None and det and np.isfinite(det):
                n = float(dim << k)
                lon = (tx * dim + np.arange(dim) + 0.5) / n * 360 - 180
                lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (ty * dim + np.arange(dim) + 0.5) / n))))
                dlon, dlat = np.meshgrid(lon - c[0], lat - c[3])
                col, row = np.floor((dlon * c[5] - dlat * c[2]) / det), np.floor((dlat * c[1] - dlon * c[4]) / det)
                good = (col >= 0) & (col < w) & (row >= 0) & (row < h)
                buffer[good] = px[row[good].astype(int), col[good].astype(int)]
            out.append((buffer.tobytes(), 0 if good is None else int(good.sum())))
        return pd.DataFrame(out, columns=["body", "covered"])

    held = images.select(F.col(key).alias("_key"), "width", "height", "body", "affn")
    j = tiles.join(held, F.col(key) == F.col("_key"))
    return j.select(key, "z", "x", "y", draw("body", "width", "height", "affn", "z", "x", "y").alias("d")).select(key, "z", "x", "y", "d.*")
