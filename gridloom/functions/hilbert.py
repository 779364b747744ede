"""Tile ids along a Hilbert curve, zoom after zoom: both ways, on whole columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The deepest zoom whose ids fit in 63 bits.
DEEPEST = 31


def first_id(z: np.ndarray | int):
    """The id of a zoom's first tile: the tiles of all zooms above it."""
    return ((1 << (2 * np.asarray(z, np.int64))) - 1) // 3


def _turned(x, y, rx, ry, side):
    """Coordinates within a quarter, as the curve runs through it."""
    flip = (ry == 0) & (rx == 1)
    x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
    return np.where(ry == 0, y, x), np.where(ry == 0, x, y)


def ids(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """-1 for a tile that doesn't exist."""
    z, x, y = (np.asarray(v, np.int64) for v in (z, x, y))
    good = (z >= 0) & (z <= DEEPEST)
    zz = np.where(good, z, 0)
    good &= (x >= 0) & (y >= 0) & (x < 1 << zz) & (y < 1 << zz)
    out = first_id(zz)
    for level in range(int(zz.max(initial=0)) - 1, -1, -1):
        here = level < zz
        side = np.int64(1) << level
        rx, ry = (x >> level) & 1, (y >> level) & 1
        out = out + np.where(here, side * side * ((3 * rx) ^ ry), 0)
        tx, ty = _turned(x & (side - 1), y & (side - 1), rx, ry, side)
        x, y = np.where(here, tx, x), np.where(here, ty, y)
    return np.where(good, out, -1)


def tiles(i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, x, y) of ids; (-1, -1, -1) for a negative one."""
    i = np.asarray(i, np.int64)
    z = np.searchsorted(first_id(np.arange(DEEPEST + 1)), i, "right") - 1
    zz = np.maximum(z, 0)
    d = i - first_id(zz)
    x, y = np.zeros_like(d), np.zeros_like(d)
    for level in range(int(zz.max(initial=0))):
        side = np.int64(1) << level
        rx = (d >> (2 * level + 1)) & 1
        ry = ((d >> (2 * level)) ^ rx) & 1
        here = level < zz
        tx, ty = _turned(x, y, rx, ry, side)
        x, y = np.where(here, tx + side * rx, x), np.where(here, ty + side * ry, y)
    return tuple(np.where(z >= 0, v, -1) for v in (z, x, y))


@F.pandas_udf(T.LongType())
def tile_id(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Null for a tile that doesn't exist, or where a coordinate is null."""
    out = pd.Series(ids(*(v.fillna(-1).to_numpy(np.int64) for v in (z, x, y)))).astype("Int64")
    return out.mask(out < 0)


@F.pandas_udf(T.StructType([T.StructField("z", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))
def tile_of(i: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip("zxy", tiles(i.to_numpy(np.int64)), strict=True)))
