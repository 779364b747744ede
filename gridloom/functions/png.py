"""PNG images in binary columns: pixels of a column of files, and a plain writer of grey images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.slices import bodies, slices

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_grey(data: bytes, width: int) -> bytes:
    """An 8-bit grey PNG whose samples are data, whose length is a positive multiple of width."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    body = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body)) + _chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of bytes with each row's prediction added back."""
    out = np.zeros((len(raw) + 1, raw.shape[1] + bpp), np.int32)  # a row above and a pixel to the left of zeros
    for y, (row, kind) in enumerate(zip(raw.astype(np.int32), kinds.tolist(), strict=True), 1):
        above = out[y - 1]
        if kind == 0:
            out[y, bpp:] = row
        elif kind == 1:
            for k in range(bpp):
                out[y, bpp + k :: bpp] = np.cumsum(row[k::bpp]) & 255
        elif kind == 2:
            out[y, bpp:] = (row + above[bpp:]) & 255
        elif kind in (3, 4):
            for x in range(bpp, len(above)):
                a, b, c = int(out[y, x - bpp]), int(above[x]), int(above[x - bpp])
                p = a + b - c
                guess = (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, x] = (row[x - bpp] + guess) & 255
        else:
            raise ValueError("filter")
    return out[1:, bpp:].astype(np.uint8)


def read_rgb(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGB samples): grey repeated, palettes resolved, alpha dropped, 16 bits cut to 8. ValueError if it is none of these."""
    if data[:8] != MAGIC:
        raise ValueError("magic")
    at, head, palette, body = 8, None, b"", []
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or head[0] == 0 or head[1] == 0 or head[3] not in SAMPLES or head[6]:
        raise ValueError("header")
    width, height, depth, colour = head[:4]
    n = SAMPLES[colour]
    stride = (width * n * depth + 7) // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    flat = _unfiltered(rows[:, 1:], rows[:, 0], max(1, n * depth // 8))
    if depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        flat = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : width * n]
        flat = flat if colour == 3 else flat * (255 // ((1 << depth) - 1))
    elif depth == 16:
        flat = flat[:, ::2]
    px = flat.reshape(height, width, n)
    if colour == 3:
        px = np.frombuffer(palette, np.uint8).reshape(-1, 3)[px[:, :, 0]]
    elif n < 3:
        px = np.repeat(px[:, :, :1], 3, axis=2)
    return width, height, np.ascontiguousarray(px[:, :, :3]).tobytes()


def _decoded(data: bytes | None) -> tuple:
    if not data:
        return None, None, None, "Empty"
    try:
        return *read_rgb(bytes(data)), None
    except (ValueError, IndexError, struct.error, zlib.error):
        return None, None, None, "DecodeFailed"


_KIND = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgb888", pa.binary()), ("error", pa.string())])


@F.arrow_udf(T.StructType([T.StructField(k, t) for k, t in (("width", T.IntegerType()), ("height", T.IntegerType()), ("rgb888", T.BinaryType()), ("error", T.StringType()))]))
def decoded(body: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Pixels of each file, or what is wrong: a bad file is a row, not a failed job. Files go in slices, as pixels may take many times their bytes."""
    for (some,) in slices((b,) for b in body):
        yield pa.array([dict(zip(("width", "height", "rgb888", "error"), _decoded(x), strict=True)) for x in bodies(some)], _KIND)


@F.arrow_udf(T.BinaryType())
def grey_png(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for body, width in slices(columns):
        yield pa.array([write_grey(x, w) for x, w in zip(bodies(body), width.to_pylist(), strict=True)], pa.binary())
