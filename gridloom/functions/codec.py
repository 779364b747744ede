"""Byte codecs and hashes: run-length coding, little-endian fields, CRC-32, FNV-1a, UUIDv5."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.slices import bodies, slices

#: The namespace of pack identities, a fixed value.
NAMESPACE = "4e72f962663245388e0a7eab63350f3f"


def rle8(data: bytes) -> bytes:
    """Runs of 3 to 128 as (0x80 | n - 1, byte); all else as literals of up to 128 behind n - 1."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return b""
    edge = np.flatnonzero(np.diff(b)) + 1
    starts = np.concatenate(([0], edge))
    lengths = np.diff(np.append(starts, len(b)))
    out, pending = bytearray(), 0  # start of the literals not yet written

    def literals(upto: int) -> None:
        nonlocal pending
        while pending < upto:
            n = min(128, upto - pending)
            out.append(n - 1)
            out.extend(data[pending : pending + n])
            pending += n

    for s, n in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        while n >= 3:
            k = min(128, n)
            literals(s)
            out.extend((0x80 | (k - 1), data[s]))
            s, n = s + k, n - k
            pending = s
    literals(len(b))
    return bytes(out)


def unrle8(data: bytes, n: int, lenient: bool = False) -> tuple[bytes | None, str | None]:
    """(n bytes, None) or (None, what is wrong). Lenient: the last block may be longer than what is left."""
    out, at = bytearray(), 0
    while len(out) < n:
        if at >= len(data):
            return None, "OutputLengthMismatch"  # a clean cut between two blocks
        head, at = data[at], at + 1
        k = (head & 0x7F) + 1
        size = 1 if head & 0x80 else k
        if at + size > len(data):
            return None, "UnexpectedEnd"
        out += data[at : at + 1] * k if head & 0x80 else data[at : at + k]
        at += size
    if len(out) > n and not lenient:
        return None, "OutputLengthMismatch"
    if n == 0 and data and not lenient:
        return None, "OutputLengthMismatch"
    return bytes(out[:n]), None


@F.arrow_udf(T.BinaryType())
def rle8_encode(body: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for (some,) in slices((b,) for b in body):
        yield pa.array([None if x is None else rle8(x) for x in bodies(some)], pa.binary())


@F.arrow_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("error", T.StringType())]))
def rle8_decode(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for body, n in slices(columns):
        found = [(None, None) if x is None else unrle8(x, k) for x, k in zip(bodies(body), n.to_pylist(), strict=True)]
        yield pa.array([{"body": b, "error": e} for b, e in found], pa.struct([("body", pa.binary()), ("error", pa.string())]))


@F.arrow_udf(T.LongType())
def deflated_size(body: pa.Array) -> pa.Array:
    return pa.array([None if x is None else len(zlib.compress(x, 9)) for x in bodies(body)], pa.int64())


def le_hex(value: Column, size: int) -> Column:
    """Hex of an unsigned number as `size` little-endian bytes."""
    h = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))))


def uuid5_hex(name: Column) -> Column:
    """UUIDv5 of a string in NAMESPACE, as hex with hyphens."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def fnv1a(bytes_array: Column) -> Column:
    """32-bit FNV-1a of an array of byte values."""
    return F.aggregate(bytes_array, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(4294967295))


def json_string(s: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped, all else verbatim."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for c in range(32):
        out = F.replace(out, F.lit(chr(c)), F.lit(short.get(c, f"\\u{c:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))
