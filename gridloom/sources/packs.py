"""The tile-pack file: built from tiles, read back as relations, checked by rules.

A pack is header, index of 20-byte entries, bodies on multiples of 4, sorted extensions and a CRC-32
footer, all little-endian. Its format bounds it to 4 GiB; packs here are made per group of tiles, so
that one group's bytes fit in a task. read_packs() takes what spark.read.format("binaryFile") gives,
so that packs may lie wherever Spark can read.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC, MAJOR, MINOR, ZOOMS, HEADER, ENTRY = b"RAWT", 1, 0, 24, 292, 20
_FRONT = struct.Struct("<4sBBH16s16s16sBBBBHBB4iQII")


def name_payload(name: str, language: str = "") -> bytes:
    """What a NAME section holds: the language tag behind its length in one byte, then the name."""
    tag = language.encode()
    if len(tag) > 255:
        raise ValueError("TagTooLong")
    return bytes([len(tag)]) + tag + name.encode()


def read_name(payload: bytes) -> tuple[str, str]:
    """(language, name) of a NAME section."""
    if not payload:
        raise ValueError("PayloadEmpty")
    if len(payload) - 1 < payload[0]:
        raise ValueError("TagExceedsPayload")
    try:
        return payload[1 : 1 + payload[0]].decode(), payload[1 + payload[0] :].decode()
    except UnicodeDecodeError:
        raise ValueError("InvalidUtf8") from None


def build_pack(meta: dict, tiles: list[tuple[int, int, int, int, bytes]], extensions: list[tuple[bytes, bytes]] = ()) -> bytes:
    """tiles: (z, x, y, compression, body), checked as they come and then put in order; keys must be unique."""
    if not any(meta["uuid"]) or any(meta.get("parent", b"")) or meta["tile_dim"] < 1 or meta["zmax"] < meta["zmin"]:
        raise ValueError("InvalidMetadata")
    keys = set()
    for z, x, y, _, body in tiles:
        if not meta["zmin"] <= z <= meta["zmax"]:
            raise ValueError("ZoomOutOfRange")
        if z >= ZOOMS:
            raise ValueError("ZoomTooHigh")
        if len(body) >= 1 << 32:
            raise ValueError("TileTooLarge")
        if (z, x, y) in keys:
            raise ValueError("DuplicateTile")
        keys.add((z, x, y))
    tiles = sorted(tiles, key=lambda t: t[:3])
    pad = lambda b: b + bytes(-len(b) % 4)
    at = HEADER + ENTRY * len(tiles)
    at += -at % 4
    index, bodies, slots = [], [], [[0, 0] for _ in range(ZOOMS)]
    for n, (z, x, y, how, body) in enumerate(tiles):
        if not slots[z][1]:
            slots[z][0] = HEADER + ENTRY * n
        slots[z][1] += 1
        index.append(struct.pack("<BBBBIIII", z, how, 0, 0, x, y, at, len(body)))
        bodies.append(pad(body))
        at += len(bodies[-1])
        if at >= 1 << 32:
            raise ValueError("OffsetOverflow")
    ext = b"".join(pad(tag + struct.pack("<I", len(p)) + p) for tag, p in sorted(extensions))
    front = _FRONT.pack(MAGIC, MAJOR, MINOR, 0, meta["uuid"], bytes(16), bytes(16), meta["pixel_format"], 1, 1, 1, meta["tile_dim"], meta["zmin"], meta["zmax"], *meta["bbox"], meta["timestamp"], len(tiles), HEADER)
    head = front + b"".join(struct.pack("<II", *s) for s in slots) + struct.pack("<I", at)  # extensions start where the bodies end, be there any or not
    data = pad(head + b"".join(index)) + b"".join(bodies) + ext
    return data + struct.pack("<I", zlib.crc32(data))


def open_pack(data: bytes) -> dict:
    """Header, entries, zoom slots and extensions; raises ValueError with the first rule that fails."""
    if len(data) < HEADER + 4:
        raise ValueError("TooShort")
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("CrcMismatch")
    f = _FRONT.unpack_from(data)
    rules = (("BadMagic", f[0] != MAGIC), ("MajorVersion", f[1] != MAJOR), ("PackUuidZero", not any(f[4])), ("ParentNotZero", any(f[6])), ("PixelFormat", f[7] not in (1, 2)), ("Projection", f[8] not in (1, 3)), ("Addressing", f[9] not in (1, 2)), ("Axis", f[10] not in (1, 2)), ("TileDim", f[11] < 1), ("ZoomRange", f[13] < f[12]), ("IndexOffset", f[20] != HEADER))
    for name, bad in rules:
        if bad:
            raise ValueError(name)
    n, end = f[19], len(data) - 4
    if HEADER + ENTRY * n > len(data):
        raise ValueError("IndexOutOfBounds")
    entries = [struct.unpack_from("<BBBBIIII", data, HEADER + ENTRY * k) for k in range(n)]
    for e in entries:
        for name, bad in (("Compression", e[1] > 1), ("Flags", e[2]), ("Reserved", e[3]), ("TileOutOfBounds", e[6] + e[7] > end)):
            if bad:
                raise ValueError(name)
    slots = [struct.unpack_from("<II", data, 96 + 8 * z) for z in range(ZOOMS)]
    at, extensions = struct.unpack_from("<I", data, 288)[0], []
    if at > end:
        raise ValueError("ExtensionsOffsetOutOfBounds")
    while at < end:
        if at + 8 > end:
            raise ValueError("ExtensionTruncated")
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("ExtensionLength")
        extensions.append((data[at : at + 4], data[at + 8 : at + 8 + size]))
        stop = at + 8 + size
        at = stop + -stop % 4
        if any(data[stop:at]):
            raise ValueError("ExtensionPadding")
    return {"header": f, "entries": entries, "slots": slots, "extensions": extensions}


def build_packs(tiles: DataFrame, tile_dim: int = 16, most_bytes: int = 64 << 20) -> DataFrame:
    """tiles (pack_id, z, x, y, compression, body) as (pack_id, part, pack): a group's tiles make as many parts as most_bytes asks for."""
    size = tiles.groupBy("pack_id").agg(F.ceil(F.sum(F.length("body") + 24) / most_bytes).cast("int").alias("parts"))
    dealt = tiles.join(size, "pack_id").withColumn("part", F.pmod(F.xxhash64("z", "x", "y"), F.greatest("parts", F.lit(1))).cast("int"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        name = f"{t['pack_id'].iat[0]}/{t['part'].iat[0]}"
        meta = {"uuid": struct.pack("<QQ", zlib.crc32(name.encode()), 1), "pixel_format": 1, "tile_dim": tile_dim, "zmin": int(t["z"].min()), "zmax": int(t["z"].max()), "bbox": (-180_000_000, -85_000_000, 180_000_000, 85_000_000), "timestamp": 0}
        rows = [(int(z), int(x), int(y), int(c), bytes(b)) for z, x, y, c, b in zip(t["z"], t["x"], t["y"], t["compression"], t["body"], strict=True)]
        return pd.DataFrame({"pack_id": t["pack_id"][:1], "part": t["part"][:1], "pack": [build_pack(meta, rows, [(b"NAME", name_payload(name))])]})

    kind = tiles.schema["pack_id"].dataType.simpleString()
    return dealt.groupBy("pack_id", "part").applyInPandas(run, f"pack_id {kind}, part int, pack binary")


def read_packs(packs: DataFrame, keys: tuple[str, ...] = ("pack_id", "part")) -> DataFrame:
    """(keys, seq, z, x, y, compression, offset, length, body, issue) of column pack; a pack that breaks a rule gives one row with the issue."""
    kinds = ", ".join(f"{k} {packs.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        for t in frames:
            rows = []
            for own, data in zip(t[list(keys)].itertuples(index=False), map(bytes, t["pack"]), strict=True):
                try:
                    rows += [(*own, n, e[0], e[4], e[5], e[1], e[6], e[7], data[e[6] : e[6] + e[7]], None) for n, e in enumerate(open_pack(data)["entries"])]
                except ValueError as e:
                    rows.append((*own, *[None] * 8, str(e)))
            yield pd.DataFrame(rows, columns=[*keys, "seq", "z", "x", "y", "compression", "offset", "length", "body", "issue"], dtype=object)

    return packs.mapInPandas(run, f"{kinds}, seq long, z int, x long, y long, compression int, offset long, length long, body binary, issue string")


def pack_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, pack) of pack files below a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("pack"))


def write_pack_file(data: bytes, path: str) -> None:
    """One pack as one file: a partial file first, then a rename, so that a reader never sees half of it."""
    import os

    part = f"{path}.partial"
    try:
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.unlink(part)
        raise
