"""One pack written by many tasks.

Two passes: the layout gives every body its offset without reading bodies, then tiles are dealt by the range of the file that their
body starts in, and each range (header, stretches of the index, stretches of bodies, extensions) is made by one task as a row of bytes with its CRC-32. The
footer's checksum comes from those of the ranges, in any order. write_pack() has each task write its rows at their places in a partial
file, and renames it once all are there, so a reader never sees half a pack and a task that runs twice writes the same bytes to the same place. No task holds more than a range and the
body that crosses its end."""

from __future__ import annotations

import os
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import tiles as layouts
from gridloom.operators.digests import joined_crc32
from gridloom.sources.packs import _FRONT, ENTRY, HEADER, MAGIC, MAJOR, MINOR, ZOOMS

RANGE, INDEX_ROWS = 8 << 20, 1 << 16
#: The largest file that offsets of 32 bits reach.
LARGEST = (1 << 32) - 1
META = {"uuid": bytes(range(1, 17)), "pixel_format": 1, "tile_dim": 16, "bbox": (-180_000_000, -85_000_000, 180_000_000, 85_000_000), "timestamp": 0}


def _extensions(extensions: list[tuple[bytes, bytes]]) -> bytes:
    parts = (tag + struct.pack("<I", len(p)) + p for tag, p in sorted(extensions))
    return b"".join(p + bytes(-len(p) % 4) for p in parts)


def _header(meta: dict, zmin: int, zmax: int, n: int, slots: list[tuple[int, int]], end: int) -> bytes:
    front = _FRONT.pack(MAGIC, MAJOR, MINOR, 0, meta["uuid"], bytes(16), bytes(16), meta["pixel_format"], 1, 1, 1, meta["tile_dim"], zmin, zmax, *meta["bbox"], meta["timestamp"], n, HEADER)
    return front + b"".join(struct.pack("<II", *s) for s in slots) + struct.pack("<I", end)


def pack_ranges(tiles: DataFrame, meta: dict = META, extensions: list[tuple[bytes, bytes]] = (), range_bytes: int = RANGE, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(pack_id, kind, start, data, crc) of tiles (pack_id, z, x, y, compression, body): the bytes of each pack, range by range, without the footer.

    kind: header, index, bodies, extensions. Keys must be unique (an error); null bodies count as empty. zmin and zmax come from the tiles unless meta has them."""
    kind = tiles.schema["pack_id"].dataType.simpleString()
    tiles = tiles.withColumn("body", F.coalesce("body", F.lit(b"")))
    index = tiles.select("pack_id", "z", "x", "y", "compression", F.octet_length("body").cast("bigint").alias("length"))
    placed = layouts.layout(index)
    box = placed.groupBy("pack_id", "z").agg(F.min("x").alias("_x"), (F.max("x") - F.min("x") + 1).alias("_w"))
    parts = layouts.with_group(placed, box, ["pack_id", "z"])
    parts = parts.withColumns({"_part": F.col("z").cast("bigint") * 4096 + F.floor((F.col("x") - F.col("_x")) * 4096.0 / F.col("_w")), "_one": F.lit(1).cast("bigint")}).drop("_x", "_w")
    placed = layouts.running_offsets(parts, ["pack_id"], ["z", "x", "y"], "_part", "_one", "seq").drop("_part", "_one")
    extra = _extensions(list(extensions))
    out = f"pack_id {kind}, kind string, start bigint, data binary, crc bigint"

    def row(t: pd.DataFrame, name: str, start: int, data: bytes) -> pd.DataFrame:
        return pd.DataFrame({"pack_id": t["pack_id"][:1], "kind": [name], "start": [start], "data": [data], "crc": [zlib.crc32(data)]})

    def heads(t: pd.DataFrame) -> pd.DataFrame:
        """The header, with the slots of the zooms, and the bytes between index and bodies; t has a row a zoom."""
        n, end, slots = int(t["n"].sum()), int(t["end"].max()), [(0, 0)] * ZOOMS
        for z, k, first in zip(t["z"], t["n"], t["first"], strict=True):
            if not 0 <= z < ZOOMS:
                raise ValueError("ZoomTooHigh")
            slots[int(z)] = (HEADER + ENTRY * int(first), int(k))
        if int(t["keys"].sum()) != n:
            raise ValueError("DuplicateTile")
        if end + len(extra) + 4 > LARGEST:
            raise ValueError("OffsetOverflow")
        zmin, zmax = meta.get("zmin", int(t["z"].min())), meta.get("zmax", int(t["z"].max()))
        if t["z"].min() < zmin or t["z"].max() > zmax:
            raise ValueError("ZoomOutOfRange")
        data = _header(meta, zmin, zmax, n, slots, end)
        after = HEADER + ENTRY * n
        return pd.concat([row(t, "header", 0, data), row(t, "index", after, bytes(-after % 4)), row(t, "extensions", end, extra)])

    def entries(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq")
        data = b"".join(struct.pack("<BBBBIIII", z, c, 0, 0, x, y, o, n) for z, c, x, y, o, n in zip(t["z"], t["compression"], t["x"], t["y"], t["offset"], t["length"], strict=True))
        return row(t, "index", HEADER + ENTRY * int(t["seq"].iat[0]), data)

    def bodies(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("offset")
        return row(t, "bodies", int(t["offset"].iat[0]), b"".join(bytes(b) + bytes(-len(b) % 4) for b in t["body"]))

    zooms = placed.groupBy("pack_id", "z").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max(F.col("offset") + layouts.align4(F.col("length"))).alias("end"), F.count_distinct("x", "y").alias("keys"))
    made = zooms.groupBy("pack_id").applyInPandas(heads, out)  # a row a zoom
    made = made.union(placed.withColumn("_k", F.floor(F.col("seq") / index_rows)).groupBy("pack_id", "_k").applyInPandas(entries, out))
    where = placed.select("pack_id", "z", "x", "y", "offset")
    dealt = layouts.with_group(tiles.select("pack_id", "z", "x", "y", "body"), where, ["pack_id", "z", "x", "y"])
    made = made.union(dealt.withColumn("_k", F.floor(F.col("offset") / range_bytes)).groupBy("pack_id", "_k").applyInPandas(bodies, out))
    return made.where(F.octet_length("data") > 0)


def footers(ranges: DataFrame) -> DataFrame:
    """(pack_id, size, crc): bytes before the footer, and the checksum that it holds."""
    sizes = ranges.groupBy("pack_id").agg(F.max(F.col("start") + F.octet_length("data")).alias("size"))
    after = layouts.with_group(ranges.select("pack_id", "start", "crc", F.octet_length("data").alias("_n")), sizes, ["pack_id"]).withColumn("_after", F.col("size") - F.col("start") - F.col("_n"))
    return layouts.with_group(sizes, joined_crc32(after, "pack_id", "crc", "_after"), ["pack_id"]).select("pack_id", "size", "crc")


def write_packs(ranges: DataFrame, folder: str) -> list[str]:
    """Files, one for each pack of ranges, in a folder that all tasks can write to; ranges is best a stored table, as it is read twice. Returns their paths.

    What a failed run leaves is a partial file, which the next run takes over."""
    os.makedirs(folder, exist_ok=True)
    ends = {r["pack_id"]: (r["size"], r["crc"]) for r in footers(ranges).collect()}  # a row a file
    named = {k: os.path.join(folder, f"{'none' if k is None else str(k).replace('/', '_')}.pack") for k in ends}
    if len(set(named.values())) < len(named):
        raise ValueError("two packs have the same file name")
    for k, (size, crc) in ends.items():
        with open(f"{named[k]}.partial", "wb") as f:
            f.truncate(size + 4)
            f.seek(size)
            f.write(struct.pack("<I", crc))

    def put(batches):
        for t in batches:
            for k, start, data in zip(t["pack_id"], t["start"], t["data"], strict=True):
                with open(f"{named[None if pd.isna(k) else k]}.partial", "r+b") as f:
                    f.seek(start)
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
            yield pd.DataFrame({"n": [len(t)]})

    ranges.select("pack_id", "start", "data").mapInPandas(put, "n long").agg(F.sum("n")).collect()
    for path in named.values():
        os.replace(f"{path}.partial", path)
    return sorted(named.values())
