"""Single-file tile pyramids (PMTiles, version 3): built from tiles, and read as relations.

Directories list tiles by their ids along the Hilbert curve: numbers of 7 bits a byte, ids as differences, runs of ids that share a body, and offsets that are
0 where a body follows the one before. Entries of run length 0 point to leaf directories: these become rows, dealt
over tasks and read by the range of bytes that they take, level after level, so a big archive is read by many tasks and never as a whole. Only
what is listed is read; bodies come with with_bodies()."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import hilbert
from gridloom.sources.ranged import listed, opened, read_range

#: Fixed values of the format: header, compressions, depth of leaf directories.
MAGIC, HEADER, DEPTH = b"PMTiles\x03", 127, 4
_HEADER = struct.Struct("<8s11QBBBBBBiiiiBii")
COMPRESSIONS, NONE, GZIP = ("unknown", "none", "gzip", "brotli", "zstd"), 1, 2
ENTRY = "array<struct<id:bigint,run:bigint,offset:bigint,length:bigint>>"


def varints(values: np.ndarray) -> bytes:
    """Numbers of 7 bits a byte, low ones first."""
    v = np.asarray(values, np.uint64)
    parts = (v[:, None] >> np.arange(0, 70, 7, dtype=np.uint64)[None, :].clip(max=63)) & np.uint64(127)  # the tenth byte has bit 63 alone
    size = np.maximum(1, ((parts != 0) * np.arange(1, 11)).max(1, initial=0))
    more = np.arange(10)[None, :] < (size - 1)[:, None]
    return (parts.astype(np.uint8) | (more * 128).astype(np.uint8))[np.arange(10)[None, :] < size[:, None]].tobytes()


def unvarints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(b) or not len(ends) or ends[-1] != len(b) - 1:
        raise ValueError("VarintTruncated")
    starts = np.concatenate(([0], ends[:-1] + 1))
    if (ends - starts).max() > 9:
        raise ValueError("VarintTooLong")
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.bitwise_or.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def write_directory(id_: np.ndarray, run: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """A directory, not compressed; entries in the order of their ids."""
    follows = np.concatenate(([False], offset[1:] == offset[:-1] + length[:-1]))
    columns = np.diff(id_, prepend=0), run, length, np.where(follows, 0, offset + 1)
    return varints(np.concatenate(([len(id_)], *columns)))


def read_directory(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, runs, offsets, lengths) of a directory, not compressed; raises ValueError where it breaks the format."""
    v = unvarints(data).astype(np.int64)
    n = int(v[0])
    if len(v) != 1 + 4 * n or n < 1:
        raise ValueError("DirectoryLength")
    step, run, length, at = v[1:].reshape(4, n)
    if at[0] == 0:
        raise ValueError("FirstOffset")
    if (step[1:] <= 0).any() or (length <= 0).any():
        raise ValueError("DirectoryOrder")
    # A body behind the one before: its offset is that of the last one given plus all lengths since.
    given = np.maximum.accumulate(np.where(at > 0, np.arange(n), 0))
    before = np.concatenate(([0], np.cumsum(length)[:-1]))
    return np.cumsum(step), run, (at[given] - 1) + before - before[given], length


def _packed(data: bytes, how: int) -> bytes:
    return gzip.compress(data, 6, mtime=0) if how == GZIP else data


def _unpacked(data: bytes, how: int) -> bytes:
    if how not in (NONE, GZIP):
        raise ValueError(f"Compression {COMPRESSIONS[how] if how < len(COMPRESSIONS) else how}")
    return gzip.decompress(data) if how == GZIP else data


def build_archive(tiles: list[tuple[int, int, int, bytes]], compression: int = GZIP, leaf: int = 4096, tile_type: int = 2, root_most: int = 16_384 - HEADER) -> bytes:
    """An archive of (z, x, y, body); equal bodies are stored once, ids that follow each other with one body are one run, and entries beyond `leaf` go to leaf directories."""
    at = hilbert.ids(*(np.array([t[k] for t in tiles], np.int64) for k in range(3))) if tiles else np.zeros(0, np.int64)
    if (at < 0).any() or len(np.unique(at)) < len(at):
        raise ValueError("TileId")
    places, data, rows = {}, bytearray(), []
    for k in np.argsort(at):
        body = bytes(tiles[k][3])
        if not body:
            raise ValueError("EmptyTile")
        if body not in places:
            places[body] = len(data)
            data += body
        if rows and rows[-1][0] + rows[-1][1] == at[k] and rows[-1][2] == places[body]:
            rows[-1][1] += 1
        else:
            rows.append([int(at[k]), 1, places[body], len(body)])
    table, leaves = np.array(rows, np.int64).reshape(-1, 4), b""
    entries = len(table)
    root = _packed(write_directory(*table.T), compression) if entries else b""
    while entries > leaf or len(root) > root_most:
        blocks = [table[a : a + leaf] for a in range(0, len(table), leaf)]
        coded = [_packed(write_directory(*b.T), compression) for b in blocks]
        begin = len(leaves) + np.concatenate(([0], np.cumsum([len(c) for c in coded])[:-1]))
        leaves += b"".join(coded)
        table = np.column_stack(([b[0, 0] for b in blocks], np.zeros(len(blocks), np.int64), begin, [len(c) for c in coded]))
        entries, root = len(table), _packed(write_directory(*table.T), compression)
        if len(blocks) <= leaf and len(root) <= root_most:
            break
    zooms = [t[0] for t in tiles] or [0]
    starts = np.cumsum([HEADER, len(root), 0, len(leaves), len(data)])
    head = _HEADER.pack(MAGIC, starts[0], len(root), starts[1], 0, starts[2], len(leaves), starts[3], len(data), len(tiles), len(rows), len(places), 1, compression, NONE, tile_type, min(zooms), max(zooms), -1_800_000_000, -850_000_000, 1_800_000_000, 850_000_000, min(zooms), 0, 0)
    return head + root + leaves + bytes(data)


def read_header(data: bytes) -> dict:
    if len(data) < HEADER:
        raise ValueError("TooShort")
    f = _HEADER.unpack(data[:HEADER])
    if f[0] != MAGIC:
        raise ValueError("BadMagic")
    names = ("root_at", "root_size", "meta_at", "meta_size", "leaf_at", "leaf_size", "data_at", "data_size", "tiles", "entries", "bodies", "clustered", "directories", "compression", "tile_type", "zmin", "zmax")
    return dict(zip(names, f[1:18], strict=True))


def _rows(found: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    """Rows (key, leaf_at, data_at, how, entries, issue)."""
    flat = [[dict(zip(("id", "run", "offset", "length"), map(int, e), strict=True)) for e in zip(*r[4], strict=True)] if r[4] is not None else None for r in found]
    entry = pa.list_(pa.struct([(c, pa.int64()) for c in ("id", "run", "offset", "length")]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], kind), *(pa.array([r[k] for r in found], pa.int64()) for k in (1, 2, 3)), pa.array(flat, entry), pa.array([r[5] for r in found], pa.string())], [key, "leaf_at", "data_at", "how", "entries", "issue"])


def entries(archives: DataFrame, key: str = "path", data: str | None = None) -> DataFrame:
    """(key, id, run, offset, length, issue): what the directories of archives list; offsets count from the start of the file.

    archives has the file's URI in column key or, where `data` names a column, its bytes there. A file or directory that breaks the format gives one row with its issue. Leaf directories are followed
    DEPTH levels down, and a level is one pass over those of all files."""
    kind = archives.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, leaf_at bigint, data_at bigint, how bigint, entries {ENTRY}, issue string"
    arrow_kind = _arrow(kind)

    def fetch(own, held, start: int, size: int) -> bytes:
        if data:
            if held is None or len(held) < size:
                raise ValueError("TooShort")
            return held[:size]
        with opened(own) as f:
            return read_range(f, start, size)

    def roots(batches):
        for batch in batches:
            found = []
            none = [None] * batch.num_rows
            for own, head, root in zip(batch.column(0).to_pylist(), *((batch.column(k).to_pylist() for k in (1, 2)) if data else (none, none)), strict=True):
                try:
                    h = read_header(fetch(own, head, 0, HEADER))
                    listed_ = read_directory(_unpacked(fetch(own, root, h["root_at"], h["root_size"]), h["directories"])) if h["root_size"] else None
                    found.append((own, h["leaf_at"], h["data_at"], h["directories"], listed_, None))
                except (ValueError, OSError) as e:
                    found.append((own, None, None, None, None, str(e)))
            yield _rows(found, key, arrow_kind)

    def leaves(batches):
        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for own, leaf_at, data_at, how, start, size, held in zip(*columns[:6], columns[6] if data else [None] * batch.num_rows, strict=True):
                try:
                    found.append((own, leaf_at, data_at, how, read_directory(_unpacked(fetch(own, held, leaf_at + start, size), how)), None))
                except (ValueError, OSError) as e:
                    found.append((own, leaf_at, data_at, how, None, str(e)))
            yield _rows(found, key, arrow_kind)

    # Of bytes in a column Python gets the header and a directory at a time, never an archive.
    field = lambda k: F.conv(F.concat(*(F.hex(F.substring(data, 9 + 8 * k + b, 1)) for b in reversed(range(8)))), 16, 10)
    level = archives.select(key, *([F.substring(data, 1, HEADER).alias("_head"), _bytes(data, field(0), field(1)).alias("_root")] if data else [])).mapInArrow(roots, schema)
    out = None
    for depth in range(DEPTH):
        each = level.select(key, "leaf_at", "data_at", "how", "issue", F.explode_outer("entries").alias("e"))
        tiles = each.where("issue is not null or e.run > 0").select(key, "e.id", "e.run", (F.col("e.offset") + F.col("data_at")).alias("offset"), "e.length", "issue")
        out = tiles if out is None else out.union(tiles)
        deeper = each.where("e.run = 0").select(key, "leaf_at", "data_at", "how", F.col("e.offset").alias("_at"), F.col("e.length").alias("_size"))
        if depth + 1 == DEPTH:
            return out.union(deeper.select(key, *(F.lit(None).cast("bigint").alias(c) for c in ("id", "run", "offset", "length")), F.lit("LeafDepth").alias("issue")))
        if data:
            held = deeper.join(archives.select(F.col(key).alias("_key"), data), F.col(key).eqNullSafe(F.col("_key")))
            deeper = held.select(*deeper.columns, _bytes(data, F.col("leaf_at") + F.col("_at"), F.col("_size")).alias("_leaf"))
        else:
            deeper = deeper.repartition(F.xxhash64(key, "_at"))  # leaves of one file go to many tasks
        level = deeper.mapInArrow(leaves, schema)
    raise AssertionError("the last depth returns")


def _bytes(data: str, start: Column, size: Column) -> Column:
    """`size` bytes of a column from `start` on, both from 0; null where these are no places in a value."""
    at, n = (F.try_add(c.try_cast("int"), F.lit(k)) for c, k in ((start, 1), (size, 0)))
    return F.when((at > 0) & (n >= 0), F.substring(data, at, n))


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]


def read_tiles(archives: DataFrame, key: str = "path", data: str | None = None) -> DataFrame:
    """(key, z, x, y, id, offset, length, issue): a row for each tile, runs told out."""
    listed_ = entries(archives, key, data)
    each = listed_.withColumn("_k", F.explode(F.when(F.col("issue").isNull(), F.sequence(F.lit(0).cast("bigint"), F.col("run") - 1)).otherwise(F.array(F.lit(0).cast("bigint")))))
    each = each.withColumn("id", F.col("id") + F.col("_k"))
    return each.withColumn("t", F.when(F.col("issue").isNull(), hilbert.tile_of(F.coalesce("id", F.lit(-1).cast("bigint"))))).select(key, "t.z", "t.x", "t.y", "id", "offset", "length", "issue")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the archives at or below a path."""
    return spark.createDataFrame([(p,) for p in listed(path) if p.endswith(".pmtiles")], "path string")


def with_bodies(tiles: DataFrame, key: str = "path") -> DataFrame:
    """tiles with column body, read by range from the file that each names."""
    schema = T.StructType([*tiles.schema.fields, T.StructField("body", T.BinaryType())])
    names = tiles.columns

    def run(batches):
        for batch in batches:
            at = {c: batch.column(names.index(c)).to_pylist() for c in (key, "offset", "length")}
            body, files = [], {}
            for own, start, size in zip(*at.values(), strict=True):
                if start is None:
                    body.append(None)
                    continue
                if own not in files:
                    files[own] = opened(own)
                body.append(read_range(files[own], start, size))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(body, pa.binary())], [*names, "body"])

    return tiles.mapInArrow(run, schema)


def build_archives(tiles: DataFrame, most_bytes: int = 64 << 20, **how) -> DataFrame:
    """tiles (archive_id, z, x, y, body) as (archive_id, part, archive): a group makes as many parts as most_bytes asks for."""
    size = tiles.groupBy("archive_id").agg(F.ceil(F.sum(F.octet_length("body") + 24) / most_bytes).cast("int").alias("parts")).withColumnRenamed("archive_id", "_id")
    dealt = tiles.join(size, F.col("archive_id").eqNullSafe(F.col("_id"))).withColumn("part", F.pmod(F.xxhash64("z", "x", "y"), F.greatest("parts", F.lit(1))).cast("int"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(z), int(x), int(y), bytes(b)) for z, x, y, b in zip(t["z"], t["x"], t["y"], t["body"], strict=True)]
        return pd.DataFrame({"archive_id": t["archive_id"][:1], "part": t["part"][:1], "archive": [build_archive(rows, **how)]})

    return dealt.groupBy("archive_id", "part").applyInPandas(run, f"archive_id {tiles.schema['archive_id'].dataType.simpleString()}, part int, archive binary")
