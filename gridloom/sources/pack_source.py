"""Pack files as a data source: spark.read.format("tilepack").load(path), after register(spark).

A partition is a range of index entries of one file, so a big pack is read by many tasks and a body only by the one that returns it. Filters on
z, x and y are pushed: the header's zoom directory gives a zoom's entries, and as these are in the order of x and y, a
binary search over 20-byte entries narrows them; partitions that can't match aren't made. Bodies are read only with option bodies, as
Spark hands a Python source no list of columns. A pack that breaks a rule of the header fails the read, or gives one row with its issue in
mode permissive; with option lengths an uncompressed body that isn't tile_dim ** 2 bytes long is an issue of its row.

Options: bodies (false), mode (failfast), lengths (false), entries (most entries of a partition, 65536)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.sources.packs import _FRONT, ENTRY, HEADER, MAGIC, MAJOR, ZOOMS
from gridloom.sources.ranged import listed, opened, read_range, spans

INDEX = np.dtype([("z", "u1"), ("compression", "u1"), ("flags", "u1"), ("reserved", "u1"), ("x", "<u4"), ("y", "<u4"), ("offset", "<u4"), ("length", "<u4")])
COLUMNS = "path string, seq long, z int, x long, y long, compression int, offset long, length long"
MOST, BATCH = (1 << 32) - 1, 1024


@dataclass
class Entries(InputPartition):
    """Entries first to last - 1 of a file, or what is wrong with it."""

    path: str
    first: int
    last: int
    dim: int
    end: int
    issue: str | None = None


@dataclass
class Bounds:
    """The least and most z, x and y asked for, and the only ones if these were listed."""

    low: dict
    high: dict
    only: dict

    def narrow(self, f: Filter) -> bool:
        """Whether this filter is understood; it is then taken into account."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name not in self.low:
            return False
        if isinstance(f, In):
            values = {v for v in f.value if v is not None}
            self.only[name] = values & self.only.get(name, values)
            low, high = min(values, default=1), max(values, default=0)
        elif isinstance(f, EqualTo):
            low = high = f.value
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            low, high = f.value + isinstance(f, GreaterThan), MOST
        elif isinstance(f, LessThan | LessThanOrEqual):
            low, high = 0, f.value - isinstance(f, LessThan)
        else:
            return False
        self.low[name], self.high[name] = max(self.low[name], low), min(self.high[name], high)
        return True

    def holds(self, e: np.ndarray) -> np.ndarray:
        good = np.ones(len(e), bool)
        for name in self.low:
            good &= (e[name] >= self.low[name]) & (e[name] <= self.high[name])
            if name in self.only:
                good &= np.isin(e[name], list(self.only[name]))
        return good


def header(data: bytes) -> tuple:
    """The fields of a header and its zoom slots (offset of the first entry, entries); raises ValueError with the first rule that fails."""
    f = _FRONT.unpack_from(data)
    rules = (("BadMagic", f[0] != MAGIC), ("MajorVersion", f[1] != MAJOR), ("PackUuidZero", not any(f[4])), ("TileDim", f[11] < 1), ("ZoomRange", f[13] < f[12]), ("IndexOffset", f[20] != HEADER))
    for name, bad in rules:
        if bad:
            raise ValueError(name)
    return f, [struct.unpack_from("<II", data, 96 + 8 * z) for z in range(ZOOMS)]


def placed(file, first: int, last: int, key: tuple[int, int, int]) -> int:
    """The first of these entries whose key is not below this one."""
    while first < last:
        mid = (first + last) // 2
        e = struct.unpack("<BBBBIIII", read_range(file, HEADER + ENTRY * mid, ENTRY))
        first, last = (mid + 1, last) if (e[0], e[4], e[5]) < key else (first, mid)
    return first


class PackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("load() needs a path")
        self.bodies, self.lengths = (options.get(k, "false").lower() == "true" for k in ("bodies", "lengths"))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.most = int(options.get("entries", 1 << 16))
        self.bounds = Bounds(dict.fromkeys("zxy", 0), dict(z=ZOOMS - 1, x=MOST, y=MOST), {})

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.bounds.narrow(f):
                yield f

    def partitions(self) -> list[Entries]:
        return [p for path in listed(self.path) for p in self._of(path)]

    def _of(self, path: str) -> list[Entries]:
        try:
            with opened(path) as file:
                size = file.size()
                if size < HEADER + 4:
                    raise ValueError("TooShort")
                f, slots = header(read_range(file, 0, HEADER))
                if HEADER + ENTRY * f[19] > size:
                    raise ValueError("IndexOutOfBounds")
                out, b = [], self.bounds
                for z in range(b.low["z"], min(b.high["z"], ZOOMS - 1) + 1):
                    at, n = slots[z]
                    if not n or z not in b.only.get("z", {z}):
                        continue
                    first = (at - HEADER) // ENTRY
                    last = first + n
                    if at < HEADER or (at - HEADER) % ENTRY or last > f[19]:
                        raise ValueError("ZoomDirectory")
                    if b.low["x"] or b.low["x"] == b.high["x"]:
                        first = placed(file, first, last, (z, b.low["x"], b.low["y"] if b.low["x"] == b.high["x"] else 0))
                    if b.high["x"] < MOST:
                        last = placed(file, first, last, (z, b.high["x"], b.high["y"] + 1) if b.low["x"] == b.high["x"] else (z, b.high["x"] + 1, 0))
                    out += [Entries(path, a, e, f[11], size - 4) for a, e in spans(first, last, self.most)]
                return out
        except ValueError as e:
            if not self.permissive:
                raise ValueError(f"{path}: {e}") from None
            return [Entries(path, 0, 0, 0, 0, str(e))]

    def read(self, part: Entries | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing was planned
            return
        names = [c.split()[0] for c in COLUMNS.split(", ")] + ["body"] * self.bodies + ["issue"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * self.bodies + [pa.string()]
        if part.issue:
            yield pa.RecordBatch.from_arrays([pa.array([part.path])] + [pa.nulls(1, k) for k in kinds[1:-1]] + [pa.array([part.issue])], names)
            return
        with opened(part.path) as file:
            for a, b in spans(part.first, part.last, BATCH):
                e = np.frombuffer(read_range(file, HEADER + ENTRY * a, ENTRY * (b - a)), INDEX)
                keep = self.bounds.holds(e)
                e, seq = e[keep], np.arange(a, b)[keep]
                if not len(e):
                    continue
                stop = e["offset"].astype(np.int64) + e["length"]
                issue = np.select([e["compression"] > 1, e["flags"] != 0, e["reserved"] != 0, stop > part.end], ["Compression", "Flags", "Reserved", "TileOutOfBounds"], "").astype(object)
                if self.lengths:
                    issue[(issue == "") & (e["compression"] == 0) & (e["length"] != part.dim**2)] = "TileLength"
                bad = issue != ""
                if bad.any() and not self.permissive:
                    raise ValueError(f"{part.path}: entry {seq[bad][0]}: {issue[bad][0]}")
                columns = [[part.path] * len(e), seq, e["z"], e["x"], e["y"], e["compression"], e["offset"], e["length"]]
                if self.bodies:
                    columns.append([None if s > part.end else read_range(file, int(o), int(n)) for o, n, s in zip(e["offset"], e["length"], stop, strict=True)])
                columns.append([x or None for x in issue])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()) if isinstance(c, np.ndarray) else c, k) for c, k in zip(columns, kinds, strict=True)], names)


class TilePacks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilepack"

    def schema(self) -> str:
        return COLUMNS + (", body binary" if self.options.get("bodies", "false").lower() == "true" else "") + ", issue string"

    def reader(self, schema) -> PackReader:
        return PackReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to this session, and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TilePacks)
