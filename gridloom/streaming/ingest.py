"""Streaming forms: ordered ingestion that rejects late keys, per-host request schedules, running checksums and windowed counts."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.streaming.ordered import in_order


def ordered_ingest(stream: DataFrame, group: str = "pack_id", time: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(pack_id, z, x, y, accepted): a tile is accepted if its key is above the group's last accepted one, in arrival order `seq`; with `time`, over batches up to `late` late."""

    def step(last, r):
        key = (r["z"], r["x"], r["y"])
        good = None not in key and (last is None or key > tuple(last))
        return (key if good else last or (-1, -1, -1)), (*key, good)

    kind = stream.schema[group].dataType.simpleString()
    return in_order(stream, group, ["seq", "z", "x", "y"], ["seq"], "z long, x long, y long", f"{group} {kind}, z int, x long, y long, accepted boolean", step, time, late)


def request_schedule(stream: DataFrame, interval_us: int, group: str = "host", time: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(host, seq, send_us): max(arrival, last + interval) per host, in order of arrival and seq, across batches."""

    def step(last, r):
        at = r["arrive_us"] if last is None else max(r["arrive_us"], last[0] + interval_us)
        return (at,), (r["seq"], at)

    kind = stream.schema[group].dataType.simpleString()
    return in_order(stream.where("arrive_us is not null"), group, ["seq", "arrive_us"], ["arrive_us", "seq"], "last long", f"{group} {kind}, seq long, send_us long", step, time, late)


def tile_counts(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Tiles arriving by event-time window and zoom."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "z").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "z", "n")


def running_checksum(stream: DataFrame, group: str = "pack_id", time: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(pack_id, seq, tiles, bytes, crc): CRC-32 of all bodies of the group so far in the order of seq, after each row; a null body counts as no bytes. What is kept between batches is three numbers."""

    def step(was, r):
        tiles, size, crc = was or (0, 0, 0)
        body = bytes(r["body"] or b"")
        now = (tiles + 1, size + len(body), zlib.crc32(body, crc))
        return now, (r["seq"], *now)

    kind = stream.schema[group].dataType.simpleString()
    return in_order(stream, group, ["seq", "body"], ["seq"], "tiles long, bytes long, crc long", f"{group} {kind}, seq long, tiles long, bytes long, crc long", step, time, late)
