"""Streams that count in order, over frames, batches and late rows; progress from observed metrics."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import Observation

from gridloom.streaming import ingest, progress

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def streamed(spark, tmp_path, batches, schema, make):
    """Rows of make(stream) in the order of the batches."""
    name = f"t{random.randrange(10**9)}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k:03}"))
    for k in range(len(batches)):  # files are taken by time of change
        for f in (tmp_path / "in" / f"b{k:03}").glob("part-*"):
            import os

            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


@pytest.fixture(params=[1, 20, 10_000])
def frames(spark, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.set(key, was)


def checksums(rows):
    out, crc, size = {}, 0, 0
    for k, (seq, body) in enumerate(sorted(rows)):
        crc, size = zlib.crc32(body, crc), size + len(body)
        out[seq] = (k + 1, size, crc)
    return out


def test_order_holds_over_all_frames(spark, tmp_path, frames):
    rng = random.Random(1)
    rows = [("a", k, bytes([k % 251]) * (k % 7)) for k in range(200)] + [(None, k, b"n%d" % k) for k in range(30)]
    rng.shuffle(rows)
    got = streamed(spark, tmp_path, [rows], "pack_id string, seq long, body binary", ingest.running_checksum)
    for pack in ("a", None):
        assert {r[1]: r[2:] for r in got if r[0] == pack} == checksums([r[1:] for r in rows if r[0] == pack])
    assert len(got) == 230


def test_ingest_and_schedule_over_frames(spark, tmp_path, frames):
    rng = random.Random(2)
    keys = sorted({(rng.randrange(3), rng.randrange(40), rng.randrange(40)) for _ in range(120)})
    good = [("p", k, *key) for k, key in enumerate(keys)]
    bad = [("p", 1000, 0, 0, 0), ("p", 1001, *keys[-1])]
    rows = good + bad
    rng.shuffle(rows)
    got = streamed(spark, tmp_path / "i", [rows[:70], rows[70:]] if frames > 10**6 else [rows], "pack_id string, seq long, z int, x long, y long", ingest.ordered_ingest)
    assert sum(r[-1] for r in got) == len(good) and [r[1:4] for r in got if not r[-1]] == [(0, 0, 0), keys[-1]]
    arrive = [("h", k, rng.randrange(10_000)) for k in range(150)]
    got = {r[1]: r[2] for r in streamed(spark, tmp_path / "s", [arrive], "host string, seq long, arrive_us long", lambda s: ingest.request_schedule(s, 250))}
    last, want = None, {}
    for _, seq, at in sorted(arrive, key=lambda r: (r[2], r[1])):
        last = at if last is None else max(at, last + 250)
        want[seq] = last
    assert got == want


def test_late_rows_count_in_their_place(spark, tmp_path, frames):
    """Rows up to ten seconds late over several batches; the last batches only move the watermark."""
    rng = random.Random(3)
    rows = [("a" if k % 3 else "b", k, b"%d;" % k, T0 + dt.timedelta(seconds=k)) for k in range(60)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 9))
    batches = [mixed[k : k + 15] for k in range(0, 60, 15)] + [[("z", 999 + k, b"", T0 + dt.timedelta(hours=1 + k))] for k in range(2)]
    got = streamed(spark, tmp_path, batches, "pack_id string, seq long, body binary, ts timestamp", lambda s: ingest.running_checksum(s, time="ts", late="10 seconds"))
    for pack in "ab":
        own = [r for r in got if r[0] == pack]
        assert {r[1]: r[2:] for r in own} == checksums([r[1:3] for r in rows if r[0] == pack])
        assert [r[1] for r in own] == sorted(r[1] for r in own)  # released in order, batch by batch


def test_progress_of_a_stream_and_a_batch(spark, tmp_path):
    seen = progress.BuildProgress("tiles", 10)
    spark.streams.addListener(seen)
    try:
        got = streamed(spark, tmp_path, [[(1, b"abc"), (2, None)], [(3, b"defg")]], "id long, body binary", lambda s: progress.observed(s, "tiles"))
        for _ in range(100):
            if len(seen.batches) >= 2 and seen.ended:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert len(got) == 3 and (seen.tiles, seen.bytes, seen.missing) == (3, 7, 1)
    assert seen.done == 0.3 and seen.eta == pytest.approx(7 * seen.seconds / 3) and seen.eta > 0
    assert progress.BuildProgress("x", 5).eta is None
    told = Observation("batch")
    progress.observed(spark.createDataFrame([(b"xy",), (None,)], "body binary"), told).write.format("noop").mode("overwrite").save()
    assert told.get == {"tiles": 2, "bytes": 2, "missing": 1}
