"""Run-length decoding of a stream that lies in chunks, cut anywhere.

What a chunk does to a decoder is a value of its own: for each number of bytes that may still belong to a block begun earlier (0 to 128), how many
bytes of the last block lie behind the chunk, and the run, if a run's byte is still to come. Such values compose, so chunks are scanned in parallel, put together in
two levels (within spans of chunks, then over one row a span), and decoded in parallel once each knows its start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.slices import bodies, slices

#: Bytes of a block behind its head, at most; a state is such a number plus RUN times the length of a run whose byte is to come.
SKIPS, RUN = 129, 256
SPAN = 1024


def effect(data: bytes) -> np.ndarray:
    """The state after data for each number of bytes before its first head."""
    b = np.frombuffer(data, np.uint8)
    m = len(b)
    if not m:
        return np.arange(SKIPS)
    head = b.astype(np.int64)
    after = np.arange(m) + 1 + np.where(head < 128, head + 1, 1)
    last = np.where(after < m, after, np.arange(m))  # jumps from head to head, doubled until the last head of the chunk
    while not np.array_equal(last, again := last[last]):
        last = again
    out = np.arange(SKIPS) - m
    starts = np.flatnonzero(out < 0)
    at = last[starts]
    out[starts] = after[at] - m + np.where((head[at] >= 128) & (at == m - 1), RUN * (head[at] - 127), 0)
    return out


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The effect of two chunks, one behind the other. A run whose byte is still to come stays one over empty chunks."""
    skip = first % RUN
    out = then[skip]
    return np.where((skip == 1) & (out % RUN == 1) & (then[1] == 1) & (then[0] == 0), first, out)


def decoded(data: bytes, state: int) -> bytes:
    """The bytes that data gives to a decoder in this state."""
    skip, run, at, out = state % RUN, state // RUN, 0, bytearray()
    if skip and data:
        out += data[:1] * run if run else data[:skip]
        at = skip
    while at < len(data):
        head, at = data[at], at + 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        else:
            out += data[at : at + 1] * (head - 127)
            at += 1
    return bytes(out)


def _effects(lists: pa.Array) -> np.ndarray:
    """Lists of effects, or effects, as rows of an array, without a Python object a number."""
    flat = lists
    while pa.types.is_list(flat.type):
        flat = flat.flatten()
    return flat.to_numpy().reshape(-1, SKIPS)


def _listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SKIPS), pa.array(rows.astype(np.int32).ravel()))


def _ends(lists: pa.ListArray) -> list[int]:
    return (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _effect(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for (some,) in slices((d,) for d in data):
        yield _listed(np.array([effect(x) for x in bodies(some)], np.int32).reshape(-1, SKIPS))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _whole(effects: pa.Array) -> pa.Array:
    """The effect of a span's chunks together."""
    own, ends, out = _effects(effects), _ends(effects), []
    for a, b in zip(ends, ends[1:], strict=False):
        total = np.arange(SKIPS)
        for e in own[a:b]:
            total = composed(total, e)
        out.append(total)
    return _listed(np.array(out).reshape(-1, SKIPS))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _starts(wholes: pa.Array) -> pa.Array:
    """The state at the start of each span of a stream."""
    own, ends, out = _effects(wholes), _ends(wholes), []
    for a, b in zip(ends, ends[1:], strict=False):
        state = 0
        for e in own[a:b]:
            out.append(state)
            state = int(_after(state, e))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("finished", T.BooleanType())])))
def _given(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What each chunk of a span gives: some spans at a time, as runs may take many times their bytes."""
    for data, effects, state in slices(columns):
        own, ends, made, finished = _effects(effects), _ends(data), [], []
        chunks = bodies(data.flatten())
        for now, a, b in zip(state.to_pylist(), ends, ends[1:], strict=False):
            for e in own[a:b]:
                after = int(_after(now, e))
                made.append(decoded(next(chunks), now))
                finished.append(after == 0)
                now = after
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(made, pa.binary()), pa.array(finished, pa.bool_())], ["body", "finished"]))


def decode_chunks(chunks: DataFrame, group: str = "stream", seq: str = "seq", data: str = "data", span: int = SPAN) -> DataFrame:
    """(group, seq, body, start, finished) of chunks, whose seq are whole numbers from 0: each one's decoded bytes, where they start in the whole, and
    whether no block is open behind it. A null chunk counts as empty; a null group is a group. No task holds more than `span` chunks."""
    rows = chunks.select(F.col(group), F.col(seq).alias("_seq"), F.floor(F.col(seq) / span).cast("bigint").alias("_span"), F.coalesce(data, F.lit(b"")).alias("data"))
    rows = rows.withColumn("effect", _effect("data"))
    spans = rows.groupBy(group, "_span").agg(F.array_sort(F.collect_list(F.struct("_seq", "data", "effect"))).alias("parts"))
    spans = spans.withColumn("whole", _whole("parts.effect"))
    # A row for each span of chunks meets in a stream's list.
    begun = spans.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_span", "whole"))).alias("spans"))
    begun = begun.select(F.col(group).alias("_g"), F.explode(F.arrays_zip(F.col("spans._span").alias("s"), _starts("spans.whole").alias("state"))).alias("b")).select("_g", F.col("b.s").alias("_s"), "b.state")
    met = spans.drop("whole").join(begun, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_span") == F.col("_s")))
    made = met.select(group, "_span", F.explode(F.arrays_zip(F.col("parts._seq").alias("q"), _given("parts.data", "parts.effect", "state").alias("d"))).alias("e"))
    made = made.select(group, F.col("e.q").alias(seq), "_span", F.col("e.d.body").alias("body"), F.col("e.d.finished").alias("finished"))
    # Where a chunk's bytes start: within spans, then over spans.
    made = made.withColumn("_n", F.octet_length("body").cast("bigint"))
    inner = Window.partitionBy(group, "_span").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = made.groupBy(group, "_span").agg(F.sum("_n").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).select(F.col(group).alias("_g"), F.col("_span").alias("_s"), "_before")
    made = made.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    made = made.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_span") == F.col("_s")))
    return made.select(group, seq, "body", (F.col("_in") + F.col("_before")).alias("start"), "finished")


def _after(state: int, e: np.ndarray) -> int:
    """The state behind a chunk of this effect. A run waits through an empty chunk."""
    return state if np.array_equal(e, np.arange(SKIPS)) else e[state % RUN]


def stream_issue(decoded_chunks: DataFrame, expected: DataFrame, group: str = "stream", seq: str = "seq") -> DataFrame:
    """(group, size, issue) of streams of (group, expected): UnexpectedEnd if the last block is cut, OutputLengthMismatch if the size is another; null if neither."""
    got = decoded_chunks.groupBy(group).agg(F.sum(F.octet_length("body")).cast("bigint").alias("size"), F.max_by("finished", seq).alias("whole"))
    got = got.withColumnRenamed(group, "_g")
    j = expected.join(got, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return j.select(group, "size", F.when(~F.coalesce("whole", F.lit(True)), "UnexpectedEnd").when(F.col("size") != F.col("expected"), "OutputLengthMismatch").alias("issue"))
