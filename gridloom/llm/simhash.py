"""Operator 11, SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has a bit set where over half of its `n`-word shingles, repeats included, have it set in their
XXH64; fingerprints link at `tau` or fewer differing bits. Documents of one fingerprint are one row from then on, so
copies cost nothing further.

The 64 bits form a ring of tau + 1 segments. Of a linking pair, some segment starts a chain in which every first l segments
together differ by at most l * tau / (tau + 1) bits: the first not at all, the first two by one bit, and so on. So a pair
meets in a bucket (start, the first segment's bits), and must keep the budgets of the whole chain before all bits are
compared. A bucket of more than `crowd` fingerprints is dealt anew by a chain one segment longer: each fingerprint lies there by its own bits,
and asks at all bits that the longer chain's budget leaves. So a fingerprint meets at most `crowd` others
in a bucket, whatever the input's size, unless its chain has all segments and the bucket is one fingerprint.

Links are found in two rounds, so that no group is spelled out as its pairs: round one holds each bucket's fingerprints
against its most frequent one and merges what links; round two returns only links between fingerprints of
different components, which makes it exact.

Null, empty or blank text: fingerprint 0, which links like any other. Fewer words than n: the whole sequence. A bit set in
exactly half: 0. Repeated rows: each is returned. Null doc_id: takes part, but never names a component it shares with a
document that has one. Very long texts are taken whole. An empty table gives an empty result. Columns besides doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER, UPPER, read, small, stored
from gridloom.llm.jaccard_join import components

N, TAU, SEED, CROWD, CHUNK = 4, 4, 42, 1024, 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, n: int = N) -> int:
    """A text's fingerprint, as an unsigned number of 64 bits."""
    words = _WORD.findall((text or "").encode("utf-8").translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - n + 1)
    starts, ends = starts[:k].tolist(), ends[-k:].tolist()
    total, one = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, k, CHUNK):  # bounds what a long text takes beside itself
        h = np.array([one(line[s:e], SEED) for s, e in zip(starts[a : a + CHUNK], ends[a : a + CHUNK], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > k, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, fp), fp being the fingerprint's bits as a signed long."""
    d = documents.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, n) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema[0].dataType.simpleString()}, fp long")


def segments(tau: int) -> list[int]:
    """The bits of each of the tau + 1 segments of the ring, as masks."""
    cuts = [round(k * 64 / (tau + 1)) for k in range(tau + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def budget(length: int, tau: int) -> int:
    """The most bits by which a chain's first `length` segments may differ together."""
    return length * tau // (tau + 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(start: int, length: int, tau: int) -> int:
    own = segments(tau)
    return _signed(sum(own[(start + k) % len(own)] for k in range(length)))


def _by_start(tau: int, of) -> Column:
    """of(start), a Python value, as a column that depends on the column start."""
    return F.element_at(F.array(*(F.lit(of(k)) for k in range(tau + 1))), F.col("start") + 1)


def keeps_budgets(a: str, b: str, tau: int) -> Column:
    """Whether a chain from segment `start` stays within all its budgets; with the last of them the pair links."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    fine = F.lit(True)
    for length in range(1, tau + 1):
        fine = fine & (F.bit_count(differ.bitwiseAND(_by_start(tau, lambda k: _chain(k, length, tau)))) <= budget(length, tau))  # noqa: B023
    return fine & (F.bit_count(differ) <= tau)


def _flips(bits: int, most: int) -> list[int]:
    """All ways to flip at most `most` of these bits."""
    out, ones = [0], [1 << k for k in range(64) if bits >> k & 1]
    layer = [(0, 0)]
    for _ in range(most):
        layer = [(m | ones[j], j + 1) for m, at in layer for j in range(at, len(ones))]
        out += [m for m, _ in layer]
    return [_signed(m) for m in out]


def buckets(fps: DataFrame, tau: int = TAU, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(own, asking), each (start, length, v, fp): where fingerprints lie, and where they ask. Every linking pair meets in a bucket, one lying and one asking."""
    masks = segments(tau)
    own = fps.select(F.explode(F.array(*(F.lit(k) for k in range(tau + 1)))).alias("start"), "fp")
    own = own.select("start", F.col("fp").bitwiseAND(_by_start(tau, lambda k: _chain(k, 1, tau))).alias("v"), "fp")
    asking = own.withColumn("used", F.lit(0))
    lie, ask = None, None
    for length in range(1, tau + 2):
        full = own.groupBy("start", "v").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("start", "v")
        full = stored(full, "crowded") if length <= tau else None
        last = full is None or full.isEmpty()
        there = [own, asking] if last else [x.join(small(full), ["start", "v"], "left_anti") for x in (own, asking)]
        there = [x.select("start", F.lit(length).alias("length"), "v", "fp") for x in there]
        lie, ask = there if lie is None else (lie.union(there[0]), ask.union(there[1]))
        if last:
            return lie, ask
        # Longer chains: the next segment's own bits, or those with as many flips as the budget leaves.
        own, asking = (x.join(small(full), ["start", "v"], "left_semi") for x in (own, asking))
        bits = _by_start(tau, lambda k: _signed(masks[(k + length) % len(masks)]))  # noqa: B023
        own = stored(own.withColumn("v", F.col("v").bitwiseOR(F.col("fp").bitwiseAND(bits))), "own-chains")
        grown = None
        for k in range(tau + 1):
            for used in range(budget(length, tau) + 1):
                flips = F.explode(F.array(*(F.lit(m) for m in _flips(masks[(k + length) % len(masks)], budget(length + 1, tau) - used))))
                some = asking.where((F.col("start") == k) & (F.col("used") == used)).select("start", "v", "fp", "used", flips.alias("flip"))
                grown = some if grown is None else grown.union(some)
        asking = grown.select("start", F.col("v").bitwiseOR(F.col("fp").bitwiseAND(bits).bitwiseXOR(F.col("flip"))).alias("v"), "fp", (F.col("used") + F.bit_count("flip")).cast("int").alias("used"))
        asking = stored(asking, "asking-chains")
    raise AssertionError("the last length returns")


def linked(fps: DataFrame, tau: int = TAU, crowd: int = CROWD) -> DataFrame:
    """(c, comp) of the fingerprints of fps (fp, copies) that link with another: comp is the least of those connected. Fingerprints are distinct."""
    key = ["start", "length", "v"]
    own, asking = (stored(x, name) for x, name in zip(buckets(fps.select("fp"), tau, crowd), ("own-buckets", "asking-buckets"), strict=True))
    counted = own.join(fps, "fp").groupBy(*key).agg(F.max(F.struct("copies", "fp"))["fp"].alias("centre"), F.count("*").alias("n"))
    # A bucket of whole first segments in which one fingerprint lies has nobody else to ask there.
    centres = counted.where("n > 1 or length > 1").select(*key, "centre")
    star = asking.join(centres, key).where(F.col("fp") != F.col("centre")).where(keeps_budgets("fp", "centre", tau))
    comp = components(star.select(F.col("fp").alias("a"), F.col("centre").alias("b")))
    near = small(comp.select(F.col("c").alias("fp"), "comp"))
    sides = [x.join(near, "fp", "left").select(*key, F.col("fp").alias(name), F.coalesce("comp", "fp").alias(f"{name}_comp")) for x, name in ((own, "a"), (asking, "b"))]
    across = sides[0].join(sides[1], key).where((F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp"))).where(keeps_budgets("a", "b", tau))
    more = stored(across.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct(), "cross-links")
    if more.isEmpty():
        return comp
    return components(comp.select(F.col("c").alias("a"), F.col("comp").alias("b")).union(more))


def near_duplicates(documents: DataFrame, n: int = N, tau: int = TAU, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id)."""
    if not 1 <= tau <= 15:
        raise ValueError("tau must be from 1 to 15")
    docs = stored(fingerprints(documents, n), "fingerprints")
    fps = stored(docs.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "distinct-fingerprints")
    comp = linked(fps, tau, crowd)
    named = fps.join(small(comp), fps["fp"] == comp["c"], "left").select("fp", "copies", "least", F.coalesce("comp", "fp").alias("comp"))
    least = stored(named.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size")).where("size > 1").drop("size"), "least-ids")
    named = stored(named.join(small(least), "comp").select("fp", "component_id"), "named-fingerprints")
    out = docs.join(small(named), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
