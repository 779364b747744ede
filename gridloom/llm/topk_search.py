"""Operator 3, exact top-k search by columnar branch-and-bound.

Vectors become integers, floor(scale * x). Rows are dealt by a hash of vec_id, vector and a row salt into
blocks of candidates, so repeated rows spread, and the stated queries (vec_id divisible by `every`) into blocks of their own;
each pair of blocks is one group, so no task holds more than two blocks, whose rows follow from the
bytes a vector takes. A candidate block lies in vertical layout, a contiguous slab for each few
dimensions. For each query the partial inner products grow slab by slab; what a candidate can still gain is at most the product of the norms of
the remaining dimensions of both (the remaining mass); a query's own rows are taken out first, and those that can't reach the query's
floor are compacted away. The floor is the k-th best lower bound so far. It doesn't start from nothing: all queries
first meet a pilot, about `pilot` candidates that a hash chooses, and every block starts from the
k-th best score found there, which can't be above the true one. Blocks' winners meet in a window a query.

Vectors null or with null or non-finite components take no part, nor do those with a component that scaling takes beyond all doubles; missing dimensions count as 0.
All other components are exact: a block's products are float64 where 2**53 holds every sum, else 64-bit integers,
else integers of any length (beyond 1e300 without bounds, as no double holds these); a score that is no 64-bit integer counts as the nearest one. Ties go to the smaller vec_id. A vec_id is one vector: repeated rows are candidates each, and a
query is asked once (its smallest vector). Null vec_id: a candidate of no one. Empty table: empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import read, stored

K, EVERY, SCALE, BLOCK_BYTES, PILOT, SLAB, TILE = 5, 50, 256, 16 << 20, 4096, 16, 64
LARGEST = 2.0**62  # scores from here on may all count alike, so no floor is above


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v holds whole numbers as doubles, as floor() to a long would cut large ones."""
    x = F.transform("embedding", lambda c: c.cast("double") * scale)
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * scale) == float("inf")))
    kept = vectors.where("vec_id is not null and embedding is not null").where(~bad)
    return kept.select("vec_id", F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)).alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max((len(x) for x in vectors), default=0)
    m = np.zeros((len(vectors), width))
    for k, x in enumerate(vectors):
        m[k, : len(x)] = x
    return m


def _tails(m: np.ndarray, cuts: range) -> np.ndarray:
    """Norms of what remains from each cut on."""
    squares = (m**2)[:, ::-1].cumsum(1)[:, ::-1]
    return np.stack([np.sqrt(squares[:, c]) if c < m.shape[1] else np.zeros(len(m)) for c in cuts])


def _whole(m: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) if kind is object else m.astype(kind)


def block_winners(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K, slab: int = SLAB) -> list[tuple]:
    """(query_id, vec_id, score) of those of each query's k best of the block's candidates that its floor leaves, itself left out."""
    width = max(q.shape[1], c.shape[1], 1)
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    cuts = range(0, width, slab)
    with np.errstate(over="ignore"):
        most = float(np.float64(width) * np.abs(q).max(initial=0) * np.abs(c).max(initial=0))
    kind = np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object
    # What float64 can be off by when it stands for sums of integers of this size.
    slack = 1e-6 if kind is np.float64 else most * 2.0**-50
    bounded = most < 1e300
    slabs = [_whole(np.ascontiguousarray(c[:, a : a + slab].T), kind) for a in cuts]
    q_tails, c_tails = (_tails(m, range(slab, width + slab, slab)) for m in (q, c)) if bounded else (None, None)
    rows, out = _whole(q, kind), []
    for own in range(len(q)):
        if own % TILE == 0:  # the first slab of many queries at once
            tile = rows[own : own + TILE, :slab] @ slabs[0]
        part, alive, floor = tile[own % TILE], None, floors[own]
        first, last = np.searchsorted(c_ids, q_ids[own], "left"), np.searchsorted(c_ids, q_ids[own], "right")
        if first < last:  # the query's own rows, however many, must not raise the floor
            alive = np.concatenate((np.arange(first), np.arange(last, len(c_ids))))
            part = part[alive]
        for s, a in enumerate(cuts):
            if s:
                part = part + rows[own, a : a + slab] @ (slabs[s] if alive is None else slabs[s][:, alive])
            if not bounded:
                continue
            gain = q_tails[s, own] * (c_tails[s] if alive is None else c_tails[s][alive]) * (1 + 1e-9) + slack
            about = part.astype(np.float64)
            if len(part) > k and floor < LARGEST:
                floor = max(floor, np.partition(about - gain, len(part) - k)[len(part) - k])
            stay = about + gain >= min(floor, LARGEST)
            if stay.sum() < 0.7 * len(stay):
                alive = np.flatnonzero(stay) if alive is None else alive[stay]
                part = part[stay]
        ids = c_ids if alive is None else c_ids[alive]
        if kind is object:
            part = np.array([max(min(int(x), 2**63 - 1), -(2**63) + 1) for x in part], object)
        best = sorted(zip((-part).tolist(), ids.tolist(), strict=True))[:k] if kind is object else [(-part[i], ids[i]) for i in np.lexsort((ids, -part))[:k]]
        out += [(int(q_ids[own]), int(i), -int(s)) for s, i in best]
    return out


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block_bytes: int = BLOCK_BYTES, pilot: int = PILOT) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    ints = stored(integers(vectors, scale).withColumn("salt", F.monotonically_increasing_id()), "integer-vectors")
    query = F.col("vec_id") % every == 0
    n, m, width = ints.agg(F.count("*"), F.coalesce(F.count_if(query), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block = max(1, block_bytes // (8 * max(1, width)))
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // (2 * block)))
    dealt = lambda blocks, *by: F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")
    upto = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = stored(ints.where(query).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", dealt(q_blocks, "vec_id").alias("qb")), "queries")

    def winners(q: DataFrame, c: DataFrame) -> DataFrame:
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rows = block_winners(left["vec_id"].to_numpy(), _matrix(left["v"]), left["floor"].to_numpy(np.float64), right["vec_id"].to_numpy(), _matrix(right["v"]), k) if len(left) and len(right) else []
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

        return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, "query_id long, vec_id long, score long")

    chance = F.xxhash64("salt", F.lit(5)) < F.lit(int(min(1.0, pilot / max(n, 1)) * (2**64 - 2048)) - 2**63)
    some = ints.where(chance).select("vec_id", "v", F.lit(0).alias("cb"), upto(q_blocks).alias("qb"))
    first = winners(asked.withColumns({"floor": F.lit(float("-inf")), "cb": F.lit(0)}), some)
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    # The floor as a double may not be above the score: it goes down by more than rounding can lift it.
    floors = stored(floors.select(F.col("query_id").alias("vec_id"), (F.col("least") - F.abs("least") * 1e-15).alias("floor")), "floors")
    asked = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    c = ints.select("vec_id", "v", dealt(c_blocks, "vec_id", "v", "salt").alias("cb"), upto(q_blocks).alias("qb"))
    found = winners(asked.withColumn("cb", upto(c_blocks)), c)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
