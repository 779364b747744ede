"""Digests of ordered content that no single task has to read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The CRC-32 polynomial, bits reversed: a fixed value.
POLYNOMIAL = 0xEDB88320


def ordered_digest(parts: DataFrame, group: str, key: str, digest: str, fan: int = 1024, levels: int = 3) -> DataFrame:
    """(group, digest): SHA-256 over the hex digests of the parts in the order of their keys, level by level.

    Keys are whole numbers from 0; a node holds the parts whose keys agree above a factor of fan, so no list is longer
    than fan below the root, and the root has a fan**(levels - 1)th of the parts. Null digests are left out."""
    at = parts.select(group, F.col(key).alias("_k"), F.col(digest).alias("_h")).where("_h is not null")
    for level in range(levels):
        node = F.floor(F.col("_k") / fan).cast("bigint") if level + 1 < levels else F.lit(0).cast("bigint")
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: x["_h"]), "")
        at = at.withColumn("_n", node).groupBy(group, "_n").agg(F.sha2(listed, 256).alias("_h")).withColumnRenamed("_n", "_k")
    return at.select(group, F.col("_h").alias("digest"))


def _applied(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of single bits, on many values."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _zero_bytes(powers: int = 48) -> list[np.ndarray]:
    """What 1, 2, 4, ... zero bytes do to a checksum: each map is the square of the one before."""
    m = np.array([POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)  # one zero bit
    for _ in range(3):
        m = _applied(m, m)
    out = [m]
    for _ in range(powers - 1):
        out.append(_applied(out[-1], out[-1]))
    return out


@F.pandas_udf(T.LongType())
def _moved(crc: pd.Series, after: pd.Series) -> pd.Series:
    values, n = crc.to_numpy(np.int64).astype(np.uint32), after.to_numpy(np.int64)
    for k, m in enumerate(_zero_bytes(max(1, int(n.max()).bit_length())) if len(n) else ()):
        values = np.where(n >> k & 1, _applied(m, values), values)
    return pd.Series(values.astype(np.int64))


def joined_crc32(parts: DataFrame, group: str, crc: str, after: str) -> DataFrame:
    """(group, crc): CRC-32 of a group's parts one behind the other, from each part's own CRC-32 and the bytes that come after it.

    A part's share of the whole is its checksum moved by those bytes, and shares add up by exclusive or, so parts may come in any order from
    anywhere and no task reads the whole."""
    return parts.select(group, _moved(F.col(crc), F.col(after)).alias("_c")).groupBy(group).agg(F.bit_xor("_c").alias("crc"))
