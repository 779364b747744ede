"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract of this subpackage.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this application below spark.checkpoint.dir, which the cluster shares. Where that is unset, only a local master may fall back to a temp folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/gridloom-checkpoints"
    return f"{root.rstrip('/')}/gridloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Removes this application's stored tables: to be called once the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "x").rsplit("/", 1)[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """df, a stored table of columns of fixed width, to be broadcast if its rows times their width stay within most_bytes. Counting it reads footers only."""
    width = sum(_WIDTHS[f.dataType.simpleString()] if f.dataType.simpleString() in _WIDTHS else 64 for f in df.schema.fields) + 16
    return F.broadcast(df) if df.count() * width <= most_bytes else df


_WIDTHS = {"bigint": 8, "double": 8, "int": 4, "boolean": 1}


def sample_of(rows: DataFrame, most: int, by: list[str], keep: list[str]) -> DataFrame:
    """About `most` of the distinct values of columns by, as rows (*by, *keep), chosen by a hash.

    The share is of the estimated number of distinct values (within a few per cent) and meets all 64 bits of the hash,
    so neither repeated rows nor the table's size change how many are kept. No rows at all give none."""
    h = F.xxhash64(*(F.col(c) for c in by), F.lit(29))
    n = rows.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    if n > most:
        rows = rows.where(h < F.lit(int(most / n * 2**64) - 2**63))
    return rows.groupBy(*by).agg(*(F.first(c).alias(c) for c in keep)) if keep else rows.select(*by).distinct()


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() is quicker, and the same where a text is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def pieces_of(texts: list, most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most_chars characters, which bound a task's memory; one text is never cut."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most_chars:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def factorized(words_of: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word, distinct words, the words' offsets by document)."""
    offsets = np.zeros(len(words_of) + 1, np.int64)
    np.cumsum([len(x) for x in words_of], out=offsets[1:])
    flat = np.empty(offsets[-1], object)
    for k, words in enumerate(words_of):
        flat[offsets[k] : offsets[k + 1]] = words
    codes, unique = pd.factorize(flat)
    return codes, unique, offsets


def sums_by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows of values between the offsets; 0 for an empty range. Each sum depends on its own rows alone."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some], axis=0)
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... of lengths[0] items, then those of the next range, and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
