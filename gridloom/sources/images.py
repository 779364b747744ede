"""PNG and JPEG files as RGB pixels, read and decoded by Spark's own image source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def _rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Samples in blue, green, red order as RGB; grey is spread, alpha is dropped and not blended."""
    out = []
    for raw, n in zip(data, channels, strict=True):
        if n not in (1, 3, 4):
            out.append(None)
            continue
        px = np.frombuffer(raw, np.uint8).reshape(-1, n)
        out.append((np.repeat(px, 3, axis=1) if n == 1 else px[:, 2::-1]).tobytes())
    return pd.Series(out, dtype=object)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb888, error) of the images below path; a file that is none has the error DecodeFailed."""
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    bad = F.col("height") <= 0
    ok = lambda c: F.when(~bad, c)
    return i.select(F.col("origin").alias("path"), ok(F.col("width")).alias("width"), ok(F.col("height")).alias("height"), ok(_rgb("data", "nChannels")).alias("rgb888"), F.when(bad, "DecodeFailed").alias("error"))
