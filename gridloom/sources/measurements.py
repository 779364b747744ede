"""Measured runs from JSON files that hold rows of two shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_measurements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, networks) of files that each hold one JSON array: runs are the rows with a level, networks those with counts by host, a row a host."""
    rows = spark.read.schema("level int, strategy string, blockN int, tiles long, renders long, wallMs double, rawBytes long, rleBytes long, pass int, label string, passNetwork map<string, struct<requests: long, bytes: long>>").json(path, multiLine=True)
    runs = rows.where("level is not null").drop("passNetwork")
    nets = rows.where("level is null and passNetwork is not null").select("pass", "label", F.explode("passNetwork").alias("host", "n")).select("pass", "label", "host", "n.requests", "n.bytes")
    return runs, nets
