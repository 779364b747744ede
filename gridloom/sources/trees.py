"""Directory trees of tiles, {z}/{x}/{y}.ext, as relations: keys come from paths, and Spark opens no file whose bytes aren't asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo

AXES = ("tms", "xyz")


def tile_tree(spark: SparkSession, path: str, extension: str = "png", axis: str = "tms", zooms: tuple[int, int] | None = None) -> DataFrame:
    """(z, x, y, length, modified, body, issue) of the tiles below path; y counts from the north, whatever the tree's axis.

    Rows whose path isn't that of a tile have an issue (Path, Zoom, OutOfRange). zooms leaves whole directories unread."""
    if axis not in AXES:
        raise ValueError(f"axis must be one of {AXES}")
    root = path.rstrip("/")
    where = root if zooms is None else f"{root}/{{{','.join(map(str, range(zooms[0], zooms[1] + 1)))}}}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(where)
    part = lambda k: F.regexp_extract("path", rf"/(\d+)/(\d+)/(\d+)\.{extension}$", k)
    t = files.select(part(1).try_cast("int").alias("z"), part(2).try_cast("bigint").alias("x"), part(3).try_cast("bigint").alias("_y"), F.col("length"), F.col("modificationTime").alias("modified"), F.col("content").alias("body"))
    side = F.pow(F.lit(2.0), "z").cast("bigint")
    issue = F.when(F.col("z").isNull(), "Path").when(F.col("z") > 30, "Zoom").when((F.col("x") >= side) | (F.col("_y") >= side), "OutOfRange")
    y = geo.flip_row(F.col("_y"), F.col("z")) if axis == "tms" else F.col("_y")
    return t.select("z", "x", F.when(issue.isNull(), y).alias("y"), "length", "modified", "body", issue.alias("issue"))
