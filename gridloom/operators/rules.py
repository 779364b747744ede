"""Validation rules as rows: header relations checked all at once or to the first failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.tiles import with_group


def header_rules(strict: bool) -> list[tuple[str, str, Column]]:
    """(rule, severity, fails) in the order in which a reader checks them; strict gives the second validator's: narrower values, boxes, and minor versions as warnings."""
    c = F.col
    core = [
        ("magic", "error", c("magic") != "RAWT"), ("major", "error", c("major") != 1), ("uuid", "error", c("uuid_zero")), ("parent", "error", ~c("parent_zero")),
        ("pixel_format", "error", ~c("pixel_format").isin(1, 2)), ("projection", "error", ~c("projection").isin(1, 3)), ("addressing", "error", ~c("addressing").isin(1, 2)), ("axis", "error", ~c("axis").isin(1, 2)),
        ("tile_dim", "error", c("tile_dim") < 1), ("zoom_range", "error", c("zmax") < c("zmin")),
    ]
    more = [
        ("minor", "warning", c("minor") > 0), ("pixel_format_strict", "error", c("pixel_format") == 2), ("addressing_strict", "error", c("addressing") == 2),
        ("bbox", "error", (c("min_lon") >= c("max_lon")) | (c("min_lat") >= c("max_lat")) | (F.abs("min_lon") > 180_000_000) | (F.abs("max_lon") > 180_000_000) | (F.abs("min_lat") > 90_000_000) | (F.abs("max_lat") > 90_000_000)),
    ]
    return core + (more if strict else [])


def issues(headers: DataFrame, key: str, strict: bool = True, fail_fast: bool = False) -> DataFrame:
    """(key, rule, severity) of all failing rules, or of the first."""
    rows = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity"))) for name, sev, bad in header_rules(strict)))
    found = F.array_compact(rows)
    found = F.slice(found, 1, 1) if fail_fast else found
    return headers.select(key, F.explode(found).alias("i")).select(key, "i.rule", "i.severity")


def index_issues(index: DataFrame, group: str, blob_start: str, end: str, rows: int = 1 << 16) -> DataFrame:
    """(group, seq, rule): order between neighbours, flags, bounds and alignment of index entries. A group is looked at in spans of `rows` entries; a span's first meets the last before it."""
    key = F.struct("z", "x", "y")
    index = index.withColumn("_span", F.floor(F.col("seq") / rows))
    last = index.groupBy(group, "_span").agg(F.max_by(key, F.col("seq")).alias("_last"))
    last = last.select(group, "_span", F.lag("_last").over(Window.partitionBy(group).orderBy("_span")).alias("_edge"))
    index = with_group(index.withColumn("_before", F.lag(key).over(Window.partitionBy(group, "_span").orderBy("seq"))), last, [group, "_span"])
    rules = {"order": F.coalesce("_before", "_edge") >= key, "flags": F.col("flags") != 0, "bounds": (F.col("offset") < F.col(blob_start)) | (F.col("offset") + F.col("length") > F.col(end)), "alignment": F.col("offset") % 4 != 0}
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return index.withColumn("rule", F.explode(found)).select(group, "seq", "rule")


def directory_mismatches(declared: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    """(group, z, rule) of zooms whose declared count (n) or first offset isn't that of the entries; a zoom without tiles has 0 for both."""
    both = declared.select(group, "z", F.col("n").alias("_n"), F.col("first_offset").alias("_at")).join(entries, [group, "z"], "full").na.fill(0, ["_n", "_at", "n", "first_offset"])
    found = F.array_compact(F.array(F.when(F.col("_n") != F.col("n"), F.lit("count")), F.when(F.col("_at") != F.col("first_offset"), F.lit("offset"))))
    return both.select(group, "z", F.explode(found).alias("rule"))
