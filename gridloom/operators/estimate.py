"""What a build will take: renders, bytes, seconds, a verdict, and learned rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import tiles

#: Fixed values of the cost model: ms a megapixel, ms a render, ms once, packed fraction; MiB limits.
MS_PER_MPX, MS_PER_RENDER, MS_FIXED, PACKED = 313.0, 210.0, 2500.0, 0.055
MIB = 1 << 20
COLUMN_MAX, PACK_WARN, PACK_MAX, TOTAL_WARN, TOTAL_MAX, SLOW_S = 384 * MIB, 96 * MIB, 256 * MIB, 192 * MIB, 384 * MIB, 300
BLOCKS = (16, 8, 4, 2, 1)


def plan(extent: DataFrame, region: str, dim: int = 128, budget: int = 128 * MIB) -> DataFrame:
    """A row for each region: tiles, the largest block size whose columns fit the budget, renders, bytes, seconds and verdict."""
    e = extent.withColumn("block", F.explode(F.array(*map(F.lit, BLOCKS))))
    e = e.withColumn("renders", F.ceil(F.col("nx") / F.col("block")) * F.ceil(F.col("ny") / F.col("block")))
    e = e.withColumn("column", F.col("block").cast("bigint") * F.col("ny") * dim * dim)
    p = e.groupBy(region, "block").agg(F.sum(F.col("nx") * F.col("ny")).cast("bigint").alias("tiles"), F.sum("renders").cast("bigint").alias("renders"), F.max("column").alias("column"))
    fits = F.when(F.col("column") <= budget, F.col("block"))
    w = Window.partitionBy(region)
    p = p.withColumn("chosen", F.coalesce(F.max(fits).over(w), F.min("block").over(w))).where("block = chosen")
    pack = F.round(F.col("tiles") * (dim * dim * PACKED)).cast("bigint")
    seconds = F.round((F.col("tiles") * (dim * dim / 1e6) * MS_PER_MPX + F.col("renders") * MS_PER_RENDER + MS_FIXED) / 1000, 3)
    p = p.withColumns({"pack": pack, "seconds": seconds}).withColumn("peak", 2 * F.col("column") + 2 * F.col("pack"))
    verdict = (
        F.when(F.col("tiles") == 0, "empty").when(F.col("peak") > TOTAL_MAX, "refuse_total").when(F.col("column") > COLUMN_MAX, "refuse_column")
        .when(F.col("pack") > PACK_MAX, "refuse_pack").when((F.col("peak") > TOTAL_WARN) | (F.col("pack") > PACK_WARN) | (F.col("seconds") > SLOW_S), "heavy").otherwise("ok")
    )
    return p.select(region, F.col("block").alias("block_n"), "tiles", "renders", F.col("column").alias("column_bytes"), "pack", "seconds", verdict.alias("verdict"))


def work_done(levels: DataFrame, group: str, order: str, tiles: str, cost: str, done: Column) -> DataFrame:
    """(group, work): cost of the levels finished at `done` tiles, linear inside a level; levels without tiles count nothing."""
    before = F.coalesce(F.sum(tiles).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.when(F.col(tiles) > 0, F.least(F.greatest((done - before) / F.col(tiles), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return levels.withColumn("_work", part * F.col(cost)).groupBy(group).agg(F.round(F.sum("_work"), 6).alias("work"))


def upper_medians(rows: DataFrame, group: str, value: str, accuracy: int = 50_000) -> DataFrame:
    """(group, n, middle, worst, best): middle is the value at place n // 2 + 1 of the descending order, exact.

    A quantile sketch of each group gives two bounds that the middle can't leave, 4 / accuracy of the rows apart; rows above them are
    counted, and only the distinct values between them, with their counts, are put in order. So neither an outlier nor a value that many rows hold makes a task
    large. Null values don't count; a null group is a group."""
    e = rows.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where("_v is not null")
    near = [0.5 - 2 / accuracy, 0.5 + 2 / accuracy]
    s = e.groupBy("_g").agg(F.count("*").alias("n"), F.max("_v").alias("worst"), F.min("_v").alias("best"), F.percentile_approx("_v", near, accuracy).alias("_b"))
    e = tiles.with_group(e, s.select("_g", "n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi")), ["_g"]).where("_v >= _lo")
    c = e.groupBy("_g", "n", F.when(F.col("_v") <= F.col("_hi"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_k"))  # null: all that is above
    upto = F.sum("_k").over(Window.partitionBy("_g").orderBy(F.col("_v").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = F.floor(F.col("n") / 2) + 1
    m = c.withColumn("_upto", upto).where((F.col("_upto") >= place) & (F.col("_upto") - F.col("_k") < place)).select("_g", F.col("_v").alias("middle"))
    return tiles.with_group(s, m, ["_g"]).select(F.col("_g").alias(group), "n", "middle", "worst", "best")


LAST = 100


def learned_rate(builds: DataFrame, group: str, order: str, value: str, counts: Column, start: float = MS_PER_MPX, floor: float = 10.0) -> DataFrame:
    """(group, rate): builds that count, in order, each moving the rate half way to its own.

    The fold is a sum with weights 1/2, 1/4, ... from the last build back, so what lies LAST builds back weighs less than rounding; Spark keeps
    no more than these of a group in each task before the shuffle."""
    own = builds.where(counts).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_k") <= LAST)
    s = own.groupBy(group).agg(F.sum(F.col(value) * F.pow(F.lit(0.5), "_k")).alias("s"), F.count("*").alias("n"))
    return s.select(group, F.round(F.greatest(F.lit(floor), F.col("s") + F.lit(start) * F.pow(F.lit(0.5), "n")), 6).alias("rate"))


def _tenths(n: Column, unit: int) -> Column:
    """n units with one decimal, by whole numbers; halves go up."""
    t = F.floor((n * 20 + unit) / (2 * unit))
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def human_bytes(n: Column) -> Column:
    """Whole KB; MB with a decimal below ten; GB with one."""
    whole = lambda unit, name: F.concat(F.floor((n * 2 + unit) / (2 * unit)).cast("string"), F.lit(name))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < MIB, whole(1024, " KB")).when(n < 10 * MIB, F.concat(_tenths(n, MIB), F.lit(" MB")))
        .when(n < 1 << 30, whole(MIB, " MB")).otherwise(F.concat(_tenths(n, 1 << 30), F.lit(" GB")))
    )


def human_duration(s: Column) -> Column:
    """Seconds below 90, minutes below an hour, else hours with one decimal; halves go up."""
    up = lambda v: F.floor(v + 0.5).cast("bigint").cast("string")
    hours = F.floor(s / 360 + 0.5).cast("bigint")
    return F.when(s < 1, "<1 s").when(s < 90, F.concat(up(s), F.lit(" s"))).when(s < 3600, F.concat(up(s / 60), F.lit(" min"))).otherwise(F.concat(F.floor(hours / 10).cast("string"), F.lit("."), (hours % 10).cast("string"), F.lit(" h")))


def reason(verdict: Column, block: Column) -> Column:
    """What to tell of a verdict: why it is refused or heavy, and that small blocks make it slow."""
    base = F.when(verdict == "empty", "choose an area").when(verdict == "refuse_total", "too much memory at once").when(verdict == "refuse_column", "too tall").when(verdict == "refuse_pack", "pack too large").when(verdict == "heavy", "large build").otherwise("")
    slow = F.when(~verdict.startswith("refuse") & (verdict != "empty") & (block < BLOCKS[0]), F.concat(F.lit("blocks of "), block.cast("string"))).otherwise("")
    return F.array_join(F.filter(F.array(base, slow), lambda x: x != ""), "; ")
