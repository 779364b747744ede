"""Tile relations: points, keys, densities, regions, layouts, lookups and run comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import geo

#: Fixed multipliers that spread keys over the globe.
LON_STEP, LAT_STEP = 2654435761, 2246822519
HEADER_BYTES, ENTRY_BYTES = 292, 20
#: Images that one step of the shift search compares.
SOME_IMAGES = 256


def points(df: DataFrame, key: str) -> DataFrame:
    """(id, lon, lat) in micro-degree steps, derived from an integer key."""
    lon = F.pmod(F.col(key) * LON_STEP, F.lit(360_000_000)) - 180_000_000
    lat = F.pmod(F.col(key) * LAT_STEP, F.lit(170_000_000)) - 85_000_000
    return df.select(F.col(key).cast("bigint").alias("id"), (lon / 1e6).alias("lon"), (lat / 1e6).alias("lat"))


def with_zooms(df: DataFrame, zmin: int, zmax: int) -> DataFrame:
    return df.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax))))


def assign(pts: DataFrame) -> DataFrame:
    """pts, which has z, with the tile (x, y) that holds each."""
    return pts.withColumns({"x": geo.tile_x(F.col("lon"), F.col("z")), "y": geo.tile_y(F.col("lat"), F.col("z"))})


def density(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("z", "x", "y").agg(F.count("*").alias("n"))


def pyramid(finest: DataFrame, zmin: int) -> DataFrame:
    """Densities of all zooms from zmin up to that of finest (z, x, y, n): a parent's count is its children's sum, so no point is looked at again."""
    up = F.explode(F.sequence(F.lit(0), F.col("z") - zmin)).alias("up")
    p = finest.select("z", "x", "y", "n", up).select((F.col("z") - F.col("up")).cast("int").alias("z"), F.expr("shiftright(x, up)").alias("x"), F.expr("shiftright(y, up)").alias("y"), "n")
    return p.groupBy("z", "x", "y").agg(F.sum("n").alias("n"))


def extents(regions: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """A row for each region and zoom with its tile range; edges are inclusive."""
    r = with_zooms(regions, zmin, zmax)
    z = F.col("z")
    r = r.withColumns({"x0": geo.tile_x(F.col("min_lon"), z), "x1": geo.tile_x(F.col("max_lon"), z), "y0": geo.tile_y(F.col("max_lat"), z), "y1": geo.tile_y(F.col("min_lat"), z)})
    return r.withColumns({"nx": F.col("x1") - F.col("x0") + 1, "ny": F.col("y1") - F.col("y0") + 1})


def enumerate_tiles(extent: DataFrame) -> DataFrame:
    """Every tile of every extent, rows outer and columns inner; Spark expands ranges, no join is needed."""
    return extent.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))


def align4(n):
    return F.ceil(n / 4) * 4


def with_group(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns; a null key is a group like any other."""
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(right, same, how).drop(*(f"_of_{k}" for k in keys))


def running_offsets(df: DataFrame, group: list[str], order: list[str], bucket: str, size: str, into: str) -> DataFrame:
    """Sum of `size` over all rows before each within its group, in two levels.

    `bucket` is monotone in the order, so that a group of any number of rows is split: sums within
    buckets, plus the sums of earlier buckets, of which there is one row each."""
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(F.sum(size).alias("_sum"))
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, bucket, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    return with_group(df.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0))), totals, [*group, bucket]).withColumn(into, F.col("_in") + F.col("_before")).drop("_in", "_before")


def layout(index: DataFrame, parts: int = 4096) -> DataFrame:
    """index (pack_id, z, x, y, length) with offset: bodies follow header and index in key order, each on a multiple of 4. Bodies stay out of it.

    The box that a pack's tiles of a zoom fill is cut into `parts` windows along its columns, then within a column, so a pack of a small region is
    spread like one of the world; as many rows of sums meet in a pack's window of each zoom."""
    box = index.groupBy("pack_id", "z").agg(F.min("x").alias("_x"), F.min("y").alias("_y"), (F.max("y") - F.min("y") + 1).alias("_h"), ((F.max("x") - F.min("x") + 1).cast("double") * (F.max("y") - F.min("y") + 1)).alias("_area"))
    along = (F.col("x") - F.col("_x")).cast("double") * F.col("_h") + (F.col("y") - F.col("_y"))
    placed = with_group(index, box, ["pack_id", "z"]).withColumns({"_size": align4(F.col("length")).cast("bigint"), "_part": F.col("z").cast("bigint") * parts + F.floor(along * parts / F.col("_area"))}).drop("_x", "_y", "_h", "_area")
    placed = running_offsets(placed, ["pack_id"], ["z", "x", "y"], "_part", "_size", "_at")
    n = index.groupBy("pack_id").agg(F.count("*").alias("_n"))
    start = align4(HEADER_BYTES + ENTRY_BYTES * F.col("_n"))
    return with_group(placed, n, ["pack_id"]).withColumn("offset", (start + F.col("_at")).cast("bigint")).drop("_size", "_part", "_at", "_n")


def zoom_directory(index: DataFrame) -> DataFrame:
    """(pack_id, z, first_offset, n) of each zoom of each pack: the offset of its first index entry, and its number of tiles. At most 24 rows a pack meet in the window."""
    n = index.groupBy("pack_id", "z").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pack_id").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select("pack_id", "z", (HEADER_BYTES + ENTRY_BYTES * before).alias("first_offset"), "n")


def lookup(keys: DataFrame, index: DataFrame, on=("z", "x", "y")) -> DataFrame:
    """keys with the columns of the tiles found, null where there is none."""
    return keys.join(index, list(on), "left")


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: tiles of both, missing on either side, differing, and percent differing."""
    j = a.select(*keys, F.col(value).alias("va"), F.lit(1).alias("ina")).join(b.select(*keys, F.col(value).alias("vb"), F.lit(1).alias("inb")), keys, "full")
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    s = j.agg(F.count_if(both).alias("common"), F.count_if(F.col("inb").isNull()).alias("missing_b"), F.count_if(F.col("ina").isNull()).alias("missing_a"), F.count_if(both & (F.col("va") != F.col("vb"))).alias("differing"))
    return s.withColumn("percent", F.round(F.col("differing") * 100.0 / F.col("common"), 6))


def numbered(df: DataFrame, group: list[str], order: list[str], bucket: str, into: str) -> DataFrame:
    """df with each row's number in its group, from 0, in two levels: `bucket` is monotone in the order, so a group of any size is split."""
    return running_offsets(df.withColumn("_one", F.lit(1)), group, order, bucket, "_one", into).drop("_one")


def maxima_before(df: DataFrame, group: list[str], seq: str, value: str, into: str, span: int = 1 << 16) -> DataFrame:
    """df with the greatest `value` of all rows before each in its group, by the whole number `seq`: within spans of it, and over the spans before, so a group of any size is split."""
    d = df.withColumn("_span", F.floor(F.col(seq) / span))
    tops = d.groupBy(*group, "_span").agg(F.max(value).alias("_top"))
    before = Window.unboundedPreceding, -1
    tops = tops.select(*group, "_span", F.max("_top").over(Window.partitionBy(*group).orderBy("_span").rowsBetween(*before)).alias("_earlier"))
    inside = F.max(value).over(Window.partitionBy(*group, "_span").orderBy(seq).rowsBetween(*before))
    return with_group(d.withColumn("_inside", inside), tops, [*group, "_span"]).withColumn(into, F.greatest("_inside", "_earlier")).drop("_span", "_inside", "_earlier")


def order_violations(df: DataFrame, group: list[str], seq: str, key: list[str], span: int = 1 << 16) -> DataFrame:
    """Rows whose key isn't above the one before in their group, by the whole number `seq`: within spans of it, and at a span's first row against the last of the span before."""
    k = F.struct(*key)
    d = df.withColumn("_span", F.floor(F.col(seq) / span))
    edges = d.groupBy(*group, "_span").agg(F.max_by(k, F.col(seq)).alias("_last"))
    edges = edges.select(*group, "_span", F.lag("_last").over(Window.partitionBy(*group).orderBy("_span")).alias("_edge"))
    before = F.lag(k).over(Window.partitionBy(*group, "_span").orderBy(seq))
    return with_group(d.withColumn("_before", before), edges, [*group, "_span"]).where(F.coalesce("_before", "_edge") >= k).drop("_before", "_edge", "_span")


def _best_shifts(px: pa.ListArray, steps: list[tuple[int, int]]) -> dict[str, np.ndarray]:
    """dx, dy, pct and n of each list of pixels (side, gx, gy, code). Pixels are looked up in the other side's sorted places, so memory follows the pixels, whatever the extent. All columns of numbers are made for SOME_IMAGES lists at a time, so a full batch costs no more than itself."""
    if len(px) > SOME_IMAGES:
        found = [_best_shifts(px.slice(k, SOME_IMAGES), steps) for k in range(0, len(px), SOME_IMAGES)]
        return {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    ends, flat = px.offsets.to_numpy(), px.flatten()
    side, gx, gy, code = (flat.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(4))
    there, coded = (np.ones(len(flat), bool) if not any(f.null_count for f in fs) else np.logical_and.reduce([f.is_valid().to_numpy(zero_copy_only=False) for f in fs]) for fs in ((flat.field(1), flat.field(2)), (flat.field(3),)))
    image = np.repeat(np.arange(len(px)), np.diff(ends))
    out = {"dx": np.zeros(len(px), np.int32), "dy": np.zeros(len(px), np.int32), "pct": np.full(len(px), np.inf), "n": np.zeros(len(px), np.int64)}
    m = len(px)
    of = lambda k: np.flatnonzero(there & (side == k))
    a, b = of(0), of(1)
    if not len(a) or not len(b):
        return out
    xs, ys = np.unique(gx[b]), np.unique(gy[b])
    key = lambda i, x, y: (image[i] * len(xs) + x) * len(ys) + y
    # Of pixels at one place the last one stands.
    a = a[np.lexsort((gy[a], gx[a], image[a]))]
    a = a[np.append((np.diff(image[a]) != 0) | (np.diff(gx[a]) != 0) | (np.diff(gy[a]) != 0), True)]
    at = key(b, np.searchsorted(xs, gx[b]), np.searchsorted(ys, gy[b]))
    order = np.argsort(at, kind="stable")
    order = order[np.append(np.diff(at[order]) != 0, True)]
    at, b = at[order], b[order]
    found = lambda places, v: ((p := np.searchsorted(places, v).clip(max=len(places) - 1)), places[p] == v)
    columns, rows = ({d: found(places, v[a].astype(np.int64) + d) for d in {s[k] for s in steps}} for places, v, k in ((xs, gx, 1), (ys, gy, 0)))
    for dy, dx in steps:
        (x, x_met), (y, y_met) = columns[dx], rows[dy]
        near, met = found(at, key(a, x, y))
        met &= x_met & y_met
        i, j = a[met], b[near[met]]
        n = np.bincount(image[i], minlength=m)
        differ = np.bincount(image[i[(code[i] != code[j]) & coded[i] & coded[j]]], minlength=m)
        pct = np.array([round(v, 6) for v in (differ * 100.0 / np.maximum(n, 1)).tolist()])
        new = np.flatnonzero((n > 0) & (pct < out["pct"]))
        for k, v in (("dx", dx), ("dy", dy), ("pct", pct[new]), ("n", n[new])):
            out[k][new] = v
    return out


def shift_search(a: DataFrame, b: DataFrame, image: str, reach: int = 2) -> DataFrame:
    """For each image the offset (dx, dy) at which a best matches b, ties to the first row by row.

    a, b: (image, gx, gy, code). An image is bounded, so one aggregation gathers both of its pixel lists and every offset is tried on them;
    no pixel is sent anywhere twice. A batch's pixels stay in Arrow's arrays, and some images at a time are compared."""
    side = lambda df, k: df.select(image, F.struct(F.lit(k).alias("side"), F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), F.col("code").cast("int").alias("code")).alias("p"))
    both = side(a, 0).union(side(b, 1)).groupBy(image).agg(F.collect_list("p").alias("px"))
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]

    @F.arrow_udf("dx int, dy int, pct double, n long")
    def best(lists: pa.Array) -> pa.Array:
        found = _best_shifts(lists, steps)
        return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], list(found))

    return both.select(image, best("px").alias("m")).select(image, "m.*").where("n > 0")
