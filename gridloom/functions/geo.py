"""Geographic columns: tile coordinates, their inverses, micro-degrees and zoom ladders.

Functions named *_sql return expressions that Spark SQL accepts; the others take and return Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the Web Mercator grid.
MAX_LAT = 85.05112877980659
MAX_ZOOM = 23
WORLD_MICRO = (-180_000_000, -85_051_129, 180_000_000, 85_051_129)
KM_PER_DEGREE = 111.32


def tile_x(lon: Column, z: Column) -> Column:
    """Column of the tile that holds lon, clamped to the grid."""
    n = F.pow(F.lit(2.0), z)
    x = F.floor((F.greatest(F.lit(-180.0), F.least(F.lit(180.0), lon)) + 180.0) / 360.0 * n)
    return F.greatest(F.lit(0), F.least(x, n - 1)).cast("bigint")


def tile_y(lat: Column, z: Column) -> Column:
    """Row of the tile that holds lat, clamped to the grid."""
    n = F.pow(F.lit(2.0), z)
    phi = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)))
    y = F.floor((1.0 - F.asinh(F.tan(phi)) / F.pi()) / 2.0 * n)
    return F.greatest(F.lit(0), F.least(y, n - 1)).cast("bigint")


def tile_lon(x: Column, z: Column) -> Column:
    """Longitude of a tile's west edge."""
    return x / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def tile_lat(y: Column, z: Column) -> Column:
    """Latitude of a tile's north edge."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / F.pow(F.lit(2.0), z)))))


def tile_x_frac(lon: Column, z: Column) -> Column:
    """Fractional and unclamped: lon 180 gives 2**z."""
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), z)


def tile_y_frac(lat: Column, z: Column) -> Column:
    r = F.radians(lat)
    return (1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * F.pow(F.lit(2.0), z)


def micro(deg: Column, mode: str = "even") -> Column:
    """Micro-degrees: ties to even, or with mode away away from zero."""
    return (F.rint(deg * 1e6) if mode == "even" else F.round(deg * 1e6)).cast("int")


def micro_text(m: Column) -> Column:
    """Signed decimal degrees with six places."""
    a = F.abs(m.cast("bigint"))
    return F.concat(F.when(m < 0, "-").otherwise(""), (F.floor(a / 1_000_000)).cast("string"), F.lit("."), F.lpad((a % 1_000_000).cast("string"), 6, "0"))


def grid_level(z: Column, dim: Column) -> Column:
    """Ladder zoom to grid level for tiles of dim pixels."""
    return (z + F.log2(F.lit(512.0) / dim) - 1).cast("int")


def flip_row(y: Column, z: Column) -> Column:
    """The other axis convention's row."""
    return (F.pow(F.lit(2.0), z) - 1 - y).cast("bigint")


def zoom_range(text: Column) -> Column:
    """struct(zmin, zmax) of `n` or `a-b`, at most 23 and in order; else null."""
    p = F.transform(F.split(text, "-"), lambda v: F.trim(v).try_cast("int"))
    a, b = F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0)))
    good = (F.size(p) <= 2) & ~F.exists(p, lambda v: v.isNull()) & (a >= 0) & (a <= b) & (b <= MAX_ZOOM)
    return F.when(good, F.struct(a.alias("zmin"), b.alias("zmax")))


def tile_dim_valid(d: Column) -> Column:
    """A power of two from 32 to 1024."""
    return (d >= 32) & (d <= 1024) & (d.bitwiseAND(d - 1) == 0)


def radius_box(lon: Column, lat: Column, km: float) -> dict[str, Column]:
    """The box around a point."""
    dy, dx = F.lit(km / KM_PER_DEGREE), F.lit(km / KM_PER_DEGREE) / F.cos(F.radians(lat))
    return {"min_lon": lon - dx, "min_lat": lat - dy, "max_lon": lon + dx, "max_lat": lat + dy}


def box_issue(text: Column) -> Column:
    """What is wrong with a box written as min_lon,min_lat,max_lon,max_lat: parts, number, lon, lat or order; null if nothing."""
    p = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    lon, lat = (F.abs(p[0]) > 180) | (F.abs(p[2]) > 180), (F.abs(p[1]) > 90) | (F.abs(p[3]) > 90)
    odd = F.exists(p, lambda x: x.isNull() | F.isnan(x))
    return F.when(text.isNull() | (F.size(p) != 4), "parts").when(odd, "number").when(lon, "lon").when(lat, "lat").when((p[0] >= p[2]) | (p[1] >= p[3]), "order")
