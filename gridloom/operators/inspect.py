"""A pack's report as lines: header, the tile size and whether the tiles agree with it, zooms and extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import codec, geo

#: Names of the format's numbers: fixed values.
NAMES = {
    "pixel_format": {1: "Abgr2222", 2: "Rgb565"},
    "projection": {1: "WebMercator", 3: "LocalLinear"},
    "tile_addressing_scheme": {1: "Quadtree", 2: "SingleImage"},
    "tile_axis_convention": {1: "Xyz", 2: "Tms"},
}
TEXT_TAGS = ("ATTR", "SRCD")


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _named(kind: str, c: Column) -> Column:
    out = None
    for k, name in NAMES[kind].items():
        out = F.when(c == k, name) if out is None else out.when(c == k, name)
    return out.otherwise(F.concat(F.lit("unknown "), F.coalesce(c.cast("string"), F.lit("null"))))


def report(h: dict[str, Column]) -> Column:
    """Lines, as an array of text.

    h: file, size, major, minor, uuid, supersedes, parent (null: no line), pixel_format, projection, addressing, axis, tile_dim, zmin, zmax, bbox (array of four
    microdegrees), timestamp, tiles, zooms (array of struct z, n; zooms without tiles are left out), offender (struct z, x, y, length, expected, or null), extensions
    (array of struct tag, payload)."""
    told = [_line("file: ", h["file"]), _line("size: ", h["size"], " bytes"), _line("format_version: ", h["major"], ".", h["minor"]), _line("pack_uuid: ", h["uuid"])]
    told += [F.when(h[k].isNotNull(), _line(f"{k}_uuid: ", h[k])) for k in ("supersedes", "parent")]
    told += [_line(f"{name}: ", _named(name, h[k])) for name, k in (("pixel_format", "pixel_format"), ("projection", "projection"), ("tile_addressing_scheme", "addressing"), ("tile_axis_convention", "axis"))]
    o, at = h["offender"], lambda k: h["offender"][k].cast("string")
    bad = o.isNotNull()
    told += [_line("tile_dim_px: ", h["tile_dim"], F.when(bad, " **INCONSISTENT**").otherwise(""))]
    told += [F.when(bad, _line("  WARNING: tile ", at("z"), "/", at("x"), "/", at("y"), " has ", at("length"), " bytes, not ", at("expected"))), F.when(bad, "  tiles don't have the size that the header tells; who decodes them by it takes the wrong stride")]
    told += [_line("zoom_range: ", h["zmin"], "-", h["zmax"]), F.concat(F.lit("bbox: "), F.concat_ws(" ", *(_line(f"{n}=", geo.micro_text(h["bbox"][k])) for k, n in enumerate(("minLon", "minLat", "maxLon", "maxLat")))))]
    told += [_line("build_timestamp: ", h["timestamp"]), _line("tile_count: ", h["tiles"])]
    zooms = F.transform(F.filter(h["zooms"], lambda s: s["n"] > 0), lambda s: _line("  zoom ", s["z"], ": ", s["n"], " tile(s)"))

    def section(s: Column) -> Column:
        text = F.try_validate_utf8(s["payload"].cast("string"))
        shown = F.when(~s["tag"].isin(*TEXT_TAGS), "").when(text.isNull(), ": <not valid UTF-8>").otherwise(F.concat(F.lit(": "), codec.json_string(text)))
        return _line("  ", s["tag"], " (", F.octet_length(s["payload"]), " byte payload)", shown)

    return F.concat(F.array_compact(F.array(*told)), zooms, F.array(_line("extensions: ", F.size(h["extensions"]), " section(s)")), F.transform(h["extensions"], section))
