"""Pack identities: canonical text of sources and descriptors, UUIDs as text, NAME payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import codec

#: Source kinds that are files and share one shape.
FILE_KINDS = ("dir", "geotiff", "mbtiles", "pbf", "pmtiles", "style")
#: Quantiser versions by pixel format, and by palette.
VERSIONS = {"abgr2222": 1, "rgb565": 1, "palette": 3}


def _text(c: Column) -> Column:
    return c.cast("string")


def auth_list(kinds: Column) -> Column:
    """JSON array of auth kinds, sorted and without repeats; their values never enter an identity."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.concat(F.lit('"'), k, F.lit('"'))), ","), F.lit("]"))


def source_key(s: Column) -> Column:
    """What sources are ordered by: zooms (a made-up source and an image count as 0, 0), kind, then the kind's own fields."""
    made, flat = s["kind"] == "synthetic", s["kind"].isin("synthetic", "image")
    own = F.when(made, F.lpad(_text(s["fixture_version"]), 10, "0")).when(s["kind"] == "url", s["template"]).otherwise(s["content_hash"])
    return F.struct(F.when(flat, 0).otherwise(s["zmin"]).alias("a"), F.when(flat, 0).otherwise(s["zmax"]).alias("b"), s["kind"].alias("k"), own.alias("o"), F.when(s["kind"] == "url", auth_list(s["auth"])).alias("u"))


def source_json(s: Column) -> Column:
    """A source (kind, content_hash, fixture_version, template, auth, zmin, zmax) as canonical text, keys in order."""
    zooms = F.concat(F.lit(',"zoom_max":'), _text(s["zmax"]), F.lit(',"zoom_min":'), _text(s["zmin"]), F.lit("}"))
    file = F.concat(F.lit('{"content_hash":"'), s["content_hash"], F.lit('","kind":"'), s["kind"], F.lit('"'), zooms)
    url = F.concat(F.lit('{"auth_kinds":'), auth_list(s["auth"]), F.lit(',"kind":"url","template":'), codec.json_string(s["template"]), zooms)
    made = F.concat(F.lit('{"fixture_version":'), _text(s["fixture_version"]), F.lit(',"kind":"synthetic"}'))
    image = F.concat(F.lit('{"content_hash":"'), s["content_hash"], F.lit('","kind":"image"}'))
    return F.when(s["kind"] == "synthetic", made).when(s["kind"] == "url", url).when(s["kind"] == "image", image).otherwise(file)


def descriptor_json(d: dict[str, Column]) -> Column:
    """The twelve keys of a descriptor in their order, without white space; a missing affine or style hash is written as null."""
    ints = lambda *cs: F.concat(F.lit("["), F.concat_ws(",", *map(_text, cs)), F.lit("]"))
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    ordered = F.transform(F.array_sort(F.transform(d["sources"], lambda s: F.struct(source_key(s).alias("k"), s.alias("s")))), lambda x: source_json(x["s"]))
    affine = F.concat(F.lit("["), F.array_join(F.transform(d["affn"], lambda h: F.concat(F.lit('"'), h, F.lit('"'))), ","), F.lit("]"))
    parts = {
        "affn": F.coalesce(affine, F.lit("null")), "bbox": ints(*d["bbox"]), "format_version": ints(F.lit(1), F.lit(0)), "pixel_format": _text(d["pixel_format"]), "projection": _text(d["projection"]),
        "quantiser_version": _text(d["quantiser_version"]), "sources": F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), "style_hash": quoted(d["style_hash"]),
        "tile_addressing_scheme": _text(d["addressing"]), "tile_axis_convention": _text(d["axis"]), "tile_dim_px": _text(d["tile_dim"]), "zoom_range": ints(d["zmin"], d["zmax"]),
    }
    pieces = [F.lit("{")]
    for k, (name, value) in enumerate(parts.items()):
        pieces += [F.lit(("," if k else "") + f'"{name}":'), value]
    return F.concat(*pieces, F.lit("}"))


def uuid_text(text: Column) -> Column:
    """A UUID in its usual form; hyphens may be missing or stand anywhere, case doesn't matter; null if it isn't 32 digits or is all zero."""
    h = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    form = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(h.rlike("^[0-9a-f]{32}$") & (h != "0" * 32), form)


def name_payload(language: Column, name: Column) -> Column:
    """A NAME section's bytes: the tag behind its length in one byte, then the name; null where the tag is over 255 bytes."""
    n = F.octet_length(language)
    return F.when(n <= 255, F.concat(F.unhex(F.lpad(F.hex(n), 2, "0")), F.encode(language, "UTF-8"), F.encode(name, "UTF-8")))


def read_name(payload: Column) -> Column:
    """struct(language, name, issue) of a NAME section."""
    n = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    size = F.length(payload)
    issue = F.when(size == 0, "PayloadEmpty").when(size - 1 < n, "TagExceedsPayload")
    rest = F.when(issue.isNull(), F.struct(F.substring(payload, F.lit(2), n).alias("a"), F.substring(payload, n + 2, size).alias("b")))
    odd = F.try_validate_utf8(rest["a"].cast("string")).isNull() | F.try_validate_utf8(rest["b"].cast("string")).isNull()
    issue = F.coalesce(issue, F.when(odd, "InvalidUtf8"))
    return F.struct(*(F.when(issue.isNull(), rest[k].cast("string")).alias(v) for k, v in (("a", "language"), ("b", "name"))), issue.alias("issue"))
