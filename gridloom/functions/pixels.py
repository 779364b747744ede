"""Pixel and colour columns: quantisers, palettes, Lab, contrast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.slices import bodies, slices

#: Channel thresholds of the two-bit code, and eight palette slots in order (name, r, g, b).
THRESHOLDS = (42, 127, 212)
SLOTS = (("white", 255, 255, 255), ("black", 0, 0, 0), ("red", 255, 0, 0), ("green", 0, 170, 0), ("blue", 0, 0, 255), ("yellow", 255, 255, 0), ("grey", 170, 170, 170), ("brown", 170, 85, 0))


def two_bit(v: Column) -> Column:
    a, b, c = THRESHOLDS
    return F.when(v <= a, 0).when(v <= b, 1).when(v <= c, 2).otherwise(3)


def abgr2222(r: Column, g: Column, b: Column) -> Column:
    """The one-byte code 0xC0 | b << 4 | g << 2 | r."""
    return (F.lit(192) + two_bit(b) * 16 + two_bit(g) * 4 + two_bit(r)).cast("int")


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return (F.shiftright(r, 3) * 2048 + F.shiftright(g, 2) * 32 + F.shiftright(b, 3)).cast("int")


def unpacked(code: Column) -> dict[str, Column]:
    """Two-bit channels of a code."""
    return {c: F.shiftright(code, s).bitwiseAND(3) for c, s in (("cr", 0), ("cg", 2), ("cb", 4), ("ca", 6))}


def slots_array() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for i, (_, r, g, b) in enumerate(SLOTS)))


def nearest_slot(r: Column, g: Column, b: Column) -> Column:
    """Index of the nearest slot in squared distance, ties to the first."""
    far = lambda s: (r - s["r"]) * (r - s["r"]) + (g - s["g"]) * (g - s["g"]) + (b - s["b"]) * (b - s["b"])
    return F.array_min(F.transform(slots_array(), lambda s: F.struct(far(s).alias("d"), s["i"].alias("i"))))["i"]


def palette_issue(slots: Column) -> Column:
    """struct(issue, first, second): why an array of struct(r, g, b, code) is no palette: empty, a code that isn't opaque (at first), or the first two slots of one colour. A code may stand twice."""
    at = F.transform(slots, lambda s, i: F.struct(i.alias("i"), F.struct(s["r"], s["g"], s["b"]).alias("c"), s["code"].alias("code")))
    clear = F.get(F.filter(at, lambda s: s["code"] < 192), F.lit(0))["i"]
    # For each slot the first earlier one of its colour; the pair with the smallest first slot, then second.
    twin = lambda s: F.get(F.filter(at, lambda o: (o["i"] < s["i"]) & (o["c"] == s["c"])), F.lit(0))["i"]
    pairs = F.filter(F.transform(at, lambda s: F.struct(twin(s).alias("a"), s["i"].alias("b"))), lambda p: p["a"].isNotNull())
    pair = F.array_min(pairs)
    issue = F.when(F.size(slots) == 0, "empty").when(clear.isNotNull(), "not_opaque").when(pair.isNotNull(), "duplicate_colour")
    return F.struct(issue.alias("issue"), F.when(issue == "not_opaque", clear).when(issue == "duplicate_colour", pair["a"]).alias("first"), F.when(issue == "duplicate_colour", pair["b"]).alias("second"))


#: The two-bit code of each byte.
_TWO_BIT = np.digitize(np.arange(256), np.array(THRESHOLDS) + 1).astype(np.uint8)


def _codes(body: bytes) -> bytes:
    q = _TWO_BIT[np.frombuffer(body, np.uint8).reshape(-1, 3)]
    return (192 | q[:, 2] << 4 | q[:, 1] << 2 | q[:, 0]).astype(np.uint8).tobytes()


@F.arrow_udf(T.StructType([T.StructField("codes", T.BinaryType()), T.StructField("issue", T.StringType())]))
def quantised(body: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """RGB888 bytes as two-bit codes, a byte a pixel; bytes that are no whole number of pixels are an issue."""
    for (some,) in slices((b,) for b in body):
        found = [{"codes": None, "issue": None} if x is None else {"codes": None, "issue": "length"} if len(x) % 3 else {"codes": _codes(x), "issue": None} for x in bodies(some)]
        yield pa.array(found, pa.struct([("codes", pa.binary()), ("issue", pa.string())]))


def linear(v: Column) -> Column:
    """An sRGB channel of 0 to 255 as linear light."""
    c = v / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """CIELAB of sRGB under D65."""
    lr, lg, lb = linear(r), linear(g), linear(b)
    xyz = ((0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883)
    f = [F.when(t > 216.0 / 24389.0, F.cbrt(t)).otherwise((24389.0 / 27.0 * t + 16.0) / 116.0) for t in xyz]
    return {"l": 116.0 * f[1] - 16.0, "a": 500.0 * (f[0] - f[1]), "b": 200.0 * (f[1] - f[2])}


def with_ciede2000(rows: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], into: str) -> DataFrame:
    """rows with the CIEDE2000 difference of two Lab colours, given by their columns; step by step, as one expression would repeat its parts too often to be compiled."""
    c, seven = F.col, lambda v: F.pow(v, F.lit(7.0))
    (l1, a1, b1), (l2, a2, b2) = ([c(k) for k in names] for names in (one, two))
    d = rows.withColumn("_c", seven((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2))
    d = d.withColumn("_g", 1.5 - 0.5 * F.sqrt(c("_c") / (c("_c") + 25.0**7)))
    d = d.withColumns({"_p1": a1 * c("_g"), "_p2": a2 * c("_g")})
    hue = lambda p, b: F.when((p == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, p)), F.lit(360.0)))
    d = d.withColumns({"_k1": F.hypot("_p1", b1), "_k2": F.hypot("_p2", b2), "_h1": hue(c("_p1"), b1), "_h2": hue(c("_p2"), b2)})
    grey, turn, total = c("_k1") * c("_k2") == 0, c("_h2") - c("_h1"), c("_h1") + c("_h2")
    dh = F.when(grey, 0.0).when(F.abs(turn) <= 180, turn).when(turn > 0, turn - 360).otherwise(turn + 360)
    hm = F.when(grey, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    d = d.withColumns({"_dh": 2 * F.sqrt(c("_k1") * c("_k2")) * F.sin(F.radians(dh) / 2), "_hm": hm, "_cm": (c("_k1") + c("_k2")) / 2, "_lm": F.pow((l1 + l2) / 2 - 50, F.lit(2.0))})
    wave = lambda k, at: F.cos(F.radians(k * c("_hm") + at))
    d = d.withColumns({"_t": 1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.20 * wave(4, -63), "_rc": 2 * F.sqrt(seven(c("_cm")) / (seven(c("_cm")) + 25.0**7)), "_rt": -F.sin(F.radians(60 * F.exp(-F.pow((c("_hm") - 275) / 25, F.lit(2.0)))))})
    d = d.withColumns({"_dl": (l2 - l1) / (1 + 0.015 * c("_lm") / F.sqrt(20 + c("_lm"))), "_dc": (c("_k2") - c("_k1")) / (1 + 0.045 * c("_cm")), "_db": c("_dh") / (1 + 0.015 * c("_cm") * c("_t"))})
    own = [k for k in d.columns if k in ("_c", "_g", "_p1", "_p2", "_k1", "_k2", "_h1", "_h2", "_dh", "_hm", "_cm", "_lm", "_t", "_rc", "_rt", "_dl", "_dc", "_db")]
    return d.withColumn(into, F.sqrt(c("_dl") * c("_dl") + c("_dc") * c("_dc") + c("_db") * c("_db") + c("_rt") * c("_rc") * c("_dc") * c("_db"))).drop(*own)
