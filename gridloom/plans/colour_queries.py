"""Queries over the panel's colours: previews, nearest codes, thresholds, contrast, separability, opacity and run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import panel, pixels
from gridloom.operators import tiles
from gridloom.plans import pixel_queries
from gridloom.plans.pixel_queries import _CODE, _PX, _px
from gridloom.plans.study_queries import _IMG, _images
from gridloom.plans.tile_queries import read

#: Named colours of the contrast table by their two-bit levels of red, green and blue, a fixed list.
NAMED = (("paper_white", 3, 3, 3), ("paper_warm", 3, 3, 2), ("paper_cool", 2, 3, 3), ("ink_black", 0, 0, 0), ("ink_red", 1, 0, 0), ("ink_blue", 0, 0, 1), ("neutral_mid", 1, 1, 1), ("water_blue", 0, 0, 3), ("water_pale", 1, 2, 3), ("park_green", 1, 3, 1), ("green_full", 0, 3, 0))
APART = 8.0


def _code(r: int, g: int, b: int) -> int:
    return 192 + 16 * b + 4 * g + r


def _used(spark, d) -> DataFrame:
    """(code, n) of the codes in use: 64 rows at most from here on."""
    return _px(spark, d).groupBy(pixels.abgr2222(F.col("r"), F.col("g"), F.col("b")).alias("code")).agg(F.count("*").alias("n"))


def _modelled(codes: DataFrame) -> DataFrame:
    ch = pixels.unpacked(F.col("code"))
    xyz = panel.xyz_of(ch["cr"], ch["cg"], ch["cb"])
    lab = panel.lab_of(xyz, panel.WHITE)
    return codes.withColumns({**dict(zip("XYZ", xyz, strict=True)), **dict(zip("lab", lab, strict=True))})


def panel_colours(spark, d):
    """Codes in use as the panel shows them: luminance, Lab, and sRGB previews adapted and not."""
    c = _modelled(_used(spark, d))
    xyz = [F.col(k) for k in "XYZ"]
    shown = {f"{name}_{k}": v for name, ad in (("seen", True), ("dim", False)) for k, v in zip("rgb", panel.preview(xyz, ad), strict=True)}
    return c.select("code", "n", F.round("Y", 9).alias("y"), *((F.round(k, 6) + 0.0).alias(k) for k in "lab"), *(v.alias(k) for k, v in shown.items()))


def panel_nearest(spark, d):
    """Pixels by nearest of the 64 colours in Lab, plain and with ordered dither; each distinct colour is solved once, and each colour at a dither place."""
    p = _px(spark, d, F.pmod("l_orderkey", F.lit(4)).cast("int").alias("dx"), F.pmod("l_linenumber", F.lit(4)).cast("int").alias("dy"))
    lab = [F.col(k) for k in "lab"]
    placed = p.groupBy("r", "g", "b", "dx", "dy").agg(F.count("*").alias("n"))
    colours = placed.groupBy("r", "g", "b").agg(F.collect_list(F.struct("dx", "dy", "n")).alias("places"))  # 16 at most
    colours = colours.withColumns(dict(zip("lab", panel.srgb_lab(F.col("r"), F.col("g"), F.col("b")), strict=True))).select("l", "a", "b", "places", panel.nearest(lab).alias("plain"))
    each = colours.select("l", "a", "b", "plain", F.explode("places").alias("p")).select("plain", "p.n", panel.nearest(panel.dithered(lab, F.col("p.dx"), F.col("p.dy"))).alias("dither"))
    both = F.array(*(F.struct(F.lit(how).alias("how"), F.col(how).alias("code")) for how in ("plain", "dither")))
    return each.select("n", F.explode(both).alias("s")).groupBy("s.how", "s.code").agg(F.sum("n").alias("n"))


SLOT_CODES = sorted({_code(*(0 if v <= 42 else 1 if v <= 127 else 2 if v <= 212 else 3 for v in (r, g, b))) for _, r, g, b in pixels.SLOTS})


def panel_slots(spark, d):
    """Pixels by nearest palette slot in Lab, slots in the order of their codes, and the share of pixels that are slots already."""
    c = _px(spark, d).groupBy("r", "g", "b").agg(F.count("*").alias("n")).withColumn("on", pixels.abgr2222(F.col("r"), F.col("g"), F.col("b")).isin(SLOT_CODES))
    c = c.withColumns(dict(zip("lab", panel.srgb_lab(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    c = c.select("n", panel.nearest([F.col(k) for k in "lab"], SLOT_CODES).alias("slot"), "on")
    return c.groupBy("slot").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("on"), F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 6).alias("percent_on"))


def preview_bytes(spark, d):
    """Bytes as pixels through the preview table; one whose alpha isn't opaque shows as magenta."""
    v = F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(256)).cast("int")
    c = _modelled(read(spark, d, "lineitem").groupBy(v.alias("code")).agg(F.count("*").alias("n")))
    r, g, b = panel.preview([F.col(k) for k in "XYZ"])
    legal = F.shiftright("code", 6) == 3
    rgb = F.when(legal, F.concat(*(F.lpad(F.hex(x), 2, "0") for x in (r, g, b)))).otherwise("FF00FF")
    return c.groupBy(rgb.alias("rgb")).agg(F.sum("n").alias("n"), F.count("*").alias("codes"))


def panel_thresholds(spark, d):
    """Greys of pixels by the fixed thresholds and by the panel's own: pixels that differ, mean and worst difference to the grey meant. At most 256 greys meet."""
    t, grey = panel.thresholds(), F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(256)).cast("int")
    g = read(spark, d, "lineitem").groupBy(grey.alias("grey")).agg(F.count("*").alias("n"))
    v = F.col("grey")
    own = F.when(v < t[0], 0).when(v < t[1], 1).when(v < t[2], 2).otherwise(3)
    g = g.withColumns({"fixed": pixels.two_bit(v), "own": own, **dict(zip(("l1", "a1", "b1"), panel.srgb_lab(v, v, v), strict=True))})
    for name in ("fixed", "own"):
        lab = panel.lab_of(panel.xyz_of(F.col(name), F.col(name), F.col(name)), panel.WHITE)
        g = g.withColumns(dict(zip((f"{name}_l", f"{name}_a", f"{name}_b"), lab, strict=True)))
        g = pixels.with_ciede2000(g, ("l1", "a1", "b1"), (f"{name}_l", f"{name}_a", f"{name}_b"), f"{name}_de")
    return g.agg(F.sum("n").alias("pixels"), F.sum(F.when(F.col("fixed") != F.col("own"), F.col("n")).otherwise(0)).alias("differing"), *(F.round(F.avg(f"{k}_de"), 4).alias(f"{k}_mean") for k in ("fixed", "own")), *(F.round(F.max(f"{k}_de"), 4).alias(f"{k}_worst") for k in ("fixed", "own")))


def contrast_matrix(spark, d):
    """Contrast between the named colours, a row and a column each (null with itself), with the pixels that have the row's colour."""
    named = spark.createDataFrame([(name, _code(*v)) for name, *v in NAMED], "name string, code int")  # eleven rows
    c = _modelled(F.broadcast(named).join(_used(spark, d), "code", "left")).select("name", F.coalesce("n", F.lit(0)).alias("n"), "Y")
    other = c.select(F.col("name").alias("other"), F.col("Y").alias("y2"))
    ratio = F.when(F.col("name") != F.col("other"), F.round(F.greatest("Y", "y2") / F.least("Y", "y2"), 4))
    return c.crossJoin(F.broadcast(other)).groupBy("name", "n").pivot("other", [k for k, *_ in NAMED]).agg(F.first(ratio))


def _pairs(spark, d) -> DataFrame:
    c = _modelled(_used(spark, d)).select("code", "n", *"lab")
    j = c.alias("p").join(c.alias("q"), F.col("p.code") < F.col("q.code"))  # 2016 pairs at most
    j = j.select(F.col("p.code").alias("c1"), F.col("q.code").alias("c2"), *(F.col(f"{s}.{k}").alias(f"{k}{i}") for i, s in enumerate("pq", 1) for k in "lab"))
    return pixels.with_ciede2000(j, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").select("c1", "c2", "de")


def pair_statistics(spark, d):
    """Least, median and greatest difference between the colours in use, and how many pairs are closer than 1, 2, 3 and 5."""
    p = _pairs(spark, d)
    return p.agg(F.count("*").alias("pairs"), F.round(F.min("de"), 4).alias("least"), F.round(F.median("de"), 4).alias("median"), F.round(F.max("de"), 4).alias("greatest"), *(F.count_if(F.col("de") < t).alias(f"under_{t}") for t in (1, 2, 3, 5)))


def lightness_bands(spark, d):
    """Colours in use and their pixels by band of lightness."""
    c = _modelled(_used(spark, d))
    band = F.when(F.col("l") < 40, "ink").when(F.col("l") < 50, "dark").when(F.col("l") > 80, "paper").otherwise("middle")
    return c.groupBy(band.alias("band")).agg(F.count("*").alias("codes"), F.sum("n").alias("n"), F.round(F.min("l"), 4).alias("darkest"), F.round(F.max("l"), 4).alias("lightest"))


def neutral_ramp(spark, d):
    """The neutral levels in order: pixels, lightness, step from the level before, contrast against white. Four rows meet in the window."""
    ramp = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(192 + 21 * k).alias("code")) for k in range(4))))
    c = _modelled(spark.range(1).select(ramp.alias("x")).select("x.*").join(_used(spark, d), "code", "left"))
    step = F.col("l") - F.lag("l").over(Window.orderBy("level"))
    return c.select("level", F.coalesce("n", F.lit(0)).alias("n"), F.round("l", 4).alias("l"), F.round(step, 4).alias("step"), F.round(F.lit(float(panel.WHITE[1])) / F.col("Y"), 4).alias("contrast"))


def primary_shares(spark, d):
    """Each primary at full: its share of the light, its chroma, and the pixels that show it alone."""
    only = F.explode(F.array(*(F.struct(F.lit(k).alias("primary"), F.lit(_code(*(3 * (j == i) for j in range(3)))).alias("code"), F.lit(float(panel.PRIMARY[1, i])).alias("light")) for i, k in enumerate(("red", "green", "blue")))))
    c = _modelled(spark.range(1).select(only.alias("x")).select("x.*").join(_used(spark, d), "code", "left"))
    return c.select("primary", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("light") / F.sum("light").over(Window.partitionBy()), 6).alias("share"), F.round(F.hypot("a", "b"), 4).alias("chroma"))


def separable_subset(spark, d):
    """Of the colours in use, brightest first, those at least APART from all that were taken before: a fold over at most 64 elements."""
    p = _pairs(spark, d).withColumn("ends", F.array(F.struct(F.col("c1").alias("code"), F.col("c2").alias("other")), F.struct(F.col("c2").alias("code"), F.col("c1").alias("other"))))
    p = p.select("de", F.explode("ends").alias("e"))  # no filter on de: it would be pushed below the steps of the formula and repeat them
    near = p.groupBy("e.code").agg(F.collect_set(F.when(F.col("de") < APART, F.col("e.other"))).alias("near"))
    c = _modelled(_used(spark, d)).select("code", "l").join(near, "code", "left")
    row = F.struct((-F.col("l")).alias("k"), "code", F.coalesce("near", F.expr("array()").cast("array<int>")).alias("near"))
    all_ = c.agg(F.array_sort(F.collect_list(row)).alias("all"))
    taken = F.aggregate("all", F.expr("array()").cast("array<int>"), lambda kept, x: F.when(F.arrays_overlap(kept, x["near"]), kept).otherwise(F.array_append(kept, x["code"])))
    return all_.select(F.posexplode(taken).alias("place", "code"))


def top_codes(spark, d):
    """The twelve most frequent codes with their share, and the eight darkest."""
    c = _modelled(_used(spark, d)).select("code", "n", "l", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))
    most = c.orderBy(F.desc("n"), "code").limit(12).select(F.lit("frequent").alias("list"), "code", "n", "percent")
    return most.union(c.orderBy("l", "code").limit(8).select(F.lit("dark"), "code", "n", "percent"))


def _moved(spark, d):
    a = _images(spark, d)
    step = F.pmod("image", F.lit(3)).cast("int")
    return a, a.select("image", (F.col("gx") + step).alias("gx"), "gy", F.when(F.col("code") == 5, 6).otherwise(F.col("code")).alias("code"))


def shift_histogram(spark, d):
    """Best shifts of the images that differ, by how many images have them, with the mean share of pixels that still differ."""
    best = tiles.shift_search(*_moved(spark, d), "image")
    return best.groupBy("dx", "dy").agg(F.count("*").alias("images"), F.round(F.avg("pct"), 4).alias("residual"))


def pixel_diff(spark, d):
    """Pixels of each image that differ from the moved one's in place, of those that both have."""
    a, b = _moved(spark, d)
    j = a.join(b.withColumnRenamed("code", "other"), ["image", "gx", "gy"])
    return j.groupBy("image").agg(F.count("*").alias("n"), F.count_if(F.col("code") != F.col("other")).alias("differing"))


def opacity_check(spark, d):
    """The first pixel of each tile that isn't opaque, with its alpha; opaque tiles are absent."""
    at = F.col("l_orderkey") % 64 * 8 + F.col("l_linenumber")
    alpha = F.when(F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(29)) == 0, F.pmod("l_suppkey", F.lit(255))).otherwise(255)
    p = read(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 64).alias("tile"), at.alias("at"), alpha.cast("int").alias("alpha"))
    return p.where("alpha <> 255").groupBy("tile").agg(F.min(F.struct("at", "alpha")).alias("x")).select("tile", "x.at", "x.alpha")


def rle_lengths(spark, d):
    """Run-length coded size of each image's rows, by windows alone: runs, then groups of literals; an image's pixels are bounded."""
    p = _images(spark, d).select("image", (F.col("gy") * 40 + F.col("gx")).alias("at"), F.floor(F.col("code") / 16).alias("v"))
    w = Window.partitionBy("image").orderBy("at")
    p = p.withColumn("run", F.sum(F.when(F.col("v").eqNullSafe(F.lag("v").over(w)), 0).otherwise(1)).over(w))
    r = p.groupBy("image", "run").agg(F.count("*").alias("k"))
    rest = F.col("k") % 128
    r = r.select("image", "run", "k", (2 * (F.floor(F.col("k") / 128) + F.when(rest >= 3, 1).otherwise(0))).alias("coded"), F.when(rest >= 3, 0).otherwise(rest).alias("plain"))
    # Literals end at a coded run; those behind it start a new group.
    island = F.sum(F.when(F.col("coded") > 0, 1).otherwise(0)).over(Window.partitionBy("image").orderBy("run"))
    g = r.withColumn("island", island).groupBy("image", "island").agg(F.sum("k").alias("k"), F.sum("coded").alias("coded"), F.sum("plain").alias("plain"))
    return g.groupBy("image").agg(F.sum("k").alias("raw"), F.sum(F.col("coded") + F.col("plain") + F.ceil(F.col("plain") / 128)).cast("bigint").alias("rle"))


def palette_checks(spark, d):
    """Suppliers' palettes of four slots: what is wrong with each, and where."""
    k = F.col("s_suppkey")
    slot = lambda i: F.struct(((k * (i + 3)) % 5 * 60).alias("r"), (k % (i + 2) * 50).alias("g"), F.lit(0).alias("b"), F.when((k % 9 == 0) & (i == 2), 60).otherwise(192 + k % 64).alias("code"))
    slots = F.when(k % 13 == 0, F.slice(F.array(slot(0)), 1, 0)).otherwise(F.array(*map(slot, range(4))))
    return read(spark, d, "supplier").select("s_suppkey", pixels.palette_issue(slots).alias("p")).select("s_suppkey", "p.*")


def quantised_bodies(spark, d):
    """Whole documents as RGB pixels in two-bit codes; a body that is no whole number of pixels is told apart."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    q = read(spark, d, "documents").select("doc_id", F.octet_length(body).alias("n"), pixels.quantised(body).alias("q"))
    return q.select("doc_id", F.when(F.col("q.issue").isNull(), F.floor(F.col("n") / 3)).alias("pixels"), F.sha2("q.codes", 256).alias("sha256"), "q.issue")


QUERIES = {f.__name__: f for f in (panel_colours, panel_nearest, panel_slots, preview_bytes, panel_thresholds, contrast_matrix, pair_statistics, lightness_bands, neutral_ramp, primary_shares, separable_subset, top_codes, shift_histogram, pixel_diff, opacity_check, rle_lengths, palette_checks, quantised_bodies)}


def _n(v) -> str:
    return f"{float(v)!r}::DOUBLE"


def _lab_sql(x: str, y: str, z: str, white) -> str:
    f = [f"(CASE WHEN {c} / {_n(w)} > {_n((6 / 29) ** 3)} THEN cbrt({c} / {_n(w)}) ELSE {c} / {_n(w)} * {_n((29 / 6) ** 2 / 3)} + {_n(4 / 29)} END)" for c, w in zip((x, y, z), white, strict=True)]
    return f"116 * {f[1]} - 16 AS l, 500 * ({f[0]} - {f[1]}) AS a, 200 * ({f[1]} - {f[2]}) AS b"


def _level_sql(k: int, r: str, g: str, b: str) -> str:
    return f"({_n(panel.BLACK[k])} + ({r} * {_n(panel.PRIMARY[k, 0])} + {g} * {_n(panel.PRIMARY[k, 1])} + {b} * {_n(panel.PRIMARY[k, 2])}) / 3)"


def _model_sql(codes: str) -> str:
    """codes (code, ...) with XYZ and Lab."""
    ch = ("(code & 3)", "((code >> 2) & 3)", "((code >> 4) & 3)")
    xyz = ", ".join(f"{_level_sql(k, *ch)} AS {c}" for k, c in enumerate("XYZ"))
    return f"SELECT *, {_lab_sql('X', 'Y', 'Z', panel.WHITE)} FROM (SELECT *, {xyz} FROM ({codes}))"


def _preview_sql(adapted: bool) -> list[str]:
    scale = [1 / sum(m[k] * panel.WHITE[k] for k in range(3)) for m in panel.TO_SRGB] if adapted else [1 / 0.90] * 3
    out = []
    for m, s in zip(panel.TO_SRGB, scale, strict=True):
        c = f"greatest(0::DOUBLE, least(1::DOUBLE, X * {_n(m[0] * s)} + Y * {_n(m[1] * s)} + Z * {_n(m[2] * s)}))"
        out.append(f"CAST(round_even(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({c}, {_n(1 / 2.4)}) - 0.055::DOUBLE END * 255, 0) AS INTEGER)")
    return out


def _srgb_lab_sql(r: str, g: str, b: str) -> str:
    lin = [f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055::DOUBLE, 2.4::DOUBLE) END)" for c in (r, g, b)]
    return _lab_sql(*("(" + " + ".join(f"{v} * {_n(w)}" for v, w in zip(lin, m, strict=True)) + ")" for m in panel.FROM_SRGB), panel.D65)


def ciede_sql(pairs: str, keep: str) -> str:
    """keep and de of pairs, which have l1, a1, b1, l2, a2, b2."""
    return f"""SELECT {keep}, sqrt(pow(dl / sl, 2) + pow(dc / sc, 2) + pow(dh / sh, 2) + rt * (dc / sc) * (dh / sh)) AS de FROM (
      SELECT *, 1 + 0.015::DOUBLE * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2)) AS sl, 1 + 0.045::DOUBLE * cm AS sc,
        1 + 0.015::DOUBLE * cm * (1 - 0.17::DOUBLE * cos(radians(hm - 30)) + 0.24::DOUBLE * cos(radians(2 * hm)) + 0.32::DOUBLE * cos(radians(3 * hm + 6)) - 0.20::DOUBLE * cos(radians(4 * hm - 63))) AS sh,
        -sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0::DOUBLE, 7))) AS rt FROM (
      SELECT *, l2 - l1 AS dl, k2 - k1 AS dc, 2 * sqrt(k1 * k2) * sin(radians(CASE WHEN k1 * k2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END) / 2) AS dh, (l1 + l2) / 2 AS lm, (k1 + k2) / 2 AS cm,
        CASE WHEN k1 * k2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm FROM (
      SELECT *, sqrt(p1 * p1 + b1 * b1) AS k1, sqrt(p2 * p2 + b2 * b2) AS k2, CASE WHEN p1 = 0 AND b1 = 0 THEN 0 ELSE (degrees(atan2(b1, p1)) + 360) % 360 END AS h1, CASE WHEN p2 = 0 AND b2 = 0 THEN 0 ELSE (degrees(atan2(b2, p2)) + 360) % 360 END AS h2 FROM (
      SELECT *, a1 * (1 + g) AS p1, a2 * (1 + g) AS p2 FROM (SELECT *, 0.5::DOUBLE * (1 - sqrt(pow(c0, 7) / (pow(c0, 7) + pow(25.0::DOUBLE, 7)))) AS g FROM (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS c0 FROM ({pairs})))))))"""


_USED = f"SELECT {_CODE} AS code, count(*) AS n FROM ({_PX}) GROUP BY 1"
_MODEL = _model_sql(_USED)
_PAIRS = ciede_sql(f"SELECT p.code AS c1, q.code AS c2, p.l AS l1, p.a AS a1, p.b AS b1, q.l AS l2, q.a AS a2, q.b AS b2 FROM m p JOIN m q ON p.code < q.code", "c1, c2")
_ALL = f"SELECT code, l AS cl, a AS ca, b AS cb FROM ({_model_sql('SELECT unnest(range(192, 256)) AS code')})"
_ORDER = "(code & 3) * 16 + ((code >> 2) & 3) * 4 + ((code >> 4) & 3)"
_GREY = "SELECT CAST((l_partkey * 7 + l_suppkey) % 256 AS INTEGER) AS {}, count(*) AS n FROM lineitem GROUP BY 1"
_T = panel.thresholds()
_SHIFT = f"""a AS (SELECT * FROM ({_IMG})), b AS (SELECT image, gx + image % 3 AS gx, gy, CASE WHEN code = 5 THEN 6 ELSE code END AS code FROM a)"""


def _grey_de(q: str) -> str:
    to = f"SELECT grey, l AS l2, a AS a2, b AS b2 FROM (SELECT grey, {_lab_sql('X', 'Y', 'Z', panel.WHITE)} FROM (SELECT grey, {', '.join(f'{_level_sql(k, q, q, q)} AS {c}' for k, c in enumerate('XYZ'))} FROM g))"
    return ciede_sql(f"SELECT * FROM (SELECT grey, l AS l1, a AS a1, b AS b1 FROM (SELECT grey, {_srgb_lab_sql('grey', 'grey', 'grey')} FROM g)) JOIN ({to}) USING (grey)", "grey")


SQL = {
    "panel_colours": f"SELECT code, n, round(Y, 9) AS y, round(l, 6) + 0 AS l, round(a, 6) + 0 AS a, round(b, 6) + 0 AS b, {', '.join(f'{v} AS seen_{k}' for k, v in zip('rgb', _preview_sql(True), strict=True))}, {', '.join(f'{v} AS dim_{k}' for k, v in zip('rgb', _preview_sql(False), strict=True))} FROM ({_MODEL})",
    "panel_nearest": f"""WITH p AS (SELECT r, g, b, dx, dy, count(*) AS n FROM (SELECT *, CAST(l_orderkey % 4 AS INTEGER) AS dx, l_linenumber % 4 AS dy FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 7 % 256 AS INTEGER) AS r, CAST(l_suppkey * 11 % 256 AS INTEGER) AS g, CAST(l_orderkey * 13 % 256 AS INTEGER) AS b FROM lineitem)) GROUP BY ALL),
      q AS (SELECT n, dx, dy, {_srgb_lab_sql('r', 'g', 'b')} FROM p), s AS (SELECT *, list_value({', '.join(map(str, panel.BAYER))})[dy * 4 + dx + 1] / 16.0::DOUBLE - 0.5::DOUBLE AS t FROM q), k AS ({_ALL}),
      d AS (SELECT 'plain' AS how, n, l, a, b FROM s UNION ALL SELECT 'dither', n, l + t * 14, a + t * 6, b + t * 6 FROM s), e AS (SELECT *, row_number() OVER () AS i FROM d),
      w AS (SELECT i, any_value(how) AS how, any_value(n) AS n, arg_min(code, (l - cl) * (l - cl) + (a - ca) * (a - ca) + (b - cb) * (b - cb)) AS code FROM e, k GROUP BY i) SELECT how, CAST(code AS INTEGER) AS code, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY ALL""",
    "panel_slots": f"""WITH p AS (SELECT r, g, b, count(*) AS n FROM ({_PX}) GROUP BY ALL), q AS (SELECT r AS pr, g AS pg, b AS pb, n, {_CODE} IN ({', '.join(map(str, SLOT_CODES))}) AS is_on FROM p),
      s AS (SELECT n, is_on, {_srgb_lab_sql('pr', 'pg', 'pb')} FROM q), e AS (SELECT *, row_number() OVER () AS i FROM s), k AS (SELECT * FROM ({_ALL}) WHERE code IN ({', '.join(map(str, SLOT_CODES))})),
      w AS (SELECT i, any_value(n) AS n, any_value(is_on) AS is_on, arg_min(code, (l - cl) * (l - cl) + (a - ca) * (a - ca) + (b - cb) * (b - cb)) AS slot FROM e, k GROUP BY i)
      SELECT CAST(slot AS INTEGER) AS slot, CAST(sum(n) AS BIGINT) AS n, round(coalesce(sum(n) FILTER (is_on), 0) * 100.0::DOUBLE / sum(n), 6) AS percent_on FROM w GROUP BY 1""",
    "preview_bytes": f"""SELECT CASE WHEN code >> 6 = 3 THEN {' || '.join(f"printf('%02X', {v})" for v in _preview_sql(True))} ELSE 'FF00FF' END AS rgb, CAST(sum(n) AS BIGINT) AS n, count(*) AS codes FROM ({_model_sql(_GREY.format('code'))}) GROUP BY 1""",
    "panel_thresholds": f"""WITH g0 AS ({_GREY.format('grey')}), g AS (SELECT *, CASE WHEN grey <= 42 THEN 0 WHEN grey <= 127 THEN 1 WHEN grey <= 212 THEN 2 ELSE 3 END AS fixed, CASE WHEN grey < {_n(_T[0])} THEN 0 WHEN grey < {_n(_T[1])} THEN 1 WHEN grey < {_n(_T[2])} THEN 2 ELSE 3 END AS own FROM g0),
      f AS ({_grey_de('fixed')}), o AS ({_grey_de('own')}) SELECT (SELECT CAST(sum(n) AS BIGINT) FROM g) AS pixels, (SELECT CAST(coalesce(sum(n) FILTER (fixed <> own), 0) AS BIGINT) FROM g) AS differing,
      (SELECT round(avg(de), 4) FROM f) AS fixed_mean, (SELECT round(avg(de), 4) FROM o) AS own_mean, (SELECT round(max(de), 4) FROM f) AS fixed_worst, (SELECT round(max(de), 4) FROM o) AS own_worst""",
    "contrast_matrix": f"""WITH k AS (SELECT * FROM (VALUES {', '.join(f"('{name}', {_code(*v)})" for name, *v in NAMED)}) t(name, code)), m AS ({_model_sql('SELECT * FROM k')}), u AS ({_USED}),
      c AS (SELECT name, coalesce(n, 0) AS n, Y FROM m LEFT JOIN u USING (code)) SELECT c.name, c.n, {', '.join(f"max(CASE WHEN o.name = '{k}' AND c.name <> o.name THEN round(greatest(c.Y, o.Y) / least(c.Y, o.Y), 4) END) AS {k}" for k, *_ in NAMED)} FROM c, c o GROUP BY c.name, c.n""",
    "pair_statistics": f"WITH m AS ({_MODEL}), p AS ({_PAIRS}) SELECT count(*) AS pairs, round(min(de), 4) AS least, round(median(de), 4) AS median, round(max(de), 4) AS greatest, {', '.join(f'count(*) FILTER (de < {t}) AS under_{t}' for t in (1, 2, 3, 5))} FROM p",
    "lightness_bands": f"SELECT CASE WHEN l < 40 THEN 'ink' WHEN l < 50 THEN 'dark' WHEN l > 80 THEN 'paper' ELSE 'middle' END AS band, count(*) AS codes, CAST(sum(n) AS BIGINT) AS n, round(min(l), 4) AS darkest, round(max(l), 4) AS lightest FROM ({_MODEL}) GROUP BY 1",
    "neutral_ramp": f"""WITH k AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS level), m AS ({_model_sql('SELECT level, 192 + 21 * level AS code FROM k')}), u AS ({_USED})
      SELECT level, coalesce(n, 0) AS n, round(l, 4) AS l, round(l - lag(l) OVER (ORDER BY level), 4) AS step, round({_n(panel.WHITE[1])} / Y, 4) AS contrast FROM m LEFT JOIN u USING (code)""",
    "primary_shares": f"""WITH k AS (SELECT * FROM (VALUES ('red', 195, {_n(panel.PRIMARY[1, 0])}), ('green', 204, {_n(panel.PRIMARY[1, 1])}), ('blue', 240, {_n(panel.PRIMARY[1, 2])})) t("primary", code, light)), m AS ({_model_sql('SELECT * FROM k')}), u AS ({_USED})
      SELECT "primary", coalesce(n, 0) AS n, round(light / sum(light) OVER (), 6) AS share, round(sqrt(a * a + b * b), 4) AS chroma FROM m LEFT JOIN u USING (code)""",
    "separable_subset": f"""WITH RECURSIVE m AS ({_MODEL}), p AS ({_PAIRS}), near AS (SELECT c1 AS code, c2 AS other FROM p WHERE de < {APART} UNION ALL SELECT c2, c1 FROM p WHERE de < {APART}),
      o AS (SELECT m.code, row_number() OVER (ORDER BY m.l DESC, m.code) AS i, (SELECT coalesce(list(other), []) FROM near WHERE near.code = m.code) AS near FROM m),
      f AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(kept, o.near) THEN kept ELSE list_append(kept, CAST(o.code AS INTEGER)) END FROM f JOIN o ON o.i = f.i + 1)
      SELECT CAST(generate_subscripts(kept, 1) - 1 AS INTEGER) AS place, unnest(kept) AS code FROM (SELECT kept FROM f ORDER BY i DESC LIMIT 1)""",
    "top_codes": f"""WITH m AS (SELECT code, n, l, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM ({_MODEL})) SELECT 'frequent' AS list, code, n, percent FROM (SELECT * FROM m ORDER BY n DESC, code LIMIT 12) UNION ALL SELECT 'dark', code, n, percent FROM (SELECT * FROM m ORDER BY l, code LIMIT 8)""",
    "shift_histogram": f"""WITH {_SHIFT}, m AS (SELECT image, dx, dy, gx + dx AS gx, gy + dy AS gy, code FROM a, (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS dx), (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS dy)),
      s AS (SELECT m.image, dx, dy, round(count(*) FILTER (m.code <> b.code) * 100.0::DOUBLE / count(*), 6) AS pct FROM m JOIN b ON m.image = b.image AND m.gx = b.gx AND m.gy = b.gy GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY pct, dy, dx) AS r FROM s) SELECT dx, dy, count(*) AS images, round(avg(pct), 4) AS residual FROM k WHERE r = 1 GROUP BY dx, dy""",
    "pixel_diff": f"WITH {_SHIFT} SELECT a.image, count(*) AS n, count(*) FILTER (a.code <> b.code) AS differing FROM a JOIN b ON a.image = b.image AND a.gx = b.gx AND a.gy = b.gy GROUP BY a.image",
    "opacity_check": """SELECT l_orderkey // 64 AS tile, min(l_orderkey % 64 * 8 + l_linenumber) AS "at", CAST(arg_min(l_suppkey % 255, (l_orderkey % 64 * 8 + l_linenumber) * 1000 + l_suppkey % 255) AS INTEGER) AS alpha FROM lineitem WHERE (l_partkey + l_suppkey) % 29 = 0 GROUP BY 1""",
    "rle_lengths": f"""WITH p AS (SELECT image, gy * 40 + gx AS i, code // 16 AS v FROM ({_IMG})), g AS (SELECT image, i, v, row_number() OVER (PARTITION BY image ORDER BY i) - row_number() OVER (PARTITION BY image, v ORDER BY i) AS isl FROM p),
      r AS (SELECT image, min(i) AS st, count(*) AS k FROM g GROUP BY image, v, isl), s AS (SELECT image, st, k, 2 * (k // 128 + CASE WHEN k % 128 >= 3 THEN 1 ELSE 0 END) AS coded, CASE WHEN k % 128 >= 3 THEN 0 ELSE k % 128 END AS plain FROM r),
      t AS (SELECT *, sum(CASE WHEN coded > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image ORDER BY st ROWS UNBOUNDED PRECEDING) AS grp FROM s), l AS (SELECT image, grp, sum(k) AS k, sum(coded) AS coded, sum(plain) AS plain FROM t GROUP BY image, grp)
      SELECT image, CAST(sum(k) AS BIGINT) AS raw, CAST(sum(coded + plain + ceil(plain / 128.0)) AS BIGINT) AS rle FROM l GROUP BY image""",
}
#: The Lab values of pair_distance, by the other difference.
_SRGB_LAB = pixel_queries.SQL["pair_distance"].split("SELECT p.code AS c1")[0]
SQL["ciede2000_pairs"] = _SRGB_LAB + f"SELECT c1, c2, round(de, 4) AS de FROM ({ciede_sql('SELECT p.code AS c1, q.code AS c2, p.l AS l1, p.a AS a1, p.b AS b1, q.l AS l2, q.a AS a2, q.b AS b2 FROM l p JOIN l q ON p.code < q.code', 'c1, c2')})"
_SLOT = "{{'c': CAST((s_suppkey * ({i} + 3)) % 5 * 60 AS BIGINT) * 65536 + CAST(s_suppkey % ({i} + 2) * 50 AS BIGINT), 'code': CASE WHEN s_suppkey % 9 = 0 AND {i} = 2 THEN 60 ELSE 192 + s_suppkey % 64 END}}"
SQL["palette_checks"] = f"""WITH s AS (SELECT s_suppkey, [{', '.join(_SLOT.format(i=i) for i in range(4))}] AS p FROM supplier),
  j AS (SELECT s_suppkey, i - 1 AS i, k - 1 AS k FROM s, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS k) WHERE i < k AND p[i].c = p[k].c), m AS (SELECT s_suppkey, min(i * 10 + k) AS ik FROM j GROUP BY 1)
  SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'empty' WHEN s_suppkey % 9 = 0 THEN 'not_opaque' WHEN ik IS NOT NULL THEN 'duplicate_colour' END AS issue,
    CAST(CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN 2 ELSE ik // 10 END AS INTEGER) AS first, CAST(CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 9 <> 0 THEN ik % 10 END AS INTEGER) AS second FROM s LEFT JOIN m USING (s_suppkey)"""
_BYTE = "CAST('0x' || substr(h, {}, 2) AS INTEGER)"
_Q2 = lambda v: f"(CASE WHEN {v} <= 42 THEN 0 WHEN {v} <= 127 THEN 1 WHEN {v} <= 212 THEN 2 ELSE 3 END)"
SQL["quantised_bodies"] = f"""WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  q AS (SELECT doc_id, length(h) // 2 AS n, list_transform(range(0, CASE WHEN length(h) % 6 = 0 THEN length(h) // 6 ELSE 0 END), lambda i: printf('%02X', 192 + {_Q2(_BYTE.format('6 * i + 5'))} * 16 + {_Q2(_BYTE.format('6 * i + 3'))} * 4 + {_Q2(_BYTE.format('6 * i + 1'))})) AS c FROM b)
  SELECT doc_id, CASE WHEN n % 3 = 0 THEN n // 3 END AS pixels, CASE WHEN n % 3 = 0 THEN sha256(from_hex(array_to_string(c, ''))) END AS sha256, CASE WHEN n % 3 <> 0 THEN 'length' END AS issue FROM q"""
