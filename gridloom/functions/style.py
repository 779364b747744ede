"""Style rules as columns: filters and values written as JSON expressions, compiled once into Spark's own.

An expression is a literal or [operator, arguments...]. A feature's properties are a map of strings; numbers are read from them where a number is asked for. What is
unknown or has the wrong shape is an error that names its place. Missing properties are null; comparisons with null are false, as a filter's answer always
is true or false."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class StyleError(ValueError):
    """What is wrong with a style, and where."""

    def __init__(self, place: str, what: str):
        super().__init__(f"{place}: {what}")


class Feature:
    """The columns that expressions read: properties (a map of strings), zoom and kind of geometry."""

    def __init__(self, properties: Column | str = "properties", zoom: Column | str = "zoom", geometry: Column | str = "geometry"):
        self.properties, self.zoom, self.geometry = (F.col(c) if isinstance(c, str) else c for c in (properties, zoom, geometry))


def _literal(v, place: str) -> Column:
    if v is None or isinstance(v, bool | int | float | str):
        return F.lit(v)
    raise StyleError(place, f"no literal: {json.dumps(v)}")


def _is_number(e) -> bool:
    return isinstance(e, int | float) and not isinstance(e, bool) or isinstance(e, list) and bool(e) and e[0] in ("zoom", "to-number", "+", "-", "*", "/", "step", "interpolate")


def _need(e: list, place: str, least: int, most: int | None = None) -> None:
    n = len(e) - 1
    if n < least or most is not None and n > most:
        raise StyleError(place, f"{e[0]} takes {least if most == least else f'{least} to {most}' if most else f'at least {least}'} arguments, not {n}")


def value(e, f: Feature, place: str = "value") -> Column:
    """An expression as a column: text, number or truth value by what it says."""
    if not isinstance(e, list):
        return _literal(e, place)
    if not e or not isinstance(e[0], str):
        raise StyleError(place, "an operator's name must come first")
    known = _OPERATORS.get(e[0])
    if known is None:
        raise StyleError(place, f"unknown operator {e[0]}")
    return known(e, f, place)


def number(e, f: Feature, place: str) -> Column:
    c = value(e, f, place)
    return c if _is_number(e) else c.try_cast("double")


def truth(e, f: Feature, place: str = "filter") -> Column:
    """A filter: true or false, never null."""
    if isinstance(e, bool):
        return F.lit(e)
    if not isinstance(e, list) or not e or e[0] in _OPERATORS and e[0] not in _TRUTHS:
        raise StyleError(place, f"no truth value: {json.dumps(e)}")
    c = value(e, f, place)
    return F.coalesce(c, F.lit(False))


def _get(e, f, place):
    _need(e, place, 1, 1)
    if not isinstance(e[1], str):
        raise StyleError(f"{place}[1]", "a property's name must be text")
    return F.try_element_at(f.properties, F.lit(e[1]))


def _has(e, f, place):
    return _get(["get", *e[1:]], f, place).isNotNull()


def _compared(symbol: str) -> Callable:
    def make(e, f, place):
        _need(e, place, 2, 2)
        if _is_number(e[1]) or _is_number(e[2]) or symbol not in ("==", "!="):
            a, b = (number(e[k], f, f"{place}[{k}]") for k in (1, 2))
        else:
            a, b = (value(e[k], f, f"{place}[{k}]").cast("string") for k in (1, 2))
        return {"==": a == b, "!=": ~a.eqNullSafe(b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[symbol]

    return make


def _joined(symbol: str) -> Callable:
    def make(e, f, place):
        out = F.lit(symbol == "all")
        for k, x in enumerate(e[1:], 1):
            t = truth(x, f, f"{place}[{k}]")
            out = out & t if symbol == "all" else out | t
        return out

    return make


def _not(e, f, place):
    _need(e, place, 1, 1)
    return ~truth(e[1], f, f"{place}[1]")


def _in(e, f, place):
    _need(e, place, 2, 2)
    options = e[2][1] if isinstance(e[2], list) and len(e[2]) == 2 and e[2][0] == "literal" else None
    if not isinstance(options, list) or not options:
        raise StyleError(f"{place}[2]", 'a list must be written as ["literal", [...]]')
    return _among(e[1], options, f, place)


def _among(what, options: list, f: Feature, place: str) -> Column:
    numbers = [isinstance(x, int | float) and not isinstance(x, bool) for x in options]
    if any(numbers) != all(numbers):
        raise StyleError(place, "labels must be all text or all numbers")
    return number(what, f, f"{place}[1]").isin([float(x) for x in options]) if all(numbers) else value(what, f, f"{place}[1]").cast("string").isin([str(x) for x in options])


def _match(e, f, place):
    if len(e) % 2 == 0:
        raise StyleError(place, "match needs a default")
    _need(e, place, 4)
    out, seen = None, set()
    for k in range(2, len(e) - 1, 2):
        labels = e[k] if isinstance(e[k], list) else [e[k]]
        if not labels or seen & {json.dumps(x) for x in labels}:
            raise StyleError(f"{place}[{k}]", "labels must be there and differ")
        seen |= {json.dumps(x) for x in labels}
        test, then = F.coalesce(_among(e[1], labels, f, place), F.lit(False)), value(e[k + 1], f, f"{place}[{k + 1}]")
        out = F.when(test, then) if out is None else out.when(test, then)
    return out.otherwise(value(e[-1], f, f"{place}[{len(e) - 1}]"))


def _case(e, f, place):
    _need(e, place, 3)
    if len(e) % 2:
        raise StyleError(place, "case needs a fallback")
    out = None
    for k in range(1, len(e) - 1, 2):
        test, then = truth(e[k], f, f"{place}[{k}]"), value(e[k + 1], f, f"{place}[{k + 1}]")
        out = F.when(test, then) if out is None else out.when(test, then)
    return out.otherwise(value(e[-1], f, f"{place}[{len(e) - 1}]"))


def _coalesce(e, f, place):
    _need(e, place, 1)
    return F.coalesce(*(value(x, f, f"{place}[{k}]") for k, x in enumerate(e[1:], 1)))


def _stops(e, at: int, place: str) -> list[tuple[float, object, int]]:
    rest = e[at:]
    if len(rest) % 2 or not rest:
        raise StyleError(place, "stops come in pairs of input and output")
    stops = [(rest[k], rest[k + 1], at + k + 1) for k in range(0, len(rest), 2)]
    if any(isinstance(s, bool) or not isinstance(s, int | float) for s, _, _ in stops) or any(a[0] >= b[0] for a, b in zip(stops, stops[1:])):
        raise StyleError(place, "stops must be numbers that rise")
    return stops


def _step(e, f, place):
    _need(e, place, 2)
    x, out = number(e[1], f, f"{place}[1]"), value(e[2], f, f"{place}[2]")
    for s, v, k in _stops(e, 3, place) if len(e) > 3 else []:
        out = F.when(x >= s, value(v, f, f"{place}[{k}]")).otherwise(out)
    return F.when(x.isNotNull(), out)


def _interpolate(e, f, place):
    _need(e, place, 4)
    if e[1] != ["linear"]:
        raise StyleError(f"{place}[1]", 'only ["linear"] is known')
    x, stops = number(e[2], f, f"{place}[2]"), _stops(e, 3, place)
    outs = [number(v, f, f"{place}[{k}]").cast("double") for _, v, k in stops]
    out = F.when(x <= stops[0][0], outs[0])
    for (a, _, _), (b, _, _), u, v in zip(stops, stops[1:], outs, outs[1:]):
        out = out.when(x <= b, u + (v - u) * ((x - a) / (b - a)))
    return out.when(x > stops[-1][0], outs[-1])


def _arithmetic(e, f, place):
    _need(e, place, 1 if e[0] == "-" else 2, 2 if e[0] in "-/" else None)
    xs = [number(x, f, f"{place}[{k}]").cast("double") for k, x in enumerate(e[1:], 1)]
    if len(xs) == 1:
        return -xs[0]
    out = xs[0]
    for x in xs[1:]:
        out = out + x if e[0] == "+" else out - x if e[0] == "-" else out * x if e[0] == "*" else F.try_divide(out, x)
    return out


def _plain(of: Callable[[Feature], Column]) -> Callable:
    def make(e, f, place):
        _need(e, place, 0, 0)
        return of(f)

    return make


def _lit(e, f, place):
    _need(e, place, 1, 1)
    return _literal(e[1], f"{place}[1]")


def _to(kind: str) -> Callable:
    def make(e, f, place):
        _need(e, place, 1, 1)
        return value(e[1], f, f"{place}[1]").try_cast(kind)

    return make


_OPERATORS: dict[str, Callable] = {
    "get": _get, "has": _has, "zoom": _plain(lambda f: f.zoom), "geometry-type": _plain(lambda f: f.geometry), "literal": _lit, "to-number": _to("double"), "to-string": _to("string"),
    "all": _joined("all"), "any": _joined("any"), "!": _not, "in": _in, "match": _match, "case": _case, "coalesce": _coalesce, "step": _step, "interpolate": _interpolate,
    **{s: _compared(s) for s in ("==", "!=", "<", "<=", ">", ">=")}, **dict.fromkeys("+-*/", _arithmetic),
}
_TRUTHS = {"has", "all", "any", "!", "in", "match", "case", "coalesce", "step", "==", "!=", "<", "<=", ">", ">="}
#: What a layer may have, with the kinds of geometry that it draws.
KINDS = {"background": (), "fill": ("Polygon",), "line": ("LineString", "Polygon"), "symbol": ("Point", "LineString", "Polygon"), "circle": ("Point",)}


def layers(style: str, f: Feature, source_layer: Column | str = "source_layer") -> list[tuple[str, Column, dict[str, Column]]]:
    """(id, which features it draws, its paint values) of each layer of a style, in the order of drawing; background layers draw no features."""
    try:
        told = json.loads(style)
    except ValueError as e:
        raise StyleError("style", f"no JSON: {e}") from None
    if not isinstance(told, dict) or not isinstance(told.get("layers"), list):
        raise StyleError("style", "layers are missing")
    at, out, seen = F.col(source_layer) if isinstance(source_layer, str) else source_layer, [], set()
    for k, layer in enumerate(told["layers"]):
        place = f"layers[{k}]"
        if not isinstance(layer, dict) or not isinstance(layer.get("id"), str) or layer["id"] in seen:
            raise StyleError(place, "an id of its own is missing")
        seen.add(layer["id"])
        if layer.get("type") not in KINDS:
            raise StyleError(f"{place}.type", f"unknown type {layer.get('type')}")
        if layer["type"] == "background":
            continue
        shown = at.eqNullSafe(F.lit(layer.get("source-layer"))) & f.geometry.isin(list(KINDS[layer["type"]]))
        for name, bound in (("minzoom", lambda b: f.zoom >= b), ("maxzoom", lambda b: f.zoom < b)):
            if name in layer:
                if isinstance(layer[name], bool) or not isinstance(layer[name], int | float):
                    raise StyleError(f"{place}.{name}", "a number is missing")
                shown = shown & bound(layer[name])
        if "filter" in layer:
            shown = shown & truth(layer["filter"], f, f"{place}.filter")
        paint = {name: value(e, f, f"{place}.paint.{name}") for name, e in layer.get("paint", {}).items() if not (isinstance(e, list) and (not e or not isinstance(e[0], str)))}
        out.append((layer["id"], F.coalesce(shown, F.lit(False)), paint))
    return out


def drawn(features: DataFrame, style: str, f: Feature | None = None, paint: str | None = None) -> DataFrame:
    """features with a row for each layer that draws them: its place in the order, its id and, if asked for, the value of one paint property as text."""
    f = f or Feature()
    of = [F.when(shown, F.struct(F.lit(k).alias("place"), F.lit(name).alias("layer"), (p[paint].cast("string") if paint in p else F.lit(None).cast("string")).alias("paint"))) for k, (name, shown, p) in enumerate(layers(style, f))]
    if not of:
        return features.limit(0).select("*", F.lit(0).alias("place"), F.lit("").alias("layer"), F.lit("").alias("paint"))
    return features.withColumn("_l", F.explode(F.array_compact(F.array(*of)))).select("*", "_l.*").drop("_l")
