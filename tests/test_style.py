"""Style expressions against plain evaluation, and what is wrong with a style."""

import json

import pytest

from gridloom.functions import style

ROWS = [("road", "LineString", 12.0, {"kind": "major", "lanes": "4", "name": "A"}), ("road", "LineString", 9.5, {"kind": "path", "lanes": "x"}), ("water", "Polygon", 14.0, {"kind": "lake"}), ("road", "Point", 13.0, {}), ("road", "LineString", None, None), (None, "Polygon", 3.0, {"kind": None})]
SCHEMA = "source_layer string, geometry string, zoom double, properties map<string,string>"


def plain(e, p, zoom, geometry):
    """The same semantics, spelled out."""
    if not isinstance(e, list):
        return e
    op, args = e[0], e[1:]
    num = lambda x: None if x is None else float(x) if not isinstance(x, str) or x.replace(".", "", 1).lstrip("-").isdigit() else None
    go = lambda x: plain(x, p, zoom, geometry)
    yes = lambda x: bool(go(x))
    if op == "get":
        return (p or {}).get(args[0])
    if op == "has":
        return (p or {}).get(args[0]) is not None
    if op in ("zoom", "geometry-type"):
        return zoom if op == "zoom" else geometry
    if op in ("all", "any"):
        return all(map(yes, args)) if op == "all" else any(map(yes, args))
    if op == "!":
        return not yes(args[0])
    if op in ("==", "!="):
        a, b = map(go, args)
        if style._is_number(args[0]) or style._is_number(args[1]):
            a, b = num(a), num(b)
        return a is not None and b is not None and a == b if op == "==" else a != b
    if op in ("<", "<=", ">", ">="):
        a, b = (num(go(x)) for x in args)
        return a is not None and b is not None and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if op == "in":
        return go(args[0]) in args[1][1]
    if op == "match":
        v = go(args[0])
        for labels, out in zip(args[1:-1:2], args[2:-1:2], strict=True):
            if v is not None and v in (labels if isinstance(labels, list) else [labels]):
                return go(out)
        return go(args[-1])
    if op == "case":
        return next((go(out) for test, out in zip(args[:-1:2], args[1:-1:2], strict=True) if yes(test)), go(args[-1]))
    raise AssertionError(op)


FILTERS = [
    ["match", ["get", "kind"], ["major", "minor"], True, False], ["match", ["get", "kind"], "path", False, ["lake", "sea"], True, ["has", "name"]], ["==", ["get", "kind"], "major"], ["!=", ["get", "kind"], "major"],
    [">=", ["get", "lanes"], 3], ["<", ["zoom"], 10], ["==", ["geometry-type"], "LineString"], ["all", ["has", "kind"], ["any", [">", ["zoom"], 13], ["==", ["get", "lanes"], 4]]], ["!", ["has", "kind"]],
    ["in", ["get", "kind"], ["literal", ["lake", "major"]]], ["case", ["has", "name"], ["<", ["zoom"], 11], [">", ["zoom"], 11]], True, False, ["all"], ["any"],
]


@pytest.mark.parametrize("k", range(len(FILTERS)))
def test_filters(spark, k):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [r[0] for r in df.select(style.truth(FILTERS[k], style.Feature())).collect()]
    assert got == [bool(plain(FILTERS[k], p, z, g)) for _, g, z, p in ROWS]


def test_values(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    of = lambda e: [r[0] for r in df.select(style.value(e, style.Feature())).collect()]
    assert of(["interpolate", ["linear"], ["zoom"], 10, 1, 14, 9]) == [5.0, 1.0, 9.0, 7.0, None, 1.0]
    assert of(["step", ["zoom"], "far", 10, "mid", 13, "near"]) == ["mid", "far", "near", "near", None, "far"]
    assert of(["coalesce", ["get", "name"], ["get", "kind"], "none"]) == ["A", "path", "lake", "none", "none", "none"]
    assert of(["*", ["to-number", ["get", "lanes"]], 2]) == [8.0, None, None, None, None, None] and of(["/", ["zoom"], 0]) == [None] * 6


@pytest.mark.parametrize(
    ("e", "place"),
    [(["nope"], "filter: unknown"), (["all", ["has", "a"], ["match", ["get", "b"], "x", True]], r"filter\[2\]: match needs a default"), (["match", ["get", "b"], ["x", 1], True, False], "all text or all numbers"), (["match", ["get", "b"], "x", True, "x", False, True], r"filter\[4\]: labels"), ("text", "no truth value"),
     (["get", "a"], "no truth value"), (["in", ["get", "a"], ["b"]], r"filter\[2\]: a list"), (["!"], "takes 1 arguments, not 0"), (["==", ["get", 5], 1], r"filter\[1\]\[1\]: a property"), (["any", ["==", ["step", ["zoom"], 1, 5, 2, 4, 3], 1]], r"filter\[1\]\[1\]: stops"), ([], "no truth value")],
)
def test_errors_name_their_place(spark, e, place):
    with pytest.raises(style.StyleError, match=place):
        style.truth(e, style.Feature())


def test_layers(spark):
    told = {"layers": [{"id": "bg", "type": "background"}, {"id": "roads", "type": "line", "source-layer": "road", "minzoom": 10, "filter": FILTERS[0], "paint": {"line-width": ["case", ["has", "name"], 4, 2], "line-dasharray": [3, 3]}}, {"id": "names", "type": "symbol", "source-layer": "road", "maxzoom": 13}, {"id": "water", "type": "fill", "source-layer": "water", "paint": {"line-width": 1}}]}
    got = style.drawn(spark.createDataFrame(ROWS, SCHEMA), json.dumps(told), paint="line-width")
    assert sorted((r["place"], r["layer"], r["zoom"], r["paint"]) for r in got.collect()) == [(0, "roads", 12.0, "4"), (1, "names", 9.5, None), (1, "names", 12.0, None), (2, "water", 14.0, "1")]
    for bad, place in (("{", "style: no JSON"), ("{}", "layers are missing"), ('{"layers": [{"id": "a", "type": "x"}]}', r"layers\[0\].type"), ('{"layers": [{"type": "fill"}]}', "id of its own"), ('{"layers": [{"id": "a", "type": "fill", "minzoom": "3"}]}', "minzoom"), ('{"layers": [{"id": "a", "type": "fill", "filter": ["has"]}]}', r"layers\[0\].filter")):
        with pytest.raises(style.StyleError, match=place):
            style.layers(bad, style.Feature())
    assert style.drawn(spark.createDataFrame(ROWS, SCHEMA), '{"layers": []}').collect() == []
