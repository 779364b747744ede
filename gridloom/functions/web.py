"""URL, header and text-policy columns."""

from __future__ import annotations

import html as html_entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Month names of HTTP dates, in order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DEFAULT_US, OSM_US = 250_000, 500_000


def host(url: Column) -> Column:
    """The lower-case host: no user, port or brackets; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    name = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":.*$", ""))
    return F.nullif(F.lower(name), F.lit(""))


def is_loopback(h: Column) -> Column:
    octets = F.transform(F.split(h, r"\."), lambda o: o.try_cast("int"))
    four = h.rlike(r"^127(\.[0-9]{1,3}){3}$") & F.forall(octets, lambda o: o <= 255)
    return (h == "localhost") | h.endswith(".localhost") | (h == "::1") | F.coalesce(four, F.lit(False))


def is_osm(h: Column) -> Column:
    return (h == "openstreetmap.org") | h.endswith(".openstreetmap.org")


def interval_us(h: Column, override: Column | None = None) -> Column:
    """Least time between requests to a host: an override, else none on loopback, else by policy."""
    policy = F.when(is_loopback(h), 0).when(is_osm(h), OSM_US).otherwise(DEFAULT_US)
    return F.coalesce(override, policy) if override is not None else policy


def missing_placeholders(template: Column) -> Column:
    return F.filter(F.array(F.lit("z"), F.lit("x"), F.lit("y")), lambda p: ~F.contains(template, F.concat(F.lit("{"), p, F.lit("}"))))


def expand(template: Column, z: Column, x: Column, y: Column) -> Column:
    out = template
    for name, c in (("z", z), ("x", x), ("y", y)):
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def with_query(url: Column, key: Column, value: Column) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), key, F.lit("="), value)


def split_once(text: Column, mark: str, trim_value: bool = True) -> Column:
    """struct(name, value) around the first mark: a header trims both, a query pair the name alone; null without a mark or with an empty name."""
    at = F.instr(text, mark)
    name, value = F.trim(F.substring(text, F.lit(1), at - 1)), F.substring(text, at + 1, F.length(text))
    return F.when((at > 0) & (name != ""), F.struct(name.alias("name"), (F.trim(value) if trim_value else value).alias("value")))


def http_date(text: Column) -> Column:
    """Unix seconds of an IMF-fixdate, leniently: no weekday check, any day to 31, second to 60; else null."""
    p = F.split(F.trim(F.regexp_replace(text, "^[^,]*,", "")), r"\s+")
    t = F.split(F.get(p, F.lit(3)), ":")
    num = lambda c: c.try_cast("int")
    d, mo, y = num(F.get(p, F.lit(0))), F.array_position(F.array(*map(F.lit, MONTHS)), F.get(p, F.lit(1))).cast("int"), num(F.get(p, F.lit(2)))
    h, mi, s = (num(F.get(t, F.lit(k))) for k in range(3))
    good = (d >= 1) & (d <= 31) & (mo >= 1) & (y >= 1970) & (h <= 23) & (mi <= 59) & (s <= 60)
    days = F.datediff(F.make_date(y, mo, F.lit(1)), F.lit("1970-01-01").cast("date")) + d - 1
    return F.when(good, days.cast("bigint") * 86400 + h * 3600 + mi * 60 + s)


def retry_after(text: Column, now: Column) -> Column:
    """Seconds to wait: a number, or a date from now on, not below 0; else null."""
    return F.coalesce(F.trim(text).try_cast("bigint"), F.greatest(F.lit(0), http_date(text) - now))


def attribution_issue(text: Column) -> Column:
    """The kind of the first character that a one-line attribution can't hold, `empty`, or null."""
    c = F.regexp_extract(text, "([\\x{0}-\\x{1f}\\x{7f}\\x{85}\\x{2028}\\x{2029}])", 1)
    kinds = {"\n": "lf", "\r": "cr", "\u0085": "nel", " ": "ls", " ": "ps", "\x7f": "del"}
    kind = F.when(c == "", None)
    for k, v in kinds.items():
        kind = kind.when(c == k, v)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty").otherwise(kind.otherwise("c0"))


#: Elements whose bodies are no text, and the five entities of XML.
SILENT = ("script", "style", "noscript", "svg")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


_ELEMENTS = (*((rf"<{tag}\b", rf"</{tag}\s*+>") for tag in SILENT), ("<", ">"))


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _closed(text: Column, opening: str, closing: str) -> Column:
    """text without what lies from an opening to the next closing. Only the part up to the last closing is searched, so openings that are never closed cost nothing."""

    def cut(head: Column, whole: Column) -> Column:
        return F.concat(F.regexp_replace(head, f"(?is){opening}.*?{closing}", "\n"), F.substr(whole, F.char_length(head) + 1))

    return _let(text, lambda t: _let(F.regexp_extract(t, f"(?is)^.*{closing}", 0), lambda h: cut(h, t)))


def _cut(text: str, opening: str, closing: str) -> str:
    """_closed() of one page."""
    head = max((m.end() for m in re.finditer(f"(?i){closing}", text)), default=0)
    return re.sub(f"(?is){opening}.*?{closing}", "\n", text[:head]) + text[head:]


def _page_text(html: str) -> str:
    for opening, closing in _ELEMENTS:
        html = _cut(html, opening, closing)
    return "\n".join(filter(None, (line.strip(" ") for line in html_entities.unescape(html).split("\n"))))


@F.pandas_udf(T.StringType())
def _all_entities(html: pd.Series) -> pd.Series:
    return html.map(_page_text, na_action="ignore")


def html_text(html: Column, all_entities: bool = False) -> Column:
    """A page's text: silent elements dropped, tags to line ends, entities back (those of XML, or all), lines trimmed, blank ones gone. Its time grows with the page, whatever is left open."""
    if all_entities:  # 2,231 of them: the standard library's table, in Arrow batches
        return _all_entities(html)
    out = html
    for opening, closing in _ELEMENTS:
        out = _closed(out, opening, closing)
    for name, c in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(c))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
