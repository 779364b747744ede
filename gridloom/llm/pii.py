"""Operator 9, personal data with information-theoretic sanitisation.

Base kinds (email, ip, card, phone) are the patterns below, leftmost and non-overlapping, and stay
as they are. Beyond them, terms that give a protected entity away are found: over all documents,
n(term, entity) documents hold both, at any distance, n(term) the term and n(entity) the entity.
The term discloses the entity by the information log2(n(term, entity) * n / (n(term) * n(entity)))
once they met in at least `support` documents, and n(term, entity) / n(term) is the share of the
entity's surprise that it reveals. Every occurrence of a term from both thresholds on becomes a
span of kind term in the documents that hold the entity, unless it overlaps a base span;
sanitised() removes those that reveal at least `remove` and generalises the others, and masks base
spans. Documents without the entity keep the term: there it stands beside nobody.

Counts cover all documents. A pair can reach the thresholds only if entity and term are each in at
least `support` documents and in at most n / 2**bits, so pairs are made of these alone; sketches of
fixed size tell them, and what a sketch lets through beyond that is dropped by exact counts. Entities that stand in the very same documents
are one class (told by their count and sums of hashes of these documents), and so are terms: what they disclose is the same, so
a document's pairs are those of its classes, however many addresses and names it lists. Entities
and terms travel as hashes; counts are summed per task first. Thresholds don't depend on the input's
size. Null or empty text: no spans. Very long texts are scanned whole, in time that grows with their length. Repeated rows count as documents of their own, and each
has its spans. Null doc_id: as any other. An empty table gives an empty result. Columns besides doc_id and text are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import pieces_of, read, stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT, BITS, SHARE, REMOVE, FLUSH = 2, 6.0, 0.5, 0.9, 300_000
#: Bits of a sketch of hashes, and of one of its chunks.
SKETCH, CHUNK = 1 << 26, 1 << 18
#: Disclosing terms of all documents are broadcast up to so many bytes.
MOST_BYTES = 32 << 20
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: As the pattern without the look-behind: a match takes runs of digits whole, so none starts inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT, _TERM = re.compile("[0-9]"), re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str):
    """As finditer, but it starts only where an @ is: no run of letters is walked again and again."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.lower()) - (1 << 63)


def _terms(text: str, spans: list) -> list[tuple[str, int, int]]:
    """(lower-case term, start, end) of all terms that overlap none of the base spans."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at, out = 0, []
    for m in _TERM.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at == len(taken) or taken[at][0] >= e:
            out.append((m.group().lower(), s, e))
    return out


def _entities(text: str, spans: list) -> set[int]:
    return {_hash(k + ":" + text[s:e]) for k, s, e in spans}


def _sketch(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of column h: 8 MB at any size of the input."""

    def packed(t: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(CHUNK, np.uint8)
        bits[t["low"].to_numpy() % CHUNK] = 1
        return pd.DataFrame({"chunk": t["chunk"][:1], "bits": [np.packbits(bits).tobytes()]})

    low = hashes.select(F.col("h").bitwiseAND(F.lit(SKETCH - 1)).alias("low")).distinct()
    out = np.zeros(SKETCH // 8, np.uint8)
    for r in low.select(F.expr(f"low div {CHUNK}").alias("chunk"), "low").groupBy("chunk").applyInPandas(packed, "chunk long, bits binary").collect():
        out[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _held(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & (SKETCH - 1)
    return (sketch[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 > 0


def _longs(values) -> np.ndarray:
    return np.fromiter(values, np.int64)


def _placed(documents: DataFrame) -> DataFrame:
    """(text, place): place tells documents apart; rows alike in doc_id and text share it."""
    return documents.select("text", F.xxhash64("doc_id", "text").alias("place"))


def _mark(place: int) -> int:
    """Two numbers of 30 bits, so far apart that sums of many stay apart."""
    return (place & 0x3FFFFFFF) | (place >> 30 & 0x3FFFFFFF) << 90


def counts(documents: DataFrame) -> DataFrame:
    """(entity, term, n, s1, s2) of documents: entity only (term null), term only (entity null), and neither: all documents.

    s1 and s2 are sums of the documents' marks, for terms only of documents in which they stand beside an entity: null beyond 64 bits."""

    def run(batches):
        seen: Counter = Counter()
        marks: Counter = Counter()
        total = 0
        for batch in batches:
            texts, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            total += len(texts)
            for a, b in pieces_of([x or "" for x in texts]):
                words: Counter = Counter()
                for text, place in zip(texts[a:b], places[a:b], strict=True):
                    if not text:
                        continue
                    words.update({w.lower() for w in set(_TERM.findall(text))})
                    if spans := base_spans(text):
                        m = _mark(place)
                        for x in _entities(text, spans):
                            seen[x, None] += 1
                            marks[x, None] += m
                        for w in {t[0] for t in _terms(text, spans)}:
                            marks[None, _hash(w)] += m
                for w, n in words.items():
                    seen[None, _hash(w)] += n
                if len(seen) > FLUSH:
                    yield _table(seen, marks)
                    seen.clear()
                    marks.clear()
        seen[None, None] += total
        yield _table(seen, marks)

    rows = _placed(documents).mapInArrow(run, "entity long, term long, n long, s1 long, s2 long")
    return rows.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.try_sum("s1").alias("s1"), F.try_sum("s2").alias("s2"))


def _table(seen: Counter, marks: Counter) -> pa.RecordBatch:
    keys = list(seen)
    low = (1 << 90) - 1
    columns = [[k[0] for k in keys], [k[1] for k in keys], list(seen.values()), [marks[k] & low for k in keys], [marks[k] >> 90 for k in keys]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["entity", "term", "n", "s1", "s2"])


def places(documents: DataFrame, entities: np.ndarray, terms: np.ndarray) -> DataFrame:
    """(place, entity, term, rows): where those of the sketches stand, entities (term null) and terms beside one (entity null), and how many rows the place has."""
    shared = documents.sparkSession.sparkContext.broadcast((entities, terms))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["place", "entity", "term"])

    def run(batches):
        some, few = shared.value
        rows: list[tuple] = []
        for batch in batches:
            for text, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or not (spans := base_spans(text)):
                    continue
                es = _longs(_entities(text, spans))
                es = es[_held(some, es)].tolist()
                if not es:
                    continue
                ts = _longs({_hash(w) for w in {t[0] for t in _terms(text, spans)}})
                rows += [(place, e, None) for e in es]
                rows += [(place, None, t) for t in ts[_held(few, ts)].tolist()]
                if len(rows) > FLUSH:
                    yield table(rows)
                    rows = []
        yield table(rows)

    return _placed(documents).mapInArrow(run, "place long, entity long, term long").groupBy("place", "entity", "term").agg(F.count("*").alias("rows"))


def disclosures(documents: DataFrame, support: int = SUPPORT, bits: float = BITS, share: float = SHARE) -> DataFrame:
    """(place, term, share): the terms that from the thresholds on disclose an entity of the place, and the most that they reveal of one."""
    c = stored(counts(documents), "term-counts")
    total = c.where("entity is null and term is null").agg(F.sum("n")).first()[0] or 0
    # n(term, entity) is at most n(term) and n(entity), so beyond these bounds neither can reach the thresholds.
    able = (F.col("n") >= support) & (F.col("n") <= total / 2.0**bits * (1 + 1e-9))
    of_class = F.xxhash64("n", "s1", "s2", F.coalesce("s1", "s2", "entity", "term"))
    t = c.where("entity is null and term is not null and not (s1 <=> 0L and s2 <=> 0L)").where(able).select("term", of_class.alias("tc"), F.col("n").alias("nt"))
    e = c.where("entity is not null and term is null").where(able).select("entity", of_class.alias("ec"), F.col("n").alias("ne"))
    found = stored(places(documents, _sketch(e.select(F.col("entity").alias("h"))), _sketch(t.select(F.col("term").alias("h")))), "places")
    of_terms = stored(found.where("term is not null").select("place", "term", "rows").join(t, "term"), "places-of-terms")
    there = lambda d, *names: d.groupBy("place", *names).agg(F.first("rows").alias("rows"))
    entities = there(found.where("entity is not null").select("place", "entity", "rows").join(e, "entity"), "ec", "ne")
    both = stored(entities.join(there(of_terms, "tc", "nt").drop("rows"), "place"), "class-pairs")
    j = both.groupBy("ec", "tc", "ne", "nt").agg(F.sum("rows").alias("n")).where(f"n >= {support}")
    j = j.select("ec", "tc", F.log2(F.col("n") * float(total) / (F.col("nt") * F.col("ne"))).alias("bits"), (F.col("n") / F.col("nt")).alias("share"))
    tell = stored(j.where((F.col("bits") >= bits) & (F.col("share") >= share)), "disclosures")
    told = both.join(tell, ["ec", "tc"]).groupBy("place", "tc").agg(F.max("share").alias("share"))
    return of_terms.join(told, ["place", "tc"]).select("place", "term", "share")


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _marked(text: pd.Series, base: pd.Series, hits: pd.Series) -> pd.Series:
    """Every occurrence of the terms in hits (term, share)."""
    out = []
    for x, bs, hs in zip(text, base, hits, strict=True):
        if x is None or hs is None:
            out.append([])
            continue
        share, known = {int(h["term"]): float(h["share"]) for h in hs}, {}
        spans, found = [(b["kind"], b["start"], b["end"]) for b in bs], []
        for w, s, e in _terms(x, spans):
            h = known.get(w)
            if h is None:
                h = known[w] = _hash(w)
            if h in share:
                found.append({"start": s, "end": e, "share": share[h]})
        out.append(found)
    return pd.Series(out, dtype=object)


def spans(documents: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, text, base array<struct<kind,start,end>>, terms array<struct<start,end,share>>)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of([x or "" for x in texts]):
                base = [base_spans(x) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(1)[a:b],
                    pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                ], ["doc_id", "text", "base"])

    n = disclosures(documents, **thresholds).groupBy("place").agg(F.collect_list(F.struct("term", "share")).alias("hits"))
    n = stored(n, "term-hits")
    taken = n.agg(F.sum(F.size("hits") * 16 + 64)).first()[0] or 0
    side = (F.broadcast(n) if taken <= MOST_BYTES else n).select(F.col("place").alias("_place"), "hits")
    found = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, base {_SPANS}")
    j = found.join(side, F.xxhash64("doc_id", "text") == F.col("_place"), "left")
    hit, marked = F.col("hits").isNotNull(), F.pandas_udf(_marked, "array<struct<start:bigint,end:bigint,share:double>>")
    return j.select("doc_id", "text", "base", marked(F.when(hit, F.col("text")), F.when(hit, F.col("base")), F.col("hits")).alias("terms"))


def sanitised(found: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(doc_id, text) with base spans masked by kind, and disclosing terms removed or generalised to their kind of thing."""

    @F.pandas_udf("string")
    def clean(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for x, bs, ts in zip(text, base, terms, strict=True):
            if x is not None:
                cuts = [(b["start"], b["end"], f"<{b['kind']}>") for b in bs] + [(t["start"], t["end"], "" if t["share"] >= remove else "<name>" if x[t["start"]].isupper() else "<term>") for t in ts]
                at, parts = 0, []
                for a, b, say in sorted(cuts):
                    if a >= at:
                        parts += [x[at:a], say]
                        at = b
                x = "".join([*parts, x[at:]])
            out.append(x)
        return pd.Series(out, dtype=object)

    return found.select("doc_id", clean("text", "base", "terms").alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(read(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("bigint").alias(f"n_{k}")
    say = lambda xs, kind: F.transform(xs, lambda b: F.concat_ws(":", F.lit(kind) if kind else b["kind"], b["start"].cast("string"), b["end"].cast("string")))
    base = say("base", None)
    return found.select(
        "doc_id", *map(of, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, say("terms", "term")), ",").alias("spans"), F.size("terms").cast("bigint").alias("n_term"), F.size("base").cast("bigint").alias("n_base"),
    )
