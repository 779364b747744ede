"""Operator 1, n-gram Jaccard join with multiple-global-order filtering.

A document is the set of its distinct 5-word shingles (64-bit hashes); two link at Jaccard >= 0.75.
Documents of one set are one class, and one document stands for it from the prefixes on, so copies cost nothing further. Every order of all shingles has
the prefix property: classes that link share one of the first n // 4 + 1 shingles of each. Here an
order goes by how crowded a shingle's hash bucket is (counted over all documents in a sketch of
fixed size), then by a hash, another in each order.

The first order makes candidates, in rounds so that no group is ever spelled out as all its
pairs. A star round takes two classes of each group, its most central and one by a hash, and holds every class against the
nearest few of all these that it meets; what is verified is merged into components. Further star rounds follow, with others by the hash, as long
as the pairs still open are many times the rows and a round halves them. The last round looks only at groups that still hold several
components, and there at pairs of different components of which one isn't the group's largest: it is exact, as all other pairs are already joined. Pairs
pass the bounds on lengths, positions and differences before they become rows, then on prefix shingles shared, then the same count must hold
under every other order, and only then are whole sets compared. The bound on differences is by a sketch of fixed size, the parity of
how many shingles fall in each of 512 buckets: it differs in no more places than the sets do in shingles.

Null, empty or blank text: an empty set, which links with nothing. Fewer words than n: their
whole sequence is the one shingle. Repeated rows: each is returned. Null doc_id: takes part, but never names a component it shares
with a document that has one; a component of null ids alone has the null id, and one_of_each() keeps its rows. Very long texts are taken
whole. An empty table gives an empty result. Columns besides doc_id and text are ignored, whatever their names; one_of_each() keeps them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import pieces_of, read, small, stored

N, BUCKETS, CHUNK, ORDERS, MOST_CHARS = 5, 1 << 20, 4096, 3, 1_000_000
#: 64-bit words of a sketch; classes that a star round holds each class against; open pairs a row beyond which star rounds go on (to hold a pair against
#: the bounds takes about a thousandth of what a row costs in a round), and how often at most.
WORDS, NEAREST, OPEN, STARS = 8, 4, 1024, 6
SKETCH = [f"q{k}" for k in range(WORDS)]
#: Bytes of a side that is broadcast, by rows times width. Spark's hash table takes three times as much, and the driver holds it more than once while it is built.
SENT = 8 << 20
#: A bucket's level is how many of these it exceeds: the median count, and so many times its square root and so many more.
LEVELS = ((1, 1), (2, 2), (3, 4), (4, 8), (6, 16), (12, 64), (24, 256))
_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses."""
    if not _powers or len(_powers[0]) < n:
        base = 0xD6E8FEB86659FD93
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each lower-cased word of all texts, number of words of each text)."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    b = _LOW[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    gap = _SPACE[b]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    first = np.cumsum([1] + [len(x) + 1 for x in raw])
    return h, np.diff(np.searchsorted(starts, first))


def shingle_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    with np.errstate(over="ignore"):
        w, per = word_hashes(texts)
        last = np.cumsum(per)
        g = w.copy()
        for k in range(1, n):
            g[: len(w) - k] = mixed(g[: len(w) - k] * _ODD + w[k:]) if len(w) > k else g[: len(w) - k]
        out = []
        for end, m in zip(last, per, strict=True):
            if m >= n:
                out.append(np.unique(g[end - m : end - n + 1]))
            elif m:
                h = np.uint64(m)
                for x in w[end - m : end]:
                    h = mixed(np.array([h * _ODD + x]))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _named(s: np.ndarray) -> int:
    """A set's class."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(s * _ODD + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def prefix(s: np.ndarray, order: int, crowded: np.ndarray) -> np.ndarray:
    """The first shingles of s in this order."""
    with np.errstate(over="ignore"):
        rank = mixed(s + np.uint64(order) * _ODD) >> np.uint64(3)
    rank |= crowded[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(61)
    k = len(s) // 4 + 1
    if k < len(s):
        at = np.argpartition(rank, k)[:k]
        return s[at[np.argsort(rank[at])]]
    return s[np.argsort(rank)]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of how many of s fall in each bucket, as WORDS longs."""
    return np.packbits(np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1).view(np.int64)


def features(documents: DataFrame, n: int = N) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, tag, n, c) with tag a hash of the text, how crowded each hash bucket is, from 0 to 7); the second has a fixed size at any size of the input."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        counts = np.zeros(BUCKETS, np.int32)
        none = lambda k, t: pa.nulls(k, t)
        id_type = None
        for batch in batches:
            texts, id_type = batch.column(2).to_pylist(), batch.column(0).type
            for a, b in pieces_of([x or "" for x in texts], MOST_CHARS):
                sets = shingle_sets([x or "" for x in texts[a:b]], n)
                counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([_named(s) for s in sets], pa.int64()), none(b - a, pa.int32()), none(b - a, pa.int32()), none(b - a, pa.binary())], ["doc_id", "tag", "n", "c", "chunk", "salt", "counts"])
        if id_type is not None and counts.any():
            k = BUCKETS // CHUNK
            salt = TaskContext.get().partitionId() // 1024
            yield pa.RecordBatch.from_arrays([none(k, id_type), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([salt] * k, pa.int32()), pa.array([counts[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in range(k)], pa.binary())], ["doc_id", "tag", "n", "c", "chunk", "salt", "counts"])

    rows = stored(_tagged(documents).mapInArrow(run, f"doc_id {kind}, tag long, n long, c long, chunk int, salt int, counts binary"), "shingle-features")

    def summed(t: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for x in t["counts"]:
            total += np.frombuffer(x, np.int64 if len(x) == 8 * CHUNK else np.int32)
        return pd.DataFrame({"chunk": t["chunk"][:1], "counts": [total.tobytes()]})

    parts = rows.where("chunk is not null").select("chunk", "salt", "counts")
    parts = parts.groupBy("chunk", "salt").applyInPandas(summed, "chunk int, counts binary")  # at most 1024 tasks' counts
    parts = parts.groupBy("chunk").applyInPandas(summed, "chunk int, counts binary")  # a row for each 1024 tasks
    total = np.zeros(BUCKETS, np.int64)
    for r in parts.collect():  # 8 MB at any size of the input
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(r["counts"], np.int64)
    mean = float(np.median(total))
    excess = total - mean
    levels = sum((excess > times * mean**0.5 + more).astype(np.uint8) for times, more in LEVELS)
    return rows.where("chunk is null").select("doc_id", "tag", "n", "c"), levels


def _tagged(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("tag"), "text")


def components(edges: DataFrame) -> DataFrame:
    """(c, comp) of all ends of edges (a, b): comp is the smallest c of those connected. Alternates large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small(stored(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least"), SENT)
        out = near.join(least, "a").where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out if large else out.union(least.select("a", F.col("m").alias("b")))
        return stored(out.where("a <> b").distinct(), "star")

    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was, now = None, sign(edges)
    while now[0] and was != now:
        edges = star(star(edges, True), False)
        was, now = now, sign(edges)
    least = edges.select("b").distinct()
    return stored(edges.select(F.col("a").alias("c"), F.col("b").alias("comp")).union(least.select(F.col("b"), F.col("b"))), "components")


_NEAR = "7 * least({x}n - {x}i, {y}n - {y}i) >= 3 * ({x}n + {y}n)"
_LENGTHS = "4 * least({x}n, {y}n) >= 3 * greatest({x}n, {y}n)"
#: Sets that link differ in a seventh of their sizes' sum at most, and their sketches in no more.
_DIFFER = " + ".join(f"bit_count({{x}}{q} ^ {{y}}{q})" for q in SKETCH)


def _can_link(met: str, slack: int | str = 0) -> str:
    """Whether sets that meet `met` times in their prefixes of one order can link: all else they share lies behind a prefix."""
    return f"7 * ({met} + {slack} + greatest(na, nb) - (greatest(na, nb) div 4 + 1)) >= 3 * (na + nb)"


def _close(x: str, y: str) -> str:
    """Whether the bounds on lengths and differences let the sets with these prefixes of column names link."""
    return f"{_LENGTHS} and {_DIFFER} <= ({{x}}n + {{y}}n) div 7".format(x=x, y=y)


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows (t, c, n, i) of which others have the same t, with their number k and whether t may be the first shingle that c shares with a set it links with.

    The first shingle shared has all others behind it on both sides, so a class n long that has it at i links with no set longer than (4n - 7i) / 3.
    Where two rows share t, each is held against the other; where more do, against the least n and the most reach among them.
    Rows are dealt once: the counts use every column, so that they and the join read the same shuffle."""
    reach = F.col("n") * 4 - F.col("i") * 7
    rows = rows.repartition("t")  # a shuffle at every size, as rows grow with the corpus
    about = rows.groupBy("t").agg(F.count("c").alias("k"), F.sum("n").alias("ns"), F.sum(reach).alias("reaches"), F.min("n").alias("least"), F.max(reach).alias("most")).where("k > 1")
    other_n, other_reach = (F.when(F.col("k") == 2, F.col(both) - own).otherwise(F.col(bound)) for both, own, bound in (("ns", F.col("n"), "least"), ("reaches", reach, "most")))
    first = (3 * other_n <= reach) & (3 * F.col("n") <= other_reach)
    return rows.join(about, "t").select("t", "c", "n", "i", "k", first.alias("first"))


def _star(rows: DataFrame, sketches: DataFrame, company: DataFrame, turn: int) -> DataFrame:
    """(a, b, na, nb): each class b of rows (t, c, n) and the few nearest of the centres of its groups: their most central class by (c, company), in the first turn, and one by a hash.

    Sketches (c, q0, ...) join the distinct pairs, not the rows of every shingle, and are shuffled: they grow with the corpus."""
    about = F.struct("c", "n")
    chance = F.max_by(about, F.xxhash64("c", "t", F.lit(turn))).alias("one")
    led = rows.join(small(company, SENT), "c") if turn == 0 else rows
    centres = led.groupBy("t").agg(chance, F.max_by(about, F.struct("company", "c")).alias("two") if turn == 0 else F.min_by(about, F.xxhash64("c", "t", F.lit(turn))).alias("two"))
    centres = stored(centres.select("t", F.explode(F.array("one", "two")).alias("o")).select("t", F.col("o.c").alias("o_c"), F.col("o.n").alias("o_n")), "centres")
    met = rows.select("t", F.col("c").alias("m_c"), F.col("n").alias("m_n")).join(centres, "t").where("m_c <> o_c").where(_LENGTHS.format(x="m_", y="o_"))
    met = met.select("m_c", "m_n", "o_c", "o_n").distinct()
    for x in ("o_", "m_"):
        met = met.join(sketches.withColumnsRenamed({k: f"{x}{k}" for k in ("c", *SKETCH)}), f"{x}c")
    met = met.where(_close("m_", "o_"))
    met = met.select(F.col("m_c").alias("b"), F.col("m_n").alias("nb"), F.struct(F.expr(_DIFFER.format(x="m_", y="o_")).alias("d"), F.col("o_c").alias("a"), F.col("o_n").alias("na")).alias("x"))
    # A class meets no more centres than two for each shingle of its prefix.
    near = met.groupBy("b", "nb").agg(F.slice(F.array_sort(F.collect_set("x")), 1, NEAREST).alias("xs"))
    near = near.select(F.explode("xs").alias("x"), "b", "nb").select("x.a", "b", "x.na", "nb")
    return near.selectExpr("least(a, b) as a", "greatest(a, b) as b", "if(a < b, na, nb) as na", "if(a < b, nb, na) as nb").distinct()


def _met_enough(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose prefixes of the first order share enough; shingles of a that fall together in 48 bits count in full."""
    named = stored(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), "near-classes")
    pre = groups.join(small(named, SENT), "c", "left_semi").groupBy("c").agg(F.collect_list("t").alias("pre"))  # a set's prefix each
    pre = stored(pre, "near-prefixes")
    a, b = pre.select(F.col("c").alias("a"), F.col("pre").alias("a_pre")), pre.select(F.col("c").alias("b"), F.col("pre").alias("b_pre"))
    met = F.expr(_can_link("size(array_intersect(a_pre, b_pre))", slack="(size(a_pre) - size(array_distinct(a_pre)))"))
    return pairs.join(a, "a").join(b, "b").where(met).select("a", "b", "na", "nb")


def _one_row(rows: DataFrame, repeats: bool) -> DataFrame:
    """A row a class. Only repeated rows of a document still give several; tasks reduce them before the shuffle."""
    return rows.groupBy("c").agg(*(F.first(x).alias(x) for x in rows.columns if x != "c")) if repeats else rows


def jaccard_components(documents: DataFrame, n: int = N, orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    return _labelled(documents, n, orders).drop("tag")


def _labelled(documents: DataFrame, n: int = N, orders: int = ORDERS) -> DataFrame:
    """jaccard_components() with column tag, a hash of the text."""
    spark = documents.sparkSession
    docs, kind = _tagged(documents), documents.schema["doc_id"].dataType.simpleString()
    feats, crowded = features(docs, n)
    shared = spark.sparkContext.broadcast(crowded)
    # The document that stands for each class, and whether rows of it repeat.
    same = feats.where("n > 0").groupBy("c", "doc_id", "tag").agg(F.count("*").alias("m"))
    reps = stored(same.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "m")).alias("r"), F.count("*").alias("k")).select("c", "r.doc_id", "r.tag", "r.m", "k"), "class-documents")
    repeats = not reps.where("m > 1").isEmpty()

    def prefixes(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in pieces_of([x or "" for x in texts], MOST_CHARS):
                sets = shingle_sets([x or "" for x in texts[a:b]], n)
                some = [k for k, s in enumerate(sets) if len(s)]
                sets = [sets[k] for k in some]
                at = pa.array([a + k for k in some], pa.int64())
                pre = [prefix(s, 1, shared.value) for s in sets]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in pre]))).astype(np.int32)
                flat = (np.concatenate(pre) >> np.uint64(16)).astype(np.int64) if pre else np.zeros(0, np.int64)
                parity = np.array([sketch(s) for s in sets], np.int64).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([_named(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *(pa.array(parity[:, k]) for k in range(WORDS))], ["doc_id", "tag", "c", "n", "pre", *SKETCH])

    # 48 bits of a shingle will do here: chance meetings are only candidates.
    pre = docs.mapInArrow(prefixes, f"doc_id {kind}, tag long, c long, n int, pre array<bigint>, " + ", ".join(f"{q} long" for q in SKETCH))
    copied = stored(reps.where("k > 1").select("c", F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")), "copied-classes")
    pre = pre.join(small(copied, SENT), "c", "left").where("_tag is null or (doc_id <=> _id and tag = _tag)").select("c", "n", "pre", *SKETCH)
    # From here on a class goes by a number, which rises along the stored rows: in shuffles it takes a third of the bytes of the hash, h.
    pre = stored(_one_row(pre, repeats).withColumnRenamed("c", "h").withColumn("c", F.monotonically_increasing_id()), "class-prefixes")
    hashes = pre.select("c", "h")
    groups = stored(_grouped(pre.select("c", "n", F.posexplode("pre").alias("i", "t"))), "prefix-groups")
    first_met = groups.where("first").drop("first")
    # Copies of a text are nearer to it than to each other, so a class whose shingles have most company is one to hold others against.
    company = first_met.groupBy("c").agg((F.sum("k") / (F.max("n") / 4.0 + 1)).alias("company"))
    company, sketches = stored(company, "company"), pre.select("c", *SKETCH)
    first_met, groups = first_met.drop("k"), groups.select("t", "c")
    known, comp, sets, before = first_met, None, None, float("inf")
    for turn in range(STARS):
        first = stored(_star(known, sketches, company, turn), "star-pairs")
        sets = _sets(docs, reps, hashes, repeats, first, n, orders, crowded, sets)
        links = _verified(first, sets, orders)
        if turn and links.isEmpty():
            break
        comp = components(links if comp is None else _edges(comp).union(links))
        # Groups with several components: size, and the largest component.
        here = known.drop("comp", "major").join(small(comp, SENT), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        parts = here.groupBy("t", "comp").agg(F.count("*").alias("k")).groupBy("t")
        parts = parts.agg(F.sum("k").alias("k"), F.max(F.struct("k", "comp")).alias("m")).where("m.k < k")
        parts = stored(parts.select("t", F.col("m.comp").alias("major"), "k", (F.col("k") - F.col("m.k")).alias("others")), "open-groups")
        known = stored(here.join(small(parts.select("t", "major"), SENT), "t"), "open-rows")
        rows, pairs = parts.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.col("k") * F.col("others")), F.lit(0))).first()
        if pairs <= OPEN * rows or 2 * pairs > before:
            break
        before = pairs

    # The last round. The first shingle that linked sets share meets the bound on positions, so no other meeting need become a row.
    wide = stored(known.join(sketches, "c"), "open-sketches")
    x, y = (wide.select("t", *(F.col(k).alias(f"{side}{k}") for k in ("c", "n", "i", "comp", "major", *SKETCH))) for side in "xy")
    across = x.where("xcomp <> xmajor").join(y, "t").where("xcomp < ycomp or ycomp = ymajor").where(_close("x", "y")).where(_NEAR.format(x="x", y="y"))
    pair = across.selectExpr("least(xc, yc) as a", "greatest(xc, yc) as b", "if(xc < yc, xn, yn) as na", "if(xc < yc, yn, xn) as nb").distinct()
    second = stored(_met_enough(stored(pair, "near-pairs"), groups), "cross-pairs")
    if not second.isEmpty():
        sets = _sets(docs, reps, hashes, repeats, second, n, orders, crowded, sets)
        more = _verified(second, sets, orders)
        if not more.isEmpty():
            comp = components(_edges(comp).union(more))

    whole = F.col("n") > 0
    comp = hashes.join(small(comp, SENT), "c").select(F.col("h").alias("of"), F.col("comp").alias("c"))
    comp = stored(comp.join(hashes, "c").select(F.col("of").alias("c"), F.col("h").alias("comp")), "components-by-hash")
    f = feats.join(small(comp, SENT), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = stored(f.where(whole).groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k"), "least-ids")
    f = f.join(small(least, SENT), "comp", "left")
    return f.select("doc_id", "tag", F.col("n").alias("n_shingles"), F.when(whole, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _edges(comp: DataFrame) -> DataFrame:
    return comp.select(F.col("c").alias("a"), F.col("comp").alias("b")).where("a <> b")


def _sets(docs, reps, hashes, repeats, pairs, n, orders, crowded, had) -> DataFrame:
    """(c, s, p2, p3, ...) of the classes in pairs that `had` lacks, and had: the whole sets and their prefixes under the other orders."""
    spark = docs.sparkSession
    need = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    if had is not None:
        need = need.join(had.select("c"), "c", "left_anti")
    need = stored(hashes.join(small(stored(need, "needed"), SENT), "c"), "needed-hashes")
    need = reps.withColumnRenamed("c", "h").join(small(need, SENT), "h").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "c")
    need = stored(need, "needed-ids")
    texts = docs.join(small(need, SENT), docs["doc_id"].eqNullSafe(need["_id"]) & (docs["tag"] == need["_tag"])).select("c", "text")
    shared = spark.sparkContext.broadcast(crowded)
    names = [f"p{k}" for k in range(2, orders + 1)]

    def run(batches):
        for batch in batches:
            own = batch.column(1).to_pylist()
            for a, b in pieces_of([x or "" for x in own], MOST_CHARS):
                sets = shingle_sets([x or "" for x in own[a:b]], n)
                columns = [batch.column(0)[a:b], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                columns += [pa.array([(prefix(s, k, shared.value) >> np.uint64(48)).astype(np.uint16).view(np.int16) for s in sets], pa.list_(pa.int16())) for k in range(2, orders + 1)]
                yield pa.RecordBatch.from_arrays(columns, ["c", "s", *names])

    new = stored(_one_row(texts.mapInArrow(run, "c long, s array<bigint>, " + ", ".join(f"{p} array<smallint>" for p in names)), repeats), "sets")
    return new if had is None else new.unionByName(had)


def _verified(pairs: DataFrame, sets: DataFrame, orders: int) -> DataFrame:
    """The pairs (a, b) that link: first those that meet in the prefixes of every other order, then by their whole sets."""
    names = [f"p{k}" for k in range(2, orders + 1)]

    def side(of: DataFrame, c: str, cols: list[str]) -> DataFrame:
        """The sets that of's column c names, and no others: those are few."""
        own = sets.join(small(stored(of.select(F.col(c).alias("c")).distinct(), "side"), SENT), "c", "left_semi")
        return own.select(F.col("c").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in cols))

    meet = F.lit(True)
    for p in names:  # prefixes hold 16 bits of a shingle: those of a that fall together count in full, so no pair is lost
        meet = meet & F.expr(_can_link(f"size(array_intersect(a_{p}, b_{p}))", slack=f"(size(a_{p}) - size(array_distinct(a_{p})))"))
    left = stored(pairs.join(side(pairs, "a", names), "a").join(side(pairs, "b", names), "b").where(meet).select("a", "b"), "filtered-pairs")
    both = F.size(F.array_intersect("a_s", "b_s"))
    linked = left.join(side(left, "a", ["s"]), "a").join(side(left, "b", ["s"]), "b").where(7 * both >= 3 * (F.size("a_s") + F.size("b_s")))
    return stored(linked.select("a", "b"), "links")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """documents, of each component only those with the smallest doc_id; rows of one doc_id are told apart by their texts."""
    go = _labelled(documents, **options).where("not (component_id <=> doc_id)").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    go = stored(go, "go")
    return documents.join(small(go, SENT), documents["doc_id"].eqNullSafe(go["_id"]) & (F.xxhash64(documents["text"]) == go["_tag"]), "left_anti")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.x, r.m FROM r JOIN e ON e.y = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
