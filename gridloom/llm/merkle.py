"""Operator 12, Merkle manifest of a dataset, with checkpoint-and-recompute.

A row's leaf is the SHA-256 of its fields, each as length and value. Within a group (a language) leaves ascend by key, and
every `fan` consecutive nodes become one, level by level, until one remains; these subroots, ordered by group, give the root likewise. Digests
travel as lowercase hex and are hashed as such.

Only every few levels are stored (`every`, so a stored node stands for fan ** every below it), and each stored level as rows of aligned
subtrees. A proof's siblings at the levels between are regenerated from the stored nodes of its subtree when proofs are asked for,
given out and forgotten; a lost executor costs the subtrees it was at work on. No subtree has more than fan ** every nodes, so a group of
any number of rows is many small tasks. Leaves are numbered by a range sort: numbers within a partition, plus the rows of the partitions before.

Null fields are "-". A null group is a group of its own and the first; null keys come first. Rows of one key come in the order of their
leaves, and rows alike in everything are nodes each. A lone leaf is its group's subroot. Empty and very long texts: as any other. Empty
table: no nodes, no root, an empty result. Columns that aren't fields are no part of a leaf, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, read, small, stored

FAN, EVERY = 8, 3
_PATH = "array<struct<l:string,r:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Tree(NamedTuple):
    """Stored levels (level, its subtrees) from the leaves up, and (grp, subroot)."""

    levels: list[tuple[int, DataFrame]]
    roots: DataFrame


def digest(*fields: str | Column) -> Column:
    """A leaf: the hash of these fields."""

    def framed(c) -> Column:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(framed(c) for c in fields)), 256)


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """nodes with pos, the number of rows of its grp before it, and n, the rows of its grp. Rows that tie may come in either order."""
    placed = nodes.withColumn("_salt", F.monotonically_increasing_id())  # so that rows alike in everything need not meet in one task
    by = [F.col("grp"), *order, F.col("_salt")]
    placed = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ordered-leaves")
    parts = placed.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stored(parts.select("grp", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("n")), "leaf-offsets")
    return placed.join(small(parts), ["grp", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _height(fan: int) -> Column:
    """Levels above the leaves of a tree of n."""
    powers = [fan**k for k in range(63) if fan**k < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("bigint") for p in powers)), lambda p: p < F.col("n")))


def _parents(nodes: Column, fan: int) -> Column:
    run = lambda k: F.array_join(F.slice(nodes, k * fan + 1, F.lit(fan)), "")
    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / fan).cast("int")), lambda k: F.sha2(run(k), 256))


def _subtrees(nodes: DataFrame, level: int, fan: int, every: int) -> DataFrame:
    """(grp, block, n, up, nodes): nodes of one aligned subtree in order, and how many levels of it there are above them."""
    rest = [c for c in nodes.columns if c not in ("grp", "n")]
    blocks = nodes.groupBy("grp", F.floor(F.col("pos") / fan**every).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *(c for c in rest if c != "pos")))).alias("nodes"))
    return blocks.withColumn("up", F.least(F.lit(every), _height(fan) - level))


def _levels(blocks: DataFrame, fan: int, every: int) -> DataFrame:
    """blocks with l0, l1, ...: the nodes of each level of the subtree below its top, regenerated."""
    out = blocks.withColumn("l0", F.transform("nodes", lambda x: x["node"]))
    for k in range(1, every):
        out = out.withColumn(f"l{k}", F.when(F.col("up") > k, _parents(F.col(f"l{k - 1}"), fan)))
    return out


def build(nodes: DataFrame, order: list[Column], name: str, fan: int = FAN, every: int = EVERY) -> Tree:
    """The tree of each grp of nodes (grp, node and other columns), in this order within it."""
    blocks = stored(_subtrees(numbered(nodes, order), 0, fan, every), f"{name}-level-0")
    levels, roots, level = [(0, blocks)], None, 0
    top = blocks.agg(F.max(_height(fan))).first()[0] or 0
    while True:
        up = blocks.withColumn("nodes", F.transform("nodes", lambda x: x["node"]))
        for k in range(every):
            up = up.withColumn("nodes", F.when(F.col("up") > k, _parents(F.col("nodes"), fan)).otherwise(F.col("nodes")))
        up = up.select("grp", "n", F.col("block").alias("pos"), F.element_at("nodes", 1).alias("node"))
        done = up.where(_height(fan) <= level + every)
        if level:
            done = done.where(_height(fan) > level)
        roots = done.select("grp", "node") if roots is None else roots.union(done.select("grp", "node"))
        level += every
        if level >= top:
            return Tree(levels, stored(roots, f"{name}-roots"))
        blocks = stored(_subtrees(up.where(_height(fan) > level), level, fan, every), f"{name}-level-{level}")
        levels.append((level, blocks))


def paths(tree: Tree, above: DataFrame | None = None, fan: int = FAN, every: int = EVERY) -> DataFrame:
    """(grp, pos, the leaves' columns, path): path has the siblings (l, r) left and right of each node on the way up, as text.

    above, (grp, path), goes on from each grp's root."""
    upper, none = None, F.array().cast(_PATH)
    for level, blocks in reversed(tree.levels):
        rows = _levels(blocks, fan, every).withColumn("trunk", F.lit(None).cast(_PATH))
        if above is not None:
            done = _height(fan) <= level + every
            rows = rows.join(above.withColumnRenamed("path", "_ends"), "grp", "left").withColumn("trunk", F.when(done, F.col("_ends"))).drop("_ends")
        if upper is not None:
            goes_on = upper.select("grp", F.col("pos").alias("block"), F.col("path").alias("_goes"))
            rows = rows.join(goes_on, ["grp", "block"], "left").withColumn("trunk", F.coalesce("trunk", "_goes")).drop("_goes")
        steps = lambda i: F.array_compact(F.array(*(F.when(F.col("up") > k, _beside(i, k, fan)) for k in range(every))))
        listed = F.transform("nodes", lambda x, i: F.struct(x.alias("x"), F.concat(steps(i), F.coalesce("trunk", none)).alias("path")))  # noqa: B023
        upper = rows.select("grp", F.explode(listed).alias("_")).select("grp", "_.x.*", "_.path")
    return upper


def _beside(i: Column, k: int, fan: int) -> Column:
    """The siblings, left and right, of leaf i's node k levels up."""
    at = F.floor(i / fan**k).cast("int")
    first, own = at - at % fan, at % fan
    beside = lambda start, n: F.array_join(F.slice(f"l{k}", start + 1, n), "")
    return F.struct(beside(first, own).alias("l"), beside(at + 1, fan - 1 - own).alias("r"))


def proof_text(path: str = "path") -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(leaf: str | Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def manifest(leaves: DataFrame, order: list[Column], fan: int = FAN, every: int = EVERY) -> tuple[Tree, Tree]:
    """(the groups' trees, the tree of their roots) of leaves (grp, node and other columns)."""
    trees = build(leaves, order, "leaves", fan, every)
    return trees, build(trees.roots.select(F.lit(0).alias("grp"), F.col("grp").alias("of"), "node"), [F.col("of")], "roots", fan, every)


def proofs(made: tuple[Tree, Tree], fan: int = FAN, every: int = EVERY) -> DataFrame:
    """(grp, pos, the leaves' columns, path, subroot, root) of every leaf."""
    trees, top = made
    # A row a group: no more than there are languages; a table of that many paths is broadcast only where its size allows.
    ends = stored(paths(top, None, fan, every).select(F.col("of").alias("grp"), "path"), "group-paths")
    one = F.broadcast(top.roots.select(F.col("grp").alias("_all"), F.col("node").alias("root")))  # one row
    roots = trees.roots.withColumnRenamed("node", "subroot").withColumn("_all", F.lit(0)).join(one, "_all").drop("_all")
    return paths(trees, ends, fan, every).join(small(stored(roots, "group-roots")), "grp")


def grouped(c: Column) -> Column:
    """A key of groups that is never null and sorts as c does, bytewise and null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = F.when(struck, digest("doc_id", "source", "lang", "n_chars", ascii_lower(F.col("text"))))
    leaves = stored(docs.select(grouped(F.col("lang")).alias("grp"), "doc_id", digest(*FIELDS).alias("node"), tampered.alias("tampered")), "leaves")
    out = proofs(manifest(leaves, [F.col("doc_id"), F.col("node")])).withColumn("folded_root", folded(F.coalesce("tampered", "node")))
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(proof_text(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 8) -> str:
    """A level of the trees a step, up to fan ** levels leaves a group and as many groups."""
    frame = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = [frame(c) for c in FIELDS[:-1]]
    # CRC-32 of the decimal digits: a byte is added, then eight times the low bit is shifted out.
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: list_concat([ascii(d)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    steps = [f"""base AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, sha256({" || ".join([*fields, frame("text")])}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256({" || ".join([*fields, frame(low)])}) END AS tampered FROM documents)""",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM base)",
        "t0 AS (SELECT grp, pos, n, leaf AS node FROM a0)"]

    def trees(t: str) -> None:
        for k in range(levels):
            steps.append(f"{t}{k + 1} AS (SELECT grp, pos // 8 AS pos, n, CASE WHEN n > {8**k} THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node FROM {t}{k} GROUP BY grp, pos // 8, n)")
            steps.append(f"{t}s{k} AS (SELECT x.grp, x.pos, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r FROM {t}{k} x JOIN {t}{k} y ON x.grp = y.grp AND x.pos // 8 = y.pos // 8 GROUP BY x.grp, x.pos)")

    trees("t")
    steps.append(f"u0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, node, grp AS of FROM t{levels})")
    trees("u")
    steps.append("w AS (SELECT a0.*, u0.node AS subroot, u0.pos AS upos, u0.n AS un, coalesce(tampered, leaf) AS f, '' AS p FROM a0 JOIN u0 ON u0.of = a0.grp)")
    was = "w"
    for t, pos, n in (("t", "pos", "n"), ("u", "upos", "un")):
        for k in range(levels):
            now = f"w{t}{k}"
            steps.append(f"{now} AS (SELECT {was}.* REPLACE (CASE WHEN {n} > {8**k} THEN sha256(s.l || f || s.r) ELSE f END AS f, CASE WHEN {n} > {8**k} THEN p || s.l || s.r ELSE p END AS p) FROM {was} JOIN {t}s{k} s ON s.grp = {f'{was}.grp' if t == 't' else '0'} AND s.pos = {was}.{pos} // {8**k})")
            was = now
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM {was} CROSS JOIN (SELECT node AS root FROM u{levels}) AS top"


SQL = _sql()
