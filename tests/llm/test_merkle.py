"""Operator 12 against a plain tree in Python, and its SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    said = [None if f is None else str(f) for f in fields]
    return h("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in said))


def plain_tree(nodes, fan):
    """(root, the siblings left and right of each node on its way up)."""
    places, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(places):
            first = at - at % fan
            paths[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fan])))
        nodes = [h("".join(nodes[a : a + fan])) for a in range(0, len(nodes), fan)]
        places = [at // fan for at in places]
    return nodes[0], paths


def plain(rows, fan=8):
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made, subroots = [], []
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = plain_tree([leaf(r) for r in own], fan)
        subroots.append(root)
        made.append((own, paths))
    root, tops = plain_tree(subroots, fan)
    out = []
    for (own, paths), subroot, top in zip(made, subroots, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            at = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                at = leaf((*r[:4], lower(r[4])))
            for left, right in path + top:
                at = h(left + at + right)
            out.append((r[0], leaf(r), subroot, root, h("".join(x + y for x, y in path + top)), at, at == root))
    return sorted(out, key=str)


def rows(n, langs=("de", "en", "é", None, "", "x")):
    out = [(k if k % 11 else None, None if k % 7 == 0 else f"s{k % 3}", langs[(k * k) % len(langs)], None if k % 5 == 0 else k, None if k % 13 == 0 else "" if k % 13 == 1 else f"Text {k} É" * (k % 4 + 1)) for k in range(n)]
    return out + [out[3]] * 4 + [(3, "s0", out[3][2], 9, "another Text of this id")]


def query(spark, tmp_path, data, **more):
    df = spark.createDataFrame(data, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in names) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()), key=str)


def test_query_equals_plain_tree(spark, tmp_path):
    data = rows(700)
    got = query(spark, tmp_path, data, grp="a", node="b", pos=1, n=2, path="c", leaf="d")
    assert got == plain(data)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_of_one_group(spark, tmp_path, n):
    data = [(k, "s", "en", 1, f"A{k}") for k in range(n)]
    assert query(spark, tmp_path, data) == plain(data)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


@pytest.mark.parametrize(("fan", "every"), [(2, 2), (2, 1), (3, 4)])
def test_other_fans_and_checkpoints(spark, fan, every):
    data = [(k, "s", "en" if k < 45 else "de", 1, f"t{k}") for k in range(50)]
    df = spark.createDataFrame(data, SCHEMA)
    leaves = df.select(merkle.grouped(F.col("lang")).alias("grp"), "doc_id", merkle.digest(*merkle.FIELDS).alias("node"))
    made = merkle.manifest(leaves, [F.col("doc_id")], fan, every)
    found = merkle.proofs(made, fan, every).withColumn("up", merkle.folded("node")).collect()
    want = {r[0]: r for r in plain(data, fan)}
    assert len(found) == 50
    for r in found:
        w = want[r["doc_id"]]
        assert (r["node"], r["subroot"], r["root"], r["up"], h("".join(s["l"] + s["r"] for s in r["path"]))) == (w[1], w[2], w[3], w[3], w[4])
    # Only every few levels are stored.
    assert [level for level, _ in made[0].levels] == list(range(0, 100, every))[: len(made[0].levels)]


def test_rows_alike_spread_and_hot_groups_are_many_subtrees(spark):
    df = spark.createDataFrame([("=en", "0" * 64)] * 3000, "grp string, node string")
    tree = merkle.build(df, [F.col("node")], "alike")
    assert [(level, blocks.count()) for level, blocks in tree.levels] == [(0, 6), (3, 1)]
    assert sorted(r["pos"] for r in merkle.numbered(df, [F.col("node")]).collect()) == list(range(3000))


def test_sql_equals_query(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    data = [r for r in rows(150) if r[0] is not None]
    got = query(spark, tmp_path, data)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = c.sql(merkle.SQL)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    places = [out.columns.index(n) for n in names]
    assert sorted((tuple(r[p] for p in places) for r in out.fetchall()), key=str) == got
