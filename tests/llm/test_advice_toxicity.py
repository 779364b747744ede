"""op10's features against plain counts, its cut, and its edges."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import toxicity


def plain(text):
    """Features of one text, spelled out: words and their first letters, each again for the second and third time."""
    times = {}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for f in [w] + [w[:k] + "*" for k in (4, 5, 6, 7) if len(w) >= k]:
            times[f] = times.get(f, 0) + 1
    return sorted(f + s for f, n in times.items() for k, s in ((1, ""), (2, "2"), (3, "3")) if n >= k)


def test_features_equal_plain_counts():
    rng = random.Random(7)
    words = ["Idiot", "idiots", "a1b", "éclair", "ÉCLAIRS", "x", "trashcan_trash", "the"]
    texts = [None, ""] + [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(80)] + ["long " * 50_000]
    got = toxicity.documents_features(texts)
    assert got == [plain(t or "") for t in texts]
    some = {f: 1.0 for f in plain("Idiot idiots the") if not f.startswith("i")} | {"idio*": 1.0}
    assert toxicity.documents_features(texts, some) == [[f for f in plain(t or "") if f in some] for t in texts]


def test_best_cut():
    rng = np.random.default_rng(5)
    for _ in range(50):
        p = rng.integers(0, 6, 30) / 6
        y = rng.random(30) < p
        f1 = lambda c: 2 * (y & (p >= c)).sum() / ((p >= c).sum() + y.sum()) if y.any() else 0  # noqa: E731, B023
        assert not y.any() or f1(toxicity.best_cut(p, y)) == max(f1(c) for c in (*p, 2.0))
    assert toxicity.best_cut(np.zeros(3), np.zeros(3, bool)) == 0.5 and toxicity.best_cut(np.zeros(0), np.zeros(0, bool)) == 0.5


def test_held_out_toxic_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    got = toxicity.predict(docs, toxicity.fit(docs, labels.where(~held))).join(labels.where(held).withColumnRenamed("toxic", "is_toxic"), "doc_id")
    n = {(r["is_toxic"], r["toxic"]): r["count"] for r in got.groupBy("is_toxic", "toxic").count().collect()}
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.01 * n[0, False]


def test_empty_tables_clashing_columns_and_ties(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.predict(docs, toxicity.fit(docs, labels)).collect() == []
    rows = [(k, "vile words" if k % 2 else "kind words", k, "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int, f string")
    got = toxicity.predict(docs, toxicity.fit(docs, spark.createDataFrame([(k, 1, k % 2, 7.0) for k in range(40)], "doc_id long, quality int, toxic int, severity double"))).collect()
    assert len({r["severity"] for r in got}) == 2 and {(r["doc_id"] % 2, r["toxic"]) for r in got} == {(0, False), (1, True)}
