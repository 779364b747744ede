"""Operator 10, toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - t_k): one weight vector for all ordered thresholds t_1 < t_2. x are
sparse features of a text's words: the words, and their first 4 to 7 letters, which catch unseen
forms, each once more where it occurs twice, and three times: one such stem may be chance where several tell. A
text's vector has length 1. Of all features of the labelled sample those most unevenly spread between toxic and other
documents are kept (most_features, by a z-score, in at least min_docs documents). Grades come from
the labels alone, never from the text: 0 where toxic is 0, 1 where it is set, 2 where the document is also labelled of
low quality; labels with a column grade are taken as they are. A grade that no document has leaves its threshold out of
reach. A document counts as toxic from the probability on that served best (by F1) where each half of the sample
is judged by a model of the other, features chosen anew. The model is fitted by gradient steps on about most_docs distinct labelled documents,
chosen by all 64 bits of a hash (a documented bound); scoring covers every whole text.

Null text: no features. Empty and very long texts: as any other. Null toxic labels don't count; several labels of a document: the
highest grade. Repeated rows: each is scored, and one of them is learned from. Null doc_id: scored, not learned from.
Without labels of both kinds nothing is learned and every severity is 0. Empty table: empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import factorized, pieces_of, read, sample_of, stored

MOST_DOCS, MOST_FEATURES, MIN_DOCS, MIN_Z, ROUNDS, DECAY, GRADES = 12_000, 4000, 3, 3.0, 400, 1e-4, 3
_WORDS = re.compile(r"[^\W\d_]+")
STEMS, TIMES = (4, 5, 6, 7), 3


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


def documents_features(texts: list, allowed: dict | None = None) -> list[list[str]]:
    """Each text's distinct features, of those allowed; f2 and f3 stand for feature f twice and three times."""
    codes, unique, offsets = factorized([_WORDS.findall(x.lower()) if x else [] for x in texts])
    plain = None if allowed is None else {f.rstrip("23") for f in allowed}
    of = [[f for f in features_of(w) if plain is None or f in plain] for w in unique]
    some = np.array([bool(x) for x in of])
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own, n = codes[a:b], {}
        for k, times in zip(*(x.tolist() for x in np.unique(own[some[own]] if b > a else own, return_counts=True)), strict=True):
            for f in of[k]:
                n[f] = n.get(f, 0) + times
        found = [f if k == 1 else f"{f}{k}" for f, times in n.items() for k in range(1, min(times, TIMES) + 1)]
        out.append(sorted(f for f in found if allowed is None or f in allowed))
    return out


def fit_ordinal(x: list[np.ndarray], y: np.ndarray, width: int, grades: int, rounds: int = ROUNDS, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of rows of feature indices, each scaled to length 1. Adam on the likelihood of the cumulative-link model."""
    scale = np.repeat([len(r) ** -0.5 if len(r) else 0.0 for r in x], [len(r) for r in x])
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    p = np.zeros(width + grades - 1)
    p[width:] = np.log(np.expm1(1.0))
    p[width] = 1.0
    m, s = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for step in range(1, rounds + 1):
        gaps = np.log1p(np.exp(p[width + 1 :]))
        t = p[width] + np.concatenate(([0], np.cumsum(gaps)))
        z = np.bincount(rows, p[cols] * scale, len(x))
        up = np.column_stack([np.ones(len(x)), sig(z[:, None] - t), np.zeros(len(x))])
        here = np.maximum(up[np.arange(len(x)), y] - up[np.arange(len(x)), y + 1], 1e-9)
        slope = up * (1 - up)
        d_lo, d_hi = slope[np.arange(len(x)), y] / here, slope[np.arange(len(x)), y + 1] / here
        dz = (d_lo - d_hi) / len(x)
        g = np.zeros_like(p)
        g[:width] = np.bincount(cols, dz[rows] * scale, width) - decay * p[:width]
        dt = np.array([(-(d_lo * (y == k)) + d_hi * (y == k - 1)).sum() / len(x) for k in range(1, grades)])
        tail = dt[::-1].cumsum()[::-1]
        g[width] = tail[0]
        g[width + 1 :] = tail[1:] * sig(p[width + 1 :])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return p[:width], p[width] + np.concatenate(([0], np.cumsum(np.log1p(np.exp(p[width + 1 :])))))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labelled documents."""
    if "grade" in labels.columns:
        g = F.col("grade").cast("int")
    else:
        low = F.coalesce(F.col("quality") <= 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
        g = F.when(F.col("toxic") > 0, F.when(low, 2).otherwise(1)).when(F.col("toxic") <= 0, 0)
    return labels.select("doc_id", g.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def fit(documents: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_features: int = MOST_FEATURES, grades: int = GRADES) -> tuple[dict[str, float], np.ndarray, float]:
    """(weight of each feature, thresholds, the probability from which a document counts as toxic)."""
    chosen = stored(sample_of(graded(labels), most_docs, ["doc_id"], ["grade"]), "toxic-labels")
    # About most_docs rows, whatever the input's size; a doc_id may stand for many texts, so these are drawn once more.
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("tag")).join(F.broadcast(chosen), "doc_id")
    sample = sample_of(texts, most_docs, ["doc_id", "tag"], ["text", "grade"]).select("text", "grade")

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in pieces_of([x or "" for x in texts]):
                found = documents_features(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(found, pa.list_(pa.string()))], ["grade", "f"])

    rows = stored(sample.mapInArrow(run, "grade int, f array<string>").withColumns({"toxic": (F.col("grade") > 0).cast("int"), "fold": F.pmod(F.xxhash64("f"), F.lit(2))}), "toxic-sample")
    if rows.isEmpty() and not texts.isEmpty():
        raise RuntimeError("no labelled document was drawn to learn from")
    n = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}  # 4 rows
    count = lambda toxic, folds: sum(n.get((k, toxic), 0) for k in folds)
    if not count(1, (0, 1)) or not count(0, (0, 1)):
        return {}, np.zeros(grades - 1), 0.5
    each = rows.select(F.explode("f").alias("f"), "toxic", "fold").groupBy("f")
    by = stored(each.agg(*(F.count_if((F.col("fold") == k) & (F.col("toxic") >= least)).alias(f"{name}{k}") for k in (0, 1) for name, least in (("a", 1), ("n", 0)))), "toxic-counts")

    def model(folds: tuple[int, ...], judged: tuple[int, ...]) -> tuple[dict[str, int], tuple, list, list]:
        """Features, the model of the rows of these folds, and the features and grades of those to be judged by it."""
        place = {f: k for k, f in enumerate(_telling(by, folds, count(1, folds), count(0, folds), most_features))}
        kept = rows.select("grade", "fold", F.array_intersect("f", F.lit(list(place)) if place else F.lit([]).cast("array<string>")).alias("f")).collect()  # most_docs rows
        own = [(np.array([place[f] for f in r["f"]], np.int64), min(r["grade"], grades - 1), r["fold"]) for r in kept]
        some = [r for r in own if r[2] in folds]
        fitted = fit_ordinal([r[0] for r in some], np.array([r[1] for r in some]), len(place), grades)
        return place, fitted, [r[0] for r in own if r[2] in judged], [r[1] > 0 for r in own if r[2] in judged]

    p, y = [], []
    for fold in (0, 1):
        if count(1, (fold,)) and count(0, (fold,)):
            _, (w, t), x, toxic = model((fold,), (1 - fold,))
            p += [1 / (1 + np.exp(t[0] - w[r].sum() * max(len(r), 1) ** -0.5)) for r in x]
            y += toxic
    place, (w, t), _, _ = model((0, 1), ())
    return {f: float(w[k]) for f, k in place.items()}, t, best_cut(np.array(p), np.array(y, bool))


def _telling(by: DataFrame, folds: tuple[int, ...], ones: int, zeros: int, most: int) -> list[str]:
    """The features most unevenly spread: by the signed root of the likelihood ratio of a feature's two counts."""
    a, n = (sum((F.col(f"{name}{k}") for k in folds[1:]), F.col(f"{name}{folds[0]}")) for name in "an")
    by = by.select("f", a.alias("a"), n.alias("n")).where(F.col("n") >= MIN_DOCS)
    of = lambda n, k: F.when(n > 0, n * F.log(n / (F.col("n") * (k / (ones + zeros))))).otherwise(0.0)
    z = F.sqrt(F.greatest(2 * (of(F.col("a"), ones) + of(F.col("n") - F.col("a"), zeros)), F.lit(0.0)))
    return [r["f"] for r in by.select("f", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "f").limit(most).collect()]


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability, half way between two of those seen, from which on calling toxic has the best F1; 0.5 if nothing is toxic. Ties: the higher."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    ends = np.append(np.diff(p[order]) < 0, True)  # equal probabilities stay together
    f1 = np.where(ends, 2 * hits / (n + y.sum()), -1.0)
    k = int(f1.argmax())
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0.0)) / 2)


def predict(documents: DataFrame, model: tuple[dict[str, float], np.ndarray, float], key: str = "doc_id") -> DataFrame:
    """(doc_id, grade, severity, p_toxic, toxic): severity is the expected grade, toxic whether p_toxic reaches the model's cut."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most most_features weights

    def run(batches):
        weights, t, cut = (*shared.value, 0.5)[:3]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of([x or "" for x in texts]):
                found = documents_features(texts[a:b], weights)
                z = np.array([sum(weights[f] for f in fs) * max(len(fs), 1) ** -0.5 for fs in found])
                up = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -500, 500))) if weights else np.zeros((len(z), len(t)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array((up >= 0.5).sum(1), pa.int32()), pa.array(np.round(up.sum(1), 9)), pa.array(np.round(up[:, 0], 9)), pa.array((up[:, 0] >= cut) & bool(weights))], [key, "grade", "severity", "p_toxic", "toxic"])

    d = documents.select(f"`{key}`", "text")
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, grade int, severity double, p_toxic double, toxic boolean")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs, read(spark, sf_dir, "labels")))
