"""Operator 8, language ID by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, by a forward pass over the trie; a text's score is the
sum of its words' logs, and a prediction the softmax over languages. The piece probabilities are
learned by expectation maximisation from the words of labelled documents outside the held-out fold:
about `most_docs` distinct ones, in equal parts for the languages, chosen by all 64 bits of a hash of
doc_id and text (a documented bound; a classifier may be fitted on a sample). An empty draw is an
error, never silence. Counts are gathered by Spark and a row a piece and language comes back, which
the vocabulary bounds.

Words are runs of letters, lower-cased. A character without a piece costs OTHER in every language.
Scoring never cuts a word; fitting takes words of over LONG bytes in parts of that length. A text's score depends on no other
row. Null text or no letter: und, score 0. Repeated rows: equal predictions. A language that is null is not learned. No labelled
document at all: every prediction is und. Columns lang_pred and score of the input give way to the predicted ones.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import factorized, pieces_of, read, sums_by_document
from gridloom.llm.pieces import LONG, MARK, MODEL, Vocabulary, by_length, edges_along, widths

OTHER, FOLDS, MOST_DOCS, ROUNDS = 1e-7, 5, 6000, 2
_WORDS = re.compile(r"[^\W\d_]+")
#: Keeps products of up to LONG bytes in the range of a double: about a byte's usual inverse probability.
SCALE = 8.0


def parts_of(word: str) -> list[bytes]:
    """A word's UTF-8 with the marker before it, in parts of at most LONG bytes at characters' ends."""
    raw = (MARK + word).encode()
    out = []
    while len(raw) > LONG:
        cut = LONG
        while raw[cut] & 0xC0 == 0x80:
            cut -= 1
        out.append(raw[:cut])
        raw = raw[cut:]
    return [*out, raw]


def _edges(text: np.ndarray, v: Vocabulary) -> list[tuple]:
    """All (i, j, rows, piece) of words of one length, pieces of -1 for each single character."""
    starts = (text & 0xC0) != 0x80
    width = widths(text)
    found: dict[int, list] = {i: [] for i in range(text.shape[1])}
    for i, j, rows, ids in v.trie.matches(text, starts):
        found[i].append((i, j, rows, ids))
    for i in found:
        for w in (1, 2, 3, 4):
            if len(rows := np.flatnonzero(starts[:, i] & (width[:, i] == w))) and i + w <= text.shape[1]:
                found[i].append((i, i + w, rows, -1))
    return [e for i in sorted(found) for e in found[i]]


def _forward(edges: list[tuple], n: int, length: int, p: np.ndarray) -> np.ndarray:
    alpha = np.zeros((length + 1, n, p.shape[1]))
    alpha[0] = 1
    for i, j, rows, ids in edges:
        alpha[j, rows] += alpha[i, rows] * ((OTHER if np.isscalar(ids) else p[ids]) * SCALE ** (j - i))
    return alpha


def word_logs(words: list[bytes], v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log probability of each word (a row) in each language (a column)."""
    out = np.zeros((len(words), p.shape[1]))
    long = [k for k, w in enumerate(words) if len(w) > LONG]
    for k in long:
        out[k] = _log_along(words[k], v, p)
    short = np.array([k for k, w in enumerate(words) if len(w) <= LONG], np.int64)
    for places, text in by_length([words[k] for k in short] if long else words):
        places = short[places]
        step = max(1, 2_000_000 // ((text.shape[1] + 1) * p.shape[1]))
        for a in range(0, len(text), step):
            part = text[a : a + step]
            z = _forward(_edges(part, v), *part.shape, p)[-1]
            out[places[a : a + step]] = np.log(np.maximum(z, 1e-300)) - part.shape[1] * np.log(SCALE)
    return out


def _log_along(word: bytes, v: Vocabulary, p: np.ndarray) -> list[float]:
    """The forward pass of one long word, in logs: no product of its length leaves a double's range."""
    exp, log1p, sums = math.exp, math.log1p, []
    logs = np.log(p)
    for k in range(p.shape[1]):
        alpha, low = [0.0], 0
        for i, j, ids in edges_along(word, v, every_character=True):
            if not len(i):
                continue
            alpha += [-math.inf] * (int(j.max()) + 1 - low - len(alpha))
            cost = np.where(ids < 0, math.log(OTHER), logs[ids, k])
            for a, b, c in zip((i - low).tolist(), (j - low).tolist(), cost.tolist(), strict=True):
                x, y = alpha[a] + c, alpha[b]
                alpha[b] = x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)) if y > -math.inf else x
            done = min(int(i[-1]) + 1, low + len(alpha) - 1) - low
            alpha, low = alpha[done:], low + done
        sums.append(alpha[-1])
    return sums


def piece_counts(words: list[bytes], n: np.ndarray, v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected count of each piece, words weighted by n; p: one language's probabilities."""
    out = np.zeros(len(p))
    p = p[:, None]
    for places, text in by_length(words):
        step = max(1, 1_000_000 // (text.shape[1] + 1))
        for a in range(0, len(text), step):
            part, own = text[a : a + step], n[places[a : a + step]]
            edges = _edges(part, v)
            alpha = _forward(edges, *part.shape, p)[..., 0]
            beta = np.zeros_like(alpha)
            beta[-1] = 1
            weight = own / np.maximum(alpha[-1], 1e-300)
            for i, j, rows, ids in reversed(edges):
                one = beta[j, rows] * ((OTHER if np.isscalar(ids) else p[ids, 0]) * SCALE ** (j - i))
                beta[i, rows] += one
                if not np.isscalar(ids):
                    np.add.at(out, ids, alpha[i, rows] * one * weight[rows])
    return out


def held_out(doc_id, folds: int = FOLDS):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0


def fit(documents: DataFrame, model: str = MODEL, most_docs: int = MOST_DOCS, rounds: int = ROUNDS, folds: int = FOLDS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities with a column a language)."""
    spark = documents.sparkSession
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id"), folds), F.lit(True)))
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("tag"))
    total = known.groupBy("lang").agg(F.approx_count_distinct("tag", 0.02).alias("n")).collect()  # a row a language
    langs = sorted(r["lang"] for r in total)
    v = Vocabulary(model)
    if not langs:
        return [], np.zeros((len(v.scores), 0))
    # A language's share of the 64-bit hashes, which none of its documents' number makes vanish.
    upto = [(r["lang"], (1 << 63) - 1 if r["n"] <= most_docs / len(langs) else int(most_docs / len(langs) / r["n"] * 2**64) - (1 << 63)) for r in total]
    shares = F.broadcast(spark.createDataFrame(upto, "lang string, upto long"))
    sample = known.join(shares, "lang").where(F.col("tag") <= F.col("upto")).groupBy("lang", "tag").agg(F.first("text").alias("text")).select("lang", "text")

    def counted(batches):
        for batch in batches:
            langs_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in pieces_of(texts):
                codes, unique, offsets = factorized([_WORDS.findall(x.lower()) for x in texts[a:b]])
                lang = pd.Series(langs_of[a:b], dtype=object).repeat(np.diff(offsets)).to_numpy()
                t = pd.DataFrame({"lang": lang, "code": codes}).value_counts().reset_index(name="n")
                yield pa.RecordBatch.from_arrays([pa.array(t["lang"], pa.string()), pa.array(unique[t["code"].to_numpy(np.int64)] if len(t) else [], pa.string()), pa.array(t["n"].to_numpy(np.int64))], ["lang", "word", "n"])

    # Everything below works on the words of the bounded sample.
    words = sample.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    if sample.isEmpty():
        raise RuntimeError("no labelled document was drawn to learn from")
    p = np.full((len(v.scores), len(langs)), 1.0 / len(v.scores))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((v, p, langs))

        def expected(frames):
            vocab, prob, names = shared.value
            sums: dict[str, np.ndarray] = {}
            for t in frames:
                for lang, own in t.groupby("lang"):
                    pairs = [(x, n) for w, n in zip(own["word"], own["n"], strict=True) for x in parts_of(w)]
                    c = piece_counts([x for x, _ in pairs], np.array([n for _, n in pairs], float), vocab, prob[:, names.index(lang)])
                    sums[lang] = sums.get(lang, 0) + c
            for lang, c in sums.items():
                ids = np.flatnonzero(c > 0)
                yield pd.DataFrame({"lang": lang, "piece": ids, "n": c[ids]})

        rows = words.mapInPandas(expected, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.full(p.shape, 0.02)
        for r in rows:
            counts[r["piece"], langs.index(r["lang"])] += r["n"]
        p = counts / counts.sum(0)
    words.unpersist()
    return langs, p


def predicted(texts: list, v: Vocabulary, langs: list[str], p: np.ndarray) -> tuple[list[str], np.ndarray]:
    codes, unique, offsets = factorized([_WORDS.findall(x.lower()) if x else [] for x in texts])
    letters = np.array([any(map(str.isalpha, w)) for w in unique], float)
    logs = word_logs([(MARK + w).encode() for w in unique], v, p) * letters[:, None]
    has = sums_by_document(letters[codes], offsets)
    total = sums_by_document(logs[codes], offsets)
    best = total.argmax(1)
    odds = np.exp(total - total.max(1, keepdims=True))
    score = odds.max(1) / odds.sum(1)
    no = has == 0
    return ["und" if no[k] else langs[best[k]] for k in range(len(texts))], np.where(no, 0.0, score)


def predict(documents: DataFrame, fitted: tuple[list[str], np.ndarray], model: str = MODEL) -> DataFrame:
    """documents with lang_pred and score, from the text alone."""
    langs, p = fitted
    documents = documents.drop("lang_pred", "score")
    names = documents.columns
    if not langs:
        return documents.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = documents.sparkSession.sparkContext.broadcast((Vocabulary(model), langs, p))  # pieces times languages
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in pieces_of([x or "" for x in texts]):
                lang, score = predicted(texts[a:b], *shared.value)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import StructType

    schema = StructType([*documents.schema.fields]).add("lang_pred", "string").add("score", "double")
    return documents.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang"), model), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
