"""Operator 4, secret scans with a random forest that removes false positives.

Candidates are: runs of at least 16 of the characters that keys are made of, with a digit in them or of
high entropy; values of any characters, from 6 on, that are assigned to or quoted after a name with
a word like password, token, secret or key in it, or that follow "bearer"; and the headers of PEM
private keys. Candidates of several kinds at one place are one.
Its features are its length, character classes and the transitions between them, entropy,
dictionary coverage (letters that lie in words of a public vocabulary), path signs, and the words
beside it. The forest is trained on labelled findings (candidate's doc_id, start, label), about half of
most_rows distinct ones of either label, drawn by all 64 bits of a hash (a documented bound), and scores every candidate of every whole text.

The given tables label no secrets, so the query labels findings by rules: values with a digit that are assigned to a
password, token, secret or key, and issued key formats, are secrets; payment numbers, UUIDs, runs of one
character and digit-free words amid prose are not. What the rules look at beside a value is hidden from the features: the
name it is assigned to, the sign and the quotes are cut away before the neighbouring words are taken, so the
forest has to tell a secret by its own characters, by paths and by words farther off. Candidates
without a label are scored by what it learned. Issued formats are reported whatever the forest says (column issued).

Null or empty text: no candidates. Very long texts are scanned whole. Ties and repeated rows: each finding is a row. Null doc_id:
as any other. If only one label occurs nothing can be learned: probabilities are that label's. Empty table: empty
result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import pieces_of, read, sample_of, stored

MODEL, MOST_ROWS, TREES, DEPTH, SEED = "/opt/tokenizers/piece_bpe_32k.model", 4000, 24, 8, 11
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.\-]{16,}")
ENTROPY, LEAST = 3.0, 6
_SIGN, _BEARER = re.compile(r"=>|[=:]"), re.compile(r"(?i)\bbearer[ \t]+")
_NAME = re.compile(r"(?i)(pass|pwd|token|secret|key|auth|credential)[A-Za-z0-9_.\-]{0,40}$")
_VALUE = re.compile(r"\"([^\"\n]+)\"|'([^'\n]+)'|((?:[^\s&]|&(?![A-Za-z_]\w*=))+)")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
_DIGIT, _LETTERS = re.compile("[0-9]"), re.compile("[A-Za-z]{4,}")
NEIGHBOURS = ("password", "passwd", "secret", "token", "key", "api", "auth", "bearer", "sha", "id", "version", "commit")
NAMES = (
    "length", "entropy", "digits", "upper", "lower", "other", "digit_to_letter", "letter_to_digit", "case_changes", "same_class", "distinct",
    "coverage", "slashes", "dots", "after_path", "hex", *(f"near_{w}" for w in NEIGHBOURS),
)
#: Formats of the weak labels: certain secrets, and certain others.
SECRET = (re.compile(r"AKIA[0-9A-Z]{16}$"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}$"), re.compile(r"sk_live_[A-Za-z0-9]{24,}$"), _PEM)
OTHER = (re.compile(r"[0-9.\-]+$"), re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), re.compile(r"(.)\1+$"))
_PROSE = re.compile(r"[^\W\d_]{2,}[,.;:!?]? $")
#: A name with its sign and quotes, or "bearer", at the end of what stands before a value.
_OWN_NAME = re.compile(r"(?i)(?:[\"']?[a-z0-9_.\-]*[\"']?[ \t]*(?:=>|[=:])[ \t]*|bearer[ \t]+)[\"']?$")
_ASSIGNED = re.compile(r"(?i)(password|token|secret|api_?key)[\"']?\s*[=:]\s*[\"']?$")


def dictionary(path: str = MODEL) -> frozenset[str]:
    """Lower-case words of a public vocabulary."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(p.lower() for p in (m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size())) if len(p) >= 4 and p.isascii() and p.isalpha())


def _class(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o"


def _entropy(s: str) -> float:
    return -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values())


def beside(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a candidate, lower-cased, without the name it is assigned to."""
    before = text[max(0, start - 112) : start]
    return _OWN_NAME.sub("", before)[-48:].lower(), text[end : end + 24].lstrip("\"'").lower()


def described(text: str, start: int, end: int, words: frozenset[str]) -> list[float]:
    s = text[start:end]
    kinds = [_class(c) for c in s]
    n, of = len(s), Counter(kinds)
    steps = Counter(zip(kinds, kinds[1:], strict=False))
    entropy = _entropy(s)
    covered = 0
    for m in _LETTERS.finditer(s):
        w, at = m.group().lower(), 0
        while at < len(w):
            hit = next((k for k in range(min(len(w), at + 16), at + 3, -1) if w[at:k] in words), 0)
            covered += hit - at if hit else 0
            at = hit or at + 1
    before, after = beside(text, start, end)
    return [
        n, entropy, of["d"] / n, of["u"] / n, of["l"] / n, of["o"] / n,
        sum(v for (a, b), v in steps.items() if a == "d" and b in "ul") / n, sum(v for (a, b), v in steps.items() if a in "ul" and b == "d") / n,
        (steps["u", "l"] + steps["l", "u"]) / n, sum(v for (a, b), v in steps.items() if a == b) / n, len(set(s)) / n,
        covered / n, s.count("/"), s.count("."), float(before[-1:] in ("/", "\\") or "://" in before[-24:]), 
        float(all(c in "0123456789abcdef" for c in s)), *(float(w in before or w in after) for w in NEIGHBOURS),
    ]


def weak_label(text: str, start: int, end: int) -> int | None:
    s = text[start:end]
    if any(p.match(s) for p in SECRET):
        return 1
    if _ASSIGNED.search(text[max(0, start - 24) : start]):
        return 1 if _DIGIT.search(s) else None  # a word after the name may be prose: the forest tells
    if any(p.match(s) for p in OTHER):
        return 0
    return 0 if not _DIGIT.search(s) and _PROSE.search(text[max(0, start - 24) : start]) else None


def split(text: str, start: int, end: int) -> tuple[int, int]:
    """A candidate without the name it is assigned to and the stop after it."""
    at = max(text.rfind("=", start, end - 8), start - 1)
    start = at + 1 if at >= start else start
    while end > start and text[end - 1] in "=./-":
        end -= 1
    return start, end


def _assigned(text: str):
    """Places of the values after a telling name, or after "bearer"."""
    done = 0
    for m in _SIGN.finditer(text):
        if m.start() >= done and _NAME.search(text[max(0, m.start() - 64) : m.start()].rstrip().rstrip("\"'")):
            at = m.end()
            while at < len(text) and text[at] in " \t":
                at += 1
            if found := _value(text, at):
                yield found
                done = found[1]
    for m in _BEARER.finditer(text):
        if found := _value(text, m.end()):
            yield found


def _value(text: str, at: int) -> tuple[int, int] | None:
    m = _VALUE.match(text, at)
    if not m:
        return None
    s, e = m.span(m.lastindex)
    while m.lastindex == 3 and e > s and text[e - 1] in ".,;)\"'":
        e -= 1
    return (s, e) if e - s >= LEAST else None


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of all candidates, in order."""
    out = {m.span() for m in _PEM.finditer(text)} | set(_assigned(text))
    for m in _CANDIDATE.finditer(text):
        if _DIGIT.search(m.group()) or _entropy(m.group()) >= ENTROPY:
            s, e = split(text, m.start(), m.end())
            if e - s >= 12:
                out.add((s, e))
    return sorted(out)


def candidates(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, start, end, weak, issued, features...) of all candidates."""
    shared = documents.sparkSession.sparkContext.broadcast(dictionary(model))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of([x or "" for x in texts]):
                rows = []
                for k in range(a, b):
                    text = texts[k]
                    for s, e in places(text) if text else ():
                        rows.append((k, s, e, weak_label(text, s, e), described(text, s, e, shared.value), any(p.match(text[s:e]) for p in SECRET)))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.bool_()), *(pa.array([float(r[4][i]) for r in rows], pa.float64()) for i in range(len(NAMES)))],
                    ["doc_id", "start", "end", "weak", "issued", *NAMES],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, weak int, issued boolean, " + ", ".join(f"`{x}` double" for x in NAMES))


def scored(found: DataFrame, label: str = "weak", most_rows: int = MOST_ROWS, learn: Column | None = None) -> DataFrame:
    """found with p_secret: the forest's, trained on found's labelled rows, or on those of them where `learn` holds."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = found.where(F.col(label).isNotNull()) if learn is None else found.where(F.col(label).isNotNull() & learn)
    half = [sample_of(known.where(F.col(label) == y), most_rows // 2, ["doc_id", "start", *NAMES], []).select(*NAMES, F.lit(float(y)).alias("_y")) for y in (0, 1)]
    train = stored(half[0].union(half[1]).coalesce(2).sortWithinPartitions(*NAMES, "_y"), "secret-sample")
    n = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}
    if not n and not known.isEmpty():
        raise RuntimeError("no labelled finding was drawn to learn from")
    if len(n) < 2:
        return found.withColumn("p_secret", F.lit(float(next(iter(n), 0.0))))
    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="_v").transform(found)
    train = VectorAssembler(inputCols=list(NAMES), outputCol="_v").transform(train)
    forest = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_p", predictionCol="_g", rawPredictionCol="_r").fit(train)
    return forest.transform(vectors).withColumn("p_secret", F.round(vector_to_array("_p")[1], 6)).drop("_v", "_p", "_g", "_r")


def findings(documents: DataFrame, labelled: DataFrame | None = None, model: str = MODEL) -> DataFrame:
    """(doc_id, start, end, length, entropy, coverage, p_secret, issued, is_secret) of all candidates; labelled: (doc_id, start, label), else weak labels serve."""
    found = stored(candidates(documents, model), "secret-candidates")
    if labelled is not None:
        known = labelled.groupBy("doc_id", "start").agg(F.max("label").cast("int").alias("known"))
        found = found.join(known, ["doc_id", "start"], "left").withColumn("weak", F.col("known")).drop("known")
    out = scored(found)
    return out.select("doc_id", "start", "end", "length", "entropy", "coverage", "p_secret", "issued", (F.col("issued") | (F.col("p_secret") >= 0.5)).alias("is_secret"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(read(spark, sf_dir, "documents"))
