"""Operator 2, SentencePiece encoding and decoding.

Encoding is the unigram Viterbi: of all ways to cut a text into pieces, the one with the highest sum
of log scores, found over a double-array trie. A character that no piece covers costs `unknown` and
comes out as its UTF-8 bytes' pieces. Text gets a leading space, and each U+0020 becomes the
white-space marker; pieces hold markers at their start only (checked), so words are cut apart at
runs of spaces and each distinct word of a batch is solved once, words of one length together.
Decoding gathers the pieces' bytes, turns markers into spaces and drops the leading one.

Null text: null ids. Empty text: no ids. Repeated rows: each has its ids. Very long texts and words are solved whole: a word of over
LONG bytes, as texts without spaces are, goes by itself through one walk of the trie from all its
places at once and one pass along its edges. The marker
U+2581 itself in a text decodes as a space, as in the format. Other columns stay out of Python.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.llm.common import factorized, pieces_of, read, spread
from gridloom.llm.pieces import LONG, MARK, MODEL, Vocabulary, by_length, edges_along

_CHUNK = re.compile(" +[^ ]*")
#: Characters of texts that a task solves at once, which bounds its memory.
MOST_CHARS = 1_500_000


def chunks_of(text: str) -> list[str]:
    """Words with all but the first of the spaces before them."""
    if not text:
        return []
    if "  " not in text:
        return text.split(" ")
    return [x[1:] for x in _CHUNK.findall(" " + text)]


def best_cuts(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start of each word's ids, their number) of words, which are UTF-8 with markers."""
    parts, where, starts, counts = [], 0, np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    long = [k for k, w in enumerate(words) if len(w) > LONG]
    for k in long:
        ids = _solve_long(words[k], v)
        starts[k], counts[k], where = where, len(ids), where + len(ids)
        parts.append(ids)
    short = np.array([k for k, w in enumerate(words) if len(w) <= LONG], np.int64)
    for places, text in by_length([words[k] for k in short] if long else words):
        places = short[places]
        n, length = text.shape
        step = max(1, 1_000_000 // (length + 1))
        for a in range(0, n, step):
            rows, ids, per = _solve(text[a : a + step], v)
            own = places[a : a + step]
            counts[own] = per
            starts[own] = where + np.cumsum(per) - per
            where += len(ids)
            parts.append(ids)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), starts, counts


def _solve(text: np.ndarray, v: Vocabulary) -> tuple[None, np.ndarray, np.ndarray]:
    n, length = text.shape
    starts = (text & 0xC0) != 0x80
    width = np.select([text < 0x80, text < 0xE0, text < 0xF0], [1, 2, 3], 4)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    came, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
    single = np.zeros(n, bool)
    at = -1

    def unknowns(i: int) -> None:
        """Characters at i of which no piece is just that character."""
        for w in (1, 2, 3, 4):
            rows = np.flatnonzero(starts[:, i] & (width[:, i] == w) & ~single)
            if len(rows) and i + w <= length:
                better(i, i + w, rows, v.unknown, -1)

    def better(i, j, rows, score, ids) -> None:
        total = best[i, rows] + score
        won = total > best[j, rows]
        rows = rows[won]
        best[j, rows], came[j, rows], piece[j, rows] = total[won], i, ids if np.isscalar(ids) else ids[won]

    for i, j, rows, ids in v.trie.matches(text, starts):
        while at < i:
            if at >= 0:
                unknowns(at)
            at, single = at + 1, np.zeros(n, bool)
        better(i, j, rows, v.scores[ids], ids)
        single[rows[width[rows, i] == j - i]] = True
    while at < length:
        if at >= 0:
            unknowns(at)
        at, single = at + 1, np.zeros(n, bool)

    out, mask = np.zeros((length, n), np.int32), np.zeros((length, n), bool)  # an id never needs more than its first byte's place
    end = np.full(n, length)
    live = np.arange(n)
    while len(live):
        i, p = came[end[live], live], piece[end[live], live]
        known = p >= 0
        out[i[known], live[known]] = p[known]
        mask[i[known], live[known]] = True
        for w in (1, 2, 3, 4):
            rows = (~known) & (end[live] - i == w)
            for k in range(w):
                out[i[rows] + k, live[rows]] = v.byte_ids[text[live[rows], i[rows] + k]]
                mask[i[rows] + k, live[rows]] = True
        end[live] = i
        live = live[i > 0]
    return None, out.T[mask.T], mask.sum(0)


def _solve_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """Ids of one word, by the same sums and ties as _solve()."""
    n = len(word)
    best, step, piece = [0.0], np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
    low = 0  # the places before it are done
    for i, j, ids in edges_along(word, v, every_character=False):
        if not len(i):
            continue
        high = int(j.max()) + 1
        best += [-np.inf] * (high - low - len(best))
        came, by = [0] * len(best), [-1] * len(best)
        own = piece[low:high], step[low:high]
        came[: len(own[0])], by[: len(own[0])] = own[1].tolist(), own[0].tolist()
        score = np.where(ids < 0, v.unknown, v.scores[ids])
        for a, b, p, s in zip((i - low).tolist(), (j - low).tolist(), ids.tolist(), score.tolist(), strict=True):
            total = best[a] + s
            if total > best[b]:
                best[b], came[b], by[b] = total, b - a, p
        step[low:high], piece[low:high] = came, by
        done = min(int(i[-1]) + 1, high - 1) - low
        best, low = best[done:], low + done
    out, end, raw = [], n, v.byte_ids
    while end:
        size, p = int(step[end]), int(piece[end])
        out += [p] if p >= 0 else [int(raw[b]) for b in reversed(word[end - size : end])]
        end -= size
    return np.array(out[::-1], np.int32)


def encoded_batch(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of each text's)."""
    codes, unique, offsets = factorized([chunks_of(x) for x in texts])
    ids, starts, counts = best_cuts([(MARK + w.replace(" ", MARK)).encode() for w in unique], v)
    per = np.concatenate(([0], np.cumsum(counts[codes]))) if len(codes) else np.zeros(1, np.int64)
    flat = ids[spread(starts[codes], counts[codes])] if len(codes) else np.zeros(0, np.int32)
    return flat.astype(np.int32), per[offsets[1:]] - per[offsets[:-1]]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, text, ids array<int>)."""
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(model))  # as large as the model's file

    def run(batches):
        v = shared.value
        for batch in batches:
            texts, keys, was = batch.column(1).to_pylist(), batch.column(0), batch.column(1)
            for a, b in pieces_of([x or "" for x in texts], MOST_CHARS):
                own = texts[a:b]
                flat, per = encoded_batch([x or "" for x in own], v)
                ends = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in own]))
                yield pa.RecordBatch.from_arrays([keys[a:b], was[a:b], ids], ["k", "t", "ids"])

    d = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    out = d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, t string, ids array<int>")
    return out.withColumnsRenamed({"k": key, "t": text})


def decoded_batch(ids: np.ndarray, per: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    flat, starts, lengths = table
    data = flat[spread(starts[ids], lengths[ids])].tobytes() if len(ids) else b""
    size = np.concatenate(([0], np.cumsum(lengths[ids])))
    cuts = size[np.concatenate(([0], np.cumsum(per)))]
    return [data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def piece_bytes(v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in v.bytes_of])
    return np.frombuffer(b"".join(v.bytes_of), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(encoded: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """encoded with column `into`: the text that ids stand for; null where ids is null."""
    shared = encoded.sparkSession.sparkContext.broadcast(piece_bytes(Vocabulary(model)))
    at = encoded.columns.index(ids)

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            for a, b in _even(lengths, 1_000_000):
                own = lists[a:b]
                per = lengths[a:b]
                texts = decoded_batch(np.asarray(own.flatten()), per, shared.value)
                null = np.asarray(own.is_null())
                text = pa.array([None if no else x for x, no in zip(texts, null, strict=True)], pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*batch.schema.names, into])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(into, StringType())]))


def _even(lengths: np.ndarray, most: int):
    start = size = 0
    for k, n in enumerate(lengths):
        if size and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Ids of every text, and proof of the round trip."""
    back = decode(encode(read(spark, sf_dir, "documents"), model=model), model=model)
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.regexp_replace("text", MARK, " ")).alias("round_trip"), "ids",
    )
