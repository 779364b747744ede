"""The pipeline's filtering and mixing stages against brute force, with repeated and null ids."""

import re
from collections import Counter

import pytest

from gridloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


ROWS = [
    (1, _words("a", 60), "s"), (1, _words("b", 55) + "\nmore of it", "s"), (1, _words("b", 55) + "\nmore of it", "s"), (1, _words("c", 70), None),
    (None, _words("d", 64), "s"), (None, _words("e", 61), "t"), (None, _words("a", 59), "t"), (3, _words("a", 60), "t"), (4, _words("c", 69), "s"), (5, None, "s"), (6, "", "t"), (7, "a few words", "t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), f"row{k}") for k, (i, t, s) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long, note string").coalesce(1)


def _kept(rows):
    """Rows whose component of texts has no smaller id than their own; a null id is kept if no other has an id."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (WORD.findall((t or "").lower()) for _, t, _ in rows)]
    of = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    ids = lambda k: [rows[x][0] for x in range(len(rows)) if of[x] == of[k] and rows[x][0] is not None]
    return [k for k in range(len(rows)) if (min(ids(k)) if ids(k) else None) == rows[k][0]]


def test_one_of_near_copies(spark, docs):
    import corpus_pipeline as p

    got = p.one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["note"] for r in got.collect()) == sorted(f"row{k}" for k in _kept(ROWS))


def test_mix_sources(spark, docs):
    import corpus_pipeline as p

    got = p.mix_sources(spark, docs, "").collect()
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["taken"]
    words = Counter()
    for r in got:
        i, t, s = ROWS[int(r["note"][3:])]
        n = len(WORD.findall(r["text"]))
        assert (r["doc_id"], r["source"]) == (i, s) and 0 < n <= len(WORD.findall(t)) and r["n_chars"] == len(r["text"])
        assert set(WORD.findall(r["text"])) <= set(WORD.findall(t))
        words[i, s, len(WORD.findall(t))] += n
    assert words == Counter({k: v for k, v in taken.items() if v})
    assert any(r["doc_id"] is None for r in got) and max(Counter(r["note"] for r in got).values()) <= 3


def test_stages_keep_null_and_repeated_ids(spark, docs):
    import corpus_pipeline as p

    lines = p.drop_lines(spark, docs, "")
    assert Counter(r["note"] for r in lines.collect()) == Counter(f"row{k}" for k in range(len(ROWS)))
    mixed = p.mix_sources(spark, p.one_of_near_copies(spark, lines, ""), "")
    assert {"row4", "row5"} & {r["note"] for r in mixed.collect()}
    n = mixed.count()
    assert p.to_pieces(spark, mixed, "").count() == n
