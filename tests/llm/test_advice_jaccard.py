"""op1 with copies: one document stands for each class."""

import random

import numpy as np

from gridloom.llm import jaccard_join

BASE = [f"w{k}" for k in range(60)]


def test_copies_make_one_prefix(spark, monkeypatch):
    near = " ".join(BASE[:30] + ["q"] + BASE[31:])
    rows = [(k, " ".join(BASE)) for k in range(40)] + [(50 + k, near) for k in range(3)] + [(50, near)] * 4 + [(60, " ".join(BASE[:58])), (61, "of its own " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, written = jaccard_join.stored, {}

    def watched(df, name):
        written[name] = kept(df, name)
        return written[name]

    monkeypatch.setattr(jaccard_join, "stored", watched)
    got = jaccard_join.jaccard_components(docs)
    got = {(r["doc_id"], r["component_id"]) for r in got.collect()}
    assert got == {(k, 0) for k in (*range(40), 50, 51, 52, 60)} | {(61, 61)}
    # No shingle of a class stands in a group more often than its prefix holds it.
    groups = written["prefix-groups"].groupBy("c", "t").count()
    assert groups.count() > 0 and groups.where("count > 1").count() == 0


def test_null_ids_link(spark):
    rows = [(None, " ".join(BASE)), (None, " ".join(BASE)), (4, " ".join(BASE[:58])), (None, "a b c d e f g h"), (4, "quite another text of this same id here")]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 4, -1), (-1, 56, 4), (-1, 56, 4), (4, 4, 4), (4, 54, 4)]


def _components(spark, rows):
    return {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_null_id_is_a_bridge(spark):
    near = lambda *at: " ".join("q%d" % k if k in at else w for k, w in enumerate(BASE))
    sets = [{tuple(x.split()[k : k + 5]) for k in range(56)} for x in (near(), near(20), near(20, 40))]
    link = lambda a, b: len(a & b) >= 0.75 * len(a | b)
    assert link(sets[0], sets[1]) and link(sets[1], sets[2]) and not link(sets[0], sets[2])
    assert _components(spark, [(1, near()), (None, near(20)), (2, near(20, 40))]) == {(1, 1), (None, 1), (2, 1)}
    assert _components(spark, [(1, near()), (2, near(20, 40))]) == {(1, 1), (2, 2)}


def test_many_repeats_of_two_ids(spark, monkeypatch):
    kept, most = jaccard_join.stored, {}

    def watched(df, name):
        out = kept(df, name)
        most[name] = max(most.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    rows = [(1, " ".join(BASE))] * 100 + [(2, " ".join(BASE[:57]))] * 100
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 200 and {r["component_id"] for r in got} == {1}
    assert most["links"] == 1 and most["sets"] == 2 and most["class-prefixes"] == 2


def test_very_long_texts(spark):
    words = [f"w{k}" for k in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[: 320_000])), (3, " ".join(words[:290_000]) + " x" * 9)]
    assert _components(spark, rows) == {(1, 1), (2, 1), (3, 1)}
    assert _components(spark, rows[::2]) == {(1, 1), (3, 3)}


def test_one_of_each_keeps_all_columns(spark):
    rows = [(1, " ".join(BASE), "a", 1, 5), (2, " ".join(BASE[:58]), "b", 2, 6), (None, " ".join(BASE), "c", 3, 7), (3, None, "d", 4, 8), (3, None, "d", 4, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _tag long, component_id long")
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r["_id"] for r in got.collect()) == ["a", "d", "d"]


def _family(rng, n, words, edits):
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def _brute(texts):
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                was, now = max(group[a], group[b]), min(group[a], group[b])
                group = [now if g == was else g for g in group]
    return group


def test_families_around_the_threshold(spark, monkeypatch):
    """Near copies of which few pairs link: star rounds go on, and hardly any pair that doesn't link becomes a row of the last round."""
    rng = random.Random(4)
    texts = _family(rng, 260, 120, (2, 5)) + _family(rng, 60, 400, (4, 14)) + _family(rng, 40, 30, (0, 2))
    kept, rows = jaccard_join.stored, {}

    def watched(df, name):
        out = kept(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    monkeypatch.setattr(jaccard_join, "OPEN", 8)
    got = dict(_components(spark, list(enumerate(texts))))
    assert [got[k] for k in range(len(texts))] == _brute(texts)
    assert len(rows["star-pairs"]) > 1 and sum(rows["near-pairs"]) < 4 * len(texts)


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(1)
    for n, d in ((1, 1), (40, 3), (500, 90), (3000, 700)):
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.concatenate((own[min(d, len(own) - 1) :], rng.integers(0, 2**63, d).astype(np.uint64)))
        apart = len(np.setxor1d(own, other))
        assert 0 < np.bitwise_count((jaccard_join.sketch(own) ^ jaccard_join.sketch(other)).view(np.uint64)).sum() <= apart


def test_sides_that_are_sent_stay_narrow(spark, monkeypatch):
    """Sketches were broadcast from the driver with each class, several times over; no side that may be sent holds them, and each has the operator's own bound."""
    rng = random.Random(7)
    texts = _family(rng, 40, 60, (1, 3))
    sent, bounds = [], set()

    def watched(df, most_bytes=32 << 20):
        sent.append(df.columns)
        bounds.add(most_bytes)
        return df

    monkeypatch.setattr(jaccard_join, "small", watched)
    got = dict(_components(spark, list(enumerate(texts))))
    assert [got[k] for k in range(len(texts))] == _brute(texts)
    assert sent and max(map(len, sent)) <= 3 and not any(set(c) & set(jaccard_join.SKETCH) for c in sent)
    assert bounds == {jaccard_join.SENT} and jaccard_join.SENT <= 8 << 20
