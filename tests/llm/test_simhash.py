"""Operator 11 against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def least_of_linked(fps, names, tau=4):
    """Of each, the least name reachable over links; None is no name."""
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= tau and group[a] != group[b]:
                was, now = group[a], group[b]
                group = [now if g == was else g for g in group]
    return [min((n for n, h in zip(names, group, strict=True) if h == g and n is not None), default=None) for g in group]


def flipped(rng, x, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        x ^= 1 << b
    return x


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents_equal_brute_force(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(90)]
    texts = [None, "", " \n\t", "one", "ONE", "two words", "Two  Words", "a b c d", "a b c d e", "é Ü ß É words", "x" * 50_000, " ".join(rng.choice(base) for _ in range(30_000))]
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(90)] = rng.choice(("new", "W1", "other"))
        texts.append(" ".join(own))
    ids = [None if k == 3 else 500 - 3 * k for k in range(len(texts))]
    rows = list(zip(ids, texts, strict=True)) + [(ids[20], texts[20])] * 3
    extra = [(i, t, 7, "x") for i, t in rows]
    df = spark.createDataFrame(extra, "doc_id long, text string, fp int, component_id string").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], least_of_linked(fps, [i for i, _ in rows]), strict=True), key=str)
    assert got == want


def test_an_id_that_is_missing_names_nothing(spark):
    df = spark.createDataFrame([(None, "only this text here and more"), (None, "only this text here and more")], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()] == [(None, None)] * 2


@pytest.mark.parametrize(("tau", "crowd"), [(4, 1024), (4, 3), (3, 1), (2, 2), (1, 1)])
def test_fingerprints_equal_brute_force(spark, tau, crowd):
    rng = random.Random(100 * tau + crowd)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        seed = rng.getrandbits(64)
        fps |= {flipped(rng, seed, 7) for _ in range(25)}
    # Alike in all but a few low bits, so that buckets of any start are crowded.
    fps |= {flipped(rng, 5, 3) & 0xFFFFFF for _ in range(20)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f), 1 + k % 3) for k, f in enumerate(fps)], "fp long, copies long")
    found = {r["c"]: r["comp"] for r in simhash.linked(df, tau, crowd).collect()}
    names = [signed(f) for f in fps]
    assert [found.get(n, n) for n in names] == least_of_linked(fps, names, tau)


def test_each_linking_pair_meets_and_keeps_the_budgets(spark):
    rng = random.Random(5)
    pairs = [(x := rng.getrandbits(64), flipped(rng, x, 4)) for _ in range(300)]
    for tau in (4,):
        masks = [simhash._chain(s, k, tau) & (1 << 64) - 1 for s in range(tau + 1) for k in range(1, tau + 2)]
        assert masks[tau] == (1 << 64) - 1
        for a, b in pairs:
            chains = [all(bin((a ^ b) & simhash._chain(s, k, tau)).count("1") <= simhash.budget(k, tau) for k in range(1, tau + 2)) for s in range(tau + 1)]
            assert any(chains)


def test_copies_add_no_pairs_and_crowded_buckets_stay_bounded(spark):
    """Fingerprints lie with at most `crowd` others in a bucket, unless their chain has all segments."""
    rng = random.Random(9)
    fps = sorted({flipped(rng, 1 << 63, 5) for _ in range(120)})
    own, _ = simhash.buckets(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 4, 5)
    sizes = own.groupBy("start", "length", "v").count().collect()
    assert max(r["count"] for r in sizes) <= 5 and len({r["length"] for r in sizes}) > 2
    assert own.count() == 5 * len(fps)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hash_is_the_published_one():
    # XXH64 of no bytes with seed 0: a fixed value.
    assert xxhash.xxh64_intdigest(b"", 0) == 0xEF46DB3751D8E999
    assert np.uint64(simhash.fingerprint("a b c d")) == np.uint64(xxhash.xxh64_intdigest(b"a b c d", 42))
