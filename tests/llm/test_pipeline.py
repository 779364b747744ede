"""run() against brute force in plain Python, all stages, with null and repeated ids; and what each stage returns on the small tables."""

import hashlib
import os
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

WORD, SPACE = re.compile(r"[^\x20\x09-\x0D]+"), " \t\n\x0b\x0c\r"
WEIGHTS, SHARE, REPEAT, BLOCK, SHARD_WORDS = (5, 2, 1), Fraction(3, 2), 2, 8, 1 << 18


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def with_language(rows):
    return [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]


def without_lines(rows):
    key = lambda x: low(x.strip(SPACE))
    docs = defaultdict(set)
    for i, t, _ in rows:
        for x in t.split("\n") if i is not None else ():
            docs[key(x)].add(i)
    gone = lambda x, i: i is not None and len(key(x)) >= 10 and len(docs[key(x)]) > 1 and min(docs[key(x)]) < i
    return [(i, "\n".join(x for x in t.split("\n") if not gone(x, i)), s) for i, t, s in rows]


def one_of_each(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (WORD.findall(low(t)) for _, t, _ in rows)]
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and of[a] != of[b]:
                p, q = sorted((of[a], of[b]))
                of = [p if x == q else x for x in of]
    ids = defaultdict(list)
    for (i, _, _), c, s in zip(rows, of, sets, strict=True):
        if i is not None and s:
            ids[c].append(i)
    return [r for r, c, s in zip(rows, of, sets, strict=True) if not s or r[0] == (min(ids[c]) if ids[c] else None)]


def seats(votes, n):
    """Sainte-Lague, seat by seat; ties to the first."""
    won = dict.fromkeys(votes, 0)
    for _ in range(n if any(votes.values()) else 0):
        won[max(votes, key=lambda k: Fraction(votes[k]) / (2 * won[k] + 1))] += 1
    return won


def bucket(*parts):
    return int(hashlib.md5(":".join(("mix", *map(str, parts))).encode()).hexdigest()[:12], 16)


def mixed(rows):
    size = [len(WORD.findall(t)) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(sources)}
    left, target, open_ = SHARE * sum(total.values()), {}, list(sources)
    while open_:  # fill all by weight; who is over its cap is full, and the rest is dealt again
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= REPEAT * total[s]]
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = Fraction(REPEAT * total[s])
            left -= target[s]
            open_.remove(s)
    blocks_of = seats({s: target[s] for s in sources}, int(sum(target.values()) / BLOCK + Fraction(1, 2)))
    out = []
    for no, s in enumerate(sources):
        n_shards, shards = -(-total[s] // SHARD_WORDS) + 1, defaultdict(list)
        for r, n in zip(rows, size, strict=True):
            if r[2] == s:
                ident = r[0] if r[0] is not None else "text " + hashlib.md5(r[1].encode()).hexdigest()
                shards[bucket(ident) % n_shards].append((hashlib.md5(f"mix:{ident}".encode()).hexdigest(), n, r))
        won = seats({k: sum(n for _, n, _ in shards[k]) for k in sorted(shards)}, blocks_of[s])
        for k, docs in shards.items():
            docs.sort(key=lambda d: (d[0], d[1]))
            words = [(d, w) for d, (_, n, _) in enumerate(docs) for w in range(n)]
            n = -(-len(words) // BLOCK)
            if not n:
                continue
            passes, extra = divmod(min(won[k], REPEAT * n), n)
            start = bucket(no, k) % n
            some = {b % n for b in range(start, start + extra)}
            part = defaultdict(list)
            for at, (d, w) in enumerate(words):
                if at // BLOCK in some:
                    part[d].append(w)
            for d, (_, m, (i, t, _)) in enumerate(docs):
                out += [(i, t)] * (passes if m else 0)
                if part[d]:
                    own = [x.group() for x in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)]
                    out.append((i, t if len(part[d]) == m else "".join(own[w] for w in part[d])))
    return out


def pieces(text, v):
    """Viterbi over all cuts of the whole text, places ascending; ties to the first."""
    if not text:
        return []
    known = {p: i for i, p in enumerate(v.bytes_of) if p and not v.is_byte[i]}
    raw, longest = (" " + text).encode(), max(map(len, known))
    best = [(0.0, 0, -1)] + [(float("-inf"), 0, -1)] * len(raw)
    for i in range(len(raw)):
        if raw[i] & 0xC0 == 0x80:
            continue
        wide = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        for j in range(i + 1, min(len(raw), i + longest) + 1):
            p = known.get(raw[i:j], -1)
            if (p >= 0 or j - i == wide) and best[i][0] + (v.scores[p] if p >= 0 else v.unknown) > best[j][0]:
                best[j] = (best[i][0] + (v.scores[p] if p >= 0 else v.unknown), i, p)
    out, j = [], len(raw)
    while j:
        _, i, p = best[j]
        out = ([p] if p >= 0 else [int(v.byte_ids[b]) for b in raw[i:j]]) + out
        j = i
    return out


def rows_of(seed):
    rnd = random.Random(seed)
    vocabulary = [a + b for a in ("the", "and", "wind", "light", "road", "house", "blue") for b in ("", "s", "ing", "er", "ly")]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rnd.randrange(1, 90)) + rnd.choice(["", "\na line that many hold", "\n  A LINE that many hold \nend", " ☃ 漢字"]), rnd.choice(["web", "books", "news", "code", None])) for k in range(70)]
    for k in (3, 8, 15, 21):
        w = rows[k][1].split(" ")
        rows += [(100 + k, rows[k][1], "web"), (200 + k, " ".join([*w[:-1], "other"]), "news"), (None, rows[k][1].upper(), "code")]
    rows += [rows[5]] * 3 + [(None, text(40), "web"), (None, text(40), None), (300, None, "web"), (301, "", "web"), (302, "12 34 !!", "books"), (5, text(30), "books"), (303, text(900), "news")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_run_against_brute_force(spark, tmp_path, seed):
    import corpus_pipeline as p
    from gridloom.llm.pieces import Vocabulary

    rows = rows_of(seed)
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    v = Vocabulary()
    got = [(r["doc_id"], r["n_ids"], list(r["ids"])) for r in p.run(spark, str(tmp_path)).collect()]
    kept = one_of_each(without_lines(with_language(rows)))
    assert 0 < len(kept) < len(rows)
    want = [(i, len(ids), ids) for i, t in mixed(kept) for ids in [pieces(t, v)]]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = docs.columns
    kept = docs
    for k, (_, stage) in enumerate(p.STAGES):
        before, kept = kept, stage(spark, kept, "/root/testdata/sf0.001")
        if k + 1 < len(p.STAGES):
            assert kept.columns == names
            kept = kept.cache()
        assert {r[0] for r in kept.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert kept.where("n_ids > 0").count() > 0
