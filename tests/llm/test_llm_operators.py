"""The numbered operators against brute force, on odd rows: nulls, empty and long texts, ties, clashing columns; repeats are here and in the files beside."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import gif_media, jaccard_join, language, line_dedup, mixing, pieces, pii, piece_codec, secrets, topk_search, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{k}" for k in range(60))
TEXTS = [
    (1, BASE, "en", "a"), (2, BASE + " x", "en", "a"), (3, BASE.upper(), "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, "one two", "fr", "b"), (7, "ONE  two", "fr", None),
    (8, "Shared line of text here\nown eight", "en", "a"), (9, "own nine\n  shared LINE of text here ", "en", "a"), (10, "y " * 5000, "en", "a"), (11, BASE.replace("w7 ", "q ").replace("w30", "r"), "en", "a"),
    (12, "mail a.b@x.example.com now +1 (415) 555-2671 and 10.0.0.300 1.2.3.4 and 4111111111111111 then token = \"ab12cd34ef56ab78cd90\"", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1) for r in TEXTS], "doc_id long, text string, lang string, source string, n_chars long, tag string, n long")


def empty(docs):
    return docs.where("false")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components([r[:2] for r in TEXTS])
    assert jaccard_join.jaccard_components(empty(docs)).count() == 0


def test_line_dedup(docs):
    out = {r["doc_id"]: r for r in line_dedup.apply_runs(docs, line_dedup.dropped_runs(docs)).collect()}
    assert out[9]["text"] == "own nine" and out[8]["text"] == TEXTS[7][1] and out[9]["_n_dropped"] == 1 and out[3]["text"] == ""
    assert out[4]["text"] is None and out[5]["_n_lines"] == 1 and out[1]["tag"] == "x"
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_mixing(docs):
    m = mixing.mix(docs).collect()
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in TEXTS}
    assert len(m) == len(TEXTS) and all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in m)
    assert abs(sum({r["source"]: r["target"] for r in m}.values()) - 1.5 * sum(sizes.values())) < 1e-6
    by = defaultdict(list)
    for r in m:
        by[r["source"]].append(r)
    assert all(abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 4 * mixing.BLOCK for rs in by.values())
    assert sorted(map(str, m)) == sorted(map(str, mixing.mix(docs).collect())) and mixing.mix(empty(docs)).count() == 0
    assert sum(len(WORD.findall(r["text"])) for r in mixing.mixed(docs).collect()) == sum(r["taken"] for r in m)


def test_sainte_lague(spark):
    votes = {"a": 53, "b": 24, "c": 23}
    u = spark.createDataFrame([(0, k, v, 10) for k, v in votes.items()], "g int, k string, v long, s long")
    got = {r["k"]: r["quota"] for r in mixing.apportion(u, ["g"], "v", "s", "k").collect()}
    won = dict.fromkeys(votes, 0)
    for _ in range(10):
        best = max(sorted(votes), key=lambda k: votes[k] / (2 * won[k] + 1))
        won[best] += 1
    assert got == won


def test_viterbi_against_brute_force():
    v = pieces.Vocabulary()
    ids = {p: i for i, p in enumerate(v.bytes_of) if p and not v.is_byte[i]}

    def best(b):
        top = {0: (0.0, [])}
        for j in range(1, len(b) + 1):
            found = [(top[i][0] + v.scores[ids[b[i:j]]]) for i in range(j) if i in top and b[i:j] in ids]
            if found:
                top[j] = (max(found), [])
        return top.get(len(b), (None,))[0]

    for w in ("the", "international", "xylophones", "été"):
        flat, _, _ = piece_codec.best_cuts([(pieces.MARK + w).encode()], v)
        assert abs(sum(v.scores[flat]) - best(" ".encode() + w.encode())) < 1e-6
    texts = ["", " ", "a  b", "漢字 ☃\n\t", "é" * 500, " lead", "trail "]
    flat, per = piece_codec.encoded_batch(texts, v)
    assert piece_codec.decoded_batch(flat, per, piece_codec.piece_bytes(v)) == texts


def test_encode_decode(docs):
    back = {r["doc_id"]: r for r in piece_codec.decode(piece_codec.encode(docs)).collect()}
    assert all(back[r[0]]["decoded"] == r[1] for r in TEXTS) and back[4]["ids"] is None and list(back[5]["ids"]) == []


def test_topk(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rnd.normal(size=20)]) for k in range(300)] + [(400, None), (450, [float("nan")] * 20), (301, [0.5]), (302, [0.5])]
    got = defaultdict(list)
    for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_bytes=64 * 160, pilot=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = {k: [int(np.floor(256 * float(np.float32(x)))) for x in v] for k, v in rows if v and not np.isnan(v).any()}
    for q in (k for k in ints if k % 50 == 0):
        want = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q))[:5]
        assert got[q] == [(c, -s) for s, c in want]
    assert set(got) == {k for k in ints if k % 50 == 0}


def test_gif_rules():
    # A real LZW stream (2-bit samples, growing codes): the 10 by 10 sample image of the format's public descriptions.
    data = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01")
    flat = gif_media.unpack_lzw(data, 2, 100)
    assert flat[:10].tolist() == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2] and len(flat) == 100
    pal = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [9, 9, 9]] * 64, np.uint8)
    f = [gif_media.Frame(0, 0, np.full((2, 2), 1, np.uint8), pal, 0, 2, None), gif_media.Frame(1, 1, np.array([[2]], np.uint8), pal, 0, 3, None), gif_media.Frame(0, 0, np.full((2, 2), 3, np.uint8), pal, 0, 0, 3)]
    gif_media._draw(f, 2, 2)
    assert f[0].canvas[0, 0].tolist() == [255, 0, 0, 255] and f[1].canvas[0, 0].tolist() == [0, 0, 0, 0] and f[1].canvas[1, 1].tolist() == [0, 255, 0, 255]
    assert f[2].canvas.max() == 0


def test_gif_payload(docs):
    for r in gif_media.frame_columns(gif_media.gif_column(docs)).collect():
        raw = (dict((t[0], t[1]) for t in TEXTS)[r["doc_id"]] or "").encode()
        pad = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
    long = "z" * (192 * 10_000)
    frames = gif_media.read_gif(gif_media.store(long), draw=False)
    assert b"".join(f.samples.tobytes() for f in frames) == long.encode() and len(frames) == 157


def test_language(spark):
    rows = [(k, "the and of in that with " * 5 if k % 2 else "der die und das mit ist " * 5, "en" if k % 2 else "de") for k in range(80)] + [(100, None, "en"), (101, "123 !!", "de"), (102, "the" * 200, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(d.select("doc_id", "text"), language.fit(d)).collect()}
    assert all(got[k][0] == rows[k][2] for k in range(80)) and got[100] == ("und", 0.0) and got[101] == ("und", 0.0) and 0 < got[102][1] <= 1
    v = pieces.Vocabulary()
    p = np.full((len(v.scores), 1), 1e-3)
    ids = {x for i, x in enumerate(v.bytes_of) if x and not v.is_byte[i]}
    way = [1.0] + [0.0] * 4
    for j in range(1, 5):
        for i in range(j):
            part = b" the"[i:j]
            way[j] += way[i] * ((1e-3 if part in ids else 0) + (language.OTHER if j - i == 1 else 0))
    assert abs(language.word_logs([(pieces.MARK + "the").encode()], v, p)[0, 0] - np.log(way[4])) < 1e-9


def test_pii(docs):
    found = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    text = TEXTS[11][1]
    assert [(b["kind"], text[b["start"] : b["end"]]) for b in found[12]["base"]] == [("email", "a.b@x.example.com"), ("ip", "1.2.3.4"), ("card", "4111111111111111"), ("phone", "+1 (415) 555-2671")]
    assert not found[4]["base"] and not found[10]["base"]
    for t in ("a@b.c@d.e", "@@x.y", "é@x.y", "a@b", "x.@a-b.c.d.", "a@@b.c"):
        assert list(pii._emails(t)) == [m.span() for m in pii._EMAIL.finditer(t)]
    assert pii.sanitised(pii.spans(docs)).where("doc_id = 12").first()["text"].startswith("mail <email> now <phone>")


def test_toxicity(spark):
    rows = [(k, ("vile awful words " if k % 3 == 0 else "plain kind words ") * (1 + k % 4), int(k % 3 == 0)) for k in range(120)] + [(500, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.predict(d, toxicity.fit(d, d.select("doc_id", "toxic"))).collect()}
    assert all(got[k]["toxic"] == (k % 3 == 0) for k in range(120)) and not got[500]["toxic"]
    assert toxicity.predict(d, toxicity.fit(d, d.select("doc_id", "toxic").where("toxic = 0"))).where("toxic").count() == 0


def test_secrets(docs):
    rows = secrets.findings(docs).collect()
    assert {(r["doc_id"], TEXTS[r["doc_id"] - 1][1][r["start"] : r["end"]]): r["is_secret"] for r in rows}[12, "ab12cd34ef56ab78cd90"] is True
    assert secrets.findings(empty(docs)).count() == 0


def test_ordinal_fit_is_the_likelihoods_maximum():
    rnd = np.random.default_rng(2)
    x = [np.unique(rnd.integers(0, 6, rnd.integers(0, 5))) for _ in range(200)]
    y = np.array([min(2, int((r < 2).sum()) if rnd.random() < 0.8 else int(rnd.integers(0, 3))) for r in x])
    w, t = toxicity.fit_ordinal(x, y, 6, 3, rounds=3000)

    def value(w, t):
        total = 0.0
        for r, k in zip(x, y, strict=True):
            z = sum(w[f] for f in r) / np.sqrt(max(len(r), 1))
            up = [1.0, *(1 / (1 + np.exp(t - z))), 0.0]
            total += np.log(up[k] - up[k + 1])
        return total / len(x) - toxicity.DECAY / 2 * (w**2).sum()

    at = value(w, t)
    for k in range(6):
        for step in (-0.05, 0.05):
            assert value(w + step * (np.arange(6) == k), t) < at
    assert all(value(w, t + np.array(d)) < at for d in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)))


def test_severity_is_the_expected_grade(spark):
    model = ({"ab": 2.0, "abcd*": 1.0, "abcd*2": -0.5}, np.array([0.3, 1.1]))
    rows = [(1, "ab x"), (2, "abcde abcdf"), (3, "AB abcde, abcde"), (4, ""), (5, None), (5, None), (None, "ab")]
    got = toxicity.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    zs = {1: 2.0, 2: 0.5 / 2**0.5, 3: 2.5 / 3**0.5, 4: 0.0, 5: 0.0, None: 2.0}
    assert len(got) == 7
    for r in got:
        p = 1 / (1 + np.exp(model[1] - zs[r["doc_id"]]))
        assert abs(r["severity"] - p.sum()) < 1e-8 and abs(r["p_toxic"] - p[0]) < 1e-8 and r["grade"] == (p >= 0.5).sum()
    assert toxicity.predict(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_samples_keep_their_size_at_any_share(spark):
    from gridloom.llm.common import sample_of

    rows = spark.range(3_000_000).selectExpr("if(id % 3 = 0, 7L, id) AS k", "id % 5 AS v")
    assert 20 < sample_of(rows, 60, ["k"], ["v"]).count() < 120
    # One drawn of a million: the hash is met in all its bits.
    assert sum(sample_of(spark.range(2_000_000).selectExpr(f"id * 7 + {s} AS k"), 1, ["k"], []).count() for s in range(6)) > 0
    assert sample_of(rows.where("k < 0"), 60, ["k"], ["v"]).count() == 0


def test_secret_features_against_plain_counts():
    words = frozenset({"hello", "world"})
    text = "see version src/ab12CDhello-world99 then sha"
    s, e = text.index("ab12"), text.index(" then")
    got = dict(zip(secrets.NAMES, secrets.described(text, s, e, words), strict=True))
    v = text[s:e]
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in v]
    pairs = list(zip(kind, kind[1:], strict=False))
    want = {
        "length": len(v), "digits": kind.count("d") / len(v), "upper": kind.count("u") / len(v), "lower": kind.count("l") / len(v), "other": kind.count("o") / len(v), "distinct": len(set(v)) / len(v),
        "digit_to_letter": sum(p in (("d", "u"), ("d", "l")) for p in pairs) / len(v), "letter_to_digit": sum(p in (("u", "d"), ("l", "d")) for p in pairs) / len(v),
        "case_changes": sum(p in (("u", "l"), ("l", "u")) for p in pairs) / len(v), "same_class": sum(a == b for a, b in pairs) / len(v), "coverage": 10 / len(v), "after_path": 1.0, "slashes": 0, "dots": 0, "hex": 0.0,
        "near_version": 1.0, "near_sha": 1.0, "near_token": 0.0, "entropy": -sum(v.count(c) / len(v) * np.log2(v.count(c) / len(v)) for c in set(v)),
    }
    assert {k: round(got[k], 9) for k in want} == {k: round(float(x), 9) for k, x in want.items()}
    # The name that labels a value isn't among the words beside it.
    for t in ('then token = "ab12cd34"', "api_key: ab12cd34", "Authorization: Bearer ab12cd34", '"secret": "ab12cd34"'):
        before, _ = secrets.beside(t, t.index("ab12"), len(t))
        assert not any(w in before for w in ("token", "key", "bearer", "secret")), before


def test_secrets_held_out(spark):
    rnd = np.random.default_rng(4)
    made = lambda n, of: "".join(rnd.choice(list(of), n))
    rows = [(k, f'plain words here then token = "{made(40, "0123456789abcdef")}" and so on') if k % 2 else (k, f"some paid with {made(16, '0123456789')} or onthestreetsofthecity{made(4, 'aeiou')} there") for k in range(240)]
    found = secrets.stored(secrets.candidates(spark.createDataFrame([*rows, rows[1], (None, rows[3][1])], "doc_id long, text string")), "t")
    out = secrets.scored(found, learn=secrets.F.col("doc_id") < 160).where("doc_id >= 160 and weak is not null").collect()
    hit = [(r["weak"], r["p_secret"] >= 0.5) for r in out]
    assert len(hit) > 60 and hit.count((1, True)) >= 0.9 * sum(w for w, _ in hit) and hit.count((0, True)) <= 0.1 * len(hit)


def test_long_words_as_short_ones(monkeypatch):
    v = pieces.Vocabulary()
    rnd = np.random.default_rng(1)
    ws = ["".join(rnd.choice(list("etaoinshrdlu"), n)) for n in (3, 60, 95, 240)] + ["漢字中文日本" * 9, "é☃a" * 20]
    raw = [(pieces.MARK + w).encode() for w in ws]
    p = rnd.random((len(v.scores), 2)) / len(v.scores)

    def ids():
        flat, start, n = piece_codec.best_cuts(raw, v)
        return [flat[a : a + k].tolist() for a, k in zip(start, n, strict=True)]

    monkeypatch.setattr(piece_codec, "LONG", 0)
    monkeypatch.setattr(language, "LONG", 0)
    one, log_one = ids(), language.word_logs(raw[:3], v, p)
    monkeypatch.setattr(piece_codec, "LONG", 10**6)
    monkeypatch.setattr(language, "LONG", 10**6)
    assert one == ids() and np.allclose(log_one, language.word_logs(raw[:3], v, p), rtol=1e-12)


def test_texts_without_spaces_take_seconds():
    import time

    v, start = pieces.Vocabulary(), time.time()
    for text in ("漢字中文日本語の国人" * 30_000, "qwertzuiopasdfghjklyx" * 45_000):
        flat, per = piece_codec.encoded_batch([text], v)
        assert piece_codec.decoded_batch(flat, per, piece_codec.piece_bytes(v)) == [text]
    assert time.time() - start < 40


def test_scores_depend_on_their_own_text_only():
    v = pieces.Vocabulary()
    p = np.random.default_rng(3).random((len(v.scores), 3))
    p /= p.sum(0)
    text = "the cat and the dog went over der the hills"
    alone = language.predicted([text], v, ["a", "b", "c"], p)
    other = language.predicted(["x" * 5000 + " lorem ipsum dolor", None, text, ""], v, ["a", "b", "c"], p)
    assert (other[0][2], other[1][2]) == (alone[0][0], alone[1][0]) and other[0][1] == other[0][3] == "und"


@pytest.mark.parametrize("name", ["encode", "predict_language", "spans", "gif"])
def test_empty_tables_and_clashing_columns(spark, docs, name):
    none, odd = docs.where("false"), docs.withColumnsRenamed({"tag": "score", "n": "lang_pred"})
    if name == "encode":
        assert piece_codec.decode(piece_codec.encode(none)).count() == 0
    elif name == "predict_language":
        model = language.fit(docs)
        assert language.predict(none, model).count() == 0 and language.predict(none, language.fit(none)).count() == 0
        got = language.predict(odd, model)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"] and dict(got.dtypes)["score"] == "double" and got.count() == len(TEXTS)
    elif name == "spans":
        assert pii.spans(none).count() == 0
        twice = pii.spans(docs.union(docs).select("text", "doc_id", *odd.columns[2:3])).where("doc_id = 12").collect()
        assert len(twice) == 2 and twice[0]["base"] == twice[1]["base"] and len(twice[0]["base"]) == 4
    elif name == "gif":
        assert gif_media.frame_columns(gif_media.gif_column(none)).count() == 0
        assert len({r["media_sha256"] for r in gif_media.frame_columns(gif_media.gif_column(docs.union(docs))).collect()}) == len({t[1] or "" for t in TEXTS})
