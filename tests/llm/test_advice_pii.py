"""op9 counts an entity against all terms of its documents, and marks each of their occurrences."""

import math
import time
from collections import Counter

from gridloom.llm import pii


def test_terms_far_from_the_entity(spark):
    plain = "some plain words that stand in all of the documents here and tell nothing of anyone " * 3
    rows = [(k, plain + f"own{chr(97 + k % 26)}{chr(97 + k // 26)}x") for k in range(300)]
    rows[7] = (7, "Zaphod writes. " + plain + "ask z@b.example today " + "x" * 400 + " " + plain + "by zaphod again")
    rows[8] = (8, plain + "z@b.example " + "<td>" * 100 + " one two three four five six seven eight nine ten ZAPHOD")
    rows[9] = (None, plain + "z@b.example " + plain + " zaphod@b.example Zaphod")
    rows[10] = (10, plain + "zaphod alone")
    rows += [(400 + k, "w@b.example copied secretly") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    # By brute force: all pairs of an entity and a term in a document.
    terms, entities, pairs = Counter(), Counter(), Counter()
    holds = []
    for i, t in rows:
        base = pii.base_spans(t)
        es = {k + ":" + t[a:b] for k, a, b in base}
        places = [(m.group().lower(), *m.span()) for m in pii._TERM.finditer(t)]
        free = [p for p in places if not any(a < p[2] and p[1] < b for _, a, b in base)]
        terms.update({p[0] for p in places})
        entities.update(es)
        pairs.update({(e, p[0]) for e in es for p in free})
        holds.append((i, es, free))
    share = {x: n / terms[x[1]] for x, n in pairs.items() if n >= 2 and math.log2(n * len(rows) / (terms[x[1]] * entities[x[0]])) >= 6 and n / terms[x[1]] >= 0.5}
    for i, es, free in holds:
        want = [(s, e, max(share[x, w] for x in es if (x, w) in share)) for w, s, e in free if any((x, w) in share for x in es)]
        assert [tuple(t) for t in got[i]["terms"]] == want
    say = lambda i: [rows[i][1][t["start"] : t["end"]] for t in got[rows[i][0]]["terms"]]
    assert say(7) == ["Zaphod", "zaphod"] and say(8) == ["ZAPHOD"] and say(9) == ["Zaphod"] and say(10) == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(pii.spans(docs)).collect()}
    assert "zaphod" not in clean[8].lower() and clean[10].endswith("zaphod alone")


def test_patterns_as_given():
    """The kinds by the plain patterns, on texts made of their characters."""
    import random
    import re

    rnd = random.Random(3)
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0

    for alphabet in ("0123456789....", "0123 456-789", "+12 (3).4-5", "a1.@-%é ", "012.45@a+ -"):
        for _ in range(1500):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
            want = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
            want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
            want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m.group())) <= 15]
            assert pii.base_spans(t) == want, t


def test_long_texts_take_seconds():
    import time

    start = time.time()
    for t in ("7" * 1_000_000, "1.2.3." * 200_000, "a@b.example " * 80_000, "a" * 1_000_000 + "@", "漢字" * 500_000, "+1 (" * 250_000, "x@" + "y" * 1_000_000, "1 2-" * 250_000):
        pii._terms(t, pii.base_spans(t))
    assert time.time() - start < 40


def test_pairs_follow_the_text(spark, monkeypatch):
    """Two documents that list thousands of addresses and thousands of names make one pair of classes, not millions."""
    n = 20_000
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(5))
    listed = " ".join(f"u{k}@b.example {name(k)}" for k in range(n))
    rows = [(k, f"plain words only number{name(900_000 + k)}") for k in range(300)] + [(1000, listed), (1001, listed + " end"), (1002, f"{name(3)} alone")]
    kept, made = pii.stored, {}

    def watched(df, what):
        made[what] = kept(df, what)
        return made[what]

    monkeypatch.setattr(pii, "stored", watched)
    start = time.time()
    out = {r["doc_id"]: [(t["start"], t["share"]) for t in r["terms"]] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 1000").collect()}
    assert time.time() - start < 60
    assert len(out[1000]) == len(out[1001]) == n and out[1002] == []
    # The term that stands alone elsewhere too reveals less, and is a class of its own.
    assert sorted({round(x, 6) for _, x in out[1000]}) == [round(2 / 3, 6), 1.0]
    assert made["class-pairs"].count() == 4


def test_repeated_rows_count_each(spark):
    rows = [(k, f"plain words only {chr(97 + k % 26)}{chr(97 + k // 26)}x") for k in range(200)] + [(500, "a@b.example Zaphod")] * 3 + [(None, "c@d.example Marvin")] * 2
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).where("size(base) > 0").collect()
    assert sorted((r["doc_id"] or 0, len(r["terms"])) for r in got) == [(0, 1)] * 2 + [(500, 1)] * 3
