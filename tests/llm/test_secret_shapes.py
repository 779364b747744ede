"""op4's scan against a plain version, and its forest on labelled findings of several shapes, whole shapes held out."""

import math
import random
import string

from gridloom.llm import secrets

KEYS = set(string.ascii_letters + string.digits + "_+/=.-")
NAMES = ("pass", "pwd", "token", "secret", "key", "auth", "credential")


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def named(before):
    """Whether a text ends in a name with a telling word in it, of which up to 40 characters may follow."""
    before = before.removesuffix("\n")  # a quote may stand on the next line
    low = before.lower()
    for n in NAMES:
        at = low.rfind(n)
        while at >= 0:
            rest = before[at + len(n) :]
            if len(rest) <= 40 and all(c.isascii() and (c.isalnum() or c in "_.-") for c in rest):
                return True
            at = low.rfind(n, 0, at + len(n) - 1)
    return False


def value_at(text, at):
    """A value: what lies in quotes on one line, else what has no white space, up to an & with another name; ends of sentences are cut."""
    if at >= len(text):
        return None
    if text[at] in "\"'":
        end = at + 1
        while end < len(text) and text[end] not in (text[at], "\n"):
            end += 1
        if end < len(text) and text[end] == text[at] and end > at + 1:
            return (at + 1, end) if end - at - 1 >= 6 else None
    end = at
    while end < len(text) and not text[end].isspace():
        if text[end] == "&":
            k = end + 1
            while k < len(text) and (text[k].isalnum() or text[k] == "_"):
                k += 1
            if k > end + 1 and k < len(text) and text[k] == "=" and text[end + 1].isascii() and (text[end + 1].isalpha() or text[end + 1] == "_"):
                break
        end += 1
    if end == at:
        return None
    while end > at and text[end - 1] in ".,;)\"'":
        end -= 1
    return (at, end) if end - at >= 6 else None


def plain_places(text):
    out, k = set(), 0
    while (k := text.find("-----BEGIN ", k)) >= 0:
        end = text.find("PRIVATE KEY-----", k + 11)
        if end >= 0 and all(c in string.ascii_uppercase + string.digits + " " for c in text[k + 11 : end]):
            out.add((k, end + 16))
        k += 1
    k = 0
    while k < len(text):
        if text[k] not in KEYS:
            k += 1
            continue
        end = k
        while end < len(text) and text[end] in KEYS:
            end += 1
        run = text[k:end]
        if len(run) >= 16 and (any(c in string.digits for c in run) or entropy(run) >= 3):
            a, b = k, end
            eq = max((i for i in range(k, end - 8) if text[i] == "="), default=-1)
            a = eq + 1 if eq >= 0 else a
            while b > a and text[b - 1] in "=./-":
                b -= 1
            if b - a >= 12:
                out.add((a, b))
        k = end
    done = k = 0
    while k < len(text):
        if text[k] in "=:":
            size = 2 if text[k : k + 2] == "=>" else 1
            if k >= done and named(text[max(0, k - 64) : k].rstrip().rstrip("\"'")):
                at = k + size
                while at < len(text) and text[at] in " \t":
                    at += 1
                if found := value_at(text, at):
                    out.add(found)
                    done = found[1]
            k += size
        else:
            k += 1
    low, k = text.lower(), 0
    while (k := low.find("bearer", k)) >= 0:
        at = k + 6
        while at < len(text) and text[at] in " \t":
            at += 1
        before = text[k - 1] if k else " "
        if at > k + 6 and not (before.isalnum() or before == "_") and (found := value_at(text, at)):
            out.add(found)
        k += 6
    return sorted(out)


def test_places_equal_a_plain_scan():
    rng = random.Random(4)
    parts = ["password", "api_key", "Token", "=", ":", "=>", " ", "\t", "\n", '"', "'", "&", "&x=", "bearer ", "Bearer\t", "abcDEF123", "hunter2!", "0123456789abcdef", "x", ".", ",", ";", "-----BEGIN RSA PRIVATE KEY-----", "PRIVATE KEY-----", "-----BEGIN ", "/usr/lib/python3/x.py", "====", "é", "aaaaaaaaaaaaaaaaaaaa", "qwertyuiopasdfghjkl"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert secrets.places(text) == plain_places(text), text
    assert secrets.places("word " * 200_000 + "key = hunter2!") == [(1_000_006, 1_000_014)]


def corpus(rng, n):
    """(text, start, shape, label) of n findings of each shape, amid prose."""
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    words = "report garden window market little summer people number between another company station morning problem history".split()
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    camel = lambda: "".join(w.capitalize() for w in rng.sample(words, 3))
    shapes = {
        "hex": (1, lambda: (rng.choice(("api_key = ", "secret: ", "token=")), pick("0123456789abcdef", 40))),
        "base64": (1, lambda: (rng.choice(("client_secret = ", "auth_token: ")), pick(b64, 43))),
        "alnum": (1, lambda: (rng.choice(("access_key=", "secret_token: ")), pick(alnum, rng.choice((24, 32))))),
        "dashed": (1, lambda: ("api_token = ", "-".join(pick(alnum, 8) for _ in range(3)))),
        "symbols": (1, lambda: (rng.choice(("password = ", "passwd: ")), pick(alnum + "!@#$%^*", 14))),
        "path": (0, lambda: ("key file: ", "/" + "/".join(rng.choice(words) for _ in range(4)) + rng.choice((".pem", ".json", "2.txt")))),
        "identifier": (0, lambda: ("token class: ", camel() + str(rng.randrange(10)))),
        "url": (0, lambda: ("auth page: ", f"https://{rng.choice(words)}.example/{rng.choice(words)}/{rng.choice(words)}")),
        "uuid": (0, lambda: ("key id: ", "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)))),
        "number": (0, lambda: ("token number: ", pick(string.digits, 18))),
        "slug": (0, lambda: ("secret garden: ", "-".join(rng.sample(words, 4)) + f"-{rng.randrange(100)}")),
    }
    out = []
    for shape, (label, make) in shapes.items():
        for _ in range(n):
            name, value = make()
            lead = prose(rng.randint(3, 12)) + rng.choice((" ", "\n")) + name
            out.append((lead + value + " " + prose(rng.randint(3, 12)), len(lead), shape, label))
    return out


def test_whole_shapes_held_out(spark):
    rows = [(k, *r) for k, r in enumerate(corpus(random.Random(44), 60))]
    docs = spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id long, text string")
    told, recall, alarms = {k: (s, shape, y) for k, _, s, shape, y in rows}, {}, {}
    for held in (("alnum", "path"), ("base64", "url"), ("dashed", "slug")):
        labelled = spark.createDataFrame([(k, s, y) for k, (s, shape, y) in told.items() if shape not in held], "doc_id long, start long, label int")
        hits = {(r["doc_id"], r["start"]): r["is_secret"] for r in secrets.findings(docs, labelled).collect()}
        for shape in held:
            own = [hits.get((k, s)) for k, (s, x, _) in told.items() if x == shape]
            share = sum(bool(x) for x in own) / len(own)
            (recall if any(y for _, x, y in told.values() if x == shape) else alarms)[shape] = share
    print("recall by held-out shape", recall, "false alarms", alarms)
    assert min(recall.values()) >= 0.85 and max(alarms.values()) <= 0.2


def test_very_long_texts_ties_and_clashing_columns(spark):
    key = "a1b2c3d4e5f60718293a"
    text = "plain words " * 100_000 + f"token = {key} end"
    df = spark.createDataFrame([(1, text, 3, 0.5), (1, text, 4, 0.6), (None, f"secret: {key}", 5, 0.7), (2, None, 6, 0.8)], "doc_id long, text string, start int, entropy double")
    got = sorted((r["doc_id"] or 0, r["start"]) for r in secrets.findings(df).collect())
    assert got == [(0, 8)] + [(1, 1_200_008)] * 2
