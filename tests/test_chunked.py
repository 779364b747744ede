"""Run-length streams cut anywhere give the bytes of the whole."""

import random

import numpy as np

from gridloom.functions import chunked, codec


def bodies(rng):
    yield b""
    yield bytes(range(256)) * 3
    yield b"\0" * 1000
    for _ in range(25):
        yield b"".join(bytes([rng.randrange(4)]) * rng.choice((1, 1, 2, 3, 5, 130, 400)) for _ in range(rng.randrange(30)))


def cut(rng, data, empties=True):
    out = []
    while data:
        n = rng.choice((0, 1, 1, 2, 3, 7, 50, 300) if empties else (1, 2, 9))
        out.append(data[:n])
        data = data[n:]
    return out or [b""]


def test_effects_compose_and_decode():
    rng = random.Random(1)
    for body in bodies(rng):
        packed = codec.rle8(body)
        for _ in range(4):
            parts = cut(rng, packed)
            state, out, total = 0, b"", np.arange(chunked.SKIPS)
            for p in parts:
                out += chunked.decoded(p, state)
                state = int(chunked._after(state, chunked.effect(p)))
                total = chunked.composed(total, chunked.effect(p))
            assert out == body and state == 0 and total[0] == 0
        a, b, c = (chunked.effect(x) for x in (packed[:5], packed[5:6], packed[6:]))
        assert (chunked.composed(chunked.composed(a, b), c) == chunked.composed(a, chunked.composed(b, c))).all()
        assert (chunked.composed(chunked.composed(a, b), c)[0] == chunked.effect(packed)[0]).all()


def test_chunks_of_a_table(spark):
    rng = random.Random(2)
    streams = dict(enumerate(bodies(rng))) | {None: b"xyz" * 200}
    rows = [(k, seq, part) for k, body in streams.items() for seq, part in enumerate(cut(rng, codec.rle8(body)))]
    rows.append((99, 0, codec.rle8(b"q" * 300)[:-1]))
    rng.shuffle(rows)
    df = spark.createDataFrame([r if len(r[2]) else (r[0], r[1], None) for r in rows], "stream long, seq long, data binary")
    got = chunked.decode_chunks(df, span=4)
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["seq"]):
        assert r["start"] == len(found.setdefault(r["stream"], b""))
        found[r["stream"]] += bytes(r["body"])
    assert found.pop(99) == b"q" * 256 and found == streams
    expected = spark.createDataFrame([(k, len(b) + (k == 3)) for k, b in streams.items()] + [(99, 300), (777, 0)], "stream long, expected long")
    said = {r["stream"]: r["issue"] for r in chunked.stream_issue(got, expected).collect()}
    assert said == dict.fromkeys([*streams, 777]) | {99: "UnexpectedEnd", 3: "OutputLengthMismatch"}
    assert chunked.decode_chunks(df.limit(0)).collect() == []
