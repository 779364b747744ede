"""op7's codec against plain ones: a string-table encoder and decoder written here, and Java's image reader and writer."""

import struct

import numpy as np
import pytest

from gridloom.llm import gif_media as g


def plain_encode(samples: bytes, low: int, clear_at: int = 4096) -> bytes:
    """LZW by string tables; the table is cleared once it has clear_at entries, or never if that is 0."""
    bits, size = [], low + 1
    put = lambda code: bits.extend((code >> k) & 1 for k in range(size))
    fresh = lambda: {bytes([k]): k for k in range(1 << low)}
    put(1 << low)
    table, entries, w = fresh(), (1 << low) + 2, b""
    for c in samples:
        x = w + bytes([c])
        if x in table:
            w = x
            continue
        put(table[w])
        if entries < 4096:
            table[x] = entries
            entries += 1
            if entries - 1 == 1 << size and size < 12:
                size += 1
        if clear_at and entries >= clear_at:
            put(1 << low)
            table, entries, size = fresh(), (1 << low) + 2, low + 1
        w = bytes([c])
    put(table[w])
    put((1 << low) + 1)
    return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


def plain_decode(data: bytes, low: int) -> bytes:
    value, at, out, size, table, was = int.from_bytes(data, "little"), 0, [], low + 1, {}, None
    while True:
        code = value >> at & ((1 << size) - 1)
        at += size
        if code == 1 << low:
            table, size, was = {k: bytes([k]) for k in range(1 << low)}, low + 1, None
            new = (1 << low) + 2
            continue
        if code == (1 << low) + 1:
            return b"".join(out)
        word = table[code] if code in table else was + was[:1]
        out.append(word)
        if was is not None and new < 4096:
            table[new] = was + word[:1]
            new += 1
            if new == 1 << size and size < 12:
                size += 1
        was = word


def cases():
    rnd = np.random.default_rng(6)
    for low in (2, 3, 5, 8):
        for n in (1, 2, 500, 30_000):
            yield low, rnd.integers(0, 1 << low, n).astype(np.uint8).tobytes()
            yield low, np.repeat(rnd.integers(0, 1 << low, n // 40 + 1), 40).astype(np.uint8).tobytes()
    yield 8, ("the quick brown fox jumps over the lazy dog " * 3000).encode()
    yield 8, b"\0" * 100_000


def test_codes_both_ways():
    for low, raw in cases():
        assert plain_decode(g.pack_lzw(raw, low), low) == raw
        assert g.unpack_lzw(g.pack_lzw(raw, low), low, len(raw)).tobytes() == raw
        for clear_at in (4096, 300, 0):  # 0: a full table of 12-bit codes that is never cleared
            assert g.unpack_lzw(plain_encode(raw, low, clear_at), low, len(raw)).tobytes() == raw
    with pytest.raises(ValueError, match="ends early"):
        g.unpack_lzw(g.pack_lzw(b"abc" * 99), 8, 500)
    with pytest.raises(ValueError, match="out of range"):
        g.unpack_lzw(bytes([0xFF] * 9), 8, 9)


def gif(frames, w, h, palette):
    """frames: (left, top, samples, local palette or None, interlaced, disposal, transparent, delay)."""
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF1, 0, 0) + palette.tobytes()
    for left, top, px, own, laced, how, clear, delay in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", how << 2 | (clear is not None), delay, clear or 0, 0)
        order = [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, px.shape[0], s)] if laced else range(px.shape[0])
        out += b"\x2c" + struct.pack("<HHHHB", left, top, px.shape[1], px.shape[0], (0x81 if own is not None else 0) | (0x40 if laced else 0)) + (own.tobytes() if own is not None else b"") + b"\x02"
        data = plain_encode(b"".join(px[y].tobytes() for y in order), 2)
        for k in range(0, len(data), 255):
            out += bytes([len(data[k : k + 255])]) + data[k : k + 255]
        out += b"\0"
    return out + b"\x3b"


def test_rules_against_a_plain_canvas():
    rnd = np.random.default_rng(8)
    for _ in range(30):
        w, h = rnd.integers(3, 24, 2)
        shared = rnd.integers(0, 256, (4, 3)).astype(np.uint8)
        frames = []
        for _ in range(rnd.integers(1, 6)):
            fw, fh = rnd.integers(1, w + 1), rnd.integers(1, h + 1)
            own = rnd.integers(0, 256, (4, 3)).astype(np.uint8) if rnd.random() < 0.5 else None
            frames.append((int(rnd.integers(0, w - fw + 1)), int(rnd.integers(0, h - fh + 1)), rnd.integers(0, 4, (fh, fw)).astype(np.uint8), own, rnd.random() < 0.5, int(rnd.integers(0, 4)), int(rnd.integers(0, 4)) if rnd.random() < 0.6 else None, int(rnd.integers(0, 50))))
        canvas = {}
        for f, (left, top, px, own, _, how, clear, delay) in zip(g.read_gif(gif(frames, int(w), int(h), shared)), frames, strict=True):
            kept, pal = dict(canvas), own if own is not None else shared
            for y in range(px.shape[0]):
                for x in range(px.shape[1]):
                    if px[y, x] != clear:
                        canvas[top + y, left + x] = (*pal[px[y, x]].tolist(), 255)
            assert f.samples.tolist() == px.tolist() and (f.delay_ms, f.disposal) == (10 * delay, how)
            assert all(tuple(f.canvas[y, x].tolist()) == canvas.get((y, x), (0, 0, 0, 0)) for y in range(h) for x in range(w))
            hist = g.histogram(f.canvas)
            assert hist.sum() == 3 * len(canvas) and all(hist[c][b] == sum(v[c] * 8 // 256 == b for v in canvas.values()) for c in range(3) for b in range(8))
            if how == 2:
                canvas = {k: v for k, v in canvas.items() if not (top <= k[0] < top + px.shape[0] and left <= k[1] < left + px.shape[1])}
            elif how == 3:
                canvas = kept


def test_java_reads_what_is_stored_and_is_read(spark):
    jvm = spark._jvm
    text = "Grüße, some text of a few hundred bytes; " * 700
    media = g.store(text, rows=1000)
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(media))
    (frame,) = g.read_gif(media)
    assert (image.getWidth(), image.getHeight()) == (192, frame.samples.shape[0])
    raster = image.getRaster()
    row = lambda y: [raster.getSample(x, y, 0) for x in range(192)]
    for y in (0, 1, 77, frame.samples.shape[0] - 1):
        assert row(y) == frame.samples[y].tolist()
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "gif", out)
    again = g.read_gif(bytes(out.toByteArray()))[0]
    assert (again.palette[again.samples] == frame.palette[frame.samples])[frame.samples != g.SPACE].all()


def test_query_goes_by_files(spark):
    rows = [(1, "abc " * 20_000), (2, "é"), (3, None), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = g.media_columns(docs).collect(), g.frame_columns(g.gif_column(docs)).collect()
    key = lambda r: (r["doc_id"] or 0, r["n_bytes"])
    assert sorted(one, key=key) == sorted(two, key=key)
    long = next(r for r in one if r["doc_id"] == 1)
    assert long["n_frames"] == 7 and {f["disposal"] for f in long["frames"]} == {0, 1, 2, 3} and long["media_bytes"] < long["payload_bytes"]
    assert [f["start_ms"] for f in long["frames"]] == [0, 100, 140, 390, 490, 530, 780]
    # Spaces are clear: a quarter of the first frame isn't counted.
    assert sum(long["frames"][0]["histogram"]) == 3 * 192 * 64 * 3 // 4
