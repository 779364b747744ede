"""Operator 7, media columns: GIF.

The codec writes GIF89a files of 8-bit samples and reads any: it decodes LZW code streams of every
code size, applies local and global palettes, interlacing, the four disposal rules and
transparency, and gives timed frames. Each frame is drawn on the canvas and kept as a row of column
`frames`: number, start and delay in ms, disposal rule, and the colour histogram of the canvas as
shown, clear pixels left out. The columns on the whole file are sums over these. Frames are decoded and drawn
one at a time, so a task holds one canvas of a file and not all of them.

store() turns a text into a GIF: its UTF-8 bytes, padded with spaces to a positive multiple of 192,
are the samples of frames 192 wide and at most `rows` high. The encoder is LZW with growing codes of 9 to 12
bits and a clear code when the table is full. Frames take turns in their delays and disposal rules, and
spaces are the transparent colour: that changes what is shown, not the samples, so the payload
comes back whole while a frame's canvas follows from those before it.

Null or empty text: 192 spaces. Null keys: as any other; ties don't arise. Very long texts: more frames. Repeated rows: equal values. An empty table: an empty result. Columns
besides key and text are ignored. Rows never meet, so there is no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import pieces_of, read

WIDTH, ROWS, BINS, SPACE = 192, 64, 8, 32
#: What stored frames take turns in: hundredths of a second, and disposal rules.
DELAYS, DISPOSALS = (10, 4, 25), (1, 3, 2, 0)


@dataclass
class Frame:
    """One image of a file: its samples, where it stands, and the canvas once it is drawn."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray | None = None


def _code_sizes(low: int) -> np.ndarray:
    """Bits of each code after a clear code; later ones have 12. The decoder's table has (1 << low) + 1 + k entries as it reads code k > 0."""
    table = (1 << low) + 1 + np.maximum(np.arange(4096), 1)
    return np.clip(np.floor(np.log2(table)).astype(np.int64) + 1, low + 1, 12)


_SIZES = {low: _code_sizes(low) for low in range(1, 12)}


def lzw_codes(data: bytes, low: int = 8) -> list[int]:
    """The codes of samples below 1 << low: a clear code first and whenever the table is full, the end code last."""
    clear = 1 << low
    out, table, new = [clear], {}, clear + 2
    get, put = table.get, out.append
    w = data[0] if data else clear + 1
    for c in data[1:]:
        k = w << 8 | c
        x = get(k)
        if x is not None:
            w = x
            continue
        put(w)
        w = c
        if new < 4096:
            table[k] = new
            new += 1
        else:
            put(clear)
            table.clear()
            new = clear + 2
    return [*out, w, clear + 1] if data else [*out, w]


def pack_lzw(data: bytes, low: int = 8) -> bytes:
    """The code stream of samples, packed from the lowest bit on."""
    codes = np.array(lzw_codes(data, low), np.uint16)
    at = np.arange(len(codes))
    cleared = np.maximum.accumulate(np.where(codes == 1 << low, at, -1))
    size = _SIZES[low][np.minimum(at - np.append(-1, cleared[:-1]) - 1, 4095)]
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(bits[np.arange(12) < size[:, None]], bitorder="little").tobytes()


def _code_runs(data: bytes, low: int) -> Iterator[tuple[bool, list[int]]]:
    """(whether a new table starts here, some codes that follow each other), up to the end code or the end of data."""
    clear, size, bit, k = 1 << low, _SIZES[low], 0, 0
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    if data and (raw[0] | raw[1] << 8) & (2 * clear - 1) == clear:
        bit = low + 1
    while True:
        # A code's size follows from its place, so all codes up to the next clear code come at once.
        own = size[k:] if k < len(size) else np.full(4096, 12)
        at = bit + np.cumsum(own) - own
        at = at[: np.searchsorted(at + own, 8 * len(data), "right")]
        if not len(at):
            return
        own, byte = own[: len(at)], at >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7).astype(np.uint32) & ((1 << own) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        yield k == 0, (codes[: stop[0]] if len(stop) else codes).tolist()
        if len(stop) and codes[stop[0]] == clear + 1:
            return
        last = stop[0] if len(stop) else len(at) - 1
        bit, k = int(at[last] + own[last]), 0 if len(stop) else k + len(at)


def unpack_lzw(data: bytes, low: int, n: int) -> np.ndarray:
    """n samples of an LZW code stream with minimum code size low."""
    first, out, got = [bytes([k]) for k in range(min(256, 1 << low))] + [b""] * (max(0, (1 << low) - 256) + 2), [], 0
    for fresh, codes in _code_runs(data, low):
        if fresh:
            table, was = first.copy(), b""
            grow, size = table.append, len(table)
        begun = len(out)
        for code in codes:
            if code < size:
                word = table[code]
            elif code == size and was:
                word = was + was[:1]
            else:
                raise ValueError("LZW code out of range")
            out.append(word)
            if was and size < 4096:
                grow(was + word[:1])
                size += 1
            was = word
        got += sum(map(len, out[begun:]))
        if got >= n:
            return np.frombuffer(b"".join(out)[:n], np.uint8)
    raise ValueError("LZW stream ends early")


def write_gif(frames: list[np.ndarray], palette: np.ndarray, delays: tuple = (10,), disposals: tuple = (1,), transparent: int | None = None) -> bytes:
    """A GIF89a file of frames of samples (rows by columns), all of one width; delays in hundredths of a second and disposal rules are taken in turn."""
    height, width = max(f.shape[0] for f in frames), frames[0].shape[1]
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for k, f in enumerate(frames):
        flags = disposals[k % len(disposals)] << 2 | (transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", flags, delays[k % len(delays)], transparent or 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, f.shape[0], 0) + b"\x08")
        data = np.frombuffer(pack_lzw(f.tobytes()), np.uint8)
        whole = len(data) // 255
        blocks = np.full((whole, 256), 255, np.uint8)
        blocks[:, 1:] = data[: whole * 255].reshape(whole, 255)
        rest = data[whole * 255 :].tobytes()
        out.append(blocks.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0")
    return b"".join([*out, b"\x3b"])


def read_gif(data: bytes, draw: bool = True) -> list[Frame]:
    """Frames in order; with draw, each with its RGBA canvas as shown."""
    return list(frames_of(data, draw))


def frames_of(data: bytes, draw: bool = True) -> Iterator[Frame]:
    """As read_gif(), but a frame is decoded and drawn when it is asked for."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height = struct.unpack_from("<HH", data, 6)
    return _drawn(_decoded(data), width, height) if draw else _decoded(data)


def _decoded(data: bytes) -> Iterator[Frame]:
    flags, at, shared = data[10], 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    delay, disposal, clear = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        start = at
        while data[at]:
            at += data[at] + 1
        raw = np.frombuffer(data, np.uint8, at - start, start)
        if len(raw) and len(raw) % 256 == 0 and (raw[::256] == 255).all():
            return raw.reshape(-1, 256)[:, 1:].tobytes(), at + 1
        parts, k = [], start
        while data[k]:
            parts.append(data[k + 1 : k + 1 + data[k]])
            k += data[k] + 1
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind, (body, at) = data[at + 1], blocks(at + 2)
            if kind == 0xF9:
                delay, disposal = 10 * struct.unpack_from("<H", body, 1)[0], (body[0] >> 2) & 7
                clear = body[3] if body[0] & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            at, palette = at + 10, shared
            if own & 0x80:
                n = 2 << (own & 7)
                palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            low = data[at]
            body, at = blocks(at + 1)
            samples = unpack_lzw(body, low, w * h).reshape(h, w)
            if own & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                samples = samples[np.argsort(order)]
            yield Frame(left, top, samples, palette if palette is not None else np.zeros((256, 3), np.uint8), delay, disposal, clear)
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("unknown block")


def _draw(frames: list[Frame], width: int, height: int) -> None:
    for _ in _drawn(frames, width, height):
        pass


def _drawn(frames: Iterable[Frame], width: int, height: int) -> Iterator[Frame]:
    canvas = np.zeros((height, width), "<u4")  # red in the lowest byte, alpha in the highest
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = f.samples.shape
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        samples = f.samples[: area.shape[0], : area.shape[1]]
        colours = f.palette.astype("<u4") @ np.array([1, 1 << 8, 1 << 16], "<u4") + np.uint32(0xFF << 24)
        drawn = colours[np.minimum(samples, len(colours) - 1)]
        area[:] = drawn if f.transparent is None else np.where(samples != f.transparent, drawn, area)
        f.canvas = canvas.copy().view(np.uint8).reshape(height, width, 4)
        yield f
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of a canvas's opaque pixels by colour, bins a channel: rows are red, green, blue."""
    seen = canvas[canvas[:, :, 3] > 0]
    return np.stack([np.add.reduceat(np.bincount(seen[:, c], minlength=256), np.arange(bins) * 256 // bins) for c in range(3)])


#: A fixed palette: every index another colour, so samples show text as colour bands.
PALETTE = np.stack([np.arange(256), np.arange(256) * 7 % 256, np.arange(256)[::-1]], 1).astype(np.uint8)


def store(text: str | None, rows: int = ROWS) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    raw += b" " * (-len(raw) % WIDTH if raw else WIDTH)
    samples = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return write_gif([samples[k : k + rows] for k in range(0, len(samples), rows)], PALETTE, DELAYS, DISPOSALS, SPACE)


_FRAME = pa.struct([("number", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int64()))])
_NAMES = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "n_frames": pa.int32(), "duration_ms": pa.int64(), "histogram": pa.list_(pa.int64()), "frames": pa.list_(_FRAME)}
_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long, histogram array<bigint>, frames array<struct<number:int,start_ms:bigint,delay_ms:int,disposal:int,histogram:array<bigint>>>"


def described(media: bytes) -> tuple:
    """What a file says once it is decoded and drawn, in the order of _NAMES."""
    size, digest, tail, start, frames, total = 0, hashlib.sha256(), b"", 0, [], np.zeros((3, BINS), np.int64)
    for f in frames_of(media):
        part, h = f.samples.tobytes(), histogram(f.canvas)
        digest.update(part)
        size, tail, total = size + len(part), (tail + part[-16:])[-16:], total + h
        frames.append({"number": len(frames), "start_ms": start, "delay_ms": f.delay_ms, "disposal": f.disposal, "histogram": h.ravel().tolist()})
        start += f.delay_ms
    feature = ";".join(",".join(map(str, c)) for c in total)
    return (size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), start, total.ravel().tolist(), frames)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(_NAMES.values())]


def _size(text: str | None) -> int:
    return len((text or "").encode("utf-8", "surrogatepass"))


def gif_column(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary): a GIF for each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of([x or "" for x in texts]):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([_size(x) for x in texts[a:b]], pa.int64()), pa.array([store(x) for x in texts[a:b]], pa.binary())], [key, "n_bytes", "media"])

    d = documents.select(f"`{key}`", f"`{text}`")
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def frame_columns(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is read back of column media: payload figures, features, and its timed frames as drawn."""

    def run(batches):
        for batch in batches:
            rows = [described(m.as_py()) for m in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_columns(rows)], [key, "n_bytes", *_NAMES])

    kind = media.schema[key].dataType.simpleString()
    return media.select(f"`{key}`", "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, {_SCHEMA}")


def media_columns(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """frame_columns(gif_column()) in one pass of the texts through Python: each file is written and read back at once."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of([x or "" for x in texts]):
                rows = [described(store(x)) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([_size(x) for x in texts[a:b]], pa.int64()), *_columns(rows)], [key, "n_bytes", *_NAMES])

    d = documents.select(f"`{key}`", f"`{text}`")
    return d.mapInArrow(run, f"`{key}` {d.schema[0].dataType.simpleString()}, n_bytes long, {_SCHEMA}")


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"))
