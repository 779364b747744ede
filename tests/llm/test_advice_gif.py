"""op7 gives the timed frames of a file as they are drawn."""

import struct

import numpy as np

from gridloom.llm import gif_media


def _frame(delay_cs, disposal, clear, left, top, samples):
    out = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + struct.pack("<H", delay_cs) + bytes([clear or 0, 0])
    data = gif_media.pack_lzw(samples.tobytes())
    return out + b"\x2c" + struct.pack("<HHHHB", left, top, samples.shape[1], samples.shape[0], 0) + b"\x08" + bytes([len(data)]) + data + b"\0"


def test_frames(spark):
    pal = np.zeros((256, 3), np.uint8)
    pal[1], pal[2], pal[3] = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    one = lambda v, h=1, w=1: np.full((h, w), v, np.uint8)
    gif = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0xF7, 0, 0) + pal.tobytes()
    gif += _frame(5, 1, None, 0, 0, one(1, 2, 2)) + _frame(7, 3, None, 1, 1, one(2)) + _frame(0, 2, 3, 0, 0, np.array([[3, 2]], np.uint8)) + _frame(9, 0, 3, 0, 0, one(3, 2, 2)) + b"\x3b"
    r = gif_media.frame_columns(spark.createDataFrame([(1, 4, gif)], "doc_id long, n_bytes long, media binary")).first()
    assert [(f["number"], f["start_ms"], f["delay_ms"], f["disposal"]) for f in r["frames"]] == [(0, 0, 50, 1), (1, 50, 70, 3), (2, 120, 0, 2), (3, 120, 90, 0)]
    # Red and green pixels shown: all red; one green, put back afterwards; one green, cleared with the clear pixel beside it; what is left.
    shown = [(sum(f["histogram"][1:8]), sum(f["histogram"][9:16]), sum(f["histogram"][17:])) for f in r["frames"]]
    assert shown == [(4, 0, 0), (3, 1, 0), (3, 1, 0), (2, 0, 0)] and sum(r["frames"][3]["histogram"]) == 3 * 2
    assert (r["n_frames"], r["duration_ms"]) == (4, 210) and r["histogram"] == [sum(x) for x in zip(*(f["histogram"] for f in r["frames"]), strict=True)]
