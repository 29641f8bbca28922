"""Motion JPEG of other writers, clips, and the two ways to read lossless frames."""

import struct

import numpy as np
import pytest

from inkveil.llm import avi


def book(counts, symbols):
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            out[s] = f"{code:0{bits}b}"
            code += 1
        k += n
        code <<= 1
    return out


def amplitude(v):
    n = abs(v).bit_length()
    return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""


def baseline(planes, sampling, restart=0, tables=False):
    """A baseline JPEG image of planes that fill whole units, by the definition, with quantiser 1."""
    dc = [book(c, bytes(range(12))) for c in avi._DC_COUNTS]
    ac = [book(c, avi._rest(x)) for c, x in zip(avi._AC_COUNTS, avi._AC_SYMBOLS)]
    wave = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) / 2 * (np.sqrt(0.5) if u == 0 else 1) for x in range(8)] for u in range(8)])
    zig = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    h, v = sampling[0]
    rows, cols = planes[0].shape[0] // (8 * v), planes[0].shape[1] // (8 * h)
    scan, bits, last = b"", "", [0] * len(planes)

    def flush():
        filled = bits + "1" * (-len(bits) % 8)
        return bytes(int(filled[k : k + 8], 2) for k in range(0, len(filled), 8)).replace(b"\xff", b"\xff\x00")

    for unit in range(rows * cols):
        if restart and unit and unit % restart == 0:
            scan += flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, last = "", [0] * len(planes)
        for c, (plane, (ch, cv)) in enumerate(zip(planes, sampling)):
            for k in range(ch * cv):
                y, x = 8 * (unit // cols * cv + k // ch), 8 * (unit % cols * ch + k % ch)
                z = np.round(wave @ (plane[y : y + 8, x : x + 8].astype(float) - 128) @ wave.T).astype(int)
                t = min(c, 1)
                size, extra = amplitude(int(z[0, 0]) - last[c])
                last[c] = int(z[0, 0])
                bits += dc[t][size] + extra
                run = 0
                for a, b in zig[1:]:
                    if not z[a, b]:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + ac[t][0xF0], run - 16
                    size, extra = amplitude(int(z[a, b]))
                    bits, run = bits + ac[t][run << 4 | size] + extra, 0
                if run:
                    bits += ac[t][0]
    scan += flush()
    segment = lambda m, x: struct.pack(">BBH", 0xFF, m, len(x) + 2) + x
    n = len(planes)
    out = b"\xff\xd8" + segment(0xE0, b"AVI1" + bytes(10)) + segment(0xDB, bytes([0] + [1] * 64))
    if tables:
        out += segment(0xC4, b"".join(bytes([k << 4 | t, *c, *s]) for t in (0, 1) for k, c, s in ((0, avi._DC_COUNTS[t], range(12)), (1, avi._AC_COUNTS[t], avi._rest(avi._AC_SYMBOLS[t])))))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    out += segment(0xC0, struct.pack(">BHHB", 8, *planes[0].shape, n) + b"".join(bytes([k + 1, ch << 4 | cv, 0]) for k, (ch, cv) in enumerate(sampling)))
    return out + segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, min(k, 1) * 0x11]) for k in range(n)) + bytes([0, 63, 0])) + scan + b"\xff\xd9"


def film(images, fps=10):
    """An AVI file without an index."""
    chunk = lambda k, x: k + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 1_000_000 // fps, *[0] * 13)))
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", x) for x in images)))


@pytest.mark.parametrize("restart, tables", [(0, False), (3, True), (1, False)])
def test_baseline_images(restart, tables):
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (16, 24), dtype=np.uint8)
    assert np.abs(avi.decode_jpeg(baseline([grey], [(1, 1)], restart, tables)).astype(int) - grey).max() <= 2
    luma, blue, red = rng.integers(0, 256, (32, 48), dtype=np.uint8), *rng.integers(0, 256, (2, 16, 24), dtype=np.uint8)
    got = avi.decode_jpeg(baseline([luma, blue, red], [(2, 2), (1, 1), (1, 1)], restart, tables))
    assert got.shape == luma.shape and np.abs(got.astype(int) - luma).max() <= 2


def test_both_readers_agree_on_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()
    for r in docs:
        frames = avi.text_frames((r.text or "").encode()[: 576 * 20])
        media = avi.write_avi(frames)
        assert (avi.read_avi(media)[0] == frames).all()
        places, _ = avi.parse_avi(media)
        assert all((avi.decode_jpeg(media[a : a + n]) == f).all() for (a, n), f in zip(places, frames))


def test_blocks_of_frames(monkeypatch):
    frames = np.random.default_rng(2).integers(0, 256, (23, 24, 24), dtype=np.uint8)
    whole = avi.write_avi(frames)
    monkeypatch.setattr(avi, "BLOCK", 5)
    assert avi.write_avi(frames) == whole and (avi.read_avi(whole)[0] == frames).all()


def test_clips(spark):
    dark, light = (baseline([np.full((16, 16), v, np.uint8)], [(1, 1)]) for v in (20, 220))
    good = film([dark] * 5 + [light] * 10 + [dark] * 5)
    still = film([dark] * 3)
    rows = [(1, good, 9), (1, good, 9), (2, still, 9), (3, None, 9), (4, b"RIFF", 9), (None, still, 9), (5, film([]), 9), (6, film([b"\xff\xd8junk"]), 9)]
    df = spark.createDataFrame(rows, "doc_id long, media binary, clip int")
    got = avi.clips(df).collect()
    one = [(r.clip, r.first, r.last, r.start_s, r.end_s) for r in got if r.doc_id == 1]
    assert sorted(one) == sorted([(0, 0, 4, 0.0, 0.5), (1, 5, 14, 0.5, 1.5), (2, 15, 19, 1.5, 2.0)] * 2)
    assert [(r.clip, r.last) for r in got if r.doc_id == 2] == [(0, 2)] == [(r.clip, r.last) for r in got if r.doc_id is None]
    assert {r.doc_id for r in got if r.error} == {3, 4, 6} and not [r for r in got if r.doc_id == 5]
    assert not avi.clips(df.limit(0)).collect()
