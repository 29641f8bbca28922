"""AVI files of motion JPEG: container, intra frames, shots.

Frames are written as grey JPEG images of the lossless process (SOF3, predictor 1, 8 bits).
Their Huffman table gives difference category s a code of 9 - s bits, so that code and extra
bits make 9 bits for every difference: a valid prefix code, and one that is packed and
unpacked in whole arrays.  Frames of other writers are read too: lossless ones with any
table, and baseline DCT images (SOF0, grey or YCbCr), of which the first component is kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = HEIGHT = 24
FPS = 24
#: Code lengths of the categories 0 to 8.
_LENGTHS = [9, 8, 7, 6, 5, 4, 3, 2, 1]


def canonical_codes(lengths: list[int]) -> list[int]:
    """Canonical Huffman codes: shorter codes first, ties in the order of the symbols."""
    codes, code, last = [0] * len(lengths), 0, 0
    for size, symbol in sorted((size, i) for i, size in enumerate(lengths)):
        code <<= size - last
        codes[symbol], last = code, size
        code += 1
    return codes


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """9-bit word of each difference -255..255, and the difference of each word."""
    codes = canonical_codes(_LENGTHS)
    words, back = np.zeros(511, np.uint16), np.full(512, 0, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        words[d + 255] = (codes[s] << s) | extra
        back[words[d + 255]] = d
    return words, back


_WORDS, _BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht() -> bytes:
    order = [s for _, s in sorted((size, s) for s, size in enumerate(_LENGTHS))]
    return _segment(0xC4, bytes([0, *(_LENGTHS.count(k) for k in range(1, 17)), *order]))


_HEAD = {}


def jpeg_head(width: int, height: int) -> bytes:
    if (width, height) not in _HEAD:
        sof = _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        _HEAD[width, height] = b"\xff\xd8" + _dht() + sof + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    return _HEAD[width, height]


def _pack(frames: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes of each frame before byte stuffing, (n, 9 * samples / 8)."""
    n, h, w = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _WORDS[d.reshape(n, -1, 8) + 255]
    out = np.empty((n, h * w // 8, 9), np.uint8)
    out[:, :, 0] = c[:, :, 0] >> 1
    for k in range(1, 8):
        out[:, :, k] = ((c[:, :, k - 1] << (8 - k)) | (c[:, :, k] >> (k + 1))).astype(np.uint8)
    out[:, :, 8] = c[:, :, 7].astype(np.uint8)
    return out.reshape(n, -1)


def _unpack(data: np.ndarray, height: int, width: int) -> np.ndarray:
    b = data.reshape(len(data), -1, 9).astype(np.uint16)
    c = np.empty((*b.shape[:2], 8), np.uint16)
    for k in range(8):
        c[:, :, k] = ((b[:, :, k] << (k + 1)) | (b[:, :, k + 1] >> (7 - k))) & 511
    return _undo(_BACK[c].reshape(len(data), height, width))


def _undo(d: np.ndarray) -> np.ndarray:
    """Samples from predictor-1 differences."""
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


#: Frames handled at a time, so that work arrays stay small however long a text is.
BLOCK = 4096


def _movi(frames: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Chunks of frames, and the size of each frame's image."""
    n, h, w = frames.shape
    head = np.frombuffer(jpeg_head(w, h), np.uint8)
    body = _pack(frames)
    stuffed = body == 0xFF
    size = len(head) + body.shape[1] + stuffed.sum(1) + 2
    rows = np.empty((n, 8 + len(head) + body.shape[1] + 3), np.uint8)
    rows[:, :4] = np.frombuffer(b"00dc", np.uint8)
    rows[:, 4:8] = size.astype("<u4").view(np.uint8).reshape(n, 4)
    rows[:, 8 : 8 + len(head)] = head
    a, b = 8 + len(head), 8 + len(head) + body.shape[1]
    rows[:, a:b] = body
    rows[:, b:] = [0xFF, 0xD9, 0]
    times = np.ones(rows.shape, np.int8)
    times[:, a:b] += stuffed
    times[:, -1] = size & 1  # chunks start at even places
    flat = np.repeat(rows.ravel(), times.ravel())
    again = np.cumsum(times.ravel().astype(np.int64))[np.flatnonzero(times.ravel() == 2)] - 1
    flat[again] = 0
    return flat.tobytes(), size


def write_avi(frames: np.ndarray, fps: int = FPS) -> bytes:
    """An AVI file with an idx1 index; ``frames`` are (n, height, width) bytes, height * width a multiple of 8."""
    n, h, w = frames.shape
    blocks = [_movi(frames[k : k + BLOCK]) for k in range(0, n, BLOCK)]
    movi = b"".join(x for x, _ in blocks)
    size = np.concatenate([np.zeros(0, np.int64), *(x for _, x in blocks)])
    step = 8 + size + (size & 1)
    index = np.empty((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.cumsum(step) - step
    index[:, 3] = size
    most = int(size.max()) if n else 0
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
    chunk = lambda k, x: k + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    parts = b"AVI " + hdrl + chunk(b"LIST", b"movi" + movi) + chunk(b"idx1", index.tobytes())
    return chunk(b"RIFF", parts)


class BadMedia(ValueError):
    """The bytes are not an AVI file of motion JPEG that this reader knows."""


def _walk(data: bytes, at: int, end: int):
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise BadMedia(f"chunk {kind!r} passes the end")
        yield kind, at + 8, size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[list[tuple[int, int]], float]:
    """(start, size) of each video frame, and frames a second, by the idx1 index or else the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("no RIFF AVI header")
    micros, movi, index = 0, None, None
    for kind, at, size in _walk(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if kind == b"LIST" and data[at : at + 4] == b"hdrl":
            for k, a, _ in _walk(data, at + 4, at + size):
                if k == b"avih":
                    micros = struct.unpack_from("<I", data, a)[0]
        elif kind == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, size)
        elif kind == b"idx1":
            index = np.frombuffer(data, "<u4", size // 16 * 4, at).reshape(-1, 4)
    if movi is None:
        raise BadMedia("no movi list")
    video = [int.from_bytes(x, "little") for x in (b"00dc", b"00db")]
    if index is not None:
        rows = index[np.isin(index[:, 0], video)]
        base = movi[0]
        if len(rows) and data[base + int(rows[0, 2]) : base + int(rows[0, 2]) + 2] != b"00":
            base = 0  # some writers count from the start of the file
        frames = [(base + int(r[2]) + 8, int(r[3])) for r in rows]
    else:
        frames = [(a, size) for k, a, size in _walk(data, movi[0] + 4, movi[0] + movi[1]) if k in (b"00dc", b"00db")]
    if any(a + size > len(data) for a, size in frames):
        raise BadMedia("a frame passes the end")
    return frames, 1e6 / micros if micros else 0.0


# The Huffman tables that motion JPEG frames without tables of their own use,
# as counts of codes by length and symbols (ITU-T T.81, annex K.3).
_DC_COUNTS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
_AC_COUNTS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
_AC_SYMBOLS = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a",
)


def _rest(first: str) -> bytes:
    """The symbols listed, then all others of a run and a size up to 10 in order; they have codes of one length."""
    head = bytes.fromhex(first.replace(" ", ""))
    return head + bytes(sorted({r << 4 | s for r in range(16) for s in range(1, 11)} - set(head)))


def zigzag() -> np.ndarray:
    """Place in an 8 x 8 block of each coefficient in the order of the file."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


@lru_cache(64)
def _codes(counts: tuple[int, ...] | bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(code length, symbol) of every 16 bits that a code can begin."""
    table, k = [], 0
    for bits, count in enumerate(counts, 1):
        for s in symbols[k : k + count]:
            table += [(bits, s)] * (1 << (16 - bits))
        k += count
    return table + [(0, 0)] * ((1 << 16) - len(table))


class _Bits:
    """Entropy-coded bytes without stuffing, bit by bit."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.at += 8
        # Past the end come ones, as the last byte is filled.
        self.hold = self.hold << 64 | int.from_bytes(part + b"\xff" * (8 - len(part)), "big")
        self.n += 64

    def symbol(self, table) -> int:
        if self.n < 16:
            self._fill()
        bits, s = table[self.hold >> (self.n - 16) & 0xFFFF]
        if not bits or self.at > len(self.data) + 24:
            raise BadMedia("entropy-coded data do not fit the tables")
        self.n -= bits
        self.hold &= (1 << self.n) - 1
        return s

    def value(self, size: int) -> int:
        if not size:
            return 0
        if self.n < size:
            self._fill()
        self.n -= size
        v = self.hold >> self.n
        self.hold &= (1 << self.n) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


def _baseline(scan, parts, size, quant, tables, order, restart) -> np.ndarray:
    """The first component of a baseline scan."""
    height, width = size
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    cols, rows = -(-width // (8 * wide)), -(-height // (8 * high))
    if len(parts) == 1:  # one component alone is not interleaved
        wide = high = 1
        cols, rows = -(-width // 8), -(-height // 8)
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    keep = np.zeros((rows * parts[0][2], cols * parts[0][1], 64), np.int32)
    place = zigzag().tolist()
    pieces = iter(scan)
    bits = _Bits(next(pieces))
    last = dict.fromkeys(order, 0)
    for unit in range(rows * cols):
        if restart and unit and unit % restart == 0:
            bits, last = _Bits(next(pieces, b"")), dict.fromkeys(order, 0)
        for n, (name, h, v, _) in enumerate(parts):
            dc, ac = tables[order[name][0]], tables[order[name][1]]
            for k in range(h * v):
                last[name] += bits.value(bits.symbol(dc))
                block = keep[unit // cols * v + k // h, unit % cols * h + k % h] if n == 0 else None
                if block is not None:
                    block[0] = last[name]
                i = 1
                while i < 64:
                    s = bits.symbol(ac)
                    if not s & 15:
                        if s != 0xF0:
                            break
                        i += 16
                        continue
                    i += s >> 4
                    v_ = bits.value(s & 15)
                    if i > 63:
                        raise BadMedia("a block has too many coefficients")
                    if block is not None:
                        block[place[i]] = v_
                    i += 1
    step = np.zeros(64)
    step[zigzag()] = quant[parts[0][3]]
    wave = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) / 2
    wave[:, 0] /= np.sqrt(2)
    blocks = wave @ (keep * step).reshape(*keep.shape[:2], 8, 8) @ wave.T
    image = np.clip(np.round(blocks + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(keep.shape[0] * 8, -1)
    own_h, own_w = -(-height * parts[0][2] // high), -(-width * parts[0][1] // wide)
    return image[:own_h, :own_w]


def decode_jpeg(data: bytes) -> np.ndarray:
    """A JPEG image as (height, width) bytes: a lossless grey one (predictor 1) exactly, of a baseline one the first component."""
    if data[:2] != b"\xff\xd8":
        raise BadMedia("no JPEG image")
    tables = {(0, k): _codes(c, bytes(range(12))) for k, c in enumerate(_DC_COUNTS)} | {(1, k): _codes(c, _rest(x)) for k, (c, x) in enumerate(zip(_AC_COUNTS, _AC_SYMBOLS))}
    at, shape, process, quant, parts, order, restart = 2, None, None, {}, [], {}, 0
    while True:
        if at + 4 > len(data):
            raise BadMedia("no scan")
        if data[at] != 0xFF or data[at + 1] == 0xFF:
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(float)
                body = body[1 + 64 * wide :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            process, shape = marker, struct.unpack_from(">HH", body, 1)
            if body[0] != 8 or not all(shape):
                raise BadMedia("samples other than 8 bits, or no samples")
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise BadMedia(f"JPEG process {marker:02x} is not supported")
        elif marker == 0xDA:
            order = {body[k]: ((0, body[k + 1] >> 4), (1, body[k + 1] & 15)) for k in range(1, 1 + 2 * body[0], 2)}
            predictor = body[1 + 2 * body[0]]
            break
    if shape is None or [p[0] for p in parts] != list(order):
        raise BadMedia("no frame header, or components in scans of their own")
    end = data.rfind(b"\xff\xd9", at)
    scan = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data[at : end if end >= 0 else len(data)])]
    if process != 0xC3:
        return _baseline(scan, parts, shape, quant, tables, order, restart)
    if predictor != 1 or len(parts) != 1 or restart:
        raise BadMedia("lossless images are read in grey, with predictor 1 and without restarts")
    bits, table = _Bits(scan[0]), tables[order[parts[0][0]][0]]
    diffs = [bits.value(bits.symbol(table)) for _ in range(shape[0] * shape[1])]
    return _undo(np.array(diffs, np.int32).reshape(1, *shape))[0]


def read_avi(data: bytes) -> tuple[np.ndarray, float]:
    """All frames of a file, (n, height, width), and frames a second."""
    frames, fps = parse_avi(data)
    if not frames:
        return np.zeros((0, 0, 0), np.uint8), fps
    raw = np.frombuffer(data, np.uint8)
    return np.concatenate([_read(data, raw, frames[k : k + BLOCK]) for k in range(0, len(frames), BLOCK)]), fps


def _read(data: bytes, raw: np.ndarray, frames: list[tuple[int, int]]) -> np.ndarray:
    head = jpeg_head(WIDTH, HEIGHT)
    a = np.array([x for x, _ in frames], np.int64)
    size = np.array([x for _, x in frames], np.int64)
    k, want = len(head), WIDTH * HEIGHT * 9 // 8
    own = bool((size >= k + want).all()) and bool((raw[a[:, None] + np.arange(k)] == np.frombuffer(head, np.uint8)).all())
    if not own:
        return np.stack([decode_jpeg(data[x : x + s]) for x, s in frames])
    length = size - k - 2
    place = np.repeat(a + k - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    coded = raw[place]
    stuffing = np.zeros(len(coded), bool)
    stuffing[1:] = (coded[:-1] == 0xFF) & (coded[1:] == 0)
    coded = coded[~stuffing]
    if len(coded) != want * len(frames):
        raise BadMedia("a frame has too few or too many samples")
    return _unpack(coded.reshape(len(frames), want), HEIGHT, WIDTH)


def shots(frames: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first, last) frame of each shot.

    A cut lies before frame i where the grey histograms (16 bins) of i - 1 and i differ by
    more than the mean of the differences of the ``window`` frames before plus ``factor``
    deviations, and by ``least`` at least.
    """
    n = len(frames)
    if not n:
        return []
    level = (frames.reshape(n, -1) >> 4).astype(np.int64)
    hist = np.bincount((level + 16 * np.arange(n)[:, None]).ravel(), minlength=16 * n).reshape(n, 16) / level.shape[1]
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    c1, c2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (diff, diff * diff))
    at = np.arange(len(diff))
    lo = np.maximum(at - window, 0)
    count = np.maximum(at - lo, 1)
    mean = (c1[at] - c1[lo]) / count
    dev = np.sqrt(np.maximum((c2[at] - c2[lo]) / count - mean * mean, 0))
    cuts = np.flatnonzero((diff > mean + factor * dev + 1e-9) & (diff >= least)) + 1
    first = np.concatenate([[0], cuts])
    return list(zip(first.tolist(), (np.append(cuts, n) - 1).tolist()))


def text_frames(data: bytes) -> np.ndarray:
    """UTF-8 bytes, filled with 255 to a positive multiple of a frame, as frames."""
    unit = WIDTH * HEIGHT
    fill = max(unit, -(-len(data) // unit) * unit) - len(data)
    return np.frombuffer(data + b"\xff" * fill, np.uint8).reshape(-1, HEIGHT, WIDTH)


def encode_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the AVI file of each text as a binary column, in place of one of that name; null counts as empty.

    A long text is written in blocks of frames; repeated rows are all returned; an empty table gives no rows.
    """

    @F.pandas_udf("binary")
    def encode(texts):
        return texts.map(lambda t: write_avi(text_frames((t or "").encode("utf-8", "surrogatepass"))))

    return docs.withColumn(media, encode(F.col(text)))


def clips(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Timed clip rows of AVI files: key, clip, first, last, start_s, end_s, error.

    A null or unreadable file gives one row with the error and null clip fields; a file
    without frames gives no clip and no row; a repeated row gives its clips again; of equal
    differences all or none are cuts; a long file is read in blocks of frames; other columns
    are ignored; an empty table gives no rows.
    """

    def cut_up(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    frames, fps = read_avi(data or b"")
                    for i, (a, b) in enumerate(shots(frames)):
                        rows.append((k, i, a, b, a / (fps or FPS), (b + 1) / (fps or FPS), None))
                except (BadMedia, struct.error, IndexError, ValueError) as e:
                    rows.append((k, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)

    kind = dict(files.dtypes)[key]
    fields = pa.schema([(key, pa.string() if kind == "string" else pa.int64()), ("clip", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("error", pa.string())])
    schema = f"`{key}` {kind if kind == 'string' else 'long'}, clip int, first int, last int, start_s double, end_s double, error string"
    return files.select(F.col(key) if kind == "string" else F.col(key).cast("long"), media).mapInArrow(cut_up, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """Stores each whole text as an AVI file, reads it back and describes its shots.

    One row per row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256 and
    tail_crc32 (of the samples read back), media_bytes, media_sha256, feature.  Null and
    empty texts are one frame of 255; equal texts give equal values; rows that repeat a
    doc_id are all returned; very long texts are handled in blocks of frames; other columns are
    ignored; an empty table gives no rows.  ``feature`` is
    frames|shots|start-end of each shot in frames.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def store(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = write_avi(text_frames(data))
                frames, _ = read_avi(media)
                payload = frames.tobytes()
                cuts = shots(frames)
                feature = f"{len(frames)}|{len(cuts)}|" + ",".join(f"{a}-{b}" for a, b in cuts)
                rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(store, schema)
