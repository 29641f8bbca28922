"""Request rows from DICOM files: little-endian data sets, first frame, palettes."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.sources.requests import SCHEMA

# Tags of the standard that a request is made from, by keyword.
SENSITIVE = {
    "AccessionNumber": 0x00080050, "InstitutionName": 0x00080080, "OperatorsName": 0x00081070, "PatientAge": 0x00101010, "PatientBirthDate": 0x00100030, "PatientID": 0x00100020,
    "PatientName": 0x00100010, "PatientSex": 0x00100040, "PerformingPhysicianName": 0x00081050, "PerformedProcedureStepID": 0x00400253, "ReferringPhysicianName": 0x00080090, "StudyDate": 0x00080020,
}
_UID, _SYNTAX, _SAMPLES, _PHOTO, _FRAMES, _ROWS, _COLS, _BITS = 0x00080018, 0x00020010, 0x00280002, 0x00280004, 0x00280008, 0x00280010, 0x00280011, 0x00280100
_DECIMAL = {"window_center": 0x00281050, "window_width": 0x00281051, "rescale_intercept": 0x00281052, "rescale_slope": 0x00281053}
_PALETTE = {"red": (0x00281101, 0x00281201), "green": (0x00281102, 0x00281202), "blue": (0x00281103, 0x00281203)}
_PIXELS = 0x7FE00010
RAW = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1")
_LONG = frozenset(b"OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())


def elements(data: bytes, at: int, explicit: bool, end: int | None = None) -> Iterator[tuple[int, bytes | list[bytes]]]:
    """(tag, value) of a little-endian data set; an encapsulated value is the list of its items."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        group, number = struct.unpack_from("<HH", data, at)
        tag, kind = group << 16 | number, data[at + 4 : at + 6]
        if explicit and group != 0xFFFE:
            wide = kind in _LONG
            size = struct.unpack_from("<I", data, at + 8)[0] if wide else struct.unpack_from("<H", data, at + 6)[0]
            at += 12 if wide else 8
        else:
            size = struct.unpack_from("<I", data, at + 4)[0]
            at += 8
        if size == 0xFFFFFFFF:
            items, at = _items(data, at, explicit, end)
            yield tag, items
        else:
            if at + size > end:
                raise ValueError("an element passes the end of the file")
            yield tag, data[at : at + size]
            at += size


def _items(data: bytes, at: int, explicit: bool, end: int) -> tuple[list[bytes], int]:
    """Items up to the delimiter, and the place after it; an item of open length is stepped through."""
    out = []
    while at + 8 <= end:
        tag, size = struct.unpack_from("<HHI", data, at)[1], struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if tag == 0xE0DD:
            return out, at
        if size != 0xFFFFFFFF:
            out.append(data[at : at + size])
            at += size
            continue
        start = at
        while struct.unpack_from("<HH", data, at) != (0xFFFE, 0xE00D):
            at = _after(data, at, explicit, end)
        out.append(data[start:at])
        at += 8
    raise ValueError("a sequence has no end")


def _after(data: bytes, at: int, explicit: bool, end: int) -> int:
    group, _ = struct.unpack_from("<HH", data, at)
    wide = explicit and data[at + 4 : at + 6] in _LONG
    size = struct.unpack_from("<I", data, at + (8 if wide else 4))[0] if wide or not explicit else struct.unpack_from("<H", data, at + 6)[0]
    at += 12 if wide else 8
    return _items(data, at, explicit, end)[1] if size == 0xFFFFFFFF else at + size


def unpack_palette(descriptor: bytes, values: bytes) -> list[int]:
    """Entries of one channel: bytes, or little-endian pairs of them, as the descriptor's third number says."""
    bits = struct.unpack_from("<3H", descriptor)[2]
    return list(values) if bits == 8 else list(struct.unpack(f"<{len(values) // 2}H", values[: len(values) // 2 * 2]))


def to_request(data: bytes) -> dict:
    """Columns of a request from a file: the first frame, the tags that have a value, and how to show the pixels."""
    at = 132 if data[128:132] == b"DICM" else 0
    head, body = {}, at
    while body + 8 <= len(data) and data[body : body + 2] == b"\x02\x00":
        tag, value = next(elements(data, body, True))
        head[tag] = value
        body = _after(data, body, True, len(data))
    syntax = _string(head.get(_SYNTAX)) or RAW[0]
    found = {tag: value for tag, value in elements(data, body, syntax != RAW[0])}
    number = lambda tag: struct.unpack("<H", found[tag][:2])[0] if tag in found else None
    frames = int(_string(found.get(_FRAMES)) or 1)
    pixels = found.get(_PIXELS, b"")
    if isinstance(pixels, list):  # the first item is a table of offsets
        starts = struct.unpack(f"<{len(pixels[0]) // 4}I", pixels[0][: len(pixels[0]) // 4 * 4]) if pixels else ()
        rest, size, first = pixels[1:], 0, []
        for item in rest:
            if frames > 1 and first and (len(starts) < 2 or size >= starts[1]):
                break
            first.append(item)
            size += len(item) + 8
        pixels = b"".join(first)
    else:
        pixels = pixels[: len(pixels) // frames]
    tags = {k: v for k, tag in SENSITIVE.items() if (v := _string(found.get(tag)))}
    photo = _string(found.get(_PHOTO))
    out = {
        "image": pixels, "content_type": "application/octet-stream", "sensitive_data_list": json.dumps(tags), "sop_instance_uid": _string(found.get(_UID)), "rows": number(_ROWS), "columns": number(_COLS),
        "bits_allocated": number(_BITS), "samples_per_pixel": number(_SAMPLES), "is_monochrome1": photo == "MONOCHROME1", "transfer_syntax_uid": syntax, "photometric_interpretation": photo,
    }
    if syntax in RAW:
        for name, tag in _DECIMAL.items():
            first = _string(found.get(tag)).split("\\")[0]
            out[name] = float(first) if first else None
    if photo == "PALETTE COLOR" and all(a in found and b in found for a, b in _PALETTE.values()):
        out["palette_color_lut"] = json.dumps({k: unpack_palette(found[a], found[b]) for k, (a, b) in _PALETTE.items()})
    return out


def _string(value) -> str:
    return value.decode("utf-8", "replace").strip("\0 ") if isinstance(value, bytes) else ""


def requests_from_dicom(files: DataFrame) -> DataFrame:
    """Request rows of (path, content), with ``request_id`` a hash of the path and ``error`` for files that can't be read."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, path, data in zip(pdf["request_id"], pdf["path"], pdf["content"]):
                try:
                    found, error = to_request(bytes(data)), None
                except (ValueError, KeyError, struct.error, StopIteration) as e:
                    found, error = {}, f"{type(e).__name__}: {e}"
                row = {**found, "request_id": rid, "filename": path.rsplit("/", 1)[-1]}
                rows.append(tuple(row.get(n) for n in names) + (error,))
            yield pd.DataFrame(rows, columns=[*names, "error"]).astype(object)

    keyed = files.select(F.xxhash64("path").alias("request_id"), "path", "content")
    return keyed.mapInPandas(run, SCHEMA + ", error string")
