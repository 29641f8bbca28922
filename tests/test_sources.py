import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions import enhance
from inkveil.functions.image import decode
from inkveil.functions.text import register
from inkveil.plans import api, backends
from inkveil.sources import dicom, golden, requests
from inkveil.streaming import stream


def element(tag, kind, value, explicit=True):
    value += (b"\0" if kind in (b"UI", b"OB") else b" ") * (len(value) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    return head + kind + (struct.pack("<HI", 0, len(value)) if kind in dicom._LONG else struct.pack("<H", len(value))) + value


def dataset(syntax, pixels, explicit=True, photo=b"MONOCHROME2", frames=b"1", more=b""):
    short = lambda tag, v: element(tag, b"US", struct.pack("<H", v), explicit)
    body = element(0x00080018, b"UI", b"1.2.3", explicit) + element(0x00080050, b"SH", b"", explicit)
    # A sequence of open length, with an item of open length in it.
    inner = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(0x00080100, b"SH", b"code", explicit) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    body += struct.pack("<HH", 0x0008, 0x1140) + (b"SQ" + struct.pack("<HI", 0, 0xFFFFFFFF) if explicit else struct.pack("<I", 0xFFFFFFFF)) + inner + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    body += element(0x00100010, b"PN", b"Doe^John", explicit) + element(0x00100020, b"LO", b"77", explicit) + short(0x00280002, 1) + element(0x00280004, b"CS", photo, explicit)
    body += element(0x00280008, b"IS", frames, explicit) + short(0x00280010, 2) + short(0x00280011, 2) + short(0x00280100, 8) + element(0x00281050, b"DS", b"40\\50", explicit) + element(0x00281051, b"DS", b"400", explicit)
    meta = element(0x00020010, b"UI", syntax.encode())
    return bytes(128) + b"DICM" + element(0x00020000, b"UL", struct.pack("<I", len(meta))) + meta + body + more + pixels


@pytest.mark.parametrize("explicit", [True, False])
def test_dicom_request(explicit):
    syntax = dicom.RAW[1 if explicit else 0]
    got = dicom.to_request(dataset(syntax, element(0x7FE00010, b"OW", bytes(range(8)), explicit), explicit, frames=b"2"))
    assert got["image"] == bytes(range(4)) and json.loads(got["sensitive_data_list"]) == {"PatientID": "77", "PatientName": "Doe^John"}
    assert (got["rows"], got["columns"], got["bits_allocated"], got["window_center"], got["window_width"], got["sop_instance_uid"]) == (2, 2, 8, 40.0, 400.0, "1.2.3")


def test_encapsulated_frames_and_palettes():
    item = lambda x: struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x
    pixels = struct.pack("<HH", 0x7FE0, 0x0010) + b"OB" + struct.pack("<HI", 0, 0xFFFFFFFF) + item(struct.pack("<2I", 0, 12)) + item(b"one!") + item(b"two!") + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    got = dicom.to_request(dataset("1.2.840.10008.1.2.4.50", pixels, frames=b"2"))
    assert got["image"] == b"one!" and "window_center" not in got
    table = lambda lo, v: element(lo, b"OW", v)
    more = b"".join(element(0x00281100 + k, b"US", struct.pack("<3H", 2, 0, 16 if k == 1 else 8)) for k in (1, 2, 3)) + table(0x00281201, struct.pack("<2H", 0, 65535)) + table(0x00281202, b"\1\2") + table(0x00281203, b"\3\4")
    got = dicom.to_request(dataset(dicom.RAW[1], element(0x7FE00010, b"OW", bytes(4)), photo=b"PALETTE COLOR", more=more))
    assert json.loads(got["palette_color_lut"]) == {"red": [0, 65535], "green": [1, 2], "blue": [3, 4]}


def test_dicom_folder(spark, tmp_path):
    good = dataset(dicom.RAW[1], element(0x7FE00010, b"OW", bytes([0, 90, 180, 255])))
    for name, data in (("a.dcm", good), ("sub/b", good), ("sub/.hidden.dcm", good), ("c.txt", b"no"), ("bad.DCM", good[:150] + b"\xff" * 40)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = requests.scan_dicom(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["a.dcm", "bad.DCM", "b"]
    assert requests.scan_dicom(spark, str(tmp_path), "sub").count() == 1
    rows = {r.filename: r for r in dicom.requests_from_dicom(files).collect()}
    assert rows["bad.DCM"].error and rows["a.dcm"].error is None and rows["b"].rows == 2 and rows["a.dcm"].image == bytes([0, 90, 180, 255])


def test_requests_round_trip(spark, tmp_path):
    row = {"request_id": 7, "image": b"abc", "content_type": "image/raw", "sensitive_data_list": "{}", "rows": 1}
    spark.createDataFrame([row], requests.SCHEMA).write.parquet(f"{tmp_path}/r")
    got = requests.read_requests(spark, f"{tmp_path}/r").first()
    assert (got.request_id, bytes(got.image), got.rows, got.columns) == (7, b"abc", 1, None)


def test_golden_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sop_instance_uid": "1", "rectangles": ["1 2 3 4", "0 0 9 9"]}))
    (tmp_path / "b.json").write_text("no json")
    rows = golden.read_golden(spark, str(tmp_path))
    assert {r.name: r.rectangles for r in rows.collect()} == {"a.json": ["1 2 3 4", "0 0 9 9"], "b.json": None}
    assert sorted(tuple(r) for r in golden.golden_rectangles(rows).collect()) == [("1", 0, 1, 2, 4, 6), ("1", 1, 0, 0, 9, 9)]
    tags = spark.createDataFrame([("1", ["x"])], golden.TAGS)
    golden.write_golden(tags, f"{tmp_path}/out")
    golden.write_golden(tags.withColumn("detected_tags", F.array(F.lit("y"))), f"{tmp_path}/out")
    assert golden.read_golden(spark, f"{tmp_path}/out", golden.TAGS).first().detected_tags == ["x"]
    golden.write_golden(tags.withColumn("detected_tags", F.array(F.lit("y"))), f"{tmp_path}/out", overwrite=True)
    assert golden.read_golden(spark, f"{tmp_path}/out", golden.TAGS).first().detected_tags == ["y"]


def test_masked_images(spark, tmp_path):
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    images = spark.createDataFrame([(1, (4, 4, 3, bytearray(image.tobytes()))), (2, (4, 4, 3, bytearray(image.tobytes())))], "request_id long, pixels struct<height:int,width:int,n_channels:int,data:binary>")
    masks = spark.createDataFrame([(1, [("*", "0a0b0c", ["1 1 1 1"])])], "request_id long, masks array<struct<stationName:string,color:string,rectangles:array<string>>>")
    got = {r.request_id: bytes(r.png) for r in golden.masked_images(images, masks).collect()}

    def pixels(data):
        assert data[:8] == b"\x89PNG\r\n\x1a\n"
        size = struct.unpack(">I", data[33:37])[0]
        rows = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(4, 13)
        return rows[:, 1:].reshape(4, 4, 3)[:, :, ::-1]

    assert (pixels(got[2]) == image).all()
    assert (pixels(got[1])[1:3, 1:3] == [0x0C, 0x0B, 0x0A]).all() and (pixels(got[1])[0] == image[0]).all()
    golden.write_stages(str(tmp_path), masks=masks)
    assert spark.read.parquet(f"{tmp_path}/masks").count() == 1


def test_back_ends(spark):
    # Workers can't import a test module, so the class is a local one.
    class Reader:
        def detect(self, image):
            return ["x"], [[0, 0, image.shape[1], image.shape[0]]]

    made = []
    backends.register("one", lambda: made.append(1) or Reader())
    assert backends.get("one") is backends.get("one") and made == [1] and "one" in backends.known()
    with pytest.raises(ValueError, match="unknown back end"):
        backends.get("two")
    options = backends.Options.from_mapping({"INKVEIL_BACKEND": "one", "INKVEIL_MARGIN": "4", "OTHER": "x"})
    assert (options.backend, options.margin, options.min_side) == ("one", 4, 1500)
    images = spark.createDataFrame([(1, (10, 20, 3, bytearray(600)))], "request_id long, pixels struct<height:int,width:int,n_channels:int,data:binary>")
    row = api.recognise(images, Reader(), enhance=lambda x: enhance.upscale(x, 30)).first()
    assert (row.x_max, row.y_max, row.scale) == (60.0, 30.0, 3.0)


def test_enhancement():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)
    large, factor = enhance.upscale(image, 40)
    assert large.shape == (40, 60, 3) and factor == 2.0 and enhance.upscale(image, 20) == (image, 1.0)
    flat = np.full((16, 16, 3), 90, np.uint8)
    assert (enhance.upscale(flat, 33)[0] == 90).all() and (enhance.sharpen(flat) == 90).all()
    edge = np.repeat(np.array([100] * 8 + [150] * 8, np.uint8)[None, :, None], 16, 0).repeat(3, 2)
    sharp = enhance.sharpen(edge)
    assert sharp[0, 7, 0] < 100 and sharp[0, 8, 0] > 150 and sharp[0, 0, 0] == 100
    assert np.abs(enhance.from_lab(enhance.to_lab(image)).astype(int) - image).max() <= 1
    dim = rng.integers(100, 110, (64, 64), dtype=np.uint8)
    assert np.ptp(enhance.equalise(dim)) > np.ptp(dim)
    assert enhance.local_contrast(image).shape == image.shape
    assert enhance.with_border(image, 2).shape == (24, 34, 3)
    assert enhance.boxes_without_border([[(30, 31.9), (70, 31), (70, 60), (30, 60)], [(0, 0), (500, 0), (500, 500), (0, 500)]], 20, 30) == [[0, 0, 30, 20], [0, 0, 30, 20]]
    assert enhance.first_frame([]) is None and enhance.first_frame([1, 2]) == 1


def test_versions(spark):
    rows = spark.createDataFrame([(None,), ("a/b",), ("a/b;version=1",), ("version = 12",)], "accept string")
    assert [r[0] for r in rows.select(requests.api_version(F.col("accept"))).collect()] == [1, 1, 1, 12]
    assert backends.known() is not None


def test_palettes_and_codecs(spark):
    base = {"request_id": 1, "image": bytearray([0, 1, 1, 9]), "rows": 2, "columns": 2, "bits_allocated": 8, "samples_per_pixel": 1}
    good, wide = '{"red":[10,20],"green":[30,40],"blue":[50,60]}', '{"red":[0,65535],"green":[0,257],"blue":[0,0]}'
    cases = [{"palette_color_lut": good}, {"palette_color_lut": wide}, {"palette_color_lut": "{bad"}, {"palette_color_lut": '{"red":[1]}'}, {"transfer_syntax_uid": "1.2.840.10008.1.2.4.50"}, {"image": None}, {"bits_allocated": 12}]
    rows = spark.createDataFrame([{**base, "request_id": k, **c} for k, c in enumerate(cases)], requests.SCHEMA)
    got = {r.request_id: r for r in decode(rows).collect()}
    pixels = lambda r: list(r.pixels.data)
    assert pixels(got[0])[:6] == [50, 30, 10, 60, 40, 20] and pixels(got[0])[9:] == [60, 40, 20]
    assert pixels(got[1])[:6] == [0, 0, 0, 0, 1, 255]
    assert got[2].pixels is None and got[2].decode_error and got[4].decode_error == "codec unavailable"
    # Without all three channels the palette is not used.
    assert pixels(got[3])[:6] == [0, 0, 0, 28, 28, 28] and {got[k].decode_error for k in (5, 6)} == {"Failed to decode image"}

    class Codec:
        def decode(self, data, request):
            return np.full((request["rows"], request["columns"], 3), len(data), np.uint8)

    assert pixels({r.request_id: r for r in decode(rows, Codec()).collect()}[4]) == [4] * 12


def test_stream_of_requests(spark, tmp_path):
    rows = spark.createDataFrame([{"request_id": k, "content_type": "image/raw" if k else "text/plain", "sensitive_data_list": "{}"} for k in range(3)], requests.SCHEMA)
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        stream.process(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", requests.check).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.request_id, r.status) for r in got.collect()) == [(0, 400), (1, 200), (2, 200)]


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT fuzz_ratio('jhon doe', 'john doe') a, fuzz_partial_ratio('doe', 'john doe') b, normalize_text('Été  X') c, fuzz_ratio(null, 'x') d").first()
    assert tuple(got) == (87.5, 100.0, "ete x", None)
