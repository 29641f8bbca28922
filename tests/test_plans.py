import duckdb
import numpy as np
import pytest

from inkveil import queries, queries_match  # noqa: F401
from inkveil.functions.image import apply_lut, apply_palette, background, decode_raw, paint
from inkveil.plans import api

DATA = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return str(round(v, 6))
    return str([_norm(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("part", "orders", "lineitem", "events", "supplier", "nation", "customer", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted([_norm(r[c]) for c in cols] for r in df.collect())
    rel = con.execute(queries.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    assert got == sorted([_norm(r[names.index(c)]) for c in cols] for r in rel.fetchall())


def test_image_kernels():
    assert apply_lut(np.array([[0, 100]])).tolist() == [[0, 255]] and apply_lut(np.array([[50, 50]])).tolist() == [[0, 0]]
    assert apply_lut(np.array([[-100, 500]]), center=128, width=256).tolist() == [[0, 255]]
    palette = {"red": [255, 0], "green": [0, 255], "blue": [0, 0]}
    assert apply_palette(np.array([[0, 9]]), palette).tolist() == [[[255, 0, 0], [0, 255, 0]]] and apply_palette(np.array([[0]]), {"red": [1]}) is None
    assert decode_raw({"rows": 2, "columns": 2, "bits_allocated": 8, "samples_per_pixel": 1, "image": b"abc"}) is None
    image = np.full((10, 10, 3), 255, np.uint8)
    image[:1] = 0
    assert background(image, 0, 0, 10, 10) == (255, 255, 255) and background(image, 20, 20, 30, 30) is None
    assert (paint(image, [("1 1 8 8", "ff0000")])[5, 5] == [0, 0, 255]).all()


# A window of 256 from 0 brings 255 to 254, as test_image_kernels has it.
@pytest.mark.parametrize("center, width, color", [(128.0, 256.0, "fefefe"), (127.5, 255.0, "ffffff")])
def test_deidentify_and_report(spark, center, width, color):
    class Stub:
        def detect(self, image):
            return ["john", "hello"], [[1, 1, 7, 7], [1, 8, 9, 9]]

    base = {"image": bytes([255] * 100), "content_type": "image/raw", "rows": 10, "columns": 10, "bits_allocated": 8, "samples_per_pixel": 1, "window_center": center, "window_width": width}
    cases = [("1", '{"PatientName":"Smith^John"}'), ("2", "{}"), ("3", "not json"), ("4", '["a"]')]
    rows = [{"request_id": int(i), "sensitive_data_list": j, "sop_instance_uid": None, **base} for i, j in cases]
    rows.append({**rows[0], "request_id": 5, "content_type": "text/plain"})
    from inkveil.sources.requests import SCHEMA

    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r.get(f) if r.get(f) is not None else (bytearray(r["image"]) if f == "image" else None) for f in fields) for r in rows], SCHEMA)
    got = {r.request_id: r for r in api.deidentify(df, Stub()).collect()}
    assert got[1].message == "1 sensitive data detected" and got[1].masks[0].color == color and got[1].masks[0].rectangles == ["0 0 9 9"]
    assert got[2].message == "No sensitive data list provided"
    assert [got[i].status for i in (3, 4, 5)] == [400, 400, 400] and got[5].error == "Unsupported file type."
    seen = {r.request_id: r for r in api.report(df, Stub()).collect()}
    assert seen[1].detected_tags == ["PatientName"]


def _boxes(spark, boxes):
    rows = [(1, i, t, float(x), float(y), float(x2), float(y + 20)) for i, (t, x, y, x2) in enumerate(boxes)]
    return spark.createDataFrame(rows, "request_id long, box_id int, text string, x_min double, y_min double, x_max double, y_max double")


def test_detection_cases(spark):
    # A name over two boxes, a box that only resembles one of its words, and a date over two boxes beside its label.
    boxes = _boxes(spark, [("Lakeside", 0, 0, 80), ("Radiology", 90, 0, 180), ("RAD", 0, 100, 40), ("Birth d.", 0, 200, 80), ("1947", 89, 200, 140), ("/ 11 / 08", 180, 200, 260)])
    tags = spark.createDataFrame([(1, 0, "InstitutionName", "Lakeside Radiology"), (1, 1, "PatientBirthDate", "19471108")], "request_id long, tag_pos int, tag string, value string")
    rows = api.sensitive_boxes(boxes, tags).collect()
    found = {r.text for r in rows}
    assert {"Lakeside", "Radiology", "1947"} <= found and "Birth d." not in found and "RAD" not in found
    assert [r.box_id for r in rows] == sorted(r.box_id for r in rows)
    assert api.report_tags(boxes, tags).first().detected_tags == ["InstitutionName", "PatientBirthDate"]


def test_edges_of_detection(spark):
    boxes = _boxes(spark, [("", 0, 0, 10), (None, 20, 0, 30), ("...", 40, 0, 50)])
    tags = spark.createDataFrame([(1, 0, "PatientName", "^"), (1, 1, "PatientID", ""), (1, 2, "StudyDate", "2023"), (2, 0, "PatientID", "77")], "request_id long, tag_pos int, tag string, value string")
    assert not api.sensitive_boxes(boxes, tags).collect() and not api.report_tags(boxes, tags).collect()
    assert not api.sensitive_boxes(boxes.limit(0), tags).collect() and not api.sensitive_boxes(boxes, tags.limit(0)).collect()


def test_boxes_of_an_enlarged_image(spark):
    boxes = _boxes(spark, [("DOE,1234567", 0, 0, 330)]).selectExpr("*", "3.0D AS scale")
    got = api.prepare(boxes).orderBy("box_id").collect()
    whole = api.prepare(boxes.drop("scale")).orderBy("box_id").collect()
    assert len(got) == 2 and all((a.x_min, a.x_max, a.y_max) == (b.x_min / 3, b.x_max / 3, b.y_max / 3) for a, b in zip(got, whole))


def test_scripts(spark):
    names = {"ja": ("山田^太郎", "山田 太郎"), "ru": ("Петров^Иван", "ПЕТРОВ ИВАН"), "he": ("כהן^דוד", "דוד כהן"), "ar": ("الحسن^عمر", "عمر الحسن"), "ko": ("김^민준", "김 민준"), "zh": ("王^小明", "王 小明"), "fr": ("Lefèvre^Zoé", "LEFEVRE ZOE")}
    rows = [(k, 0, shown, 0.0, 0.0, 200.0, 20.0) for k, (_, shown) in enumerate(names.values())] + [(k, 1, "xyz qrs", 0.0, 100.0, 200.0, 120.0) for k in range(len(names))]
    boxes = spark.createDataFrame(rows, "request_id long, box_id int, text string, x_min double, y_min double, x_max double, y_max double")
    tags = spark.createDataFrame([(k, 0, "PatientName", value) for k, (value, _) in enumerate(names.values())], "request_id long, tag_pos int, tag string, value string")
    assert [(r.request_id, r.text) for r in api.sensitive_boxes(boxes, tags).collect()] == [(k, shown) for k, (_, shown) in enumerate(names.values())]
