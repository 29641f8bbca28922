"""End-to-end plans: terms from tags, masks and tag reports from recognised boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import expand
from inkveil.functions.blocks import split_blocks
from inkveil.functions.image import box_color, decode
from inkveil.functions.text import normalize_text
from inkveil.operators.color import group_by_color
from inkveil.operators.geometry import grow, rectangle, rescale
from inkveil.operators.match import detect
from inkveil.operators.settle import settle
from inkveil.plans import backends
from inkveil.sources.requests import NO_LIST, NOTHING, check, tag_rows

class OcrBackend(Protocol):
    """Text recognition: BGR image to texts and [x_min, y_min, x_max, y_max] boxes."""

    def detect(self, image: np.ndarray) -> tuple[list[str], list[list[float]]]: ...


def build_terms(tags: DataFrame) -> DataFrame:
    """(request_id, tag, term, is_name, in_lookup): normalised variants of all tag values.

    Empty and malformed values give no term.  Twins without spaces are looked up but are no
    names.
    """
    birth, study = (F.max(F.when(F.col("tag") == t, expand.dicom_date(F.col("value")))).over(Window.partitionBy("request_id")) for t in ("PatientBirthDate", "StudyDate"))
    v, tag = F.col("value"), F.col("tag")
    rows = tags.filter("value IS NOT NULL AND value <> ''").withColumn("birth", birth).withColumn("study", study)
    plain = lambda c: c
    variants = (
        F.when(tag == "PatientName", expand.name_variants(v, plain)).when(tag == "PatientSex", expand.sex_variants(v))
        .when(tag.isin("PatientBirthDate", "StudyDate"), expand.date_variants(expand.dicom_date(v)))
        .when(tag == "PatientAge", expand.age_variants(v, F.col("birth"), F.col("study"))).otherwise(F.array(v))
    )
    terms = rows.select("request_id", "tag", (tag == "PatientName").alias("is_name"), F.explode(variants).alias("t")).withColumn("term", normalize_text("t")).drop("t")
    twins = terms.select("request_id", "tag", F.lit(False).alias("is_name"), F.replace("term", F.lit(" "), F.lit("")).alias("term"))
    both = terms.unionByName(twins).filter("term <> ''").groupBy("request_id", "tag", "term").agg(F.max("is_name").alias("is_name"))
    return both.withColumn("in_lookup", F.lit(True))


def prepare(boxes: DataFrame) -> DataFrame:
    """Recognised boxes, split, numbered and normalised.

    Boxes of an enlarged image are split there and then brought back to the size of the
    original by their ``scale``.
    """
    parts = split_blocks(boxes)
    if "scale" in parts.columns:
        corners = ("x_min", "y_min", "x_max", "y_max")
        small = dict(zip(corners, rescale([F.col(c) for c in corners], F.coalesce("scale", F.lit(1.0)))))
        parts = parts.withColumns(small).drop("scale")
    order = Window.partitionBy("request_id").orderBy("group_id", "part_no")
    return parts.withColumn("box_id", F.row_number().over(order) - 1).withColumn("norm", normalize_text("text"))


def recognise(images: DataFrame, backend: OcrBackend | str, enhance: Callable[[np.ndarray], tuple[np.ndarray, float]] | None = None) -> DataFrame:
    """(request_id, box_id, text, box, scale) of decoded images.

    ``backend`` is an object, or the name of a registered one, which every Python worker then
    makes for itself when it is first used.  ``enhance`` returns the image to read and what it
    was enlarged by.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = backends.get(backend) if isinstance(backend, str) else backend
        for pdf in batches:
            rows = []
            for rid, p in zip(pdf["request_id"], pdf["pixels"]):
                image, scale = np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"], p["n_channels"]), 1.0
                if enhance is not None:
                    image, scale = enhance(image)
                texts, found = reader.detect(image)
                rows += [(rid, i, t, *map(float, b), scale) for i, (t, b) in enumerate(zip(texts, found))]
            yield pd.DataFrame(rows, columns=["request_id", "box_id", "text", "x_min", "y_min", "x_max", "y_max", "scale"])

    return images.select("request_id", "pixels").mapInPandas(run, "request_id long, box_id int, text string, x_min double, y_min double, x_max double, y_max double, scale double")


def found_boxes(boxes: DataFrame, tags: DataFrame) -> DataFrame:
    """Split boxes that hold sensitive text, in no order."""
    texts = settle(prepare(boxes))
    return texts.join(detect(texts, build_terms(tags)), ["request_id", "box_id"], "left_semi")


def sensitive_boxes(boxes: DataFrame, tags: DataFrame) -> DataFrame:
    """Split boxes that hold sensitive text, in reading order."""
    return found_boxes(boxes, tags).orderBy("request_id", "box_id")


def in_order(tags: DataFrame) -> DataFrame:
    """(request_id, detected_tags): tags of each request in the caller's order."""
    return tags.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tag_pos", "tag"))), lambda s: s.tag).alias("detected_tags"))


def report_tags(boxes: DataFrame, tags: DataFrame) -> DataFrame:
    """(request_id, detected_tags): tags found on their own terms, in the caller's order."""
    hits = detect(prepare(boxes), build_terms(tags), by_tag=True).select("request_id", "tag").distinct()
    return in_order(tags.join(hits, ["request_id", "tag"], "left_semi"))


def _images(requests: DataFrame, codec) -> tuple[DataFrame, DataFrame, DataFrame]:
    checked = check(requests)
    good = checked.filter("status = 200")
    busy = good.filter(F.size(F.coalesce(F.json_object_keys("sensitive_data_list"), F.array())) > 0)
    images = decode(busy.select(*requests.columns), codec)
    bad = checked.filter("status <> 200").select("request_id", "status", "error")
    bad = bad.unionByName(images.filter("pixels IS NULL").select("request_id", F.lit(400).alias("status"), F.col("decode_error").alias("error")))
    return images.filter("pixels IS NOT NULL"), bad, good.join(busy.select("request_id"), "request_id", "left_anti")


def deidentify(requests: DataFrame, backend: OcrBackend | str, codec=None, enhance=None) -> DataFrame:
    """(request_id, status, error, masks, message, sop_instance_uid) of request rows."""
    images, bad, idle = _images(requests, codec)
    tags = tag_rows(images)
    hits = found_boxes(settle(recognise(images, backend, enhance)), tags)
    x = [F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    grown = hits.select("request_id", F.col("box_id").alias("ord"), *[c.alias(n) for c, n in zip(grow(*x), ("x1", "y1", "x2", "y2"))])
    painted = grown.join(images.select("request_id", "pixels"), "request_id").withColumn("color", box_color("pixels", "x1", "y1", "x2", "y2")).filter("color IS NOT NULL")
    groups = group_by_color(painted.select("request_id", "ord", "color", rectangle(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("rectangle")))
    mask = F.struct(F.col("first_ord"), F.struct(F.lit("*").alias("stationName"), "color", "rectangles").alias("mask"))
    masks = groups.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(mask)), lambda s: s.mask).alias("masks"), F.sum(F.size("rectangles")).alias("n"))
    done = images.select("request_id", "sop_instance_uid").join(masks, "request_id", "left")
    message = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" sensitive data detected"))).otherwise(F.lit(NOTHING))
    out = done.select("request_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), "masks", message.alias("message"), "sop_instance_uid")
    return _with_rest(out, bad, idle)


def report(requests: DataFrame, backend: OcrBackend | str, codec=None, enhance=None) -> DataFrame:
    """(request_id, status, error, detected_tags, message, sop_instance_uid) of request rows."""
    images, bad, idle = _images(requests, codec)
    found = report_tags(settle(recognise(images, backend, enhance)), tag_rows(images))
    done = images.select("request_id", "sop_instance_uid").join(found, "request_id", "left").withColumn("detected_tags", F.coalesce("detected_tags", F.array().cast("array<string>")))
    n = F.size("detected_tags")
    message = F.when(n > 0, F.concat(n.cast("string"), F.lit(" sensitive tags detected"))).otherwise(F.lit(NOTHING))
    out = done.select("request_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), "detected_tags", message.alias("message"), "sop_instance_uid")
    return _with_rest(out, bad, idle)


def _with_rest(out: DataFrame, bad: DataFrame, idle: DataFrame) -> DataFrame:
    empty = idle.select("request_id", F.lit(200).alias("status"), F.lit(NO_LIST).alias("message"), "sop_instance_uid")
    return out.unionByName(empty, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)
