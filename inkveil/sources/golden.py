"""Golden files, masked images and the tables of intermediate stages."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.image import paint
from inkveil.operators.geometry import parse_rectangle

MASKS = "sop_instance_uid string, rectangles array<string>"
TAGS = "sop_instance_uid string, detected_tags array<string>"


def read_golden(spark: SparkSession, path: str, schema: str = MASKS) -> DataFrame:
    """Golden JSON files with the name of each; a file that is no JSON object has nulls."""
    files = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return files.select(*[c for c in files.columns if c != "_corrupt_record"], F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))


def write_golden(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object a line; what is there stays unless ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "ignore").json(path)


def golden_rectangles(golden: DataFrame, key: str = "sop_instance_uid") -> DataFrame:
    """(image_id, golden_id, x1, y1, x2, y2) of golden files, as the evaluation takes them."""
    rows = golden.select(F.col(key).alias("image_id"), F.posexplode("rectangles").alias("golden_id", "r"))
    return rows.select("image_id", "golden_id", *[c.alias(n) for c, n in zip(parse_rectangle(F.col("r")), ("x1", "y1", "x2", "y2"))])


def png(image: np.ndarray) -> bytes:
    """An 8-bit PNG file of a BGR image."""
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image[:, :, ::-1]).reshape(height, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def masked_images(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(request_id, png): decoded images with the rectangles of their masks filled, each in its colour."""

    @F.pandas_udf("binary")
    def fill(pixels: pd.DataFrame, found: pd.Series) -> pd.Series:
        out = []
        for h, w, c, data, groups in zip(pixels["height"], pixels["width"], pixels["n_channels"], pixels["data"], found):
            image = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c))
            out.append(png(paint(image, [(r, g["color"]) for g in (groups if groups is not None else []) for r in g["rectangles"]])))
        return pd.Series(out, dtype=object)

    both = images.select("request_id", "pixels").join(masks.select("request_id", "masks"), "request_id", "left")
    return both.select("request_id", fill("pixels", "masks").alias("png"))


def folder_name(moment: Column) -> Column:
    """Name of the folder of a run, by its start."""
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def write_stages(folder: str, **stages: DataFrame) -> None:
    """Writes tables of intermediate stages, each under its name, for a look at a run."""
    for name, table in stages.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
