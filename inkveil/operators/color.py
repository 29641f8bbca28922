"""Background colours of boxes from their pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def median_color(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median of each channel."""
    return pixels.groupBy(*keys).agg(*[F.median(c).alias(f"m{c}") for c in CHANNELS])


def background_color(pixels: DataFrame, keys: list[str], radius: float = 30.0) -> DataFrame:
    """Floor of the mean of the pixels within ``radius`` of the median; of all pixels if none is."""
    near = pixels.join(median_color(pixels, keys), keys)
    distance = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in CHANNELS), F.lit(0.0)))
    near = near.withColumn("close", distance <= radius)
    mean = lambda c: F.floor(F.coalesce(F.avg(F.when(F.col("close"), F.col(c))), F.avg(c))).cast("long").alias(c)
    return near.groupBy(*keys).agg(*map(mean, CHANNELS))


def group_by_color(boxes: DataFrame) -> DataFrame:
    """(request_id, ord, color, rectangle) to one row per colour: rectangles in order, colours by first use."""
    return boxes.groupBy("request_id", "color").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rectangle"))), lambda s: s.rectangle).alias("rectangles"), F.min("ord").alias("first_ord"))
