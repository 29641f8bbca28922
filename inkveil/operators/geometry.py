"""Box arithmetic: margins, scaling, output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grow(x1, y1, x2, y2, margin: int = 2) -> list[Column]:
    """Box with a margin, cut at the upper left edge only."""
    zero = F.lit(0)
    return [F.greatest(zero, x1 - margin), F.greatest(zero, y1 - margin), x2 + margin, y2 + margin]


def rescale(coords: list[Column], factor) -> list[Column]:
    return [c / factor for c in coords]


def rectangle(x1, y1, x2, y2) -> Column:
    """'x y width height', every number truncated after the subtraction."""
    return F.concat_ws(" ", *[v.cast("int").cast("string") for v in (x1, y1, x2 - x1, y2 - y1)])


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)]))


def parse_rectangle(text: Column) -> list[Column]:
    """x1, y1, x2, y2 of 'x y width height'."""
    x, y, w, h = (F.split(text, " ").getItem(i).cast("int") for i in range(4))
    return [x, y, x + w, y + h]


def polygon_bounds(points: Column) -> list[Column]:
    """Bounding box of an array of (x, y) arrays, truncated to whole numbers."""
    axis = lambda i: F.transform(points, lambda p: p[i].cast("int"))
    return [F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1))]


def clip_box(x1, y1, x2, y2, width, height, pad: int = 0) -> list[Column]:
    """A box found on an image with a border of ``pad``, moved back and cut to the image."""
    cut = lambda v, most: F.greatest(F.lit(0), F.least((v - pad).cast("int"), most))
    return [cut(x1, width), cut(y1, height), cut(x2, width), cut(y2, height)]


def zip_shortest(*arrays: str) -> Column:
    """Structs of the elements at the same place, as many as the shortest array has."""
    return F.slice(F.arrays_zip(*arrays), F.lit(1), F.least(*map(F.size, arrays)))


def scale_factor(height: Column, width: Column, min_side: int = 1500) -> Column:
    """What an image is enlarged by before its text is read: up to ``min_side`` on the shorter side."""
    side = F.least(height, width)
    return F.when(side >= min_side, F.lit(1.0)).otherwise(F.lit(float(min_side)) / side)


def box_of(values: Column) -> Column:
    """The four numbers of an array as a box; null for an array of another size or with a null in it."""
    good = (F.size(values) == 4) & ~F.exists(values, lambda v: v.isNull())
    return F.when(good, F.struct(*[F.get(values, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))]))
