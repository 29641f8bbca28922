"""Comparison of detected rectangles and tags with golden ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "image_id"


def overlaps(golden: DataFrame, detected: DataFrame) -> DataFrame:
    """(image_id, golden_id, detected_id, cx1, cy1, cx2, cy2): clipped non-empty intersections."""
    d = detected.select(KEY, "detected_id", *[F.col(c).alias(f"d{c}") for c in ("x1", "y1", "x2", "y2")])
    both = golden.join(d, KEY).select(
        KEY, "golden_id", "detected_id", F.greatest("x1", "dx1").alias("cx1"), F.greatest("y1", "dy1").alias("cy1"), F.least("x2", "dx2").alias("cx2"), F.least("y2", "dy2").alias("cy2")
    )
    return both.filter("cx1 < cx2 AND cy1 < cy2")


def coverage(golden: DataFrame, detected: DataFrame) -> DataFrame:
    """(image_id, golden_id, fraction): share of a golden rectangle under the union of detected ones.

    The clipped rectangles of a golden one are one array.  Their vertical edges cut it into
    strips; within a strip the covered height is a union of intervals, summed in one pass.
    """
    keys = [KEY, "golden_id"]
    parts = overlaps(golden, detected).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cy1", "cy2", "cx1", "cx2"))).alias("ps"))
    edges = F.array_sort(F.array_distinct(F.concat("ps.cx1", "ps.cx2")))

    def strip(x, i):
        right = F.get("edges", i + 1)
        inside = F.filter("ps", lambda p: (p.cx1 <= x) & (p.cx2 >= right))
        # How far down the strip is covered, and how much of it.
        start = F.struct(F.lit(None).cast("double").alias("low"), F.lit(0.0).alias("sum"))
        add = lambda a, p: F.struct(
            F.greatest(a.low, p.cy2.cast("double")).alias("low"), (a["sum"] + F.greatest(F.lit(0.0), p.cy2 - F.greatest(p.cy1.cast("double"), a.low))).alias("sum")
        )
        return F.when(right.isNull(), F.lit(0.0)).otherwise((right - x) * F.aggregate(inside, start, add, lambda a: a["sum"]))

    area = parts.withColumn("edges", edges).select(*keys, F.aggregate(F.transform("edges", strip), F.lit(0.0), lambda a, v: a + v).alias("covered"))
    whole = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    out = golden.join(area, keys, "left")
    return out.select(*keys, F.when((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.coalesce("covered", F.lit(0.0)) / whole).otherwise(F.lit(0.0)).cast("double").alias("fraction"))


def false_positives(golden: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected rectangles that touch no golden one."""
    return detected.join(overlaps(golden, detected).select(KEY, "detected_id").distinct(), [KEY, "detected_id"], "left_anti")


def verdict(golden: DataFrame, detected: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(image_id, matched, missed, extra, ok): ok if no golden rectangle is missed."""
    hit = coverage(golden, detected).groupBy(KEY).agg(F.count_if(F.col("fraction") >= threshold).alias("matched"), F.count_if(F.col("fraction") < threshold).alias("missed"))
    extra = false_positives(golden, detected).groupBy(KEY).agg(F.count("*").alias("extra"))
    out = hit.join(extra, KEY, "full").fillna(0, ["matched", "missed", "extra"])
    return out.withColumn("ok", F.col("missed") == 0)


def compare_tags(golden: DataFrame, detected: DataFrame) -> DataFrame:
    """(image_id, matched, missing, extra): sorted tag arrays."""
    g = golden.distinct().withColumn("g", F.lit(True))
    d = detected.distinct().withColumn("d", F.lit(True))
    pick = lambda cond, name: F.array_sort(F.collect_list(F.when(cond, F.col("tag")))).alias(name)
    both = g.join(d, [KEY, "tag"], "full")
    return both.groupBy(KEY).agg(pick(F.col("g") & F.col("d"), "matched"), pick(F.col("d").isNull(), "missing"), pick(F.col("g").isNull(), "extra"))


def latency_percentiles(rows: DataFrame, keys: list[str], value: str, percents=(50, 95, 99), slack: float = 0.005) -> DataFrame:
    """Value at index min(n - 1, int(p / 100 * n)) of the sorted values.

    Sketches bracket each percentile; then only the few values inside a bracket are ordered,
    after those below it are counted, so that no task sorts a whole key.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v"))
    ks = [f"k{i}" for i in range(len(keys))]
    ends = [min(max(p / 100 + d, 0.0), 1.0) for p in percents for d in (-slack, slack)]
    sketch = rows.groupBy(*ks).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", ends, 10_000).alias("q"))
    at = lambda p: F.least(F.col("n") - 1, (F.lit(p) / F.lit(100.0) * F.col("n")).cast("long"))
    # Brackets at either end take all that lies beyond the sketch.
    one = lambda i, p: F.struct(
        F.lit(p).alias("p"), at(p).alias("at"), F.when(F.lit(ends[2 * i] <= 0), F.col("least")).otherwise(F.get("q", F.lit(2 * i))).alias("lo"),
        F.when(F.lit(ends[2 * i + 1] >= 1), F.col("most")).otherwise(F.get("q", F.lit(2 * i + 1))).alias("hi"),
    )
    asked = sketch.select(*[F.col(k).alias(f"a_{k}") for k in ks], F.array(*[one(i, p) for i, p in enumerate(percents)]).alias("asked"))
    same = [F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in ks]
    each = rows.join(asked, reduce(lambda a, b: a & b, same) if same else F.lit(True)).select(*ks, "v", F.explode("asked").alias("a")).select(*ks, "v", "a.*")
    # One row for each value in a bracket, and one for all below it.
    each = each.filter("v <= hi").withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v")))
    counts = each.groupBy(*ks, "p", "at", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*ks, "p").orderBy(F.asc_nulls_first("v")))
    found = counts.withColumn("upto", upto).filter("v IS NOT NULL AND at < upto AND at >= upto - c")
    out = found.groupBy(*ks).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])
    return out.select(*[F.col(a).alias(b) for a, b in zip(ks, keys)], *[f"p{p}" for p in percents])


def status_histogram(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, share): rows of each status, and their share of all."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    # One row a status is left, so the window over all of them is small.
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def throughput(rows: DataFrame, seconds: str, keys: list[str]) -> DataFrame:
    """(keys, n, total_s, per_second): rows over the time they took; null where they took none."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(seconds).alias("total_s"))
    return out.withColumn("per_second", F.col("n") / F.nullif(F.col("total_s"), F.lit(0.0)))
