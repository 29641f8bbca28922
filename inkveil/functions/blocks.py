"""Splitting of text boxes into tokens with boxes of their own."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GAP = re.compile(r"(?:[, \t/]|\.{2,})+")
_EDGE = re.compile(r"[,/]|\.+")
_AFTER_SLASH = re.compile(r"[ \t/]*(?=\d)")
#: Digits before a slash, back to a blank, a separator, a mark, or the dot of an abbreviation.
_BEFORE_SLASH = re.compile(r"(?:^|[ \t,/]|[^\w.]|_|(?<=[^\W\d_])\.)[\d.]*\d[ \t]*\Z")
_INITIAL = re.compile(r"(?:^|[ \t,./])[^\W\d_]\Z")
_DIGITS_LEFT = re.compile(r"([^\W\d_])?(\d*)\Z")
_DIGITS_RIGHT = re.compile(r"\d*")


def dot_parts(text: str, at: int) -> bool:
    """Whether a single dot stands between two fields and not inside a date, a number or initials."""
    left, right = text[:at], text[at + 1 :]
    if not left or not right or not left[-1].isalnum() or not right[0].isalnum():
        return False
    if right[0].isalpha() and _INITIAL.search(left):
        return False
    m = _DIGITS_LEFT.search(left)
    before, after = len(m[2]), len(_DIGITS_RIGHT.match(right)[0])
    if before and after:
        return max(before, after) > (7 if m[1] else 4)
    return not 0 < before + after <= 4


def slash_joins(text: str, at: int) -> bool:
    """Whether a slash is inside a date."""
    return bool(_AFTER_SLASH.match(text, at + 1)) and bool(_BEFORE_SLASH.search(text[:at]))


def find_tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end): text between commas, field slashes, runs of dots and field dots."""
    out, at, size = [], 0, len(text)
    while at < size:
        gap = _GAP.match(text, at)
        if gap:
            at = gap.end()
            continue
        if text[at] == "." and dot_parts(text, at):
            at += 1
            continue
        end, look = size, at
        while (edge := _EDGE.search(text, look)) is not None:
            mark, place = edge[0], edge.start()
            if mark == "/" and slash_joins(text, place):
                look = _AFTER_SLASH.match(text, place + 1).end()
                continue
            if len(mark) > 1:
                splits = sum(map(str.isalnum, text[at:place])) >= 4
            else:
                splits = mark in ",/" or dot_parts(text, place)
            if splits:
                end = place
                break
            look = edge.end()
        token = text[at:end].rstrip()
        if token:
            out.append((token, at, at + len(token)))
        at = max(end, at + 1)
    return out


_TOKENS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


@F.pandas_udf(_TOKENS)
def tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"token": a, "start": b, "stop": c} for a, b, c in find_tokens(t)], na_action="ignore")


def weight(text: Column) -> Column:
    """Width in characters; a blank weighs a fifth."""
    return F.length(text) - F.lit(0.8) * (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))))


def split_blocks(boxes: DataFrame, parts: str | None = None) -> DataFrame:
    """(request_id, box_id, text, x_min..y_max) to (.., group_id, part_no, text, box): one row per token.

    Boxes are cut in proportion to the width before and in the token, padded, and never
    padded into the token before.  A box of at most one token keeps its text and geometry.
    All tokens of a box are in one array, so nothing is shuffled.
    """
    corners = ("x_min", "y_min", "x_max", "y_max")
    more = [c for c in ("scale",) if c in boxes.columns]
    b = boxes.select("request_id", F.col("box_id").alias("group_id"), "text", *corners, *more, (F.col(parts) if parts else tokens("text")).alias("parts"))
    x_min, y_min, x_max, y_max = (F.col(c).cast("int") for c in corners)
    char = (x_max - x_min) / F.nullif(weight(F.col("text")), F.lit(0.0))
    b = b.withColumn("char", char).withColumn("pad", F.greatest(F.lit(3), (F.col("char") * 0.9).cast("int")))
    place = lambda at: x_min + weight(F.substring(F.col("text"), F.lit(1), at)) * F.col("char")
    b = b.withColumn("ends", F.transform("parts", lambda p: F.struct(p.token.alias("token"), place(p.start).alias("from"), place(p.stop).alias("to"))))

    def cut(p, i):
        # The end before is the unpadded one.
        free = p["from"] - (F.get("ends", i - 1)["to"] + F.col("pad"))
        left = F.when(i == 0, F.col("pad").cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("pad").cast("double"), free)))
        x0, x1 = F.greatest(x_min, (p["from"] - left).cast("int")), F.least(x_max, p["to"].cast("int") + F.col("pad"))
        return F.struct(p.token.alias("text"), *[v.cast("double").alias(c) for c, v in zip(corners, (x0, y_min, x1, y_max))])

    whole = F.array(F.struct("text", *[F.col(c).cast("double").alias(c) for c in corners]))
    b = b.withColumn("cuts", F.when(F.size("parts") > 1, F.transform("ends", cut)).otherwise(whole))
    return b.select("request_id", "group_id", *more, F.posexplode("cuts").alias("part_no", "c")).select("request_id", "group_id", "part_no", "c.*", *more)
