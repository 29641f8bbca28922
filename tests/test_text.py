import datetime
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkveil.functions import expand
from inkveil.functions.blocks import find_tokens
from inkveil.functions.text import lcs, normalize, normalize_ascii, partial_ratio, ratio


@pytest.mark.parametrize("text, want", [("HELLO", "hello"), ("hello@world!", "helloworld"), ("àcafé", "acafe"), ("  hello   world   ", "hello world"), ("", ""), ("@#$%", ""), ("Anonyme^Fille", "anonymefille"), ("J0hn", "john"), (None, None)])
def test_normalize(text, want):
    assert normalize(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=20))
def test_normalize_by_definition(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    plain = " ".join("".join(c for c in plain if (c.isalnum() or c.isspace() or re.match(r"\w", c)) and c != "_").split())
    assert normalize(text) == re.sub("(?<=[a-z])0(?=[a-z])", "o", plain)


@pytest.mark.parametrize(
    "a, b, whole, part",
    [("jhon doe", "john doe", 87.5, 87.5), ("ficle", "fille", 80, 80), ("4urnnd", "durand", 66.6667, 72.7273), ("duponttor", "dupontmoranddurandmarie", 50, 88.8889), ("1928 03 03", "19280303", 88.8889, 80), ("03 03", "19280303", 61.5385, 88.8889), ("test", "world", 0, 0)],
)
def test_scores(a, b, whole, part):
    assert ratio(a, b) == pytest.approx(whole, abs=1e-3)
    assert partial_ratio(a, b) == pytest.approx(part, abs=1e-3)


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs(a, b) == table[-1][-1]
    assert ratio(a, b) == ratio(b, a)


@pytest.mark.parametrize(
    "text, want",
    [
        ("ANONYME,FILLE", ["ANONYME", "FILLE"]), ("12345 / DUPONT", ["12345", "DUPONT"]), ("27/10/2020", ["27/10/2020"]), ("1928 / 03/ 03", ["1928 / 03/ 03"]),
        ("ITm1.0 / 02-09-2021", ["ITm1.0", "02-09-2021"]), ("JEAN,ALBERTDUPONT,97658223.20190116", ["JEAN", "ALBERTDUPONT", "97658223", "20190116"]),
        ("Né(..20/11/1880", ["Né(..20/11/1880"]), ("H.U.G. 3C", ["H.U.G. 3C"]), ("JEAN.ALBERT", ["JEAN", "ALBERT"]), ("", []),
    ],
)
def test_tokens(text, want):
    assert [t for t, _, _ in find_tokens(text)] == want


def test_expanders(spark):
    rows = spark.createDataFrame([("Doe^John", "20230115", "045Y"), ("^Jane", "2023011", "04"), ("", None, "001D")], "name string, day string, age string")
    from pyspark.sql import functions as F

    got = rows.select(
        expand.name_variants(F.col("name"), normalize_ascii).alias("n"), expand.date_variants(expand.dicom_date(F.col("day"))).alias("d"),
        expand.age_variants(F.col("age"), F.lit(datetime.date(1980, 1, 15)), F.lit(datetime.date(2025, 3, 20))).alias("a"),
    ).collect()
    assert set(got[0].n) == {"doe", "john", "john doe", "doe john"} and set(got[1].n) == {"jane"}
    assert {"15.01.2023", "01/15/2023", "15 january 2023", "2023jan15", "15 jan 23"} <= set(got[0].d) and got[1].d == [] and got[2].d == []
    assert set(got[0].a) == {"45y", "045y", "45ans", "45y2m", "45a2m"} and got[1].a == [] and set(got[2].a) == {"1d", "001d"}
