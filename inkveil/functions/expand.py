"""Search-term variants of tag values, as array columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and the words of the sex codes.
MONTHS = (
    "january february march april may june july august september october november december".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split(),
    "jan fev mar avr mai jun jul aou sep oct nov dec".split(),
)
SEX = {"f": ["female", "femme", "fille", "feminin"], "m": ["male", "homme", "garcon", "masculin"], "o": ["other", "autre", "non-binary", "nonbinary", "non binaire"]}
NUMERIC = ("dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")
#: Order of day (D), month (M) and year (Y, or y of two digits); glued forms put the year first.
TEXTUAL = ("D M Y", "M D Y", "Y M D", "YMD", "YM D", "Y MD", "D M y", "M D y")


def dicom_date(value: Column) -> Column:
    """A date of eight digits, or null."""
    return F.when(value.rlike("^[0-9]{8}$"), F.try_to_date(value, "yyyyMMdd"))


def date_variants(date: Column) -> Column:
    """All spellings of a date; an empty array for null.

    Forms are one literal array that the day, the year and the month's names are put into, so
    the expression stays small.
    """
    day, year = F.dayofmonth(date).cast("string"), F.date_format(date, "yyyy")
    names = F.array(*[F.element_at(F.array(*map(F.lit, m)), F.month(date)) for m in MONTHS])
    forms = F.transform(F.array(*map(F.lit, TEXTUAL)), lambda f: F.replace(F.replace(f, F.lit("Y"), year), F.lit("y"), F.substring(year, 3, 2)))
    dated = F.flatten(F.transform(F.array(day, F.lpad(day, 2, "0")), lambda d: F.transform(forms, lambda f: F.replace(f, F.lit("D"), d))))
    textual = F.flatten(F.transform(names, lambda n: F.transform(dated, lambda f: F.replace(f, F.lit("M"), n))))
    numeric = F.array(*[F.date_format(date, f) for f in NUMERIC])
    return F.when(date.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(numeric, textual)))


def months_over(birth: Column, study: Column) -> Column:
    """Full months beyond the full years between two dates."""
    total = (F.year(study) - F.year(birth)) * 12 + F.month(study) - F.month(birth)
    return F.pmod(total - (F.dayofmonth(study) < F.dayofmonth(birth)).cast("int"), F.lit(12))


def age_variants(age: Column, birth: Column, study: Column) -> Column:
    """Spellings of an age string nnnU; an empty array for anything else."""
    number, unit = F.try_to_number(F.substring(age, 1, 3), F.lit("999")).cast("int"), F.lower(F.substring(age, 4, 1))
    plain = number.cast("string")
    months = months_over(birth, study).cast("string")
    forms = F.array(F.concat(plain, unit), F.concat(F.lpad(plain, 3, "0"), unit))
    years = F.array(F.concat(plain, F.lit("ans")), F.concat(plain, F.lit("y"), months, F.lit("m")), F.concat(plain, F.lit("a"), months, F.lit("m")))
    out = F.when(unit == "y", F.concat(forms, F.filter(years, lambda x: x.isNotNull()))).otherwise(forms)
    return F.when((F.length(age) >= 4) & number.isNotNull(), F.array_distinct(out)).otherwise(F.array().cast("array<string>"))


def sex_variants(sex: Column) -> Column:
    code = F.lower(sex)
    return reduce(lambda rest, k: F.when(code == k, F.array(*map(F.lit, SEX[k]))).otherwise(rest), SEX, F.array(code))


def name_variants(name: Column, normal) -> Column:
    """First names, last name and both orders of Last^First,First; ``normal`` normalises a column."""
    parts = F.split(name, r"\^")
    last = normal(F.element_at(parts, 1))
    firsts = F.when(F.size(parts) > 1, F.transform(F.split(F.get(parts, F.lit(1)), ","), normal)).otherwise(F.array().cast("array<string>"))
    both = F.flatten(F.transform(firsts, lambda f: F.array(F.concat_ws(" ", f, last), F.concat_ws(" ", last, f))))
    return F.array_distinct(F.concat(firsts, F.when(last != "", F.concat(F.array(last), both)).otherwise(F.array().cast("array<string>"))))


def with_stripped(terms: Column) -> Column:
    """Terms and their twins without spaces."""
    return F.array_union(terms, F.transform(terms, lambda t: F.replace(t, F.lit(" "), F.lit(""))))
