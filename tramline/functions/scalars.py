"""Scalar expressions on feed text, all of them Catalyst expressions but for names, which need Unicode decomposition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tramline.common import PLAIN_DECIMAL, strip
from tramline.operators.copydiff import exact_decimal

__all__ = ["add_month", "alnum_name", "canonical_trip", "date_of", "distance_m", "exact_decimal", "folded", "natural_key", "number_first", "row_label", "safe_cell", "seconds", "strip", "upcoming_friday", "zero_pad"]

CLOCK = r"^([0-9]{1,3}):([0-5][0-9]):([0-5][0-9])$"


def seconds(v: Column) -> Column:
    """Seconds of service-day time h:mm:ss, hours beyond 24 included; null if it is none."""
    part = lambda i: F.regexp_extract(v, CLOCK, i).try_cast("int")
    return F.when(v.rlike(CLOCK), part(1) * 3600 + part(2) * 60 + part(3))


def date_of(v: Column) -> Column:
    """The date of eight digits yyyyMMdd; null if they form none."""
    return F.when(v.rlike("^[0-9]{8}$"), F.try_to_date(v, "yyyyMMdd"))


def distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance on a sphere of radius 6,371,000 m; null if a coordinate is."""
    dp, dl = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.pow(F.sin(dp), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dl), 2)
    return F.when(h.isNotNull(), F.lit(2 * 6_371_000.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def coordinate(v: Column) -> Column:
    return F.when(v.rlike(PLAIN_DECIMAL), v.try_cast("double"))


@F.pandas_udf(StringType())
def folded(v: pd.Series) -> pd.Series:
    """Case folded, accents dropped, all else kept."""
    return v.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c)))


def alnum_name(v: Column) -> Column:
    """A name for comparison: folded, runs of other characters than a-z and 0-9 as single blanks."""
    return F.trim(F.regexp_replace(F.when(v.rlike(r"^[\x00-\x7f]*$"), F.lower(v)).otherwise(folded(v)), "[^a-z0-9]+", " "))


def canonical_trip(trip: Column, service: Column) -> Column:
    """The trip id without its own service id as suffix."""
    tail = F.concat(F.lit("-"), service)
    return F.when((service != "") & F.endswith(trip, tail), F.substring(trip, F.lit(1), F.length(trip) - F.length(tail))).otherwise(trip)


def upcoming_friday(d: Column) -> Column:
    """The same day if it is a Friday, else the next one."""
    return F.date_add(d, F.pmod(F.lit(4) - F.weekday(d), F.lit(7)))


def add_month(d: Column) -> Column:
    return F.add_months(d, 1)


def natural_key(v: Column) -> Column:
    """Sorts digit runs by value: they are put to twelve digits."""
    return F.regexp_replace(F.regexp_replace(v, "([0-9]+)", "000000000000$1"), "0*([0-9]{12})(?![0-9])", "$1")


def number_first(v: Column) -> list[Column]:
    """Sort columns that put whole numbers first, by value, then other texts."""
    return [F.when(v.rlike("^[0-9]+$"), 0).otherwise(1), F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint")), v]


def zero_pad(v: Column, n: int) -> Column:
    """Leading zeros up to n characters; longer texts are kept."""
    return F.when(F.length(v) < n, F.lpad(v, n, "0")).otherwise(v)


def safe_cell(v: Column) -> Column:
    """Text a spreadsheet won't take for a formula."""
    return F.when(F.ltrim(v).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v)


def row_label(v: Column, row: Column) -> Column:
    return F.when(strip(v) == "", F.concat(F.lit("row "), row.cast("string"))).otherwise(v)
