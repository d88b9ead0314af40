"""Days of service: calendars to dates, coverage, clipping to a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.contract import DAYS
from tramline.functions.scalars import date_of

LONGEST_DAYS = 3660


def active_dates(calendar: DataFrame, exceptions: DataFrame | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """(_feed, service_id, date): the dates on which services run, within first..last if given.

    A service's later rows replace earlier ones (by _row).  Exceptions add (1) or remove (2) dates, the last row per date
    counts.  Rows with an unusable date give no dates; a span of over ten years within the window is an error.
    """
    day_flags = F.array(*[strip(d) for d in DAYS])
    cal = calendar.groupBy("_feed", strip("service_id").alias("service_id")).agg(F.max(F.struct("_row", day_flags.alias("flags"), date_of(strip("start_date")).alias("a"), date_of(strip("end_date")).alias("b"))).alias("m")).select("_feed", "service_id", "m.flags", "m.a", "m.b")
    if first:
        cal = cal.withColumn("a", F.greatest("a", F.lit(first).cast("date")))
    if last:
        cal = cal.withColumn("b", F.least("b", F.lit(last).cast("date")))
    cal = cal.where("service_id != '' and a is not null and b is not null and a <= b")
    cal = cal.withColumn("b", F.when(F.datediff("b", "a") > LONGEST_DAYS, F.raise_error(F.concat(F.lit("service runs over ten years: "), F.col("service_id"))).cast("date")).otherwise(F.col("b")))
    days = cal.select("_feed", "service_id", "flags", F.explode(F.sequence("a", "b")).alias("date")).where(F.col("flags")[F.weekday("date")] == "1").select("_feed", "service_id", "date")
    if exceptions is None:
        return days
    ex = exceptions.select("_feed", strip("service_id").alias("service_id"), date_of(strip("date")).alias("date"), "_row", strip("exception_type").alias("kind")).where("date is not null and kind in ('1', '2')")
    if first:
        ex = ex.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        ex = ex.where(F.col("date") <= F.lit(last).cast("date"))
    ex = ex.groupBy("_feed", "service_id", "date").agg(F.max_by("kind", "_row").alias("kind"))
    both = days.join(ex, ["_feed", "service_id", "date"], "full")
    return both.where("kind is null or kind = '1'").select("_feed", "service_id", "date")


def coverage(calendar: DataFrame, feed_info: DataFrame | None = None) -> DataFrame:
    """(_feed, first, last): the window feed_info's first row states, if both dates are valid, else that of the calendars."""
    cal = calendar.groupBy("_feed").agg(F.min(date_of(strip("start_date"))).alias("first"), F.max(date_of(strip("end_date"))).alias("last"))
    if feed_info is None:
        return cal
    said = feed_info.groupBy("_feed").agg(F.min(F.struct("_row", date_of(strip("feed_start_date")).alias("a"), date_of(strip("feed_end_date")).alias("b"))).alias("m")).select("_feed", "m.a", "m.b").where("a is not null and b is not null")
    return cal.join(said, "_feed", "full").select("_feed", F.coalesce("a", "first").alias("first"), F.coalesce("b", "last").alias("last"))


def clipped(calendar: DataFrame, first: str, last: str) -> DataFrame:
    """The calendar within first..last (yyyyMMdd, compared as texts); services fully outside get the window and no days."""
    a, b = strip("start_date"), strip("end_date")
    out = (b < first) | (a > last)
    cols = {d: F.when(out, "0").otherwise(strip(d)) for d in DAYS}
    return calendar.withColumns(cols | {"start_date": F.when(out, first).otherwise(F.greatest(a, F.lit(first))), "end_date": F.when(out, last).otherwise(F.least(b, F.lit(last)))})
