"""A source feed against a release, trip by trip and date by date. Serves the audit of any source; parameters tell its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.functions.scalars import canonical_trip, coordinate
from tramline.operators.patterns import trip_summaries
from tramline.operators.rules import whole
from tramline.operators.service_dates import active_dates


def dated_trips(t: dict[str, DataFrame], walk: DataFrame | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """(trip_id, canonical, schedule_print, dates, shape_print, fields...) per trip of one feed; dates within first..last (yyyyMMdd), sorted as texts."""
    trips = t["trips"].groupBy(strip("trip_id").alias("trip_id")).agg(F.min(F.struct("_row", *[strip(c).alias(c) for c in ("route_id", "service_id", "trip_headsign", "direction_id", "shape_id", "wheelchair_accessible", "bikes_allowed")])).alias("m")).select("trip_id", "m.*").where("trip_id != ''")
    day = lambda d: d and f"{d[:4]}-{d[4:6]}-{d[6:]}"
    days = active_dates(t["calendar"], t.get("calendar_dates"), day(first), day(last)).groupBy("service_id").agg(F.sort_array(F.collect_set(F.date_format("date", "yyyyMMdd"))).alias("dates"))
    prints = trip_summaries(t["stop_times"], walk).select("trip_id", "stop_count", "stop_print", "schedule_print")
    out = trips.join(days, "service_id", "left").join(prints, "trip_id", "left")
    if "shapes" in t:
        out = out.join(shape_prints(t["shapes"]), "shape_id", "left")
    else:
        out = out.withColumn("shape_print", F.lit(None).cast("string"))
    return out.withColumn("canonical", canonical_trip(F.col("trip_id"), F.col("service_id"))).withColumn("dates", F.coalesce("dates", F.array().cast("array<string>")))


def shape_prints(shapes: DataFrame) -> DataFrame:
    """(shape_id, shape_print): a hash of a shape's points in order, rounded to seven places. Points of one number count once."""
    points = shapes.select(strip("shape_id").alias("shape_id"), whole(strip("shape_pt_sequence")).alias("n"), F.bround(coordinate(strip("shape_pt_lat")), 7).alias("la"), F.bround(coordinate(strip("shape_pt_lon")), 7).alias("lo"), "_row").where("shape_id != '' and n is not null")
    points = points.groupBy("shape_id", "n").agg(F.min(F.struct("_row", "la", "lo")).alias("m")).select("shape_id", "n", "m.la", "m.lo")
    text = F.transform(F.sort_array(F.collect_list(F.struct("n", "la", "lo"))), lambda p: F.concat_ws(",", F.format_string("%.7f", p["la"]), F.format_string("%.7f", p["lo"])))
    return points.groupBy("shape_id").agg(F.sha2(F.array_join(text, ";"), 256).alias("shape_print"))


COMPARED = ["trip_headsign", "direction_id", "wheelchair_accessible", "bikes_allowed"]


def dated_status(source: DataFrame, final: DataFrame, changed: str = "issues", shapes: bool = True, window: DataFrame | None = None) -> DataFrame:
    """(trip_id, final_trip_id, method, status, issues, missing_dates) per source trip; both sides from dated_trips().

    A trip's partners are the final trips of its canonical id; without any, those of equal schedule on a common date.
    status: unverifiable (no calls or dates), outside_final_window, missing, `changed` or matching; issues lists what differs
    in every partner or which dates no partner serves.  With several partners the smallest id is named.  window: one row
    (w1, w2) of yyyyMMdd texts, the dates compared; by default from the first to the last date any final trip runs.
    """
    if window is None:
        window = final.select(F.explode("dates").alias("d")).agg(F.min("d").alias("w1"), F.max("d").alias("w2"))
    s = source.crossJoin(F.broadcast(window)).withColumn("dates", F.filter("dates", lambda d: (d >= F.col("w1")) & (d <= F.col("w2")))).withColumn("outside", (F.size("dates") == 0))
    s = s.select(*[F.col(c).alias(f"s_{c}") for c in ("trip_id", "canonical", "schedule_print", "stop_print", "shape_print", "dates", *COMPARED)], "outside")
    f = final.select(*[F.col(c).alias(f"f_{c}") for c in ("trip_id", "canonical", "schedule_print", "stop_print", "shape_print", "dates", *COMPARED)])
    by_id = s.join(f, F.col("s_canonical") == F.col("f_canonical")).withColumn("method", F.lit("trip_id"))
    rest = s.join(by_id.select("s_trip_id").distinct(), "s_trip_id", "left_anti")
    by_time = rest.join(f, (F.col("s_schedule_print") == F.col("f_schedule_print")) & F.arrays_overlap("s_dates", "f_dates")).withColumn("method", F.lit("schedule_and_dates"))
    both = by_id.unionByName(by_time.select(by_id.columns))
    differs = {"stop_pattern": F.col("s_stop_print") != F.col("f_stop_print"), "schedule": (F.col("s_stop_print") == F.col("f_stop_print")) & (F.col("s_schedule_print") != F.col("f_schedule_print"))}
    differs |= {c: F.col(f"s_{c}") != F.col(f"f_{c}") for c in COMPARED}
    if shapes:
        differs["shape"] = F.col("s_shape_print") != F.col("f_shape_print")
    issues = F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, hit in differs.items()]))
    per = both.withColumn("issues", issues).groupBy("s_trip_id").agg(F.min("f_trip_id").alias("final_trip_id"), F.min("method").alias("method"), F.min_by("issues", F.struct(F.size("issues"), "f_trip_id")).alias("issues"), F.array_distinct(F.flatten(F.collect_set("f_dates"))).alias("served"))
    out = s.join(per, "s_trip_id", "left")
    gone = F.when(F.col("final_trip_id").isNotNull(), F.array_except("s_dates", "served")).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("missing_dates", gone).withColumn("issues", F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.when(F.size("missing_dates") > 0, F.array(F.lit("dates"))).otherwise(F.array().cast("array<string>"))))
    status = F.when(F.col("outside"), "outside_final_window").when(F.col("s_schedule_print").isNull(), "unverifiable").when(F.col("final_trip_id").isNull(), "missing").when(F.size("issues") > 0, changed).otherwise("matching")
    return out.select(F.col("s_trip_id").alias("trip_id"), "final_trip_id", "method", status.alias("status"), F.when(F.col("outside"), F.array().cast("array<string>")).otherwise(F.col("issues")).alias("issues"), "missing_dates")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))
