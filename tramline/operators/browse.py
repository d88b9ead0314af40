"""Looking things up: pages, keys, search, route and trip details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.functions.scalars import number_first
from tramline.operators.patterns import ordered_calls
from tramline.operators.sequences import alignment


def page(rows: DataFrame, offset: int, limit: int) -> tuple[DataFrame, bool]:
    """Up to `limit` rows (1 to 100) from the record number `offset` on, in order, and whether there are more."""
    n = min(max(limit, 1), 100)
    got = rows.where(F.col("_row") >= offset).orderBy("_row").limit(n + 1)
    return got.orderBy("_row").limit(n), got.count() > n


def lookup(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The rows whose trimmed key is one of values' (one column)."""
    return rows.withColumn("_k", strip(key)).join(values.select(F.col(values.columns[0]).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows whose columns, as one JSON text, hold the searched text whatever its case."""
    return rows.where(F.lower(F.to_json(F.struct(*columns))).contains(text.lower()))


def facets(findings: DataFrame, text: str = "", severity: str = "", category: str = "", rule: str = "", file: str = "") -> DataFrame:
    out = findings
    for c, v in (("severity", severity), ("category", category), ("rule_id", rule), ("file", file)):
        out = out.where(F.col(c) == v) if v else out
    hay = F.lower(F.concat_ws(" ", "rule_id", "category", "file", "key", "observed", "expected"))
    return out.where(hay.contains(text.lower())) if text else out


def inventory(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """(_feed, route_id, route_name, trips): routes with their number of trips rows."""
    n = trips.groupBy("_feed", strip("route_id").alias("route_id")).agg(F.count("*").alias("trips"))
    r = routes.groupBy("_feed", strip("route_id").alias("route_id")).agg(F.min_by(strip("route_short_name"), "_row").alias("route_name"))
    return r.join(n, ["_feed", "route_id"], "left").fillna(0, ["trips"])


def route_order(name: str) -> list[Column]:
    return number_first(F.col(name))


def route_detail(trips: DataFrame, stop_times: DataFrame, feed: str, route: str) -> DataFrame:
    """(direction_id, shape_id, stops, trips, first_time) of one route: its variations by direction, stops and shape."""
    mine = trips.where((F.col("_feed") == feed) & (strip("route_id") == route)).select("_feed", strip("trip_id").alias("trip_id"), strip("direction_id").alias("direction_id"), strip("shape_id").alias("shape_id")).distinct()
    calls = ordered_calls(stop_times.withColumn("_t", strip("trip_id")).join(mine.select("_feed", F.col("trip_id").alias("_t")), ["_feed", "_t"], "left_semi"))
    per = calls.groupBy("_feed", "trip_id").agg(F.sort_array(F.collect_list(F.struct("n", "stop", "departure"))).alias("c"))
    met = mine.join(per, ["_feed", "trip_id"], "left").withColumn("stops", F.array_join(F.transform(F.coalesce("c", F.array().cast("array<struct<n:int,stop:string,departure:string>>")), lambda x: x["stop"]), ">"))
    return met.groupBy("direction_id", "shape_id", "stops").agg(F.count("*").alias("trips"), F.min(F.col("c")[0]["departure"]).alias("first_time"))


def trip_detail(stop_times: DataFrame, stops: DataFrame, feed: str, trip: str) -> DataFrame:
    """(n, stop, stop_name, arrival, departure) of one trip in order; no rows for a trip without calls."""
    calls = ordered_calls(stop_times.where((F.col("_feed") == feed) & (strip("trip_id") == trip)))
    names = stops.where(F.col("_feed") == feed).groupBy(strip("stop_id").alias("stop")).agg(F.min_by("stop_name", "_row").alias("stop_name"))
    return calls.join(names, "stop", "left").select("n", "stop", "stop_name", "arrival", "departure").orderBy("n")


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """(row, left_stop, right_stop, status, fields): two trips' calls aligned by stop, from ordered_calls() of one trip each.

    status: match, schedule_difference, left_only, right_only or different_stop; fields are those of a matched call that differ.
    """
    parts = ["stop", "arrival", "departure", "pickup", "drop_off"]
    gather = lambda df, p: df.agg(F.sort_array(F.collect_list(F.struct("n", *parts))).alias(p))
    both = gather(left, "l").crossJoin(F.broadcast(gather(right, "r")))  # one row each
    rows = both.select("l", "r", F.posexplode(alignment(F.transform("l", lambda x: x["stop"]), F.transform("r", lambda x: x["stop"]))).alias("row", "x"))
    at = lambda p, c: F.get(F.col(p), F.col(f"x.{'left' if p == 'l' else 'right'}"))[c]
    fields = F.array_compact(F.array(*[F.when((F.col("x.status") == "match") & (at("l", c) != at("r", c)), F.lit(c)) for c in parts[1:]]))
    out = rows.select("row", at("l", "stop").alias("left_stop"), at("r", "stop").alias("right_stop"), F.col("x.status").alias("status"), fields.alias("fields"))
    return out.withColumn("status", F.when(F.size("fields") > 0, "schedule_difference").otherwise(F.col("status")))
