"""Stop patterns: trips summed up, variations of routes, journeys that both sources have, and the health of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.functions.scalars import alnum_name, seconds
from tramline.operators.rules import whole


def ordered_calls(stop_times: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(_feed, trip_id, n, stop, arrival, departure, pickup, drop_off, timepoint): one row per trip and valid number, its first row.

    walk: (source_id, target_id) puts stop ids into another feed's; ids it doesn't map stay.
    """
    call = F.struct("_row", strip("stop_id").alias("stop"), strip("arrival_time").alias("arrival"), strip("departure_time").alias("departure"), strip("pickup_type").alias("pickup"), strip("drop_off_type").alias("drop_off"), strip("timepoint").alias("timepoint"))
    calls = stop_times.select("_feed", strip("trip_id").alias("trip_id"), whole(strip("stop_sequence")).alias("n"), call.alias("c")).where("n is not null and trip_id != ''")
    calls = calls.groupBy("_feed", "trip_id", "n").agg(F.min("c").alias("c")).select("_feed", "trip_id", "n", "c.*").drop("_row")
    if walk is not None:
        to = walk.select(F.col("source_id").alias("stop"), "target_id")
        calls = calls.join(to, "stop", "left").withColumn("stop", F.coalesce("target_id", "stop")).drop("target_id")
    return calls


def trip_summaries(stop_times: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(_feed, trip_id, stop_count, stops, first_time, last_time, stop_print, schedule_print) per trip with valid calls.

    stop_print hashes position and stop, schedule_print number, stop, times and boarding of each call, in order.  The calls
    of one trip, distinct by number, are gathered in one place.
    """
    calls = ordered_calls(stop_times, walk)
    got = calls.groupBy("_feed", "trip_id").agg(F.sort_array(F.collect_list(F.struct("n", "stop", "arrival", "departure", "pickup", "drop_off"))).alias("calls"))
    stop_lines = F.transform("calls", lambda x, i: F.concat((i + 1).cast("string"), F.lit("|"), x["stop"], F.lit("\n")))
    call_lines = F.transform("calls", lambda x, i: F.concat_ws("|", x["n"].cast("string"), x["stop"], x["arrival"], x["departure"], x["pickup"], x["drop_off"], F.lit("\n")))
    last = F.element_at("calls", -1)
    return got.select(
        "_feed", "trip_id", F.size("calls").alias("stop_count"), F.transform("calls", lambda x: x["stop"]).alias("stops"),
        F.when(F.col("calls")[0]["departure"] != "", F.col("calls")[0]["departure"]).otherwise(F.col("calls")[0]["arrival"]).alias("first_time"), F.when(last["arrival"] != "", last["arrival"]).otherwise(last["departure"]).alias("last_time"),
        F.sha2(F.array_join(stop_lines, ""), 256).alias("stop_print"), F.sha2(F.array_join(call_lines, ""), 256).alias("schedule_print"),
    )


def with_trips(summaries: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Summaries with route, route_name, direction, headsign, shape and service of the trip's first row."""
    t = trips.groupBy("_feed", strip("trip_id").alias("trip_id")).agg(F.min(F.struct("_row", strip("route_id").alias("route_id"), strip("direction_id").alias("direction_id"), strip("trip_headsign").alias("headsign"), strip("shape_id").alias("shape_id"), strip("service_id").alias("service_id"))).alias("m")).select("_feed", "trip_id", "m.*").drop("_row")
    r = routes.groupBy("_feed", strip("route_id").alias("route_id")).agg(F.min(F.struct("_row", strip("route_short_name").alias("route_name"))).alias("m")).select("_feed", "route_id", "m.route_name")
    return summaries.join(t, ["_feed", "trip_id"]).join(r, ["_feed", "route_id"], "left").withColumn("route_name", F.coalesce("route_name", "route_id"))


def variations(named: DataFrame) -> DataFrame:
    """(_feed, route_name, stop_print, variation, ...): the distinct stop patterns of a route, numbered V1, V2 ..., with their
    distinct headsigns, shapes and directions; the trips of each are rows of variation_members().

    Numbered by direction, headsign, number of stops, first time and print of the trip that leaves first, as texts.
    """
    first = F.min(F.struct("first_time", "last_time", "trip_id", "direction_id", "headsign", "stop_count")).alias("m")
    per = named.groupBy("_feed", "route_name", "stop_print").agg(first, F.count("*").alias("trips"), F.count_distinct("shape_id").alias("shapes"), *[F.sort_array(F.collect_set(c)).alias(n) for c, n in (("shape_id", "shape_ids"), ("direction_id", "direction_ids"), ("headsign", "headsigns"))], F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    w = W.partitionBy("_feed", "route_name").orderBy("m.direction_id", "m.headsign", "m.stop_count", "m.first_time", "stop_print")
    return per.withColumn("variation", F.concat(F.lit("V"), F.row_number().over(w).cast("string"))).select("_feed", "route_name", "stop_print", "variation", F.col("m.trip_id").alias("example_trip"), F.col("m.direction_id").alias("direction_id"), F.col("m.headsign").alias("headsign"), F.col("m.stop_count").alias("stop_count"), "trips", "shapes", "shape_ids", "direction_ids", F.array_join("headsigns", " ").alias("headsigns"), "first_time", "last_time")


def variation_members(named: DataFrame, catalog: DataFrame) -> DataFrame:
    """(_feed, route_name, variation, trip_id): the trips of each variation of variations()."""
    return named.join(catalog.select("_feed", "route_name", "stop_print", "variation"), ["_feed", "route_name", "stop_print"]).select("_feed", "route_name", "variation", "trip_id")


def numbered_by_first(rows: DataFrame, within: list[str], key: list[str], prefix: str) -> DataFrame:
    """(within, key, variation): distinct keys numbered <prefix>1, <prefix>2 ... by the first row (_row) that has them."""
    first = rows.groupBy(*within, *key).agg(F.min("_row").alias("_first"))
    return first.withColumn("variation", F.concat(F.lit(prefix), F.row_number().over(W.partitionBy(*within).orderBy("_first", *key)).cast("string"))).drop("_first")


def final_variations(named: DataFrame, catalog: DataFrame, left: str, right: str, final: str) -> DataFrame:
    """(route_name, variation, stop_print, trips, source): a release's patterns per route, numbered in order of their prints,
    and which of the two sources has the pattern on that route: both, left, right or none."""
    per = named.where(F.col("_feed") == final).groupBy("route_name", "stop_print").agg(F.count("*").alias("trips"))
    per = per.withColumn("variation", F.concat(F.lit("Final V"), F.row_number().over(W.partitionBy("route_name").orderBy("stop_print")).cast("string")))
    held = catalog.where(F.col("_feed").isin(left, right)).groupBy("route_name", "stop_print").agg(F.max((F.col("_feed") == left).cast("int")).alias("l"), F.max((F.col("_feed") == right).cast("int")).alias("r"))
    source = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, left).when(F.col("r") == 1, right).otherwise("none")
    return per.join(held, ["route_name", "stop_print"], "left").select("route_name", "variation", "stop_print", "trips", source.alias("source"))


def journeys_by_variation(named: DataFrame, catalog: DataFrame, left: str, right: str) -> DataFrame:
    """(_feed, route_name, variation, comparable, affected): common journeys that each variation serves, and those of them without a shared pattern."""
    met = compared_journeys(named, left, right).select(*JOURNEY, F.when(F.col("shared") == 0, 1).otherwise(0).alias("bad"))
    each = journeys(named.where(F.col("_feed").isin(left, right))).select("_feed", *JOURNEY, "stop_print").distinct().join(met, JOURNEY)
    return each.join(catalog.select("_feed", "route_name", "stop_print", "variation"), ["_feed", "route_name", "stop_print"]).groupBy("_feed", "route_name", "variation").agg(F.count("*").alias("comparable"), F.sum("bad").alias("affected"))


JOURNEY = ["route_name", "direction_id", "head", "first_time", "last_time"]


def journeys(named: DataFrame) -> DataFrame:
    """named with head, the headsign put for comparison; JOURNEY are the parts of a journey's key."""
    return named.withColumn("head", alnum_name(F.col("headsign")))


def compared_journeys(named: DataFrame, left: str, right: str) -> DataFrame:
    """(JOURNEY..., left_patterns, right_patterns, shared): journeys that both feeds have and how many of their patterns are shared."""
    j = journeys(named.where(F.col("_feed").isin(left, right)))
    per = j.groupBy(*JOURNEY, "stop_print").agg(F.max((F.col("_feed") == left).cast("int")).alias("l"), F.max((F.col("_feed") == right).cast("int")).alias("r"))
    met = per.groupBy(*JOURNEY).agg(F.sum("l").alias("left_patterns"), F.sum("r").alias("right_patterns"), F.sum(F.col("l") * F.col("r")).alias("shared"))
    return met.where("left_patterns > 0 and right_patterns > 0")


def route_health(named: DataFrame, left: str, right: str) -> DataFrame:
    """(route_name, left_trips, right_trips, journeys, affected, match_pct, status) per route of either feed.

    affected are common journeys without a shared pattern; match_pct is the others' percentage, in tenths, -1 without any.
    """
    trips = named.where(F.col("_feed").isin(left, right)).groupBy("route_name").agg(F.count_if(F.col("_feed") == left).alias("left_trips"), F.count_if(F.col("_feed") == right).alias("right_trips"))
    met = compared_journeys(named, left, right).groupBy("route_name").agg(F.count("*").alias("journeys"), F.count_if(F.col("shared") == 0).alias("affected"))
    all_ = trips.join(met, "route_name", "left").fillna(0, ["journeys", "affected"])
    pct = F.when(F.col("journeys") > 0, F.floor((F.col("journeys") - F.col("affected")) * 1000 / F.col("journeys")) / 10).otherwise(F.lit(-1.0))
    status = F.when(F.col("left_trips") == 0, f"{right}_only").when(F.col("right_trips") == 0, f"{left}_only").when(F.col("journeys") == 0, "not_comparable").when(F.col("affected") > 0, "issues").otherwise("healthy")
    return all_.select("route_name", "left_trips", "right_trips", "journeys", "affected", pct.alias("match_pct"), status.alias("status"))


def contiguity_breaks(stop_times: DataFrame) -> DataFrame:
    """(_feed, trip_id, runs): trips whose rows are not together in file order (TRP001).

    A run begins where the row before, by _row in the feed, has another trip; rows before are found inside blocks of rows,
    with the last trip of the block before as its first neighbour.
    """
    rows = stop_times.select("_feed", "_row", strip("trip_id").alias("trip_id")).withColumn("_blk", F.floor(F.col("_row") / 50_000))
    w = W.partitionBy("_feed", "_blk").orderBy("_row")
    ends = rows.groupBy("_feed", "_blk").agg(F.max_by("trip_id", "_row").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(W.partitionBy("_feed").orderBy("_blk")))
    seen = rows.withColumn("_prev", F.lag("trip_id").over(w)).join(ends, ["_feed", "_blk"]).withColumn("_prev", F.coalesce("_prev", "_end"))
    return seen.where("_prev is null or _prev != trip_id").groupBy("_feed", "trip_id").agg(F.count("*").alias("runs")).where("runs > 1")


def timed_pairs(left: DataFrame, right: DataFrame, tolerance: int = 60, least: int = 2) -> DataFrame:
    """(l_trip, r_trip, anchors): trips that pass at least `least` common stops within the tolerance (timing anchors).

    left, right: (trip_id, route, stop, at).  A band join by slots of the tolerance: the right side is put in three slots.
    """
    slot = F.floor(F.col("at") / F.lit(max(tolerance, 1)))
    l = left.select(F.col("trip_id").alias("l_trip"), "route", "stop", F.col("at").alias("l_at"), slot.alias("slot"))
    r = right.select(F.col("trip_id").alias("r_trip"), "route", "stop", F.col("at").alias("r_at"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    near = l.join(r, ["route", "stop", "slot"]).where(F.abs(F.col("l_at") - F.col("r_at")) <= tolerance)
    return near.groupBy("l_trip", "r_trip").agg(F.count_distinct("stop").alias("anchors")).where(F.col("anchors") >= least)


def anchors(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, feed: str) -> DataFrame:
    """(trip_id, route, stop, at) of a feed's calls that state a departure."""
    calls = ordered_calls(stop_times.where(F.col("_feed") == feed))
    named = with_trips(calls.select("_feed", "trip_id").distinct(), trips, routes).select("trip_id", F.col("route_name").alias("route"))
    return calls.select("trip_id", "stop", seconds(F.col("departure")).alias("at")).where("at is not null and stop != ''").join(named, "trip_id")
