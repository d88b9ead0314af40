"""Trips of two planning sources matched in tiers of falling certainty."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tramline.common import cut, strip
from tramline.functions.scalars import seconds
from tramline.operators.patterns import ordered_calls, with_trips
from tramline.operators.service_dates import active_dates

METHODS = ["exact_pattern_and_departure", "endpoint_times_and_similar_pattern", "timing_anchors", "review_pattern", "unmatched"]


def models(t: dict[str, DataFrame], walk: DataFrame | None = None) -> DataFrame:
    """(trip_id, route, block, stops, at, start, end, dates): start is the first departure, end the arrival at the last number."""
    calls = ordered_calls(t["stop_times"], walk).groupBy("_feed", "trip_id").agg(F.sort_array(F.collect_list(F.struct("n", "stop", seconds(F.col("departure")).alias("dep"), seconds(F.col("arrival")).alias("arr"), F.col("timepoint")))).alias("c"))
    named = with_trips(calls, t["trips"], t["routes"])
    blocks = t["trips"].groupBy(strip("trip_id").alias("trip_id")).agg(F.min(strip("block_id") if "block_id" in t["trips"].columns else F.lit("")).alias("block"))
    days = active_dates(t["calendar"], t.get("calendar_dates")).groupBy("service_id").agg(F.sort_array(F.collect_set(F.date_format("date", "yyyyMMdd"))).alias("dates"))
    out = named.join(days, "service_id", "left").join(blocks, "trip_id", "left")
    last = F.element_at("c", -1)
    return out.select("trip_id", F.col("route_name").alias("route"), "block", F.transform("c", lambda x: x["stop"]).alias("stops"), F.transform("c", lambda x: x["dep"]).alias("at"), F.transform("c", lambda x: F.coalesce(x["timepoint"], F.lit("")) == "1").alias("timed"), F.col("c")[0]["dep"].alias("start"), last["arr"].alias("end"), F.coalesce("dates", F.array().cast("array<string>")).alias("dates"))


@F.pandas_udf(DoubleType())
def coverage(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the longer sequence's calls that lie in blocks both have, in order."""
    from difflib import SequenceMatcher

    return pd.Series([sum(m.size for m in SequenceMatcher(None, list(x), list(y), autojunk=False).get_matching_blocks()) / max(1, len(x), len(y)) for x, y in zip(a, b)])


def exact_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(trip_id, candidate, method) of the first tier alone: equal route, stops and first departure, and a common date."""
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in ("trip_id", "route", "start", "dates")], F.xxhash64("stops").alias("k"), F.col("stops").alias("l_stops"))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in ("trip_id", "route", "start", "dates")], F.xxhash64("stops").alias("k"), F.col("stops").alias("r_stops"))
    same = (l["k"] == r["k"]) & (F.col("l_route") == F.col("r_route")) & (F.col("l_start") == F.col("r_start"))
    return l.join(r, same).where((F.col("l_stops") == F.col("r_stops")) & F.arrays_overlap("l_dates", "r_dates")).select(F.col("l_trip_id").alias("trip_id"), F.col("r_trip_id").alias("candidate"), F.lit(METHODS[0]).alias("method"))


def match_sources(left: DataFrame, right: DataFrame, tolerance: int = 60, least: float = 0.8, sure: float = 0.9) -> DataFrame:
    """(trip_id, candidate, method): all candidates of each left trip in the first tier that has any; candidate null if none has.

    Tier 1: equal route, stops and first departure.  Tier 2: equal route, start and end, coverage of at least `sure`.  Tier
    3: at least two timing anchors within the tolerance and coverage of at least `least`, those of `sure` first; below it
    the method is review_pattern.  Every tier asks for a common date, and works only on trips the tiers before left.
    """
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    shared_day = F.arrays_overlap("l_dates", "r_dates")
    got = cut(exact_matches(left, right).select(F.col("trip_id").alias("l_trip_id"), F.col("candidate").alias("r_trip_id"), "method"))
    rest = l.join(got.select("l_trip_id").distinct(), "l_trip_id", "left_anti")
    two = rest.join(r, (F.col("l_route") == F.col("r_route")) & (F.col("l_start") == F.col("r_start")) & (F.col("l_end") == F.col("r_end"))).where(shared_day).where(coverage("l_stops", "r_stops") >= sure)
    second = cut(two.select("l_trip_id", "r_trip_id", F.lit(METHODS[1]).alias("method")))
    rest = rest.join(second.select("l_trip_id").distinct(), "l_trip_id", "left_anti")
    call = lambda df, s: df.select(f"{s}_trip_id", F.col(f"{s}_route").alias("route"), F.inline(F.arrays_zip(F.col(f"{s}_stops").alias("stop"), F.col(f"{s}_at").alias(f"{s}_t"), F.col(f"{s}_timed").alias("timed")))).where(f"timed and {s}_t is not null").withColumn("slot", F.floor(F.col(f"{s}_t") / max(tolerance, 1)))
    near = call(rest, "l").join(call(r, "r").withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))), ["route", "stop", "slot"]).where(F.abs(F.col("l_t") - F.col("r_t")) <= tolerance)
    anchored = near.groupBy("l_trip_id", "r_trip_id").agg(F.count_distinct("stop").alias("anchors")).where("anchors >= 2")
    three = anchored.join(rest.select("l_trip_id", "l_stops", "l_dates"), "l_trip_id").join(r.select("r_trip_id", "r_stops", "r_dates"), "r_trip_id").where(shared_day).withColumn("share", coverage("l_stops", "r_stops")).where(F.col("share") >= least)
    best = three.groupBy("l_trip_id").agg(F.max(F.col("share") >= sure).alias("has_sure"))
    third = three.join(best, "l_trip_id").where(~F.col("has_sure") | (F.col("share") >= sure)).select("l_trip_id", "r_trip_id", F.when(F.col("share") >= sure, METHODS[2]).otherwise(METHODS[3]).alias("method"))
    found = got.unionByName(second).unionByName(third)
    every = l.select("l_trip_id").join(found, "l_trip_id", "left")
    return every.select(F.col("l_trip_id").alias("trip_id"), F.col("r_trip_id").alias("candidate"), F.coalesce("method", F.lit(METHODS[4])).alias("method"))


def learned_blocks(matches: DataFrame, left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """(block, date, target): the right block that all uniquely matched trips of a left block and date go to, seen at least twice."""
    single = matches.where("candidate is not null").groupBy("trip_id").agg(F.min("candidate").alias("candidate"), F.count_distinct("candidate").alias("n")).where("n = 1")
    seen = single.join(left.select("trip_id", "block", "dates"), "trip_id").join(right.select(F.col("trip_id").alias("candidate"), F.col("block").alias("target"), F.col("dates").alias("d2")), "candidate").where("block != '' and target != ''")
    per = seen.select("trip_id", "block", "target", F.explode(F.array_intersect("dates", "d2")).alias("date"))
    return per.groupBy("block", "date").agg(F.min("target").alias("target"), F.count_distinct("target").alias("targets"), F.count_distinct("trip_id").alias("trips")).where(f"targets = 1 and trips >= {least}").select("block", "date", "target")


def resolved(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """matches, where a trip with a date that several candidates serve has only those that its block's known target leaves.

    Blocks are learned from unique matches of the first tier.  On a date whose block is known only candidates of the target
    stay, on other dates all that serve it; a trip is changed only if each of its dates then has exactly one candidate.
    """
    blocks = learned_blocks(matches.where(F.col("method") == METHODS[0]), left, right)
    days = left.select("trip_id", "block", F.explode("dates").alias("date")).join(blocks, ["block", "date"], "left").select("trip_id", "date", "target")
    serve = matches.select("trip_id", "candidate").distinct().join(right.select(F.col("trip_id").alias("candidate"), F.col("block").alias("own"), F.explode("dates").alias("date")), "candidate")
    wide = cut(days.join(serve, ["trip_id", "date"], "left").withColumn("stays", F.col("candidate").isNotNull() & (F.col("target").isNull() | (F.col("own") == F.col("target")))))
    per = wide.groupBy("trip_id", "date").agg(F.count("candidate").alias("n"), F.count_if("stays").alias("left_over"))
    settled = per.groupBy("trip_id").agg(F.max("n").alias("most"), F.min("left_over").alias("low"), F.max("left_over").alias("high")).where("most > 1 and low = 1 and high = 1").select("trip_id")
    told = wide.where("stays").join(settled, "trip_id", "left_semi").select("trip_id", "candidate").distinct()
    return matches.join(settled, "trip_id", "left_anti").unionByName(matches.join(told, ["trip_id", "candidate"], "left_semi"))


def date_coverage(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(trip_id, uncovered, ambiguous): dates of a trip that no candidate serves, and that several do."""
    days = matches.join(left.select("trip_id", F.explode("dates").alias("date")), "trip_id")
    serve = days.join(right.select(F.col("trip_id").alias("candidate"), F.explode("dates").alias("date"), F.lit(1).alias("one")), ["candidate", "date"], "left")
    per = serve.groupBy("trip_id", "date").agg(F.count("one").alias("n"))
    return per.groupBy("trip_id").agg(F.count_if(F.col("n") == 0).alias("uncovered"), F.count_if(F.col("n") > 1).alias("ambiguous"))
