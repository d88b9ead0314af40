"""What lies behind a finding: single records, trips side by side with a release, the parts of a variation, routes of findings."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.common import strip
from tramline.functions.scalars import coordinate, distance_m
from tramline.operators import browse
from tramline.operators.patterns import ordered_calls
from tramline.operators.rules import whole
from tramline.operators.sequences import alignment


def in_file_order(rows: DataFrame) -> DataFrame:
    """All rows in the order of the file."""
    return rows.orderBy("_feed", "_row")


def batches(rows: DataFrame, size: int = 25_000) -> Iterator[list[Row]]:
    """All rows in the order of the file, `size` at a time; partitions come one after another."""
    part: list[Row] = []
    for r in in_file_order(rows).toLocalIterator():
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def record(rows: DataFrame, feed: str, row: int) -> DataFrame:
    """The record of that number in its file; the header, number 1, is none."""
    if row < 2:
        raise ValueError("records are numbered from 2")
    return rows.where((F.col("_feed") == feed) & (F.col("_row") == row))


def sequence_order(c: Column) -> list[Column]:
    """Sort columns of a call's number as written: numbers by value, other texts after them."""
    return [F.coalesce(whole(strip(c)), F.lit(2**31 - 1)), strip(c)]


def trip_calls(stop_times: DataFrame, stops: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(_feed, trip_id, place, sequence, source_stop, stop, stop_name, arrival, departure, pickup, drop_off): every call, those
    without a number too, placed from 0 in its trip; stop is the id put into another feed's by walk."""
    from pyspark.sql import Window as W

    names = stops.groupBy("_feed", strip("stop_id").alias("source_stop")).agg(F.min_by(strip("stop_name"), "_row").alias("stop_name"))
    text = {"sequence": "stop_sequence", "source_stop": "stop_id", "arrival": "arrival_time", "departure": "departure_time", "pickup": "pickup_type", "drop_off": "drop_off_type"}
    calls = stop_times.select("_feed", "_row", strip("trip_id").alias("trip_id"), *[strip(c).alias(n) for n, c in text.items()]).join(names, ["_feed", "source_stop"], "left")
    calls = calls.withColumn("stop", F.col("source_stop"))
    if walk is not None:
        calls = calls.drop("stop").join(walk.select(F.col("source_id").alias("source_stop"), "target_id"), "source_stop", "left").withColumn("stop", F.coalesce("target_id", "source_stop"))
    w = W.partitionBy("_feed", "trip_id").orderBy(*sequence_order(F.col("sequence")), "_row")
    return calls.select("_feed", "trip_id", (F.row_number().over(w) - 1).alias("place"), "sequence", "source_stop", "stop", F.coalesce("stop_name", F.lit("")).alias("stop_name"), "arrival", "departure", "pickup", "drop_off")


def with_release(pair: list[str | None], other: list[str | None], final: list[str]) -> list[dict]:
    """A release's stops beside aligned rows of two sources: (row of the alignment or none, place in final or none, source).

    The first source's stop stands for a row, else the second's.  source tells which of the two has the release's stop there:
    both, left, right, neither, or absent if the release has none.
    """
    base = [a if a is not None else b for a, b in zip(pair, other)]
    out = []
    for _, i1, i2, j1, j2 in SequenceMatcher(None, base, final, autojunk=False).get_opcodes():
        for k in range(max(i2 - i1, j2 - j1)):
            i, j = (i1 + k if i1 + k < i2 else None), (j1 + k if j1 + k < j2 else None)
            same = [side for side, stops in (("left", pair), ("right", other)) if i is not None and j is not None and stops[i] == final[j]]
            out.append({"row": i, "final": j, "source": "absent" if j is None else "both" if len(same) == 2 else same[0] if same else "neither"})
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("row", T.IntegerType()).add("final", T.IntegerType()).add("source", T.StringType())))
def release_rows(pair: pd.Series, other: pd.Series, final: pd.Series) -> pd.Series:
    return pd.Series([with_release(list(a), list(b), list(c)) for a, b, c in zip(pair, other, final)])


def beside_release(trips: DataFrame) -> DataFrame:
    """(key, place, left_stop, right_stop, final_stop, status, source) of trips(key, left, right, final), arrays of stop ids: the
    two sources aligned with one another and the release with both; status is that of alignment(), or final_only."""
    rows = trips.withColumn("rows", alignment("left", "right"))
    at = lambda side, i: F.get(F.col(side), i)
    rows = rows.withColumn("a", F.transform("rows", lambda r: at("left", r["left"]))).withColumn("b", F.transform("rows", lambda r: at("right", r["right"])))
    met = rows.select("key", "rows", "a", "b", "final", F.posexplode(release_rows("a", "b", "final")).alias("place", "x"))
    return met.select("key", "place", F.get("a", F.col("x.row")).alias("left_stop"), F.get("b", F.col("x.row")).alias("right_stop"), F.get("final", F.col("x.final")).alias("final_stop"), F.coalesce(F.get("rows", F.col("x.row"))["status"], F.lit("final_only")).alias("status"), F.col("x.source").alias("source"))


def trip_stops(stop_times: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(_feed, trip_id, stops): the stops of each trip in order."""
    return ordered_calls(stop_times, walk).groupBy("_feed", "trip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "stop"))), lambda x: x["stop"]).alias("stops"))


def stop_evidence(pairs: DataFrame, source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """(source_id, target_id, distance_m, differs, source_record, target_record) of mapped pairs that differ (crosswalk.stop_pairs()), with
    both records as JSON."""
    rec = lambda df, name, ident: df.groupBy(strip("stop_id").alias(ident)).agg(F.min_by(F.to_json(F.struct(*[strip(c).alias(c) for c in columns])), "_row").alias(name))
    odd = pairs.where("names_differ or distance_m > 0 or size(differs) > 0")
    return odd.join(rec(source, "source_record", "source_id"), "source_id").join(rec(target, "target_record", "target_id"), "target_id").select("source_id", "target_id", "distance_m", F.array_join("differs", ",").alias("differs"), "source_record", "target_record")


def crosswalk_summary(walk: DataFrame, source: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: stops of the source, mapped ones by tier, unmapped ones, and mapped pairs whose names differ or that lie apart or differ otherwise."""
    n = source.select(strip("stop_id").alias("id")).where("id != ''").agg(F.count_distinct("id").alias("stops"))
    m = walk.agg(F.count("*").alias("mapped"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("same_id", "target_code", "shared_code")])
    p = pairs.agg(F.count_if("names_differ").alias("names_differ"), F.count_if(F.col("distance_m") > 35).alias("apart"), F.count_if(F.size("differs") > 0).alias("differ"))
    return n.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(p)).withColumn("unmapped", F.col("stops") - F.col("mapped"))  # one row each


def mapping_filter(mapped: DataFrame, text: str = "", difference: str = "") -> DataFrame:
    """Mapped stops (with source_id, target_id and differs, an array) that hold a text, whatever its case, and differ in a field."""
    out = mapped.where(F.array_contains("differs", difference)) if difference else mapped
    return browse.search(out, [c for c in out.columns if c != "differs"], text) if text else out


def status_filter(rows: DataFrame, status: str = "all") -> DataFrame:
    return rows if status == "all" else rows.where(F.col("status") == status)


def routes_of_findings(findings: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """findings with route_id: the one its context names, else that of the trips row it stands at, of the trip that is its key,
    of the trip before the key's colon, or the route that is its key; null if none tells."""
    keyed = lambda df, key, name: df.select(F.col("_feed").alias("feed"), key.alias(name), strip("route_id").alias(f"r_{name}"))
    first = t["trips"].groupBy("_feed", strip("trip_id").alias("trip_id")).agg(F.min_by(strip("route_id"), "_row").alias("route_id"))
    trips = t["trips"].where("_row is not null")
    out = findings.withColumn("_c", F.get_json_object("context", "$.route_id")).withColumn("_k", F.coalesce("key", F.lit(""))).withColumn("_h", F.substring_index("_k", ":", 1))
    by_row = trips.groupBy(F.col("_feed").alias("feed"), F.col("_row").alias("row")).agg(F.min(strip("route_id")).alias("r_row")).withColumn("file", F.lit("trips"))
    out = out.join(by_row, ["feed", "row", "file"], "left")
    out = out.join(keyed(first, F.col("trip_id"), "_k"), ["feed", "_k"], "left").join(keyed(first, F.col("trip_id"), "_h"), ["feed", "_h"], "left")
    own = t["routes"].select(F.col("_feed").alias("feed"), strip("route_id").alias("_k")).distinct().withColumn("file", F.lit("routes")).withColumn("r_own", F.col("_k"))
    out = out.join(own, ["feed", "_k", "file"], "left")
    return out.select(*findings.columns, F.nullif(F.coalesce("_c", "r_row", "r__k", "r__h", "r_own"), F.lit("")).alias("route_id"))


def route_health(named: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(feed, route_id, trips, shapes, directions, findings, status) per route of a feed, from routes_of_findings(): needs_review if a
    warning or worse names it."""
    from tramline.operators.inspection import route_rollup

    per = named.where("route_id is not null").groupBy("feed", "route_id").agg(F.count("*").alias("findings"), F.max((F.col("severity") != "info").cast("int")).alias("bad"))
    out = route_rollup(t).withColumnRenamed("_feed", "feed").join(per, ["feed", "route_id"], "left").fillna(0, ["findings", "bad"])
    return out.withColumn("status", F.when(F.col("bad") == 1, "needs_review").otherwise("no_route_findings")).drop("bad")


def variation_evidence(t: dict[str, DataFrame], catalog: DataFrame, named: DataFrame, route: str, variation: str, feed: str, trip: str | None = None) -> dict[str, DataFrame]:
    """All records of one variation: its trips, the chosen trip's calls, the stops with their stations, its shape, route and services.

    An unknown variation, or a trip that is not of it, is an error.
    """
    mine = catalog.where((F.col("_feed") == feed) & (F.col("route_name") == route) & (F.col("variation") == variation)).select("_feed", "route_name", "stop_print", "example_trip").limit(1)
    head = mine.collect()
    if not head:
        raise ValueError(f"{feed} has no variation {variation} on route {route}")
    members = named.join(mine.select("_feed", "route_name", "stop_print"), ["_feed", "route_name", "stop_print"], "left_semi").select("_feed", "trip_id").distinct()
    chosen = trip or head[0].example_trip
    if members.where(F.col("trip_id") == chosen).isEmpty():
        raise ValueError(f"the trip {chosen} is not of {variation}")
    trips = t["trips"].where(F.col("_feed") == feed).withColumn("_t", strip("trip_id")).join(members.select(F.col("trip_id").alias("_t")), "_t", "left_semi").drop("_t")
    one = trips.where(strip("trip_id") == chosen)
    meets = lambda name, c: t[name].where(F.col("_feed") == feed).withColumn("_k", strip(c)).join(one.select(strip(c).alias("_k")).distinct(), "_k", "left_semi").drop("_k")
    calls = t["stop_times"].where((F.col("_feed") == feed) & (strip("trip_id") == chosen))
    stops = t["stops"].where(F.col("_feed") == feed)
    ids = calls.select(strip("stop_id").alias("_k")).distinct()
    used = stops.withColumn("_k", strip("stop_id")).join(ids, "_k", "left_semi").drop("_k")
    above = stops.withColumn("_k", strip("stop_id")).join(used.select(strip("parent_station").alias("_k")).where("_k != ''").distinct(), "_k", "left_semi").drop("_k")
    return {
        "trips": trips, "stop_times": calls.orderBy(*sequence_order(F.col("stop_sequence"))), "stops": used.unionByName(above).distinct(), "shapes": meets("shapes", "shape_id"),
        "routes": meets("routes", "route_id"), **{n: meets(n, "service_id") for n in ("calendar", "calendar_dates") if n in t},
    }


def finding_evidence(rule: str, left: DataFrame, right: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """The evidence of one finding from its sides: of a stop rule (STP...) the two records, one row each, with their distance; of a
    trip rule (TRP...) the sides' ordered calls (see trip_calls()) aligned, and beside the release's if there is one.

    A side without rows leaves the other alone.
    """
    if rule.startswith("STP"):
        a = left.select(F.to_json(F.struct(*left.columns)).alias("left"), F.struct(*[coordinate(strip(c)).alias(c) for c in ("stop_lat", "stop_lon")]).alias("p")).limit(1)
        b = right.select(F.to_json(F.struct(*right.columns)).alias("right"), F.struct(*[coordinate(strip(c)).alias(c) for c in ("stop_lat", "stop_lon")]).alias("q")).limit(1)
        both = a.crossJoin(F.broadcast(b))  # one row each
        return both.select("left", "right", F.round(distance_m(F.col("p.stop_lat"), F.col("p.stop_lon"), F.col("q.stop_lat"), F.col("q.stop_lon")), 1).alias("distance_m"))
    gather = lambda df, n: df.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "stop"))), lambda x: x["stop"]).alias(n))
    sides = gather(left, "left").crossJoin(F.broadcast(gather(right, "right")))  # one trip each
    sides = sides.crossJoin(F.broadcast(gather(final, "final"))) if final is not None else sides.withColumn("final", F.array().cast("array<string>"))
    return beside_release(sides.withColumn("key", F.lit(rule)))


def affected_pairs(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """findings whose key names (route ¦ left ¦ right) a pair of variations that is among pairs."""
    held = pairs.where("left is not null and right is not null").select(F.concat_ws(" ¦ ", "route_name", "left", "right").alias("key")).distinct()
    return findings.join(held, "key", "left_semi")


def card_order(by: str = "attention") -> list[Column]:
    """Sort columns of routes (route_name, status, variations): those that need attention first, or with most variations, or by number."""
    from tramline.functions.scalars import number_first

    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ["issues", "ambiguous", "not_comparable", "healthy"])), F.col("status")), F.lit(0)), F.lit(9))
    return {"attention": [rank], "variations": [F.col("variations").desc()], "number": []}[by] + number_first(F.col("route_name"))
