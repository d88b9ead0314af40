"""Findings of comparing sources with each other and with a release: stops, patterns, schedules, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.contract import FAR_METRES
from tramline.functions.scalars import alnum_name, canonical_trip, coordinate, distance_m
from tramline.operators.crosswalk import one_state, untraceable
from tramline.plans.ledger import finding


def _as(df: DataFrame, parts: list[Column]) -> DataFrame:
    return df.select(F.lit(None).cast("string").alias("feed"), *parts)


def stops_missing(source: DataFrame, calls: DataFrame, final: DataFrame, walk: DataFrame | None = None, rule: str = "STP002") -> DataFrame:
    """STP002, STP003: source stops that the release lacks, by their mapped id; an error if a call uses the stop, else a warning."""
    ids = source.groupBy(strip("stop_id").alias("id")).agg(F.min(strip("stop_name")).alias("name")).where("id != ''")
    if walk is not None:
        ids = ids.join(walk.select(F.col("source_id").alias("id"), "target_id"), "id", "left").withColumn("to", F.coalesce("target_id", "id"))
    else:
        ids = ids.withColumn("to", F.col("id"))
    lost = ids.join(final.select(strip("stop_id").alias("to")).distinct(), "to", "left_anti")
    used = calls.select(strip("stop_id").alias("id")).distinct().withColumn("used", F.lit(True))
    met = lost.join(used, "id", "left")
    return _as(met, finding(rule, F.when(F.col("used"), "error").otherwise("warning"), "Stop reconciliation", "stops", None, F.col("id"), "missing", F.col("name")))


def stops_of_no_source(final: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """STP004."""
    return _as(untraceable(final, sources, "stop_id"), finding("STP004", "error", "Stop reconciliation", "stops", None, F.col("id")))


def kept_metadata(final: DataFrame, sources: list[DataFrame], columns: list[str], limit: float = FAR_METRES["final"]) -> DataFrame:
    """STP007 (name of no source), STP008 (further than `limit` from every source) and STP009 (a non-blank value of the last source not kept).

    Stops are compared under their own id; sources have ids of the release.
    """
    cols = ["stop_name", "stop_lat", "stop_lon", *columns]
    f = one_state(final, "stop_id", cols).select("stop_id", *[F.col(c).alias(f"f_{c}") for c in cols])
    each = None
    for i, s in enumerate(sources):
        part = one_state(s, "stop_id", cols).withColumn("_i", F.lit(i))
        each = part if each is None else each.unionByName(part)
    met = f.join(each, "stop_id")
    c = lambda x: coordinate(F.col(x))
    near = F.min(distance_m(c("f_stop_lat"), c("f_stop_lon"), c("stop_lat"), c("stop_lon")))
    same = F.max((alnum_name(F.col("f_stop_name")) == alnum_name(F.col("stop_name"))).cast("int"))
    per = met.groupBy("stop_id").agg(near.alias("near"), same.alias("same"), F.max("f_stop_name").alias("f_stop_name"))
    lost = met.where(F.col("_i") == len(sources) - 1).select("stop_id", F.inline(F.filter(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("want"), F.col(f"f_{x}").alias("has")) for x in columns]), lambda v: (v["want"] != "") & (v["want"] != v["has"]))))
    name = _as(per.where("same = 0"), finding("STP007", "error", "Stop reconciliation", "stops", None, F.col("stop_id"), F.col("f_stop_name")))
    far = _as(per.where(F.col("near") > limit), finding("STP008", "error", "Stop reconciliation", "stops", None, F.col("stop_id"), F.format_number("near", 1), f"at most {limit:g} m"))
    meta = _as(lost, finding("STP009", "error", "Stop reconciliation", "stops", None, F.col("stop_id"), F.concat_ws(": ", "column", "has"), F.col("want")))
    return name.unionByName(far).unionByName(meta)


def changed_trips(final: DataFrame, sources: DataFrame) -> DataFrame:
    """TRP100 (stop pattern of none of the sources' trips of its id) and TRP101 (pattern kept, schedule not).

    Both: (trip_id, service_id, stop_print, schedule_print, stop_count), as patterns.with_trips gives.
    """
    ident = canonical_trip(F.col("trip_id"), F.col("service_id")).alias("_id")
    s = sources.select(ident, F.col("stop_print").alias("s_stop"), F.col("schedule_print").alias("s_time"))
    met = final.select(ident, "trip_id", "stop_print", "schedule_print", "stop_count").join(s, "_id")
    per = met.groupBy("trip_id", "stop_count").agg(F.max((F.col("stop_print") == F.col("s_stop")).cast("int")).alias("stops"), F.max((F.col("schedule_print") == F.col("s_time")).cast("int")).alias("times"))
    rule = F.when(F.col("stops") == 0, "TRP100").otherwise("TRP101")
    return per.where("times = 0").select(F.lit(None).cast("string").alias("feed"), rule.alias("rule_id"), *finding("", "error", "Trip reconciliation", "stop_times", None, F.col("trip_id"), F.col("stop_count").cast("string"))[1:])


def journey_findings(journeys: DataFrame, pairs: DataFrame) -> DataFrame:
    """TRP102: common journeys without a shared pattern; TRP103: pairs of variations that differ and are not ambiguous."""
    key = F.concat_ws(" ¦ ", "route_name", "direction_id", "head", "first_time", "last_time")
    one = _as(journeys.where("shared = 0"), finding("TRP102", "warning", "Trip reconciliation", "stop_times", None, key, F.col("left_patterns").cast("string"), F.col("right_patterns").cast("string")))
    two = _as(pairs.where("status = 'issues'"), finding("TRP103", "warning", "Trip reconciliation", "stop_times", None, F.concat_ws(" ¦ ", "route_name", "left", "right"), F.col("difference").cast("string")))
    return one.unionByName(two)


def without_routes_named(t: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """The bundle without routes that have one of the names (one column), and without their trips."""
    out = names.select(F.col(names.columns[0]).alias("_n")).distinct()
    routes = t["routes"].withColumn("_n", strip("route_short_name"))
    gone = routes.join(out, "_n", "left_semi").select("_feed", strip("route_id").alias("_r")).distinct()
    kept = routes.join(out, "_n", "left_anti").drop("_n")
    trips = t["trips"].withColumn("_r", strip("route_id")).join(gone, ["_feed", "_r"], "left_anti").drop("_r")
    return t | {"routes": kept, "trips": trips}


def route_changes(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """RAIL005: (name, changed): fields that differ in every route of b of the same short name as a's route."""
    side = lambda df, p: df.select(strip("route_short_name").alias("name"), *[strip(f).alias(f"{p}_{f}") for f in fields]).where("name != ''").distinct()
    met = side(a, "a").join(side(b, "b"), "name")
    per = met.groupBy("name").agg(*[F.min((F.col(f"a_{f}") != F.col(f"b_{f}")).cast("int")).alias(f) for f in fields])
    changed = F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in fields]))
    return per.select("name", changed.alias("changed")).where("size(changed) > 0")


def stop_changes(source: DataFrame, final: DataFrame, calls: DataFrame, walk: DataFrame, fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """RAIL006: (stop_id, final_id, changed): used source stops that the release lacks or has with other texts or coordinates."""
    used = calls.select(strip("stop_id").alias("stop_id")).distinct()
    cols = [*fields, "stop_lat", "stop_lon"]
    s = one_state(source, "stop_id", cols).join(used, "stop_id", "left_semi").join(walk.select(F.col("source_id").alias("stop_id"), F.col("target_id").alias("final_id")), "stop_id", "left")
    f = one_state(final, "stop_id", cols).select(F.col("stop_id").alias("final_id"), *[F.col(c).alias(f"f_{c}") for c in cols])
    met = s.join(f, "final_id", "left")
    moved = lambda c: F.coalesce(F.abs(coordinate(F.col(c)) - coordinate(F.col(f"f_{c}"))) > tolerance, F.col(c) != F.col(f"f_{c}"))
    diff = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"f_{c}"), F.lit(c)) for c in fields], *[F.when(moved(c), F.lit(c)) for c in ("stop_lat", "stop_lon")]))
    changed = F.when(F.col("final_id").isNull() | F.col("f_stop_lat").isNull(), F.array(F.lit("missing"))).otherwise(diff)
    return met.select("stop_id", "final_id", changed.alias("changed")).where("size(changed) > 0")


def audit_findings(statuses: DataFrame, final_ids: DataFrame, prefix: str = "RAIL") -> DataFrame:
    """RAIL002 per source trip that is missing (error), differs or can't be verified (warning); RAIL003 per release trip that no source trip names.

    statuses: from dated.dated_status; final_ids: (trip_id).
    """
    bad = statuses.where("status in ('missing', 'issues', 'changed', 'unverifiable')")
    one = _as(bad, finding(f"{prefix}002", F.when(F.col("status") == "missing", "error").otherwise("warning"), "Source and release", "trips", None, F.col("trip_id"), F.array_join("issues", ", ")))
    named = statuses.where("final_trip_id is not null").select(F.col("final_trip_id").alias("trip_id")).distinct()
    two = _as(final_ids.select("trip_id").distinct().join(named, "trip_id", "left_anti"), finding(f"{prefix}003", "warning", "Source and release", "trips", None, F.col("trip_id")))
    return one.unionByName(two)


def pair_filter(pairs: DataFrame, presence: str = "any", places: str = "any") -> DataFrame:
    """Pairs of variations by which sides have them (both, left_only, right_only, any) and, with a column `places`, where they differ."""
    there = {"both": "left is not null and right is not null", "left_only": "right is null", "right_only": "left is null", "any": "true"}[presence]
    out = pairs.where(there)
    if places == "any" or "places" not in pairs.columns:
        return out
    return out.where(F.array_contains("places", places))
