"""Review of one feed beyond the technical rules, and roll-ups per route and table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.contract import REQUIRED
from tramline.operators.service_dates import active_dates
from tramline.plans.ledger import FINDING, as_findings, finding, row_checks, union

BUS_TYPES, RAIL_TYPES = ["3", "11"], ["0", "1", "2", "5", "7", "12"]


def row_inspections(t: dict[str, DataFrame], kind: str = "bus") -> DataFrame:
    """INS001 to INS004, INS006, INS008 and INS009: blank values, names, coordinates, spans, route types; kind is bus or rail."""
    row, out = F.col("_row"), []
    for name, cols in (("agency", ["agency_name", "agency_url", "agency_timezone"]), ("feed_info", ["feed_publisher_name", "feed_publisher_url", "feed_lang"]), ("trips", ["route_id", "service_id", "trip_id"])):
        if name in t:
            key = strip("trip_id") if name == "trips" else None
            out.append(row_checks(t[name], [(strip(c) == "", finding("INS001", "error", "Technical", name, row, key, c)) for c in cols]))
    kind_of, has_place = strip("location_type"), (strip("stop_lat") != "") & (strip("stop_lon") != "")
    needs = kind_of.isin("1", "2") | (kind_of.isin("", "0") & (strip("parent_station") == ""))
    out.append(row_checks(t["stops"], [
        (kind_of.isin("", "0", "1", "2") & (strip("stop_name") == ""), finding("INS002", "error", "Technical", "stops", row, strip("stop_id"))),
        (needs & ~has_place, finding("INS003", "error", "Technical", "stops", row, strip("stop_id"))),
    ]))
    out.append(row_checks(t["calendar"], [((strip("start_date") != "") & (strip("end_date") != "") & (strip("start_date") > strip("end_date")), finding("INS004", "error", "Technical", "calendar", row, strip("service_id")))]))
    wrong = strip("route_type").isin(RAIL_TYPES if kind == "bus" else BUS_TYPES)
    out.append(row_checks(t["routes"], [
        ((strip("route_short_name") == "") & (strip("route_long_name") == ""), finding("INS006", "error", "Technical", "routes", row, strip("route_id"))),
        (wrong, finding("INS008" if kind == "bus" else "INS009", "warning", "Content scope", "routes", row, strip("route_id"), strip("route_type"))),
    ]))
    return union(out)


def routes_without_trips(t: dict[str, DataFrame]) -> DataFrame:
    """INS007."""
    used = t["trips"].select("_feed", strip("route_id").alias("k")).distinct()
    idle = t["routes"].select("_feed", "_row", strip("route_id").alias("k")).join(used, ["_feed", "k"], "left_anti")
    return as_findings(idle, *finding("INS007", "warning", "Technical", "routes", F.col("_row"), F.col("k")))


def trip_kinds(t: dict[str, DataFrame]) -> DataFrame:
    """(_feed, route_id, rule_id, trips, first_row): INS010 to INS014 per route - trips of fewer than two calls, shapes of one
    point, no shape, no headsign, no day of service."""
    trips = t["trips"].select("_feed", "_row", strip("route_id").alias("route_id"), strip("trip_id").alias("trip_id"), strip("shape_id").alias("shape_id"), strip("trip_headsign").alias("head"), strip("service_id").alias("service_id"))
    calls = t["stop_times"].groupBy("_feed", strip("trip_id").alias("trip_id")).agg(F.count("*").alias("calls"))
    points = t["shapes"].groupBy("_feed", strip("shape_id").alias("shape_id")).agg(F.count("*").alias("points"))
    days = active_dates(t["calendar"], t.get("calendar_dates")).select("_feed", "service_id").distinct().withColumn("runs", F.lit(True))
    met = trips.join(calls, ["_feed", "trip_id"], "left").join(points, ["_feed", "shape_id"], "left").join(days, ["_feed", "service_id"], "left")
    kinds = F.array_compact(F.array(
        F.when(F.coalesce("calls", F.lit(0)) < 2, F.lit("INS010")), F.when(F.col("points") == 1, F.lit("INS011")), F.when(F.col("shape_id") == "", F.lit("INS012")),
        F.when(F.col("head") == "", F.lit("INS013")), F.when(F.col("runs").isNull(), F.lit("INS014")),
    ))
    return met.select("_feed", "route_id", "_row", F.explode(kinds).alias("rule_id")).groupBy("_feed", "route_id", "rule_id").agg(F.count("*").alias("trips"), F.min("_row").alias("first_row"))


def inspected(t: dict[str, DataFrame], kind: str = "bus") -> DataFrame:
    """All findings of the inspection; a feed without calendar or shapes counts as one where they are empty."""
    none = lambda name: t["trips"].select(*[F.lit("").alias(c) for c in REQUIRED[name]], "_feed", "_row").where("false")
    t = {name: none(name) for name in ("calendar", "shapes")} | t
    return union([row_inspections(t, kind), routes_without_trips(t), kind_findings(trip_kinds(t))])


def kind_findings(kinds: DataFrame) -> DataFrame:
    """The findings of trip_kinds(): one per route and kind, at the first trip's row."""
    hard = F.col("rule_id") == "INS010"
    parts = finding("", F.when(hard, "error").otherwise("warning"), "", "trips", F.col("first_row"), F.col("route_id"), F.col("trips").cast("string"))
    return kinds.select(F.col("_feed").alias("feed"), "rule_id", F.when(hard, "Technical").otherwise("Agency review").alias("category"), *[c for c, n in zip(parts, FINDING) if n not in ("rule_id", "category")])


def route_rollup(t: dict[str, DataFrame]) -> DataFrame:
    """(_feed, route_id, trips, shapes, directions): what each route of routes has; blank shapes and directions don't count."""
    per = t["trips"].groupBy("_feed", strip("route_id").alias("route_id")).agg(F.count_distinct(strip("trip_id")).alias("trips"), F.count_distinct(F.nullif(strip("shape_id"), F.lit(""))).alias("shapes"), F.count_distinct(F.nullif(strip("direction_id"), F.lit(""))).alias("directions"))
    return t["routes"].select("_feed", strip("route_id").alias("route_id")).distinct().join(per, ["_feed", "route_id"], "left").fillna(0)


def table_inventory(t: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """(feed, table, rows) of the tables that are there, 0 for expected ones that aren't."""
    spark = next(iter(t.values())).sparkSession
    out = None
    for name, df in t.items():
        part = df.groupBy(F.col("_feed").alias("feed")).agg(F.count("*").alias("rows")).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    want = spark.createDataFrame([(e,) for e in expected], "table string")
    return out.select("feed").distinct().crossJoin(F.broadcast(want)).join(out, ["feed", "table"], "full").select("feed", "table", F.coalesce("rows", F.lit(0)).alias("rows"))


def shared_short_names(routes: DataFrame, left: str, right: str) -> DataFrame:
    """(name): short names that routes of both feeds have."""
    name = lambda f: routes.where(F.col("_feed") == f).select(strip("route_short_name").alias("name")).where("name != ''").distinct()
    return name(left).join(name(right), "name", "left_semi")
