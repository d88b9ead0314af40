"""Findings of an audit of a source against a release, of where a release's ids come from, and of runs that can't be made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.functions.scalars import canonical_trip
from tramline.operators.crosswalk import one_state
from tramline.operators.patterns import contiguity_breaks
from tramline.operators.rules import whole
from tramline.plans.ledger import COLUMNS, finding, union

ROUTE_FIELDS = ["route_type", "route_long_name", "route_color", "route_text_color", "agency_id"]


def _as(df: DataFrame, *parts) -> DataFrame:
    return df.select(F.lit(None).cast("string").alias("feed"), *parts)


def relabelled(findings: DataFrame, rule: str, category: str, label: str) -> DataFrame:
    """RAIL001: another check's findings under one rule, with the file's label and the rule they come from as context."""
    return findings.select("feed", *finding(rule, F.col("severity"), category, F.concat(F.lit(f"{label}:"), F.coalesce("file", F.lit(""))), F.col("row"), F.col("key"), None, None, {"source_rule": F.col("rule_id")}))


def _named(routes: DataFrame) -> DataFrame:
    return routes.groupBy(strip("route_id").alias("route_id")).agg(F.min_by(strip("route_short_name"), "_row").alias("name"))


def isolation_findings(bus: dict[str, DataFrame], rail_routes: DataFrame, label: str) -> DataFrame:
    """RAIL020: routes rows of a bus source that have a rail route's short name, with their number of trips."""
    names = rail_routes.select(strip("route_short_name").alias("name")).distinct()
    n = bus["trips"].groupBy(strip("route_id").alias("route_id")).agg(F.count("*").alias("n"))
    met = bus["routes"].select("_row", strip("route_id").alias("route_id"), strip("route_short_name").alias("name")).join(names, "name", "left_semi").join(n, "route_id", "left")
    return _as(met, *finding("RAIL020", "warning", "Rail isolation", "routes", F.col("_row"), F.col("route_id"), F.coalesce("n", F.lit(0)).cast("string"), None, {"route_short_name": F.col("name"), "source": F.lit(label)}))


def shared_name_findings(routes: DataFrame, rail_routes: DataFrame, rail_types: list[str]) -> DataFrame:
    """INS015: routes of a bus feed, of no rail type, whose non-blank short name a rail route has too."""
    names = rail_routes.select(strip("route_short_name").alias("name")).where("name != ''").distinct()
    met = routes.where(~strip("route_type").isin(rail_types)).select("_feed", "_row", strip("route_id").alias("k"), strip("route_short_name").alias("name")).join(names, "name", "left_semi")
    return met.select(F.col("_feed").alias("feed"), *finding("INS015", "warning", "Content scope", "routes", F.col("_row"), F.col("k"), F.col("name")))


def route_change_findings(a: DataFrame, b: DataFrame, fields: list[str] = ROUTE_FIELDS) -> DataFrame:
    """RAIL005: per pair of routes of one non-blank short name the fields that differ."""
    have = [f for f in fields if f in a.columns and f in b.columns]
    side = lambda df, p: one_state(df, "route_id", ["route_short_name", *have]).select(F.col("route_id").alias(f"{p}_id"), F.col("route_short_name").alias("name"), *[F.col(f).alias(f"{p}_{f}") for f in have]).where("name != ''")
    met = side(a, "a").join(side(b, "b"), "name").withColumn("changed", F.array_compact(F.array(*[F.when(F.col(f"a_{f}") != F.col(f"b_{f}"), F.lit(f)) for f in have]))).where("size(changed) > 0")
    return _as(met, *finding("RAIL005", "warning", "Rail comparison", "routes", None, F.concat_ws(" ↔ ", "a_id", "b_id"), F.array_join("changed", ", "), None, {"route_short_name": F.col("name"), "difference_fields": F.col("changed")}))


def stop_change_findings(changes: DataFrame) -> DataFrame:
    """RAIL006 of reconciliation.stop_changes()."""
    return _as(changes, *finding("RAIL006", "warning", "Rail comparison", "stops", None, F.col("stop_id"), F.array_join("changed", ", "), None, {"final_stop_id": F.col("final_id"), "difference_fields": F.col("changed")}))


def route_findings(source: dict[str, DataFrame], final_routes: DataFrame, statuses: DataFrame) -> DataFrame:
    """RAIL004: short names with missing trips (see dated.dated_status) that no route of the release has; RAIL008: routes without trips.

    A blank short name is a name like any other.
    """
    names = _named(source["routes"])
    trips = source["trips"].groupBy(strip("trip_id").alias("trip_id")).agg(F.min_by(strip("route_id"), "_row").alias("route_id"))
    lost = statuses.where("status = 'missing'").select("trip_id").join(trips, "trip_id").join(names, "route_id").groupBy("name").agg(F.count("*").alias("n"))
    gone = lost.join(final_routes.select(strip("route_short_name").alias("name")).distinct(), "name", "left_anti")
    idle = names.join(trips.select("route_id").distinct(), "route_id", "left_anti")
    one = _as(gone, *finding("RAIL004", "error", "Rail comparison", "routes", None, F.col("name"), F.col("n").cast("string"), None, {"route_short_name": F.col("name")}))
    return one.unionByName(_as(idle, *finding("RAIL008", "warning", "Rail validation", "routes", None, F.col("route_id"), None, None, {"route_short_name": F.col("name")})))


def route_statuses(source: dict[str, DataFrame], final: dict[str, DataFrame], statuses: DataFrame, changed: str = "issues") -> DataFrame:
    """(name, trips, matching, missing, issues, unverifiable, outside, changes, extra, status) per short name of the source.

    changes counts pairs of routes whose fields differ, extra the release's trips of that name that run and that no source trip names.
    """
    per_trip = source["trips"].groupBy(strip("trip_id").alias("trip_id")).agg(F.min_by(strip("route_id"), "_row").alias("route_id"))
    names = _named(source["routes"])
    n = lambda s: F.count_if(F.col("status") == s)
    met = names.join(per_trip, "route_id", "left").join(statuses, "trip_id", "left")
    per = met.groupBy("name").agg(F.count("trip_id").alias("trips"), n("matching").alias("matching"), n("missing").alias("missing"), n(changed).alias("issues"), n("unverifiable").alias("unverifiable"), n("outside_final_window").alias("outside"))
    differ = route_change_findings(source["routes"], final["routes"]).select(F.get_json_object("context", "$.route_short_name").alias("name")).groupBy("name").agg(F.count("*").alias("changes"))
    used = statuses.where("final_trip_id is not null").select(F.col("final_trip_id").alias("trip_id")).distinct()
    mine = final["trips"].groupBy(strip("trip_id").alias("trip_id")).agg(F.min_by(strip("route_id"), "_row").alias("route_id")).where("trip_id != ''").join(_named(final["routes"]), "route_id")
    extra = mine.join(used, "trip_id", "left_anti").groupBy("name").agg(F.count("*").alias("extra"))
    out = per.join(differ, "name", "left").join(extra, "name", "left").fillna(0, ["changes", "extra"]).withColumn("extra", F.when(F.col("outside") < F.col("trips"), F.col("extra")).otherwise(F.lit(0)))
    bad = (F.col("changes") + F.col("extra") + F.col("missing") + F.col("issues") + F.col("unverifiable") > 0) | (F.col("trips") == 0)
    return out.withColumn("status", F.when(bad, "issues").when(F.col("matching") == 0, "outside_final_window").otherwise("matching"))


def examples_of(statuses: DataFrame, trips: DataFrame, k: int = 200, buckets: int = 64) -> DataFrame:
    """(route_id, trip_id, status, issues): of each route at most k trips that neither match nor run outside, the smallest ids; the cap is the feature."""
    from pyspark.sql import Window as W

    route = trips.groupBy(strip("trip_id").alias("trip_id")).agg(F.min_by(strip("route_id"), "_row").alias("route_id"))
    bad = statuses.where("status not in ('matching', 'outside_final_window')").join(route, "trip_id").withColumn("_b", F.pmod(F.xxhash64("trip_id"), F.lit(buckets)))
    near = bad.withColumn("_i", F.row_number().over(W.partitionBy("route_id", "_b").orderBy("trip_id"))).where(F.col("_i") <= k)
    return near.withColumn("_j", F.row_number().over(W.partitionBy("route_id").orderBy("trip_id"))).where(F.col("_j") <= k).select("route_id", "trip_id", "status", F.array_join("issues", ", ").alias("issues"))


def rail_findings(source: dict[str, DataFrame], final: dict[str, DataFrame], bus: dict[str, dict[str, DataFrame]], technical: DataFrame, statuses: DataFrame, changes: DataFrame) -> DataFrame:
    """RAIL001, RAIL004, RAIL005, RAIL006, RAIL008 and RAIL020 of a rail source; RAIL002 and RAIL003 are reconciliation.audit_findings'.

    bus: label -> bundle; one without routes can't be checked, which RAIL021 tells.
    """
    out = [relabelled(technical, "RAIL001", "Rail validation", "rail"), route_findings(source, final["routes"], statuses), route_change_findings(source["routes"], final["routes"]), stop_change_findings(changes)]
    for label, t in bus.items():
        out.append(isolation_findings(t, source["routes"], label) if {"routes", "trips"} <= set(t) else told(source["routes"].sparkSession, "RAIL021", "warning", "Rail isolation", label, "overlap can't be checked"))
    return union(out)


def _ids(t: dict[str, DataFrame], name: str, c: str) -> DataFrame:
    parts = [t[n].select(strip(c).alias("id")) for n in ((name, "calendar_dates") if name == "calendar" else (name,)) if n in t and c in t[n].columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("id != ''").distinct()


def _trip_keys(trips: DataFrame) -> DataFrame:
    return trips.select(canonical_trip(strip("trip_id"), strip("service_id")).alias("id")).where("id != ''").distinct()


def provenance_sides(final: dict[str, DataFrame], sources: list[dict[str, DataFrame]], rail: dict[str, DataFrame] | None = None, resolved: DataFrame | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Entity -> (ids of the release, ids that are accounted for); trips by their id without their own service as suffix.

    Ids of rail count as accounted for, as do the release's routes of a rail route's short name, and the shapes and services
    of the release's trips in resolved (one column: trip_id), which the audit of rail has found a source for.
    """
    every = [*sources, *([rail] if rail else [])]
    both = lambda make: [make(s) for s in every]

    def union_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    routes = both(lambda s: _ids(s, "routes", "route_id"))
    trips = both(lambda s: _trip_keys(s["trips"]))
    shapes, services = both(lambda s: _ids(s, "shapes", "shape_id")), both(lambda s: _ids(s, "calendar", "service_id"))
    if rail:
        names = rail["routes"].select(strip("route_short_name").alias("name")).distinct()
        routes.append(final["routes"].select(strip("route_id").alias("id"), strip("route_short_name").alias("name")).join(names, "name", "left_semi").select("id"))
    if resolved is not None:
        linked = final["trips"].withColumn("_t", strip("trip_id")).join(resolved.select(F.col(resolved.columns[0]).alias("_t")).distinct(), "_t", "left_semi")
        trips.append(_trip_keys(linked))
        shapes.append(linked.select(strip("shape_id").alias("id")))
        services.append(linked.select(strip("service_id").alias("id")))
    return {
        "routes": (_ids(final, "routes", "route_id"), union_of(routes)), "trips": (_trip_keys(final["trips"]), union_of(trips)),
        "shapes": (_ids(final, "shapes", "shape_id"), union_of(shapes)), "calendar": (_ids(final, "calendar", "service_id"), union_of(services)),
    }


PROVENANCE = {"routes": "MRG101", "trips": "MRG102", "shapes": "MRG103", "calendar": "MRG104"}


def provenance_findings(sides: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """MRG101 to MRG104: ids of the release that are not accounted for."""
    return union([_as(ids.join(held, "id", "left_anti"), *finding(PROVENANCE[n], "error", "Merge provenance", n, None, F.col("id"))) for n, (ids, held) in sides.items()])


def ambiguity_findings(target: DataFrame, source: DataFrame) -> DataFrame:
    """STP001: codes that several rows of the target's stops have and that are ids of the source, with those stops' ids."""
    codes = target.select(strip("stop_code").alias("code"), strip("stop_id").alias("id")).where("code != ''").groupBy("code").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("ids")).where("n > 1")
    met = codes.join(source.select(strip("stop_id").alias("code")).distinct(), "code", "left_semi")
    return _as(met, *finding("STP001", "error", "Stop reconciliation", "stops", None, F.col("code"), F.col("ids"), "one stop_id"))


def contiguity_findings(stop_times: DataFrame) -> DataFrame:
    """TRP001: trips whose rows are not together in the file."""
    return contiguity_breaks(stop_times).select(F.col("_feed").alias("feed"), *finding("TRP001", "error", "Trip reconciliation", "stop_times", None, F.col("trip_id"), F.col("runs").cast("string"), "1"))


def comparable_feeds(stop_times: DataFrame) -> DataFrame:
    """(_feed): feeds none of whose trips breaks contiguity, the only ones whose trips are compared where that is asked for."""
    return stop_times.select("_feed").distinct().join(contiguity_breaks(stop_times).select("_feed").distinct(), "_feed", "left_anti")


def coverage_findings(feeds: DataFrame, windows: DataFrame) -> DataFrame:
    """INS005: feeds (_feed) whose service dates can't be established, from service_dates.coverage()."""
    lost = feeds.select("_feed").distinct().join(windows.where("first is not null and last is not null").select("_feed"), "_feed", "left_anti")
    return lost.select(F.col("_feed").alias("feed"), *finding("INS005", "warning", "Agency review", "calendar"))


def review_findings(statuses: DataFrame, trips: DataFrame, routes: DataFrame, label: str) -> DataFrame:
    """INS020: routes of a source with trips that are missing, differ or can't be verified, and how many of each kind."""
    route = trips.groupBy(strip("trip_id").alias("trip_id")).agg(F.min_by(strip("route_id"), "_row").alias("route_id"))
    bad = statuses.where("status in ('missing', 'changed', 'issues', 'unverifiable')").join(route, "trip_id").join(_named(routes), "route_id")
    per = bad.groupBy("name").agg(F.count_if(F.col("status") == "missing").alias("m"), F.count_if(F.col("status").isin("changed", "issues")).alias("c"), F.count_if(F.col("status") == "unverifiable").alias("u"))
    seen = F.format_string("%d missing, %d changed, %d unverifiable", "m", "c", "u")
    return _as(per, *finding("INS020", "warning", "Source → final", "", None, F.col("name"), seen, None, {"inspection_source": F.lit(label), "route_short_name": F.col("name")}))


def log_findings(assessed: DataFrame) -> DataFrame:
    """OIG001 of diagnostics.assessed_messages(): one per message, info where the feed confirms it."""
    c = {"assessment": F.col("assessment"), "source_severity": F.col("source_severity"), "kind": F.col("kind")}
    return _as(assessed, *finding("OIG001", F.when(F.col("assessment") == "confirmed_defect", "info").otherwise("warning"), "Export log", "log", F.col("row_id"), F.col("kind"), None, None, c))


def told(spark, rule: str, severity: str, category: str, key: str, seen: str = "") -> DataFrame:
    """One finding about a run itself: RUN001, RUN002, MRG001 to MRG006, TRP002, RAIL021, RAIL999, INS021, INS999."""
    schema = ", ".join(f"{c} {'bigint' if c == 'row' else 'string'}" for c in COLUMNS)
    row = {"rule_id": rule, "severity": severity, "category": category, "file": "", "key": key, "observed": seen}
    return spark.createDataFrame([tuple(row.get(c) for c in COLUMNS)], schema)


FAILURES = {"run": ("RUN002", "blocker", "Run setup"), "rail": ("RAIL999", "error", "Rail validation"), "inspection": ("INS999", "error", "Individual inspection"), "source": ("INS021", "error", "Source → final"), "trips": ("TRP002", "error", "Trip reconciliation")}


def attempted(spark, part: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s findings, or one finding that this part of a run stopped, so that the other parts go on."""
    try:
        out = make()
        out.limit(1).count()
        return out
    except Exception as e:  # noqa: BLE001 - whatever stops one part is reported as a finding
        rule, severity, category = FAILURES[part]
        return told(spark, rule, severity, category, label, str(e).splitlines()[0][:500] if str(e) else type(e).__name__)


def fan_in(parts: dict[str, DataFrame]) -> DataFrame:
    """The inspections of several feeds as one ledger: file and context name the feed.

    Of `final` only rules of the inspection itself stay, as its technical ones are told apart; of `rail` none of the
    technical ones, which RAIL001 repeats.
    """
    out = []
    for label, df in parts.items():
        keep = {"final": F.col("rule_id").startswith("INS"), "rail": ~F.col("rule_id").rlike("^(PKG|CSV|REL|TIME|VAL|RUN)")}.get(label, F.lit(True))
        named = df.where(keep).select("feed", *[F.concat(F.lit(f"{label}:"), F.coalesce(c, F.lit(""))).alias(c) if c == "file" else F.to_json(F.struct(F.lit(label).alias("inspection_source"), F.col("context").alias("inner"))).alias(c) if c == "context" else F.col(c) for c in COLUMNS if c != "feed"])
        out.append(named)
    return union(out)


def unordered_trips(stop_times: DataFrame) -> DataFrame:
    """(_feed, trip_id): trips whose numbers don't rise strictly in the order of the file, whose calls have to be put in order.

    The row before is found among the trip's rows; a trip's rows, unlike a feed's, are few.
    """
    from pyspark.sql import Window as W

    rows = stop_times.select("_feed", "_row", strip("trip_id").alias("trip_id"), whole(strip("stop_sequence")).alias("n")).where("n is not null and trip_id != ''")
    before = F.lag("n").over(W.partitionBy("_feed", "trip_id").orderBy("_row"))
    return rows.withColumn("b", before).where("n <= b").select("_feed", "trip_id").distinct()
