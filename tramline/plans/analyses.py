"""The whole analyses: one feed checked, two sources reconciled, a source audited against a release, a release built, two compared."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.common import cut, strip
from tramline.contract import DIFF_KEYS, FIELDS
from tramline.operators import audits, crosswalk, dated, inspection, patterns, reconciliation, release, releasediff, rules, sequences, service_dates
from tramline.plans import ledger
from tramline.sources import feed as source
from tramline.sources import sinks
from tramline.sources.policy import DEFAULT


def load(spark: SparkSession, path: str, feed: str, strict: bool = False) -> dict[str, DataFrame]:
    return source.strict_tables(spark, path, feed) if strict else source.tables(source.kept_records(spark, path, feed))


def validate(spark: SparkSession, path: str, feed: str = "feed", kind: str = "bus") -> DataFrame:
    """All findings of one archive: its package, its structure and, where the tables allow, the technical rules and the inspection.

    An archive that isn't there is RUN001; a part of the run that stops is RUN002 or INS999, and the other parts go on.
    """
    elsewhere = re.match("[a-z][a-z0-9+.-]+:/", path) or any(c in path for c in "*?[{")
    if not elsewhere and not os.path.exists(path):
        return audits.told(spark, "RUN001", "blocker", "Run setup", path, "does not exist")
    rows = source.kept_records(spark, path, feed)
    parts = [source.package_findings(spark, source.members(spark, path, feed)), source.structure_findings(spark, rows)]
    t = source.tables(rows)
    if {"routes", "stops", "trips", "stop_times"} <= set(t):
        if "calendar" in t or "calendar_dates" in t:
            parts.append(audits.attempted(spark, "run", feed, lambda: rules.technical(t)))
        parts.append(audits.attempted(spark, "inspection", feed, lambda: inspection.inspected(t, kind)))
    return ledger.union(parts)


def load_bundle(spark: SparkSession, path: str, label: str) -> tuple[dict[str, DataFrame] | None, DataFrame]:
    """(tables, findings) of a source: None and one of MRG001 to MRG006 if it can't be used - it isn't there, is no archive, has
    members off its root, lacks tables, has a broken member, or can't be parsed."""
    stop = lambda rule, seen: (None, audits.told(spark, rule, "blocker", "Merge inputs", label, seen))
    none = audits.told(spark, "", "info", "", "").where("false")
    if not os.path.isfile(path):
        return stop("MRG001", path)
    inside = source.members(spark, path, label).select("name", "broken").collect()  # an archive's list of members
    if any(m.name is None for m in inside):
        return stop("MRG002", path)
    odd = [m.name for m in inside if source.unsafe_name(m.name)]
    if odd:
        return stop("MRG003", ", ".join(odd[:20]))
    lacking = sorted({"routes.txt", "stops.txt", "trips.txt", "stop_times.txt", "calendar.txt", "shapes.txt"} - {m.name for m in inside})
    if lacking:
        return stop("MRG004", ", ".join(lacking))
    if any(m.broken for m in inside):
        return stop("MRG005", next(m.name for m in inside if m.broken))
    rows = source.kept_records(spark, path, label)
    bad = rows.where("bad in ('encoding', 'csv')").select("table").limit(1).collect()
    return stop("MRG006", bad[0].table) if bad else (source.tables(rows), none)


def reconciled_findings(a: dict[str, DataFrame], b: dict[str, DataFrame], final: dict[str, DataFrame] | None = None, rail: dict[str, DataFrame] | None = None, left: str = "a", right: str = "b") -> DataFrame:
    """Every finding of two sources against each other and, if given, a release and a rail source: stops, ids, schedules, patterns.

    Routes named like rail's are left out of the bus sources; the rail source is audited by date.
    """
    spark = a["trips"].sparkSession
    out = []
    bus = {left: a, right: b}
    resolved = None
    if rail and final:
        def audit() -> DataFrame:
            statuses = cut(audit_source(rail, final))
            walk = crosswalk.crosswalk(rail["stops"], final["stops"])
            changes = reconciliation.stop_changes(rail["stops"], final["stops"], rail["stop_times"], walk, ["stop_name", "stop_code"])
            ids = final["trips"].join(final["routes"].withColumn("_n", strip("route_short_name")).join(rail["routes"].select(strip("route_short_name").alias("_n")).distinct(), "_n", "left_semi").select("route_id").distinct(), "route_id", "left_semi").select(strip("trip_id").alias("trip_id"))
            return audits.rail_findings(rail, final, bus, rules.technical(rail), statuses, changes).unionByName(reconciliation.audit_findings(statuses, ids))

        out.append(audits.attempted(spark, "rail", "rail", audit))
        if {"trips", "stop_times", "stops", "calendar"} <= set(rail):
            resolved = audit_source(rail, final).where("final_trip_id is not null").select("final_trip_id")
    if rail:
        names = rail["routes"].select(strip("route_short_name"))
        a, b = reconciliation.without_routes_named(a, names), reconciliation.without_routes_named(b, names)
    got = reconcile(a, b, left, right)
    out += [audits.ambiguity_findings(a["stops"], b["stops"]), got["stops"], audits.contiguity_findings(a["stop_times"]), audits.contiguity_findings(b["stop_times"])]
    out.append(reconciliation.journey_findings(got["journeys"], got["pairs"]))
    if final:
        walk = got["crosswalk"]
        renamed = b["stops"].withColumn("_s", strip("stop_id")).join(walk.select(F.col("source_id").alias("_s"), "target_id"), "_s", "left").withColumn("stop_id", F.coalesce("target_id", "_s")).drop("_s", "target_id")
        out += [reconciliation.stops_missing(a["stops"], a["stop_times"], final["stops"]), reconciliation.stops_missing(b["stops"], b["stop_times"], final["stops"], walk, "STP003")]
        out.append(reconciliation.stops_of_no_source(final["stops"], [a["stops"], renamed, *([rail["stops"]] if rail else [])]))
        out.append(reconciliation.kept_metadata(final["stops"], [a["stops"], renamed], ["wheelchair_boarding"]))
        out.append(audits.provenance_findings(audits.provenance_sides(final, [a, b], rail, resolved)))
        out.append(reconciliation.changed_trips(named_trips(final), named_trips(a).unionByName(named_trips(b, walk))))
    return ledger.union(out)


def named_trips(t: dict[str, DataFrame], walk: DataFrame | None = None) -> DataFrame:
    return patterns.with_trips(patterns.trip_summaries(t["stop_times"], walk), t["trips"], t["routes"])


def reconcile(a: dict[str, DataFrame], b: dict[str, DataFrame], left: str = "a", right: str = "b") -> dict[str, DataFrame]:
    """Two sources against each other: stops, journeys, variations in pairs, health of routes. b's stops are put into a's by code or id.

    The tables' _feed is taken from left and right.
    """
    tag = lambda t, f: {n: df.withColumn("_feed", F.lit(f)) for n, df in t.items()}
    a, b = tag(a, left), tag(b, right)
    walk = cut(crosswalk.crosswalk(b["stops"], a["stops"]))
    named = cut(named_trips(a).unionByName(named_trips(b, walk)))
    v = patterns.variations(named)
    example = named.select("_feed", F.col("trip_id").alias("example_trip"), "stops")
    tagged = patterns.journeys(named).join(v.select("_feed", "route_name", "stop_print", "variation"), ["_feed", "route_name", "stop_print"])
    side = lambda f, n: tagged.where(F.col("_feed") == f).select(*patterns.JOURNEY, F.col("variation").alias(n)).distinct()
    links = side(left, "left").join(side(right, "right"), patterns.JOURNEY).groupBy("route_name", "left", "right").agg(F.count("*").alias("n"))
    full = v.join(example, ["_feed", "example_trip"]).select("_feed", "route_name", "variation", "direction_id", "headsigns", "stops", "trips")
    return {
        "crosswalk": walk,
        "stops": crosswalk.stop_findings(crosswalk.stop_pairs(walk, b["stops"], a["stops"])),
        "journeys": patterns.compared_journeys(named, left, right),
        "variations": full,
        "members": patterns.variation_members(named, v),
        "pairs": sequences.paired_variations(full, links, left, right),
        "routes": patterns.route_health(named, left, right),
    }


def missing_report(pairs: DataFrame, variations: DataFrame, missing_in: str, left: str = "a", right: str = "b", search: str = "") -> DataFrame:
    """(route_name, variation, kind, missing_stops): the other side's variations that `missing_in` has no pair for, or whose
    pair lacks stops; replaced stops are missing in neither."""
    there, here = ("left", "right") if missing_in == right else ("right", "left")
    other = left if missing_in == right else right
    stops = lambda f, n: variations.where(F.col("_feed") == f).select("route_name", F.col("variation").alias(n), F.col("stops").alias(f"{n}_stops"))
    both = pairs.where(F.col(there).isNotNull()).join(stops(other, there), ["route_name", there]).join(stops(missing_in, here), ["route_name", here], "left")
    lone = F.filter(F.col("rows"), lambda r: (r["status"] == "left_only") & (r["block"] != "replace"))
    paired = both.where(F.col(f"{here}_stops").isNotNull() & (F.col(f"{there}_stops") != F.col(f"{here}_stops"))).withColumn("rows", sequences.alignment(f"{there}_stops", f"{here}_stops"))
    lacking = paired.withColumn("lone", lone).where("size(lone) > 0").select("route_name", F.col(there).alias("variation"), F.lit("stops").alias("kind"), F.transform("lone", lambda r: F.col(f"{there}_stops")[r["left"]]).alias("missing_stops"))
    alone = both.where(F.col(f"{here}_stops").isNull()).select("route_name", F.col(there).alias("variation"), F.lit("variation").alias("kind"), F.col(f"{there}_stops").alias("missing_stops"))
    out = lacking.unionByName(alone)
    return out.where(F.lower(F.to_json(F.struct("route_name", "variation", "missing_stops"))).contains(search.lower())) if search else out


def missing_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count_distinct("route_name").alias("routes"), F.count("*").alias("variations"), F.coalesce(F.sum(F.size("missing_stops")), F.lit(0)).alias("stops"), F.count_if(F.col("kind") == "variation").alias("unpaired"))


def audit_source(a: dict[str, DataFrame], final: dict[str, DataFrame], tiers: tuple[str, ...] = crosswalk.TIERS, changed: str = "issues", shapes: bool = True) -> DataFrame:
    """Each trip of a source against a release, by date; the source's stops are put into the release's."""
    walk = crosswalk.crosswalk(a["stops"], final["stops"], tiers)
    window = service_dates.coverage(final["calendar"], final.get("feed_info") if "feed_start_date" in getattr(final.get("feed_info"), "columns", []) else None)
    window = window.agg(F.date_format(F.min("first"), "yyyyMMdd").alias("w1"), F.date_format(F.max("last"), "yyyyMMdd").alias("w2"))
    w1, w2 = window.first()  # one row
    return dated.dated_status(dated.dated_trips(a, walk, w1, w2), dated.dated_trips(final, None, w1, w2), changed, shapes, window)


def compare(candidate: dict[str, DataFrame], reference: dict[str, DataFrame], strict: bool = True) -> dict[str, DataFrame]:
    """Table -> keyed difference, for the tables that either release has; a table one lacks counts as empty there."""
    out = {}
    for name in DIFF_KEYS:
        a, b = candidate.get(name), reference.get(name)
        if a is None and b is None:
            continue
        a, b = (a if a is not None else b.where("false")), (b if b is not None else a.where("false"))
        fields = [f for f in FIELDS[name] if f in a.columns or f in b.columns]
        full = lambda df: df.withColumns({f: F.lit("") for f in [*fields, *DIFF_KEYS[name]] if f not in df.columns})  # noqa: B023, E731
        out[name] = releasediff.keyed_diff(full(a), full(b), name, fields, strict)
    return out


def reviewed(base: DataFrame, candidate: DataFrame) -> dict:
    """A receipt's summary: findings per severity and warnings per kind with examples."""
    found = {r.severity: r.n for r in candidate.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    return {"findings": found, "warnings": [r.asDict() for r in release.warning_groups(base).orderBy(F.col("n").desc(), "kind").collect()]}


def build(
    base: dict[str, DataFrame], other: dict[str, DataFrame], path: str, first: str, last: str, rail: dict[str, DataFrame] | None = None,
    policy: dict | None = None, order: DataFrame | None = None, allow_draft: bool = False, inputs: tuple[str, ...] = (),
) -> dict:
    """Writes a release for first..last (yyyyMMdd) and beside it a receipt, which is returned; neither may exist.

    The release is base's schedule with other's metadata where its trips match (see release.assembled()) and rail's below it.
    Warnings, or errors that the written archive has, stop the build unless a draft is allowed; so does an input archive of
    `inputs` that changes meanwhile.  If anything stops it nothing is left behind.
    """
    spark = base["trips"].sparkSession
    policy = DEFAULT | (policy or {})
    receipt = f"{path.removesuffix('.zip')}.report.json"
    for p in (path, receipt):
        if os.path.exists(p):
            raise FileExistsError(p)
    if first > last:
        raise ValueError("the window ends before it begins")
    before = {p: source.digest(p) for p in inputs}
    tables, warnings, matches = release.assembled(spark, base, other, rail, policy, first, last, order)
    # Each table is worked out once, and then written and counted.
    tables, warnings = {n: cut(df) for n, df in tables.items()}, cut(warnings)
    kinds = sorted(r.kind for r in warnings.select("kind").distinct().collect())
    if kinds and not allow_draft:
        raise ValueError(f"to be reviewed before a release is made: {', '.join(kinds)}")
    staged = f"{path}.draft.zip"
    made = []
    try:
        sinks.write_feed(tables, staged)
        found = validate(spark, staged, "release")
        summary = reviewed(warnings, found)
        if not allow_draft and any(summary["findings"].get(s) for s in ("error", "blocker")):
            raise ValueError("the release has errors")
        changed = [p for p, was in before.items() if source.digest(p) != was]
        if changed:
            raise ValueError(f"changed while it was read: {changed[0]}")
        methods = {r.method: r.n for r in matches.groupBy("method").agg(F.count_distinct("trip_id").alias("n")).collect()}
        body = {"path": path, "sha256": source.digest(staged), "window": [first, last], "inputs": before, "policy": policy, "rows": {n: df.count() for n, df in tables.items()}, "matched_trips": methods, **summary}
        os.link(staged, path)
        made.append(path)
        sinks.write_once(body, receipt)
        made.append(receipt)
        return body
    except BaseException:
        for p in made:
            os.remove(p)
        raise
    finally:
        if os.path.exists(staged):
            os.remove(staged)


def report_sheets(got: dict[str, DataFrame], a: dict[str, DataFrame], b: dict[str, DataFrame], missing_in: str, left: str = "a", right: str = "b", search: str = "") -> dict[str, DataFrame]:
    """The ten sheets of a report on what `missing_in` lacks, from reconcile(): totals, variations, and all records of the other feed behind them."""
    t, feed = (a, left) if missing_in == right else (b, right)
    report = cut(missing_report(got["pairs"], got["variations"], missing_in, left, right, search))
    spark = report.sparkSession
    totals = missing_totals(report)
    n = totals.first()
    about = spark.createDataFrame([(k, str(v)) for k, v in (("Missing in", missing_in), ("Search", search), *n.asDict().items())], "item string, value string")
    members = cut(got["members"].where(F.col("_feed") == feed).join(report.select("route_name", "variation"), ["route_name", "variation"], "left_semi").select("route_name", "variation", F.col("trip_id").alias("_t")))
    public = lambda df: df.select([c for c in df.columns if not c.startswith("_")])
    trips = t["trips"].withColumn("_t", strip("trip_id")).join(members, "_t")
    semi = lambda name, c, ids: public(t[name].withColumn("_k", strip(c)).join(ids.select(F.col(ids.columns[0]).alias("_k")).distinct(), "_k", "left_semi"))
    calls = t["stop_times"].withColumn("_t", strip("trip_id")).join(members, "_t")
    used = calls.select(strip("stop_id").alias("stop_id")).distinct()
    parents = semi("stops", "stop_id", used).select(strip("parent_station").alias("stop_id")).where("stop_id != ''")
    services = None
    for name in ("calendar", "calendar_dates"):
        if name in t:
            part = semi(name, "service_id", trips.select(strip("service_id"))).withColumn("source_table", F.lit(name))
            services = part if services is None else services.unionByName(part, allowMissingColumns=True)
    pairs = got["pairs"].join(report.select("route_name", F.col("variation").alias("left" if feed == left else "right")).distinct(), ["route_name", "left" if feed == left else "right"], "left_semi")
    return {
        "Report": about, "Variations": report.withColumn("missing_stops", F.array_join("missing_stops", ", ")), "Routes": semi("routes", "route_id", trips.select(strip("route_id"))), "Trips": public(trips),
        "Stop times": public(calls), "Stops": semi("stops", "stop_id", used.unionByName(parents)), "Shapes": semi("shapes", "shape_id", trips.select(strip("shape_id")).where("shape_id != ''")) if "shapes" in t else about.where("false"),
        "Services": services if services is not None else about.where("false"), "Missing items": report.select("route_name", "variation", F.posexplode("missing_stops").alias("place", "stop_id")), "Comparisons": pairs.withColumn("places", F.array_join("places", ", ")),
    }
