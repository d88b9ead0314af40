"""An agency's own profile of a feed's tables: one driver for all of them, with the profile as data.

The profile says which columns must be there and filled, which values, formats and ranges they may have and which ids are
exempt; an agency's own lists are parameters.  Findings carry row and field of their own.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.contract import DAYS, ENUMS, KEYS, REQUIRED
from tramline.functions.scalars import date_of, row_label
from tramline.operators.profile import FORMATS
from tramline.operators.rules import number
from tramline.plans import ledger
from tramline.plans.ledger import as_findings, finding, row_checks, union

CATEGORY = "Agency"
#: Formats whose breach is only a warning.
SOFT = ("language", "email", "phone")


@dataclass(frozen=True)
class Profile:
    """What a table must be like. ident names its rows; allow exempts ids: column -> ids that may leave it blank."""

    table: str
    ident: str | None
    required: tuple[str, ...] = ()
    expected: tuple[str, ...] = ()
    not_yet: tuple[str, ...] = ()
    may_be_blank: tuple[str, ...] = ()
    allow: dict[str, tuple[str, ...]] = field(default_factory=dict)
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    empty: dict[str, tuple[str, ...]] = field(default_factory=dict)
    one_row: bool = False


def _given(table: str, columns: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    return {c: tuple(v for v in ENUMS[table][c] if v) for c in columns}


PROFILES = {
    "agency": Profile("agency", "agency_id", tuple(REQUIRED["agency"]), ("agency_id", "agency_lang", "agency_phone", "agency_fare_url", "agency_email"), ("cemv_support",), formats={"agency_url": "url", "agency_fare_url": "url", "agency_lang": "language", "agency_email": "email", "agency_phone": "phone"}),
    "feed_info": Profile("feed_info", None, tuple(REQUIRED["feed_info"]), ("feed_start_date", "feed_end_date", "feed_version", "feed_contact_url"), may_be_blank=("default_lang", "feed_contact_email"), formats={"feed_publisher_url": "url", "feed_contact_url": "url", "feed_lang": "language", "default_lang": "language", "feed_contact_email": "email"}, dates=("feed_start_date", "feed_end_date"), one_row=True),
    "calendar": Profile("calendar", "service_id", tuple(REQUIRED["calendar"]), values={d: ("0", "1") for d in DAYS}, dates=("start_date", "end_date")),
    "calendar_dates": Profile("calendar_dates", "service_id", tuple(REQUIRED["calendar_dates"]), values={"exception_type": ("1", "2")}, dates=("date",)),
    "routes": Profile("routes", "route_id", tuple(REQUIRED["routes"]), ("route_color", "route_text_color", "route_sort_order"), may_be_blank=("route_desc", "route_url", "route_sort_order", "network_id"), values=_given("routes", ("route_type", "continuous_pickup", "continuous_drop_off")), formats={"route_color": "colour", "route_text_color": "colour", "route_url": "url"}),
    "trips": Profile("trips", "trip_id", tuple(REQUIRED["trips"]), ("trip_headsign", "direction_id", "shape_id"), values=_given("trips", ("direction_id", "wheelchair_accessible", "bikes_allowed"))),
    "stops": Profile("stops", "stop_id", tuple(REQUIRED["stops"]), ("stop_code", "location_type", "parent_station", "wheelchair_boarding"), may_be_blank=("parent_station",), values=_given("stops", ("location_type", "wheelchair_boarding")), ranges={"stop_lat": (-90, 90), "stop_lon": (-180, 180)}),
    "stop_times": Profile("stop_times", "trip_id", tuple(REQUIRED["stop_times"]), ("pickup_type", "drop_off_type", "timepoint"), values=_given("stop_times", ("pickup_type", "drop_off_type", "timepoint"))),
    "shapes": Profile("shapes", "shape_id", tuple(REQUIRED["shapes"]), formats={"shape_pt_sequence": "digits"}, ranges={"shape_pt_lat": (-90, 90), "shape_pt_lon": (-180, 180), "shape_dist_traveled": (0, float("inf"))}),
}


def public_columns(rows: DataFrame) -> list[str]:
    """The table's own columns, without those that begin with an underscore."""
    return [c for c in rows.columns if not c.startswith("_")]


def header_findings(feeds: DataFrame, table: str, header: list[str], profile: Profile | None = None) -> DataFrame:
    """AG02 per feed (one column _feed, one row a feed): blank and repeated names are errors, as are required columns that lack;
    expected ones that lack, and ones not expected yet, are warnings; columns there as they should be are told as info."""
    told: list[tuple[str, str, str]] = []
    told += [("error", f"position {i}", "blank name") for i, h in enumerate(header, 1) if not h.strip()]
    told += [("error", h, "repeated") for h in sorted({h for h in header if h.strip() and header.count(h) > 1})]
    if not header:
        told.append(("error", "", "no header"))
    if profile:
        told += [("info", c, "there") if c in header else ("error", c, "missing") for c in profile.required]
        told += [("info", c, "there") if c in header else ("warning", c, "missing") for c in profile.expected]
        told += [("warning", c, "not expected yet") if c in header else ("info", c, "not there yet") for c in profile.not_yet]
    if not told:
        return feeds.where("false").select(F.col("_feed").alias("feed"), *finding("AG02", "info", CATEGORY, table))
    each = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit(o).alias("o")) for s, c, o in told])
    return feeds.select("_feed", F.inline(each)).select(F.col("_feed").alias("feed"), *finding("AG02", F.col("s"), CATEGORY, table, None, F.col("c"), F.col("o")))


def _values(rows: DataFrame, p: Profile, zones: list[str]) -> list[tuple[Column, list[Column]]]:
    """The checks that look at one row: blanks, values, formats, ranges, dates, columns that should be empty."""
    has = set(rows.columns)
    row = F.col("_row")
    key = row_label(strip(p.ident), row) if p.ident in has else F.concat(F.lit("row "), row.cast("string"))
    out = []

    def tell(rule: str, severity: str, c: str, holds: Column, expected: str | None = None) -> None:
        out.append((holds, finding(rule, severity, CATEGORY, p.table, row, key, F.concat(F.lit(f"{c}: "), strip(c)), expected)))

    for c in dict.fromkeys([*p.required, *p.expected]):
        if c in has and c not in p.may_be_blank:
            blank = strip(c) == ""
            tell("AG04", "error", c, blank & ~strip(p.ident).isin(*p.allow[c]) if p.allow.get(c) and p.ident else blank)
    for c, allowed in p.values.items():
        if c in has:
            tell("AG16", "error", c, (strip(c) != "") & ~strip(c).isin(*allowed), ", ".join(allowed))
    for c, f in p.formats.items():
        if c in has:
            tell("AG07", "warning" if f in SOFT else "error", c, (strip(c) != "") & ~strip(c).rlike(FORMATS[f]), f)
    for c, (low, high) in p.ranges.items():
        if c in has:
            tell("AG22", "error", c, (strip(c) != "") & ~F.coalesce(number(strip(c)).between(low, high), F.lit(False)), f"{low:g} to {high:g}")
    for c in p.dates:
        if c in has:
            tell("AG06", "error", c, (strip(c) != "") & date_of(strip(c)).isNull(), "yyyyMMdd")
    for c, allowed in p.empty.items():
        if c in has:
            tell("AG17", "error", c, ~strip(c).isin("", *allowed), "empty")
    if p.table == "agency" and "agency_timezone" in has:
        tell("AG08", "error", "agency_timezone", (strip("agency_timezone") != "") & ~strip("agency_timezone").isin(zones), "time zone")
    return out


def stale_exceptions(rows: DataFrame, p: Profile, listed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """AG19: ids that an exception names and the table of the feed no longer has, as warnings."""
    spark = rows.sparkSession
    lists = p.allow if listed is None else listed
    named = spark.createDataFrame([(c, i) for c, ids in lists.items() for i in ids], "_column string, _k string")
    every = rows.select("_feed").distinct().crossJoin(F.broadcast(named))
    lost = every.join(rows.select("_feed", strip(p.ident).alias("_k")).distinct(), ["_feed", "_k"], "left_anti")
    return as_findings(lost, *finding("AG19", "warning", CATEGORY, p.table, None, F.col("_k"), F.col("_column")))


def expected_dates(today: dt.date) -> tuple[str, str]:
    """The Friday on or after today, and the day one month after it, as yyyyMMdd; a month without that day ends sooner."""
    start = today + dt.timedelta((4 - today.weekday()) % 7)
    year, month = start.year + start.month // 12, start.month % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)).day
    return start.strftime("%Y%m%d"), start.replace(year=year, month=month, day=min(start.day, last)).strftime("%Y%m%d")


def window_checks(rows: DataFrame, table: str, today: dt.date) -> DataFrame:
    """AG10 and AG11: dates other than expected_dates(); errors in the first row of feed_info, warnings in calendar."""
    start, end = expected_dates(today)
    row = F.col("_row")
    if table == "feed_info":
        first = rows.groupBy("_feed").agg(F.min(F.struct("_row", *[strip(c).alias(c) for c in ("feed_start_date", "feed_end_date")])).alias("m")).select("_feed", "m.*")
        return row_checks(first, [(F.col(c) != want, finding("AG10", "error", CATEGORY, table, row, c, F.col(c), want)) for c, want in (("feed_start_date", start), ("feed_end_date", end))])
    key = row_label(strip("service_id"), row)
    return row_checks(rows, [((strip(c) != "") & (strip(c) != want), finding("AG11", "warning", CATEGORY, table, row, key, F.concat(F.lit(f"{c}: "), strip(c)), want)) for c, want in (("start_date", start), ("end_date", end))])


def station_checks(stops: DataFrame, no_platform: tuple[str, ...] = (), no_parent: tuple[str, ...] = (), platform: str = "platform_code") -> DataFrame:
    """AG23: stations with a parent or a platform, stops with only one of parent and platform, parents that are no station.

    Ids of no_platform may lack a platform, those of no_parent a parent; a stop whose name says OFF ONLY may lack a platform
    too.  What such an exception lets pass is told as info.
    """
    row, ident = F.col("_row"), strip("stop_id")
    station, parent, code = strip("location_type") == "1", strip("parent_station"), strip(platform)
    off = off_only(strip("stop_name"))
    known = off | (ident.isin(*no_platform) if no_platform else F.lit(False))
    lone = ident.isin(*no_parent) if no_parent else F.lit(False)
    said = lambda rule, severity, seen: finding(rule, severity, CATEGORY, "stops", row, ident, seen)
    checks = [
        (station & (parent != ""), said("AG23", "error", F.concat(F.lit("station with parent "), parent))),
        (station & (code != ""), said("AG23", "error", F.concat(F.lit("station with platform "), code))),
        (~station & (parent != "") & (code == ""), said("AG23", F.when(known, "info").otherwise("error"), F.concat(F.lit("no platform, parent "), parent))),
        (~station & (parent == "") & (code != ""), said("AG23", F.when(lone, "info").otherwise("error"), F.concat(F.lit("no parent, platform "), code))),
    ]
    held = stops.where(strip("location_type") == "1").select("_feed", ident.alias("_p")).distinct()
    lost = stops.select("_feed", parent.alias("_p")).where("_p != ''").distinct().join(held, ["_feed", "_p"], "left_anti")
    return row_checks(stops, checks).unionByName(as_findings(lost, *finding("AG23", "error", CATEGORY, "stops", None, F.col("_p"), "parent that is no station")))


def off_only(name: Column) -> Column:
    return F.upper(name).contains("OFF ONLY")


def station_summary(stops: DataFrame, platform: str = "platform_code") -> DataFrame:
    """(feed, parent, children, platforms, off_only): per station its children rows, their platforms in order and how many only let passengers off."""
    kids = stops.select("_feed", strip("parent_station").alias("parent"), F.nullif(strip(platform), F.lit("")).alias("code"), off_only(strip("stop_name")).alias("off"))
    per = kids.groupBy("_feed", "parent").agg(F.count("*").alias("children"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("platforms"), F.count_if("off").alias("off_only"))
    held = stops.where(strip("location_type") == "1").select("_feed", strip("stop_id").alias("parent")).distinct()
    return held.join(per, ["_feed", "parent"], "left").select(F.col("_feed").alias("feed"), "parent", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("platforms", F.lit("")).alias("platforms"), F.coalesce("off_only", F.lit(0)).alias("off_only"))


def feed_versions(feed_info: DataFrame) -> DataFrame:
    """(feed, versions): the distinct versions stated, to be looked at."""
    return feed_info.groupBy(F.col("_feed").alias("feed")).agg(F.array_join(F.sort_array(F.collect_set(strip("feed_version"))), ", ").alias("versions"))


def table_findings(rows: DataFrame, profile: Profile, today: dt.date | None = None, header: list[str] | None = None, feeds: DataFrame | None = None) -> DataFrame:
    """Every rule of a profile on one table (AG02 to AG12, AG14, AG16 to AG20, AG22).

    feeds: the feeds (_feed) that have the table, by default those with rows in it; one that has none is told as empty and
    gets no other finding of rows.  today switches on the checks of dates against the coming Friday.
    """
    table, has = profile.table, set(rows.columns)
    feeds = rows.select("_feed").distinct() if feeds is None else feeds
    out = [header_findings(feeds, table, public_columns(rows) if header is None else header, profile)]
    out.append(as_findings(feeds.join(rows.select("_feed").distinct(), "_feed", "left_anti"), *finding("AG03", "error", CATEGORY, table, None, None, "no rows")))
    out.append(row_checks(rows, _values(rows, profile, sorted(zoneinfo.available_timezones()))))
    key = [c for c in KEYS.get(table, []) if c in has]
    if len(key) == 1:  # one finding a repeated value
        again = rows.groupBy("_feed", strip(key[0]).alias("_k")).agg(F.count("*").alias("n")).where("n > 1")
        out.append(as_findings(again, *finding("AG05", "error", CATEGORY, table, None, F.col("_k"), F.col("n").cast("string"))))
    if profile.allow and profile.ident in has:
        out.append(stale_exceptions(rows, profile))
    if profile.one_row:
        out.append(as_findings(rows.groupBy("_feed").agg(F.count("*").alias("n")).where("n > 1"), *finding("AG09", "warning", CATEGORY, table, None, None, F.col("n").cast("string"), "one row")))
    if table == "feed_info" and "feed_version" in has:
        out.append(feed_versions(rows).select("feed", *finding("AG09", "info", CATEGORY, table, None, "feed_version", F.col("versions"))))
    if today and (table == "calendar" or table == "feed_info" and {"feed_start_date", "feed_end_date"} <= has):
        out.append(window_checks(rows, table, today))
    return union(out)


def agency_findings(t: dict[str, DataFrame], today: dt.date | None = None, changes: dict[str, dict] | None = None, no_platform: tuple[str, ...] = (), no_parent: tuple[str, ...] = ()) -> DataFrame:
    """AG01: the drivers of all nine tables. changes: table -> fields of its Profile that the agency sets otherwise.

    A table that lacks is told once per feed.
    """
    feeds = reduce(DataFrame.unionByName, [df.select("_feed") for df in t.values()]).distinct()
    out = []
    for name, profile in PROFILES.items():
        profile = replace(profile, **(changes or {}).get(name, {}))
        if name not in t:
            out.append(as_findings(feeds, *finding("AG01", "error", CATEGORY, name, None, None, "missing")))
            continue
        out.append(table_findings(t[name], profile, today, feeds=feeds))
        if name == "stops" and "platform_code" in t[name].columns:
            out.append(station_checks(t[name], no_platform, no_parent))
    return union(out)


def agency_report(findings: DataFrame, k: int = 250) -> DataFrame:
    """AG26: at most k findings per feed, table and severity, with the exact total of each in `total`; the cap is the feature."""
    return ledger.samples(findings, ["feed", "file", "severity"], k)


def located(messages: DataFrame, text: str = "message") -> DataFrame:
    """messages with row and field, taken from texts that say `row N` and `column 'x'` or begin with a field's name."""
    c = F.col(text)
    row = F.regexp_extract(c, r"\brow (\d{1,18})\b", 1)
    named = F.regexp_extract(c, r"\bcolumn '([^']+)'", 1)
    begun = F.regexp_extract(c, r"\binvalid ([a-z_]+):", 1)
    return messages.withColumn("row", F.when(row != "", row.cast("bigint"))).withColumn("field", F.when(named != "", named).when(begun != "", begun))


def final_checks(t: dict[str, DataFrame], technical: Callable[[dict[str, DataFrame]], DataFrame], external: Callable[[dict[str, DataFrame]], DataFrame] | None = None, today: dt.date | None = None) -> dict[str, DataFrame]:
    """Three engines on one release, kept apart: technical, agency and external; without an external engine that one says so.

    FINAL001, under `review`, tells per feed and engine that found errors or warnings.
    """
    found = {"technical": technical(t), "agency": agency_findings(t, today)}
    if external:
        found["external"] = external(t)
    bad = []
    for name, df in found.items():
        per = df.where("severity in ('blocker', 'error', 'warning')").groupBy("feed").agg(F.max((F.col("severity") != "warning").cast("int")).alias("hard"), F.count("*").alias("n"))
        bad.append(per.select("feed", *finding("FINAL001", F.when(F.col("hard") == 1, "error").otherwise("warning"), "Final validation", "", None, name, F.col("n").cast("string"))))
    if not external:
        feeds = found["technical"].select("feed").distinct()
        bad.append(feeds.select("feed", *finding("FINAL001", "warning", "Final validation", "", None, "external", "unavailable")))
    return found | {"review": union(bad)}
