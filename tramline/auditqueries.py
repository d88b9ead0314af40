"""Queries of audits, agency profiles, evidence and releases on the test tables, each with the SQL it is compared with."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline import feedqueries as fq
from tramline.common import cut, strip, table
from tramline.contract import FIELDS
from tramline.feedqueries import ALL, DATE, NUM, PLAIN, SEQ, feeds, found, one, x
from tramline.functions.scalars import distance_m
from tramline.operators import agency, audits, browse, crosswalk, dated, diagnostics, evidence, inspection, matcher, patterns, reconciliation, release, releasediff, rules, sequences, service_dates
from tramline.operators.crosswalk import one_state
from tramline.operators.profile import FORMATS
from tramline.plans import ledger

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Inspection and agency profile

KINDS_SQL = f"select feed, rule_id, 'trips' file, first_row as row, route_id as key, trips::varchar observed from ({fq.TRIP_KINDS_SQL})"


@query("inspected", ALL.join(f"select {fq.FIND} from ({q})" for q in (fq.INS_SQL, fq.SQL["routes_without_trips"], KINDS_SQL)))
def inspected(spark: SparkSession, d: str) -> DataFrame:
    return found(inspection.inspected(feeds(spark, d)))


@query("kind_findings", f"select feed, rule_id, case when rule_id = 'INS010' then 'error' else 'warning' end severity, case when rule_id = 'INS010' then 'Technical' else 'Agency review' end category, first_row as row, route_id as key, trips::varchar observed from ({fq.TRIP_KINDS_SQL})")
def kind_findings(spark: SparkSession, d: str) -> DataFrame:
    return inspection.kind_findings(inspection.trip_kinds(feeds(spark, d))).select("feed", "rule_id", "severity", "category", "row", "key", "observed")


TODAY = dt.date(2026, 3, 3)
#: The profiles of the test tables, with an exemption no stop has, and a column expected to hold one value.
P = {
    "stops": replace(agency.PROFILES["stops"], allow={"stop_code": ("no such stop",)}),
    "stop_times": replace(agency.PROFILES["stop_times"], empty={"timepoint": ("0",)}),
    "routes": replace(agency.PROFILES["routes"], not_yet=("agency_id", "cemv_support")),
    **{n: agency.PROFILES[n] for n in ("trips", "calendar", "shapes")},
}
COLUMNS = {
    "stops": "stop_id stop_code stop_name stop_lat stop_lon location_type parent_station wheelchair_boarding", "routes": "route_id agency_id route_short_name route_long_name route_type route_color route_text_color",
    "trips": "route_id service_id trip_id trip_headsign direction_id shape_id wheelchair_accessible bikes_allowed", "stop_times": "trip_id arrival_time departure_time stop_id stop_sequence pickup_type drop_off_type timepoint",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date", "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence",
}
_TEXT = lambda v: "'" + v.replace("'", "''") + "'"
#: A single key, of which a repeated value is one finding.
_ONE_KEY = ("stops", "routes", "trips", "calendar")


def _agency_sql(name: str) -> str:
    p, has, out = P[name], COLUMNS[name].split(), []
    key = fq._LABEL.format(x(p.ident), x(p.ident))

    def row(rule: str, severity: str, c: str, where: str) -> None:
        out.append(f"select coalesce(feed, '') feed, '{rule}' rule_id, '{severity}' severity, row_id as row, {key} as key, '{c}: ' || {x(c)} observed from {name} where {where}")

    heads = [("info", c, "there") if c in has else ("error", c, "missing") for c in p.required] + [("info", c, "there") if c in has else ("warning", c, "missing") for c in p.expected] + [("warning", c, "not expected yet") if c in has else ("info", c, "not there yet") for c in p.not_yet]
    out += [f"select distinct coalesce(feed, '') feed, 'AG02' rule_id, '{s}' severity, null::bigint as row, '{c}' as key, '{o}' observed from {name}" for s, c, o in heads]
    for c in dict.fromkeys([*p.required, *p.expected]):
        if c in has and c not in p.may_be_blank:
            row("AG04", "error", c, f"{x(c)} = ''" + (f" and {x(p.ident)} not in ({', '.join(map(_TEXT, p.allow[c]))})" if p.allow.get(c) else ""))
    for c, allowed in p.values.items():
        if c in has:
            row("AG16", "error", c, f"{x(c)} <> '' and {x(c)} not in ({', '.join(map(_TEXT, allowed))})")
    for c, f in p.formats.items():
        if c in has:
            row("AG07", "warning" if f in agency.SOFT else "error", c, f"{x(c)} <> '' and not regexp_matches({x(c)}, {_TEXT(FORMATS[f])})")
    for c, (low, high) in p.ranges.items():
        if c in has:
            row("AG22", "error", c, f"{x(c)} <> '' and not coalesce({NUM(x(c))} between {low} and {high}, false)")
    for c in p.dates:
        row("AG06", "error", c, f"{x(c)} <> '' and {DATE(x(c))} is null")
    for c, allowed in p.empty.items():
        row("AG17", "error", c, f"{x(c)} not in ('', {', '.join(map(_TEXT, allowed))})")
    if name in _ONE_KEY:
        out.append(f"select coalesce(feed, ''), 'AG05', 'error', null, {x(p.ident)}, count(*)::varchar from {name} group by 1, 5 having count(*) > 1")
    for c, ids in p.allow.items():
        out += [f"select f, 'AG19', 'warning', null, {_TEXT(i)}, '{c}' from (select distinct coalesce(feed, '') f from {name}) g where not exists (select 1 from {name} n where coalesce(n.feed, '') = g.f and {x('n.' + p.ident)} = {_TEXT(i)})" for i in ids]
    if name == "calendar":
        start, end = "20260306", "20260406"
        for c, want in (("start_date", start), ("end_date", end)):
            row("AG11", "warning", c, f"{x(c)} <> '' and {x(c)} <> '{want}'")
    return ALL.join(out)


def _agency(name: str):
    def make(spark: SparkSession, d: str) -> DataFrame:
        rows = feeds(spark, d)[name].select("_feed", "_row", *COLUMNS[name].split())
        return agency.table_findings(rows, P[name], TODAY).select("feed", "rule_id", "severity", "row", "key", "observed")

    return make


for _n in P:
    query(f"agency_{_n}", _agency_sql(_n))(_agency(_n))

_AGENCY = ALL.join(f"select feed, severity, '{n}' file, row, key, observed from ({_agency_sql(n)})" for n in ("routes", "trips", "calendar", "shapes"))
_STATUS = "select feed, file, case max(case severity when 'error' then 2 when 'warning' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'PASS WITH WARNINGS' else 'PASS' end status"


def _agency_union(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return ledger.union([agency.table_findings(t[n].select("_feed", "_row", *COLUMNS[n].split()), P[n], TODAY) for n in ("routes", "trips", "calendar", "shapes")])


@query("table_status", f"{_STATUS} from ({_AGENCY}) group by 1, 2")
def table_status(spark: SparkSession, d: str) -> DataFrame:
    from tramline.operators import profile

    return profile.status(_agency_union(spark, d))


@query("agency_report", f"select feed, file, severity, row, key, observed, total, place from (select *, count(*) over (partition by feed, file, severity) total, row_number() over (partition by feed, file, severity order by row nulls last, key, observed) place from ({_AGENCY})) where place <= 250")
def agency_report(spark: SparkSession, d: str) -> DataFrame:
    return agency.agency_report(_agency_union(spark, d)).select("feed", "file", "severity", "row", "key", "observed", "total", F.col("place").cast("bigint").alias("place"))


_OFF = f"contains(upper({x('stop_name')}), 'OFF ONLY')"
_STN, _PAR, _PLT = f"{x('location_type')} = '1'", x("parent_station"), x("stop_code")
STATION_SQL = f"""with k as (select coalesce(feed, '') feed, row_id, {x('stop_id')} k, {_STN} st, {_PAR} pa, {_PLT} pl, {_OFF} off from stops)
select feed, 'error' severity, row_id as row, k as key, 'station with parent ' || pa observed from k where st and pa <> '' union all select feed, 'error', row_id, k, 'station with platform ' || pl from k where st and pl <> ''
union all select feed, case when off then 'info' else 'error' end, row_id, k, 'no platform, parent ' || pa from k where not st and pa <> '' and pl = ''
union all select feed, 'error', row_id, k, 'no parent, platform ' || pl from k where not st and pa = '' and pl <> ''
union all select distinct feed, 'error', null, pa, 'parent that is no station' from k a where pa <> '' and not exists (select 1 from k b where b.feed = a.feed and b.st and b.k = a.pa)"""


@query("agency_stations", STATION_SQL)
def agency_stations(spark: SparkSession, d: str) -> DataFrame:
    return agency.station_checks(feeds(spark, d)["stops"], platform="stop_code").select("feed", "severity", "row", "key", "observed")


@query("station_summary", f"""with s as (select distinct coalesce(feed, '') feed, {x('stop_id')} p from stops where {_STN}), c as (select coalesce(feed, '') feed, {_PAR} p, count(*) n, list_sort(list(distinct nullif({_PLT}, ''))) pl, count(*) filter ({_OFF}) off from stops group by 1, 2)
select s.feed, s.p parent, coalesce(n, 0) children, coalesce(array_to_string(pl, ','), '') platforms, coalesce(off, 0) off_only from s left join c on c.feed = s.feed and c.p = s.p""")
def station_summary(spark: SparkSession, d: str) -> DataFrame:
    return agency.station_summary(feeds(spark, d)["stops"], "stop_code")


_ODD_FORMATS = {"route_short_name": "digits", "route_color": "colour", "route_long_name": "language", "route_id": "phone", "route_text_color": "email", "agency_id": "url"}


@query("profile_formats", ALL.join(fq._f("AG07", "routes", f"{x(c)} <> '' and not regexp_matches({x(c)}, {_TEXT(FORMATS[f])})", fq._LABEL.format(x("route_id"), x("route_id")), f"'{c}: ' || {x(c)}") for c, f in _ODD_FORMATS.items()))
def profile_formats(spark: SparkSession, d: str) -> DataFrame:
    from tramline.operators import profile

    return found(profile.formats(feeds(spark, d)["routes"], "routes", _ODD_FORMATS, "route_id"))


@query("feed_versions", f"select coalesce(feed, '') feed, array_to_string(list_sort(list(distinct {x('agency_id')})), ', ') versions from routes group by 1")
def feed_versions(spark: SparkSession, d: str) -> DataFrame:
    return agency.feed_versions(feeds(spark, d)["routes"].withColumn("feed_version", F.col("agency_id")))


# Audit of a source against a release

_FIRST = lambda t, k, c: f"(select {x(k)} k, arg_min({x(c)}, row_id) v from {t} where feed = '{{f}}' group by 1)"
_ROUTE_OF = lambda f: _FIRST("trips", "trip_id", "route_id").format(f=f)
_NAME_OF = lambda f: _FIRST("routes", "route_id", "route_short_name").format(f=f)


@query("route_findings", f"""with q as ({fq.DATED_SQL}), l as (select n.v nm, count(*) n from q join {_ROUTE_OF('cad')} r on r.k = q.trip_id join {_NAME_OF('cad')} n on n.k = r.v where q.status = 'missing' group by 1)
select 'RAIL004' rule_id, 'error' severity, nm as key, n::varchar observed from l where nm not in (select {x('route_short_name')} from routes where feed = 'hastus')
union all select 'RAIL008', 'warning', k, null from {_NAME_OF('cad')} where k not in (select v from {_ROUTE_OF('cad')})""")
def route_findings(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return audits.route_findings(one(t, "cad"), one(t, "hastus")["routes"], fq._statuses(spark, d)).select("rule_id", "severity", "key", "observed")


_RC = [f for f in audits.ROUTE_FIELDS if f in COLUMNS["routes"].split()]
_RSTATE = lambda f: f"(select k, m.* from (select {x('route_id')} k, arg_min(struct_pack(nm := {x('route_short_name')}, {', '.join(f'{c} := {x(c)}' for c in _RC)}), row_id) m from routes where feed = '{f}' and {x('route_id')} <> '' group by 1) where m.nm <> '')"
ROUTE_CHANGE_SQL = f"""select a.nm nm, a.k || ' ↔ ' || b.k as key, concat_ws(', ', {', '.join(f"case when a.{c} <> b.{c} then '{c}' end" for c in _RC)}) observed from {_RSTATE('cad')} a join {_RSTATE('hastus')} b on a.nm = b.nm where {' or '.join(f'a.{c} <> b.{c}' for c in _RC)}"""


@query("route_change_findings", f"select 'RAIL005' rule_id, key, observed from ({ROUTE_CHANGE_SQL})")
def route_change_findings(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)["routes"]
    return audits.route_change_findings(t.where("_feed = 'cad'"), t.where("_feed = 'hastus'")).select("rule_id", "key", "observed")


@query("route_statuses", f"""with q as ({fq.DATED_SQL}), m as (select n.v nm, r.k trip, q.status from {_NAME_OF('cad')} n left join {_ROUTE_OF('cad')} r on r.v = n.k left join q on q.trip_id = r.k),
p as (select nm, count(trip) trips, {', '.join(f"count(*) filter (status = '{s}') {c}" for s, c in (('matching', 'matching'), ('missing', 'missing'), ('issues', 'issues'), ('unverifiable', 'unverifiable'), ('outside_final_window', 'outside')))} from m group by 1),
c as (select nm, count(*) n from ({ROUTE_CHANGE_SQL}) group by 1), e as (select n.v nm, count(*) n from {_ROUTE_OF('hastus')} r join {_NAME_OF('hastus')} n on n.k = r.v where r.k <> '' and r.k not in (select final_trip_id from q where final_trip_id is not null) group by 1),
z as (select p.*, coalesce(c.n, 0) changes, case when outside < trips then coalesce(e.n, 0) else 0 end extra from p left join c on c.nm = p.nm left join e on e.nm = p.nm)
select nm as name, trips, matching, missing, issues, unverifiable, outside, changes, extra, case when changes + extra + missing + issues + unverifiable > 0 or trips = 0 then 'issues' when matching = 0 then 'outside_final_window' else 'matching' end status from z""")
def route_statuses(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return audits.route_statuses(one(t, "cad"), one(t, "hastus"), cut(fq._statuses(spark, d)))


@query("stop_change_findings", "select 'RAIL006' rule_id, stop_id as key, replace(changed, ',', ', ') observed from (" + fq.SQL["stop_changes"] + ")")
def stop_change_findings(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    got = reconciliation.stop_changes(one(t, "cad")["stops"], one(t, "hastus")["stops"], one(t, "cad")["stop_times"], fq._walk(spark, d), ["stop_name", "wheelchair_boarding"])
    return audits.stop_change_findings(got).select("rule_id", "key", "observed")


@query("isolation_findings", f"select 'RAIL020' rule_id, r.row_id as row, {x('r.route_id')} as key, (select count(*) from trips t where t.feed = 'cad' and {x('t.route_id')} = {x('r.route_id')})::varchar observed from routes r where r.feed = 'cad' and {x('r.route_short_name')} in (select {x('route_short_name')} from routes where feed = 'rail')")
def isolation_findings(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return audits.isolation_findings(one(t, "cad"), one(t, "rail")["routes"], "cad").select("rule_id", "row", "key", "observed")


@query("shared_name_findings", f"select feed, 'INS015' rule_id, row_id as row, {x('route_id')} as key, {x('route_short_name')} observed from routes where feed in ('cad', 'hastus') and {x('route_type')} not in ('0', '1', '2', '5', '7', '12') and {x('route_short_name')} in (select {x('route_short_name')} from routes where feed = 'rail' and {x('route_short_name')} <> '')")
def shared_name_findings(spark: SparkSession, d: str) -> DataFrame:
    r = feeds(spark, d)["routes"]
    return audits.shared_name_findings(r.where("_feed in ('cad', 'hastus')"), r.where("_feed = 'rail'"), inspection.RAIL_TYPES).select("feed", "rule_id", "row", "key", "observed")


@query("relabelled", f"select feed, 'RAIL001' rule_id, 'error' severity, 'rail:' || file file, row, key, rule_id source_rule from ({fq.TIME_SQL}) where feed = 'rail'")
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    bad = rules.table_checks(feeds(spark, d, "rail")["stop_times"], "stop_times").where("rule_id like 'TIME%'")
    return audits.relabelled(bad, "RAIL001", "Rail validation", "rail").select("feed", "rule_id", "severity", "file", "row", "key", F.get_json_object("context", "$.source_rule").alias("source_rule"))


@query("inspection_fan_in", f"select feed, rule_id, 'hastus:' || file file, row, key, 'hastus' as source from ({fq.INS_SQL}) where feed = 'hastus' union all select feed, rule_id, 'final:' || file, row, key, 'final' from ({fq.INS_SQL}) where feed = 'final'")
def inspection_fan_in(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    more = rules.table_checks(one(t, "final")["stop_times"], "stop_times")  # of a release only the inspection's own rules stay
    got = audits.fan_in({"hastus": inspection.row_inspections(one(t, "hastus")), "final": ledger.union([inspection.row_inspections(one(t, "final")), more])})
    return got.select("feed", "rule_id", "file", "row", "key", F.get_json_object("context", "$.inspection_source").alias("source"))


_CANON = lambda a="": f"case when {x(a + 'service_id')} <> '' and ends_with({x(a + 'trip_id')}, '-' || {x(a + 'service_id')}) then left({x(a + 'trip_id')}, length({x(a + 'trip_id')}) - length({x(a + 'service_id')}) - 1) else {x(a + 'trip_id')} end"
_LINKED = "(select * from trips where feed = 'hastus' and deleted_at is not null)"
_SIDES = {
    "routes": (x("route_id"), "routes", f"select {x('route_id')} from routes where feed = 'hastus' and {x('route_short_name')} in (select {x('route_short_name')} from routes where feed = 'rail')"),
    "trips": (_CANON(), "trips", f"select {_CANON()} from {_LINKED}"), "shapes": (x("shape_id"), "shapes", f"select {x('shape_id')} from {_LINKED}"), "calendar": (x("service_id"), "calendar", f"select {x('service_id')} from {_LINKED}"),
}


def _linked(t: dict[str, DataFrame]) -> DataFrame:
    """Trips of the release that an audit is taken to have found a source for: those withdrawn, by id."""
    return t["trips"].where("_feed = 'hastus' and deleted_at is not null").select(strip("trip_id").alias("trip_id"))


# Ids of withdrawn rows link every row of theirs.
_SIDES = {n: (i, tab, more.replace(_LINKED, f"(select * from trips where feed = 'hastus' and {x('trip_id')} in (select {x('trip_id')} from trips where feed = 'hastus' and deleted_at is not null))")) for n, (i, tab, more) in _SIDES.items()}


@query("provenance_findings", ALL.join(f"select distinct '{audits.PROVENANCE[n]}' rule_id, '{n}' file, {i} as key from {tab} where feed = 'hastus' and {i} <> '' and {i} not in (select {i} from {tab} where feed in ('cad', 'rail')) and {i} not in ({more})" for n, (i, tab, more) in _SIDES.items()))
def provenance_findings(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return audits.provenance_findings(audits.provenance_sides(one(t, "hastus"), [one(t, "cad")], one(t, "rail"), _linked(t))).select("rule_id", "file", "key")


@query("ambiguity_findings", f"select 'STP001' rule_id, {x('stop_id')} as key, array_to_string(list_sort(list({x('stop_id')})), ', ') observed from stops where feed = 'cad' and {x('stop_id')} <> '' and {x('stop_id')} in (select {x('stop_id')} from stops where feed = 'hastus') group by 2 having count(*) > 1")
def ambiguity_findings(spark: SparkSession, d: str) -> DataFrame:
    s = feeds(spark, d)["stops"]
    return audits.ambiguity_findings(s.where("_feed = 'cad'").withColumn("stop_code", F.col("stop_id")), s.where("_feed = 'hastus'")).select("rule_id", "key", "observed")


@query("contiguity_findings", f"select feed, 'TRP001' rule_id, trip_id as key, runs::varchar observed from ({fq.SQL['contiguity_breaks']})")
def contiguity_findings(spark: SparkSession, d: str) -> DataFrame:
    return audits.contiguity_findings(feeds(spark, d)["stop_times"]).select("feed", "rule_id", "key", "observed")


@query("comparable_feeds", f"select distinct feed from stop_times where feed not in (select feed from ({fq.SQL['contiguity_breaks']}))")
def comparable_feeds(spark: SparkSession, d: str) -> DataFrame:
    return audits.comparable_feeds(feeds(spark, d)["stop_times"]).withColumnRenamed("_feed", "feed")


@query("coverage_findings", "select distinct feed, 'INS005' rule_id from trips where feed not in (select distinct feed from calendar where feed in ('cad', 'rail'))")
def coverage_findings(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return audits.coverage_findings(t["trips"], service_dates.coverage(t["calendar"].where("_feed in ('cad', 'rail')"))).select("feed", "rule_id")


@query("review_findings", f"""with q as ({fq.DATED_SQL}), p as (select n.v nm, count(*) filter (status = 'missing') m, count(*) filter (status = 'issues') c, count(*) filter (status = 'unverifiable') u from q join {_ROUTE_OF('cad')} r on r.k = q.trip_id join {_NAME_OF('cad')} n on n.k = r.v where status in ('missing', 'issues', 'unverifiable') group by 1)
select 'INS020' rule_id, nm as key, m || ' missing, ' || c || ' changed, ' || u || ' unverifiable' observed from p""")
def review_findings(spark: SparkSession, d: str) -> DataFrame:
    t = one(feeds(spark, d), "cad")
    return audits.review_findings(fq._statuses(spark, d), t["trips"], t["routes"], "cad").select("rule_id", "key", "observed")


@query("audit_examples", f"""with q as ({fq.DATED_SQL}) select route_id, trip_id, status, issues from (select r.v route_id, q.trip_id, q.status, replace(q.issues, ',', ', ') issues, row_number() over (partition by r.v order by q.trip_id) i from q join {_ROUTE_OF('cad')} r on r.k = q.trip_id where status not in ('matching', 'outside_final_window')) where i <= 20""")
def audit_examples(spark: SparkSession, d: str) -> DataFrame:
    return audits.examples_of(fq._statuses(spark, d), feeds(spark, d, "cad")["trips"], 20)


# Logs

_LOW = "lower(strip_accents(trim(regexp_replace(coalesce(message, ''), '[\\s\\x{a0}]+', ' ', 'g'))))"
_KIND = "case " + " ".join(f"when ({' or '.join(f'contains(m, {_TEXT(p)})' for p in parts)}){' and contains(m, ' + _TEXT('is missing its') + ')' if k == 'route_colours' else ''} then '{k}'" for k, parts in diagnostics.KINDS) + " else 'unknown' end"
LOG_SQL = f"select row_id, case when regexp_matches(m, '^(warning|avertissement)\\s*:') then 'Warning' when regexp_matches(m, '^(error|erreur)\\s*:') then 'Error' else 'Unspecified' end source_severity, {_KIND} kind from (select row_id, {_LOW} m from error_warning)"


@query("log_classify", LOG_SQL)
def log_classify(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.parsed_messages(table(spark, d, "error_warning")).select("row_id", "source_severity", "kind")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages made of the feed's own rows, as the logs of the test data hardly speak of them: each trip's pattern, each stop."""
    t = feeds(spark, d)
    shape = t["trips"].where("_feed = 'hastus'").select((F.col("row_id") * 2).alias("row_id"), F.concat(F.lit("Avertissement : Parcours type ligne: "), F.substring(strip("shape_id"), F.lit(1), F.greatest(F.length(strip("shape_id")) - 4, F.lit(0))), F.lit(" Numéro: "), F.regexp_extract(strip("shape_id"), r"(\d{4})$", 1), F.lit(" : itinéraire manquant")).alias("message"))
    stop = t["stops"].where("_feed = 'rail'").select((F.col("row_id") * 2 + 1).alias("row_id"), F.concat(F.lit("Warning: Stop x"), F.col("row_id").cast("string"), F.lit(" ( "), F.translate(strip("stop_id"), "()", ""), F.lit(" ) of usage stop not station")).alias("message"))
    return diagnostics.parsed_messages(shape.unionByName(stop))


_MADE = f"""m as (select row_id * 2 row_id, case when regexp_matches({x('shape_id')}, '\\S{{1}}\\d{{4}}$') and not regexp_matches(left({x('shape_id')}, length({x('shape_id')}) - 4), '\\s') then {x('shape_id')} else '' end shape_id, '' stop_id, 'missing_itinerary' kind from trips where feed = 'hastus'
union all select row_id * 2 + 1, '', trim(translate({x('stop_id')}, '()', '')), 'stop_usage' from stops where feed = 'rail')"""
CONCERNED_SQL = f"""{_MADE}, c as (select m.row_id, coalesce(t.feed, '') feed, 'shape_id' via, {x('t.trip_id')} trip_id from m join trips t on m.shape_id <> '' and {x('t.shape_id')} = m.shape_id
union select m.row_id, coalesce(s.feed, ''), 'stop_id', {x('s.trip_id')} from m join stop_times s on m.stop_id <> '' and {x('s.stop_id')} = m.stop_id)"""


@query("concerned_trips", f"with {CONCERNED_SQL} select * from c")
def concerned_trips(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.concerned_trips(_messages(spark, d), feeds(spark, d)).withColumnRenamed("_feed", "feed")


@query("concerned_routes", f"with {CONCERNED_SQL} select distinct c.row_id, c.feed, 'trip' via, {x('t.route_id')} route_id from c join trips t on coalesce(t.feed, '') = c.feed and {x('t.trip_id')} = c.trip_id")
def concerned_routes(spark: SparkSession, d: str) -> DataFrame:
    t, m = feeds(spark, d), _messages(spark, d)
    return diagnostics.concerned_routes(m, t, diagnostics.concerned_trips(m, t)).withColumnRenamed("_feed", "feed")


@query("log_findings", f"select row_id as row, 'OIG001' rule_id, 'warning' severity, kind as key from ({LOG_SQL})")
def log_findings(spark: SparkSession, d: str) -> DataFrame:
    got = diagnostics.assessed_messages(diagnostics.parsed_messages(table(spark, d, "error_warning")), feeds(spark, d))
    return audits.log_findings(got).select("row", "rule_id", "severity", "key")


@query("diagnostic_counts", f"select m.*, (select count(*) from (select distinct feed, shape_id from ({fq.MISSING_SHAPE_SQL}))) missing_shapes, (select coalesce(sum(trips), 0)::bigint from ({fq.MISSING_SHAPE_SQL})) affected_trips from (select count(*) messages, count(*) filter (source_severity = 'Error') source_errors, count(*) filter (kind = 'unknown') unknown_messages, count(*) source_review from ({LOG_SQL})) m")
def diagnostic_counts(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    got = diagnostics.assessed_messages(diagnostics.parsed_messages(table(spark, d, "error_warning")), t)
    return diagnostics.diagnostic_counts(got, diagnostics.missing_shapes(t["trips"], t["shapes"], t["stop_times"]))


@query("unknown_messages", f"select row_id from ({LOG_SQL}) where kind = 'unknown'")
def unknown_messages(spark: SparkSession, d: str) -> DataFrame:
    got = diagnostics.assessed_messages(diagnostics.parsed_messages(table(spark, d, "error_warning")), feeds(spark, d))
    return diagnostics.by_assessment(got, "unknown").select("row_id")


@query("affected_trips", f"""with t as (select distinct coalesce(feed, '') feed, {x('route_id')} route_id, {x('shape_id')} shape_id, {x('trip_id')} trip_id, {x('service_id')} service_id from trips where {x('shape_id')} <> '')
select t.*, (select count(*) from stop_times s where coalesce(s.feed, '') = t.feed and {x('s.trip_id')} = t.trip_id) calls from t where not exists (select 1 from shapes h where coalesce(h.feed, '') = t.feed and {x('h.shape_id')} = t.shape_id)""")
def affected_trips(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.affected_trips(feeds(spark, d)).withColumnRenamed("_feed", "feed").select("feed", "route_id", "shape_id", "trip_id", "service_id", "calls")


# Patterns, numbering, evidence

_V = f"v as (select *, variation va from ({fq.VAR_SQL}))"


@query("final_variations", f"""with {fq.NAMED_SQL}, p as (select rn, pr, count(*) n from j where f = 'final' group by 1, 2), c as (select rn, pr, max((f = 'cad')::int) l, max((f = 'hastus')::int) r from j where f in ('cad', 'hastus') group by 1, 2)
select p.rn route_name, 'Final V' || row_number() over (partition by p.rn order by p.pr) variation, p.pr stop_print, n trips, case when l = 1 and r = 1 then 'both' when l = 1 then 'cad' when r = 1 then 'hastus' else 'none' end source from p left join c on c.rn = p.rn and c.pr = p.pr""".replace("p as (select f, t, c, n, row_number()", "p0 as (select f, t, c, n, row_number()").replace("from p group by 1, 2),\ntr", "from p0 group by 1, 2),\ntr"))
def final_variations(spark: SparkSession, d: str) -> DataFrame:
    named = cut(fq._named(spark, d))
    return patterns.final_variations(named, patterns.variations(named), "cad", "hastus", "final")


@query("journeys_by_variation", f"""with {fq.JOURNEY_SQL}, w as (select f, rn, pr, 'V' || row_number() over (partition by f, rn order by m.di, m.h, m.sc, m.ft, pr) va from (select f, rn, pr, arg_min(struct_pack(t := t, di := di, h := h, sc := stop_count, ft := ft), struct_pack(a := ft, b := lt, c := t)) m from j group by 1, 2, 3)),
e as (select distinct f, rn, di, {fq.NAME('h')} head, ft, lt, pr from j where f in ('cad', 'hastus'))
select e.f feed, e.rn route_name, w.va variation, count(*) comparable, sum((k.shared = 0)::int)::bigint affected from e join k on k.route_name = e.rn and k.direction_id = e.di and k.head = e.head and k.first_time = e.ft and k.last_time = e.lt join w on w.f = e.f and w.rn = e.rn and w.pr = e.pr group by 1, 2, 3""")
def journeys_by_variation(spark: SparkSession, d: str) -> DataFrame:
    named = cut(fq._named(spark, d))
    return patterns.journeys_by_variation(named, patterns.variations(named), "cad", "hastus").withColumnRenamed("_feed", "feed")


@query("variation_members", f"""with {fq.NAMED_SQL}, w as (select f, rn, pr, 'V' || row_number() over (partition by f, rn order by m.di, m.h, m.sc, m.ft, pr) va from (select f, rn, pr, arg_min(struct_pack(t := t, di := di, h := h, sc := stop_count, ft := ft), struct_pack(a := ft, b := lt, c := t)) m from j group by 1, 2, 3))
select j.f feed, j.rn route_name, w.va variation, j.t trip_id from j join w on w.f = j.f and w.rn = j.rn and w.pr = j.pr""")
def variation_members(spark: SparkSession, d: str) -> DataFrame:
    named = cut(fq._named(spark, d))
    return patterns.variation_members(named, patterns.variations(named)).withColumnRenamed("_feed", "feed")


@query("numbered_by_first", f"select feed, route_id, direction_id, shape_id, 'V' || row_number() over (partition by feed, route_id order by r, direction_id, shape_id) variation from (select coalesce(feed, '') feed, {x('route_id')} route_id, {x('direction_id')} direction_id, {x('shape_id')} shape_id, min(row_id) r from trips group by 1, 2, 3, 4)")
def numbered_by_first(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds(spark, d)["trips"].select("_row", F.col("_feed").alias("feed"), *[strip(c).alias(c) for c in ("route_id", "direction_id", "shape_id")])
    return patterns.numbered_by_first(rows, ["feed", "route_id"], ["direction_id", "shape_id"], "V")


@query("unordered_trips", f"select distinct feed, t trip_id from (select coalesce(feed, '') feed, {x('trip_id')} t, {SEQ} n, lag({SEQ}) over (partition by coalesce(feed, ''), {x('trip_id')} order by row_id) b from stop_times where {SEQ} is not null and {x('trip_id')} <> '') where n <= b")
def unordered_trips(spark: SparkSession, d: str) -> DataFrame:
    return audits.unordered_trips(feeds(spark, d)["stop_times"]).withColumnRenamed("_feed", "feed")


@query("trip_calls", f"""with n as (select coalesce(feed, '') f, {x('stop_id')} k, arg_min({x('stop_name')}, row_id) nm from stops group by 1, 2)
select coalesce(s.feed, '') feed, {x('s.trip_id')} trip_id, row_number() over (partition by coalesce(s.feed, ''), {x('s.trip_id')} order by coalesce({SEQ}, 2147483647), {x('stop_sequence')}, s.row_id) - 1 place, {x('s.stop_id')} stop, coalesce(n.nm, '') stop_name, {x('arrival_time')} arrival from stop_times s left join n on n.f = coalesce(s.feed, '') and n.k = {x('s.stop_id')}""")
def trip_calls(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return evidence.trip_calls(t["stop_times"], t["stops"]).select(F.col("_feed").alias("feed"), "trip_id", F.col("place").cast("bigint").alias("place"), "stop", "stop_name", "arrival")


@query("record", "select row_id, trip_id from trips where feed = 'cad' and row_id = 7")
def record(spark: SparkSession, d: str) -> DataFrame:
    return evidence.record(feeds(spark, d)["trips"], "cad", 7).select("row_id", "trip_id")


@query("rows_in_order", "select feed, row_id from routes order by feed, row_id")
def rows_in_order(spark: SparkSession, d: str) -> DataFrame:
    return evidence.in_file_order(feeds(spark, d)["routes"]).select("feed", "row_id")


@query("finding_routes", f"""with t as (select coalesce(feed, '') f, {x('trip_id')} k, arg_min({x('route_id')}, row_id) r from trips group by 1, 2), q as ({fq.TIME_SQL}) select q.feed, q.rule_id, q.row, q.key, nullif(coalesce(a.r, b.r), '') route_id from q left join t a on a.f = q.feed and a.k = q.key left join t b on b.f = q.feed and b.k = split_part(q.key, ':', 1)""")
def finding_routes(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    bad = rules.table_checks(t["stop_times"], "stop_times").where("rule_id like 'TIME%'")
    return evidence.routes_of_findings(bad, t).select("feed", "rule_id", "row", "key", "route_id")


@query("beside_release")
def beside_release(spark: SparkSession, d: str) -> DataFrame:
    """The sources' trips of one id that differ, and beside them a release that has the first source's."""
    s = cut(evidence.trip_stops(feeds(spark, d, "cad", "hastus")["stop_times"]))
    side = lambda f, n: s.where(F.col("_feed") == f).select(F.col("trip_id").alias("key"), F.col("stops").alias(n))
    both = side("cad", "left").join(side("hastus", "right"), "key").where("left != right")
    return evidence.beside_release(both.withColumn("final", F.col("left")))


_HELD = "(select k, m.* from (select {k} k, arg_min(struct_pack(la := {la}, lo := {lo}), row_id) m from stops where feed = '{f}' and {k} <> '' group by 1))"
_SPOT = lambda f: _HELD.format(k=x("stop_id"), la=x("stop_lat"), lo=x("stop_lon"), f=f)


@query("haversine_pairs", f"select a.k stop_id, round({fq._HAV('a', 'b')}, 3) metres from {_SPOT('cad')} a join {_SPOT('hastus')} b on a.k = b.k")
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    from tramline.functions.scalars import coordinate

    s = feeds(spark, d)["stops"]
    side = lambda f, p: one_state(s.where(F.col("_feed") == f), "stop_id", ["stop_lat", "stop_lon"]).select("stop_id", *[coordinate(F.col(c)).alias(f"{p}{c}") for c in ("stop_lat", "stop_lon")])
    both = side("cad", "a").join(side("hastus", "b"), "stop_id")
    return both.select("stop_id", F.round(distance_m(F.col("astop_lat"), F.col("astop_lon"), F.col("bstop_lat"), F.col("bstop_lon")), 3).alias("metres"))


@query("crosswalk_summary", f"""with w as ({fq.WALK_SQL}), p as ({fq.STP_SQL}) select (select count(distinct {x('stop_id')}) from stops where feed = 'cad' and {x('stop_id')} <> '') stops, (select count(*) from w) mapped, (select count(*) filter (tier = 'same_id') from w) same_id, (select count(*) filter (tier = 'target_code') from w) target_code, (select count(*) filter (tier = 'shared_code') from w) shared_code,
(select count(*) filter (rule_id = 'STP005') from p) names_differ, (select count(*) filter (rule_id = 'STP006') from p) apart, (select count(*) filter (rule_id = 'STP010') from p) differ, (select count(distinct {x('stop_id')}) from stops where feed = 'cad' and {x('stop_id')} <> '') - (select count(*) from w) unmapped""")
def crosswalk_summary(spark: SparkSession, d: str) -> DataFrame:
    s, walk = feeds(spark, d)["stops"], cut(fq._walk(spark, d))
    a, b = s.where("_feed = 'cad'"), s.where("_feed = 'hastus'")
    return evidence.crosswalk_summary(walk, a, crosswalk.stop_pairs(walk, a, b))


@query("mapping_filter", f"select source_id, target_id from ({fq.PAIR_SQL}) where wheelchair_differs and (contains(lower(source_id), '7') or contains(lower(target_id), '7'))")
def mapping_filter(spark: SparkSession, d: str) -> DataFrame:
    s = feeds(spark, d)["stops"]
    pairs = crosswalk.stop_pairs(fq._walk(spark, d), s.where("_feed = 'cad'"), s.where("_feed = 'hastus'")).select("source_id", "target_id", "differs")
    return evidence.mapping_filter(pairs, "7", "wheelchair_boarding").select("source_id", "target_id")


@query("status_filter", f"select trip_id from ({fq.DATED_SQL}) where status = 'issues'")
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    return evidence.status_filter(fq._statuses(spark, d), "issues").select("trip_id")


@query("journey_disagreements", f"with {fq.JOURNEY_SQL} select 'TRP102' rule_id, concat_ws(' ¦ ', route_name, direction_id, head, first_time, last_time) as key, left_patterns::varchar observed from k where shared = 0")
def journey_disagreements(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], sequences.PAIRS)
    return reconciliation.journey_findings(patterns.compared_journeys(fq._named(spark, d), "cad", "hastus"), none).select("rule_id", "key", "observed")


@query("greedy_pairing")
def greedy_pairing(spark: SparkSession, d: str) -> DataFrame:
    return fq.variation_pairs(spark, d).withColumn("places", F.array_join("places", ",")).orderBy("route_name", *sequences.pair_order())


@query("severity_decision", f"""with e as (select feed, case when rule_id = 'REL010' then 'warning' else 'error' end s from ({fq.TECHNICAL_SQL})), n as (select feed, count(*) filter (s = 'blocker') blockers, count(*) filter (s = 'error') errors, count(*) filter (s = 'warning') warnings, count(*) filter (s = 'info') infos from e group by 1)
select *, case when blockers > 0 then 'BLOCKED' when errors + warnings > 0 then 'NEEDS REVIEW' else 'ELIGIBLE FOR APPROVAL' end decision from n""")
def severity_decision(spark: SparkSession, d: str) -> DataFrame:
    return ledger.decision(rules.technical(feeds(spark, d)))


@query("decisions_by_table", f"""with e as (select file feed, severity s from ({_AGENCY})), n as (select feed, count(*) filter (s = 'blocker') blockers, count(*) filter (s = 'error') errors, count(*) filter (s = 'warning') warnings, count(*) filter (s = 'info') infos from e group by 1) select *, case when blockers > 0 then 'BLOCKED' when errors + warnings > 0 then 'NEEDS REVIEW' else 'ELIGIBLE FOR APPROVAL' end decision from n""")
def decisions_by_table(spark: SparkSession, d: str) -> DataFrame:
    """Decisions as if each table were a feed, some of which only have warnings and infos."""
    return ledger.decision(_agency_union(spark, d).withColumn("feed", F.col("file")))


# A release

_KEPT = f"""(select t.* from trips t left join (select {x('route_id')} r, min({x('route_short_name')}) nm from routes where feed = 'cad' group by 1) r on r.r = {x('t.route_id')} where t.feed = 'cad' and coalesce(nm, '') not in ('47') and not (regexp_full_match(coalesce(nm, ''), '[0-9]{{1,9}}') and try_cast(nm as int) between 200 and 499 and {x('t.direction_id')} <> '0'))"""
POLICY = {"exclude_routes": ["47"], "direction_rules": [{"route_min": 200, "route_max": 499, "keep": ["0"]}], "clear_block_ids": []}


def _release(spark: SparkSession, d: str) -> tuple[dict, dict, DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """(base, other, kept trips, matches, models); matches are those of the first tier, which SQL can tell."""
    t = feeds(spark, d)
    base, other = one(t, "cad"), one(t, "hastus")
    kept = cut(release.kept_trips(base, POLICY))
    l, r = cut(matcher.models(base | {"trips": kept})), cut(matcher.models(other))
    exact = matcher.exact_matches(l, r)
    matches = l.select("trip_id").join(exact, "trip_id", "left").withColumn("method", F.coalesce("method", F.lit(matcher.METHODS[-1])))
    return base, other, kept, cut(matches), (l, r)


_TIERS = fq.TIER_SQL
_PAIRS = "(select distinct trip_id t, candidate c from q)"
_OTHER = lambda fields: f"(select {x('trip_id')} t, arg_min(struct_pack({', '.join(f'{f} := {x(f)}' for f in fields)}), row_id) m from trips where feed = 'hastus' group by 1)"
_TAKE = lambda f: f"case when g.{f} is not null then g.{f} else {x('k.' + f)} end {f}"


@query("release_trips", f"""with {_TIERS}, o as (select p.t, {', '.join(f"case when min(u.m.{f}) = max(u.m.{f}) then min(u.m.{f}) end {f}" for f in release.TRIP_FIELDS)} from {_PAIRS} p join {_OTHER(release.TRIP_FIELDS)} u on u.t = p.c group by 1)
select k.row_id, {x('k.trip_id')} trip_id, {', '.join(_TAKE(f) for f in release.TRIP_FIELDS)} from {_KEPT} k left join o g on g.t = {x('k.trip_id')}""")
def release_trips(spark: SparkSession, d: str) -> DataFrame:
    _, other, kept, matches, _ = _release(spark, d)
    return release.enriched_trips(kept, matches, other["trips"], [])[0].select(F.col("_row").alias("row_id"), "trip_id", *release.TRIP_FIELDS)


_PLACED = lambda f: f"(select *, row_number() over (partition by t order by n) - 1 place from (select {x('trip_id')} t, {SEQ} n, min(row_id) r, arg_min(case when {x('pickup_type')} = '' then '0' else {x('pickup_type')} end, row_id) pk from stop_times where feed = '{f}' and {SEQ} is not null and {x('trip_id')} <> '' group by 1, 2))"


@query("release_stop_times", f"""with {_TIERS}, w as (select p.t, h.place, case when min(h.pk) = max(h.pk) and count(distinct p.c) = (select count(*) from {_PAIRS} z where z.t = p.t) then min(h.pk) end pk from {_PAIRS} p join {_PLACED('hastus')} h on h.t = p.c group by 1, 2)
select s.row_id, {x('s.trip_id')} trip_id, coalesce(w.pk, {x('s.pickup_type')}) pickup_type, '' stop_headsign from stop_times s left join {_PLACED('cad')} a on a.r = s.row_id left join w on w.t = a.t and w.place = a.place
where s.feed = 'cad' and {SEQ} is not null and {x('s.trip_id')} <> '' and {x('s.trip_id')} in (select {x('trip_id')} from {_KEPT})""")
def release_stop_times(spark: SparkSession, d: str) -> DataFrame:
    base, other, kept, matches, (l, r) = _release(spark, d)
    got = release.enriched_calls(base["stop_times"], kept.select(strip("trip_id").alias("trip_id")), matches, release.aligned_calls(matches, l, r, 60), other["stop_times"])[0]
    return got.select(F.col("_row").alias("row_id"), "trip_id", "pickup_type", "stop_headsign")


_RF = [f for f in FIELDS["routes"] if f not in ("route_id", "route_short_name", "route_sort_order") and f in COLUMNS["routes"].split()]


@query("release_routes", f"""with g as (select {x('route_short_name')} nm, {', '.join(f"case when min({x(f)}) = max({x(f)}) then min({x(f)}) end {f}" for f in _RF)} from routes where feed = 'hastus' group by 1)
select k.row_id, {x('k.route_id')} route_id, {', '.join(_TAKE(f) for f in _RF)}, coalesce((select max({x('route_type')}) from routes z where z.feed = 'rail' and {x('z.route_short_name')} = {x('k.route_short_name')}), '') route_sort_order from routes k left join g on g.nm = {x('k.route_short_name')} where k.feed = 'cad' and {x('k.route_id')} in (select {x('route_id')} from {_KEPT})""")
def release_routes(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    kept = release.kept_trips(one(t, "cad"), POLICY)
    order = t["routes"].where("_feed = 'rail'").select("route_short_name", F.col("route_type").alias("route_sort_order"))
    got = release.enriched_routes(one(t, "cad")["routes"], kept.select(strip("route_id").alias("route_id")), one(t, "hastus")["routes"], order)[0]
    return got.select(F.col("_row").alias("row_id"), "route_id", *_RF, "route_sort_order")


_SF = ["stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"]
_VALUE = lambda v: f"case when regexp_full_match({v}, '[+-]?[0-9]+(\\.[0-9]+)?') then cast({v} as decimal(38, 18))::double::varchar else {v} end"
_UP = f"""w as (select {x('stop_id')} s, c.id t from (select distinct stop_id from stops where feed = 'hastus' and {x('stop_id')} <> '') h join {fq._UNIQUE('cad')} c on c.code = {x('stop_id')})"""


@query("release_stops", f"""with {_UP}, b as (select {x('stop_id')} k, arg_min(struct_pack(la := {x('stop_lat')}, lo := {x('stop_lon')}), row_id) m from stops where feed = 'cad' and {x('stop_id')} <> '' group by 1),
a as (select 0 o, s.row_id r, coalesce(w.t, {x('s.stop_id')}) id, {x('s.stop_name')} stop_name, coalesce(b.m.la, {x('s.stop_lat')}) stop_lat, coalesce(b.m.lo, {x('s.stop_lon')}) stop_lon, {x('s.location_type')} location_type, coalesce(u.t, {x('s.parent_station')}) parent_station
 from stops s left join w on w.s = {x('s.stop_id')} left join b on b.k = coalesce(w.t, {x('s.stop_id')}) left join w u on u.s = {x('s.parent_station')} where s.feed = 'hastus' and (b.k is not null or {x('s.location_type')} = '1')
 union all select 1, row_id, {x('stop_id')}, {', '.join(x(f) for f in _SF)} from stops where feed = 'rail' union all select 2, row_id, {x('stop_id')}, {', '.join(x(f) for f in _SF)} from stops where feed = 'cad' and {x('stop_id')} in (select {x('stop_id')} from stop_times where feed = 'cad')),
f as (select *, row_number() over (partition by id order by o, r desc) i from a where id <> '') select id stop_id, r row_id, stop_name, {_VALUE('stop_lat')} stop_lat, {_VALUE('stop_lon')} stop_lon, location_type, parent_station from f where i = 1""")
def release_stops(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    base, other = one(t, "cad"), one(t, "hastus")
    walk = crosswalk.crosswalk(other["stops"], base["stops"], ("target_code",))
    got = release.release_stops(base["stops"], other["stops"], walk, one(t, "rail")["stops"], base["stop_times"])
    value = lambda c: F.when(F.col(c).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.col(c).try_cast("double").cast("string")).otherwise(F.col(c))
    return got.select("stop_id", F.col("_row").alias("row_id"), "stop_name", value("stop_lat").alias("stop_lat"), value("stop_lon").alias("stop_lon"), "location_type", "parent_station")


_CAL_ONE = "(select *, row_number() over (partition by feed, trim(service_id) order by row_id) i from calendar where feed in ('cad', 'rail'))"
_OUTSIDE = f"greatest({x('start_date')}, '20260301') > least({x('end_date')}, '20260430')"


@query("release_calendar", f"select feed, {x('service_id')} service_id, case when {_OUTSIDE} then '0' else {x('monday')} end monday, case when {_OUTSIDE} then '20260301' else greatest({x('start_date')}, '20260301') end start_date, case when {_OUTSIDE} then '20260430' else least({x('end_date')}, '20260430') end end_date from {_CAL_ONE} where i = 1")
def release_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Each service's first row, as rows that repeat one stop a build; the sources' ids are told apart by their feed."""
    t = feeds(spark, d)["calendar"].where("_feed in ('cad', 'rail')")
    first = t.groupBy("_feed", strip("service_id").alias("_s")).agg(F.min("_row").alias("_row"))
    rows = t.join(first, ["_feed", "_row"]).withColumn("service_id", F.concat_ws("/", "_feed", "_s"))
    got = release.release_calendar({f: {"calendar": rows.where(F.col("_feed") == f)} for f in ("cad", "rail")}, "20260301", "20260430")[0]
    part = F.split("service_id", "/", 2)
    return got.select(part[0].alias("feed"), part[1].alias("service_id"), "monday", "start_date", "end_date")


@query("warning_groups", f"with w as (select case when nm is null then 'unmatched_route' else 'matched' end kind, {x('r.route_id')} k from routes r left join (select distinct {x('route_short_name')} nm from routes where feed = 'hastus') h on h.nm = {x('r.route_short_name')} where r.feed = 'cad') select kind, count(*) n, array_to_string(list_sort(list(k order by k)[1:5]), '; ') examples from w group by 1")
def warning_groups(spark: SparkSession, d: str) -> DataFrame:
    r = feeds(spark, d)["routes"]
    held = r.where("_feed = 'hastus'").select(strip("route_short_name").alias("nm")).distinct().withColumn("there", F.lit(True))
    mine = r.where("_feed = 'cad'").withColumn("nm", strip("route_short_name")).join(held, "nm", "left")
    made = release.warning(mine.where("there is null"), "unmatched_route", "base", strip("route_id")).unionByName(release.warning(mine.where("there"), "matched", "base", strip("route_id")))
    return release.warning_groups(made).withColumn("examples", F.regexp_replace("examples", " (?=;|$)", ""))


@query("release_differences", fq.DIFF_SQL.replace("stop_code", "parent_station"))
def release_differences(spark: SparkSession, d: str) -> DataFrame:
    s = feeds(spark, d)["stops"]
    return releasediff.keyed_diff(s.where("_feed = 'cad'"), s.where("_feed = 'hastus'"), "stops", ["stop_name", "parent_station", "wheelchair_boarding", "location_type"]).withColumn("changed", F.array_join("changed", ","))
