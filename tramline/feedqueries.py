"""Queries of the feed operators on the test tables, each with the SQL it is compared with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.common import cut, strip, table
from tramline.contract import DAYS, ENUMS
from tramline.functions import scalars
from tramline.operators import browse, builder, crosswalk, dated, diagnostics, inspection, matcher, patterns, profile, reconciliation, releasediff, rules, sequences, service_dates
from tramline.plans import ledger
from tramline.sources.feed import from_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("stops", "routes", "trips", "stop_times", "calendar", "shapes")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def feeds(spark: SparkSession, d: str, *feed: str) -> dict[str, DataFrame]:
    t = from_tables({n: table(spark, d, n) for n in TABLES})
    return {n: df.where(F.col("_feed").isin(*feed)) for n, df in t.items()} if feed else t


def one(t: dict[str, DataFrame], feed: str) -> dict[str, DataFrame]:
    return {n: df.where(F.col("_feed") == feed) for n, df in t.items()}


def x(c: str) -> str:
    return f"trim(coalesce({c}, ''))"


SECS = lambda v: f"case when regexp_full_match({v}, '[0-9]{{1,3}}:[0-5][0-9]:[0-5][0-9]') then split_part({v}, ':', 1)::int * 3600 + split_part({v}, ':', 2)::int * 60 + split_part({v}, ':', 3)::int end"  # noqa: E731, E501
WHOLE = lambda v: f"case when regexp_full_match({v}, '[+]?[0-9]{{1,9}}') then {v}::int end"
NUM = lambda v: f"case when regexp_full_match({v}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then {v}::double end"
DATE = lambda v: f"(case when regexp_full_match({v}, '[0-9]{{8}}') then try_strptime({v}, '%Y%m%d') end)::date"
NAME = lambda v: f"trim(regexp_replace(lower(strip_accents({v})), '[^a-z0-9]+', ' ', 'g'))"
FIND = "feed, rule_id, file, row, key, observed"


def found(df: DataFrame) -> DataFrame:
    return df.select("feed", "rule_id", "file", "row", "key", "observed")


def pick(df: DataFrame, *rule: str) -> DataFrame:
    return found(df.where(F.col("rule_id").isin(*rule)))


def _f(rule: str, file: str, where: str, key: str = "null", observed: str = "null", source: str | None = None) -> str:
    return f"select coalesce(feed, '') feed, '{rule}' rule_id, '{file}' file, row_id as row, ({key})::varchar as key, ({observed})::varchar observed from {source or file} where {where}"


ALL = " union all "
#: A stricter list than the format's, so that the test data has violations.
STRICT = ENUMS | {"stops": {"location_type": ["0", "1"], "wheelchair_boarding": ["0", "1"]}, "stop_times": {"pickup_type": ["0", "1"], "drop_off_type": ["0", "1"], "timepoint": ["1", ""]}}
ENUM_TABLES = ("routes", "trips", "stops", "stop_times", "calendar")
_enum_sql = lambda enums: ALL.join(_f("VAL001", t, f"{x(c)} not in ({', '.join(repr(v) for v in vs)})", "null", f"'{c}: ' || {x(c)}") for t in ENUM_TABLES for c, vs in enums[t].items() if not c.startswith("continuous"))
ENUM_SQL = _enum_sql(STRICT)


@query("enum_violation", ENUM_SQL)
def enum_violation(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return pick(ledger.union([rules.table_checks(t[n], n, STRICT) for n in ENUM_TABLES]), "VAL001")


DATE_SQL = ALL.join(_f("VAL002", "calendar", f"{x(c)} <> '' and {DATE(x(c))} is null", "null", f"'{c}: ' || {x(c)}") for c in ("start_date", "end_date"))


@query("date_validity", DATE_SQL)
def date_validity(spark: SparkSession, d: str) -> DataFrame:
    return pick(rules.table_checks(feeds(spark, d)["calendar"], "calendar"), "VAL002")


def _range(c: str, most: int) -> str:
    return f"not coalesce({NUM(x(c))} between -{most} and {most}, false)"


N = WHOLE(x("shape_pt_sequence"))
COORD_SQL = ALL.join(
    [_f("VAL003", "stops", f"{x(c)} <> '' and {_range(c, m)}", x("stop_id"), f"'{c}: ' || {x(c)}") for c, m in (("stop_lat", 90), ("stop_lon", 180))]
    + [_f("GEO002", "shapes", f"{N} is not null and {_range(c, m)}", f"{x('shape_id')} || ':' || {N}", f"'{c}: ' || {x(c)}") for c, m in (("shape_pt_lat", 90), ("shape_pt_lon", 180))]
    + [_f("GEO001", "shapes", f"{N} is null", x("shape_id"), x("shape_pt_sequence"))]
)


@query("coord_range", COORD_SQL)
def coord_range(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return pick(ledger.union([rules.table_checks(t[n], n) for n in ("stops", "shapes")]), "VAL003", "GEO001", "GEO002")


COLOUR_SQL = ALL.join(_f("VAL004", "routes", f"{x(c)} <> '' and not regexp_full_match({x(c)}, '[0-9A-Fa-f]{{6}}')", x("route_id"), f"'{c}: ' || {x(c)}") for c in ("route_color", "route_text_color"))


@query("regex_format", COLOUR_SQL)
def regex_format(spark: SparkSession, d: str) -> DataFrame:
    return pick(rules.table_checks(feeds(spark, d)["routes"], "routes"), "VAL004")


KEY_OF = {"stops": x("stop_id"), "routes": x("route_id"), "trips": x("trip_id"), "calendar": x("service_id"), "shapes": f"{x('shape_id')} || ' ¦ ' || coalesce({N}::varchar, {x('shape_pt_sequence')})"}
BLANK_OF = {"stops": f"{x('stop_id')} = ''", "routes": f"{x('route_id')} = ''", "trips": f"{x('trip_id')} = ''", "calendar": f"{x('service_id')} = ''", "shapes": f"{x('shape_id')} = '' or {x('shape_pt_sequence')} = ''"}
BLANK_SQL = ALL.join(_f("REL001", t, b) for t, b in BLANK_OF.items())


@query("blank_required", BLANK_SQL)
def blank_required(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return pick(ledger.union([rules.table_checks(t[n], n) for n in BLANK_OF]), "REL001")


SEQ = WHOLE(x("stop_sequence"))


def _dup(t: str) -> str:
    key, blank, ok = KEY_OF.get(t), BLANK_OF.get(t), "true"
    if t == "stop_times":
        key, blank, ok = f"{x('trip_id')} || ' ¦ ' || {x('stop_sequence')}", f"{x('trip_id')} = '' or {x('stop_sequence')} = ''", f"{SEQ} is not null"
    if t == "shapes":
        ok = f"{N} is not null"
    rule = "TIME004" if t == "stop_times" else "REL002"
    return f"select feed, '{rule}' rule_id, '{t}' file, row_id as row, k::varchar as key, null::varchar observed from (select coalesce(feed, '') feed, row_id, {key} k, min(row_id) over (partition by coalesce(feed, ''), {key}) f from {t} where not ({blank}) and {ok}) where row_id > f"


DUP_SQL = ALL.join(_dup(t) for t in ("stops", "routes", "trips", "calendar", "shapes", "stop_times"))


@query("dup_key_rows", DUP_SQL)
def dup_key_rows(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return found(ledger.union([rules.repeated_keys(t[n], n) for n in ("stops", "routes", "trips", "calendar", "shapes", "stop_times")]))


@query("dup_key_values", f"select coalesce(feed, '') feed, {x('trip_id')} as key, count(*) n from trips where {x('trip_id')} <> '' group by 1, 2 having count(*) > 1")
def dup_key_values(spark: SparkSession, d: str) -> DataFrame:
    return rules.duplicate_key_values(feeds(spark, d)["trips"], "trips")


def _fk(rule: str, t: str, field: str, parent: str, pfield: str, key: str, blank_ok: bool = False, held: str = "true") -> str:
    return _f(rule, t, f"({x(field)}) not in (select {x('p.' + pfield)} from {parent} p where coalesce(p.feed, '') = coalesce({t}.feed, '') and {held})" + (f" and {x(field)} <> ''" if blank_ok else ""), key, x(field))


FK_SQL = ALL.join([
    _fk("REL005", "stop_times", "trip_id", "trips", "trip_id", x("trip_id")), _fk("REL006", "stop_times", "stop_id", "stops", "stop_id", f"{x('trip_id')} || ':' || {x('stop_sequence')}"),
    _fk("REL007", "trips", "route_id", "routes", "route_id", x("trip_id")), _fk("REL008", "trips", "service_id", "calendar", "service_id", x("trip_id")),
    _fk("REL009", "trips", "shape_id", "shapes", "shape_id", x("trip_id"), True, f"{N} is not null"),
])


@query("anti_unknown_fk", FK_SQL)
def anti_unknown_fk(spark: SparkSession, d: str) -> DataFrame:
    return found(rules.reference_checks(feeds(spark, d)))


UNUSED_SQL = f"select distinct coalesce(feed, '') feed, 'REL010' rule_id, 'shapes' file, null::bigint as row, {x('shape_id')} as key, null::varchar observed from shapes s where {N} is not null and {x('shape_id')} <> '' and not exists (select 1 from trips t where coalesce(t.feed, '') = coalesce(s.feed, '') and {x('t.shape_id')} = {x('s.shape_id')})"


@query("unused_dimension", UNUSED_SQL)
def unused_dimension(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return found(rules.unused_shapes(t["shapes"], t["trips"]))


KIND = f"case when {x('location_type')} = '' then '0' else {x('location_type')} end"
PARENT_SQL = f"""with h as (select coalesce(feed, '') feed, {x('stop_id')} k, arg_max({KIND}, row_id) t from stops group by 1, 2),
c as (select coalesce(feed, '') feed, row_id, {x('stop_id')} k, {x('parent_station')} p, {KIND} t from stops where {x('parent_station')} <> ''),
m as (select c.*, h.t pt, case when c.t = '4' then '0' else '1' end want from c left join h on h.feed = c.feed and h.k = c.p where c.t <> '1')
select feed, case when pt is null then 'REL003' else 'REL011' end rule_id, 'stops' file, row_id as row, k as key, case when pt is null then p else pt end observed from m where pt is null or pt <> want
union all {_f('REL004', 'stops', f"{x('location_type')} = '1' and {x('parent_station')} <> ''", x('stop_id'))}
union all {_f('REL012', 'stops', f"{x('location_type')} in ('2', '3', '4') and {x('parent_station')} = ''", x('stop_id'))}"""


@query("parent_type_check", PARENT_SQL)
def parent_type_check(spark: SparkSession, d: str) -> DataFrame:
    stops = feeds(spark, d)["stops"]
    return found(rules.parent_checks(stops)).unionByName(pick(rules.table_checks(stops, "stops"), "REL004", "REL012"))


A, D = x("arrival_time"), x("departure_time")
CALL_KEY = f"{x('trip_id')} || ':' || {SEQ}"
TIME_SQL = ALL.join(
    [_f("TIME001", "stop_times", f"{SEQ} is null", x("trip_id"), x("stop_sequence"))]
    + [_f("TIME002", "stop_times", f"{SEQ} is not null and {v} <> '' and {SECS(v)} is null", CALL_KEY, v) for v in (A, D)]
    + [_f("TIME003", "stop_times", f"{SEQ} is not null and {SECS(A)} > {SECS(D)}", CALL_KEY, f"{A} || ' → ' || {D}")]
)


@query("call_checks", TIME_SQL)
def call_checks(spark: SparkSession, d: str) -> DataFrame:
    return pick(rules.table_checks(feeds(spark, d)["stop_times"], "stop_times"), "TIME001", "TIME002", "TIME003")


CALLS = f"(select coalesce(feed, '') f, {x('trip_id')} t, {SEQ} n, arg_min(row_id, row_id) r, arg_min(struct_pack(stop := {x('stop_id')}, a := {A}, d := {D}, p := {x('pickup_type')}, o := {x('drop_off_type')}), row_id) c from stop_times where {SEQ} is not null group by 1, 2, 3)"
REGRESS_SQL = f"""with c as (select f, t, n, r, coalesce({SECS('c.a')}, {SECS('c.d')}) come, coalesce({SECS('c.d')}, {SECS('c.a')}) go from {CALLS}),
w as (select *, last_value(go ignore nulls) over (partition by f, t order by n rows between unbounded preceding and 1 preceding) b from c)
select f feed, 'TIME005' rule_id, 'stop_times' file, r as row, t || ':' || n as key, come::varchar observed from w where come < b"""


@query("time_regression", REGRESS_SQL)
def time_regression(spark: SparkSession, d: str) -> DataFrame:
    return found(rules.time_regressions(feeds(spark, d)["stop_times"]))


TECHNICAL_SQL = ALL.join(f"select {FIND} from ({q})" for q in (_enum_sql(ENUMS), DATE_SQL, COORD_SQL, COLOUR_SQL, BLANK_SQL, DUP_SQL, FK_SQL, UNUSED_SQL, PARENT_SQL, TIME_SQL, REGRESS_SQL))


@query("top_rules", f"select rule_id, count(*) n from ({TECHNICAL_SQL}) group by 1 order by n desc, rule_id limit 6")
def top_rules(spark: SparkSession, d: str) -> DataFrame:
    return ledger.rule_counts(rules.technical(feeds(spark, d))).select("rule_id", "n").orderBy(F.col("n").desc(), "rule_id").limit(6)


@query("samples_with_total", f"select feed, rule_id, row, total, place from (select feed, rule_id, row, count(*) over (partition by feed, rule_id) total, row_number() over (partition by feed, rule_id order by row, key, observed) place from ({ENUM_SQL})) where place <= 20")
def samples_with_total(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    got = ledger.union([rules.table_checks(t[n], n, STRICT) for n in ENUM_TABLES]).where("rule_id = 'VAL001'")
    return ledger.samples(got, ["feed", "rule_id"], 20).select("feed", "rule_id", "row", "total", F.col("place").cast("bigint").alias("place"))


ENTITY = {"routes": "route_id", "stops": "stop_id", "trips": "trip_id", "shapes": "shape_id", "calendar": "service_id"}


@query("entity_counts", ALL.join(f"select coalesce(feed, '') feed, '{t}' entity, count(distinct {x(k)}) n from {t} where {x(k)} <> '' group by 1" for t, k in ENTITY.items()))
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.entity_counts(feeds(spark, d))


@query("group_counts", f"select coalesce(feed, '') feed, {x('trip_id')} trip_id, count(*) n from stop_times group by 1, 2")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return feeds(spark, d)["stop_times"].groupBy(F.col("_feed").alias("feed"), strip("trip_id").alias("trip_id")).agg(F.count("*").alias("n"))


@query("table_inventory", ALL.join(f"select coalesce(feed, '') feed, '{t}' as \"table\", count(*) as rows from {t} group by 1" for t in TABLES) + ALL + "select distinct feed, 'agency', 0 from stops" + ALL + "select distinct feed, 'feed_info', 0 from stops")
def table_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inspection.table_inventory(feeds(spark, d), ["agency", "feed_info"])


@query("route_inventory", f"with n as (select coalesce(feed, '') f, {x('route_id')} r, count(*) n from trips group by 1, 2) select q.feed, q.route_id, q.route_name, coalesce(n.n, 0) trips from (select coalesce(feed, '') feed, {x('route_id')} route_id, arg_min({x('route_short_name')}, row_id) route_name from routes group by 1, 2) q left join n on n.f = q.feed and n.r = q.route_id")
def route_inventory(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return browse.inventory(t["trips"], t["routes"]).withColumnRenamed("_feed", "feed")


@query("numeric_route_sort", f"select route_name, row_number() over (order by case when regexp_full_match(route_name, '[0-9]+') then 0 else 1 end, case when regexp_full_match(route_name, '[0-9]+') then route_name::bigint end, route_name) place from (select distinct {x('route_short_name')} route_name from routes)")
def numeric_route_sort(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    names = feeds(spark, d)["routes"].select(strip("route_short_name").alias("route_name")).distinct()
    return names.select("route_name", F.row_number().over(W.orderBy(*browse.route_order("route_name"))).cast("bigint").alias("place"))


@query("route_rollup", f"with t as (select coalesce(feed, '') f, {x('route_id')} r, count(distinct {x('trip_id')}) trips, count(distinct nullif({x('shape_id')}, '')) shapes, count(distinct nullif({x('direction_id')}, '')) directions from trips group by 1, 2) select q.feed, q.route_id, coalesce(trips, 0) trips, coalesce(shapes, 0) shapes, coalesce(directions, 0) directions from (select distinct coalesce(feed, '') feed, {x('route_id')} route_id from routes) q left join t on t.f = q.feed and t.r = q.route_id")
def route_rollup(spark: SparkSession, d: str) -> DataFrame:
    return inspection.route_rollup(feeds(spark, d)).withColumnRenamed("_feed", "feed")


_STOPS = lambda f: f"(select {x('stop_id')} id, max({x('stop_code')}) code from stops where feed = '{f}' and {x('stop_id')} <> '' group by 1)"
_UNIQUE = lambda f: f"(select {x('stop_code')} code, min({x('stop_id')}) id from stops where feed = '{f}' and {x('stop_code')} <> '' and {x('stop_id')} <> '' group by 1 having count(distinct {x('stop_id')}) = 1)"
WALK_SQL = f"""select source_id, coalesce(a, b, c) target_id, case when a is not null then 'same_id' when b is not null then 'target_code' else 'shared_code' end tier from (
select s.id source_id, t.id a, u.id b, v.id c from {_STOPS('cad')} s left join {_STOPS('hastus')} t on t.id = s.id left join {_UNIQUE('hastus')} u on u.code = s.id
left join (select p.code, q.id from {_UNIQUE('cad')} p join {_UNIQUE('hastus')} q using (code)) v on v.code = s.code) where coalesce(a, b, c) is not null"""


def _walk(spark: SparkSession, d: str) -> DataFrame:
    stops = feeds(spark, d)["stops"]
    return crosswalk.crosswalk(stops.where("_feed = 'cad'"), stops.where("_feed = 'hastus'"))


@query("crosswalk_tiers", WALK_SQL)
def crosswalk_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d)


@query("crosswalk_unique", f"select {x('stop_name')} code, count(distinct {x('stop_id')}) ids from stops where feed = 'cad' and {x('stop_name')} <> '' and {x('stop_id')} <> '' group by 1 having count(distinct {x('stop_id')}) > 1")
def crosswalk_unique(spark: SparkSession, d: str) -> DataFrame:
    return crosswalk.ambiguous_codes(feeds(spark, d, "cad")["stops"], "stop_name")


PLAIN = lambda v: f"case when regexp_full_match({v}, '[+-]?[0-9]+(\\.[0-9]+)?') then {v}::double end"
_STATE = lambda f: f"(select k, c.* from (select {x('stop_id')} k, arg_min(struct_pack(la := {x('stop_lat')}, lo := {x('stop_lon')}, ty := {KIND}, pa := {x('parent_station')}, wh := {x('wheelchair_boarding')}), row_id) c from stops where feed = '{f}' and {x('stop_id')} <> '' group by 1))"
_HAV = lambda a, b: f"case when {' + '.join(PLAIN(f'{t}.{c}') for t in (a, b) for c in ('la', 'lo'))} is not null then 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({PLAIN(b + '.la')} - {PLAIN(a + '.la')}) / 2), 2) + cos(radians({PLAIN(a + '.la')})) * cos(radians({PLAIN(b + '.la')})) * pow(sin(radians({PLAIN(b + '.lo')} - {PLAIN(a + '.lo')}) / 2), 2)))) end"
PAIR_SQL = f"""with w as ({WALK_SQL}) select w.source_id, w.target_id, round({_HAV('s', 't')}, 1) distance_m, s.ty <> t.ty type_differs, coalesce(nullif(s.wh, ''), '0') <> coalesce(nullif(t.wh, ''), '0') wheelchair_differs, coalesce(u.target_id, s.pa) <> t.pa parent_differs
from w join {_STATE('cad')} s on s.k = w.source_id join {_STATE('hastus')} t on t.k = w.target_id left join w u on u.source_id = s.pa"""


@query("attribute_diff", PAIR_SQL)
def attribute_diff(spark: SparkSession, d: str) -> DataFrame:
    stops = feeds(spark, d)["stops"]
    pairs = crosswalk.stop_pairs(_walk(spark, d), stops.where("_feed = 'cad'"), stops.where("_feed = 'hastus'"))
    has = lambda f: F.array_contains("differs", f)
    return pairs.select("source_id", "target_id", F.round("distance_m", 1).alias("distance_m"), has("location_type").alias("type_differs"), has("wheelchair_boarding").alias("wheelchair_differs"), has("parent_station").alias("parent_differs"))


_STATE_N = lambda f: _STATE(f).replace("struct_pack(", f"struct_pack(nm := {x('stop_name')}, ")
STP_SQL = f"""with w as ({WALK_SQL}), p as (select w.target_id || ' ↔ ' || w.source_id as key, s.nm <> '' and t.nm <> '' and {NAME('s.nm')} <> {NAME('t.nm')} names, {_HAV('s', 't')} dist,
concat_ws(', ', case when s.ty <> t.ty then 'location_type' end, case when coalesce(nullif(s.wh, ''), '0') <> coalesce(nullif(t.wh, ''), '0') then 'wheelchair_boarding' end, case when coalesce(u.target_id, s.pa) <> t.pa then 'parent_station' end) diff
from w join {_STATE_N('cad')} s on s.k = w.source_id join {_STATE_N('hastus')} t on t.k = w.target_id left join w u on u.source_id = s.pa)
select null::varchar feed, 'STP005' rule_id, 'stops' file, null::bigint as row, key, null::varchar observed from p where names
union all select null, 'STP006', 'stops', null, key, format('{{:,.1f}}', dist) from p where dist > 35 union all select null, 'STP010', 'stops', null, key, diff from p where diff <> ''"""


@query("stop_reconciliation", STP_SQL)
def stop_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    stops = feeds(spark, d)["stops"]
    return found(crosswalk.stop_findings(crosswalk.stop_pairs(_walk(spark, d), stops.where("_feed = 'cad'"), stops.where("_feed = 'hastus'"))))


@query("provenance_except", f"select distinct {x('trip_id')} id from trips where feed = 'hastus' and {x('trip_id')} <> '' and {x('trip_id')} not in (select {x('trip_id')} from trips where feed in ('cad', 'rail'))")
def provenance_except(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)["trips"]
    return crosswalk.untraceable(t.where("_feed = 'hastus'"), [t.where("_feed = 'cad'"), t.where("_feed = 'rail'")], "trip_id")


@query("provenance", ALL.join(f"select '{t}' entity, count(*) filter (id in (select {x(k)} from {t} where feed in ('cad', 'rail'))) traceable, count(*) total from (select distinct {x(k)} id from {t} where feed = 'hastus' and {x(k)} <> '')" for t, k in (("routes", "route_id"), ("trips", "trip_id"), ("shapes", "shape_id"), ("calendar", "service_id"))))
def provenance(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return crosswalk.provenance(one(t, "hastus"), [one(t, "cad"), one(t, "rail")])


GOT = f"(select * from {CALLS} where t <> '')"
PRINT_SQL = f"""with p as (select f, t, c.stop stop, n, row_number() over (partition by f, t order by n) i from {GOT})
select f feed, t trip_id, count(*)::int stop_count, sha256(string_agg(i || '|' || stop || chr(10), '' order by n)) stop_print from p group by 1, 2"""


@query("pattern_fingerprint", PRINT_SQL)
def pattern_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return patterns.trip_summaries(feeds(spark, d)["stop_times"]).select(F.col("_feed").alias("feed"), "trip_id", "stop_count", "stop_print")


NAMED_SQL = f"""p as (select f, t, c, n, row_number() over (partition by f, t order by n) i from {GOT}),
s as (select f, t, count(*) stop_count, sha256(string_agg(i || '|' || c.stop || chr(10), '' order by n)) pr, arg_min(case when c.d <> '' then c.d else c.a end, n) ft, arg_max(case when c.a <> '' then c.a else c.d end, n) lt from p group by 1, 2),
tr as (select coalesce(feed, '') f, {x('trip_id')} t, arg_min(struct_pack(r := {x('route_id')}, di := {x('direction_id')}, h := {x('trip_headsign')}, sh := {x('shape_id')}, sv := {x('service_id')}), row_id) m from trips group by 1, 2),
ro as (select coalesce(feed, '') f, {x('route_id')} r, arg_min({x('route_short_name')}, row_id) nm from routes group by 1, 2),
j as (select s.*, tr.m.r route_id, tr.m.di di, tr.m.h h, tr.m.sh sh, tr.m.sv sv, coalesce(ro.nm, tr.m.r) rn from s join tr on tr.f = s.f and tr.t = s.t left join ro on ro.f = s.f and ro.r = tr.m.r)"""
VAR_SQL = f"""with {NAMED_SQL}, v as (select f, rn, pr, arg_min(struct_pack(t := t, di := di, h := h, sc := stop_count, ft := ft), struct_pack(a := ft, b := lt, c := t)) m, count(*) trips, count(distinct sh) shapes, min(ft) first_time, max(lt) last_time from j group by 1, 2, 3)
select f feed, rn route_name, pr stop_print, 'V' || row_number() over (partition by f, rn order by m.di, m.h, m.sc, m.ft, pr) variation, m.t example_trip, m.sc::int stop_count, trips, shapes, first_time, last_time from v"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return patterns.with_trips(patterns.trip_summaries(t["stop_times"]), t["trips"], t["routes"])


@query("variation_catalog", VAR_SQL)
def variation_catalog(spark: SparkSession, d: str) -> DataFrame:
    return patterns.variations(_named(spark, d)).select(F.col("_feed").alias("feed"), "route_name", "stop_print", "variation", "example_trip", "stop_count", "trips", "shapes", "first_time", "last_time")


JOURNEY_SQL = f"""{NAMED_SQL}, q as (select rn, di, {NAME('h')} head, ft, lt, pr, max((f = 'cad')::int) l, max((f = 'hastus')::int) r from j where f in ('cad', 'hastus') group by all),
k as (select rn route_name, di direction_id, head, ft first_time, lt last_time, sum(l)::bigint left_patterns, sum(r)::bigint right_patterns, sum(l * r)::bigint shared from q group by all having sum(l) > 0 and sum(r) > 0)"""


@query("journey_compare", f"with {JOURNEY_SQL} select * from k")
def journey_compare(spark: SparkSession, d: str) -> DataFrame:
    return patterns.compared_journeys(_named(spark, d), "cad", "hastus")


@query("route_health", f"""with {JOURNEY_SQL}, t as (select rn, count(*) filter (f = 'cad') lt, count(*) filter (f = 'hastus') rt from j where f in ('cad', 'hastus') group by 1), m as (select route_name, count(*) js, count(*) filter (shared = 0) af from k group by 1)
select rn route_name, lt left_trips, rt right_trips, coalesce(js, 0) journeys, coalesce(af, 0) affected, case when coalesce(js, 0) > 0 then floor((js - af) * 1000 / js) / 10 else -1.0 end match_pct,
case when lt = 0 then 'hastus_only' when rt = 0 then 'cad_only' when coalesce(js, 0) = 0 then 'not_comparable' when af > 0 then 'issues' else 'healthy' end status from t left join m on m.route_name = t.rn""")
def route_health(spark: SparkSession, d: str) -> DataFrame:
    return patterns.route_health(_named(spark, d), "cad", "hastus")


@query("variation_pairs")
def variation_pairs(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d).where("_feed in ('cad', 'hastus')")
    v = patterns.variations(named)
    example = named.select("_feed", F.col("trip_id").alias("example_trip"), "stops")
    full = v.join(example, ["_feed", "example_trip"]).select("_feed", "route_name", "variation", "direction_id", "headsigns", "stops", "trips")
    tagged = patterns.journeys(named).join(v.select("_feed", "route_name", "stop_print", "variation"), ["_feed", "route_name", "stop_print"])
    side = lambda f, n: tagged.where(F.col("_feed") == f).select(*patterns.JOURNEY, F.col("variation").alias(n)).distinct()
    links = side("cad", "left").join(side("hastus", "right"), patterns.JOURNEY).groupBy("route_name", "left", "right").agg(F.count("*").alias("n"))
    return sequences.paired_variations(full, links, "cad", "hastus")


def _both_trips(spark: SparkSession, d: str) -> DataFrame:
    s = patterns.trip_summaries(feeds(spark, d, "cad", "hastus")["stop_times"]).select("_feed", "trip_id", "stops", "first_time")
    return s.where("_feed = 'cad'").select("trip_id", F.col("stops").alias("a")).join(s.where("_feed = 'hastus'").select("trip_id", F.col("stops").alias("b")), "trip_id")


@query("seq_similarity")
def seq_similarity(spark: SparkSession, d: str) -> DataFrame:
    s = sequences.similarity("a", "b", F.lit(""), F.lit(""))
    return _both_trips(spark, d).select("trip_id", sequences.difference_count("a", "b").alias("difference"), F.array_join(sequences.mismatch_places("a", "b"), ",").alias("places"), F.round(s["ratio"], 6).alias("ratio"), F.round(s["score"], 6).alias("score"))


@query("seq_align")
def seq_align(spark: SparkSession, d: str) -> DataFrame:
    got = _both_trips(spark, d).where("a != b").select("trip_id", sequences.alignment("a", "b").alias("rows"))
    return sequences.only_in_one(got).select("trip_id", "left", "right", "status")


@query("occurrence_align")
def occurrence_align(spark: SparkSession, d: str) -> DataFrame:
    calls = patterns.ordered_calls(feeds(spark, d, "cad", "hastus")["stop_times"]).groupBy("_feed", "trip_id").agg(F.sort_array(F.collect_list(F.struct("n", "stop", scalars.seconds(F.col("departure")).alias("t")))).alias("c"))
    side = lambda f, p: calls.where(F.col("_feed") == f).select("trip_id", F.transform("c", lambda v: v["stop"]).alias(f"{p}s"), F.transform("c", lambda v: v["t"]).alias(f"{p}t"))
    both = side("cad", "a").join(side("hastus", "b"), "trip_id").where(F.col("as") != F.col("bs"))
    return both.select("trip_id", F.explode(sequences.occurrence_udf(60)("as", "bs", "at", "bt")).alias("left", "right"))


ANCHOR_SQL = f"""with {NAMED_SQL}, c as (select g.f, g.t, j.rn, g.c.stop stop, {SECS('g.c.d')} tm from {GOT} g join j on j.f = g.f and j.t = g.t), e as (select * from c where tm is not null and stop <> '')
select a.t l_trip, b.t r_trip, count(distinct a.stop) anchors from e a join e b on a.f = 'final' and b.f = 'final' and a.t < b.t and a.rn = b.rn and a.stop = b.stop and abs(a.tm - b.tm) <= 300 group by 1, 2 having count(distinct a.stop) >= 2"""


@query("band_join_anchor", ANCHOR_SQL)
def band_join_anchor(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d, "final")
    a = patterns.anchors(t["stop_times"], t["trips"], t["routes"], "final")
    return patterns.timed_pairs(a, a, 300).where("l_trip < r_trip")


def _models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = feeds(spark, d)
    block = lambda df: df.withColumn("block", F.concat_ws("/", "route", F.substring("start", 1, 1)))
    return block(matcher.models(one(t, "cad"))), block(matcher.models(one(t, "hastus")))


_CAL = f"(select coalesce(feed, '') f, {x('service_id')} s, arg_max(struct_pack(fl := [{', '.join(x(c) for c in DAYS)}], a := {DATE(x('start_date'))}, b := {DATE(x('end_date'))}), row_id) m from calendar group by 1, 2)"
_DAY = f"(select f, s, unnest(generate_series(m.a::timestamp, m.b::timestamp, interval 1 day)) dt, m.fl fl from {_CAL} where s <> '' and m.a is not null and m.b is not null and m.a <= m.b and date_diff('day', m.a, m.b) <= 3660)"
DATES_SQL = f"ds as (select f, s, list_sort(list(distinct strftime(dt, '%Y%m%d'))) ds from {_DAY} where fl[isodow(dt)] = '1' group by 1, 2)"
TIER_SQL = f"""{NAMED_SQL}, {DATES_SQL}, l as (select p.f, p.t, list(p.c.stop order by p.n) stops, arg_min({SECS('p.c.d')}, p.n) filter (i = 1) st from p group by 1, 2),
m as (select j.f, j.t, j.rn, l.stops, l.st, coalesce(ds.ds, []) ds from j join l on l.f = j.f and l.t = j.t left join ds on ds.f = j.f and ds.s = j.sv),
q as (select a.t trip_id, b.t candidate, a.rn || '/' || substr(a.st::varchar, 1, 1) block, b.rn || '/' || substr(b.st::varchar, 1, 1) target, list_intersect(a.ds, b.ds) dys from m a join m b on a.f = 'cad' and b.f = 'hastus' and a.rn = b.rn and a.st = b.st and a.stops = b.stops and list_has_any(a.ds, b.ds))"""


@query("exact_tier_match", f"with {TIER_SQL} select trip_id, candidate, 'exact_pattern_and_departure' as method from q")
def exact_tier_match(spark: SparkSession, d: str) -> DataFrame:
    return matcher.exact_matches(*_models(spark, d))


@query("match_tiers")
def match_tiers(spark: SparkSession, d: str) -> DataFrame:
    return matcher.match_sources(*map(cut, _models(spark, d)))


@query("learned_map", f"with {TIER_SQL}, u as (select trip_id from q group by 1 having count(distinct candidate) = 1), e as (select q.trip_id, block, target, unnest(dys) as date from q join u on u.trip_id = q.trip_id where block <> '' and target <> '') select block, date, min(target) target from e group by 1, 2 having count(distinct target) = 1 and count(distinct trip_id) >= 2")
def learned_map(spark: SparkSession, d: str) -> DataFrame:
    l, r = _models(spark, d)
    return matcher.learned_blocks(exact_tier_match(spark, d), l, r)


@query("match_dates")
def match_dates(spark: SparkSession, d: str) -> DataFrame:
    l, r = map(cut, _models(spark, d))
    return matcher.date_coverage(matcher.resolved(cut(matcher.match_sources(l, r)), l, r), l, r)


_AGREE = lambda f: f"case when count(distinct {x(f)}) = 1 then min({x(f)}) end {f}, count(distinct {x(f)}) > 1 {f}_conflict"


@query("consensus", f"select {x('trip_id')} trip_id, {_AGREE('trip_headsign')}, {_AGREE('direction_id')} from trips where feed in ('cad', 'hastus') group by 1")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d, "cad", "hastus")["trips"].select(*[strip(c).alias(c) for c in ("trip_id", "trip_headsign", "direction_id")])
    return builder.consensus(t, ["trip_id"], ["trip_headsign", "direction_id"])


EXPAND_SQL = f"""select f feed, s service_id, strftime(dt, '%Y-%m-%d') as date from (select f, s, m.fl fl, unnest(generate_series(m.a::timestamp, m.b::timestamp, interval 1 day)) dt from {_CAL} where s <> '' and m.a is not null and m.b is not null and m.a <= m.b and date_diff('day', m.a, m.b) <= 3660) where fl[isodow(dt)] = '1'"""


@query("calendar_expand", EXPAND_SQL)
def calendar_expand(spark: SparkSession, d: str) -> DataFrame:
    return service_dates.active_dates(feeds(spark, d)["calendar"]).select(F.col("_feed").alias("feed"), "service_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("coverage_window", f"select coalesce(feed, '') feed, strftime(min({DATE(x('start_date'))}), '%Y%m%d') as first, strftime(max({DATE(x('end_date'))}), '%Y%m%d') as last from calendar group by 1")
def coverage_window(spark: SparkSession, d: str) -> DataFrame:
    return service_dates.coverage(feeds(spark, d)["calendar"]).select(F.col("_feed").alias("feed"), F.date_format("first", "yyyyMMdd").alias("first"), F.date_format("last", "yyyyMMdd").alias("last"))


_S, _E = x("start_date"), x("end_date")
_OUT = f"({_E} < '20260301' or {_S} > '20260430')"


@query("calendar_clip", f"select row_id, case when {_OUT} then '0' else {x('monday')} end monday, case when {_OUT} then '20260301' else greatest({_S}, '20260301') end start_date, case when {_OUT} then '20260430' else least({_E}, '20260430') end end_date from calendar")
def calendar_clip(spark: SparkSession, d: str) -> DataFrame:
    return service_dates.clipped(feeds(spark, d)["calendar"], "20260301", "20260430").select("row_id", "monday", "start_date", "end_date")


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return dated.dated_status(dated.dated_trips(one(t, "cad")), dated.dated_trips(one(t, "hastus")))


DATED_SQL = f"""with {NAMED_SQL}, {DATES_SQL}, sc as (select f, t, string_agg(concat_ws('|', n, c.stop, c.a, c.d, c.p, c.o, chr(10)), '' order by n) sp from {GOT} group by 1, 2),
sh as (select f, s, string_agg(printf('%.7f,%.7f', round_even({PLAIN('m.la')}, 7), round_even({PLAIN('m.lo')}, 7)), ';' order by n) g from (select coalesce(feed, '') f, {x('shape_id')} s, {N} n, arg_min(struct_pack(la := {x('shape_pt_lat')}, lo := {x('shape_pt_lon')}), row_id) m from shapes where {x('shape_id')} <> '' and {N} is not null group by 1, 2, 3) group by 1, 2),
tt as (select coalesce(feed, '') f, {x('trip_id')} t, arg_min(struct_pack(h := {x('trip_headsign')}, di := {x('direction_id')}, wa := {x('wheelchair_accessible')}, ba := {x('bikes_allowed')}, sh := {x('shape_id')}, sv := {x('service_id')}), row_id) m from trips where {x('trip_id')} <> '' group by 1, 2),
a as (select tt.f, tt.t, tt.m, case when tt.m.sv <> '' and ends_with(tt.t, '-' || tt.m.sv) then left(tt.t, length(tt.t) - length(tt.m.sv) - 1) else tt.t end ca, s.pr, sc.sp, sh.g, coalesce(ds.ds, []) ds from tt left join s on s.f = tt.f and s.t = tt.t left join sc on sc.f = tt.f and sc.t = tt.t left join sh on sh.f = tt.f and sh.s = tt.m.sh left join ds on ds.f = tt.f and ds.s = tt.m.sv),
w as (select min(x) w1, max(x) w2 from (select unnest(ds) x from a where f = 'hastus')), l as (select a.* exclude (ds), list_filter(ds, lambda e: e >= w1 and e <= w2) ds from a, w where f = 'cad'), r as (select * from a where f = 'hastus'),
b1 as (select l.t, 'trip_id' method, l.m lm, r.m rm, l.pr lp, r.pr rp, l.sp ls, r.sp rs, l.g lg, r.g rg, r.t rt, r.ds rd from l join r on l.ca = r.ca),
b2 as (select l.t, 'schedule_and_dates' method, l.m lm, r.m rm, l.pr lp, r.pr rp, l.sp ls, r.sp rs, l.g lg, r.g rg, r.t rt, r.ds rd from l join r on l.sp = r.sp and list_has_any(l.ds, r.ds) where l.t not in (select t from b1)),
i as (select *, list_filter([case when lp <> rp then 'stop_pattern' end, case when lp = rp and ls <> rs then 'schedule' end, case when lm.h <> rm.h then 'trip_headsign' end, case when lm.di <> rm.di then 'direction_id' end, case when lm.wa <> rm.wa then 'wheelchair_accessible' end, case when lm.ba <> rm.ba then 'bikes_allowed' end, case when lg <> rg then 'shape' end], lambda e: e is not null) iss from (select * from b1 union all select * from b2)),
g as (select t, min(rt) fin, min(method) method, arg_min(iss, struct_pack(a := len(iss), b := rt)) iss, list_distinct(flatten(list(rd))) served from i group by 1),
z as (select l.t trip_id, g.fin final_trip_id, g.method, len(l.ds) = 0 outside, l.sp is null blank, coalesce(g.iss, []) iss, case when g.fin is not null then len(list_filter(l.ds, lambda e: not list_contains(g.served, e))) else 0 end gone from l left join g on g.t = l.t)
select trip_id, final_trip_id, method, case when outside then 'outside_final_window' when blank then 'unverifiable' when final_trip_id is null then 'missing' when len(iss) > 0 or gone > 0 then 'issues' else 'matching' end status, case when outside then '' else array_to_string(case when gone > 0 then list_append(iss, 'dates') else iss end, ',') end issues, gone::int missing_dates from z"""


@query("dated_status", DATED_SQL)
def dated_status(spark: SparkSession, d: str) -> DataFrame:
    return _statuses(spark, d).select("trip_id", "final_trip_id", "method", "status", F.array_join("issues", ",").alias("issues"), F.size("missing_dates").alias("missing_dates"))


@query("dated_counts", f"select status, count(*) n from ({DATED_SQL}) group by 1")
def dated_counts(spark: SparkSession, d: str) -> DataFrame:
    return dated.status_counts(_statuses(spark, d))


_DF = ["stop_name", "stop_code", "wheelchair_boarding", "location_type"]
_ROWS = lambda f: f"(select k, m.* from (select {x('stop_id')} k, arg_min(struct_pack({', '.join(f'{c} := {x(c)}' for c in _DF)}), row_id) m from stops where feed = '{f}' group by 1))"
DIFF_SQL = f"""select coalesce(a.k, b.k) as key, case when b.k is null then 'added' when a.k is null then 'removed' else 'changed' end status, case when a.k is null or b.k is null then '' else concat_ws(',', {', '.join(f"case when a.{c} <> b.{c} then '{c}' end" for c in _DF)}) end changed
from {_ROWS('cad')} a full join {_ROWS('hastus')} b on a.k = b.k where a.k is null or b.k is null or {' or '.join(f'a.{c} <> b.{c}' for c in _DF)}"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    s = feeds(spark, d)["stops"]
    return releasediff.keyed_diff(s.where("_feed = 'cad'"), s.where("_feed = 'hastus'"), "stops", _DF)


@query("keyed_diff", DIFF_SQL)
def keyed_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).withColumn("changed", F.array_join("changed", ","))


@query("change_histogram", f"with q as ({DIFF_SQL}), u as (select status, '' field from q union all select status, unnest(string_split(changed, ',')) from q where changed <> '') select status, field, count(*) n from u group by 1, 2")
def change_histogram(spark: SparkSession, d: str) -> DataFrame:
    return releasediff.change_histogram(_diff(spark, d))


@query("policy_filter", f"""with r as (select coalesce(feed, '') f, {x('route_id')} r, min({x('route_short_name')}) nm from routes group by 1, 2)
select t.row_id from trips t left join r on r.f = coalesce(t.feed, '') and r.r = {x('t.route_id')} where coalesce(nm, '') not in ('47', '100') and not (regexp_full_match(coalesce(nm, ''), '[0-9]{{1,9}}') and try_cast(nm as int) between 200 and 499 and {x('direction_id')} <> '0')""")
def policy_filter(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return builder.eligible(t["trips"], t["routes"], ["47", "100"], [(200, 499, ["0"])]).select("row_id")


@query("merged_stops", f"select k stop_id, arg_min(o, o * 1000000000 + row_id)::int source, arg_min(nm, o * 1000000000 + row_id) stop_name from (select {x('stop_id')} k, case feed when 'cad' then 0 when 'rail' then 1 else 2 end o, row_id, stop_name nm from stops where feed in ('cad', 'rail', 'hastus')) where k <> '' group by 1")
def merged_stops(spark: SparkSession, d: str) -> DataFrame:
    s = feeds(spark, d)["stops"].select("_row", "_feed", "stop_id", "stop_name", "parent_station")
    return builder.merged_stops([s.where(F.col("_feed") == f) for f in ("cad", "rail", "hastus")]).select("stop_id", "source", "stop_name")


@query("facet_search", f"select row_id from stops where contains(lower(coalesce(stop_name, '')), 'gare') or contains(lower(coalesce(stop_code, '')), 'gare')")  # noqa: F541
def facet_search(spark: SparkSession, d: str) -> DataFrame:
    return browse.search(feeds(spark, d)["stops"], ["stop_name", "stop_code"], "Gare").select("row_id")


@query("page_scan", "select row_id from stops where row_id >= 500 order by row_id limit 100")
def page_scan(spark: SparkSession, d: str) -> DataFrame:
    return browse.page(feeds(spark, d)["stops"], 500, 100)[0].select("row_id")


@query("lookup_many", f"select row_id from stop_times where {x('trip_id')} in (select {x('trip_id')} from trips where deleted_at is not null)")
def lookup_many(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return browse.lookup(t["stop_times"], "trip_id", t["trips"].where("deleted_at is not null").select(strip("trip_id"))).select("row_id")


@query("scan_project_trim", f"select distinct {x('route_id')} route_id from trips where {x('route_id')} <> ''")
def scan_project_trim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trips").select(strip("route_id").alias("route_id")).where("route_id != ''").distinct()


@query("service_seconds", f"select row_id, {SECS(A)} arrival_s, {SECS(D)} departure_s from stop_times")
def service_seconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stop_times").select("row_id", scalars.seconds(strip("arrival_time")).alias("arrival_s"), scalars.seconds(strip("departure_time")).alias("departure_s"))


MISSING_SHAPE_SQL = f"""with t as (select distinct coalesce(feed, '') f, {x('route_id')} r, {x('direction_id')} di, {x('shape_id')} s, {x('trip_id')} t from trips where {x('shape_id')} <> ''),
l as (select * from t where not exists (select 1 from shapes h where coalesce(h.feed, '') = t.f and {x('h.shape_id')} = t.s)), c as (select coalesce(feed, '') f, {x('trip_id')} t, count(*) n from stop_times group by 1, 2)
select l.f feed, r route_id, di direction_id, s shape_id, count(*) trips, coalesce(sum(n), 0)::bigint calls, count(*) filter (n is null) trips_without_calls from l left join c on c.f = l.f and c.t = l.t group by 1, 2, 3, 4"""


@query("missing_shapes", MISSING_SHAPE_SQL)
def missing_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return diagnostics.missing_shapes(t["trips"], t["shapes"], t["stop_times"]).withColumnRenamed("_feed", "feed")


_PLACE = f"({x('stop_lat')} <> '' and {x('stop_lon')} <> '')"
INS_SQL = ALL.join(
    [_f("INS001", "trips", f"{x(c)} = ''", x("trip_id"), f"'{c}'") for c in ("route_id", "service_id", "trip_id")]
    + [_f("INS002", "stops", f"{x('location_type')} in ('', '0', '1', '2') and {x('stop_name')} = ''", x("stop_id")), _f("INS003", "stops", f"({x('location_type')} in ('1', '2') or ({x('location_type')} in ('', '0') and {x('parent_station')} = '')) and not {_PLACE}", x("stop_id"))]
    + [_f("INS004", "calendar", f"{_S} <> '' and {_E} <> '' and {_S} > {_E}", x("service_id")), _f("INS006", "routes", f"{x('route_short_name')} = '' and {x('route_long_name')} = ''", x("route_id")), _f("INS008", "routes", f"{x('route_type')} in ('0', '1', '2', '5', '7', '12')", x("route_id"), x("route_type"))]
)


@query("feed_inspection", INS_SQL)
def feed_inspection(spark: SparkSession, d: str) -> DataFrame:
    return found(inspection.row_inspections(feeds(spark, d)))


@query("routes_without_trips", f"select coalesce(feed, '') feed, 'INS007' rule_id, 'routes' file, row_id as row, {x('route_id')} as key, null::varchar observed from routes r where not exists (select 1 from trips t where coalesce(t.feed, '') = coalesce(r.feed, '') and {x('t.route_id')} = {x('r.route_id')})")
def routes_without_trips(spark: SparkSession, d: str) -> DataFrame:
    return found(inspection.routes_without_trips(feeds(spark, d)))


TRIP_KINDS_SQL = f"""with c as (select coalesce(feed, '') f, {x('trip_id')} t, count(*) n from stop_times group by 1, 2), h as (select coalesce(feed, '') f, {x('shape_id')} s, count(*) n from shapes group by 1, 2),
a as (select distinct feed f, service_id s from ({EXPAND_SQL})), m as (select coalesce(t.feed, '') feed, t.row_id, {x('t.route_id')} route_id, coalesce(c.n, 0) cn, h.n hn, {x('t.shape_id')} sh, {x('t.trip_headsign')} hd, a.s sv from trips t
left join c on c.f = coalesce(t.feed, '') and c.t = {x('t.trip_id')} left join h on h.f = coalesce(t.feed, '') and h.s = {x('t.shape_id')} left join a on a.f = coalesce(t.feed, '') and a.s = {x('t.service_id')}),
u as (select feed, route_id, row_id, unnest(list_filter([case when cn < 2 then 'INS010' end, case when hn = 1 then 'INS011' end, case when sh = '' then 'INS012' end, case when hd = '' then 'INS013' end, case when sv is null then 'INS014' end], lambda e: e is not null)) rule_id from m)
select feed, route_id, rule_id, count(*) trips, min(row_id) first_row from u group by 1, 2, 3"""


@query("trip_kinds", TRIP_KINDS_SQL)
def trip_kinds(spark: SparkSession, d: str) -> DataFrame:
    return inspection.trip_kinds(feeds(spark, d)).withColumnRenamed("_feed", "feed")


@query("shared_short_names", f"select distinct {x('route_short_name')} as name from routes where feed = 'cad' and {x('route_short_name')} <> '' and {x('route_short_name')} in (select {x('route_short_name')} from routes where feed = 'rail')")
def shared_short_names(spark: SparkSession, d: str) -> DataFrame:
    return inspection.shared_short_names(feeds(spark, d)["routes"], "cad", "rail")


@query("contiguity_breaks", f"with s as (select coalesce(feed, '') feed, row_id, {x('trip_id')} t from stop_times), w as (select *, lag(t) over (partition by feed order by row_id) p from s) select feed, t trip_id, count(*) runs from w where p is null or p <> t group by 1, 2 having count(*) > 1")
def contiguity_breaks(spark: SparkSession, d: str) -> DataFrame:
    return patterns.contiguity_breaks(feeds(spark, d)["stop_times"]).withColumnRenamed("_feed", "feed")


_LABEL = "case when {0} = '' then 'row ' || row_id else {1} end"


@query("profile_missing_values", ALL.join(_f("AG04", "trips", f"{x(c)} = ''", _LABEL.format(x("trip_id"), x("trip_id")), f"'{c}'") for c in ("trip_headsign", "direction_id", "shape_id", "bikes_allowed")))
def profile_missing_values(spark: SparkSession, d: str) -> DataFrame:
    return found(profile.missing_values(feeds(spark, d)["trips"], "trips", ["trip_headsign", "direction_id", "shape_id", "bikes_allowed"], "trip_id"))


@query("profile_value_counts", f"select coalesce(feed, '') feed, {x('location_type')} as value, count(*) n from stops group by 1, 2")
def profile_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(feeds(spark, d)["stops"], "location_type")


@query("profile_parents", f"with h as (select distinct coalesce(feed, '') f, {x('stop_id')} k from stops) select q.feed, parent, children, h.k is not null known from (select coalesce(feed, '') feed, {x('parent_station')} parent, count(distinct {x('stop_id')}) children from stops where {x('parent_station')} <> '' group by 1, 2) q left join h on h.f = q.feed and h.k = q.parent")
def profile_parents(spark: SparkSession, d: str) -> DataFrame:
    return profile.parent_summary(feeds(spark, d)["stops"])


_SORTED = f"(select {x('route_short_name')} nm, {x('route_type')} o from routes where feed = 'rail' and {x('route_short_name')} <> '')"


@query("profile_sort_order", f"""with m as (select nm, list(distinct o) filter (o <> '') has from {_SORTED} group by 1), w as (select {x('route_short_name')} nm, min({x('route_type')}) want, count(distinct {x('route_type')}) n from routes where feed = 'final' and {x('route_short_name')} <> '' group by 1),
b as (select coalesce(m.nm, w.nm) nm, m.nm is not null mine, coalesce(len(has), 0) k, has[1] h, want, n from m full join w on m.nm = w.nm), p as (select nm, case when n > 1 then 'reference_repeats' when want is null then 'not_in_reference' when not mine then 'not_used' when k = 0 then 'no_value' when k > 1 then 'several_values' when not regexp_full_match(h, '[0-9]+') then 'not_a_number' when h <> want then 'differs' end problem from b)
select nm route_short_name, problem from p where problem is not null""")
def profile_sort_order(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)["routes"].withColumn("route_sort_order", F.col("route_type"))
    return profile.sort_order(t.where("_feed = 'rail'"), t.where("_feed = 'final'"))


_IDS = lambda f: f"(select {x('stop_id')} id, min({x('stop_name')}) nm from stops where feed = '{f}' and {x('stop_id')} <> '' group by 1)"


@query("stops_missing", f"select case when id in (select {x('stop_id')} from stop_times where feed = 'cad') then 'error' else 'warning' end severity, id as key, nm expected from {_IDS('cad')} where id not in (select id from {_IDS('hastus')})")
def stops_missing(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return reconciliation.stops_missing(one(t, "cad")["stops"], one(t, "cad")["stop_times"], one(t, "hastus")["stops"]).select("severity", "key", "expected")


@query("stops_of_no_source", f"select id as key from {_IDS('hastus')} where id not in (select {x('stop_id')} from stops where feed in ('cad', 'rail'))")
def stops_of_no_source(spark: SparkSession, d: str) -> DataFrame:
    s = feeds(spark, d)["stops"]
    return reconciliation.stops_of_no_source(s.where("_feed = 'hastus'"), [s.where("_feed = 'cad'"), s.where("_feed = 'rail'")]).select("key")


_KEPT = lambda f: f"(select k, m.* from (select {x('stop_id')} k, arg_min(struct_pack(nm := {x('stop_name')}, la := {x('stop_lat')}, lo := {x('stop_lon')}, wh := {x('wheelchair_boarding')}, co := {x('stop_code')}), row_id) m from stops where feed = '{f}' and {x('stop_id')} <> '' group by 1))"
KEPT_SQL = f"""with m as (select s.k, t.nm fn, {NAME('s.nm')} = {NAME('t.nm')} same, {_HAV('s', 't')} near, s.wh sw, t.wh tw, s.co sc, t.co tc from {_KEPT('hastus')} t join {_KEPT('cad')} s on s.k = t.k)
select 'STP007' rule_id, k as key, fn observed from m where not same union all select 'STP008', k, format('{{:,.1f}}', near) from m where near > 15
union all select 'STP009', k, 'wheelchair_boarding: ' || tw from m where sw <> '' and sw <> tw union all select 'STP009', k, 'stop_code: ' || tc from m where sc <> '' and sc <> tc"""


@query("kept_metadata", KEPT_SQL)
def kept_metadata(spark: SparkSession, d: str) -> DataFrame:
    s = feeds(spark, d)["stops"]
    return reconciliation.kept_metadata(s.where("_feed = 'hastus'"), [s.where("_feed = 'cad'")], ["wheelchair_boarding", "stop_code"]).select("rule_id", "key", "observed")


CHANGED_SQL = f"""with {NAMED_SQL}, sc as (select f, t, string_agg(concat_ws('|', n, c.stop, c.a, c.d, c.p, c.o, chr(10)), '' order by n) sp from {GOT} group by 1, 2)
select case when a.pr <> b.pr then 'TRP100' else 'TRP101' end rule_id, a.t as key, a.stop_count::varchar observed from j a join j b on a.f = 'hastus' and b.f = 'cad' and a.t = b.t join sc p on p.f = a.f and p.t = a.t join sc q on q.f = b.f and q.t = b.t where p.sp <> q.sp"""


@query("changed_trips", CHANGED_SQL)
def changed_trips(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d)
    return reconciliation.changed_trips(named.where("_feed = 'hastus'"), named.where("_feed = 'cad'")).select("rule_id", "key", "observed")


@query("without_routes_named", f"with g as (select distinct {x('route_short_name')} n from routes where feed = 'rail') select t.row_id from trips t where t.feed = 'cad' and {x('t.route_id')} not in (select {x('route_id')} from routes r where r.feed = 'cad' and {x('r.route_short_name')} in (select n from g))")
def without_routes_named(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    return reconciliation.without_routes_named(one(t, "cad"), one(t, "rail")["routes"].select(strip("route_short_name")))["trips"].select("row_id")


_RF = ["route_long_name", "route_type", "route_color"]


@query("route_changes", f"""with a as (select distinct {x('route_short_name')} nm, {', '.join(f'{x(c)} {c}' for c in _RF)} from routes where feed = 'cad'), b as (select distinct {x('route_short_name')} nm, {', '.join(f'{x(c)} {c}' for c in _RF)} from routes where feed = 'hastus'),
m as (select nm, {', '.join(f'bool_and(a.{c} <> b.{c}) {c}' for c in _RF)} from a join b using (nm) where nm <> '' group by 1)
select nm as name, concat_ws(',', {', '.join(f"case when {c} then '{c}' end" for c in _RF)}) changed from m where {' or '.join(_RF)}""")
def route_changes(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)["routes"]
    return reconciliation.route_changes(t.where("_feed = 'cad'"), t.where("_feed = 'hastus'"), _RF).withColumn("changed", F.array_join("changed", ","))


@query("stop_changes", f"""with w as ({WALK_SQL}), s as (select * from {_KEPT('cad')} where k in (select {x('stop_id')} from stop_times where feed = 'cad')), m as (select s.*, w.target_id, t.k tk, t.nm tn, t.wh tw, t.la ta, t.lo tlo from s left join w on w.source_id = s.k left join {_KEPT('hastus')} t on t.k = w.target_id),
c as (select k stop_id, target_id final_id, case when tk is null then 'missing' else concat_ws(',', case when nm <> tn then 'stop_name' end, case when wh <> tw then 'wheelchair_boarding' end, case when coalesce(abs({PLAIN('la')} - {PLAIN('ta')}) > 1e-6, la <> ta) then 'stop_lat' end, case when coalesce(abs({PLAIN('lo')} - {PLAIN('tlo')}) > 1e-6, lo <> tlo) then 'stop_lon' end) end changed from m)
select * from c where changed <> ''""")
def stop_changes(spark: SparkSession, d: str) -> DataFrame:
    t = feeds(spark, d)
    got = reconciliation.stop_changes(one(t, "cad")["stops"], one(t, "hastus")["stops"], one(t, "cad")["stop_times"], _walk(spark, d), ["stop_name", "wheelchair_boarding"])
    return got.withColumn("changed", F.array_join("changed", ","))


@query("audit_findings", f"""with q as ({DATED_SQL}) select 'RAIL002' rule_id, case when status = 'missing' then 'error' else 'warning' end severity, trip_id as key, replace(issues, ',', ', ') observed from q where status in ('missing', 'issues', 'unverifiable')
union all select 'RAIL003', 'warning', id, null from (select distinct {x('trip_id')} id from trips where feed = 'hastus' and {x('trip_id')} <> '') where id not in (select final_trip_id from q where final_trip_id is not null)""")
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    ids = feeds(spark, d, "hastus")["trips"].select(strip("trip_id").alias("trip_id")).where("trip_id != ''")
    return reconciliation.audit_findings(_statuses(spark, d), ids).select("rule_id", "severity", "key", "observed")


@query("journey_findings")
def journey_findings(spark: SparkSession, d: str) -> DataFrame:
    return found(reconciliation.journey_findings(patterns.compared_journeys(_named(spark, d), "cad", "hastus"), variation_pairs(spark, d)))
