"""The core's queries on the test tables; those of the llm subpackage are in its own module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.common import strip, table
from tramline.operators import copydiff, logs, nearby, references, rejects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_PARENTS = """
  select 'trips' ptab, feed, trim(trip_id) k, loaded_at l, deleted_at g from trips union all select 'stops', feed, trim(stop_id), loaded_at, deleted_at from stops
  union all select 'shapes', feed, trim(shape_id), loaded_at, deleted_at from shapes union all select 'calendar', feed, trim(service_id), loaded_at, deleted_at from calendar"""
_REFS = """
  select 'stop_times' tab, 'trip_id' fld, 'trips' ptab, row_id, feed, trim(trip_id) k, loaded_at t from stop_times
  union all select 'stop_times', 'stop_id', 'stops', row_id, feed, trim(stop_id), loaded_at from stop_times
  union all select 'trips', 'shape_id', 'shapes', row_id, feed, trim(shape_id), loaded_at from trips
  union all select 'trips', 'service_id', 'calendar', row_id, feed, trim(service_id), loaded_at from trips"""
_ORPHANS = f"""with p as ({_PARENTS}), r as (select * from ({_REFS}) where coalesce(k, '') <> ''), j as (
  select r.tab, r.fld, r.row_id, r.t, count(p.k) n, min(p.l) born, coalesce(bool_or(p.l <= r.t and (p.g is null or p.g > r.t)), false) live
  from r left join p on r.ptab = p.ptab and r.feed = p.feed and r.k = p.k group by all),
o as (select tab, fld, row_id, t, case when n = 0 then 'missing' when born > t then 'late' else 'deleted' end reason from j where not live)"""

_ISO, _ZONE = r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d", r"(?:[.,]\d+)?(?: ?(?:Z|[+-]\d\d:?\d\d))?"
_LAYOUTS = {
    "a": (rf"^({_ISO}){_ZONE}\s+(\pL+)\s+([^\s\[\]()]+)\s+-\s", "['time', 'level', 'component']"),
    "b": (r"^(\d\d/\d\d/\d{4} \d\d:\d\d:\d\d)\s+-\s+(\pL+)\s*-\s+([^\s\[\]()]+)\s+-\s", "['time', 'level', 'component']"),
    "c": (rf"^\[({_ISO}){_ZONE}\]\s*\[\s*(\pL+)\s*\]\s*\[\s*([^\s\]]+)\s*\]", "['time', 'level', 'component']"),
    "d": (rf"^\[(\d\d/\pL{{3}}/\d{{4}}:\d\d:\d\d:\d\d){_ZONE}\]\s+([^\s\[\]()]+)\s+(\pL+)\s*:", "['time', 'component', 'level']"),
    "e": (r"^(\pL{3} {1,2}\d{1,2} \d\d:\d\d:\d\d)\s+\S+\s+([^\s\[\]():]+)(?:\[\d+\])?():", "['time', 'component', 'level']"),
    "f": (r"^(\d{8} \d{6})\|\s*(\pL+)\s*\|\s*([^|]*?)\s*\|", "['time', 'level', 'component']"),
    "g": (r"^(\d{9,10})(?:\.\d+)?\s+(\pL)/([^\s():]+)\s*\(\s*\d+\):", "['time', 'level', 'component']"),
    "h": (r"^(?i:(debug|info|warning|warn|error|fatal|avertissement|erreur))()()\s*:", "['level', 'time', 'component']"),
}
_PAIR = lambda k: f"coalesce(nullif(regexp_extract(t, '(?:^|\\s){k}=([^\\s\"]+)', 1), ''), '')"
_JSON = lambda k: f"case when t like '{{%' and json_valid(t) then coalesce(json_extract_string(t, '$.{k}'), '') else '' end"
_CASES = " ".join(f"when regexp_matches(t, '{p}') then (select struct_pack(time := q.time, level := q.level, component := q.component) from (select regexp_extract(t, '{p}', {names}) q))" for p, names in _LAYOUTS.values())
P1_FOUND = f"""with l as (select log_id, line_number::bigint n, regexp_replace(coalesce(message, ''), '[\\r\\n]+$', '') t, strftime(loaded_at, '%Y') y from error_warning),
h as (select *, case {_CASES} when regexp_matches(t, '^\\w+=') and {_PAIR('ts')} <> '' then struct_pack(time := {_PAIR('ts')}, level := {_PAIR('lvl')}, component := {_PAIR('mod')})
  when {_JSON('time')} <> '' then struct_pack(time := {_JSON('time')}, level := {_JSON('level')}, component := {_JSON('logger')}) end q from l),
f as (select *, max(case when q is not null then n end) over (partition by log_id order by n) first_line from h),
e as (select log_id, first_line, max(case when regexp_matches(t, '[^\\s\\x{{a0}}]') then n end) last_line, arg_min(q, n) q, arg_min(y, n) y from f where first_line is not null group by 1, 2),
m as (select *, list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(regexp_extract(q.time, '\\pL{{3}}'))) mon from e)
select log_id, first_line, last_line, case when q.time = '' then '' when regexp_matches(q.time, '^\\d{{4}}-') then left(q.time, 10) || ' ' || substr(q.time, 12, 8)
  when regexp_matches(q.time, '^\\d\\d/\\d\\d/') then substr(q.time, 7, 4) || '-' || substr(q.time, 4, 2) || '-' || left(q.time, 2) || ' ' || substr(q.time, 12, 8)
  when regexp_matches(q.time, '^\\d\\d/') then substr(q.time, 8, 4) || '-' || lpad(mon::varchar, 2, '0') || '-' || left(q.time, 2) || ' ' || substr(q.time, 13, 8)
  when regexp_matches(q.time, '^\\pL') then y || '-' || lpad(mon::varchar, 2, '0') || '-' || lpad(trim(substr(q.time, 4, 3)), 2, '0') || ' ' || right(q.time, 8)
  when regexp_matches(q.time, '^\\d{{8}} ') then regexp_replace(q.time, '(....)(..)(..) (..)(..)(..)', '\\1-\\2-\\3 \\4:\\5:\\6') else strftime(make_timestamp(try_cast(q.time as bigint) * 1000000), '%Y-%m-%d %H:%M:%S') end logged_at,
case when lower(q.level) in ('debug', 'd') then 'DEBUG' when lower(q.level) in ('info', 'i') then 'INFO' when lower(q.level) in ('warning', 'warn', 'w', 'avertissement') then 'WARNING' when lower(q.level) in ('error', 'err', 'e', 'erreur') then 'ERROR' when lower(q.level) in ('fatal', 'f') then 'FATAL' else '' end severity, trim(q.component) component from m"""

_AFTER = " ".join(f"when regexp_matches(t, '{p}') then {'' if k == 'f' else 'ltrim'}(regexp_replace(t, '{p}', ''){'' if k == 'f' else ', ' + chr(39) + ' ' + chr(39) + ' || chr(9)'})" for k, (p, _) in _LAYOUTS.items())
_MESSAGE = f"""case {_AFTER} when regexp_matches(t, '^\\w+=') then regexp_extract(t, '(?:^|\\s)(?:msg|message|text)="([^"\\\\]*(?:\\\\.[^"\\\\]*)*)"', 1) when {_JSON('time')} <> '' then {_JSON('msg')} else t end"""
P1_ENTRIES = P1_FOUND.replace("f as (select *,", f"g as (select *, case when q is null then t else {_MESSAGE} end said from h), f as (select *,").replace("from h), e as", "from h), e as").replace("over (partition by log_id order by n) first_line from h)", "over (partition by log_id order by n) first_line from g)")
P1_ENTRIES = P1_ENTRIES.replace("arg_min(q, n) q,", "string_agg(said, chr(10) order by n) filter (n <= till) message, arg_min(q, n) q,").replace("from f where first_line is not null group by 1, 2)", "from (select *, coalesce(max(case when regexp_matches(t, '[^\\s\\x{a0}]') then n end) over (partition by log_id, first_line), first_line) till from f) where first_line is not null group by 1, 2)").replace("trim(q.component) component from m", "trim(q.component) component, message from m")

P2_FOUND = _ORPHANS + " select tab, fld, row_id, reason from o"
P2_COUNTS = _ORPHANS + """ select o.tab, o.fld, o.month, o.reason, o.n, q.refs from
  (select tab, fld, strftime(t, '%Y-%m') as month, reason, count(*) n from o group by all) o
  join (select tab, fld, strftime(t, '%Y-%m') as month, count(*) refs from r group by all) q using (tab, fld, month)"""

_CELLS = """regexp_extract_all(',' || x, ',("(?:[^"]|"")*"|[^",]*)', 1)"""
_UNQUOTED = "trim(case when v like '\"%' then replace(substr(v, 2, length(v) - 2), '\"\"', '\"') else v end)"
P3_FOUND = f"""with l as (select row_id, file_id, line_number, case when line_number = 1 then regexp_replace(y, '^\ufeff', '') else y end x from (select *, case when line like '%' || chr(13) then left(line, length(line) - 1) else coalesce(line, '') end y from raw_lines)),
h as (select file_id, [lower({_UNQUOTED}) for v in {_CELLS}] names from l where line_number = 1),
c as (select row_id, regexp_full_match(x, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') well, [{_UNQUOTED} for v in {_CELLS}] cells, names from l join h using (file_id) where line_number > 1),
v as (select *, cells[nullif(list_position(names, 'stop_sequence'), 0)] s, cells[nullif(list_position(names, 'arrival_time'), 0)] a, cells[nullif(list_position(names, 'start_date'), 0)] d from c),
r as (select row_id, case when not well then 'quoting' when len(cells) <> len(names) then 'columns'
  when not regexp_full_match(s, '[0-9]+') or not regexp_full_match(a, '([0-9]{{1,3}}:[0-5][0-9]:[0-5][0-9])?')
    or (d is not null and not (regexp_full_match(d, '[0-9]{{8}}') and try_strptime(d, '%Y%m%d') is not null)) then 'value' end reason from v)
select 'raw_lines' tab, row_id, reason from r where reason is not null
union all select 'stop_times', row_id, 'value' from stop_times where not regexp_full_match(trim(coalesce(stop_sequence, '')), '[0-9]+')
  or not regexp_full_match(trim(coalesce(arrival_time, '')), '([0-9]{{1,3}}:[0-5][0-9]:[0-5][0-9])?')
union all select 'calendar', row_id, 'value' from calendar where not regexp_full_match(trim(coalesce(start_date, '')), '[0-9]{{8}}') or try_strptime(trim(start_date), '%Y%m%d') is null"""

P4_FOUND = r"""with p as (select row_id, trim(coalesce(stop_id, '')) k, try_cast(trim(stop_lat) as double) la, try_cast(trim(stop_lon) as double) lo from stops
  where regexp_full_match(trim(stop_lat), '[+-]?[0-9]+(\.[0-9]+)?') and regexp_full_match(trim(stop_lon), '[+-]?[0-9]+(\.[0-9]+)?')),
q as (select *, floor(la / 0.0004)::bigint s from p where la between -90 and 90 and lo between -180 and 180 and not (la = 0 and lo = 0)),
e as (select *, unnest([s - 1, s, s + 1]) z from q)
select a.row_id row_id_a, b.row_id row_id_b from e a join q b on a.z = b.s and a.row_id < b.row_id and a.k <> b.k
where 2 * 6371000.0 * asin(sqrt(least(1, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 35""".replace("\\\\", "\\")


def _diff_sql(tab: str, key: str, fields: dict[str, object]) -> str:
    def put(f: str, how: object) -> str:
        v = f"trim(coalesce({f}, ''))"
        if how is copydiff.colour:
            return f"upper(ltrim({v}, '#'))"
        if how is copydiff.exact_decimal:
            return f"case when regexp_full_match({v}, '[+-]?[0-9]+(\\.[0-9]+)?') then cast(cast({v} as decimal(38, 18)) as varchar) else {v} end"
        return v

    best = f"select feed, trim({key}) k, {', '.join(f'{put(f, how)} {f}' for f, how in fields.items())}, row_number() over (partition by feed, trim({key}) order by loaded_at desc) i from {tab} where deleted_at is null and feed in ('cad', 'hastus') and trim(coalesce({key}, '')) <> ''"
    one = lambda feed: f"(select * from ({best}) where i = 1 and feed = '{feed}')"
    only = f"select '{tab}' tab, coalesce(a.k, b.k) record_key, '' fld, case when b.k is null then 'only_cad' else 'only_hastus' end kind from {one('cad')} a full join {one('hastus')} b on a.k = b.k where a.k is null or b.k is null"
    return " union all ".join([only, *(f"select '{tab}', a.k, '{f}', 'differs' from {one('cad')} a join {one('hastus')} b on a.k = b.k where a.{f} <> b.{f}" for f in fields)])


P5_FOUND = " union all ".join(_diff_sql(t, k, f) for t, k, f in (("stops", "stop_id", copydiff.STOPS), ("trips", "trip_id", copydiff.TRIPS), ("routes", "route_id", copydiff.ROUTES)))


@query("p1_found", P1_FOUND)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_entries(table(spark, d, "error_warning"), with_message=False)


@query("p1_entries", P1_ENTRIES)
def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_entries(table(spark, d, "error_warning"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = references.feed_references(table(spark, d, "stop_times"), table(spark, d, "trips"))
    return refs, references.feed_parents(*(table(spark, d, t) for t in ("trips", "stops", "shapes", "calendar")))


@query("p2_found", P2_FOUND)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_references(spark, d)).select("tab", "fld", "row_id", "reason")


@query("p2_counts", P2_COUNTS)
def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    refs, held = _references(spark, d)
    return references.orphan_counts(refs, references.orphan_references(refs, held))


@query("p3_found", P3_FOUND)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    raw = rejects.checked_lines(table(spark, d, "raw_lines")).where("reason != ''").select(F.lit("raw_lines").alias("tab"), "row_id", "reason")
    for t, fields in (("stop_times", ["stop_sequence", "arrival_time"]), ("calendar", ["start_date"])):
        bad = rejects.split_table(table(spark, d, t), fields)[1]
        raw = raw.unionByName(bad.select(F.lit(t).alias("tab"), F.col("row_id").cast("bigint").alias("row_id"), F.lit("value").alias("reason")))
    return raw


_JOINED = lambda t, cols: f"concat_ws('|', {', '.join(f'coalesce({c}::varchar, {chr(39) * 2})' for c in cols)})"
_CALL_COLUMNS = ["feed", "trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "pickup_type", "drop_off_type", "timepoint"]
_DAY_COLUMNS = ["feed", "service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"]
_NUMBER = lambda v: f"regexp_replace({v}, '^0+([0-9])', '\\1')"
_SECONDS = lambda v: f"case when {v} <> '' then split_part({v}, ':', 1)::int * 3600 + split_part({v}, ':', 2)::int * 60 + split_part({v}, ':', 3)::int end"
_DATE = lambda v: f"strftime(try_strptime({v}, '%Y%m%d'), '%Y-%m-%d')"
P3_LOADED = P3_FOUND[: P3_FOUND.index("select 'raw_lines' tab")].replace("cells, names from l join", f"cells, [{_UNQUOTED[5:-1]} for v in {_CELLS}] whole, names from l join").replace("r as (select row_id,", "r as (select row_id, whole, s, a, d,") + f"""
select 'raw_lines' tab, row_id, {_NUMBER('s')} as sequence, {_SECONDS('a')} arrival_s, {_DATE('d')} start_day, array_to_string(whole, '|') as record from r where reason is null
union all select 'stop_times', row_id, {_NUMBER("trim(stop_sequence)")}, {_SECONDS("trim(coalesce(arrival_time, ''))")}, null, {_JOINED('stop_times', _CALL_COLUMNS)} from stop_times where regexp_full_match(trim(coalesce(stop_sequence, '')), '[0-9]+') and regexp_full_match(trim(coalesce(arrival_time, '')), '([0-9]{{1,3}}:[0-5][0-9]:[0-5][0-9])?')
union all select 'calendar', row_id, null, null, {_DATE('trim(start_date)')}, {_JOINED('calendar', _DAY_COLUMNS)} from calendar where regexp_full_match(trim(coalesce(start_date, '')), '[0-9]{{8}}') and try_strptime(trim(start_date), '%Y%m%d') is not null"""


@query("p3_loaded", P3_LOADED)
def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows of all three tables, checked fields in types and every value as text."""
    out = lambda df, tab, value, record: df.select(F.lit(tab).alias("tab"), F.col("row_id").cast("bigint").alias("row_id"), *rejects.typed(value), record.alias("record"))
    got = out(rejects.loaded_lines(rejects.checked_lines(table(spark, d, "raw_lines"))), "raw_lines", lambda f: F.when(F.array_contains(F.map_keys("record"), f), strip(F.try_element_at("record", F.lit(f)))), F.array_join(F.map_values("record"), "|"))
    for t, fields, cols in (("stop_times", ["stop_sequence", "arrival_time"], _CALL_COLUMNS), ("calendar", ["start_date"], _DAY_COLUMNS)):
        good = rejects.split_table(table(spark, d, t), fields)[0]
        got = got.unionByName(out(good, t, lambda f, held=fields: strip(f) if f in held else F.lit(None).cast("string"), F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols])))
    return got.withColumn("start_day", F.date_format("start_day", "yyyy-MM-dd"))


@query("p4_found", P4_FOUND)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    points = nearby.usable_points(table(spark, d, "stops").withColumn("_label", strip("stop_id")), "stop_lat", "stop_lon")
    return nearby.near_pairs(points, "row_id", "_label", 35.0).select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


@query("p5_found", P5_FOUND)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copydiff.feed_copy_differences(*(table(spark, d, t) for t in ("stops", "trips", "routes")))
