"""Technical rules on the tables of feeds.

Tables come as DataFrames of text with _feed and _row, the record's number in its file.  Null is ''.  A blank id is an id like
any other, so a blank reference is fine where a blank id exists.  Empty tables give no findings of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.contract import ENUMS, KEYS
from tramline.functions.scalars import date_of, seconds
from tramline.plans.ledger import as_findings, finding, row_checks, union

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def number(v: Column) -> Column:
    return F.when(v.rlike(NUMBER), v.try_cast("double"))


def whole(v: Column) -> Column:
    """A whole number of at least 0; null for anything else."""
    return F.when(v.rlike(r"^\+?[0-9]{1,9}$"), v.try_cast("int"))


def keyed(rows: DataFrame, table: str) -> DataFrame:
    """rows with _key, the trimmed parts of the primary key joined by ' ¦ '; a shape's number counts by value."""
    parts = [F.coalesce(whole(strip(k)).cast("string"), strip(k)) if table == "shapes" and k == "shape_pt_sequence" else strip(k) for k in KEYS[table]]
    return rows.withColumn("_key", F.concat_ws(" ¦ ", *parts)).withColumn("_blank", F.exists(F.array(*parts), lambda p: p == ""))


def enum_checks(table: str, columns: list[str], enums: dict[str, dict[str, list[str]]] = ENUMS) -> list[tuple[Column, list[Column]]]:
    return [(~strip(c).isin(allowed), finding("VAL001", "error", "Field values", table, F.col("_row"), None, F.concat(F.lit(f"{c}: "), strip(c)), ", ".join(sorted(allowed)))) for c, allowed in enums.get(table, {}).items() if c in columns]


def table_checks(rows: DataFrame, table: str, enums: dict[str, dict[str, list[str]]] = ENUMS) -> DataFrame:
    """Every rule of a table that looks at one row: key parts, enums, dates, coordinates, colours, numbers, times."""
    cols, row = rows.columns, F.col("_row")
    checks = enum_checks(table, cols, enums)
    if table in KEYS and table not in ("stop_times", "agency"):
        rows = keyed(rows, table)
        checks.append((F.col("_blank"), finding("REL001", "error", "Relationships", table, row)))
    for c in ("start_date", "end_date", "date", "feed_start_date", "feed_end_date"):
        if c in cols and table in ("calendar", "calendar_dates", "feed_info"):
            checks.append(((strip(c) != "") & date_of(strip(c)).isNull(), finding("VAL002", "error", "Field values", table, row, None, F.concat(F.lit(f"{c}: "), strip(c)), "YYYYMMDD")))
    if table == "stops":
        for c, most in (("stop_lat", 90), ("stop_lon", 180)):
            checks.append(((strip(c) != "") & ~F.coalesce(number(strip(c)).between(-most, most), F.lit(False)), finding("VAL003", "error", "Geography", table, row, strip("stop_id"), F.concat(F.lit(f"{c}: "), strip(c)))))
        kind, parent = strip("location_type"), strip("parent_station")
        checks.append(((kind == "1") & (parent != ""), finding("REL004", "error", "Relationships", table, row, strip("stop_id"))))
        checks.append((kind.isin("2", "3", "4") & (parent == ""), finding("REL012", "error", "Relationships", table, row, strip("stop_id"))))
    if table == "routes":
        for c in ("route_color", "route_text_color"):
            if c in cols:
                checks.append(((strip(c) != "") & ~strip(c).rlike("^[0-9A-Fa-f]{6}$"), finding("VAL004", "error", "Field values", table, row, strip("route_id"), F.concat(F.lit(f"{c}: "), strip(c)), "RRGGBB")))
    if table == "shapes":
        n = whole(strip("shape_pt_sequence"))
        checks.append((n.isNull(), finding("GEO001", "error", "Geography", table, row, strip("shape_id"), strip("shape_pt_sequence"))))
        for c, most in (("shape_pt_lat", 90), ("shape_pt_lon", 180)):
            checks.append((n.isNotNull() & ~F.coalesce(number(strip(c)).between(-most, most), F.lit(False)), finding("GEO002", "error", "Geography", table, row, F.concat(strip("shape_id"), F.lit(":"), n.cast("string")), F.concat(F.lit(f"{c}: "), strip(c)))))
    if table == "stop_times":
        n, key = whole(strip("stop_sequence")), F.concat(strip("trip_id"), F.lit(":"), whole(strip("stop_sequence")).cast("string"))
        checks.append((n.isNull(), finding("TIME001", "error", "Stop times", table, row, strip("trip_id"), strip("stop_sequence"))))
        arrival, departure = strip("arrival_time"), strip("departure_time")
        for v in (arrival, departure):
            checks.append((n.isNotNull() & (v != "") & seconds(v).isNull(), finding("TIME002", "error", "Stop times", table, row, key, v)))
        checks.append((n.isNotNull() & (seconds(arrival) > seconds(departure)), finding("TIME003", "error", "Stop times", table, row, key, F.concat(arrival, F.lit(" → "), departure))))
    return row_checks(rows, checks)


def repeated_keys(rows: DataFrame, table: str) -> DataFrame:
    """REL002 (TIME004 for stop_times): rows whose key an earlier row of the feed has; expected cites that row.

    The first rows of keys are found by a map-side aggregate and meet the rows again by a join, which splits hot keys, so
    that no key's rows need to be sorted in one task.
    """
    rows = keyed(rows, table)
    ok = F.lit(True) if table != "stop_times" else whole(strip("stop_sequence")).isNotNull()
    if table == "shapes":
        ok = whole(strip("shape_pt_sequence")).isNotNull()
    rows = rows.where(ok & ~F.col("_blank")).select("_feed", "_row", "_key")
    first = rows.groupBy("_feed", "_key").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    rule, category = ("TIME004", "Stop times") if table == "stop_times" else ("REL002", "Relationships")
    late = rows.join(first, ["_feed", "_key"]).where("_row > _first")
    return as_findings(late, *finding(rule, "error", category, table, F.col("_row"), F.col("_key"), None, F.concat(F.lit("first in row "), F.col("_first").cast("string"))))


def duplicate_key_values(rows: DataFrame, table: str) -> DataFrame:
    """(feed, key, n): keys that several rows have."""
    return keyed(rows, table).where("not _blank").groupBy(F.col("_feed").alias("feed"), F.col("_key").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def unknown_references(rows: DataFrame, table: str, fields: list[tuple[str, DataFrame, str, str, Column, bool]]) -> DataFrame:
    """Rows whose references are no ids of their parent tables in the same feed; fields: (field, parent, its id, rule, key, blank is fine).

    The distinct ids of all fields are anti-joined in one pass, then meet the rows in another.
    """
    ref = lambda i, f: F.struct(F.lit(i).alias("_i"), strip(f).alias("_ref"))
    named = rows.select("_feed", F.inline(F.array(*[ref(i, f) for i, (f, *_) in enumerate(fields)]))).distinct()
    blank = [i for i, f in enumerate(fields) if f[5]]
    if blank:
        named = named.where((F.col("_ref") != "") | ~F.col("_i").isin(blank))
    held = None
    for i, (_, parent, ident, *_) in enumerate(fields):
        part = parent.select("_feed", F.lit(i).alias("_i"), strip(ident).alias("_ref"))
        held = part if held is None else held.unionByName(part)
    lost = named.join(held.distinct(), ["_feed", "_i", "_ref"], "left_anti")
    each = F.array(*[F.struct(F.lit(i).alias("_i"), strip(f).alias("_ref"), key.alias("_k"), F.lit(rule).alias("_rule")) for i, (f, _, _, rule, key, _) in enumerate(fields)])
    bad = rows.select("_feed", "_row", F.inline(each)).join(lost, ["_feed", "_i", "_ref"])
    return bad.select(F.col("_feed").alias("feed"), F.col("_rule").alias("rule_id"), *finding("", "error", "Relationships", table, F.col("_row"), F.col("_k"), F.col("_ref"))[1:])


def parent_checks(stops: DataFrame) -> DataFrame:
    """REL003 and REL011: parents that don't exist or have the wrong type. Boarding areas (4) need a platform, others a station."""
    kind = lambda c: F.when(strip(c) == "", "0").otherwise(strip(c))
    child = stops.where(strip("parent_station") != "").select("_feed", "_row", strip("stop_id").alias("_k"), strip("parent_station").alias("_p"), kind("location_type").alias("_t")).where("_t != '1'")
    held = stops.groupBy("_feed", strip("stop_id").alias("_p")).agg(F.max_by(kind("location_type"), "_row").alias("_pt"))
    met = child.join(held, ["_feed", "_p"], "left").withColumn("_want", F.when(F.col("_t") == "4", "0").otherwise("1"))
    lost = as_findings(met.where("_pt is null"), *finding("REL003", "error", "Relationships", "stops", F.col("_row"), F.col("_k"), F.col("_p")))
    wrong = as_findings(met.where("_pt is not null and _pt != _want"), *finding("REL011", "error", "Relationships", "stops", F.col("_row"), F.col("_k"), F.col("_pt"), F.col("_want")))
    return lost.unionByName(wrong)


def unused_shapes(shapes: DataFrame, trips: DataFrame) -> DataFrame:
    """REL010: shapes that no trip of the feed uses. A shape none of whose points has a valid number is none."""
    held = shapes.where(whole(strip("shape_pt_sequence")).isNotNull()).select("_feed", strip("shape_id").alias("_k")).distinct()
    used = trips.select("_feed", strip("shape_id").alias("_k")).distinct()
    return as_findings(held.join(used, ["_feed", "_k"], "left_anti").where("_k != ''"), *finding("REL010", "warning", "Relationships", "shapes", None, F.col("_k")))


def carried_last(rows: DataFrame, keys: list[str], order: str, value: str, highest: int | None = None, block: int = 4096) -> DataFrame:
    """rows with _before, the last non-null value of earlier rows of the same keys in order of the whole number `order`.

    The running value is found inside blocks of `order`; what a block hands on to the next ones goes through one row per
    block.  highest, if known, is the largest order there is: below `block` every key has one block and hands nothing on.
    """
    rows = rows.withColumn("_blk", F.floor(F.col(order) / block))
    inside = F.last(value, ignorenulls=True).over(W.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    seen = rows.withColumn("_before", inside)
    if highest is not None and highest < block:
        return seen.drop("_blk")
    ends = rows.groupBy(*keys, "_blk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    handed = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1))).where("_carry is not null").select(*keys, "_blk", "_carry")
    return seen.join(handed, [*keys, "_blk"], "left").withColumn("_before", F.coalesce("_before", "_carry")).drop("_carry", "_blk")


def time_regressions(stop_times: DataFrame) -> DataFrame:
    """TIME005: a call before the last known time of the trip's earlier calls. Of calls with one number the first row counts."""
    calls = stop_times.select("_feed", "_row", strip("trip_id").alias("_t"), whole(strip("stop_sequence")).alias("_n"), seconds(strip("arrival_time")).alias("_a"), seconds(strip("departure_time")).alias("_d")).where("_n is not null")
    calls = calls.groupBy("_feed", "_t", "_n").agg(F.min(F.struct("_row", "_a", "_d")).alias("m")).select("_feed", "_t", "_n", "m.*")
    calls = calls.withColumn("_come", F.coalesce("_a", "_d")).withColumn("_go", F.coalesce("_d", "_a"))
    highest = stop_times.agg(F.max(whole(strip("stop_sequence")))).first()[0] or 0  # a scan of one column
    late = carried_last(calls, ["_feed", "_t"], "_n", "_go", highest).where("_come < _before")
    return as_findings(late, *finding("TIME005", "error", "Stop times", "stop_times", F.col("_row"), F.concat(F.col("_t"), F.lit(":"), F.col("_n").cast("string")), F.col("_come").cast("string"), F.concat(F.lit(">= "), F.col("_before").cast("string"))))


def reference_checks(t: dict[str, DataFrame]) -> DataFrame:
    """REL005 to REL009 over the tables that are there; service ids may come from either calendar."""
    trip, call = strip("trip_id"), F.concat(strip("trip_id"), F.lit(":"), strip("stop_sequence"))
    services = [t[c].select("_feed", "service_id") for c in ("calendar", "calendar_dates") if c in t]
    fields = [("route_id", t["routes"], "route_id", "REL007", trip, False), ("service_id", services[0] if len(services) == 1 else services[0].unionByName(services[1]), "service_id", "REL008", trip, False)]
    if "shapes" in t and "shape_id" in t["trips"].columns:
        held = t["shapes"].where(whole(strip("shape_pt_sequence")).isNotNull())
        fields.append(("shape_id", held, "shape_id", "REL009", trip, True))
    calls = unknown_references(t["stop_times"], "stop_times", [("trip_id", t["trips"], "trip_id", "REL005", trip, False), ("stop_id", t["stops"], "stop_id", "REL006", call, False)])
    return calls.unionByName(unknown_references(t["trips"], "trips", fields))


def technical(t: dict[str, DataFrame]) -> DataFrame:
    """All findings of the technical rules on a bundle of tables."""
    out = [table_checks(df, name) for name, df in t.items() if name in KEYS or name == "feed_info"]
    out += [repeated_keys(t[name], name) for name in KEYS if name in t and name != "agency"]
    out += [parent_checks(t["stops"]), reference_checks(t), time_regressions(t["stop_times"])]
    if "shapes" in t and "shape_id" in t["trips"].columns:
        out.append(unused_shapes(t["shapes"], t["trips"]))
    return union(out)


def entity_counts(t: dict[str, DataFrame]) -> DataFrame:
    """(feed, entity, n): distinct non-blank ids per feed."""
    each = [df.select(F.col("_feed").alias("feed"), F.lit(name).alias("entity"), strip(key).alias("k")) for name, key in (("routes", "route_id"), ("stops", "stop_id"), ("trips", "trip_id"), ("shapes", "shape_id"), ("calendar", "service_id")) if (df := t.get(name)) is not None]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.where("k != ''").groupBy("feed", "entity").agg(F.count_distinct("k").alias("n"))
