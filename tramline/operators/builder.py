"""Parts of a merged feed: agreed values, stops of several feeds, appended feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.contract import FIELDS


def consensus(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Per group and field the value that all rows agree on, null where they don't, and <field>_conflict. Blank is a value."""
    aggs = []
    for f in fields:
        low, high = F.min(F.coalesce(f, F.lit(""))), F.max(F.coalesce(f, F.lit("")))
        aggs += [F.when(low == high, low).alias(f), (low != high).alias(f"{f}_conflict")]
    return rows.groupBy(*by).agg(*aggs)


def taken(base: Column, agreed: Column, conflict: Column) -> Column:
    """The agreed value, blank too; the base's own where candidates are missing or differ."""
    return F.when(agreed.isNotNull() & ~F.coalesce(conflict, F.lit(False)), agreed).otherwise(base)


def merged_stops(sources: list[DataFrame], walk: DataFrame | None = None) -> DataFrame:
    """Stops of several feeds by precedence: per id the first feed's row, with parents put through walk (source_id, target_id)."""
    cols = sources[0].columns
    every = None
    for i, s in enumerate(sources):
        part = s.select(*[c for c in cols if c in s.columns]).withColumn("_rank", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    every = every.withColumn("stop_id", strip("stop_id")).where("stop_id != ''")
    rest = [c for c in cols if c != "stop_id"]
    out = every.groupBy("stop_id").agg(F.min(F.struct("_rank", "_row", *[c for c in rest if c != "_row"])).alias("m")).select("stop_id", F.col("m._rank").alias("source"), F.col("m._row").alias("_row"), *[f"m.{c}" for c in rest if c != "_row"])
    if walk is None:
        return out
    up = walk.select(F.col("source_id").alias("_p"), F.col("target_id").alias("_t"))
    return out.withColumn("_p", strip("parent_station")).join(up, "_p", "left").withColumn("parent_station", F.coalesce("_t", "_p")).drop("_p", "_t")


def appended(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """base and more below it; a key that both have stops the build."""
    trimmed = lambda df: df.select(*[strip(k).alias(k) for k in key]).distinct()
    if not trimmed(base).join(trimmed(more), key, "left_semi").isEmpty():
        raise ValueError(f"both feeds have the same {', '.join(key)}")
    return base.unionByName(more, allowMissingColumns=True)


def merged_exceptions(sources: list[DataFrame], first: str, last: str) -> DataFrame:
    """Exceptions of several feeds within first..last (yyyyMMdd), equal ones once; differing ones of a service and date stop the build."""
    every = None
    for s in sources:
        part = s.select(*[strip(c).alias(c) for c in FIELDS["calendar_dates"]]).where(F.col("date").between(first, last))
        every = part if every is None else every.unionByName(part)
    every = every.distinct().withColumn("_row", F.lit(None).cast("bigint"))
    if not every.groupBy("service_id", "date").count().where("count > 1").isEmpty():
        raise ValueError("exceptions of one service and date differ")
    return every


def stated_window(trips: DataFrame, feed_info: DataFrame | None, first: str, last: str) -> DataFrame:
    """The first row of feed_info, blank without one, with the window first..last (yyyyMMdd) as the feed's dates."""
    fields = FIELDS["feed_info"]
    row = feed_info.orderBy("_row").limit(1).collect() if feed_info is not None else []
    said = {f: row[0][f] for f in fields if f in feed_info.columns} if row else {}
    said |= {"feed_start_date": first, "feed_end_date": last}
    schema = ", ".join(f"{f} string" for f in fields) + ", _row bigint"
    return trips.sparkSession.createDataFrame([(*[said.get(f) or "" for f in fields], 2)], schema)


def eligible(trips: DataFrame, routes: DataFrame, excluded: list[str], rules: list[tuple[int, int, list[str]]]) -> DataFrame:
    """Trips whose route is not excluded and whose direction is one that the first numeric range holding the route keeps."""
    names = routes.groupBy("_feed", strip("route_id").alias("route_id")).agg(F.min(strip("route_short_name")).alias("_name"))
    ok = ~F.col("_name").isin(excluded) if excluded else F.lit(True)
    n = F.when(F.col("_name").rlike("^[0-9]{1,9}$"), F.col("_name").try_cast("int"))
    for low, high, keep in rules:
        ok = ok & F.coalesce(~n.between(low, high) | strip("direction_id").isin(keep), F.lit(True))
    return trips.withColumn("route_id", strip("route_id")).join(names, ["_feed", "route_id"], "left").withColumn("_name", F.coalesce("_name", F.lit(""))).where(ok).drop("_name")
