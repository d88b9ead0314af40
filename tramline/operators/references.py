"""References to records that do not exist, are no longer there or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.common import cut, hot_keys, maybe_broadcast, ntz, skew_join, strip

KEY = ["ptab", "feed", "key"]


def references(rows: DataFrame, tab: str, fields: dict[str, str]) -> DataFrame:
    """(tab, fld, ptab, row_id, feed, key, at): one row per non-blank reference; fields gives the parent table by field.

    at is loaded_at; a row without one counts as loaded after everything else.
    """
    each = F.array(*[F.struct(F.lit(f).alias("fld"), F.lit(p).alias("ptab"), strip(f).alias("key")) for f, p in fields.items()])
    at = F.coalesce(ntz("loaded_at"), F.lit("9999-12-31").cast("timestamp_ntz"))
    return rows.select(F.lit(tab).alias("tab"), F.col("row_id").cast("bigint").alias("row_id"), F.coalesce("feed", F.lit("")).alias("feed"), at.alias("at"), F.inline(each)).where("key != ''")


def parents(rows: DataFrame, tab: str, key: str) -> DataFrame:
    """(ptab, feed, key, born, gone): one row per parent row with a key; no loaded_at counts as there from the start."""
    has_end = "deleted_at" in rows.columns
    return rows.select(F.lit(tab).alias("ptab"), F.coalesce("feed", F.lit("")).alias("feed"), strip(key).alias("key"), F.coalesce(ntz("loaded_at"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("born"), (ntz("deleted_at") if has_end else F.lit(None).cast("timestamp_ntz")).alias("gone")).where("key != ''")


def _uncovered(times: DataFrame, spans: DataFrame) -> DataFrame:
    """(KEY, at) of times, distinct (KEY, at), at which none of the key's spans (KEY, born, gone) holds.

    A time is covered if the latest end among the spans begun by then lies after it, so a running maximum decides, however
    long spans are and however many overlap.  It runs inside hours of a key; what earlier hours reached goes through one row
    per key and hour.
    """
    events = spans.where("born < gone").groupBy(*KEY, F.col("born").alias("at")).agg(F.max("gone").alias("gone")).withColumn("asked", F.lit(False))
    events = events.unionByName(times.select(*KEY, "at", F.lit(None).cast("timestamp_ntz").alias("gone"), F.lit(True).alias("asked"))).withColumn("hour", F.date_trunc("hour", F.col("at").cast("timestamp_ntz")))
    carried = events.groupBy(*KEY, "hour").agg(F.max("gone").alias("reach")).withColumn("reach", F.max("reach").over(W.partitionBy(*KEY).orderBy("hour").rowsBetween(W.unboundedPreceding, -1)))
    inside = events.withColumn("here", F.max("gone").over(W.partitionBy(*KEY, "hour").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)))
    met = inside.where("asked").join(carried.where("reach is not null"), [*KEY, "hour"], "left")
    return met.where("not coalesce(greatest(here, reach) > at, false)").select(*KEY, "at")


def orphan_references(refs: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """(tab, fld, row_id, at, reason) of references without a live parent row; reason is missing, late or deleted.

    The distinct keys referred to are compared with one summary row per parent key; keys none of whose references can
    fail are dropped there, and only the others meet the referring rows again.  Keys that hold much of all rows are
    salted in that second join.  A row at a time before all its parents' loading is late; between a parent's loading
    and its withdrawal, or after the loading of one never withdrawn, it is fine; else deleted.  That is found for the
    distinct times of a key, whose failing ones meet the rows once more.  Empty inputs give no rows.
    """
    named = refs.groupBy(*KEY).agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    known = parent_rows.groupBy(*KEY).agg(F.min("born").alias("born"), F.min(F.when(F.col("gone").isNull(), F.col("born"))).alias("open"))
    suspect = cut(named.join(known, KEY, "left").where("open is null or first_at < open").select(*KEY, "n", "born", "open"))
    bare, fits = maybe_broadcast(suspect.select(*KEY, "born", "open"), 96)
    if fits:
        met = refs.join(bare, KEY)
    else:
        met = skew_join(refs, bare, KEY, hot_keys(suspect, KEY, "n"), "n")
    met = met.where("open is null or at < open").select("tab", "fld", "row_id", "at", *KEY, "born")
    sure = met.where("born is null or at < born").select("tab", "fld", "row_id", "at", F.when(F.col("born").isNull(), "missing").otherwise("late").alias("reason"))
    between = met.where("at >= born")
    times = cut(between.groupBy(*KEY, "at").agg(F.count("*").alias("n")))
    spans = parent_rows.where("gone is not null").join(F.broadcast(suspect.select(*KEY)) if fits else suspect.select(*KEY), KEY, "left_semi")
    bad = cut(_uncovered(times, spans))
    few, small = maybe_broadcast(bad, 72)
    dead = between.join(few, [*KEY, "at"], "left_semi") if small else skew_join(between, bad, [*KEY, "at"], hot_keys(times, [*KEY, "at"], "n"), "n", "left_semi")
    return sure.unionByName(dead.select("tab", "fld", "row_id", "at", F.lit("deleted").alias("reason")))


def feed_references(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    return references(stop_times, "stop_times", {"trip_id": "trips", "stop_id": "stops"}).unionByName(references(trips, "trips", {"shape_id": "shapes", "service_id": "calendar"}))


def feed_parents(trips: DataFrame, stops: DataFrame, shapes: DataFrame, calendar: DataFrame) -> DataFrame:
    return parents(trips, "trips", "trip_id").unionByName(parents(stops, "stops", "stop_id")).unionByName(parents(shapes, "shapes", "shape_id")).unionByName(parents(calendar, "calendar", "service_id"))


def orphan_counts(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """(tab, fld, month, reason, n, refs): orphans per table, field, month of the referring row and reason, and all references of that month."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    bad = orphans.groupBy("tab", "fld", month, "reason").agg(F.count("*").alias("n"))
    return bad.join(refs.groupBy("tab", "fld", month).agg(F.count("*").alias("refs")), ["tab", "fld", "month"])
