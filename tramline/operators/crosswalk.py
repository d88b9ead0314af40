"""Which stop of one feed is which of another, and how their attributes differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.contract import FAR_METRES
from tramline.functions.scalars import alnum_name, coordinate, distance_m
from tramline.plans.ledger import finding

TIERS = ("same_id", "target_code", "shared_code")


def one_state(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per trimmed non-blank key the columns, trimmed, of its first row (smallest _row)."""
    return rows.groupBy(strip(key).alias(key)).agg(F.min(F.struct("_row", *[strip(c).alias(c) for c in columns if c != key])).alias("m")).where(F.col(key) != "").select(key, *[f"m.{c}" for c in columns if c != key])


def unique_codes(stops: DataFrame, code: str = "stop_code", ident: str = "stop_id") -> DataFrame:
    """(code, id) of codes that exactly one stop has."""
    ids = stops.select(strip(code).alias("code"), strip(ident).alias("id")).where("code != '' and id != ''")
    return ids.groupBy("code").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").select("code", "id")


def ambiguous_codes(stops: DataFrame, code: str = "stop_code", ident: str = "stop_id") -> DataFrame:
    """(code, ids): codes that several stops have, how many."""
    ids = stops.select(strip(code).alias("code"), strip(ident).alias("id")).where("code != '' and id != ''")
    return ids.groupBy("code").agg(F.count_distinct("id").alias("ids")).where("ids > 1")


def crosswalk(source: DataFrame, target: DataFrame, tiers: tuple[str, ...] = TIERS, ambiguous: str = "skip") -> DataFrame:
    """(source_id, target_id, tier): one row per source stop that a tier maps, the first tier that does.

    same_id: a target stop has the source's id.  target_code: exactly one target stop has the id as its code.  shared_code:
    exactly one stop on each side has the code.  ambiguous 'raise' stops where a code that is needed is not unique.
    """
    ids = source.select(strip("stop_id").alias("source_id"), strip("stop_code").alias("code")).where("source_id != ''")
    ids = ids.groupBy("source_id").agg(F.max("code").alias("code"))
    if ambiguous == "raise" and "target_code" in tiers:
        clash = ambiguous_codes(target).select(F.col("code").alias("source_id")).join(ids, "source_id", "left_semi")
        if not clash.isEmpty():
            raise ValueError("stop codes that several target stops have are needed")
    out = ids
    if "same_id" in tiers:
        out = out.join(target.select(strip("stop_id").alias("same_id")).distinct(), F.col("source_id") == F.col("same_id"), "left")
    if "target_code" in tiers:
        out = out.join(unique_codes(target).select(F.col("code").alias("_c1"), F.col("id").alias("target_code")), F.col("source_id") == F.col("_c1"), "left")
    if "shared_code" in tiers:
        both = unique_codes(source).select("code").join(unique_codes(target).withColumnRenamed("id", "shared_code"), "code")
        out = out.join(both.select(F.col("code").alias("_c2"), "shared_code"), out["code"] == F.col("_c2"), "left")
    tier = F.coalesce(*[F.when(F.col(t).isNotNull(), F.lit(t)) for t in tiers])
    return out.select("source_id", F.coalesce(*tiers).alias("target_id"), tier.alias("tier")).where("target_id is not null")


PAIR_COLUMNS = ["stop_name", "stop_lat", "stop_lon", "location_type", "parent_station", "wheelchair_boarding"]
#: Compared as names, where both feeds have them.
TEXT_COLUMNS = ["platform_code", "zone_id", "stop_desc"]


def stop_pairs(walk: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(source_id, target_id, distance_m, names_differ, differs): mapped pairs with what differs; differs is an array of fields.

    A blank location type or wheelchair value is 0; platform, zone and description are compared as names, where both feeds have
    the column; parents are compared through the same mapping.
    """
    texts = [c for c in TEXT_COLUMNS if c in source.columns and c in target.columns]
    s = one_state(source, "stop_id", [*PAIR_COLUMNS, *texts]).select(*[F.col(c).alias(f"s_{c}") for c in ["stop_id", *PAIR_COLUMNS, *texts]])
    t = one_state(target, "stop_id", [*PAIR_COLUMNS, *texts]).select(*[F.col(c).alias(f"t_{c}") for c in ["stop_id", *PAIR_COLUMNS, *texts]])
    up = walk.select(F.col("source_id").alias("s_parent_station"), F.col("target_id").alias("mapped_parent"))
    both = walk.join(s, F.col("source_id") == F.col("s_stop_id")).join(t, F.col("target_id") == F.col("t_stop_id")).join(up, "s_parent_station", "left")
    c = lambda x: coordinate(F.col(x))
    kind = lambda x: F.when(F.col(x) == "", "0").otherwise(F.col(x))
    fields = {
        "location_type": kind("s_location_type") != kind("t_location_type"),
        "wheelchair_boarding": kind("s_wheelchair_boarding") != kind("t_wheelchair_boarding"),
        **{c: alnum_name(F.col(f"s_{c}")) != alnum_name(F.col(f"t_{c}")) for c in texts},
        "parent_station": F.coalesce("mapped_parent", "s_parent_station") != F.col("t_parent_station"),
    }
    differs = F.array_compact(F.array(*[F.when(hit, F.lit(f)) for f, hit in fields.items()]))
    names = (F.col("s_stop_name") != "") & (F.col("t_stop_name") != "") & (alnum_name(F.col("s_stop_name")) != alnum_name(F.col("t_stop_name")))
    return both.select("source_id", "target_id", distance_m(c("s_stop_lat"), c("s_stop_lon"), c("t_stop_lat"), c("t_stop_lon")).alias("distance_m"), names.alias("names_differ"), differs.alias("differs"))


def stop_findings(pairs: DataFrame, limit: float = FAR_METRES["sources"]) -> DataFrame:
    """STP005 (names), STP006 (distance) and STP010 (attributes) for pairs."""
    key = F.concat(F.col("target_id"), F.lit(" ↔ "), F.col("source_id"))
    checks = [
        (F.col("names_differ"), finding("STP005", "warning", "Stop reconciliation", "stops", None, key)),
        (F.col("distance_m") > limit, finding("STP006", "warning", "Stop reconciliation", "stops", None, key, F.format_number("distance_m", 1))),
        (F.size("differs") > 0, finding("STP010", "warning", "Stop reconciliation", "stops", None, key, F.array_join("differs", ", "))),
    ]
    every = F.array(*[F.when(hit, F.struct(*parts)) for hit, parts in checks])
    return pairs.select(F.lit(None).cast("string").alias("feed"), F.inline(F.filter(every, lambda x: x.isNotNull())))


def untraceable(final: DataFrame, sources: list[DataFrame], ident: str) -> DataFrame:
    """Ids of the final feed that no source has (MRG101 to MRG104, STP004)."""
    held = sources[0].select(strip(ident).alias("id"))
    for s in sources[1:]:
        held = held.unionByName(s.select(strip(ident).alias("id")))
    return final.select(strip(ident).alias("id")).where("id != ''").distinct().join(held.distinct(), "id", "left_anti")


def provenance(final: dict[str, DataFrame], sources: list[dict[str, DataFrame]]) -> DataFrame:
    """(entity, traceable, total) of the final feed's ids."""
    out = None
    for name, ident in (("routes", "route_id"), ("trips", "trip_id"), ("shapes", "shape_id"), ("calendar", "service_id")):
        ids = final[name].select(strip(ident).alias("id")).where("id != ''").distinct()
        held = sources[0][name].select(strip(ident).alias("id"))
        for s in sources[1:]:
            held = held.unionByName(s[name].select(strip(ident).alias("id")))
        met = ids.join(held.distinct().withColumn("there", F.lit(1)), "id", "left")
        part = met.agg(F.count("there").alias("traceable"), F.count("*").alias("total")).select(F.lit(name).alias("entity"), "traceable", "total")
        out = part if out is None else out.unionByName(part)
    return out
