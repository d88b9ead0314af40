"""A release built from planning sources: the base's trips with what the other source knows better, and a rail feed below.

Everything is a DataFrame until the release is written; what must stop a build is checked by small aggregates, and what must be
looked at comes as rows of warnings (kind, source, key, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.common import cut, strip
from tramline.contract import DAYS, DIFF_KEYS, FIELDS
from tramline.functions.scalars import canonical_trip, exact_decimal
from tramline.operators import builder, crosswalk, matcher, sequences
from tramline.operators.rules import whole

TRIP_FIELDS = ["trip_headsign", "wheelchair_accessible", "bikes_allowed"]
WARNING = "kind string, source string, key string, detail string"
#: Fields of stops whose numbers are written by value.
COORDINATES = {"stops": ["stop_lat", "stop_lon"], "shapes": ["shape_pt_lat", "shape_pt_lon", "shape_dist_traveled"], "stop_times": ["shape_dist_traveled"]}


def warning(df: DataFrame, kind: str, source: str, key: Column, detail: Column | str = "") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(source).alias("source"), key.cast("string").alias("key"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def clean(df: DataFrame, table: str) -> DataFrame:
    """The columns of FIELDS, trimmed, '' where they lack, with _row."""
    return df.select("_row", *[(strip(c) if c in df.columns else F.lit("")).alias(c) for c in FIELDS[table]])


def unsupported(spark: SparkSession, feeds: dict[str, dict[str, DataFrame]], policy: dict) -> DataFrame:
    """Warnings of tables and columns that no rule carries over, and of tables that the policy leaves out; one that has rows and
    that the policy doesn't name as such stops the build."""
    out = []
    for label, t in feeds.items():
        for name, df in t.items():
            file = f"{name}.txt"
            if file in policy["omit_tables"]:
                if df.isEmpty():
                    continue
                if file not in policy["allow_omit_nonempty_tables"]:
                    raise ValueError(f"{label}: {file} has rows, and the policy does not say that they may be left out")
                out.append(("omitted_table", label, file, ""))
            elif name not in FIELDS:
                out.append(("unsupported_table", label, file, ""))
            else:
                extra = sorted(c for c in df.columns if not c.startswith("_") and c not in FIELDS[name])
                if extra:
                    out.append(("unsupported_columns", label, file, ", ".join(extra)))
    return spark.createDataFrame(out, WARNING)


def kept_trips(base: dict[str, DataFrame], policy: dict) -> DataFrame:
    rules = [(r["route_min"], r["route_max"], r["keep"]) for r in policy["direction_rules"]]
    return builder.eligible(base["trips"], base["routes"], policy["exclude_routes"], rules)


def matched(base: dict[str, DataFrame], other: dict[str, DataFrame], walk: DataFrame, policy: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, models of base, models of other): matcher.resolved() of the two sources, the other's stops put into the base's."""
    l, r = cut(matcher.models(base)), cut(matcher.models(other, walk))
    found = cut(matcher.match_sources(l, r, policy["timing_tolerance_seconds"], policy["minimum_stop_coverage"]))
    return cut(matcher.resolved(found, l, r)), l, r


def enriched_trips(trips: DataFrame, matches: DataFrame, other_trips: DataFrame, clear_blocks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(trips, warnings): headsign and accessibility that all candidates of a trip agree on, blank too; else the trip's own.

    Blocks of clear_blocks are blanked.  A trip without a candidate keeps its own values and is told, as are conflicts.
    """
    t = clean(trips, "trips")
    o = crosswalk.one_state(other_trips, "trip_id", TRIP_FIELDS).withColumnRenamed("trip_id", "candidate")
    agreed = builder.consensus(matches.where("candidate is not null").select("trip_id", "candidate").distinct().join(o, "candidate"), ["trip_id"], TRIP_FIELDS)
    agreed = cut(agreed.select("trip_id", *[F.col(f).alias(f"a_{f}") for f in TRIP_FIELDS], *[f"{f}_conflict" for f in TRIP_FIELDS]))
    met = t.join(agreed, "trip_id", "left")
    block = F.when(F.col("block_id").isin(clear_blocks), "").otherwise(F.col("block_id")) if clear_blocks else F.col("block_id")
    out = met.withColumns({f: builder.taken(F.col(f), F.col(f"a_{f}"), F.col(f"{f}_conflict")) for f in TRIP_FIELDS} | {"block_id": block}).select("_row", *FIELDS["trips"])
    told = warning(agreed.select("trip_id", F.explode(F.array_compact(F.array(*[F.when(F.col(f"{f}_conflict"), F.lit(f)) for f in TRIP_FIELDS]))).alias("f")), "conflicting_trip_metadata", "base", F.col("trip_id"), F.col("f"))
    per = matches.groupBy("trip_id").agg(F.min("method").alias("method"), F.count("candidate").alias("n"))
    told = told.unionByName(warning(per.where("n = 0"), "unmatched_trip", "base", F.col("trip_id")))
    told = told.unionByName(warning(per.where(F.col("method") == matcher.METHODS[3]), "lower_similarity_trip", "base", F.col("trip_id")))
    return out, told


def aligned_calls(matches: DataFrame, left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """(trip_id, candidate, place, other): places of a trip's calls, from 0, and of the same calls of each of its candidates."""
    pairs = matches.where("candidate is not null").select("trip_id", "candidate").distinct()
    met = pairs.join(left.select("trip_id", F.col("stops").alias("a"), F.col("at").alias("t")), "trip_id").join(right.select(F.col("trip_id").alias("candidate"), F.col("stops").alias("b"), F.col("at").alias("u")), "candidate")
    return met.select("trip_id", "candidate", F.explode(sequences.occurrence_udf(tolerance)("a", "b", "t", "u")).alias("place", "other"))


def _placed(stop_times: DataFrame) -> DataFrame:
    """stop_times with _place, from 0, of each call in its trip's order of numbers; a number's first row has it, the others none."""
    from pyspark.sql import Window as W

    calls = clean(stop_times, "stop_times").withColumn("_n", whole(F.col("stop_sequence"))).where("_n is not null and trip_id != ''")
    first = calls.groupBy("trip_id", "_n").agg(F.min("_row").alias("_row"))
    first = first.withColumn("_place", (F.row_number().over(W.partitionBy("trip_id").orderBy("_n")) - 1).cast("int")).select("_row", "_place", F.col("trip_id").alias("_t"))
    return calls.join(first, (calls["_row"] == first["_row"]) & (calls["trip_id"] == first["_t"]), "left").select(calls["*"], "_place")


def enriched_calls(stop_times: DataFrame, trips: DataFrame, matches: DataFrame, aligned: DataFrame, other_calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stop_times, warnings) of trips (trip_id): pickup type and destination of a call that every candidate of its trip has and
    agrees on; else the call's own pickup type and no destination, as a destination of another pattern would mislead."""
    mine = _placed(stop_times).join(trips.select("trip_id").distinct(), "trip_id", "left_semi")
    theirs = _placed(other_calls).where("_place is not null").select(F.col("trip_id").alias("candidate"), F.col("_place").alias("other"), F.when(F.col("pickup_type") == "", "0").otherwise(F.col("pickup_type")).alias("pickup"), F.col("stop_headsign").alias("head"))
    n = matches.where("candidate is not null").groupBy("trip_id").agg(F.count_distinct("candidate").alias("_all"))
    per = aligned.join(theirs, ["candidate", "other"]).groupBy("trip_id", "place").agg(F.count_distinct("candidate").alias("_seen"), *[x for c in ("pickup", "head") for x in (F.min(c).alias(c), (F.min(c) != F.max(c)).alias(f"{c}_conflict"))])
    per = cut(per.join(n, "trip_id").withColumnRenamed("place", "_place"))
    met = mine.join(per, ["trip_id", "_place"], "left")
    whole_set = F.col("_seen") == F.col("_all")
    agreed = lambda c: F.coalesce(whole_set & ~F.col(f"{c}_conflict"), F.lit(False))
    out = met.withColumns({"pickup_type": F.when(agreed("pickup"), F.col("pickup")).otherwise(F.col("pickup_type")), "stop_headsign": F.when(agreed("head"), F.col("head")).otherwise(F.lit("")), "shape_dist_traveled": exact_decimal(F.col("shape_dist_traveled"))}).select("_row", *FIELDS["stop_times"])
    told = per.select("trip_id", "_place", F.explode(F.array_compact(F.array(F.when(F.col("pickup_conflict"), F.lit("pickup_type")), F.when(F.col("head_conflict"), F.lit("stop_headsign"))))).alias("f"))
    return out, warning(told, "conflicting_stop_metadata", "base", F.concat_ws(":", "trip_id", F.col("_place") + 1), F.col("f"))


def enriched_routes(routes: DataFrame, used: DataFrame, other: DataFrame, order: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(routes, warnings): the routes used (route_id) with the attributes that all routes of the other source of the same short
    name agree on, and the agency's sort order (route_short_name, route_sort_order)."""
    fields = [f for f in FIELDS["routes"] if f not in ("route_id", "route_short_name", "route_sort_order")]
    mine = clean(routes, "routes").join(used.select("route_id").distinct(), "route_id", "left_semi")
    agreed = builder.consensus(clean(other, "routes"), ["route_short_name"], fields)
    agreed = agreed.select("route_short_name", F.lit(True).alias("_met"), *[F.col(f).alias(f"a_{f}") for f in fields], *[f"{f}_conflict" for f in fields])
    met = cut(mine.join(agreed, "route_short_name", "left").drop("route_sort_order").transform(lambda d: with_order(d, order)))
    out = met.withColumns({f: builder.taken(F.col(f), F.col(f"a_{f}"), F.col(f"{f}_conflict")) for f in fields}).select("_row", *FIELDS["routes"])
    told = warning(met.select("route_id", F.explode(F.array_compact(F.array(*[F.when(F.col(f"{f}_conflict"), F.lit(f)) for f in fields]))).alias("f")), "conflicting_route_metadata", "base", F.col("route_id"), F.col("f"))
    told = told.unionByName(warning(met.where("_met is null"), "unmatched_route", "base", F.col("route_id")))
    return out, told.unionByName(warning(met.where("route_sort_order = ''"), "missing_route_sort", "base", F.col("route_id")))


def with_order(routes: DataFrame, order: DataFrame | None) -> DataFrame:
    """routes with the agency's sort order, '' where it has none; of repeated names the order's last row counts, as given by its text."""
    if order is None:
        return routes.withColumn("route_sort_order", F.lit(""))
    last = order.groupBy(strip("route_short_name").alias("route_short_name")).agg(F.max(strip("route_sort_order")).alias("route_sort_order"))
    return routes.join(last, "route_short_name", "left").withColumn("route_sort_order", F.coalesce("route_sort_order", F.lit("")))


def release_stops(base: DataFrame, other: DataFrame, walk: DataFrame, rail: DataFrame | None, used: DataFrame) -> DataFrame:
    """Stops of a release: the other source's rows under the base's ids and with the base's coordinates and mapped parents,
    without those that are neither mapped nor stations; rail's stops that aren't there yet; and the base's own stops that a call
    (stop_id) uses and no other source has."""
    b = crosswalk.one_state(base, "stop_id", ["stop_lat", "stop_lon"]).select(F.col("stop_id").alias("_to"), F.col("stop_lat").alias("_lat"), F.col("stop_lon").alias("_lon"))
    up = walk.select(F.col("source_id").alias("_p"), F.col("target_id").alias("_pt"))
    o = clean(other, "stops").join(walk.select(F.col("source_id").alias("stop_id"), "target_id"), "stop_id", "left").withColumn("_to", F.coalesce("target_id", "stop_id"))
    o = o.join(b, "_to", "left").where("_lat is not null or location_type = '1'").withColumn("_p", F.col("parent_station")).join(up, "_p", "left")
    o = o.withColumns({"stop_lat": F.coalesce("_lat", "stop_lat"), "stop_lon": F.coalesce("_lon", "stop_lon"), "parent_station": F.coalesce("_pt", "_p"), "stop_id": F.col("_to"), "_rank": F.lit(0)})
    cols = ["_rank", "_row", *FIELDS["stops"]]
    every = o.select(cols)
    if rail is not None:
        every = every.unionByName(clean(rail, "stops").withColumn("_rank", F.lit(1)).select(cols))
    mine = clean(base, "stops").join(used.select(strip("stop_id").alias("stop_id")).distinct(), "stop_id", "left_semi").withColumn("_rank", F.lit(2)).select(cols)
    every = every.unionByName(mine).where("stop_id != ''")
    # Of one source's rows of an id the last counts, as it replaces the earlier ones.
    best = every.groupBy("stop_id").agg(F.min(F.struct("_rank", (-F.col("_row")).alias("_back"), "_row", *[c for c in FIELDS["stops"] if c != "stop_id"])).alias("m")).select("stop_id", "m.*")
    return best.withColumns({c: exact_decimal(F.col(c)) for c in COORDINATES["stops"]}).select("_row", *FIELDS["stops"])


def rail_trips(rail: dict[str, DataFrame], taken: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips, (source id, id), warnings): rail's trips under ids without their service as suffix; one that is taken (trip_id), or
    that two get, stops the build."""
    t = clean(rail["trips"], "trips").withColumn("_from", F.col("trip_id")).withColumn("trip_id", canonical_trip(F.col("trip_id"), F.col("service_id")))
    clash = t.groupBy("trip_id").count().where("count > 1").select("trip_id").unionByName(t.select("trip_id").join(taken.select("trip_id"), "trip_id", "left_semi")).limit(1).collect()
    if clash:
        raise ValueError(f"two trips would have the id {clash[0].trip_id}")
    told = warning(t.where("_from = trip_id"), "rail_trip_id_preserved", "rail", F.col("trip_id"))
    return t.select("_row", *FIELDS["trips"]), t.select("_from", F.col("trip_id").alias("_to")), told


def rail_calls(stop_times: DataFrame, renamed: DataFrame) -> DataFrame:
    """rail's calls under the trips' new ids; a distance that lacks is 0."""
    c = clean(stop_times, "stop_times").join(renamed, F.col("trip_id") == F.col("_from"))
    return c.withColumns({"trip_id": F.col("_to"), "shape_dist_traveled": F.when(F.col("shape_dist_traveled") == "", "0").otherwise(F.col("shape_dist_traveled"))}).select("_row", *FIELDS["stop_times"])


def release_calendar(sources: dict[str, dict[str, DataFrame]], first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """(calendar, warnings): services of all sources within first..last (texts yyyyMMdd); one fully outside keeps the window and no days."""
    every = None
    for label, t in sources.items():
        if "calendar" in t:
            part = clean(t["calendar"], "calendar").withColumn("_label", F.lit(label))
            every = part if every is None else every.unionByName(part)
    again = every.groupBy("service_id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"two services have the id {again[0].service_id}")
    out = F.greatest("start_date", F.lit(first)) > F.least("end_date", F.lit(last))
    told = every.where(out).select(F.lit("calendar_outside_window").alias("kind"), F.col("_label").alias("source"), F.col("service_id").alias("key"), F.lit("").alias("detail"))
    cols = {d: F.when(out, "0").otherwise(F.col(d)) for d in DAYS} | {"start_date": F.when(out, first).otherwise(F.greatest("start_date", F.lit(first))), "end_date": F.when(out, last).otherwise(F.least("end_date", F.lit(last)))}
    return every.withColumns(cols).select("_row", *FIELDS["calendar"]), told


def assembled(spark: SparkSession, base: dict[str, DataFrame], other: dict[str, DataFrame], rail: dict[str, DataFrame] | None, policy: dict, first: str, last: str, order: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables, warnings, crosswalk of trips) of a release; ValueError where sources can't be put together."""
    feeds = {"base": base, "other": other} | ({"rail": rail} if rail else {})
    told = [unsupported(spark, feeds, policy)]
    if not rail:
        told.append(spark.createDataFrame([("rail_not_supplied", "rail", "", "")], WARNING))
    kept = cut(kept_trips(base, policy))
    walk = cut(crosswalk.crosswalk(other["stops"], base["stops"], ("target_code",), "raise"))
    mine = base | {"trips": kept, "stop_times": base["stop_times"].withColumn("_t", strip("trip_id")).join(kept.select(strip("trip_id").alias("_t")).distinct(), "_t", "left_semi").drop("_t")}
    matches, l, r = matched(mine, other, walk, policy)
    trips, w1 = enriched_trips(kept, matches, other["trips"], policy["clear_block_ids"])
    calls, w2 = enriched_calls(base["stop_times"], trips, matches, aligned_calls(matches, l, r, policy["timing_tolerance_seconds"]), other["stop_times"])
    routes, w3 = enriched_routes(base["routes"], trips, other["routes"], order)
    dates = matcher.date_coverage(matches, l, r)
    told += [w1, w2, w3, warning(dates.where("uncovered > 0").join(matches.where("candidate is not null").select("trip_id").distinct(), "trip_id", "left_semi"), "partial_dates", "base", F.col("trip_id"), F.col("uncovered"))]
    trips = cut(trips)
    shapes = [("base", base)]
    if rail:
        more, renamed, w4 = rail_trips(rail, trips)
        more, renamed = cut(more), cut(renamed)
        told.append(w4)
        extra = clean(rail["routes"], "routes").join(more.select("route_id").distinct(), "route_id", "left_semi").drop("route_sort_order").transform(lambda d: with_order(d, order)).select("_row", *FIELDS["routes"])
        routes = builder.appended(routes, extra, ["route_id"])
        trips = trips.unionByName(more)
        calls = calls.unionByName(rail_calls(rail["stop_times"], renamed))
        shapes.append(("rail", rail))
    dated = {"base": base} | ({"rail": rail} if rail else {})
    calendar, w5 = release_calendar(dated, first, last)
    told.append(w5)
    out = {"routes": routes, "trips": trips, "stop_times": calls, "calendar": calendar, "stops": release_stops(base["stops"], other["stops"], walk, rail["stops"] if rail else None, mine["stop_times"])}
    given = [t["calendar_dates"] for t in dated.values() if "calendar_dates" in t]
    out["calendar_dates"] = builder.merged_exceptions(given, first, last) if given else spark.createDataFrame([], ", ".join(f"{c} string" for c in FIELDS["calendar_dates"]))
    known = calendar.select("service_id").unionByName(out["calendar_dates"].select("service_id")).distinct()
    lost = trips.select("service_id").distinct().join(known, "service_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"trips name the service {lost[0].service_id}, which no source has")
    used = trips.where("shape_id != ''").select("shape_id").distinct()
    points = [clean(t["shapes"], "shapes").join(used, "shape_id", "left_semi") for _, t in shapes if "shapes" in t]
    if len(points) > 1:
        points = [builder.appended(points[0], points[1], ["shape_id"])]
    lost = (used.join(points[0].select("shape_id").distinct(), "shape_id", "left_anti") if points else used).limit(1).collect()
    if lost:
        raise ValueError(f"trips name the shape {lost[0].shape_id}, which no source has")
    if points:
        out["shapes"] = points[0].withColumns({c: exact_decimal(F.col(c)) for c in COORDINATES["shapes"]})
    if "agency" in base:
        out["agency"] = clean(base["agency"], "agency")
    info = other.get("feed_info") if "feed_info" in other and not other["feed_info"].isEmpty() else base.get("feed_info")
    out["feed_info"] = builder.stated_window(base["trips"], info, first, last)
    if "feed_info" in base and "feed_version" in base["feed_info"].columns:
        version = base["feed_info"].orderBy("_row").select(strip("feed_version").alias("v")).limit(1).collect()
        out["feed_info"] = out["feed_info"].withColumn("feed_version", F.lit(version[0].v if version else ""))
    warnings = told[0]
    for w in told[1:]:
        warnings = warnings.unionByName(w)
    return {n: out[n] for n in DIFF_KEYS if n in out}, warnings, matches


def warning_groups(warnings: DataFrame, k: int = 5) -> DataFrame:
    """(kind, n, examples): warnings per kind, with the first k by key; the examples are the feature."""
    from pyspark.sql import Window as W

    part = warnings.withColumn("_b", F.pmod(F.xxhash64("key", "detail"), F.lit(64)))
    near = part.withColumn("_i", F.row_number().over(W.partitionBy("kind", "_b").orderBy("key", "detail"))).where(F.col("_i") <= k)
    top = near.withColumn("_j", F.row_number().over(W.partitionBy("kind").orderBy("key", "detail"))).where(F.col("_j") <= k)
    shown = top.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "key", "detail"))), "; ").alias("examples"))
    return warnings.groupBy("kind").agg(F.count("*").alias("n")).join(shown, "kind")
