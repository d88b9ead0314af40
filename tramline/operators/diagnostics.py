"""Export-log messages by kind, with the ids they name, and what of the feed they concern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import strip
from tramline.functions.scalars import folded, zero_pad

#: Kind -> parts of folded messages that tell it, English or French, in the order tried.
KINDS = [
    ("scheduling_units", ["more than one scheduling unit", "plus d'une unite horaire"]),
    ("operating_exception", ["no variations operating on the day", "sans variations en service pour ce jour"]),
    ("missing_itinerary", ["missing itinerary", "itineraire manquant"]),
    ("deleted_pattern", ["does not exist anymore", "parcours type assigne n'existant plus"]),
    ("stop_location", ["different from the default stop location", "differente de la localisation de defaut"]),
    ("destination_names", ["has no name for its last node/timpoint"]),
    ("station_code", ["usage station but does not have"]),
    ("stop_usage", ["usage stop not station"]),
    ("station_description", ["missing an english station description"]),
    ("route_colours", ["colour value"]),
    ("route_directions", ["missing its public information direction names"]),
]


def message_kind(value: Column) -> Column:
    """The kind of a folded message; 'unknown' if no phrase tells it. Colours also need 'is missing its'."""
    chain = None
    for kind, parts in KINDS:
        hit = None
        for p in parts:
            hit = value.contains(p) if hit is None else hit | value.contains(p)
        if kind == "route_colours":
            hit = hit & value.contains("is missing its")
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("unknown")


#: Phrases of messages, English or French, with what they name. {x} is a word, {x#} a number, {x*} any text up to
#: the next words, {x>} all the rest, (x) parentheses; ^ begins the message, | parts words of which one ends the phrase.
PHRASES = [
    ("trip pattern route: {internal_route} number: {pattern_id#}", "parcours type ligne: {internal_route} numero: {pattern_id#}"),
    ("trips for route: {internal_route} direction: {public_direction*} has no name for its last node/timpoint: {end_place>}",),
    ("uses a stop location identifier: {pattern_stop_location} different from the default stop location: {default_stop_location}", "utilise une localisation d'arret: {pattern_stop_location} differente de la localisation de defaut: {default_stop_location}"),
    ("stop {stop_code} ({stop_id*})", "station {stop_code} ({stop_id*})"),
    ("route {public_route} is missing its",),
    ("^error: {service_id*} is planned|has at least one day exception|est planifi|a au moins une variation", "^erreur: {service_id*} is planned|has at least one day exception|est planifi|a au moins une variation"),
    ("operating on the day: {exception_date*} for scheduling unit {scheduling_unit*}", "en service pour ce jour: {exception_date*} pour l'unite horaire {scheduling_unit*}"),
]
#: Letters with the accents they may carry in a message.
ACCENTS = {"a": "aàâ", "c": "cç", "e": "eéèêë", "i": "iîï", "o": "oô", "u": "uùûü", "'": "'’"}
MESSAGE_FIELDS = list(dict.fromkeys(f for group in PHRASES for p in group for f in re.findall(r"\{([a-z_]+)", p)))


def _words(text: str) -> str:
    """A pattern of the words of a phrase, whatever their accents and the blanks between them."""
    loose = lambda part: r"\s+".join("".join(f"[{ACCENTS[c]}]" if c in ACCENTS else re.escape(c) for c in word) for word in part.split())
    ways = [r"\s*:\s*".join(loose(part) for part in way.split(":")) for way in text.split("|")]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def phrase_pattern(phrase: str) -> tuple[str, list[str]]:
    """The regular expression of a phrase of PHRASES and the fields of its groups."""
    out, fields = "(?iu)", []
    if phrase.startswith("^"):
        out, phrase = out + "^", phrase[1:]
    else:
        out += r"(?<![\p{L}\d])"
    parts = re.split(r"(\(?\{[a-z_]+[#*>]?\}\)?)", phrase)
    for i, part in enumerate(parts):
        m = re.fullmatch(r"(\(?)\{([a-z_]+)([#*>]?)\}\)?", part)
        if m:
            fields.append(m[2])
            last = not "".join(parts[i + 1 :]).strip()
            kind = {"#": r"(\d+)\b", ">": "(.*)", "*": r"(.*?)" + (r"(?:\.\s|$)" if last else ""), "": r"(\S+)"}[m[3]]
            out += r"\(\s*([^()]+?)\s*\)" if m[1] else kind
        elif part.strip():
            words = part.strip()
            out += (r"\s+" if i and not words.startswith(":") else "") + _words(words) + (r"\s*" if words.endswith(":") or i == len(parts) - 1 else r"\s+")
        else:
            out += r"\s*" if part else ""
    return out, fields


def parsed_messages(lines: DataFrame, text: str = "message") -> DataFrame:
    """lines with kind, source_severity, shape_id and MESSAGE_FIELDS, '' where a message names none.

    A shape id is the route followed by the pattern's number, put to four digits at least.  Identifiers keep their case.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\s\x{a0}]+", " "))
    value = F.when(flat.rlike(r"^[\x00-\x7f]*$"), F.lower(flat)).otherwise(folded(flat))
    out = lines.withColumn("_flat", flat).withColumn("_value", value)
    word = F.regexp_extract("_value", r"^(warning|error|avertissement|erreur)\s*:", 1)
    severity = F.when(word.isin("warning", "avertissement"), "Warning").when(word.isin("error", "erreur"), "Error").otherwise("Unspecified")
    found: dict[str, list[Column]] = {f: [] for f in MESSAGE_FIELDS}
    for group in PHRASES:
        for phrase in group:
            pattern, fields = phrase_pattern(phrase)
            for i, f in enumerate(fields, 1):
                found[f].append(F.nullif(F.trim(F.regexp_extract("_flat", pattern, i)), F.lit("")))
    said = {"kind": message_kind(F.col("_value")), "source_severity": severity} | {f: F.coalesce(*cs, F.lit("")) for f, cs in found.items()}
    out = out.withColumns(said)
    shape = F.when(F.col("pattern_id") != "", F.concat("internal_route", zero_pad(F.regexp_replace("pattern_id", "^0+(?=[0-9])", ""), 4))).otherwise("")
    return out.withColumn("shape_id", shape).drop("_flat", "_value")


def missing_shapes(trips: DataFrame, shapes: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(_feed, route_id, direction_id, shape_id, trips, calls, trips_without_calls): groups of trips whose shape has no points."""
    t = trips.select("_feed", strip("route_id").alias("route_id"), strip("direction_id").alias("direction_id"), strip("shape_id").alias("shape_id"), strip("trip_id").alias("trip_id")).where("shape_id != ''").distinct()
    lost = t.join(shapes.select("_feed", strip("shape_id").alias("shape_id")).distinct(), ["_feed", "shape_id"], "left_anti")
    calls = stop_times.groupBy("_feed", strip("trip_id").alias("trip_id")).agg(F.count("*").alias("calls"))
    met = lost.join(calls, ["_feed", "trip_id"], "left")
    return met.groupBy("_feed", "route_id", "direction_id", "shape_id").agg(F.count("*").alias("trips"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count_if(F.col("calls").isNull()).alias("trips_without_calls"))


def concerned_trips(messages: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(row_id, _feed, via, trip_id): trips that a parsed message concerns, by the shape, the service or the stop it names.

    messages has row_id.  A trip that passes a stop several times counts once.
    """
    trips = t["trips"].select("_feed", *[strip(c).alias(c) for c in ("trip_id", "shape_id", "service_id")])
    named = lambda c: messages.where(F.col(c) != "").select("row_id", c)
    out = [named(c).join(trips.select("_feed", "trip_id", c), c).select("row_id", "_feed", F.lit(c).alias("via"), "trip_id") for c in ("shape_id", "service_id")]
    stops = named("stop_id")
    calls = t["stop_times"].select("_feed", strip("trip_id").alias("trip_id"), strip("stop_id").alias("stop_id")).join(stops.select("stop_id").distinct(), "stop_id", "left_semi").distinct()
    out.append(stops.join(calls, "stop_id").select("row_id", "_feed", F.lit("stop_id").alias("via"), "trip_id"))
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def concerned_routes(messages: DataFrame, t: dict[str, DataFrame], trips: DataFrame) -> DataFrame:
    """(row_id, _feed, via, route_id): routes a message concerns: those of its trips (see concerned_trips), all versions of the
    public route it names, and, for messages no other way finds a route for, all routes whose id is the internal route and a version."""
    of_trip = t["trips"].select("_feed", strip("trip_id").alias("trip_id"), strip("route_id").alias("route_id")).distinct()
    by_trip = trips.select("row_id", "_feed", "trip_id").distinct().join(of_trip, ["_feed", "trip_id"]).select("row_id", "_feed", F.lit("trip").alias("via"), "route_id")
    routes = t["routes"].select("_feed", strip("route_id").alias("route_id"), strip("route_short_name").alias("public_route")).distinct()
    by_name = messages.where("public_route != ''").select("row_id", "public_route").join(routes, "public_route").select("row_id", "_feed", F.lit("public_route").alias("via"), "route_id")
    known = by_trip.unionByName(by_name)
    versions = routes.withColumn("internal_route", F.regexp_extract("route_id", r"^(.*)-\d+$", 1)).where("internal_route != ''")
    by_version = messages.where("internal_route != ''").select("row_id", "internal_route").join(known.select("row_id").distinct(), "row_id", "left_anti").join(versions, "internal_route").select("row_id", "_feed", F.lit("internal_route").alias("via"), "route_id")
    return known.unionByName(by_version).distinct()


def assessed_messages(messages: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(row_id, kind, source_severity, assessment): confirmed_defect if an itinerary is missing whose shape trips name and no feed
    that has them holds points of, else source_review."""
    used = t["trips"].select("_feed", strip("shape_id").alias("shape_id")).where("shape_id != ''").distinct()
    lost = used.join(t["shapes"].select("_feed", strip("shape_id").alias("shape_id")).distinct(), ["_feed", "shape_id"], "left_anti").select("shape_id").distinct().withColumn("lost", F.lit(True))
    met = messages.select("row_id", "kind", "source_severity", "shape_id").join(lost, "shape_id", "left")
    return met.select("row_id", "kind", "source_severity", F.when((F.col("kind") == "missing_itinerary") & F.col("lost"), "confirmed_defect").otherwise("source_review").alias("assessment"))


def by_assessment(assessed: DataFrame, which: str = "all") -> DataFrame:
    """Messages that are confirmed, to be reviewed, of unknown kind, or all."""
    return {"all": assessed, "confirmed": assessed.where("assessment = 'confirmed_defect'"), "review": assessed.where("assessment = 'source_review' and kind != 'unknown'"), "unknown": assessed.where("kind = 'unknown'")}[which]


def diagnostic_counts(assessed: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row: messages, source_errors, unknown_messages, source_review, missing_shapes, affected_trips; shapes from missing_shapes()."""
    m = assessed.agg(F.count("*").alias("messages"), F.count_if(F.col("source_severity") == "Error").alias("source_errors"), F.count_if(F.col("kind") == "unknown").alias("unknown_messages"), F.count_if(F.col("assessment") == "source_review").alias("source_review"))
    g = shapes.agg(F.count_distinct("_feed", "shape_id").alias("missing_shapes"), F.coalesce(F.sum("trips"), F.lit(0)).alias("affected_trips"))
    return m.crossJoin(F.broadcast(g))  # one row each


def affected_trips(t: dict[str, DataFrame], messages: DataFrame | None = None, shape: str | None = None) -> DataFrame:
    """(_feed, route_id, pattern_ids, shape_id, trip_id, service_id, calls): trips whose shape has no points, with the pattern
    numbers that messages give for it; of one shape if named, which must be among them."""
    trips = t["trips"].select("_feed", *[strip(c).alias(c) for c in ("route_id", "shape_id", "trip_id", "service_id")]).where("shape_id != ''").distinct()
    lost = trips.join(t["shapes"].select("_feed", strip("shape_id").alias("shape_id")).distinct(), ["_feed", "shape_id"], "left_anti")
    if shape is not None:
        lost = lost.where(F.col("shape_id") == shape)
        if lost.isEmpty():
            raise ValueError(f"no trips lack the shape {shape}")
    calls = t["stop_times"].groupBy("_feed", strip("trip_id").alias("trip_id")).agg(F.count("*").alias("calls"))
    out = lost.join(calls, ["_feed", "trip_id"], "left").fillna(0, ["calls"])
    if messages is None:
        out = out.withColumn("pattern_ids", F.lit(""))
    else:
        said = messages.where("kind = 'missing_itinerary' and shape_id != ''").groupBy("shape_id").agg(F.array_join(F.sort_array(F.collect_set("pattern_id")), ";").alias("pattern_ids"))
        out = out.join(said, "shape_id", "left").fillna("", ["pattern_ids"])
    return out.select("_feed", "route_id", "pattern_ids", "shape_id", "trip_id", "service_id", "calls")
