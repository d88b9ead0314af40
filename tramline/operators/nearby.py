"""Points near other points: latitude strips with overlap, each swept in order of longitude."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.common import BROADCAST_BYTES, PLAIN_DECIMAL, cut, hot_keys, maybe_broadcast, partitions, skew_join, strip

EARTH_M = 6_371_000.0
#: Degrees by which the sweep looks further than the distance asks for, as positions are rounded; distances are verified exactly.
SLACK = 1e-5


def usable_points(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    """rows with _lat and _lon as doubles; only rows with plain decimals in range that are not both 0."""
    la, lo = strip(lat), strip(lon)
    out = rows.withColumn("_lat", F.when(la.rlike(PLAIN_DECIMAL), la.try_cast("double"))).withColumn("_lon", F.when(lo.rlike(PLAIN_DECIMAL), lo.try_cast("double")))
    return out.where("_lat between -90 and 90 and _lon between -180 and 180 and not (_lat = 0 and _lon = 0)")


def near_pairs(points: DataFrame, ident: str, label: str, metres: float, tasks: int | None = None) -> DataFrame:
    """(a, b) with a < b: ids of points with different labels at most `metres` apart on the sphere.

    points: ident BIGINT, label, _lat and _lon (see usable_points).  Points of one label at one place count as one until the
    end, so a place that holds most rows is one point of the sweep.  Strips of latitude are as high as the distance, so
    partners lie in the same or the next strip; each point also appears in the strip above as a guest.  The order
    (strip, longitude) is cut into ranges of equal numbers of points - a strip full of points is cut along its
    longitude too - and points near a cut are repeated in the ranges before it that they can reach.  A pair belongs to
    the range and strip of its right-hand point, so it comes out once.  Only the cuts, one number a task, reach the driver.
    Pairs of places are put in terms of their rows at the end: as many as there are by definition.  Repeated ids with one
    place and label give repeated pairs.
    """
    spot = ["label", "lat", "lon"]
    base = points.select(F.col(ident).cast("bigint").alias("id"), F.xxhash64(label).alias("label"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).where("id is not null")
    places = cut(base.groupBy(*spot).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    # A place with one row is known by that row's id, h = 0; one with several by its first id and its hash.
    places = places.withColumn("h", F.when(F.col("n") > 1, F.xxhash64(*spot)).otherwise(F.lit(0).cast("bigint")))
    swept = _place_pairs(places, metres, tasks or max(partitions(points.sparkSession), 2))
    full = places.where("n > 1")
    total = full.agg(F.sum("n")).first()[0] or 0
    found = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not total:
        return found(swept)
    at = full.select(*spot, F.col("id").alias("first"), "h")
    rows = base.join(maybe_broadcast(at, 48)[0], spot).select("first", "h", "id")
    side = lambda c: rows.select(F.col("first").alias(c), F.col("h").alias(f"{c}h"), F.col("id").alias(f"{c}_id"))
    if total * 32 <= BROADCAST_BYTES:
        for c in ("a", "b"):
            swept = swept.join(F.broadcast(side(c)), [c, f"{c}h"], "left").withColumn(c, F.coalesce(f"{c}_id", c)).drop(f"{c}_id")
        return found(swept)
    swept, n = cut(swept), full.select("id", "h", "n")
    done, rest = swept.where("ah = 0 and bh = 0"), swept.where("ah != 0 or bh != 0")
    # Of two places the one with fewer rows is put in terms of its rows first.
    rest = rest.select(*[F.when(F.col("an") <= F.col("bn"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("ah", "bh"), ("an", "bn"), ("b", "a"), ("bh", "ah"), ("bn", "an"))])
    for c in ("a", "b"):
        key = [c, f"{c}h"]
        hot = hot_keys(n.select(F.col("id").alias(c), F.col("h").alias(f"{c}h"), "n"), key, "n")
        many = skew_join(side(c), rest.where(f"{c}h != 0"), key, hot, "n").withColumn(c, F.col(f"{c}_id")).drop(f"{c}_id")
        rest = rest.where(f"{c}h = 0").unionByName(many)
    return found(done).unionByName(found(rest))


def _place_pairs(places: DataFrame, metres: float, n: int) -> DataFrame:
    """(a, b, ah, bh, an, bn) of places(id, label, lat, lon, h, n) near each other, with different labels."""
    high = math.degrees(metres / EARTH_M)
    home = F.floor((F.col("lat") + 90) / high)
    strips = F.array(F.struct(home.alias("strip"), F.lit(True).alias("own")), F.struct((home + 1).alias("strip"), F.lit(False).alias("own")))
    both = places.select("id", "label", "lat", "lon", "h", "n", F.inline(strips))
    # Longitude that `metres` span at the strip's latitude nearest to a pole, its guests' strip included.
    edge = F.least(F.greatest(F.abs(F.col("strip") * high - 90 - high), F.abs((F.col("strip") + 1) * high - 90)), F.lit(90.0))
    ratio = F.lit(math.sin(metres / EARTH_M)) / F.cos(F.radians(edge))
    both = both.withColumn("reach", F.when((edge >= 90 - high) | (ratio >= 1), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + SLACK))
    # Across the 180th meridian: a copy left of -180 that only serves as a left-hand point.
    here = F.struct(F.col("lon").alias("x"), F.lit(False).alias("left_only"))
    wrapped = F.when((F.col("reach") < 180) & (F.col("lon") > 180 - F.col("reach")), F.struct((F.col("lon") - 360).alias("x"), F.lit(True).alias("left_only")))
    both = both.select("*", F.inline(F.array_compact(F.array(here, wrapped)))).drop("lon").withColumnRenamed("x", "lon")
    both = both.withColumn("place", F.col("strip") * 1024.0 + F.col("lon") + 400.0)
    cuts = sorted(set(both.approxQuantile("place", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    both = both.withColumn("end", F.least(F.col("place") + F.col("reach"), F.col("strip") * 1024.0 + 580.0))
    both = _ranges(both, cuts, {"place": "home", "end": "until"})
    both = both.withColumn("task", F.explode(F.sequence(F.col("home"), F.greatest("home", "until"))))
    both = both.withColumn("right", ~F.col("left_only") & (F.col("task") == F.col("home"))).select("task", "place", "id", "label", "lat", "lon", "own", "right", "reach", "h", "n")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch.assign(old=False)
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) < 60_000:
                continue
            out, held = _sweep(held, False, metres)
            yield from out
        if held is not None and len(held):
            yield from _sweep(held, True, metres)[0]

    placed = both.repartitionById(len(cuts) + 1, F.col("task")).sortWithinPartitions("task", "place")
    return placed.mapInPandas(sweep, "a bigint, b bigint, ah bigint, bh bigint, an bigint, bn bigint")


def _ranges(rows: DataFrame, cuts: list[float], columns: dict[str, str]) -> DataFrame:
    """rows with, per column, how many of the sorted cuts its value has reached, by binary search."""
    if not cuts:
        return rows.withColumns({out: F.lit(0) for out in columns.values()})
    splits = [-math.inf, *cuts, math.inf]
    found = Bucketizer(splitsArray=[splits] * len(columns), inputCols=list(columns), outputCols=list(columns.values())).transform(rows)
    return found.withColumns({out: F.col(out).cast("int") for out in columns.values()})


def _sweep(rows: pd.DataFrame, final: bool, metres: float) -> tuple[list[pd.DataFrame], pd.DataFrame]:
    """Pairs among rows sorted by task and place, and the rows that later ones may still reach."""
    task, place = rows["task"].to_numpy(), rows["place"].to_numpy()
    ids, labels, lat, lon, hashes, sizes = (rows[c].to_numpy() for c in ("id", "label", "lat", "lon", "h", "n"))
    own, right, reach = (rows[c].to_numpy() for c in ("own", "right", "reach"))
    shift = np.concatenate([[0], np.cumsum(task[1:] != task[:-1])]) * 2.0**31
    strip_end = np.floor(place / 1024) * 1024 + 1023
    end = np.searchsorted(place + shift, np.minimum(place + reach + SLACK, strip_end) + shift, side="right")
    # Pairs whose left-hand point came with an earlier batch were not made there only if the right-hand one is new.
    fresh = ~rows["old"].to_numpy()
    out, here = [], np.arange(len(rows))
    counts = end - here - 1
    total = np.cumsum(counts)
    start = 0
    while start < len(rows):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + 2_000_000, side="right")))
        c = counts[start:stop]
        i = np.repeat(here[start:stop], c)
        j = i + 1 + (np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c))
        keep = right[j] & fresh[j] & (own[i] | own[j]) & (labels[i] != labels[j])
        i, j = i[keep], j[keep]
        p, q = np.radians(lat[i]), np.radians(lat[j])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2
        near = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1))) <= metres
        i, j = i[near], j[near]
        if len(i):
            out.append(pd.DataFrame({"a": ids[i], "b": ids[j], "ah": hashes[i], "bh": hashes[j], "an": sizes[i], "bn": sizes[j]}))
        start = stop
    if final:
        return out, rows.iloc[:0]
    still = (task == task[-1]) & (np.floor(place / 1024) == np.floor(place[-1] / 1024)) & (place + reach + SLACK >= place[-1])
    return out, rows[still].assign(old=True)
