"""Differences between two copies of keyed data, by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.common import PLAIN_DECIMAL, cut, ntz, partitions, strip


def exact_decimal(v: Column) -> Column:
    """One spelling per value of a plain decimal; other texts as they are."""
    digits = F.regexp_replace(v, r"^[+-]?0*(?=[0-9])", "")
    short = F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(v.rlike(PLAIN_DECIMAL), F.when(v.startswith("-") & (short != "0"), F.concat(F.lit("-"), short)).otherwise(short)).otherwise(v)


def colour(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "^#", ""))


def latest(rows: DataFrame, tab: str, key: str, fields: dict[str, object], copies: Sequence[str] = ("cad", "hastus"), feed: str = "feed") -> DataFrame:
    """(tab, copy, key, vals): per copy and trimmed key the row last loaded among those not withdrawn.

    fields: name -> how its trimmed text is put for comparison, or None.  vals is the array of those texts.  Rows with a
    blank key are left out; of rows equal in loaded_at the one that sorts last counts; null loaded_at is the earliest.
    """
    vals = F.array(*[(how(strip(f)) if how else strip(f)) for f, how in fields.items()])
    live = rows.where(F.col(feed).isin(*copies) & F.col("deleted_at").isNull()).select(F.col(feed).alias("copy"), strip(key).alias("key"), ntz("loaded_at").alias("at"), vals.alias("vals")).where("key != ''")
    return live.groupBy("copy", "key").agg(F.max(F.struct("at", "vals")).alias("m")).select(F.lit(tab).alias("tab"), "copy", "key", "m.vals")


def _chunks(rows: Iterator[pd.DataFrame], window: int, mean: int, most: int) -> Iterator[pd.DataFrame]:
    """Rows in order of tab, key, with both copies' rows mixed: adds the fingerprint of the row's chunk in its copy."""
    mult, turn, none = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.empty(0, dtype=np.uint64)
    #: Per table and copy the rows of the chunk that is still open, and the hashes of the last keys.
    state: dict[tuple[str, str], tuple] = {}

    def closed(tab: str, copy: str, keys: np.ndarray, rh: np.ndarray, stops: np.ndarray) -> pd.DataFrame:
        """Rows up to stops[-1] with the fingerprints of the chunks that end there."""
        starts = np.concatenate([[0], stops[:-1]])
        size = stops - starts
        rh = rh[: stops[-1]]
        place = (np.arange(len(rh)) - np.repeat(starts, size) + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            a = np.bitwise_xor.reduceat((rh ^ (rh >> np.uint64(29))) * mult + place * turn, starts)
            b = np.add.reduceat(rh * (place * mult | np.uint64(1)), starts)
        return pd.DataFrame({"tab": tab, "copy": copy, "key": keys[: stops[-1]], "size": np.repeat(size, size), "a": np.repeat(a.view(np.int64), size), "b": np.repeat(b.view(np.int64), size)})

    for batch in rows:
        out = []
        for (tab, copy), g in batch.groupby(["tab", "copy"], sort=False):
            keys, rh, tail = state.get((tab, copy), (np.empty(0, dtype=object), none, none))
            kh = g["kh"].to_numpy().astype(np.int64).view(np.uint64)
            seen = np.concatenate([tail, kh])
            roll = np.zeros(len(kh), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for back in range(window):  # the sum over the last `window` keys' hashes, each turned by its distance
                    part = seen[max(0, len(seen) - len(kh) - back) : len(seen) - back]
                    roll[len(kh) - len(part) :] += part * (mult ** np.uint64(back + 1) if back else mult)
            stops = len(keys) + 1 + np.flatnonzero((roll >> np.uint64(33)) % np.uint64(mean) == 0)
            keys, rh = np.concatenate([keys, g["key"].to_numpy()]), np.concatenate([rh, g["rh"].to_numpy().astype(np.int64).view(np.uint64)])
            # A stretch without a cut is cut every `most` rows.
            bounds = np.concatenate([[0], stops, [len(keys)]])
            for at in np.flatnonzero(np.diff(bounds) > most):
                stops = np.concatenate([stops, np.arange(bounds[at] + most, bounds[at + 1], most)])
            stops = np.unique(stops)
            if len(stops):
                out.append(closed(tab, copy, keys, rh, stops))
                keys, rh = keys[stops[-1] :], rh[stops[-1] :]
            state[tab, copy] = keys, rh, seen[len(seen) - min(len(seen), window - 1) :]
        if out:
            yield pd.concat(out, ignore_index=True)
    rest = [closed(tab, copy, keys, rh, np.array([len(keys)])) for (tab, copy), (keys, rh, _) in state.items() if len(keys)]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def copy_differences(copies: DataFrame, fields: dict[str, Sequence[str]], left: str = "cad", right: str = "hastus", window: int = 3, mean: int = 16, most: int = 4096) -> DataFrame:
    """(tab, record_key, fld, kind): keys in one copy only (fld '', kind only_<copy>) and fields that differ (kind differs).

    copies: from latest(), one row per tab, copy and key.  Both copies are range-partitioned together by key and sorted; a
    copy's rows are cut where the rolling hash over the last keys meets a condition, so a missing row moves the cuts only
    near it.  Chunks whose fingerprint both copies hold are equal and dropped; only rows of the others are compared field
    by field.  Only hashes and keys go through the chunking.  Two empty copies, or equal ones, give no rows.
    """
    spark = copies.sparkSession
    copies = cut(copies)
    slim = copies.select("tab", "copy", "key", F.xxhash64("key").alias("kh"), F.xxhash64("key", "vals").alias("rh"))
    placed = slim.repartitionByRange(partitions(spark), "tab", "key").sortWithinPartitions("tab", "key", "copy")
    chunked = cut(placed.mapInPandas(lambda it: _chunks(it, window, mean, most), "tab string, copy string, key string, size bigint, a bigint, b bigint"))
    chunk = ["tab", "size", "a", "b"]
    shared = chunked.groupBy(*chunk).agg(F.min("copy").alias("one"), F.max("copy").alias("other")).where("one != other").select(*chunk)
    odd = chunked.join(shared, chunk, "left_anti").select("tab", "copy", "key")
    rows = copies.join(odd, ["tab", "copy", "key"], "left_semi")
    side = lambda c: F.max(F.when(F.col("copy") == c, F.col("vals")))
    pairs = rows.groupBy("tab", "key").agg(side(left).alias("l"), side(right).alias("r"))
    # A chunk of one copy may lack a partner whose rows are all in shared chunks of the other copy only if keys repeat; they don't.
    names = F.create_map(*[x for t, f in fields.items() for x in (F.lit(t), F.array(*map(F.lit, f)))])
    moved = F.filter(F.transform(names[F.col("tab")], lambda f, i: F.when(F.col("l")[i] != F.col("r")[i], f)), lambda f: f.isNotNull())
    what = F.when(F.col("r").isNull(), F.array(F.struct(F.lit("").alias("fld"), F.lit(f"only_{left}").alias("kind")))).when(F.col("l").isNull(), F.array(F.struct(F.lit("").alias("fld"), F.lit(f"only_{right}").alias("kind")))).otherwise(F.transform(moved, lambda f: F.struct(f.alias("fld"), F.lit("differs").alias("kind"))))
    return pairs.select("tab", F.col("key").alias("record_key"), F.inline(what))


#: The compared fields of the feeds' tables and how their texts are put for comparison.
STOPS = {"stop_name": None, "stop_lat": exact_decimal, "stop_lon": exact_decimal, "parent_station": None, "wheelchair_boarding": None}
TRIPS = {"route_id": None, "service_id": None, "trip_headsign": None, "direction_id": None, "shape_id": None, "wheelchair_accessible": None, "bikes_allowed": None}
ROUTES = {"route_short_name": None, "route_long_name": None, "route_type": None, "route_color": colour, "route_text_color": colour}


def feed_copy_differences(stops: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    both = latest(stops, "stops", "stop_id", STOPS).unionByName(latest(trips, "trips", "trip_id", TRIPS)).unionByName(latest(routes, "routes", "route_id", ROUTES))
    return copy_differences(both, {"stops": list(STOPS), "trips": list(TRIPS), "routes": list(ROUTES)})
