"""The same runs in two feeds without a common id: blocking by MinHash, features of pairs, a classifier, one-to-one matches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.common import cut, strip
from tramline.llm.sample import sampled

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
CLOCK = r"^([0-9]{1,3}):([0-5][0-9]):([0-5][0-9])$"
#: Letters with accents and their bases.
ACCENTED, BASES = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
FEATURES = ["bias", "start", "name", "name_unknown", "long_name", "line_share", "headsign", "headsign_unknown", "direction", "direction_unknown", "calls"]


def seconds(v: Column) -> Column:
    g = lambda i: F.regexp_extract(v, CLOCK, i).try_cast("int")
    return F.when(v.rlike(CLOCK), g(1) * 3600 + g(2) * 60 + g(3))


def plain(v: Column) -> Column:
    """Lower-case letters and digits without accents, other characters as single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(v), ACCENTED, BASES), r"[^\p{L}\p{N}]+", " "))


def grams(v: Column, n: int = 3) -> Column:
    """The distinct character n-grams of a text with its ends marked; empty for ''."""
    padded = F.concat(F.lit("^"), v, F.lit("$"))
    return F.when(v == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))))


def runs(trips: DataFrame, routes: DataFrame, calendar: DataFrame, stop_times: DataFrame, feed: str, longest_wait: int = 600) -> DataFrame:
    """One row per trip of a feed: id, line, number, letters, long, days, head, direction, start, calls.

    Of repeated rows, and of older states of a record, the one last loaded counts, of equal ones the one that sorts last.
    start is the arrival at the call that departs first, whatever its number, as numbers may be broken; its departure if the
    arrival is none or lies more than `longest_wait` seconds from it, as then one of them is wrong.  days is the service's pattern of weekdays.
    """
    of = lambda df: df.where(F.col("feed") == feed)

    def last(df: DataFrame, key: str, **cols: Column) -> DataFrame:
        best = F.max(F.struct("loaded_at", *[c.alias(n) for n, c in cols.items()])).alias("m")
        return of(df).groupBy(strip(key).alias(key)).agg(best).where(F.col(key) != "").select(key, *[f"m.{n}" for n in cols])

    trip = last(trips, "trip_id", route_id=strip("route_id"), service_id=strip("service_id"), head=plain(strip("trip_headsign")), direction=strip("direction_id"))
    short = F.upper(strip("route_short_name"))
    route = last(routes, "route_id", number=F.regexp_replace(F.regexp_extract(short, r"([0-9]+)[^0-9]*$", 1), r"^0+(?=[0-9])", ""), letters=F.regexp_extract(short, r"^([A-Z]*)", 1), long=plain(strip("route_long_name")))
    service = last(calendar, "service_id", days=F.concat(*[strip(d) for d in DAYS]))
    number = strip("stop_sequence")
    come, go = seconds(strip("arrival_time")), seconds(strip("departure_time"))
    call = of(stop_times).select(strip("trip_id").alias("trip_id"), F.when(number.rlike("^[0-9]{1,9}$"), number.try_cast("int")).alias("n"), come.alias("come"), go.alias("go"))
    calls = call.groupBy("trip_id").agg(F.min_by(F.struct("come", "go"), F.coalesce("go", "come")).alias("first"), F.count_distinct("n").alias("calls"))
    near = F.abs(F.col("first.go") - F.col("first.come")) <= longest_wait
    calls = calls.select("trip_id", F.when(near, F.col("first.come")).otherwise(F.coalesce("first.go", "first.come")).alias("start"), "calls")
    out = trip.join(calls, "trip_id", "left").join(route, "route_id", "left").join(service, "service_id", "left")
    return out.select(F.col("trip_id").alias("id"), F.col("route_id").alias("line"), F.coalesce("number", F.lit("")).alias("number"), F.coalesce("letters", F.lit("")).alias("letters"), F.coalesce("long", F.lit("")).alias("long"), F.coalesce("days", F.lit("")).alias("days"), "head", "direction", "start", F.coalesce("calls", F.lit(0)).alias("calls"))


def _least(tokens: Column, seed: int) -> Column:
    """MinHash of a set of tokens under one order."""
    return F.array_min(F.transform(tokens, lambda t: F.xxhash64(t, F.lit(seed))))


def candidate_pairs(left: DataFrame, right: DataFrame, near: int = 120, orders: int = 4) -> DataFrame:
    """Distinct (l, r) ids that share a block: equal days, starts at most `near` seconds apart, and a key by the lines' numbers.

    Where both lines have a number the key is the number.  Where one has none it is the MinHash of the character grams of
    the headsign or of the line's long name, under `orders` orders each, which finds partners that are spelled another way.
    Lines with two different numbers are compared by the same MinHashes, but only lines of which some trips meet under one
    headsign or long name, as their number grows with the square of the trips else.  The start's slot of `near` seconds is
    part of every key, with the right side's put in three slots: so even a line that holds much of all trips falls apart
    into blocks of the few trips that leave together.
    """
    hashed = lambda c, kind, of: F.when(F.col(c) != "", F.xxhash64(F.lit(kind), of))
    least = F.array_distinct(F.array_compact(F.array(*[hashed(c, f"{c}{k}", _least(grams(F.col(c)), k)) for c in ("head", "long") for k in range(orders)])))
    whole = F.array_compact(F.array(*[hashed(c, c, F.col(c)) for c in ("head", "long")]))
    slot, number = F.floor(F.col("start") / near), F.array_compact(F.array(hashed("number", "number", F.col("number"))))
    known = lambda df: df.where("start is not null and days != ''")
    none, some = F.col("number") == "", F.col("number") != ""

    def side(df: DataFrame, to: str, keys: Column, slots: Column) -> DataFrame:
        return known(df).select(F.col("id").alias(to), F.col("line").alias(f"{to}_line"), F.col("number").alias(f"{to}_number"), F.col("start").alias(f"{to}_start"), "days", keys.alias("key"), slots.alias("slot"))

    def met(l: DataFrame, r: DataFrame, lk: Column, rk: Column) -> DataFrame:
        """Pairs of rows that share a key and leave at most `near` seconds apart."""
        l, r = side(l, "l", lk, slot).withColumn("key", F.explode("key")), side(r, "r", rk, F.array(slot - 1, slot, slot + 1)).withColumn("key", F.explode("key")).withColumn("slot", F.explode("slot"))
        return l.join(r, ["key", "days", "slot"]).where(close)

    close = F.abs(F.col("l_start") - F.col("r_start")) <= near
    pairs = met(left.where(some), right.where(some), number, number).select("l", "r")
    for l, r in ((left.where(none), right), (left.where(some), right.where(none))):
        if not l.isEmpty() and not r.isEmpty():
            pairs = pairs.unionByName(met(l, r, least, least).select("l", "r"))
    lines = met(left.where(some), right.where(some), whole, whole).where("l_number != r_number").select("l_line", "r_line").distinct()
    l, r = side(left.where(some), "l", least, slot), side(right.where(some), "r", least, F.explode(F.array(slot - 1, slot, slot + 1))).withColumnRenamed("key", "r_key")
    renamed = l.join(lines, "l_line").join(r, ["r_line", "days", "slot"]).where(close & F.arrays_overlap("key", "r_key"))
    return pairs.unionByName(renamed.select("l", "r")).distinct()


def _overlap(a: Column, b: Column) -> Column:
    """Shared grams over the smaller set's size: a cut-off or extended spelling still counts as near."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame, near: int = 120) -> DataFrame:
    """(l, r, gap, the features): similarities of the pair, and how far its lines and directions belong together by all pairs."""
    l = left.select([F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("l_grams", grams(F.col("l_head"), 2))
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r_grams", grams(F.col("r_head"), 2))
    both = pairs.join(l, F.col("l") == F.col("l_id")).join(r, F.col("r") == F.col("r_id"))
    both = both.withColumn("headsign", F.when((F.col("l_head") != "") & (F.col("r_head") != ""), _overlap(F.col("l_grams"), F.col("r_grams")))).withColumn("gap", F.abs(F.col("l_start") - F.col("r_start")))
    both = both.select("l", "r", "gap", "headsign", "l_line", "r_line", "l_direction", "r_direction", "l_number", "r_number", "l_letters", "r_letters", "l_long", "r_long", "l_calls", "r_calls")
    # How often trips of the two lines meet, against how often trips of either line meet any trip; only plausible headsigns count.
    good = both.where("headsign is null or headsign >= 0.5")
    meet = good.groupBy("l_line", "r_line").agg(F.count_distinct("l").alias("met"), F.count_distinct("r").alias("met_r"))
    of_l = left.groupBy(F.col("line").alias("l_line")).agg(F.count("*").alias("l_n"))
    of_r = right.groupBy(F.col("line").alias("r_line")).agg(F.count("*").alias("r_n"))
    lines = meet.join(of_l, "l_line").join(of_r, "r_line").select("l_line", "r_line", F.least(F.lit(1.0), F.least("met", "met_r") / F.least("l_n", "r_n")).alias("line_share"))
    # Whether the two numberings of directions agree or are swapped on these lines, by the headsigns of their other pairs.
    sides = both.where("headsign is not null and l_direction in ('0', '1') and r_direction in ('0', '1')").withColumn("same", F.col("l_direction") == F.col("r_direction")).withColumn("vote", F.when(F.col("headsign") >= 0.6, 1).when(F.col("headsign") < 0.4, -1).otherwise(0))
    turn = sides.groupBy("l_line", "r_line").agg(F.sum(F.when(F.col("same"), F.col("vote")).otherwise(-F.col("vote"))).alias("turn"), F.sum(F.abs("vote")).alias("votes"))
    known = F.col("l_direction").isin("0", "1") & F.col("r_direction").isin("0", "1")
    out = both.join(lines, ["l_line", "r_line"], "left").join(turn, ["l_line", "r_line"], "left")
    own = F.when(known & F.col("headsign").isNotNull(), F.when(F.col("headsign") >= 0.6, 1).when(F.col("headsign") < 0.4, -1).otherwise(0)).otherwise(0)
    sign = F.when(F.col("l_direction") == F.col("r_direction"), 1).otherwise(-1)
    rest = F.coalesce("turn", F.lit(0)) - own * sign  # without the pair's own vote
    lean = rest / (F.coalesce("votes", F.lit(0)) - F.abs(own) + 2)
    letters = F.when(F.col("l_letters") == F.col("r_letters"), 1.0).when((F.length("l_letters") > 1) | (F.length("r_letters") > 1) | (F.col("l_letters") == "") | (F.col("r_letters") == ""), 0.3).otherwise(-1.0)
    number = F.when((F.col("l_number") != "") & (F.col("r_number") != ""), F.when(F.col("l_number") == F.col("r_number"), letters).otherwise(-2.0))
    long = F.when((F.col("l_long") != "") & (F.col("r_long") != ""), F.when(F.col("l_long") == F.col("r_long"), 1.0).otherwise(2 * _overlap(grams(F.col("l_long"), 2), grams(F.col("r_long"), 2)) - 1.4))
    return out.select(
        "l", "r", "gap",
        F.lit(1.0).alias("bias"), (F.col("gap") / near).alias("start"), F.coalesce(number, F.lit(0.0)).alias("name"), F.when(number.isNull(), 1.0).otherwise(0.0).alias("name_unknown"),
        F.coalesce(long, F.lit(0.0)).alias("long_name"), F.coalesce("line_share", F.lit(0.0)).alias("line_share"),
        F.coalesce(2 * F.col("headsign") - 1, F.lit(0.0)).alias("headsign"), F.when(F.col("headsign").isNull(), 1.0).otherwise(0.0).alias("headsign_unknown"),
        F.when(known, lean * sign).otherwise(0.0).cast("double").alias("direction"), F.when(known, 0.0).otherwise(1.0).alias("direction_unknown"),
        (F.least("l_calls", "r_calls") / F.greatest("l_calls", "r_calls", F.lit(1))).cast("double").alias("calls"),
    )


def _votes(x: dict[str, np.ndarray]) -> np.ndarray:
    """Weak label by votes of simple rules: near 1 same run, near 0 not, 0.5 undecided."""
    line = (x["line_share"] >= 0.3) * 1.0 - (x["line_share"] < 0.12) + (x["long_name"] > 0.5) - (x["long_name"] < -0.3) + 0.5 * (x["name"] == 1) - 1.5 * (x["name"] <= -1)
    way = 1.5 * (x["headsign"] > 0.4) - 1.5 * (x["headsign"] < -0.4) * (x["headsign_unknown"] == 0) + (x["direction"] > 0.4) - (x["direction"] < -0.4)
    both = np.minimum(line, way)
    return np.where(both >= 1, 1.0, np.where(both <= -1, 0.0, 0.5))


def fit_matcher(sample: list[tuple]) -> tuple[np.ndarray, tuple[float, float]]:
    """Logistic weights and the two numbers that calibrate their scores, from rows of features in the order of FEATURES.

    Trained on three quarters of the weakly labelled rows; the slope and offset of the calibration are fitted on the rest.
    """
    x = np.array(sample, dtype=float).reshape(-1, len(FEATURES))
    cols = {f: x[:, i] for i, f in enumerate(FEATURES)}
    y = _votes(cols)
    sure = y != 0.5
    if not (y[sure] == 1).any() or not (y[sure] == 0).any():  # too little to learn from: the rules' own scale
        w = np.zeros(len(FEATURES))
        w[[FEATURES.index(f) for f in ("bias", "line_share", "headsign", "direction", "name", "long_name")]] = [-1.5, 4, 3, 3, 1.5, 1]
        return w, (1.0, 0.0)

    def logistic(a: np.ndarray, t: np.ndarray, ridge: float) -> np.ndarray:
        w = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - t) + ridge * w
            h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(a.shape[1])
            w -= np.linalg.solve(h, g)
        return w

    x, y = x[sure], y[sure]
    held = np.arange(len(x)) % 4 == 3
    w = logistic(x[~held], y[~held], 2.0)
    score = x[held] @ w
    cal = logistic(np.stack([score, np.ones(len(score))], axis=1), np.clip(y[held], 0.02, 0.98), 0.1) if held.sum() > 20 else np.array([1.0, 0.0])
    return w, (float(max(cal[0], 0.1)), float(cal[1]))


def scored_pairs(left: DataFrame, right: DataFrame, near: int = 120, most_sampled: int = 20_000) -> DataFrame:
    """(l, r, gap, confidence) for all candidate pairs. The classifier is fitted on at most `most_sampled` of them, chosen by hash."""
    features = cut(pair_features(cut(candidate_pairs(left, right, near)), left, right, near))
    sample = sampled(features.select("l", "r", *FEATURES), ["l", "r"], most_sampled)
    w, (slope, offset) = fit_matcher([tuple(s[f] for f in FEATURES) for s in sample])
    score = sum((F.col(f) * float(c) for f, c in zip(FEATURES, w)), F.lit(0.0))
    return features.select("l", "r", "gap", (1 / (1 + F.exp(-(score * slope + offset)))).alias("confidence"))


def one_to_one(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs in which each side is the other's best of those still free, taken in rounds until none is left.

    The best is the one of highest confidence, then smallest gap, then smallest ids.
    """
    open_pairs = cut(pairs.where(F.col("confidence") >= least))
    taken = None
    order = [F.col("confidence").desc(), "gap", "l", "r"]
    while True:
        ranked = open_pairs.withColumn("i", F.row_number().over(W.partitionBy("l").orderBy(*order))).withColumn("j", F.row_number().over(W.partitionBy("r").orderBy(*order)))
        best = cut(ranked.where("i = 1 and j = 1").select("l", "r", "gap", "confidence"))
        taken = best if taken is None else taken.unionByName(best)
        open_pairs = cut(open_pairs.join(best.select("l"), "l", "left_anti").join(best.select("r"), "r", "left_anti"))
        if open_pairs.isEmpty():
            return taken


def matched_runs(left: DataFrame, right: DataFrame, near: int = 120, least: float = 0.5) -> DataFrame:
    """(l, r, gap, confidence): pairs of rows of runs() that are one run; a run is in one pair at most.

    Runs whose start or days are unknown can't be paired.  Empty feeds give no rows.
    """
    return one_to_one(scored_pairs(cut(left), cut(right), near), least)
