import random

from pyspark.sql import functions as F

from tramline.llm.entities import candidate_pairs, matched_runs, one_to_one, runs

NAMES = ["Pandesby", "Klérmont", "Vaindamstow", "Türémgny", "Rômaimbourg", "Skockonport", "Zêckémère", "Flilaumgate"]


def tables(spark, day, seed=10, lines=24, per=16):
    rng = random.Random(seed)
    trips, routes, calls, cal, truth = [], [], [], [], set()
    for f in ("rail", "final"):
        for k, days in (("W", "1111100"), ("S", "0000010"), ("D", "0000001")):
            cal.append((f, f"{f}{k}", *days, day(0)))
    for n in range(lines):
        ends, swap = rng.sample(NAMES, 2), rng.random() < 0.3
        routes += [("rail", f"R{n}", f"{'RL'[n % 2]}{n // 2}", " – ".join(ends), day(0)), ("final", f"F{n}", rng.choice([f"{'RL'[n % 2]}{n // 2}", f"{n // 2}", f"{'rl'[n % 2]}{n // 2} "]), "" if n % 3 else " – ".join(ends), day(0))]
        for i in range(per):
            way, k, at = rng.randrange(2), rng.choice("WSD"), 21600 + i * 3000 + rng.randrange(900)
            clock = lambda s: f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
            pair = rng.random() < 0.85
            for f, there in (("rail", True), ("final", pair)):
                if there:
                    t = f"{f[0]}{n}-{i}"
                    head = ends[way] if f == "rail" else rng.choice([ends[way], ends[way].upper(), ends[way][:6], None, f"Gare {ends[way]}"])
                    d = str(1 - way) if f == "final" and swap else str(way)
                    trips.append((f, f"{f[0].upper()}{n}", f"{f}{k}", t, head, "" if rng.random() < 0.1 else d, day(1)))
                    start = at if f == "rail" else at + rng.choice([0, 60, -60, 120])
                    calls += [(f, t, clock(start + j * 120), None, str(j + 1)) for j in range(8)]
            if pair:
                truth.add((f"f{n}-{i}", f"r{n}-{i}"))
            else:  # a decoy on the same line at the time, the other way
                t = f"x{n}-{i}"
                trips.append(("final", f"F{n}", f"final{k}", t, ends[1 - way], str(way if swap else 1 - way), day(1)))
                calls += [("final", t, clock(at + j * 120), None, str(j + 1)) for j in range(8)]
    return (
        spark.createDataFrame(trips + trips[:5], "feed string, route_id string, service_id string, trip_id string, trip_headsign string, direction_id string, loaded_at timestamp"),
        spark.createDataFrame(routes, "feed string, route_id string, route_short_name string, route_long_name string, loaded_at timestamp"),
        spark.createDataFrame(cal, "feed string, service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, loaded_at timestamp"),
        spark.createDataFrame(calls, "feed string, trip_id string, arrival_time string, departure_time string, stop_sequence string"),
    ), truth


def test_pairs_and_decoys(spark, day):
    t, truth = tables(spark, day)
    final, rail = runs(*t, "final"), runs(*t, "rail")
    cand = {(r.l, r.r) for r in candidate_pairs(final, rail).collect()}
    assert len(truth & cand) == len(truth)
    rows = matched_runs(final, rail).collect()
    got = {(r.l, r.r) for r in rows}
    assert len(got) == len(rows) == len({l for l, _ in got}) == len({r for _, r in got})
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)
    assert all(0.5 <= r.confidence <= 1 and r.gap <= 120 for r in rows)


def test_candidates_do_not_grow_with_the_square_of_lines(spark):
    rng = random.Random(4)
    towns = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(80)]
    row = lambda f, n, number, head, start: (f"{f}{n}", f"{f}line{number or n}", number, "R", "", "1111100", head, "0", start, 8)
    sides = [[row(f, n, str(n), f"terminus {t}", 30000) for n, t in enumerate(towns)] for f in "lr"]
    sides[0] += [row("l", 901, "700", "gare mavito", 40000), row("l", 902, "700", "quai", 50000), row("l", 903, "", "gare nopita", 60000)]
    sides[1] += [row("r", 901, "800", "gare mavito", 40060), row("r", 902, "800", "quai nord", 50000), row("r", 903, "9", "nopita", 60000)]  # renumbered, and without a number
    l, r = (spark.createDataFrame(x, "id string, line string, number string, letters string, long string, days string, head string, direction string, start int, calls long") for x in sides)
    got = {(x.l, x.r) for x in candidate_pairs(l, r).collect()}
    assert {(f"l{n}", f"r{n}") for n in [*range(80), 901, 902, 903]} == got


def test_one_to_one_takes_the_best_in_rounds(spark):
    pairs = spark.createDataFrame([("a", "x", 0, 0.9), ("a", "y", 0, 0.8), ("b", "x", 0, 0.85), ("b", "y", 0, 0.4), ("c", "y", 5, 0.7), ("d", "y", 5, 0.7)], "l string, r string, gap int, confidence double")
    assert sorted((r.l, r.r) for r in one_to_one(pairs).collect()) == [("a", "x"), ("c", "y")]


def test_empty_and_null_tables(spark, day):
    (trips, routes, cal, calls), _ = tables(spark, day, lines=2, per=3)
    none = [x.where("false") for x in (trips, routes, cal, calls)]
    assert matched_runs(runs(*none, "final"), runs(*none, "rail")).collect() == []
    blank = [x.select(*[F.col(c) if c == "feed" else F.lit(None).cast(t).alias(c) for c, t in x.dtypes]) for x in (trips, routes, cal, calls)]
    assert matched_runs(runs(*blank, "final"), runs(*blank, "rail")).collect() == []
    for i in range(1, 4):
        some = [none[j] if j == i else x for j, x in enumerate((trips, routes, cal, calls))]
        matched_runs(runs(*some, "final"), runs(*some, "rail")).collect()
