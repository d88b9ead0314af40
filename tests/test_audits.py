import pytest
from pyspark.sql import functions as F

from tramline.operators import audits as A
from tramline.operators import evidence as E
from tramline.operators import inspection, patterns, reconciliation, rules, service_dates
from tramline.plans import analyses, ledger


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


CALLS = [("t1", "25:00:00", "25:00:00", "s1", "1", "0", "0", "1"), ("t1", "25:10:00", "25:10:00", "s2", "2", "0", "0", "1")]


def test_kinds_of_trips_don_t_mix(baseline):
    ids = ["a", "b", "c", "d"]
    t = baseline(trips=[("r1", "wk", "a", "", "0", "", "1", "1"), ("r1", "wk", "b", "x", "0", "", "1", "1"), ("r1", "wk", "c", "x", "0", "", "1", "1"), ("r1", "wk", "d", "x", "0", "g1", "1", "1")], stop_times=[(i, *c[1:]) for i in ids for c in CALLS])
    got = told(inspection.inspected(t).where("rule_id between 'INS010' and 'INS014'"), "rule_id", "severity", "category", "row", "key", "observed")
    assert got == [("INS012", "warning", "Agency review", 2, "r1", "3"), ("INS013", "warning", "Agency review", 2, "r1", "1")]


def test_routes_of_an_audit(baseline):
    rail = baseline(routes=[("r1", "A", "7", "x", "2", "00AA11", ""), ("r2", "A", "8", "y", "2", "", "")])
    final = baseline(routes=[("q", "B", "9", "z", "2", "", "")], trips=[("q", "wk", "zz", "M", "0", "g1", "1", "1")], stop_times=[("zz", *c[1:3], "s2", *c[4:]) for c in CALLS])
    statuses = analyses.audit_source(rail, final).cache()
    assert told(statuses, "trip_id", "status") == [("t1", "missing")]
    assert told(A.route_findings(rail, final["routes"], statuses), "rule_id", "key", "severity") == [("RAIL004", "7", "error"), ("RAIL008", "r2", "warning")]
    assert told(A.route_statuses(rail, final, statuses), "name", "status", "missing", "extra") == [("7", "issues", 1, 0), ("8", "issues", 0, 0)]
    assert told(A.review_findings(statuses, rail["trips"], rail["routes"], "rail"), "rule_id", "key", "observed") == [("INS020", "7", "1 missing, 0 changed, 0 unverifiable")]
    assert told(A.examples_of(statuses, rail["trips"]), "route_id", "trip_id") == [("r1", "t1")] and A.examples_of(statuses, rail["trips"], 0).count() == 0
    assert told(A.route_change_findings(rail["routes"], baseline()["routes"]), "key", "observed") == [("r1 ↔ r1", "route_type, route_long_name, route_text_color")]
    bus = {"cad": baseline(), "bad": {}}
    got = A.rail_findings(rail, final, bus, rules.technical(rail), statuses, reconciliation.stop_changes(rail["stops"], final["stops"], rail["stop_times"], final["stops"].selectExpr("stop_id as source_id", "stop_id as target_id"), ["stop_name"]))
    rail_rules = [r for r, *_ in told(got, "rule_id", "key")]
    assert {"RAIL004", "RAIL008", "RAIL020", "RAIL021"} <= set(rail_rules)
    assert told(A.relabelled(rules.technical(baseline(trips=[("zz", "wk", "t1", "x", "0", "g1", "1", "1")])), "RAIL001", "Rail validation", "rail"), "rule_id", "file", "context")[0] == ("RAIL001", "rail:trips", '{"source_rule":"REL007"}')


def test_where_ids_come_from(spark, baseline):
    cad, rail = baseline(), baseline(routes=[("q1", "A", "1", "x", "2", "", "")], trips=[("q1", "rs", "u1-rs", "x", "0", "h1", "1", "1")], shapes=[("h1", "1", "1", "1")], calendar=[("rs", *"1111100", "20260105", "20260118")])
    final = baseline(routes=[("r1", "A", "7", "x", "3", "", ""), ("new", "A", "1", "x", "2", "", ""), ("lost", "A", "5", "x", "3", "", "")], trips=[("r1", "wk", "t1-wk", "x", "0", "g1", "1", "1"), ("new", "rs", "u1", "x", "0", "h9", "1", "1"), ("new", "s9", "u9", "x", "0", "h9", "1", "1"), ("lost", "s8", "bad", "x", "0", "h8", "1", "1")], shapes=[("g1", "1", "1", "1"), ("h9", "1", "1", "1"), ("h8", "1", "1", "1")], calendar=[("wk", *"1111100", "20260105", "20260118"), ("s9", *"1111100", "20260105", "20260118"), ("s8", *"1111100", "20260105", "20260118")], calendar_dates=[])
    resolved = spark.createDataFrame([("u9",)], "trip_id string")
    got = told(A.provenance_findings(A.provenance_sides(final, [cad], rail, resolved)), "rule_id", "key")
    assert got == [("MRG101", "lost"), ("MRG102", "bad"), ("MRG103", "h8"), ("MRG104", "s8")]
    assert len(told(A.provenance_findings(A.provenance_sides(final, [cad])), "rule_id", "key")) > 4


def test_findings_about_sources(baseline):
    a = baseline(stops=[("a", "c7", "x", "1", "1", "", "", ""), ("b", "c7", "x", "1", "1", "", "", "")])
    b = baseline(stops=[("c7", "", "x", "1", "1", "", "", "")])
    assert told(A.ambiguity_findings(a["stops"], b["stops"]), "rule_id", "key", "observed") == [("STP001", "c7", "a, b")]
    apart = baseline(stop_times=[CALLS[0], ("t2", *CALLS[0][1:]), CALLS[1]])
    assert told(A.contiguity_findings(apart["stop_times"]), "rule_id", "key", "observed") == [("TRP001", "t1", "2")]
    assert A.comparable_feeds(apart["stop_times"]).count() == 0 and A.comparable_feeds(baseline()["stop_times"]).count() == 1
    bad = baseline(calendar=[("wk", *"1111100", "x", "")])
    assert told(A.coverage_findings(bad["trips"], service_dates.coverage(bad["calendar"])), "rule_id") == [("INS005",)]
    assert A.coverage_findings(a["trips"], service_dates.coverage(a["calendar"])).count() == 0
    rail = baseline(routes=[("q", "A", "7", "", "2", "", ""), ("q2", "A", "", "", "2", "", "")])["routes"]
    assert told(A.shared_name_findings(baseline()["routes"], rail, inspection.RAIL_TYPES), "rule_id", "key", "observed") == [("INS015", "r1", "7")]
    turned = baseline(stop_times=[("t1", *CALLS[0][1:4], "2", "", "", ""), ("t1", *CALLS[0][1:4], "1", "", "", ""), ("t2", *CALLS[0][1:4], "1", "", "", "")])
    assert told(A.unordered_trips(turned["stop_times"]), "trip_id") == [("t1",)]


@pytest.mark.parametrize("part, rule", [("run", "RUN002"), ("rail", "RAIL999"), ("inspection", "INS999"), ("source", "INS021"), ("trips", "TRP002")])
def test_a_part_that_stops_is_told(spark, part, rule):
    def stop():
        raise KeyError("calendar")

    assert told(A.attempted(spark, part, "x", stop), "rule_id", "key", "observed") == [(rule, "x", "'calendar'")]
    fine = A.told(spark, "INS020", "warning", "c", "k")
    assert A.attempted(spark, part, "x", lambda: fine) is fine


def test_inspections_together(baseline):
    t = baseline(trips=[("", "wk", "t1", "x", "0", "g1", "1", "1")])
    both = ledger.union([inspection.inspected(t), rules.technical(t)])
    got = A.fan_in({"cad": both, "final": both, "rail": both})
    per = {s: {r for r, f in told(got, "rule_id", "file") if f.startswith(s)} for s in ("cad", "final", "rail")}
    assert "REL007" in per["cad"] and per["final"] == {r for r in per["cad"] if r.startswith("INS")} and not any(r.startswith(("REL", "VAL")) for r in per["rail"])


def test_a_whole_reconciliation(baseline):
    a, b = baseline(), baseline(stops=[("11", "", "Quay Else", "45.2", "-75.1", "0", "", "2"), ("12", "", "Mill", "45.2", "-75.2", "", "", "1")], stop_times=[("t1", *CALLS[0][1:3], "11", *CALLS[0][4:]), ("t1", *CALLS[1][1:3], "12", *CALLS[1][4:])])
    final = baseline(stop_times=[CALLS[0]], trips=[("r1", "wk", "t1", "Mill", "0", "zz", "1", "1")], shapes=[("zz", "1", "1", "1")], stops=[("s1", "11", "Quay", "45.1", "-75.1", "0", "", "1"), ("new", "", "x", "1", "1", "", "", "")])
    rail = baseline(routes=[("q1", "A", "1", "x", "2", "", "")], trips=[("q1", "wk", "u1", "x", "0", "g1", "1", "1")], stop_times=[("u1", *c[1:]) for c in CALLS])
    got = {(r.rule_id, r.key) for r in analyses.reconciled_findings(a, b, final, rail).select("rule_id", "key").collect()}
    assert {("STP005", "s1 ↔ 11"), ("STP006", "s1 ↔ 11"), ("STP010", "s1 ↔ 11"), ("STP002", "s2"), ("STP003", "12"), ("STP004", "new"), ("MRG103", "zz"), ("TRP100", "t1"), ("RAIL002", "u1"), ("RAIL004", "1")} <= got
    assert "RAIL999" not in {r for r, _ in got}


def test_records_and_order(baseline):
    t = baseline()
    assert told(E.record(t["stops"], "f", 3), "stop_id") == [("s2",)] and E.record(t["stops"], "f", 99).count() == 0
    with pytest.raises(ValueError):
        E.record(t["stops"], "f", 1)
    assert [r._row for r in E.in_file_order(t["stops"]).collect()] == [2, 3, 4] and [len(b) for b in E.batches(t["stops"], 2)] == [2, 1]
    odd = baseline(stop_times=[("t1", "", "", "s1", "x", "", "", ""), ("t1", "", "", "s2", "10", "", "", ""), ("t1", "", "", "s1", "9", "", "", "")])
    assert [(r.place, r.sequence, r.stop_name) for r in E.trip_calls(odd["stop_times"], odd["stops"]).orderBy("place").collect()] == [(0, "9", "Quay"), (1, "10", "Mill"), (2, "x", "Quay")]


def test_a_release_beside_its_sources(spark):
    rows = [("k", list("abcd"), list("abxd"), list("abde")), ("same", list("ab"), list("ab"), list("ab")), ("none", list("ab"), list("b"), [])]
    got = E.beside_release(spark.createDataFrame(rows, "key string, left array<string>, right array<string>, final array<string>"))
    per = lambda k: [(r.left_stop, r.right_stop, r.final_stop, r.status, r.source) for r in got.where(F.col("key") == k).orderBy("place").collect()]
    assert per("k") == [("a", "a", "a", "match", "both"), ("b", "b", "b", "match", "both"), ("c", "x", None, "different_stop", "absent"), ("d", "d", "d", "match", "both"), (None, None, "e", "final_only", "neither")]
    assert {x[4] for x in per("same")} == {"both"} and per("none") == [("a", None, None, "left_only", "absent"), ("b", "b", None, "match", "absent")]
    assert E.with_release(["a", None], [None, "b"], ["b"]) == [{"row": 0, "final": None, "source": "absent"}, {"row": 1, "final": 0, "source": "right"}]


def test_evidence_of_findings(baseline):
    t = baseline()
    got = E.finding_evidence("STP006", t["stops"].where("stop_id = 's1'"), t["stops"].where("stop_id = 's2'")).first()
    assert got.distance_m > 10_000 and '"stop_id":"s1"' in got.left
    calls = E.trip_calls(t["stop_times"], t["stops"])
    assert told(E.finding_evidence("TRP102", calls, calls, calls), "left_stop", "final_stop", "source") == [("s1", "s1", "both"), ("s2", "s2", "both")]
    assert told(E.finding_evidence("TRP102", calls, calls.where("false")), "left_stop", "status") == [("s1", "left_only"), ("s2", "left_only")]


def test_parts_of_a_variation(baseline):
    t = baseline()
    named = analyses.named_trips(t)
    v = patterns.variations(named)
    got = E.variation_evidence(t, v, named, "7", "V1", "f")
    assert {n: df.count() for n, df in got.items()} == {"trips": 1, "stop_times": 2, "stops": 3, "shapes": 2, "routes": 1, "calendar": 1, "calendar_dates": 1}
    for bad in ({"variation": "V2"}, {"trip": "zz"}):
        with pytest.raises(ValueError):
            E.variation_evidence(t, v, named, "7", bad.get("variation", "V1"), "f", bad.get("trip"))


def test_routes_of_findings(spark, baseline):
    t = baseline()
    rows = [("x", None, None, '{"route_id":"ctx"}'), ("trips", 2, None, None), ("stop_times", 9, "t1:3", None), ("stop_times", 9, "t1", None), ("routes", None, "r1", None), ("stops", 2, "r1", None), ("stops", 2, None, None)]
    df = spark.createDataFrame([("f", f"R{i}", "error", "c", f, r, k, None, None, c) for i, (f, r, k, c) in enumerate(rows)], ", ".join(f"{c} {'bigint' if c == 'row' else 'string'}" for c in ledger.COLUMNS))
    named = E.routes_of_findings(df, t)
    assert [r.route_id for r in named.orderBy("rule_id").collect()] == ["ctx", "r1", "r1", "r1", "r1", None, None]
    assert told(E.route_health(named, t), "route_id", "findings", "status") == [("r1", 4, "needs_review")]


def test_filters_and_orders(spark, baseline):
    a, b = baseline(), baseline(stops=[("s1", "11", "Other", "45.1", "-75.1", "0", "p1", "2"), ("s2", "12", "Mill", "45.2", "-75.2", "", "", "1")])
    got = analyses.reconcile(a, b)
    from tramline.operators import crosswalk

    pairs = crosswalk.stop_pairs(got["crosswalk"], b["stops"], a["stops"]).cache()
    assert told(E.mapping_filter(pairs.select("source_id", "differs"), "S1", "wheelchair_boarding"), "source_id") == [("s1",)] and E.mapping_filter(pairs, "", "parent_station").count() == 0
    s = E.crosswalk_summary(got["crosswalk"], b["stops"], pairs).first()
    assert (s.stops, s.mapped, s.same_id, s.names_differ, s.differ, s.unmapped) == (2, 2, 2, 1, 1, 0)
    assert told(E.stop_evidence(pairs, b["stops"], a["stops"], ["stop_name"]), "source_id", "source_record", "target_record") == [("s1", '{"stop_name":"Other"}', '{"stop_name":"Quay"}')]
    routes = spark.createDataFrame([("10", "healthy", 1), ("9", "issues", 2), ("8", "healthy", 3)], "route_name string, status string, variations int")
    order = lambda by: [r.route_name for r in routes.orderBy(*E.card_order(by)).collect()]
    assert (order("attention"), order("variations"), order("number")) == (["9", "8", "10"], ["8", "9", "10"], ["8", "9", "10"])
    assert E.status_filter(routes, "issues").count() == 1 and E.status_filter(routes).count() == 3
    f = spark.createDataFrame([("7 ¦ V1 ¦ V2",), ("7 ¦ V1 ¦ V3",)], "key string")
    p = spark.createDataFrame([("7", "V1", "V2"), ("7", "V1", None)], "route_name string, left string, right string")
    assert told(E.affected_pairs(f, p), "key") == [("7 ¦ V1 ¦ V2",)]


def test_report_of_what_a_source_lacks(baseline):
    stops = [(s, "", s, "45", "-75", "", "", "") for s in "abcd"]
    calls = lambda w: [("t1", f"08:{i:02d}:00", f"08:{i:02d}:00", s, str(i + 1), "0", "0", "1") for i, s in enumerate(w)]
    a, b = baseline(stops=stops, stop_times=calls("abcd")), baseline(stops=stops, stop_times=calls("abd"))
    got = analyses.report_sheets(analyses.reconcile(a, b), a, b, "b")
    n = {k: df.count() for k, df in got.items()}
    assert n == {"Report": 6, "Variations": 1, "Routes": 1, "Trips": 1, "Stop times": 4, "Stops": 4, "Shapes": 2, "Services": 2, "Missing items": 1, "Comparisons": 1}


def test_numbers_and_sources_of_patterns(baseline, spark):
    t = baseline()
    named = analyses.named_trips(t).withColumn("_feed", F.lit("a")).unionByName(analyses.named_trips(t).withColumn("_feed", F.lit("final")))
    v = patterns.variations(named)
    assert told(patterns.final_variations(named, v, "a", "b", "final"), "variation", "source") == [("Final V1", "a")]
    assert told(patterns.variation_members(named, v), "_feed", "variation", "trip_id") == [("a", "V1", "t1"), ("final", "V1", "t1")]
    assert told(patterns.journeys_by_variation(named, v, "a", "final"), "_feed", "comparable", "affected") == [("a", 1, 0), ("final", 1, 0)]
    rows = spark.createDataFrame([("r", "b", 5), ("r", "a", 7), ("r", "b", 9)], "route string, k string, _row bigint")
    assert told(patterns.numbered_by_first(rows, ["route"], ["k"], "V"), "k", "variation") == [("a", "V2"), ("b", "V1")]
