import csv
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.operators import crosswalk, matcher, release
from tramline.plans import analyses
from tramline.sources import sinks
from tramline.sources.policy import DEFAULT

TRIP = "r1 wk t1 Mill 0 g1 1 1".split()
RAIL = {"routes": [("q1", "A", "1", "Rail", "2", "", "")], "trips": [("q1", "rl", "u1-rl", "Top", "0", "h1", "1", "1")], "calendar": [("rl", *"1111100", "20260105", "20260118")], "calendar_dates": [], "shapes": [("h1", "45.10", "-75.100", "1"), ("h1", "45.2", "-75.2", "2")], "stops": [("x1", "", "Top", "45.1", "-75.1", "", "", "1"), ("x2", "", "End", "45.3", "-75.1", "", "", "1")], "stop_times": [("u1-rl", "08:00:00", "08:00:00", "x1", "1", "0", "0", "1"), ("u1-rl", "08:09:00", "08:09:00", "x2", "2", "0", "0", "1")]}


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def calls(*rows):
    return [(t, at, at, stop, n, pickup, "0", "1") for t, at, stop, n, pickup in rows]


def test_a_whole_release(spark, baseline, tmp_path):
    """The other source's metadata, the base's schedule in any order of rows, rail below, and what is to be looked at."""
    base = baseline(trips=[(*TRIP[:3], "Old", *TRIP[4:])], stop_times=calls(("t1", "25:10:00", "s2", "2", "0"), ("t1", "25:00:00", "s1", "1", "0")), calendar_dates=[("wk", "20260107", "2"), ("wk", "20270101", "1")])
    base |= {"custom": base["routes"].select("route_id", "_feed", "_row"), "trips": base["trips"].withColumn("own", F.lit("x"))}
    other = baseline(trips=[(*TRIP[:3], "Far", *TRIP[4:])], stop_times=calls(("t1", "25:00:01", "s1", "1", "0"), ("t1", "25:10:00", "s2", "2", "1")))
    other["stop_times"] = other["stop_times"].withColumn("stop_headsign", F.lit("Far"))
    order = spark.createDataFrame([("7", "20"), ("1", "10")], "route_short_name string, route_sort_order string")
    path = str(tmp_path / "r.zip")
    got = analyses.build(base, other, path, "20260101", "20260131", baseline(**RAIL), None, order, allow_draft=True)
    with zipfile.ZipFile(path) as z:
        t = {n[:-4]: list(csv.DictReader(io.StringIO(z.read(n).decode()))) for n in z.namelist()}
    bus = {r["trip_id"]: r for r in t["trips"]}
    assert set(bus) == {"t1", "u1"} and bus["t1"]["trip_headsign"] == "Far"
    mine = {r["stop_id"]: r for r in t["stop_times"] if r["trip_id"] == "t1"}
    assert {s: (r["pickup_type"], r["departure_time"], r["stop_headsign"]) for s, r in mine.items()} == {"s1": ("0", "25:00:00", "Far"), "s2": ("1", "25:10:00", "Far")}
    rail = [r for r in t["stop_times"] if r["trip_id"] == "u1"]
    assert [r["stop_id"] for r in rail] == ["x1", "x2"] and {r["shape_dist_traveled"] for r in rail} == {"0"}
    assert {p["shape_pt_lat"] for p in t["shapes"] if p["shape_id"] == "h1"} == {"45.1", "45.2"} and {r["stop_id"] for r in t["stops"]} == {"x1", "x2", "s1", "s2", "p1"}
    assert {r["route_short_name"]: r["route_sort_order"] for r in t["routes"]} == {"7": "20", "1": "10"}
    assert [r["date"] for r in t["calendar_dates"]] == ["20260107"] and (t["feed_info"][0]["feed_start_date"], t["feed_info"][0]["feed_end_date"]) == ("20260101", "20260131")
    kinds = {w["kind"]: w["examples"] for w in got["warnings"]}
    assert {"unsupported_table", "unsupported_columns"} <= set(kinds) and not {"unmatched_trip", "rail_not_supplied", "missing_route_sort"} & set(kinds)
    assert got["matched_trips"] == {"timing_anchors": 1} and json.load(open(str(tmp_path / "r.report.json")))["sha256"] == got["sha256"]
    with pytest.raises(FileExistsError):
        analyses.build(base, other, path, "20260101", "20260131")


def test_nothing_is_left_behind(spark, baseline, tmp_path, monkeypatch):
    t = baseline()
    warned = spark.createDataFrame([("unmatched_trip", "base", "t1", "")], release.WARNING)
    matches = spark.createDataFrame([("t1", None, "unmatched")], "trip_id string, candidate string, method string")
    monkeypatch.setattr(release, "assembled", lambda *a: (t, warned, matches))
    monkeypatch.setattr(analyses, "validate", lambda *a: spark.createDataFrame([], "severity string"))
    (tmp_path / "in.zip").write_bytes(b"a")
    build = lambda **k: analyses.build(t, t, str(tmp_path / "r.zip"), "20260101", "20260131", **k)
    with pytest.raises(ValueError, match="unmatched_trip"):
        build()
    with pytest.raises(ValueError, match="window"):
        analyses.build(t, t, str(tmp_path / "r.zip"), "20260201", "20260131")
    real = sinks.write_feed
    monkeypatch.setattr(sinks, "write_feed", lambda *a: (real(*a), (tmp_path / "in.zip").write_bytes(b"b")))
    with pytest.raises(ValueError, match="changed"):
        build(inputs=(str(tmp_path / "in.zip"),), allow_draft=True)
    monkeypatch.setattr(sinks, "write_feed", real)
    monkeypatch.setattr(sinks, "write_once", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        build(allow_draft=True)
    assert sorted(os.listdir(tmp_path)) == ["in.zip"]


def test_what_candidates_agree_on(spark, baseline):
    base = baseline(trips=[("r1", "wk", t, "Own", "0", "g1", "1", "1") for t in ("one", "blank", "two", "none", "like")])
    other = baseline(trips=[("r1", "wk", "a", "New", "0", "g1", "2", "1"), ("r1", "wk", "b", "Else", "0", "g1", "2", "1"), ("r1", "wk", "c", "", "0", "g1", "1", "1")])
    m = spark.createDataFrame([("one", "a", "exact"), ("blank", "c", "exact"), ("two", "a", "exact"), ("two", "b", "exact"), ("none", None, "unmatched"), ("like", "a", matcher.METHODS[3])], "trip_id string, candidate string, method string")
    got, warned = release.enriched_trips(base["trips"].withColumn("block_id", F.lit("B9")), m, other["trips"], ["B9"])
    assert told(got, "trip_id", "trip_headsign", "wheelchair_accessible", "block_id") == [("blank", "", "1", ""), ("like", "New", "2", ""), ("none", "Own", "1", ""), ("one", "New", "2", ""), ("two", "Own", "2", "")]
    assert told(warned, "kind", "key", "detail") == [("conflicting_trip_metadata", "two", "trip_headsign"), ("lower_similarity_trip", "like", ""), ("unmatched_trip", "none", "")]
    assert told(release.warning_groups(warned), "kind", "n")[0] == ("conflicting_trip_metadata", 1)


def test_calls_keep_each_visit_apart(spark, baseline):
    m = spark.createDataFrame([("t", "u", "exact"), ("t", "w", "exact")], "trip_id string, candidate string, method string")
    side = lambda *rows: spark.createDataFrame(rows, "trip_id string, stops array<string>, at array<int>")
    aligned = release.aligned_calls(m, side(("t", list("aba"), [0, 60, 120])), side(("u", list("abxa"), [0, 60, 90, 120]), ("w", list("aba"), [0, 60, 120])), 5)
    assert told(aligned.where("candidate = 'u'"), "place", "other") == [(0, 0), (1, 1), (2, 3)]
    mine = baseline(stop_times=calls(*[("t", "", s, str(n), "0") for n, s in enumerate("aba", 1)]))["stop_times"]
    theirs = baseline(stop_times=calls(("u", "", "a", "1", "1"), ("u", "", "b", "2", "2"), ("u", "", "x", "3", "0"), ("u", "", "a", "9", "3"), ("w", "", "a", "1", "1"), ("w", "", "b", "2", "3"), ("w", "", "a", "3", "3")))["stop_times"].withColumn("stop_headsign", F.lit("H"))
    got, warned = release.enriched_calls(mine, m.select("trip_id"), m, aligned, theirs)
    assert told(got, "stop_sequence", "pickup_type", "stop_headsign") == [("1", "1", "H"), ("2", "0", "H"), ("3", "3", "H")]
    assert told(warned, "key", "detail") == [("t:2", "pickup_type")]


def test_what_stops_a_release(spark, baseline):
    rail = baseline(**RAIL)
    got, renamed, warned = release.rail_trips(rail, baseline()["trips"])
    assert told(got, "trip_id") == [("u1",)] and told(renamed, "_from", "_to") == [("u1-rl", "u1")] and warned.count() == 0
    with pytest.raises(ValueError, match="t1"):
        release.rail_trips(baseline(trips=[("q1", "rl", "t1-rl", "Top", "0", "h1", "1", "1")]), baseline()["trips"])
    assert told(release.rail_trips(baseline(trips=[("q1", "rl", "v", "Top", "0", "h1", "1", "1")]), baseline()["trips"])[2], "kind", "key") == [("rail_trip_id_preserved", "v")]
    with pytest.raises(ValueError, match="wk"):
        release.release_calendar({"base": baseline(), "rail": baseline()}, "20260101", "20260131")
    days, warned = release.release_calendar({"base": baseline()}, "20260201", "20260228")
    assert told(days, "monday", "start_date", "end_date") == [("0", "20260201", "20260228")] and told(warned, "kind") == [("calendar_outside_window",)]
    more = baseline()["routes"].select("route_id", "_feed", "_row")
    check = lambda t, **k: told(release.unsupported(spark, {"base": baseline() | t}, DEFAULT | k), "kind", "key", "detail")
    assert check({"custom": more}) == [("unsupported_table", "custom.txt", "")] and check({}) == []
    with pytest.raises(ValueError, match="frequencies"):
        check({"frequencies": more}, omit_tables=["frequencies.txt"])
    assert check({"frequencies": more.where("false")}, omit_tables=["frequencies.txt"]) == []
    assert check({"frequencies": more}, omit_tables=["frequencies.txt"], allow_omit_nonempty_tables=["frequencies.txt"]) == [("omitted_table", "frequencies.txt", "")]
    rules = {"direction_rules": [{"route_min": 1, "route_max": 9, "keep": ["1"]}]}
    assert release.kept_trips(baseline(), DEFAULT | rules).count() == 0 and release.kept_trips(baseline(), DEFAULT | {"exclude_routes": ["7"]}).count() == 0 and release.kept_trips(baseline(), DEFAULT).count() == 1


def test_stops_and_routes_of_a_release(spark, baseline):
    other = baseline(stops=[("11", "", "Quay New", "40.0", "-70.0", "0", "10", "2"), ("s2", "", "Mill New", "45.2", "-75.2", "", "", ""), ("10", "", "Station New", "1", "1", "1", "", ""), ("zz", "", "Nowhere", "1", "1", "", "", "")], routes=[("x", "B", "7", "Long", "3", "AA", ""), ("y", "C", "7", "Long", "3", "", "")])
    base = baseline(stops=[("s1", "11", "Quay", "45.10", "-75.1", "0", "p1", "1"), ("s2", "12", "Mill", "45.2", "-75.2", "", "", "1"), ("p1", "10", "Quay Station", "45.1", "-75.1", "1", "", "0"), ("s9", "", "Own", "1", "1", "", "", "")])
    walk = crosswalk.crosswalk(other["stops"], base["stops"], ("target_code",), "raise")
    used = spark.createDataFrame([("s1",), ("s9",)], "stop_id string")
    got = release.release_stops(base["stops"], other["stops"], walk, baseline(**RAIL)["stops"], used)
    assert told(got, "stop_id", "stop_name", "stop_lat", "parent_station") == [("p1", "Station New", "45.1", ""), ("s1", "Quay New", "45.1", "p1"), ("s2", "Mill New", "45.2", ""), ("s9", "Own", "1", ""), ("x1", "Top", "45.1", ""), ("x2", "End", "45.3", "")]
    routes, warned = release.enriched_routes(base["routes"], base["trips"].select("route_id"), other["routes"], None)
    assert told(routes, "route_id", "route_long_name", "agency_id", "route_color") == [("r1", "Long", "A", "00AA11")]
    assert told(warned, "kind", "detail") == [("conflicting_route_metadata", "agency_id"), ("conflicting_route_metadata", "route_color"), ("missing_route_sort", "")]
