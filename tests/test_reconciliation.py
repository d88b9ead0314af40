import json

import pytest

from tramline.operators import reconciliation as R
from tramline.operators.crosswalk import crosswalk
from tramline.sources.policy import DEFAULT, identity, kept, load_policy

FINAL = [("s1", "11", "Quay", "45.1", "-75.1", "0", "p1", "1"), ("s2", "12", "Mill Street", "45.3", "-75.2", "", "", "2"), ("zz", "", "New", "1", "1", "", "", "")]


def test_stops_against_a_release(baseline):
    a, f = baseline(), baseline(stops=FINAL)
    got = {(r.key, r.severity) for r in R.stops_missing(a["stops"], a["stop_times"], f["stops"]).collect()}
    assert got == {("p1", "warning")}
    assert [r.key for r in R.stops_of_no_source(f["stops"], [a["stops"]]).collect()] == ["zz"]
    assert {(r.rule_id, r.key, r.observed) for r in R.kept_metadata(f["stops"], [a["stops"]], ["wheelchair_boarding"]).collect()} == {("STP007", "s2", "Mill Street"), ("STP008", "s2", "11,119.5"), ("STP009", "s2", "wheelchair_boarding: 2")}
    walk = crosswalk(a["stops"], f["stops"])
    assert {(r.stop_id, tuple(r.changed)) for r in R.stop_changes(a["stops"], f["stops"], a["stop_times"], walk, ["stop_name"]).collect()} == {("s2", ("stop_name", "stop_lat"))}
    assert R.kept_metadata(f["stops"].where("false"), [a["stops"]], ["stop_code"]).collect() == []


def test_routes_left_out_and_changed(baseline):
    a = baseline(routes=[("r1", "A", "7", "x", "3", "", ""), ("r2", "A", "8", "x", "3", "", "")])
    left = R.without_routes_named(a, baseline()["routes"].select("route_short_name"))
    assert [r.route_id for r in left["routes"].collect()] == ["r2"] and left["trips"].count() == 0
    b = baseline(routes=[("q", "A", "7", "y", "3", "", ""), ("q2", "A", "8", "x", "3", "", "")])
    assert [(r.name, r.changed) for r in R.route_changes(a["routes"], b["routes"], ["route_long_name", "route_type"]).collect()] == [("7", ["route_long_name"])]


def test_pairs_filtered(spark):
    pairs = spark.createDataFrame([("V1", "V1", ["first"]), ("V2", None, []), (None, "V3", [])], "left string, right string, places array<string>")
    count = lambda **k: R.pair_filter(pairs, **k).count()
    assert (count(), count(presence="both"), count(presence="left_only"), count(presence="right_only"), count(places="first"), count(places="last")) == (3, 1, 1, 1, 1, 0)


@pytest.mark.parametrize("change", [{"extra": 1}, {"timing_tolerance_seconds": 61}, {"timing_tolerance_seconds": True}, {"minimum_stop_coverage": 0.5}, {"exclude_routes": [1]}, {"direction_rules": [{"route_min": 5, "route_max": 1, "keep": []}]}])
def test_policies_are_checked(tmp_path, change):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(DEFAULT))
    assert load_policy(str(path)) == DEFAULT
    path.write_text(json.dumps(DEFAULT | change))
    with pytest.raises(ValueError):
        load_policy(str(path))


def test_results_are_kept_by_their_inputs(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    one, made = identity([str(tmp_path / "a")], {"k": 1}), []
    for _ in range(2):
        assert kept(spark, str(tmp_path / "c"), one, lambda: made.append(1) or spark.range(3)).count() == 3
    from tramline.sources.policy import prune

    (tmp_path / "c" / "mine").mkdir()
    assert prune(str(tmp_path / "c"), 1 << 30, 30) == [] and prune(str(tmp_path / "c"), 1 << 30, 30, keep=(one,), reserve=2 << 30) == []
    assert prune(str(tmp_path / "c"), 0, 30) == [one] and (tmp_path / "c" / "mine").exists()
    (tmp_path / "a").write_text("y")
    assert made == [1] and identity([str(tmp_path / "a")], {"k": 1}) != one != identity([str(tmp_path / "a")], {"k": 2})
