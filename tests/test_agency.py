import datetime as dt
from dataclasses import replace

import pytest

from tramline.operators import agency as A
from tramline.operators.profile import FORMATS

DATES = [("2026-03-06", "20260306", "20260406"), ("2026-03-03", "20260306", "20260406"), ("2026-01-30", "20260130", "20260228"), ("2026-12-05", "20261211", "20270111"), ("2024-01-31", "20240202", "20240302")]


@pytest.mark.parametrize("today, start, end", DATES)
def test_dates_expected(today, start, end):
    assert A.expected_dates(dt.date.fromisoformat(today)) == (start, end)


@pytest.mark.parametrize("kind, good, bad", [("language", ["en", "fr-CA", "fra"], ["e", "en-GBR", "en_GB"]), ("phone", ["613 741-4390", "+1 (613) 7", "311"], ["call", "613x"]), ("url", ["http://", "https://a.b"], ["ftp://a", "a.b"]), ("email", ["a@b.c"], ["a@b", "@b.c", "a b@c.d"])])
def test_formats(spark, kind, good, bad):
    rows = spark.createDataFrame([(v,) for v in [*good, *bad]], "v string")
    assert [r.v for r in rows.where(rows.v.rlike(FORMATS[kind])).collect()] == good


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_one_table(spark, baseline):
    t = baseline(agency=[("A", "Line Works", "lines.example", "Mars/Base"), ("A", "", "https://x", "America/Toronto")])
    got = told(A.table_findings(t["agency"], A.PROFILES["agency"]).where("severity != 'info'"), "rule_id", "severity", "observed")
    assert ("AG07", "error", "agency_url: lines.example") in got and ("AG08", "error", "agency_timezone: Mars/Base") in got and ("AG04", "error", "agency_name: ") in got and ("AG05", "error", "2") in got
    assert sum(g[:2] == ("AG02", "warning") for g in got) == 4
    stops = replace(A.PROFILES["stops"], allow={"stop_code": ("p1", "gone")}, empty={"stop_code": ("11",)})
    got = told(A.table_findings(t["stops"], stops).where("severity != 'info'"), "rule_id", "key", "observed")
    assert ("AG19", "gone", "stop_code") in got and ("AG17", "s2", "stop_code: 12") in got and not any(k == "p1" and o == "stop_code: " for _, k, o in got)
    none = A.table_findings(t["stops"].where("false"), stops, feeds=t["stops"].select("_feed").distinct())
    assert ("AG03", None, "no rows") in told(none, "rule_id", "key", "observed")


def test_headers(spark, baseline):
    feeds = baseline()["stops"].select("_feed").distinct()
    got = told(A.header_findings(feeds, "stops", ["a", "", "a"]), "severity", "key", "observed")
    assert got == [("error", "a", "repeated"), ("error", "position 2", "blank name")]
    assert told(A.header_findings(feeds, "stops", []), "observed") == [("no header",)]
    assert A.header_findings(feeds, "stops", ["a"]).collect() == []


def test_window(spark, baseline):
    info = spark.createDataFrame([("f", 2, "20260306", "20260405"), ("f", 3, "x", "y")], "_feed string, _row bigint, feed_start_date string, feed_end_date string")
    assert told(A.window_checks(info, "feed_info", dt.date(2026, 3, 3)), "rule_id", "key", "observed") == [("AG10", "feed_end_date", "20260405")]
    assert told(A.window_checks(baseline()["calendar"], "calendar", dt.date(2026, 3, 3)), "rule_id", "observed") == [("AG11", "end_date: 20260118"), ("AG11", "start_date: 20260105")]


def test_stations(spark):
    rows = [("st", "S", "1", "", ""), ("s2", "S", "1", "st", "9"), ("a", "Quay", "0", "st", "1"), ("b", "Quay Off only", "", "st", ""), ("c", "Mill", "", "st", ""), ("d", "Mill", "", "", "2"), ("e", "x", "", "zz", "1"), ("g", "known", "", "st", ""), ("h", "known", "", "", "3")]
    df = spark.createDataFrame([(*r, "f", i) for i, r in enumerate(rows, 2)], "stop_id string, stop_name string, location_type string, parent_station string, platform_code string, _feed string, _row bigint")
    got = told(A.station_checks(df, ("g",), ("h",)), "severity", "key", "observed")
    assert got == sorted([("error", "s2", "station with parent st"), ("error", "s2", "station with platform 9"), ("info", "b", "no platform, parent st"), ("error", "c", "no platform, parent st"), ("error", "d", "no parent, platform 2"), ("error", "zz", "parent that is no station"), ("info", "g", "no platform, parent st"), ("info", "h", "no parent, platform 3")])
    assert told(A.station_summary(df), "parent", "children", "platforms", "off_only") == [("s2", 0, "", 0), ("st", 5, "1,9", 1)]


def test_all_tables_and_engines(spark, baseline):
    t = baseline()
    got = told(A.agency_findings(t, changes={"stops": {"expected": ()}}).where("rule_id = 'AG01'"), "file", "observed")
    assert got == [("feed_info", "missing")]
    kept = A.agency_report(A.agency_findings(t), 1).collect()
    assert len(kept) == len({(r.feed, r.file, r.severity) for r in kept}) and all(r.total >= 1 for r in kept)
    from tramline.operators import rules

    checks = A.final_checks(t, rules.technical)
    assert set(checks) == {"technical", "agency", "review"} and ("agency", "error") in told(checks["review"], "key", "severity")
    outside = A.final_checks(t, rules.technical, lambda _: rules.technical(t))
    assert "external" in outside and not any(k == "external" for k, _ in told(outside["review"], "key", "severity"))


def test_rows_and_fields_in_messages(spark):
    df = spark.createDataFrame([("stops.txt missing value: stop_id 7, column 'stop_name', row 12.",), ("trips.txt invalid direction_id: x, row 3",), ("nothing",), (None,)], "message string")
    assert [(r.row, r.field) for r in A.located(df).collect()] == [(12, "stop_name"), (3, "direction_id"), (None, None), (None, None)]
