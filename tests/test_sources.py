import csv
import io
import json
import zipfile

import pytest

from tramline import __main__ as cli
from tramline.operators import browse
from tramline.plans import analyses
from tramline.sources import feed, sinks
from tramline.streaming.watch import watch


def write_zip(path, tables, mode=0o100644, raw=None):
    with zipfile.ZipFile(path, "w") as z:
        for name, df in tables.items():
            cols = [c for c in df.columns if c[0] != "_"]
            out = io.StringIO()
            w = csv.writer(out)
            w.writerow(cols)
            w.writerows([[r[c] for c in cols] for r in df.orderBy("_row").collect()])
            info = zipfile.ZipInfo(f"{name}.txt")
            info.external_attr = mode << 16 or 0x20
            z.writestr(info, out.getvalue())
        for name, text in (raw or {}).items():
            info = zipfile.ZipInfo(name)
            info.external_attr = mode << 16
            z.writestr(info, text)
    return str(path)


@pytest.fixture
def good(tmp_path, baseline):
    t = baseline() | {"feed_info": baseline()["agency"].selectExpr("'Line Works' feed_publisher_name", "'https://x' feed_publisher_url", "'en' feed_lang", "_feed", "_row")}
    return write_zip(tmp_path / "good.zip", t), t


def rules_of(df):
    return sorted({r.rule_id for r in df.collect()})


def test_a_sound_archive(spark, good):
    assert rules_of(analyses.validate(spark, good[0])) == []


def test_optional_tables_may_be_missing_from_an_inspected_archive(spark, tmp_path, baseline):
    t = baseline(stops=[("s1", "11", "", "45.1", "-75.1", "0", "", "1"), ("s2", "12", "Mill", "45.2", "-75.2", "", "", "1")], calendar_dates=[("wk", "20260107", "1")])
    for i, gone in enumerate((["calendar"], ["calendar", "shapes"], ["shapes"], ["calendar", "calendar_dates"])):
        path = write_zip(tmp_path / f"{i}.zip", {k: v for k, v in t.items() if k not in gone})
        got = [r for r in rules_of(analyses.validate(spark, path)) if r.startswith("INS")]
        assert "INS002" in got and ("INS014" in got) == ("calendar_dates" in gone)


@pytest.mark.parametrize("mode, want", [(0o100600, ["PKG009"]), (0, ["PKG018"]), (0o100666, [])])
def test_member_modes(spark, tmp_path, good, mode, want):
    assert rules_of(feed.package_findings(spark, feed.members(spark, write_zip(tmp_path / "m.zip", good[1], mode), "f"))) == want


def test_odd_packages(spark, tmp_path, good):
    t = {k: v for k, v in good[1].items() if k not in ("trips", "calendar", "calendar_dates", "shapes")}
    path = write_zip(tmp_path / "odd.zip", t, raw={"sub/trips.txt": "x", "notes.pdf": "x"})
    assert rules_of(feed.package_findings(spark, feed.members(spark, path, "f"))) == ["PKG003", "PKG012", "PKG013", "PKG014", "PKG017"]
    (tmp_path / "not.zip").write_bytes(b"no archive")
    assert "PKG001" in rules_of(analyses.validate(spark, str(tmp_path / "not.zip")))
    assert feed.unsafe_name("../x") and feed.unsafe_name("/x") and feed.unsafe_name("C:x") and not feed.unsafe_name("trips.txt")


def test_structure(spark, tmp_path):
    raw = {"stops.txt": "﻿stop_id, stop_name,stop_lat,stop_lat,,x\r\na,\"q, \"\"r\"\"\",1,2,,\r\n\r\nb,c\r\nd,e,1,2,3,4,5\r\n", "routes.txt": "route_id,route_short_name,route_long_name,route_type\n", "trips.txt": b"route_id,service_id,trip_id\n\xff,1,2\n", "calendar_dates.txt": "service_id,date,exception_type\n"}
    rows = feed.records(spark, write_zip(tmp_path / "s.zip", {}, raw=raw), "f")
    got = {(r.rule_id, r.file, r.row) for r in feed.structure_findings(spark, rows).collect()}
    assert {("CSV003", "stops", None), ("CSV004", "stops", None), ("CSV005", "stops", None), ("CSV006", "stops", 3), ("CSV006", "stops", 4), ("CSV006", "stops", 5), ("CSV007", "routes", None)} <= got
    assert any(r == "CSV002" and f == "trips" for r, f, _ in got)
    assert {r.severity for r in feed.structure_findings(spark, rows).where("rule_id = 'CSV007' and file = 'calendar_dates'").collect()} == {"info"}
    t = feed.tables(rows)
    assert [(r._row, r.stop_id, r.stop_name, r.stop_lat, r.stop_lon) for r in t["stops"].orderBy("_row").collect()] == [(2, "a", 'q, "r"', "1", ""), (3, "", "", "", ""), (4, "b", "c", "", ""), (5, "d", "e", "1", "")]
    with pytest.raises(ValueError):
        feed.strict_tables(spark, str(tmp_path / "s.zip"), "f")


def test_written_archives_are_the_same_and_compare_equal(spark, tmp_path, good):
    t = good[1]
    one, two = str(tmp_path / "1.zip"), str(tmp_path / "2.zip")
    for p in (one, two):
        sinks.write_feed(t, p)
    assert feed.digest(one) == feed.digest(two)
    with pytest.raises(FileExistsError):
        sinks.write_feed(t, one)
    a, b = analyses.load(spark, one, "a", True), analyses.load(spark, good[0], "b")
    assert all(d.isEmpty() for d in analyses.compare(a, b).values())
    sinks.verify_feed(one)


def test_headers_go_by_their_file(spark, tmp_path):
    one = write_zip(tmp_path / "h1.zip", {}, raw={"stops.txt": "stop_id,stop_name,stop_lat,stop_lon,own\na,Quay,1,2,x\n", "routes.txt": ""})
    write_zip(tmp_path / "h2.zip", {}, raw={"stops.txt": "stop_name,stop_id,stop_lon,stop_lat\nMill,b,4,3\n"})
    rows = feed.records(spark, str(tmp_path / "h*.zip"), "f")
    got = {r.stop_id: (r.stop_name, r.stop_lat, r.stop_lon, r.own) for r in feed.tables(rows)["stops"].collect()}
    assert got == {"a": ("Quay", "1", "2", "x"), "b": ("Mill", "3", "4", "")}
    assert [(r.rule_id, r.file) for r in feed.structure_findings(spark, feed.records(spark, one, "f")).collect() if r.rule_id == "CSV001"] == [("CSV001", "routes")]


@pytest.mark.parametrize("raw", ["trip_id,route_id,service_id\nt,r,s\nt,r,s\n", "trip_id,trip_id,route_id,service_id\n", "trip_id,,route_id,service_id\n", "trip_id,route_id,service_id\nt,r,s,x\n", ""])
def test_strict_sources_stop(spark, tmp_path, raw):
    path = write_zip(tmp_path / "s.zip", {}, raw={"trips.txt": raw})
    with pytest.raises(ValueError, match="trips"):
        feed.strict_tables(spark, path, "f")


def test_bundles_that_cannot_be_used(spark, tmp_path, good):
    whole = {n: df for n, df in good[1].items()}
    (tmp_path / "no.zip").write_bytes(b"x")
    bad = {"MRG001": str(tmp_path / "none.zip"), "MRG002": str(tmp_path / "no.zip"), "MRG003": write_zip(tmp_path / "a.zip", whole, raw={"x/y.txt": "1"}), "MRG004": write_zip(tmp_path / "b.zip", {n: df for n, df in whole.items() if n != "stops"}), "MRG006": write_zip(tmp_path / "c.zip", {n: df for n, df in whole.items() if n != "stops"}, raw={"stops.txt": b"stop_id\n\xff\n"})}
    for rule, path in bad.items():
        t, told = analyses.load_bundle(spark, path, "a")
        assert t is None and [r.rule_id for r in told.collect()] == [rule]
    broken = tmp_path / "d.zip"
    raw = bytearray(open(write_zip(broken, whole), "rb").read())
    raw[60:70] = b"\x00" * 10
    broken.write_bytes(raw)
    assert [r.rule_id for r in analyses.load_bundle(spark, str(broken), "a")[1].collect()] in (["MRG005"], ["MRG002"])
    t, told = analyses.load_bundle(spark, good[0], "a")
    assert {"stops", "trips"} <= set(t) and told.collect() == []
    assert [r.rule_id for r in analyses.validate(spark, str(tmp_path / "none.zip")).collect()] == ["RUN001"]


def test_reports(spark, tmp_path, good, baseline):
    bad = analyses.validate(spark, write_zip(tmp_path / "bad.zip", baseline(trips=[("r1", "wk", "t1", "=cmd", "0", "g1", "1", "1"), ("r1", "zz", "=t2", "x", "0", "", "1", "1")])))
    body = sinks.report_json(bad, str(tmp_path / "r.json"))
    read = json.load(open(tmp_path / "r.json"))
    assert len(read["findings"]) == bad.count() and read["decisions"] == body["decisions"] and body["decisions"][0]["blockers"] == 0
    assert len(json.load(open(tmp_path / "r.json"))["findings"][0]) == 10
    few = sinks.report_json(bad, str(tmp_path / "few.json"), 1)
    assert few["suppressed_findings"] == bad.count() - 1 and len(json.load(open(tmp_path / "few.json"))["findings"]) == 1
    sinks.findings_sheet(bad, str(tmp_path / "f.csv"))
    assert (tmp_path / "f.csv").read_bytes().startswith(b"\xef\xbb\xbffeed,rule_id") and "'=t2" in (tmp_path / "f.csv").read_text()
    sinks.export_csv(spark.createDataFrame([("=1", None)], "`a.b` string, n int"), str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_text().splitlines() == ["a.b,n", "'=1,"]
    sinks.write_once({"a": 1}, str(tmp_path / "once.json"))
    with pytest.raises(FileExistsError):
        sinks.write_once({"a": 2}, str(tmp_path / "once.json"))
    sinks.notices_html([{"code": "<x>", "severity": "ERROR", "totalNotices": 2, "sampleNotices": [{"row": 1}]}], str(tmp_path / "n.html"), "N")
    assert "&lt;x&gt; (2)" in (tmp_path / "n.html").read_text()
    history = sinks.BuildHistory(str(tmp_path / "builds"), lines=2, builds=2)
    for i in range(3):
        history.save(f"b{i}", {"id": i, "log": list("abc")})
    assert [h["id"] for h in history.all()] == [2, 1] and history.all()[0]["log"] == ["b", "c"]
    sinks.findings_csv(bad, str(tmp_path / "csv"))
    assert "'=t2" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    odd = spark.createDataFrame([("a\x01<&>", None), ("x" * 32_767, 2)], "text string, n int")
    sinks.write_xlsx({"One": odd, "Two": bad}, str(tmp_path / "b.xlsx"))
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        from xml.dom.minidom import parseString

        assert z.testzip() is None and len(z.namelist()) == 6
        cells = [t.firstChild.data if t.firstChild else "" for t in parseString(z.read("xl/worksheets/sheet1.xml")).getElementsByTagName("t")]
        assert cells[:4] == ["text", "n", "a<&>", ""] and len(cells[4]) == 32_767
    with pytest.raises(ValueError, match="A2"):
        sinks.write_xlsx({"One": spark.createDataFrame([("x" * 32_768,)], "text string")}, str(tmp_path / "long.xlsx"))
    assert sinks.LETTERS[0] == "A" and sinks.LETTERS[26] == "AA" and sinks.LETTERS[701] == "ZZ"
    sinks.write_html({"One": odd}, str(tmp_path / "r.html"), "A & B")
    assert "A &amp; B" in (tmp_path / "r.html").read_text()


def test_logs_in_several_encodings(spark, tmp_path):
    text = "Erreur : été\nfin"
    for name, raw in {"u16": text.encode("utf-16"), "u8": b"\xef\xbb\xbf" + text.encode(), "w": text.encode("cp1252"), "lost": b"\x81\xff"}.items():
        (tmp_path / f"{name}.log").write_bytes(raw)
    got = {(r.path.rsplit("/", 1)[-1], r.line_number): (r.message, r.encoding) for r in feed.log_lines(spark, str(tmp_path / "*.log")).collect()}
    assert [got[f"{n}.log", 1] for n in ("u16", "u8", "w")] == [("Erreur : été", e) for e in ("utf-16", "utf-8-sig", "cp1252")] and got["u8.log", 2][0] == "fin" and "losses" in got["lost.log", 1][1]


@pytest.mark.parametrize("wrap", ["{}", '"{}"', "'{}'", "“{}”", '  "{}"  '])
def test_pasted_paths(wrap):
    assert feed.plain_path(wrap.format("C:\\Agency's files\\Final.zip")) == "C:\\Agency's files\\Final.zip"
    assert feed.plain_path('""') == feed.plain_path(None) == ""


def test_browsing(spark, baseline):
    t = baseline()
    got, more = browse.page(t["stop_times"], 2, 1)
    assert [r._row for r in got.collect()] == [2] and more and not browse.page(t["stop_times"], 3, 500)[1]
    assert browse.lookup(t["stops"], "stop_id", spark.createDataFrame([("s1",), ("s1",)], "v string")).count() == 1
    assert [r.stop_name for r in browse.trip_detail(t["stop_times"], t["stops"], "f", "t1").collect()] == ["Quay", "Mill"]
    assert [(r.stops, r.trips) for r in browse.route_detail(t["trips"], t["stop_times"], "f", "r1").collect()] == [("s1>s2", 1)]
    assert browse.search(t["stops"], ["stop_name"], "QUAY").count() == 2


def test_new_archives_are_checked_once(spark, tmp_path, baseline, good):
    (tmp_path / "in").mkdir()
    write_zip(tmp_path / "in" / "x.zip", baseline(trips=[("zz", "wk", "t1", "Mill", "0", "g1", "1", "1")]))
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "found"), str(tmp_path / "state"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "found")).collect()
    assert [r.feed for r in got if r.rule_id == "REL007"] == ["x.zip"]


def test_command_line(spark, tmp_path, good, baseline, capsys):
    bad = write_zip(tmp_path / "bad.zip", baseline(trips=[("zz", "wk", "t1", "Mill", "0", "g1", "1", "1")]))
    assert cli.main(["validate", good[0], str(tmp_path / "r.json")]) == 0 and cli.main(["validate", bad]) in (1, 2)
    assert cli.main(["compare", good[0], good[0]]) == 0 and cli.main(["compare", good[0], bad]) == 1
    assert cli.main(["reconcile", good[0], good[0], str(tmp_path / "b.xlsx")]) == 0 and cli.main(["audit", good[0], good[0]]) == 0
    assert cli.main(["nothing"]) == 2
