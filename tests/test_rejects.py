import csv
import random

from tramline.operators.rejects import checked_lines, checked_table, loaded_lines, split_table

SCHEMA = "row_id bigint, file_id string, line_number int, line string, names string, cells string, blk int"
HEAD = "trip_id,arrival_time,stop_sequence,note"


def frame(spark, lines, file="f", head=HEAD):
    return spark.createDataFrame([(i, file, i, t, "clash", "", 0) for i, t in enumerate([head, *lines], 1)], SCHEMA)


def reasons(df, **k):
    return {r.row_id: r.reason for r in checked_lines(df, **k).collect()}


def test_reasons(spark):
    lines = {
        't1,08:00:00,1,"a, ""b"" c"': "", '"t1","08:00:00","1",""': "", "t1,,007,\r": "", "t1,123:59:59, 5 ,x": "",
        '"t1,08:00:00,1,x': "quoting", 't1,08:00:00,1,a"b': "quoting", '"t1"x,08:00:00,1,x': "quoting", 't1,"08:00:00" ,1,x': "quoting", '"': "quoting", '"a"b"",,1,': "quoting",
        "t1,08:00:00,1": "columns", "t1,08:00:00,1,x,": "columns", "": "columns", None: "columns",
        "t1,8:0:00,1,x": "value", "t1,08:00:60,1,x": "value", "t1,08:00:00,,x": "value", "t1,08:00:00,-1,x": "value", "t1,08:00:00,1.0,x": "value", 't1,1234:00:00,"1",x': "value",
    }
    got = reasons(frame(spark, list(lines)))
    assert {t: got[i] for i, t in enumerate(lines, 2)} == lines


def test_valid_records_load_as_the_csv_module_reads_them(spark):
    rng = random.Random(3)
    pieces = ['"', '""', ",", "a", "\x01", "\x01a", "é", " ", '"x"']
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(800)]
    rows = checked_lines(frame(spark, lines, head="a,b,c"), fields=[])
    kept = {r.row_id: r.record for r in loaded_lines(rows).collect()}
    bad = {r.row_id: r.reason for r in rows.collect()}
    for i, t in enumerate(lines, 2):
        try:
            want = next(csv.reader([t], strict=True), [""])
        except csv.Error:
            want = None
        if bad[i] == "":
            assert [kept[i][c] for c in "abc"] == want, t
        elif bad[i] == "columns" and want is not None:
            assert len(want or [""]) != 3


def test_headers_blocks_and_hot_files(spark):
    head = '﻿ Stop_Sequence ,"arrival_time"\r'
    df = frame(spark, ["1,08:00:00", "x,08:00:00"] * 50, head=head)
    got = reasons(df, block=7)
    assert got == reasons(df) and sum(r == "value" for r in got.values()) == 50
    lost = spark.createDataFrame([(9, "g", 2, "a,b", "", "", 0), (10, None, 2, "a", "", "", 0), (11, "g", None, "a", "", "", 0)], SCHEMA)
    assert reasons(lost) == {9: "columns"}
    assert reasons(df.where("false")) == {}
    long = frame(spark, ['"' + '""' * 60_000 + '",08:00:00,1,' + "y" * 100_000])
    assert reasons(long) == {2: ""}


def test_dates_and_tables(spark):
    rows = spark.createDataFrame([(1, "20260229"), (2, " 20240229 "), (3, ""), (4, None), (5, "2026010l")], "row_id bigint, start_date string")
    good, bad = split_table(rows, ["start_date"])
    assert [r.row_id for r in good.collect()] == [2] and sorted(r.row_id for r in bad.collect()) == [1, 3, 4, 5]
    assert checked_table(rows.where("false"), ["start_date"]).collect() == []


def test_repeated_names_lose_no_record(spark):
    df = spark.createDataFrame([(1, "f", 1, "trip_id,stop_sequence,stop_sequence,", "", "", 0), (2, "f", 2, "t,1,2,x", "", "", 0), (3, "f", 3, "t,q,2,", "", "", 0)], SCHEMA)
    rows = checked_lines(df)
    assert {r.row_id: r.record for r in loaded_lines(rows).collect()} == {2: {"trip_id": "t", "stop_sequence": "1", "": "x"}}
    assert {r.row_id: r.reason for r in rows.collect()} == {2: "", 3: "value"}
