import datetime as dt

from pyspark.sql import functions as F

from tramline.functions import scalars as S
from tramline.operators import browse
from tramline.operators.patterns import ordered_calls


def values(spark, f, *inputs):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_times_and_dates(spark):
    assert values(spark, S.seconds, "25:01:02", "7:00:00", "007:00:00", "7:0:00", "24:60:00", "", None, "١:00:00") == [90062, 25200, 25200, None, None, None, None, None]
    assert values(spark, S.date_of, "20240229", "20250229", "2026101", "", None) == [dt.date(2024, 2, 29), None, None, None, None]
    friday = lambda v: S.upcoming_friday(v.cast("date"))
    assert values(spark, friday, "2026-01-02", "2026-01-03", "2026-01-01") == [dt.date(2026, 1, 2), dt.date(2026, 1, 9), dt.date(2026, 1, 2)]
    assert values(spark, lambda v: S.add_month(v.cast("date")), "2026-01-31", "2026-12-15") == [dt.date(2026, 2, 28), dt.date(2027, 1, 15)]


def test_texts(spark):
    assert values(spark, S.alnum_name, "  Île-d'Orléans / Quai 3B", "STRASSE ß", "", None) == ["ile d orleans quai 3b", "strasse ss", "", None]
    assert values(spark, S.safe_cell, "=1+1", "  @x", "a=b", "-5", "") == ["'=1+1", "'  @x", "a=b", "'-5", ""]
    assert values(spark, lambda v: S.zero_pad(v, 4), "7", "12345", "") == ["0007", "12345", "0000"]
    names = ["R10", "R9", "R9a10", "R9a9", "A"]
    keys = values(spark, S.natural_key, *names)
    assert [n for _, n in sorted(zip(keys, names))] == ["A", "R9", "R9a9", "R9a10", "R10"]
    ids = spark.createDataFrame([("t1-wk", "wk"), ("t1-wk", ""), ("wk", "wk"), ("t-wk-x", "wk")], "t string, s string")
    assert [r.x for r in ids.select(S.canonical_trip(F.col("t"), F.col("s")).alias("x")).collect()] == ["t1", "t1-wk", "wk", "t-wk-x"]
    order = [r.v for r in spark.createDataFrame([(v,) for v in ["10", "9", "A1", "", "100"]], "v string").orderBy(*S.number_first(F.col("v"))).collect()]
    assert order == ["9", "10", "100", "", "A1"]


def test_distance(spark):
    d = spark.range(1).select(S.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("a"), S.distance_m(F.lit(90.0), F.lit(5.0), F.lit(-90.0), F.lit(5.0)).alias("b"), S.distance_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert abs(d.a - 111194.93) < 0.01 and abs(d.b - 3.141592653589793 * 6_371_000) < 1 and d.c is None


def test_trips_side_by_side(baseline):
    row = lambda s, n, at: ("t1", at, at, s, str(n), "0", "0", "")
    a = ordered_calls(baseline(stop_times=[row("a", 1, "08:00:00"), row("b", 2, "08:05:00"), row("c", 3, "08:09:00")])["stop_times"])
    b = ordered_calls(baseline(stop_times=[row("x", 1, "07:55:00"), row("a", 2, "08:00:00"), row("b", 3, "08:06:00"), row("c", 9, "08:09:00"), row("y", 10, "08:10:00")])["stop_times"])
    got = [(r.left_stop, r.right_stop, r.status, r.fields) for r in browse.side_by_side(a, b).orderBy("row").collect()]
    assert got == [(None, "x", "right_only", []), ("a", "a", "match", []), ("b", "b", "schedule_difference", ["arrival", "departure"]), ("c", "c", "match", []), (None, "y", "right_only", [])]
