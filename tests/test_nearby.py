import math
import random

import pytest

from tramline.operators import nearby
from tramline.operators.nearby import near_pairs, usable_points

SCHEMA = "row_id bigint, stop_id string, stop_lat string, stop_lon string, id string, label int, lat int, lon int, task int"


def metres(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


def found(spark, points, limit=35.0, tasks=None):
    df = spark.createDataFrame([(i, k, f"{la:.7f}", f"{lo:.7f}", "", 0, 0, 0, 0) for i, k, la, lo in points], SCHEMA)
    return sorted((r.a, r.b) for r in near_pairs(usable_points(df, "stop_lat", "stop_lon"), "row_id", "stop_id", limit, tasks).collect())


@pytest.mark.parametrize("tasks, limit", [(1, None), (7, None), (3, 0)])
def test_against_brute_force(spark, tasks, limit, monkeypatch):
    if limit is not None:  # rows of full places too many to broadcast
        monkeypatch.setattr(nearby, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    pts = []
    for i in range(900):
        la, lo = rng.choice([(45.0, -75.0), (-56.32, 179.99995), (-56.32, -179.99995), (89.9995, 10.0), (89.9999, -170.0), (-90.0, 3.0), (0.0, 0.0003)])
        la = max(-90.0, min(90.0, round(la + rng.uniform(-6e-4, 6e-4), 7)))
        lo = round((lo + rng.uniform(-6e-4, 6e-4) + 180) % 360 - 180, 7)
        pts.append((i, f"s{rng.randrange(300)}", la, lo))
    pts += [(1000 + i, *rng.choice(pts[:40])[1:]) for i in range(60)]  # repeated rows
    want = sorted((a[0], b[0]) for n, a in enumerate(pts) for b in pts[n + 1 :] if a[1] != b[1] and metres(a, b) <= 35)
    assert found(spark, pts, tasks=tasks) == want and len(want) > 1000


def test_one_line_of_points_is_cut_along_it(spark):
    pts = [(i, f"k{i}", 45.0, round(-75 + i * 2e-4, 7)) for i in range(500)]
    want = sorted((i, j) for i in range(500) for j in range(i + 1, min(500, i + 4)) if metres(pts[i], pts[j]) <= 35)
    assert found(spark, pts, tasks=16) == want


def test_unusable_and_repeated(spark):
    df = spark.createDataFrame([(1, "a", "45", "-75", "", 0, 0, 0, 0), (2, "b", " 45.0 ", "-75.00", "", 0, 0, 0, 0), (3, "a", "45", "-75", "", 0, 0, 0, 0), (4, "c", "45,0", "-75", "", 0, 0, 0, 0), (5, "c", "NaN", "-75", "", 0, 0, 0, 0), (6, "c", "0", "0.0", "", 0, 0, 0, 0), (7, "c", "0", "0", "", 0, 0, 0, 0), (8, "c", None, None, "", 0, 0, 0, 0), (9, "c", "91", "0", "", 0, 0, 0, 0), (10, None, "45", "-75", "", 0, 0, 0, 0)], SCHEMA)
    pts = usable_points(df, "stop_lat", "stop_lon")
    got = sorted((r.a, r.b) for r in near_pairs(pts, "row_id", "stop_id", 35.0).collect())
    assert got == [(1, 2), (1, 10), (2, 3), (2, 10), (3, 10)]
    assert near_pairs(pts.where("false"), "row_id", "stop_id", 35.0).collect() == []


def test_a_full_place(spark):
    """100,000 rows of one stop at one place make no pairs among themselves, and one each with the other stop there."""
    rows = spark.range(100_000).selectExpr("id", "'s' as k", "45.0D as _lat", "-75.0D as _lon").unionByName(spark.createDataFrame([(100_000, "t", 45.0001, -75.0), (100_001, "u", 46.0, -75.0)], "id bigint, k string, _lat double, _lon double"))
    got = near_pairs(rows, "id", "k", 35.0, 4)
    assert got.count() == 100_000 and got.where("b != 100000").count() == 0 and got.select("a").distinct().count() == 100_000
