import random

import pytest

from tramline.operators import references as R

CHILD = "row_id bigint, feed string, trip_id string, stop_id string, loaded_at timestamp, tab string, key string, ptab string"
PARENT = "feed string, stop_id string, trip_id string, loaded_at timestamp, deleted_at timestamp, born int, gone int"


def brute(children, parents):
    out = set()
    for row, feed, trip, stop, at in children:
        for fld, ref in (("trip_id", trip), ("stop_id", stop)):
            ref = (ref or "").strip()
            if not ref:
                continue
            ps = [p for p in parents if p[0] == feed and (p[2] if fld == "trip_id" else p[1]) and (p[2] if fld == "trip_id" else p[1]).strip() == ref]
            if any(p[3] <= at and (p[4] is None or p[4] > at) for p in ps):
                continue
            out.add((fld, row, "missing" if not ps else "late" if all(p[3] > at for p in ps) else "deleted"))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, day, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(R, "maybe_broadcast", lambda df, n: (df, False))
    rng = random.Random(2)
    ids = [f"k{i}" for i in range(12)]
    parents = [(rng.choice("ab"), rng.choice(ids) if rng.random() < 0.5 else None, rng.choice(ids) + " ", day(rng.randrange(20), rng.randrange(24)), day(rng.randrange(25), 3) if rng.random() < 0.6 else None) for _ in range(60)]
    children = [(i, rng.choice("ab"), rng.choice([None, "", " ", "K1", *ids, "k1"]), rng.choice(["k2", *ids]), day(rng.randrange(25), rng.randrange(24))) for i in range(3000)]
    kids = spark.createDataFrame([(*c, "", "", "") for c in children], CHILD)
    held = spark.createDataFrame([(*p, 0, 0) for p in parents], PARENT)
    refs = R.references(kids, "stop_times", {"trip_id": "trips", "stop_id": "stops"})
    live = R.parents(held, "trips", "trip_id").unionByName(R.parents(held, "stops", "stop_id"))
    got = [(r.fld, r.row_id, r.reason) for r in R.orphan_references(refs, live).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(children, parents)
    counts = R.orphan_counts(refs, R.orphan_references(refs, live))
    assert sum(r.n for r in counts.collect()) == len(got)


def test_nulls_and_empty_tables(spark, day):
    kids = spark.createDataFrame([(1, None, "x", None, None, "", "", ""), (2, "a", None, None, day(1), "", "", "")], CHILD)
    none = spark.createDataFrame([], PARENT)
    refs = R.references(kids, "t", {"trip_id": "trips"})
    assert [(r.row_id, r.reason) for r in R.orphan_references(refs, R.parents(none, "trips", "trip_id")).collect()] == [(1, "missing")]
    held = spark.createDataFrame([(None, None, "x", None, None, 0, 0)], PARENT)
    assert R.orphan_references(refs, R.parents(held, "trips", "trip_id")).collect() == []
    assert R.orphan_references(refs.where("false"), R.parents(held, "trips", "trip_id")).collect() == []


def test_spans_of_any_length_and_number(spark, day):
    """A parent without loaded_at that was withdrawn, and thousands of overlapping spans on one key."""
    import datetime as dt

    kids = spark.createDataFrame([(i, "a", "x", "y", day(i % 300, i % 24), "", "", "") for i in range(2000)] + [(9000, "a", "x", "z", None, "", "", "")], CHILD)
    held = spark.createDataFrame([("a", None, "x", None, day(100), 0, 0), *[("a", "y", None, day(n % 250) + dt.timedelta(seconds=n), day(n % 250 + 2), 0, 0) for n in range(3000)], ("a", "z", None, day(1), day(2), 0, 0)], PARENT)
    refs = R.references(kids, "t", {"trip_id": "trips", "stop_id": "stops"})
    found = R.orphan_references(refs, R.parents(held, "trips", "trip_id").unionByName(R.parents(held, "stops", "stop_id"))).collect()
    got = {(r.fld, r.row_id): r.reason for r in found}
    assert len(got) == len(found)
    for i in range(2000):
        at = day(i % 300, i % 24)
        assert got.get(("trip_id", i)) == (None if at < day(100) else "deleted")
        live = any(day(b) + dt.timedelta(seconds=n) <= at < day(b + 2) for b in range(max(0, i % 300 - 3), min(250, i % 300 + 1)) for n in (b, b + 250 * 11))
        assert (got.get(("stop_id", i)) is None) == live
    assert got["trip_id", 9000] == "deleted" and got["stop_id", 9000] == "deleted"
