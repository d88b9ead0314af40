import random

from pyspark.sql import functions as F

from tramline.operators.copydiff import colour, copy_differences, exact_decimal, latest

SCHEMA = "feed string, k string, a string, b string, c string, loaded_at timestamp, deleted_at timestamp, tab string, copy string, key string, vals string"
FIELDS = {"a": None, "b": exact_decimal, "c": colour}


def norm(f, v):
    from decimal import Decimal

    v = (v or "").strip()
    if f == "b":
        try:
            return Decimal(v)
        except ArithmeticError:
            return v
    return v.removeprefix("#").upper() if f == "c" else v


def test_against_brute_force(spark, day):
    rng = random.Random(5)
    rows = []
    for i in range(2500):
        for feed in ("cad", "hastus"):
            if rng.random() < 0.97:
                rows.append((feed, f"k{i} " if rng.random() < 0.1 else f"k{i}", "x" if rng.random() < 0.98 else rng.choice(["y", None, ""]), rng.choice(["1.50", "+1.5", "01.5"]) if rng.random() < 0.99 else "1.6", rng.choice(["#ffAA00", "FFAA00"]), day(rng.randrange(5)), day(9) if rng.random() < 0.02 else None))
                if rng.random() < 0.1:
                    rows.append((feed, f"k{i}", "older", "2", "", day(-5), None))
    best = {}
    for feed, k, a, b, c, at, gone in rows:
        key = (feed, k.strip())
        if gone is None and (key not in best or best[key][0] <= at):
            best[key] = (at, {"a": norm("a", a), "b": norm("b", b), "c": norm("c", c)})
    want = set()
    for k in {k for _, k in best}:
        l, r = best.get(("cad", k)), best.get(("hastus", k))
        if not l or not r:
            want.add((k, "", "only_cad" if l else "only_hastus"))
        else:
            want |= {(k, f, "differs") for f in FIELDS if l[1][f] != r[1][f]}
    df = spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)
    got = [(r.record_key, r.fld, r.kind) for r in copy_differences(latest(df, "t", "k", FIELDS), {"t": list(FIELDS)}).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_equal_decimals(spark):
    same = ["1.5", "+1.50", "01.500", "1.5000000000000000000000000000"]
    rows = spark.createDataFrame([(v,) for v in [*same, "-0.0", "0", "-1.5", "1e3", "", "007"]], "v string")
    got = [r.x for r in rows.select(exact_decimal(F.col("v")).alias("x")).collect()]
    assert set(got[:4]) == {"1.5"} and got[4:] == ["0", "0", "-1.5", "1e3", "", "7"]


def test_empty_and_one_sided(spark, day):
    none = spark.createDataFrame([], SCHEMA)
    assert copy_differences(latest(none, "t", "k", FIELDS), {"t": list(FIELDS)}).collect() == []
    one = spark.createDataFrame([("cad", "k", "a", "", "", None, None, "", "", "", ""), ("cad", " ", "", "", "", day(1), None, "", "", "", ""), ("final", "z", "", "", "", day(1), None, "", "", "", "")], SCHEMA)
    assert [(r.record_key, r.kind) for r in copy_differences(latest(one, "t", "k", FIELDS), {"t": list(FIELDS)}).collect()] == [("k", "only_cad")]


def test_chunks_are_cut_alike_whatever_the_batches():
    import numpy as np
    import pandas as pd

    from tramline.operators.copydiff import _chunks

    rng = np.random.default_rng(1)
    n = 3000
    rows = pd.DataFrame({"tab": "t", "copy": rng.choice(["a", "b"], n), "key": [f"k{i:05}" for i in range(n)], "kh": rng.integers(-(2**62), 2**62, n), "rh": rng.integers(-(2**62), 2**62, n)})
    whole = pd.concat(_chunks([rows], 3, 16, 40)).sort_values("key", ignore_index=True)
    parts = pd.concat(_chunks([rows[i : i + 7] for i in range(0, n, 7)], 3, 16, 40)).sort_values("key", ignore_index=True)
    pd.testing.assert_frame_equal(whole, parts)
    assert len(whole) == n and whole["size"].max() <= 40 and whole["size"].mean() > 8
