import datetime as dt
import random

from tramline.operators.logs import log_entries

SCHEMA = "log_id string, line_number int, message string, loaded_at timestamp, log string, n int, body string"
AT = dt.datetime(2026, 3, 1)


def frame(spark, lines, log="L"):
    return spark.createDataFrame([(log, i, t, AT, "clash", 0, "x") for i, t in enumerate(lines, 1)], SCHEMA)


def test_every_layout(spark):
    cases = {
        "2026-02-10 05:12:50,209 WARNING  Planner - msg": ("2026-02-10 05:12:50", "WARNING", "Planner", "msg"),
        "24/04/2026 01:40:09 - AVERTISSEMENT - o.t.Zip - trop long - oui": ("2026-04-24 01:40:09", "WARNING", "o.t.Zip", "trop long - oui"),
        "[2026-02-13T16:27:42.320Z] [WARN ] [Sync] text": ("2026-02-13 16:27:42", "WARNING", "Sync", "text"),
        "[07/Jan/2026:00:54:41 +0000] Job FATAL: oh: no": ("2026-01-07 00:54:41", "FATAL", "Job", "oh: no"),
        "Feb  5 17:28:38 unit-64 Job[6060]: text": ("2026-02-05 17:28:38", "", "Job", "text"),
        "1773294975.071 E/Sync( 33): text": ("2026-03-12 05:56:15", "ERROR", "Sync", "text"),
        "20260409 201809|D|Planner       |text": ("2026-04-09 20:18:09", "DEBUG", "Planner", "text"),
        "Erreur : text": ("", "ERROR", "", "text"),
        'lvl=err ts=2026-02-20T19:55:08 mod=walk msg="a ts=1 \\" b"': ("2026-02-20 19:55:08", "ERROR", "walk", 'a ts=1 \\" b'),
        '{"msg": "x \\"time\\": 1", "level": "warn", "logger": "m", "time": "2026-06-01T11:54:35+00:00"}': ("2026-06-01 11:54:35", "WARNING", "m", 'x "time": 1'),
    }
    got = {r.first_line: r for r in log_entries(frame(spark, list(cases))).collect()}
    assert len(got) == len(cases)
    for i, want in enumerate(cases.values(), 1):
        assert (got[i].logged_at, got[i].severity, got[i].component, got[i].message) == want


def test_continuations_and_preamble(spark):
    lines = ["# preamble", "", "Error: a", "  Error: indented", "> Error: quoted", "KeyError: 3", '{"level": "info"}', "", None, "Warning: b", " ", ""]
    got = sorted((r.first_line, r.last_line, r.message) for r in log_entries(frame(spark, lines)).collect())
    assert got == [(3, 7, 'a\n  Error: indented\n> Error: quoted\nKeyError: 3\n{"level": "info"}'), (10, 10, "b")]


def test_blocks_agree_with_one_pass(spark):
    rng = random.Random(1)
    lines = [rng.choice(["Error: x", "more", "", "  at y", "more"]) if rng.random() < 0.3 else "more" for _ in range(600)]
    want, first, last = [], None, None
    for i, t in enumerate(lines, 1):
        if t.startswith("Error"):
            if first:
                want.append((first, last))
            first = last = i
        elif first and t.strip():
            last = i
    want.append((first, last))
    for block in (4, 4096):
        for texts in (True, False):
            got = sorted((r.first_line, r.last_line) for r in log_entries(frame(spark, lines), block=block, with_message=texts).collect())
            assert got == want


def test_nulls_empties_and_long_texts(spark):
    rows = [(None, 1, "Error: a", AT, "", 0, ""), ("L", None, "Error: a", AT, "", 0, ""), ("L", 1, "Error: " + "x" * 200_000, None, "", 0, ""), ("L", 2, "\t" + '"' * 50_000, None, "", 0, ""), ("L", 2, "again", None, "", 0, ""), ("L", 3, "ts=2026-01-01T00:00:00 msg=\"" + '\\"' * 30_000, None, "", 0, "")]
    got = sorted((r.first_line, r.last_line) for r in log_entries(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 2), (3, 3)]
    assert log_entries(spark.createDataFrame([], SCHEMA)).collect() == []
