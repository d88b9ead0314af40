import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def day():
    return lambda n, h=0: dt.datetime(2026, 1, 1) + dt.timedelta(days=n, hours=h)


@pytest.fixture(scope="session")
def baseline(spark):
    """One small valid feed: a route, a trip of two calls after midnight, three stops, a service, a shape."""

    def make(**change):
        rows = {
            "agency": ("agency_id agency_name agency_url agency_timezone", [("A", "Line Works", "https://lines.example", "America/Toronto")]),
            "routes": ("route_id agency_id route_short_name route_long_name route_type route_color route_text_color", [("r1", "A", "7", "Quay – Mill", "3", "00AA11", "FFFFFF")]),
            "stops": ("stop_id stop_code stop_name stop_lat stop_lon location_type parent_station wheelchair_boarding", [("s1", "11", "Quay", "45.1", "-75.1", "0", "p1", "1"), ("s2", "12", "Mill", "45.2", "-75.2", "", "", "1"), ("p1", "", "Quay Station", "45.1", "-75.1", "1", "", "0")]),
            "trips": ("route_id service_id trip_id trip_headsign direction_id shape_id wheelchair_accessible bikes_allowed", [("r1", "wk", "t1", "Mill", "0", "g1", "1", "1")]),
            "stop_times": ("trip_id arrival_time departure_time stop_id stop_sequence pickup_type drop_off_type timepoint", [("t1", "25:00:00", "25:00:00", "s1", "1", "0", "0", "1"), ("t1", "25:10:00", "25:10:00", "s2", "2", "0", "0", "1")]),
            "calendar": ("service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date", [("wk", "1", "1", "1", "1", "1", "0", "0", "20260105", "20260118")]),
            "calendar_dates": ("service_id date exception_type", [("wk", "20260107", "2")]),
            "shapes": ("shape_id shape_pt_lat shape_pt_lon shape_pt_sequence", [("g1", "45.1", "-75.1", "1"), ("g1", "45.2", "-75.2", "2")]),
        } | {}
        out = {}
        for name, (cols, data) in rows.items():
            data = change.get(name, data)
            names = cols.split()
            schema = ", ".join(f"{c} string" for c in names) + ", _feed string, _row bigint"
            out[name] = spark.createDataFrame([(*r, "f", i) for i, r in enumerate(data, 2)], schema).coalesce(1)
        return out

    return make
