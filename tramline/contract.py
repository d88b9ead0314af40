"""What the tables of a feed must hold. Fixed values of the public schedule format."""

from __future__ import annotations

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

REQUIRED = {
    "agency": ["agency_name", "agency_url", "agency_timezone"],
    "feed_info": ["feed_publisher_name", "feed_publisher_url", "feed_lang"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "trips": ["route_id", "service_id", "trip_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "calendar": ["service_id", *DAYS, "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
}

KEYS = {
    "agency": ["agency_id"],
    "routes": ["route_id"],
    "stops": ["stop_id"],
    "trips": ["trip_id"],
    "stop_times": ["trip_id", "stop_sequence"],
    "calendar": ["service_id"],
    "calendar_dates": ["service_id", "date"],
    "shapes": ["shape_id", "shape_pt_sequence"],
}

#: In the diff of two releases an exception's type is part of its key, and feed_info is keyed by its row.
DIFF_KEYS = KEYS | {"calendar_dates": ["service_id", "date", "exception_type"], "feed_info": ["_row"]}

#: Compared as numbers in the diff.
NUMERIC = ["stop_lat", "stop_lon", "shape_pt_lat", "shape_pt_lon", "shape_dist_traveled", "shape_pt_sequence", "stop_sequence"]

ENUMS = {
    "routes": {"route_type": ["0", "1", "2", "3", "4", "5", "6", "7", "11", "12"], "continuous_pickup": ["0", "1", "2", "3", ""], "continuous_drop_off": ["0", "1", "2", "3", ""]},
    "trips": {"direction_id": ["0", "1", ""], "wheelchair_accessible": ["0", "1", "2", ""], "bikes_allowed": ["0", "1", "2", ""]},
    "stops": {"location_type": ["0", "1", "2", "3", "4", ""], "wheelchair_boarding": ["0", "1", "2", ""]},
    "stop_times": {"pickup_type": ["0", "1", "2", "3", ""], "drop_off_type": ["0", "1", "2", "3", ""], "timepoint": ["0", "1", ""]},
    "calendar": {d: ["0", "1"] for d in DAYS},
    "calendar_dates": {"exception_type": ["1", "2"]},
}

FIELDS = {
    "agency": "agency_id agency_name agency_url agency_timezone agency_lang agency_phone agency_fare_url agency_email".split(),
    "feed_info": "feed_publisher_name feed_publisher_url feed_lang default_lang feed_start_date feed_end_date feed_version feed_contact_email feed_contact_url".split(),
    "routes": "route_id agency_id route_short_name route_long_name route_desc route_type route_url route_color route_text_color route_sort_order continuous_pickup continuous_drop_off network_id".split(),
    "stops": "stop_id stop_code stop_name tts_stop_name stop_desc stop_lat stop_lon zone_id stop_url location_type parent_station stop_timezone wheelchair_boarding level_id platform_code".split(),
    "trips": "route_id service_id trip_id trip_headsign trip_short_name direction_id block_id shape_id wheelchair_accessible bikes_allowed".split(),
    "stop_times": "trip_id arrival_time departure_time stop_id stop_sequence stop_headsign pickup_type drop_off_type shape_dist_traveled timepoint".split(),
    "calendar": ["service_id", *DAYS, "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence shape_dist_traveled".split(),
}

REQUIRED_MEMBERS = ["agency", "routes", "stops", "trips", "stop_times"]
EXPECTED_MEMBERS = ["feed_info", "shapes"]
CALENDARS = ["calendar", "calendar_dates"]

MAX_MEMBER_BYTES = 4 << 30
MAX_TOTAL_BYTES = 12 << 30
MAX_RATIO, RATIO_FROM_BYTES = 250, 10 << 20
FINDINGS_CAP = 10_000
FAR_METRES = {"sources": 35.0, "final": 15.0}
SEVERITIES = ["blocker", "error", "warning", "info"]
