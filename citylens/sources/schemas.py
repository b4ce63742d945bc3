"""Declared feed schemas, unique keys and time columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


SCALARS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def schema(columns: str) -> T.StructType:
    """``"name type, name type"`` of scalar columns as a schema; needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, SCALARS[kind]) for name, kind in pairs])


# Column names and order of the published feeds.
STOP_RIDERSHIP = schema(
    "Route_ID string, Stop_ID string, Stop_Name string, Route_Stop_Order int, "
    "Weekday_Ons int, Weekday_Offs int, Weekday_Leave_Load int, "
    "Saturday_Ons int, Saturday_Offs int, Saturday_Leave_Load int, "
    "Sunday_Ons int, Sunday_Offs int, Sunday_Leave_Load int, "
    "Direction string, Borough string, Latitude double, Longitude double"
)

BIKE_TRIP_NAMES = [
    "ride_id", "rideable_type", "start_time", "end_time", "start_name", "start_id", "end_name", "end_id",
    "start_lat", "start_long", "end_lat", "end_long", "rider_type",
]
BIKE_TRIP = schema(
    "ride_id string, rideable_type string, start_time timestamp, end_time timestamp, start_name string, "
    "start_id string, end_name string, end_id string, start_lat double, start_long double, "
    "end_lat double, end_long double, rider_type string"
)


@dataclass(frozen=True)
class Feed:
    """A keyed, append-only feed: its table schema, unique key and time column."""

    schema: T.StructType
    key: tuple[str, ...]
    time: str


FEEDS = {
    "mta_bridge_traffic": Feed(
        schema(
            "transit_timestamp timestamp, date date, hour int, facility_id string, facility string, direction string, "
            "payment_method string, vehicle_class int, vehicle_class_description string, "
            "vehicle_class_category string, traffic_count int"
        ),
        ("transit_timestamp", "facility", "direction", "payment_method", "vehicle_class"),
        "transit_timestamp",
    ),
    "mta_subway_ridership": Feed(
        schema(
            "transit_timestamp timestamp, transit_mode string, station_complex_id string, station_complex string, "
            "borough string, payment_method string, fare_class_category string, ridership double, transfers double, "
            "latitude double, longitude double, georeference string"
        ),
        ("transit_timestamp", "station_complex_id", "transit_mode", "payment_method", "fare_class_category"),
        "transit_timestamp",
    ),
    "cbd_entries": Feed(
        schema(
            "toll_date timestamp, toll_hour timestamp, toll_10_minute_block timestamp, minute_of_hour double, "
            "hour_of_day double, day_of_week_int double, day_of_week string, toll_week timestamp, time_period string, "
            "vehicle_class string, detection_group string, detection_region string, crz_entries double, "
            "excluded_roadway_entries double"
        ),
        ("toll_10_minute_block", "vehicle_class", "detection_group", "detection_region"),
        "toll_10_minute_block",
    ),
    "mta_overall_ridership_traffic": Feed(
        schema("date timestamp, mode string, count double"), ("date", "mode"), "date"
    ),
    "mta_subway_otp": Feed(
        schema(
            "month timestamp, division string, line string, day_type double, num_on_time_trips double, "
            "num_sched_trips double, terminal_on_time_performance double"
        ),
        ("month", "division", "line", "day_type"),
        "month",
    ),
}
# End of fixed values.
