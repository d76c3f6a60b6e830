"""Tables of the engine, as DDL that Spark parses."""

from pyspark.sql.types import StructType

#: The value of a reading comes as it stands in the message, so that null, text, numbers and true stay apart.
READING = "struct<meter_id:string,household_id:string,reading_time:string,kwh:variant,received_at:string>"
DELIVERY = f"delivery_id string, source string, ingest_time string, readings array<{READING}>"
#: What does not parse lands in `corrupt`.
DELIVERY_WITH_CORRUPT = f"{DELIVERY}, corrupt string"

TABLES = {
    "homes": "household_id string, meter_id string, postcode_area string, household_size int, acorn_group string, tariff_type string",
    "weather_hourly": "observed_at timestamp, station string, temp_c double, report_type string",
    "clean_readings": "meter_id string, reading_time timestamp, household_id string, kwh double, received_at timestamp, ingested_at timestamp",
    "meter_corrections_log": "meter_id string, reading_time timestamp, old_kwh double, new_kwh double, delta double, corrected_at timestamp",
    "rejected_readings": "id long, delivery_id string, meter_id string, reading_time timestamp, kwh double, kwh_raw string, received_at timestamp, "
    "rejection_type string, rejection_detail string, source string, rejected_at timestamp, archived boolean",
    "batch_log": "delivery_id string, source string, received_at timestamp, reading_count int, status string, logged_at timestamp",
    "batch_duplicates": "delivery_id string, detected_at timestamp, source string, reading_count int",
    "dead_letters": "value string, lane int, seen_at timestamp",
    "live_window": "window_start timestamp, kwh double, meters long, forecast double, updated_at timestamp",
    "live_meters": "window_start timestamp, meter_id string, kwh decimal(38,9)",
    "meter_sketches": "window_start timestamp, sketch binary",
    "live_counters": "kind string, first_at timestamp, last_at timestamp, n long",
    "feed_status": "source string, status string, at timestamp",
    "stream_progress": "name string, query string, batch long, rows long, seconds double, at timestamp",
    "meter_silence_log": "meter_id string, postcode_area string, last_seen timestamp, silent_hours double, detected_at timestamp",
    "orphan_meters_summary": "meter_id string, first_seen timestamp, last_seen timestamp, reading_count long, total_kwh double",
    "meter_lag_stats": "meter_id string, avg_lag_sec double, p95_lag_sec double, max_lag_sec double, updated_at timestamp",
    "rejection_hourly_summary": "ts_hour timestamp, rejection_reason string, count long",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
