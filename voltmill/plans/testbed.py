"""Telemetry tables derived from the star-schema test tables, in Spark and in DuckDB SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: 0-2 hours late, one in four of the backfill lane, batches of EPOCH_ROWS in order of id."""
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("meter_id"),
        F.concat(F.lit("H"), F.col("user_id")).alias("household_id"),
        at.alias("reading_time"),
        F.col("value").alias("kwh"),
        (at + F.make_interval(secs=(F.col("event_id") % 7200).cast("decimal(18,6)"))).alias("received_at"),
        F.when(F.col("event_id") % 4 == 0, "backfill").otherwise("live").alias("source"),
        F.floor(F.col("event_id") / EPOCH_ROWS).alias("batch"),
        "event_type",
    )


READINGS = f"""readings AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS meter_id, 'H' || user_id AS household_id, ts AS reading_time, value AS kwh,
         ts + to_seconds(event_id % 7200) AS received_at, CASE WHEN event_id % 4 = 0 THEN 'backfill' ELSE 'live' END AS source,
         event_id // {EPOCH_ROWS} AS batch, event_type
  FROM events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings within the valid range, as the fact table holds them."""
    return readings(spark, sf_dir).filter((F.col("kwh") >= 0) & (F.col("kwh") <= 50))


FACTS = READINGS + ",\nfacts AS (SELECT * FROM readings WHERE kwh BETWEEN 0 AND 50)"


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as homes; one in ten is left out, so that its readings are orphans."""
    c, n = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 10 != 3), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("H"), F.col("c_custkey")).alias("household_id"),
        F.col("c_custkey").cast("string").alias("meter_id"),
        F.col("n_name").alias("postcode_area"),
        (F.col("c_custkey") % 5 + 1).cast("int").alias("household_size"),
        F.col("c_mktsegment").alias("acorn_group"),
        F.when(F.col("c_custkey") % 5 == 0, "ToU").otherwise("Std").alias("tariff_type"),
    )


HOMES = """homes AS (
  SELECT 'H' || c_custkey AS household_id, CAST(c_custkey AS VARCHAR) AS meter_id, n_name AS postcode_area,
         CAST(c_custkey % 5 + 1 AS INTEGER) AS household_size, c_mktsegment AS acorn_group,
         CASE WHEN c_custkey % 5 = 0 THEN 'ToU' ELSE 'Std' END AS tariff_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 3)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as weather reports; the best type is one in three."""
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return e.select(F.col("ts").cast("timestamp").alias("observed_at"), F.col("value").alias("temp_c"), F.when(F.col("event_id") % 3 == 0, "FM-12").otherwise("FM-15").alias("report_type"), F.col("event_id").alias("file_order"))


WEATHER = """weather AS (
  SELECT ts AS observed_at, value AS temp_c, CASE WHEN event_id % 3 = 0 THEN 'FM-12' ELSE 'FM-15' END AS report_type, event_id AS file_order
  FROM events WHERE event_type = 'view')"""


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text, with each kind of fault in turn; half of the words `true` are booleans."""
    k = F.col("event_id") % 11
    number = F.col("kwh").cast("string")
    return readings(spark, sf_dir).select(
        "event_id", "meter_id", "household_id", "source", F.lit("d").alias("delivery_id"),
        F.when(k == 2, "not-a-timestamp").otherwise(F.date_format("reading_time", "yyyy-MM-dd'T'HH:mm:ss")).alias("reading_time"),
        F.when(k == 0, F.lit(None)).when(k == 1, "abc").when(k == 3, "NaN").when(k == 4, "true").when(k == 5, F.concat(F.lit("-"), number)).otherwise(number).alias("kwh"),
        ((k == 4) & (F.col("event_id") % 2 == 0)).alias("kwh_boolean"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss").alias("received_at"),
    )


RAW = (
    READINGS
    + """,
raw AS (
  SELECT event_id, meter_id, source, CASE WHEN event_id % 11 = 2 THEN NULL ELSE date_trunc('second', reading_time) END AS reading_time,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN 'abc' WHEN event_id % 11 = 3 THEN 'NaN' WHEN event_id % 11 = 4 THEN 'true'
              WHEN event_id % 11 = 5 THEN '-' || CAST(kwh AS VARCHAR) ELSE CAST(kwh AS VARCHAR) END AS raw
  FROM readings),
checked AS (
  SELECT *, CASE WHEN raw = 'true' AND event_id % 2 = 0 THEN 1.0 WHEN raw = 'NaN' THEN 'NaN'::DOUBLE ELSE TRY_CAST(raw AS DOUBLE) END AS kwh FROM raw),
validated AS (
  SELECT *, CASE WHEN reading_time IS NULL THEN 'invalid_reading_time' WHEN kwh IS NULL THEN 'missing_kwh'
                 WHEN isnan(kwh) OR kwh < 0 OR kwh > 50 THEN 'kwh_out_of_range' END AS rejection_type,
            CASE WHEN reading_time IS NULL THEN 'reading_time absent or unparseable' WHEN raw IS NULL THEN 'kwh is null'
                 WHEN kwh IS NULL THEN 'kwh=''' || raw || ''' not numeric'
                 WHEN isnan(kwh) THEN 'kwh=nan, expected [0.0,50.0]'
                 WHEN kwh < 0 OR kwh > 50 THEN 'kwh=' || CAST(kwh AS VARCHAR) || ', expected [0.0,50.0]' END AS rejection_detail
  FROM checked)"""
)


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects of the raw readings, rejected an hour to ten days after the last reading's month began, some archived."""
    from voltmill.operators.ingest import validate

    v = validate(raw_readings(spark, sf_dir)).filter("rejection_type is not null")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_interval(hours=(F.col("event_id") % 240).cast("int"))
    return v.select(F.col("event_id").alias("id"), "meter_id", "reading_time", "rejection_type", at.alias("rejected_at"), (F.col("event_id") % 13 == 0).alias("archived"))


REJECTS = (
    RAW
    + """,
rejects AS (
  SELECT event_id AS id, meter_id, reading_time, rejection_type, TIMESTAMP '2024-02-01' + to_hours(event_id % 240) AS rejected_at, event_id % 13 = 0 AS archived
  FROM validated WHERE rejection_type IS NOT NULL)"""
)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries whose ids come again and again, one sighting an event."""
    return readings(spark, sf_dir).select(F.concat(F.lit("d"), "meter_id").alias("delivery_id"), "source", F.col("reading_time").alias("ingest_time"), F.col("event_id").alias("seq"), (F.col("event_id") % 48).cast("int").alias("reading_count"))


SIGHTINGS = READINGS + ",\nsightings AS (SELECT 'd' || meter_id AS delivery_id, source, reading_time AS ingest_time, event_id AS seq, CAST(event_id % 48 AS INTEGER) AS reading_count FROM readings)"


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one slot a meter and day, so that keys come again across batches; some without received_at."""
    r = readings(spark, sf_dir)
    day = F.date_trunc("day", "reading_time")
    late = F.when(F.col("event_id") % 13 != 0, day + F.make_interval(hours=(F.col("event_id") % 3).cast("int")))
    return r.select("event_id", "meter_id", day.alias("reading_time"), "household_id", (F.col("event_id") % 5).cast("double").alias("kwh"), late.alias("received_at"), "batch")


UPDATES = (
    READINGS
    + """,
updates AS (
  SELECT event_id, meter_id, date_trunc('day', reading_time) AS reading_time, household_id, CAST(event_id % 5 AS DOUBLE) AS kwh,
         CASE WHEN event_id % 13 <> 0 THEN date_trunc('day', reading_time) + to_hours(event_id % 3) END AS received_at, batch
  FROM readings)"""
)
