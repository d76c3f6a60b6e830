"""Pages of an archive, and deliveries made of them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltmill.functions.columns import bucket, content_hash


def archive_pages(readings: DataFrame, since, limit: int) -> DataFrame:
    """Readings from `since` in pages of `limit`, by time and meter; page numbers stand for cursors.

    Places are ranks within a half hour plus the rows of earlier ones, so one task ranks one reading a meter, and only
    the counts of half hours pass through a single one.
    """
    rows = readings.filter(F.col("reading_time") >= since).withColumn("_slot", bucket(F.col("reading_time")))
    order = Window.partitionBy("_slot").orderBy("reading_time", "meter_id", "kwh")
    slots = rows.groupBy("_slot").agg(F.count("*").alias("_n"))
    before = slots.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_slot", "_before")
    placed = rows.withColumn("_place", F.row_number().over(order)).join(before, "_slot")
    return placed.withColumn("page", F.floor((F.col("_place") + F.col("_before") - 1) / limit)).drop("_slot", "_place", "_before")


def page_deliveries(pages: DataFrame, ingest_time, with_kwh: bool = True) -> DataFrame:
    """A delivery for each page, its id a hash of its content."""
    row = F.struct("meter_id", "household_id", F.col("reading_time").cast("string").alias("reading_time"), F.col("kwh").cast("string").alias("kwh"), F.col("received_at").cast("string").alias("received_at"))
    by = pages.groupBy("page").agg(F.collect_list(row).alias("readings"))
    return by.select(content_hash(F.col("readings"), with_kwh).alias("delivery_id"), F.lit("backfill").alias("source"), ingest_time.alias("ingest_time"), "readings")
