"""Deliveries made for tests and demonstrations: faulty readings, a replayed history, and a disorderly sender."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltmill.functions.columns import bucket, spread
from voltmill.sources.deliveries import to_messages

FAULTS = ("invalid_reading_time", "missing_kwh", "kwh_out_of_range", "below_range")


def faulty(readings: DataFrame, every: int = 5) -> DataFrame:
    """Readings as text, about one in `every` with a fault; which, and its kind in `fault`, follow from meter and time."""
    mix = spread(F.concat_ws(" ", "meter_id", F.date_format("reading_time", "yyyy-MM-dd HH:mm")), every * len(FAULTS))
    fault = F.when(mix < len(FAULTS), F.element_at(F.array(*[F.lit(f) for f in FAULTS]), (mix + 1).cast("int")))
    time, kwh = F.date_format("reading_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("kwh")
    return readings.select(
        "meter_id", "household_id", fault.alias("fault"),
        F.when(fault == "invalid_reading_time", F.concat(F.lit("on "), time)).otherwise(time).alias("reading_time"),
        F.when(fault == "missing_kwh", F.lit(None)).when(fault == "kwh_out_of_range", kwh + 1000).when(fault == "below_range", -1 - kwh).otherwise(kwh).cast("string").alias("kwh"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("received_at"),
    )


def replay(readings: DataFrame, start: Column, seconds_a_day: float, size: int = 1000) -> DataFrame:
    """(delivery_id, source, due_s, readings): history as deliveries of up to `size` readings of one half hour.

    due_s is when a delivery is sent, in seconds after the replay begins: a day of data takes `seconds_a_day`. A reading
    is sent when its half hour is over.
    """
    slot = bucket(F.col("reading_time"))
    rows = readings.filter(F.col("reading_time") >= start).withColumn("_slot", slot)
    place = F.row_number().over(Window.partitionBy("_slot").orderBy("meter_id", "reading_time"))
    rows = rows.withColumn("_part", F.floor((place - 1) / size).cast("int"))
    row = F.struct("meter_id", "household_id", F.col("reading_time").cast("string").alias("reading_time"), F.col("kwh").cast("string").alias("kwh"), F.col("received_at").cast("string").alias("received_at"))
    made = rows.groupBy("_slot", "_part").agg(F.array_sort(F.collect_list(row)).alias("readings"))
    over = (F.unix_timestamp("_slot") + 1800 - F.unix_timestamp(start)) * F.lit(seconds_a_day / 86400)
    return made.select(F.concat_ws("-", F.lit("replay"), F.unix_timestamp("_slot"), "_part").alias("delivery_id"), F.lit("live").alias("source"), over.alias("due_s"), "readings")


def disorderly(deliveries: DataFrame, duplicates: float = 0.05, shuffled: float = 0.15, late: float = 0.02, outage: tuple[float, float] | None = None, late_s: float = 3600.0) -> DataFrame:
    """Deliveries of replay() as a sender with faults makes them, with `attempt`: 0, or 1 for a delivery sent again.

    A share is sent twice, of a share the readings stand in another order, a share comes `late_s` later, and what is due
    in the outage, given in seconds of the replay, comes when it ends. All follow from the id, so reruns agree.
    """
    draw = lambda salt: spread(F.concat(F.lit(salt), F.col("delivery_id")), 10_000) / 10_000
    sent = deliveries.withColumn("readings", F.when(draw("order ") < shuffled, F.reverse("readings")).otherwise(F.col("readings")))
    sent = sent.withColumn("due_s", F.col("due_s") + F.when(draw("late ") < late, F.lit(late_s)).otherwise(F.lit(0.0)))
    if outage:
        sent = sent.withColumn("due_s", F.when((F.col("due_s") >= outage[0]) & (F.col("due_s") < outage[1]), F.lit(float(outage[1]))).otherwise(F.col("due_s")))
    again = F.when(draw("again ") < duplicates, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return sent.withColumn("attempt", F.explode(again))


def write_in_order(deliveries: DataFrame, landing: str, step_s: float) -> int:
    """Drop deliveries into a landing folder, one folder a step of the replay's clock, in order; the number of steps."""
    step = F.floor(F.col("due_s") / step_s).cast("int")
    kept = deliveries.withColumn("_step", step).withColumn("ingest_time", F.lit(None).cast("string"))
    steps = [r[0] for r in kept.select("_step").distinct().orderBy("_step").collect()]
    for s in steps:
        to_messages(kept.filter(F.col("_step") == s)).coalesce(1).write.mode("append").text(landing)
    return len(steps)


def sample_readings(spark: SparkSession, meters: int = 4, slots: int = 8) -> DataFrame:
    """A little clean history: `meters` meters, `slots` half hours from 13 January 2014, received an hour after each."""
    k = F.col("id")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2014-01-13 00:00:00").cast("timestamp")) + F.floor(k / meters) * 1800)
    return spark.range(meters * slots).select(
        F.format_string("M%04d", k % meters).alias("meter_id"), F.format_string("H%04d", k % meters).alias("household_id"), at.alias("reading_time"),
        ((k % 7 + 1) / 4).alias("kwh"), (at + F.make_interval(hours=F.lit(1))).alias("received_at"),
    )
