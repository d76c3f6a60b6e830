"""Delivery lag of each meter."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltmill.config import DEFAULT
from voltmill.functions.columns import seconds_between


def lags(readings: DataFrame) -> DataFrame:
    """Seconds from reading to receipt; readings without a meter or a time, or received too early, have none."""
    lag = seconds_between(F.col("received_at"), F.col("reading_time"))
    return readings.withColumn("lag", lag).filter("meter_id is not null and lag >= 0")


def lag_stats(readings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, p95 and maximum lag of each meter.

    p95 is the value at place max(1, int(0.95 n)) in order. Equal lags of a meter are counted before rows move, so a
    busy meter costs as many rows as it has different lags.
    """
    keys = ["meter_id", *(by or [])]
    counted = lags(readings).groupBy(*keys, "lag").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy(*keys).orderBy("lag")
    ranked = counted.withColumn("upto", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    place = F.greatest(F.lit(1), F.floor(F.col("all") * F.lit(0.95)))
    total = F.sum((F.col("lag") * 1e6).cast("decimal(38,0)") * F.col("n"))
    return ranked.groupBy(*keys).agg(
        (total.cast("double") / 1e6 / F.sum("n")).alias("avg_lag_sec"),
        F.min(F.when(F.col("upto") >= place, F.col("lag"))).alias("p95_lag_sec"),
        F.max("lag").alias("max_lag_sec"),
        F.sum("n").alias("n"),
    )


def fold_lag(stats: DataFrame, batch: str, keep: float = DEFAULT.ewma_keep) -> DataFrame:
    """Smoothed lag after all batches in order; the first batch of a meter seeds it, the maximum never falls."""
    steps = stats.groupBy("meter_id").agg(F.array_sort(F.collect_list(F.struct(F.col(batch), F.col("avg_lag_sec").alias("a"), F.col("p95_lag_sec").alias("p")))).alias("s"), F.max("max_lag_sec").alias("max_lag_sec"))
    first = F.element_at("s", 1)
    smooth = lambda f: F.aggregate(F.slice("s", 2, F.size("s")), first[f], lambda acc, x: acc * keep + x[f] * (1 - keep))
    return steps.select("meter_id", smooth("a").alias("avg_lag_sec"), smooth("p").alias("p95_lag_sec"), "max_lag_sec")


def upsert_lag(stored: DataFrame, batch: DataFrame, keep: float = DEFAULT.ewma_keep) -> DataFrame:
    """Stored statistics after one more batch."""
    s, b = stored.alias("s"), batch.alias("b")
    both = s.join(b, "meter_id", "full_outer")
    mixed = lambda c: F.coalesce(F.col(f"s.{c}") * keep + F.col(f"b.{c}") * (1 - keep), f"b.{c}", f"s.{c}").alias(c)
    return both.select("meter_id", mixed("avg_lag_sec"), mixed("p95_lag_sec"), F.greatest("s.max_lag_sec", "b.max_lag_sec").alias("max_lag_sec"))
