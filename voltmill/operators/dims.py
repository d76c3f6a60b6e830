"""Dimension tables, and the preparation of raw extracts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.functions.columns import exact_sum, rounded, spread

STATION = "EGLL-Heathrow"
BEST_REPORT = "FM-12"


def tariff(c: Column) -> Column:
    return F.when(c == "ToU", "ToU").otherwise("Std")


def homes(raw: DataFrame) -> DataFrame:
    """One row a household, tariff normalised; of repeated households any one stays, by its columns' order."""
    row = F.min(F.struct("meter_id", "postcode_area", "household_size", "acorn_group", tariff(F.col("tariff_type")).alias("tariff_type"))).alias("r")
    return raw.filter("household_id is not null and meter_id is not null").groupBy("household_id").agg(row).select("household_id", "r.*")


def weather_hours(raw: DataFrame, order: str) -> DataFrame:
    """One report an hour: the last of the best type, else the first of any."""
    row, best = F.struct("temp_c", "report_type", order), F.trim("report_type") == BEST_REPORT
    picked = F.coalesce(F.max_by(F.when(best, row), F.when(best, F.col(order))), F.min_by(row, F.col(order)))
    by = raw.filter("observed_at is not null").groupBy(F.date_trunc("hour", "observed_at").alias("observed_at")).agg(picked.alias("r"))
    return by.select("observed_at", F.lit(STATION).alias("station"), "r.temp_c", "r.report_type", f"r.{order}")


def replay_window(readings: DataFrame, start: Column, end: Column, lead_days: int = 30) -> DataFrame:
    return readings.filter((F.col("reading_time") >= start - F.make_interval(days=F.lit(lead_days))) & (F.col("reading_time") <= end))


def to_utc(readings: DataFrame, zone: str = "Europe/London") -> DataFrame:
    return readings.withColumn("reading_time", F.to_utc_timestamp("reading_time", zone))


def without_outliers(readings: DataFrame, low: float = 0.0, high: float = 50.0) -> DataFrame:
    return readings.filter((F.col("kwh") >= low) & (F.col("kwh") <= high))


def well_covered(readings: DataFrame, expected: Column, least: float = 0.5) -> DataFrame:
    """Readings of households that have at least a share of the expected number."""
    kept = readings.groupBy("household_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least * expected).select("household_id")
    return readings.join(kept, "household_id", "left_semi")


def labelled(households: DataFrame) -> DataFrame:
    """Areas, groups and sizes that follow from the id alone: eight areas, groups 30/30/40 in a hundred."""
    place = spread(F.col("household_id"), 100)
    group = F.when(place < 30, "Affluent").when(place < 60, "Comfortable").otherwise("Adversity")
    area = F.concat(F.lit("N1-"), F.substring(F.lit("ABCDEFGH"), (place % 8 + 1).cast("int"), F.lit(1)))
    size = F.when(group == "Affluent", 4).when(group == "Comfortable", 3).otherwise(2)
    return households.select("household_id", area.alias("postcode_area"), group.alias("acorn_group"), size.alias("household_size"))


def profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, quartiles and the most frequent value, the least on ties, of number columns, one row each, in one pass."""
    stats = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"), F.countDistinct(c).alias("distinct"), rounded(exact_sum(F.col(c)) / F.count(c), 6).alias("mean"), rounded(F.stddev(c), 6).alias("std"), F.mode(c, True).cast("double").alias("top"),
        F.min(F.col(c).cast("double")).alias("least"), F.percentile(c, 0.25).alias("q1"), F.percentile(c, 0.5).alias("median"), F.percentile(c, 0.75).alias("q3"), F.max(F.col(c).cast("double")).alias("most"),
    )
    return table.agg(F.array(*[stats(c) for c in columns]).alias("s")).select(F.inline("s"))
