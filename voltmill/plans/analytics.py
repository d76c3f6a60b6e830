"""Analyst queries over facts and dimensions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.functions.columns import bucket, exact_sum, rounded, share
from voltmill.operators.dims import tariff

OFF_PEAK_HOURS = 6


def half_hours(facts: DataFrame, start: Column, end: Column) -> DataFrame:
    rows = facts.filter((F.col("reading_time") >= start) & (F.col("reading_time") < end))
    total = exact_sum(F.col("kwh"))
    return (
        rows.groupBy(bucket(F.col("reading_time")).alias("window_start"))
        .agg(rounded(total, 2).alias("total_kwh"), F.countDistinct("meter_id").alias("meters_reporting"), rounded(total / F.count("kwh"), 4).alias("avg_kwh_per_reading"))
        .orderBy("window_start")
    )


def top_households(facts: DataFrame, homes: DataFrame, start: Column, end: Column, k: int = 10) -> DataFrame:
    """Facts are summed by meter before they meet the homes; ties go to the first meter."""
    rows = facts.filter((F.col("reading_time") >= start) & (F.col("reading_time") < end))
    by = rows.groupBy("meter_id").agg(rounded(exact_sum(F.col("kwh")), 3).alias("total_kwh_day"), F.count("reading_time").alias("readings_count"))
    joined = by.join(homes.select("household_id", "meter_id", "postcode_area", "acorn_group", "tariff_type"), "meter_id")
    return joined.orderBy(F.desc("total_kwh_day"), "meter_id").limit(k)


def segment_days(facts: DataFrame, homes: DataFrame, days: int | None = None, newest: Column | None = None) -> DataFrame:
    """Daily use by group and tariff; with `days`, only that many before the newest reading count, which is looked for if it isn't given."""
    if days is not None:
        newest = facts.agg(F.max("reading_time")).scalar() if newest is None else newest
        facts = facts.filter(F.col("reading_time") > newest - F.make_interval(days=F.lit(days)))
    daily = facts.groupBy("meter_id", F.to_date("reading_time").alias("reading_date")).agg(exact_sum(F.col("kwh")).alias("day_kwh"))
    joined = daily.join(homes.select("meter_id", F.coalesce("acorn_group", F.lit("Unknown")).alias("acorn_group"), tariff(F.col("tariff_type")).alias("tariff_type")), "meter_id")
    return (
        joined.groupBy("acorn_group", "tariff_type")
        .agg(
            F.countDistinct("meter_id").alias("meter_count"),
            rounded(exact_sum(F.col("day_kwh")) / F.count("day_kwh"), 3).alias("avg_daily_kwh"),
            rounded(F.min("day_kwh"), 3).alias("min_daily_kwh"),
            rounded(F.max("day_kwh"), 3).alias("max_daily_kwh"),
        )
        .orderBy("acorn_group", "tariff_type")
    )


def coverage(facts: DataFrame, homes: DataFrame) -> DataFrame:
    by = facts.groupBy(F.to_date("reading_time").alias("reading_date")).agg(F.countDistinct("meter_id").alias("meters_reporting"))
    known = F.broadcast(homes.agg(F.count("*").alias("total_known_meters")))
    pct = rounded(share(F.lit(100.0) * F.col("meters_reporting"), F.col("total_known_meters")), 1)
    return by.crossJoin(known).withColumn("coverage_pct", pct).orderBy("reading_date")


def off_peak(facts: DataFrame, homes: DataFrame, daily: bool = False) -> DataFrame:
    """Share of use in the first hours of the day among flexible tariffs, over all days or for each.

    Readings are summed by meter before they meet the homes.
    """
    flexible = homes.filter(F.col("tariff_type") == "ToU").select("meter_id")
    keys = [F.to_date("reading_time").alias("reading_date")] if daily else []
    night = F.when(F.hour("reading_time") < OFF_PEAK_HOURS, F.col("kwh")).otherwise(F.lit(0.0))
    exact = lambda c: F.sum(c.cast("decimal(28,9)"))
    meters = facts.groupBy("meter_id", *keys).agg(exact(F.col("kwh")).alias("total"), exact(night).alias("night"))
    rows = meters.join(flexible, "meter_id").groupBy(*(["reading_date"] if daily else []))
    by = rows.agg(F.countDistinct("meter_id").alias("tou_meter_count"), F.sum("total").cast("double").alias("total"), F.sum("night").cast("double").alias("night"))
    pct = share(F.lit(100.0) * F.col("night"), F.col("total"))
    return by.select(
        *(["reading_date"] if daily else []), "tou_meter_count", rounded(F.col("total"), 2).alias("total_kwh"), rounded(F.col("night"), 2).alias("off_peak_kwh"),
        rounded(pct, 2).alias("off_peak_pct"), rounded(pct - 100.0 * OFF_PEAK_HOURS / 24, 2).alias("shift_vs_uniform_pct"),
    )


def temperature(facts: DataFrame, weather: DataFrame) -> DataFrame:
    """Daily temperature and use, with their correlation over all days; readings without a weather hour drop out.

    Readings are summed by hour before they meet the weather, and the correlation is one row joined to all.
    """
    hour = F.date_trunc("hour", "reading_time")
    hourly = facts.groupBy(hour.alias("observed_at")).agg(F.count("*").alias("n"), exact_sum(F.col("kwh")).alias("kwh"))
    warm = weather.select("observed_at", "temp_c")
    joined = hourly.join(warm, "observed_at")
    seen = F.when(F.col("temp_c").isNotNull(), F.col("n"))
    daily = joined.groupBy(F.to_date("observed_at").alias("reading_date")).agg(
        rounded(exact_sum(F.col("temp_c") * F.col("n")) / F.sum(seen), 1).alias("avg_temp_c"), rounded(exact_sum(F.col("kwh")), 0).alias("total_kwh")
    )
    meters = (
        facts.select("meter_id", hour.alias("observed_at")).distinct().join(warm.select("observed_at"), "observed_at", "left_semi")
        .groupBy(F.to_date("observed_at").alias("reading_date")).agg(F.countDistinct("meter_id").alias("meters_reporting"))
    )
    both = daily.join(meters, "reading_date")
    r = both.agg(rounded(F.corr("avg_temp_c", "total_kwh"), 3).alias("r_temp_kwh"))
    return both.crossJoin(F.broadcast(r)).select("reading_date", "avg_temp_c", "total_kwh", "meters_reporting", "r_temp_kwh").orderBy("reading_date")


def slots_last_day(facts: DataFrame, hours: int = 24, newest: Column | None = None) -> DataFrame:
    newest = facts.agg(F.max("reading_time")).scalar() if newest is None else newest
    recent = facts.filter(F.col("reading_time") > newest - F.make_interval(hours=F.lit(hours)))
    return recent.groupBy(bucket(F.col("reading_time")).alias("time")).agg(exact_sum(F.col("kwh")).alias("total_kwh")).orderBy("time")


def rejects_hourly(rejects: DataFrame, start: Column, end: Column) -> DataFrame:
    rows = rejects.filter(F.col("reading_time").isNotNull() & (F.col("reading_time") >= start) & (F.col("reading_time") <= end))
    return rows.groupBy(F.date_trunc("hour", "reading_time").alias("time"), F.col("rejection_type").alias("metric")).agg(F.count("*").alias("value"))


def silent_top(log: DataFrame, k: int = 50) -> DataFrame:
    return log.select("meter_id", "postcode_area", "last_seen", rounded(F.col("silent_hours"), 1).alias("silent_hours"), "detected_at").orderBy(F.desc("silent_hours"), "meter_id").limit(k)


def last_delivery(log: DataFrame) -> DataFrame:
    return log.agg(F.max("logged_at").alias("last_delivery"))


def delivery_rate(log: DataFrame, now: Column) -> DataFrame:
    since = lambda m: F.count_if(F.col("logged_at") > now - F.make_interval(mins=F.lit(m)))
    return log.agg(since(5).alias("last_5_min"), rounded(since(60) / 12.0, 1).alias("baseline_5_min"))
