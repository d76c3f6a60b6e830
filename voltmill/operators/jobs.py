"""Maintenance jobs: silent meters, orphan meters, and the archive of rejects. Each takes its time of now."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.config import DEFAULT
from voltmill.functions.columns import exact_sum, seconds_between


def silent_meters(facts: DataFrame, homes: DataFrame, hours: float = DEFAULT.silence_hours, days: int = DEFAULT.silence_lookback_days, newest: Column | None = None) -> DataFrame:
    """Meters whose last reading of the last days is over `hours` before the newest reading of all, longest first.

    With `newest` known, the facts are read once and need not go further back than the days.
    """
    now = facts.agg(F.max("reading_time")).scalar() if newest is None else newest
    last = facts.filter(F.col("reading_time") > now - F.make_interval(days=F.lit(days))).groupBy("meter_id").agg(F.max("reading_time").alias("last_seen"))
    silent = last.withColumn("_s", seconds_between(now, F.col("last_seen"))).filter(F.col("_s") > hours * 3600)
    known = silent.join(homes.select("meter_id", "postcode_area"), "meter_id", "left")
    return known.select("meter_id", "postcode_area", "last_seen", (F.col("_s") / 3600).alias("silent_hours")).orderBy(F.desc("silent_hours"), "meter_id")


def silence_rows(silent: DataFrame, now: Column) -> DataFrame:
    return silent.withColumn("detected_at", now)


def orphans(facts: DataFrame, homes: DataFrame) -> DataFrame:
    """Meters with readings but no home; facts are reduced to meters before they meet the homes."""
    by = facts.groupBy("meter_id").agg(
        F.min("reading_time").alias("first_seen"), F.max("reading_time").alias("last_seen"), F.count("*").alias("reading_count"), F.coalesce(exact_sum(F.col("kwh")), F.lit(0.0)).alias("total_kwh")
    )
    return by.join(homes.select("meter_id"), "meter_id", "left_anti")


def upsert_orphans(stored: DataFrame, found: DataFrame, keep_first: bool = True) -> DataFrame:
    """Stored summary after a run: counts and last sightings are replaced.

    first_seen stays as stored, or, if `keep_first` is off, becomes the earlier of both.
    """
    s, f = stored.alias("s"), found.alias("f")
    first = F.coalesce("s.first_seen", "f.first_seen") if keep_first else F.least("s.first_seen", "f.first_seen")
    new = lambda c: F.coalesce(f"f.{c}", f"s.{c}").alias(c)
    return s.join(f, "meter_id", "full_outer").select("meter_id", first.alias("first_seen"), new("last_seen"), new("reading_count"), new("total_kwh"))


def _older(now: Column, days: int) -> Column:
    return F.col("rejected_at") < now - F.make_interval(days=F.lit(days))


def archivable(rejects: DataFrame, now: Column, days: int = DEFAULT.archive_after_days) -> DataFrame:
    return rejects.filter(_older(now, days) & ~F.col("archived"))


def roll_up(summary: DataFrame, rejects: DataFrame) -> DataFrame:
    """Hourly totals after rejects are added; the hour is that of the reading, or of the reject if it has no time."""
    hour = F.date_trunc("hour", F.coalesce("reading_time", "rejected_at"))
    new = rejects.groupBy(hour.alias("ts_hour"), F.col("rejection_type").alias("rejection_reason")).agg(F.count("*").alias("count"))
    return summary.unionByName(new).groupBy("ts_hour", "rejection_reason").agg(F.sum("count").alias("count"))


def mark_archived(rejects: DataFrame, now: Column, days: int = DEFAULT.archive_after_days) -> DataFrame:
    """Rejects with those marked that archivable() takes, so that no later run counts them again."""
    return rejects.withColumn("archived", F.col("archived") | F.coalesce(_older(now, days), F.lit(False)))


def purge(rejects: DataFrame, now: Column, days: int = DEFAULT.reject_retain_days) -> DataFrame:
    return rejects.filter(~F.coalesce(_older(now, days), F.lit(False)))
