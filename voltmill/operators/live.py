"""Live state: the current half hour, its forecast, counters and feed health."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmill.config import DEFAULT
from voltmill.functions.columns import band, bucket, exact_sum, rounded

#: Steps of the panels: value, then from where it is marked, and from where marked strongly.
BANDS = {"kwh": (4118.0, 4575.0), "forecast": (9720.0, 10800.0), "duplicates": (10.0, 50.0), "invalid": (20.0, 100.0)}
METERS = (4500.0, 4900.0)
#: log2 of a sketch's registers; its relative error is about 1.04 / sqrt(registers).
LG_K = 12


def forecast(kwh: Column, seen: Column, book: Column) -> Column:
    """Projected total of the window: what came so far over the share of known meters that reported."""
    cover = F.least(seen / book, F.lit(1.0))
    return F.when((book > 0) & (seen > 0), rounded(kwh / cover, 2)).otherwise(kwh)


def windows(facts: DataFrame, book: DataFrame) -> DataFrame:
    """Every half hour of the facts: total, meters and forecast. The book is one row, the number of known meters."""
    by = facts.groupBy(bucket(F.col("reading_time")).alias("window_start")).agg(exact_sum(F.col("kwh")).alias("kwh"), F.countDistinct("meter_id").alias("meters"))
    return _with_forecast(by, book)


def _with_forecast(by: DataFrame, book: DataFrame) -> DataFrame:
    return by.crossJoin(F.broadcast(book.agg(F.count("*").alias("book")))).select(
        "window_start", "kwh", "meters", forecast(F.col("kwh"), F.col("meters"), F.col("book")).alias("forecast")
    )


def current_window(facts: DataFrame, book: DataFrame) -> DataFrame:
    """The half hour of the newest reading, from merged facts, so corrections and repeats count once."""
    newest = facts.agg(bucket(F.max("reading_time"))).scalar()
    return windows(facts.filter(F.col("reading_time") >= newest), book)


def deltas(merged: DataFrame) -> DataFrame:
    """(window_start, meter_id, kwh) that the changed rows of a merge add to half hours, exactly: a value that gives way is taken back."""
    exact = lambda c: F.coalesce(F.col(c).cast("decimal(28,9)"), F.lit(0).cast("decimal(28,9)"))
    change = (exact("kwh") - F.when(F.col("replaced"), exact("old_kwh")).otherwise(F.lit(0).cast("decimal(28,9)"))).cast("decimal(28,9)")
    rows = merged.filter("changed").select(bucket(F.col("reading_time")).alias("window_start"), "meter_id", change.alias("kwh"))
    return rows.groupBy("window_start", "meter_id").agg(F.sum("kwh").cast("decimal(38,9)").alias("kwh"))


def after_deltas(kept: DataFrame, changed: DataFrame) -> DataFrame:
    """(window_start, meter_id, kwh) of the newest half hour after the changes: `kept` is that of the newest one before."""
    rows = kept.unionByName(changed)
    newest = rows.agg(F.max("window_start")).scalar()
    return rows.filter(F.col("window_start") == newest).groupBy("window_start", "meter_id").agg(F.sum("kwh").cast("decimal(38,9)").alias("kwh"))


def kept_window(meters: DataFrame, book: DataFrame) -> DataFrame:
    """The current window of kept sums of meters, as current_window() gives it from facts."""
    by = meters.groupBy("window_start").agg(F.sum("kwh").cast("double").alias("kwh"), F.count("*").alias("meters"))
    return _with_forecast(by, book)


def sketches(changed: DataFrame) -> DataFrame:
    """A sketch of the meters of each half hour that a batch changed."""
    return changed.groupBy("window_start").agg(F.hll_sketch_agg("meter_id", F.lit(LG_K)).alias("sketch"))


def meters_kept(kept: DataFrame) -> DataFrame:
    """Distinct meters of each half hour from the sketches of all batches, whose union is the sketch of all their rows."""
    return kept.groupBy("window_start").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("meters"))


def rolling_window(readings: DataFrame, book: DataFrame, batch: str = "batch") -> DataFrame:
    """The window that batches leave behind if each adds its readings of its own newest half hour.

    A batch whose newest half hour is older than the stored one is skipped, and a newer one starts from nothing. So the
    end holds, for the newest half hour of all, the batches for which it was the newest too.
    """
    own = readings.groupBy(F.col(batch).alias("_b")).agg(bucket(F.max("reading_time")).alias("_w"))
    last = own.agg(F.max("_w").alias("_w"))
    ends = own.join(F.broadcast(last), "_w")
    rows = readings.join(ends, F.col(batch).eqNullSafe(F.col("_b")) & (bucket(F.col("reading_time")) == F.col("_w")))
    return windows(rows.drop("_b", "_w"), book)


def meters_sketch(facts: DataFrame) -> DataFrame:
    """Distinct meters a half hour from mergeable sketches."""
    return facts.groupBy(bucket(F.col("reading_time")).alias("window_start")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("meter_id", F.lit(LG_K))).alias("meters"))


def sessions(events: DataFrame, time: str, gap_minutes: int = DEFAULT.quiet_gap_minutes) -> DataFrame:
    """Counters that run until nothing came for the gap: start, last event and count of each run.

    Events less than a gap apart share a run, so all of one slot as long as the gap do. Slots are counted first, and
    only they are put in order, one row a slot however many events came.
    """
    gap = gap_minutes * 60_000_000
    at = F.unix_micros(time)
    slots = events.filter(F.col(time).isNotNull()).groupBy(F.floor(at / gap).alias("slot")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))
    order = Window.orderBy("slot")
    begins = F.coalesce(F.col("lo") - F.lag("hi").over(order) >= gap, F.lit(True))
    runs = slots.withColumn("new", begins.cast("int")).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("run").agg(F.timestamp_micros(F.min("lo")).alias("first_at"), F.timestamp_micros(F.max("hi")).alias("last_at"), F.sum("n").alias("n")).drop("run")


def continued(kept: DataFrame, events: DataFrame, gap_minutes: int = DEFAULT.quiet_gap_minutes) -> DataFrame:
    """Runs (kind, first_at, last_at, n) of counters after a batch of (kind, at, n), all of whose events come at one time.

    An event less than the gap after the last one of its kind goes on in its run, else a new run begins; so the runs are
    those of sessions() over all events, and the newest one of a kind is its counter so far.
    """
    new = events.filter("n > 0").groupBy("kind").agg(F.min("at").alias("at"), F.sum("n").alias("more"))
    last = kept.groupBy(F.col("kind").alias("k")).agg(F.max("last_at").alias("newest"))
    both = new.join(last, F.col("kind") == F.col("k"), "left")
    on = F.coalesce(F.unix_micros("at") - F.unix_micros("newest") < gap_minutes * 60_000_000, F.lit(False))
    placed = both.select(F.col("kind").alias("k"), "at", "more", F.when(on, F.col("newest")).alias("goes_on"))
    grown = kept.join(F.broadcast(placed.drop("at").filter("goes_on is not null").withColumnRenamed("more", "extra")), (F.col("kind") == F.col("k")) & (F.col("last_at") == F.col("goes_on")), "left")
    at = F.broadcast(placed.select(F.col("k").alias("k2"), F.col("at").alias("now")))
    grown = grown.join(at, (F.col("k") == F.col("k2")), "left").select("kind", "first_at", F.coalesce("now", "last_at").alias("last_at"), (F.col("n") + F.coalesce("extra", F.lit(0))).alias("n"))
    return grown.unionByName(placed.filter("goes_on is null").select(F.col("k").alias("kind"), F.col("at").alias("first_at"), F.col("at").alias("last_at"), F.col("more").alias("n")))


def trailing(events: DataFrame, time: str, now: Column, minutes: int) -> DataFrame:
    """Events of the last minutes before `now`."""
    return events.agg(F.count_if((F.col(time) > now - F.make_interval(mins=F.lit(minutes))) & (F.col(time) <= now)).alias("n"))


def feed_status(deliveries: DataFrame, now: Column, live_s: int = DEFAULT.live_ttl_seconds, backfill_s: int = DEFAULT.backfill_ttl_seconds) -> DataFrame:
    """LIVE while a delivery came within the last seconds; whether gaps are being filled likewise."""
    at = F.unix_micros("ingest_time")
    last = deliveries.agg(F.max(at).alias("last"), F.max(F.when(F.col("source") == "backfill", at)).alias("fill"))
    age = lambda c: (F.unix_micros(now) - F.col(c)) / 1e6
    return last.select(
        F.timestamp_micros("last").alias("last_delivery"),
        F.when(age("last") < live_s, "LIVE").otherwise("DEAD").alias("feed"),
        F.coalesce(age("fill") < backfill_s, F.lit(False)).alias("filling_gaps"),
    )


def count_bands(repeats: DataFrame, rejects: DataFrame, now: Column, minutes: int = DEFAULT.quiet_gap_minutes) -> DataFrame:
    """Repeats and rejects of the last minutes before `now`, each with its band, from tables with detected_at and rejected_at."""
    n = lambda df, time: df.agg(F.count_if((F.col(time) > now - F.make_interval(mins=F.lit(minutes))) & (F.col(time) <= now)).alias("n"))
    both = n(repeats, "detected_at").select(F.col("n").alias("duplicates")).crossJoin(n(rejects, "rejected_at").select(F.col("n").alias("invalid")))
    return both.select("duplicates", band(F.col("duplicates"), *BANDS["duplicates"]).alias("duplicates_band"), "invalid", band(F.col("invalid"), *BANDS["invalid"]).alias("invalid_band"))


def banded(windows: DataFrame) -> DataFrame:
    low, enough = METERS
    meters = F.when(F.col("meters") >= enough, "ok").when(F.col("meters") >= low, "warn").otherwise("low")
    return windows.select("window_start", band(F.col("kwh"), *BANDS["kwh"]).alias("kwh_band"), band(F.col("forecast"), *BANDS["forecast"]).alias("forecast_band"), meters.alias("meters_band"))
