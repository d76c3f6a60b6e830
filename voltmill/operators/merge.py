"""Conditional merge of readings into the fact table, with an audit of changed values."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["meter_id", "reading_time"]
VALUES = ["household_id", "kwh", "received_at", "ingested_at"]


def newest_in_batch(batch: DataFrame, order: list[str], keys: list[str] = KEY, by: str = "received_at") -> DataFrame:
    """One row a key: the newest by `by`, null last; among equals the last in `order`."""
    keyed = batch.filter(" and ".join(f"{k} is not null" for k in keys))
    newest = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *[F.col(c).desc() for c in order])
    return keyed.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def overwrites(new: Column, old: Column) -> Column:
    """Whether a reading replaces the stored one: received later, or at the same time, seen later and of another value.

    If just one of the two has no received_at, the stored reading stays, either way round.
    """
    later = F.coalesce(new["received_at"] > old["received_at"], F.lit(False))
    same = new["received_at"].eqNullSafe(old["received_at"]) & (new["ingested_at"] > old["ingested_at"])
    return later | (same & ~new["kwh"].eqNullSafe(old["kwh"]))


def merge(target: DataFrame, batch: DataFrame, order: list[str], now: Column) -> DataFrame:
    """Outcome for each key of the batch or the target: the row to store, `old_kwh` and `changed`."""
    return _decided(target, batch, order, now, "full_outer")


def outcome(target: DataFrame, batch: DataFrame, order: list[str], now: Column) -> DataFrame:
    """As merge(), for the keys of the batch alone."""
    return _decided(target, batch, order, now, "right_outer")


def _decided(target: DataFrame, batch: DataFrame, order: list[str], now: Column, how: str) -> DataFrame:
    """Only keys decide which rows meet, so the whole is one shuffle of both sides by key."""
    new = newest_in_batch(batch.withColumn("ingested_at", now), order).select(*KEY, F.struct(*VALUES).alias("new"))
    old = target.select(*KEY, F.struct(*VALUES).alias("old"))
    both = old.join(new, KEY, how)
    wins = F.col("old").isNull() | (F.col("new").isNotNull() & overwrites(F.col("new"), F.col("old")))
    took = both.withColumn("wins", wins).withColumn("row", F.when(F.col("wins"), F.col("new")).otherwise(F.col("old")))
    return took.select(*KEY, "row.*", F.col("old.kwh").alias("old_kwh"), (F.col("wins") & F.col("old").isNotNull()).alias("replaced"), F.col("wins").alias("changed"))


def corrections(merged: DataFrame, now: Column) -> DataFrame:
    """Audit rows of a merge: stored values that gave way to others."""
    changed = merged.filter(F.col("replaced") & ~F.col("kwh").eqNullSafe(F.col("old_kwh")))
    return changed.select(*KEY, "old_kwh", F.col("kwh").alias("new_kwh"), (F.col("kwh") - F.col("old_kwh")).alias("delta"), now.alias("corrected_at"))


def fold_batches(readings: DataFrame, batch: str, order: list[str]) -> DataFrame:
    """What merging the batches one after another leaves: the row of each key and its corrections, in order.

    The batch number stands for the time of ingestion. Batches are folded by key, without a job for each.
    """
    winners = newest_in_batch(readings, order + [batch], [*KEY, batch]).select(
        *KEY, F.struct(F.col(batch).cast("long").alias("ingested_at"), "household_id", "kwh", "received_at").alias("new")
    )
    steps = winners.groupBy(*KEY).agg(F.array_sort(F.collect_list("new")).alias("steps"))
    kind = "struct<ingested_at:bigint,household_id:string,kwh:double,received_at:timestamp>"
    audit = "array<struct<ingested_at:bigint,old_kwh:double,new_kwh:double>>"
    first = F.element_at("steps", 1).cast(kind)
    start = F.struct(first.alias("row"), F.array().cast(audit).alias("log"))

    def step(acc: Column, new: Column) -> Column:
        old = acc["row"]
        wins = overwrites(new, old)
        line = F.struct(new["ingested_at"].alias("ingested_at"), old["kwh"].alias("old_kwh"), new["kwh"].alias("new_kwh"))
        logs = wins & ~new["kwh"].eqNullSafe(old["kwh"])
        return F.struct(
            F.when(wins, new.cast(kind)).otherwise(old).alias("row"),
            F.when(logs, F.concat(acc["log"], F.array(line)).cast(audit)).otherwise(acc["log"]).alias("log"),
        )

    rest = F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0)))
    return steps.withColumn("end", F.aggregate(rest, start, step)).select(*KEY, "end.row.*", F.col("end.log").alias("log"))


def latest(readings: DataFrame, order: str) -> DataFrame:
    """The short way to fold_batches where every received_at is set: its kwh is that of the newest, then last reading."""
    newest = F.max_by(F.struct("household_id", "kwh", "received_at"), F.struct("received_at", order))
    return readings.filter("meter_id is not null and reading_time is not null").groupBy(*KEY).agg(newest.alias("r")).select(*KEY, "r.*")
