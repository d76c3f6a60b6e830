"""Maintenance runs on the engine's tables: each reads, works out and writes back, seen at once when it ends.

A scheduler outside runs them, one of a kind at a time; two that meet by mistake don't both count.
"""

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.config import DEFAULT, EngineConfig
from voltmill.operators import dims, ingest, jobs
from voltmill.plans import analytics
from voltmill.sources.store import ARCHIVED, REJECTS, Store


def run_silence(store: Store, now: Column, config: EngineConfig = DEFAULT) -> None:
    """Append the meters that are silent now; every run logs all of them again.

    The newest reading is looked for in its month alone, and no month before the days that count is opened.
    """
    newest = store.newest()
    if newest is None:
        return
    days = config.silence_lookback_days
    facts = store.facts_last(timedelta(days=days), newest)
    silent = jobs.silent_meters(facts, store.read("homes"), config.silence_hours, days, F.lit(newest))
    t = store.begin()
    t.append("meter_silence_log", jobs.silence_rows(silent, now))
    t.commit()


def last_day(store: Store, hours: int = 24) -> DataFrame:
    """Use by half hour of the last hours; two months are opened at most."""
    newest = store.newest()
    return analytics.slots_last_day(store.facts() if newest is None else store.facts_last(timedelta(hours=hours), newest), hours, None if newest is None else F.lit(newest))


def recent_segments(store: Store, days: int) -> DataFrame:
    """Daily use by group and tariff of the last days, whose months alone are opened."""
    newest = store.newest()
    facts = store.facts() if newest is None else store.facts_last(timedelta(days=days), newest)
    return analytics.segment_days(facts, store.read("homes"), days, None if newest is None else F.lit(newest))


def load_homes(store: Store, raw: DataFrame) -> None:
    """Insert the households that the table lacks; the ones it has stay as they are, and a second run adds nothing."""
    _insert_absent(store, "homes", dims.homes(raw), ["household_id"])


def load_weather(store: Store, raw: DataFrame, order: str) -> None:
    """Insert the weather hours that the table lacks, the best report of each; only its times are read of the table."""
    _insert_absent(store, "weather_hourly", dims.weather_hours(raw, order).drop(order), ["observed_at"])


def _insert_absent(store: Store, name: str, rows: DataFrame, keys: list[str]) -> None:
    t, seen = store.begin(), store.folders(name)
    t.append(name, ingest.insert_if_absent(store.read(name), rows, keys, keys), seen)
    t.commit()


def run_orphans(store: Store, keep_first: bool = True) -> None:
    """Bring the summary of meters without a home up to date."""
    found = jobs.orphans(store.facts(), store.read("homes"))
    t = store.begin()
    t.replace("orphan_meters_summary", jobs.upsert_orphans(store.read("orphan_meters_summary"), found, keep_first))
    t.commit()


def run_archive(store: Store, now: Column, config: EngineConfig = DEFAULT) -> None:
    """Add old rejects to the hourly totals, mark them, and remove those past retention.

    Rejects lie by day. Days that have been archived as a whole are noted and not read again until they are past
    retention, when their folders leave unread; the days of the two cuts alone are written anew. Totals and marks become
    visible together, so no reject is counted twice or left out, however often a run dies. Rejects that come meanwhile
    stay as they are.
    """
    cut = lambda days: F.date_format(now - F.make_interval(days=F.lit(days)), "yyyy-MM-dd")
    old, gone = store.spark.range(1).select(cut(config.archive_after_days), cut(config.reject_retain_days)).first()
    state = store.state()
    held = {day: [f"{store.base}/{p}" for p, _ in folders] for day, folders in state["tables"].get(REJECTS, {}).items()}
    done = set(state.get(ARCHIVED, []))
    due = [d for d in held if d <= old and d not in done]
    read = sorted({*due, *(d for d in held if d == gone)})
    past = [d for d in held if d < gone]
    rejects = store.read(REJECTS, read)
    totals = jobs.roll_up(store.read("rejection_hourly_summary"), jobs.archivable(rejects, now, config.archive_after_days))
    kept = jobs.purge(jobs.mark_archived(rejects, now, config.archive_after_days), now, config.reject_retain_days)
    t = store.begin()
    if due:
        t.replace("rejection_hourly_summary", totals)
    t.replace_days(REJECTS, kept if read else None, "rejected_at", {d: held[d] for d in {*read, *past}}, [d for d in due if d < old])
    t.commit()


def latest_silence(store: Store):
    """Silent meters of the last run alone."""
    log = store.read("meter_silence_log")
    return log.join(log.agg(F.max("detected_at").alias("detected_at")), "detected_at", "left_semi")
