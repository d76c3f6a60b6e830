"""The stream: messages in, merged facts and audit tables out."""

import json
import logging
import sys
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from voltmill.config import DEFAULT, EngineConfig
from voltmill.operators import lag, live
from voltmill.operators.ingest import flatten, parse_deliveries, split_valid, validate
from voltmill.sources.store import FOLDERS_A_TIER, REJECTS, Store, Transaction

log = logging.getLogger(__name__)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # processors travel with their code

MARKED = "value string, lane int, repeat boolean"


def keyed(messages: DataFrame) -> DataFrame:
    """(value, lane, key) of messages.

    Nothing that a delivery says of its times counts for repeats, so however late it was made, and whether or not it says
    so, it is never too late. A delivery without an id goes by its readings, a dead message by its text.
    """
    key = (
        F.when(F.col("dead"), F.concat(F.lit("dead "), F.md5(F.coalesce("value", F.lit("")).cast("binary"))))
        .when(F.col("delivery_id") == "", F.concat(F.lit("readings "), F.md5(F.to_json("readings").cast("binary"))))
        .otherwise(F.concat(F.lit("id "), F.col("delivery_id")))
    )
    return parse_deliveries(messages).select("value", F.col("lane").cast("int").alias("lane"), key.alias("key"))


class Sightings(StatefulProcessor):
    """Marks messages whose key has passed less than the time to live ago.

    The state is one value a key, and the store itself forgets it when its time is over. There is no watermark: if the
    clock goes back, keys are remembered longer, and no message is dropped.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", "lane int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        repeat = self.passed.exists()
        for r in rows:
            yield Row(value=r["value"], lane=r["lane"], repeat=repeat)
            if not repeat:
                self.passed.update((r["lane"],))
                repeat = True

    def close(self) -> None:
        pass


def mark_sightings(messages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Messages with `repeat`: whether their key has passed less than the time to live ago; nothing is dropped.

    Needs the state store of config.STATE_STORE. A batch that is replayed has the state it had, so it decides the same.
    """
    ttl = config.dedup_ttl_hours * 3_600_000
    return keyed(messages).groupBy("key").transformWithState(Sightings(ttl), MARKED, "append", "processingTime")


def write_batch(marked: DataFrame, epoch: int, store: Store, stream: str, config: EngineConfig = DEFAULT, now: datetime | None = None) -> None:
    """One micro-batch of (value, lane, repeat): dead letters, repeats, log, rejects, merge and lag, all seen at once.

    A batch that this stream has finished before does nothing. The live window and its meters follow from what the merge
    changes. The lag statistics are best effort: if they fail the readings stay.
    """
    if store.finished(stream, epoch):
        return
    at = now or datetime.now(UTC)
    now = F.lit(at)
    parsed = parse_deliveries(marked).withColumn("value", F.when(F.col("dead"), F.col("value"))).persist()  # the text of others is not needed again
    readings, invalid = None, 0
    try:
        t = store.begin()
        n = parsed.agg(F.count_if("dead").alias("dead"), F.count_if(~F.col("dead") & F.col("repeat")).alias("repeats"), F.count_if(~F.col("dead") & ~F.col("repeat")).alias("new")).first()
        if n["dead"]:
            t.append("dead_letters", parsed.filter("dead").select("value", "lane", now.alias("seen_at")))
        if n["repeats"]:
            t.append("batch_duplicates", parsed.filter("not dead and repeat").select("delivery_id", now.alias("detected_at"), "source", F.size("readings").alias("reading_count")))
        if n["new"]:
            new = parsed.filter("not dead and not repeat").withColumn("ingest_time", F.coalesce("ingest_time", now))
            t.append("batch_log", new.select("delivery_id", "source", F.col("ingest_time").alias("received_at"), F.size("readings").alias("reading_count"), F.lit("accepted").alias("status"), now.alias("logged_at")))
            readings = validate(flatten(new), config).persist()
            valid, rejected = split_valid(readings)
            invalid = rejected.count()
            if invalid:
                number = F.xxhash64(F.lit(t.id), F.monotonically_increasing_id())
                t.append_days(REJECTS, rejected.withColumns({"id": number, "rejected_at": now, "archived": F.lit(False)}), "rejected_at")
            t.merge(valid, ["ingest_time", "delivery_id", "place"], now, lambda merged: update_live(store, t, merged, now), held=True)
            try:
                t.replace("meter_lag_stats", lag.upsert_lag(store.read("meter_lag_stats"), lag.lag_stats(valid), config.ewma_keep).withColumn("updated_at", now))
            except Exception:
                log.exception("epoch %d: lag statistics", epoch)
        if n["repeats"] or invalid:
            events = store.spark.createDataFrame([("duplicates", n["repeats"]), ("invalid", invalid)], "kind string, n long").withColumn("at", now)
            t.replace("live_counters", live.continued(store.read("live_counters"), events, config.quiet_gap_minutes), store.folders("live_counters"))
        t.commit(stream, epoch)
    finally:
        parsed.unpersist()
        if readings is not None:
            readings.unpersist()
    try:
        if epoch % FOLDERS_A_TIER == FOLDERS_A_TIER - 1:
            store.compact()
    except Exception:
        log.exception("epoch %d: compaction", epoch)


def update_live(store: Store, t: Transaction, merged: DataFrame, now: Column) -> None:
    """Bring the live tables up to date by what a merge has changed; no fact is read again.

    live_meters holds the sum of each meter in the half hour of the newest reading. A stored value that gives way is
    taken back and the new one added; a batch with a newer half hour starts from nothing, as no earlier reading lies in
    it. meter_sketches gets a sketch of the batch's meters for each half hour, which add up to distinct meters.
    """
    before = store.folders("live_meters")
    changed = live.deltas(merged).persist()
    try:
        t.append("meter_sketches", live.sketches(changed))
        meters = live.after_deltas(store.read("live_meters"), changed).persist()
        try:
            t.replace("live_meters", meters, read=before)
            t.replace("live_window", live.kept_window(meters, store.read("homes")).withColumn("updated_at", now))
        finally:
            meters.unpersist()
    finally:
        changed.unpersist()


def start(messages: DataFrame, base: str, config: EngineConfig = DEFAULT, available_now: bool = False, dedup: bool = True, checkpoint: str | None = None) -> StreamingQuery:
    """Run the stream into the tables under `base`; without dedup the merge alone keeps repeats harmless.

    The stream's id is that of its checkpoint, so one that begins anew is another one.
    """
    store = Store(messages.sparkSession, base)
    checkpoint = checkpoint or f"{base}/_checkpoint"
    stream = mark_sightings(messages, config) if dedup else keyed(messages).select("value", "lane", F.lit(False).alias("repeat"))

    def run(df: DataFrame, epoch: int) -> None:
        write_batch(df, epoch, store, json.loads(store.files.read(f"{checkpoint}/metadata"))["id"], config)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return begun(messages.sparkSession, writer, config, available_now, False)


def begun(spark: SparkSession, writer: DataStreamWriter, config: EngineConfig, available_now: bool, idle: bool) -> StreamingQuery:
    """The query, started; with `idle` it also runs batches without data, which timers need and no run that is to end may have."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(idle and not available_now).lower())  # a query keeps the settings that it begins with
    try:
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{config.trigger_seconds} seconds")).start()
    finally:
        spark.conf.set(name, kept)


def live_counts(messages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Deliveries of each run without a quiet gap between arrivals, as a streaming session window."""
    parsed = parse_deliveries(messages).filter("not dead").withColumn("arrived_at", F.current_timestamp())
    gap = f"{config.quiet_gap_minutes} minutes"
    return parsed.withWatermark("arrived_at", gap).groupBy(F.session_window("arrived_at", gap), "source").count()
