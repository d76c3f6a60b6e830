"""Health of the stream: whether deliveries come in, by timers, and how its batches go, by a listener."""

import logging
import sys
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from voltmill.config import DEFAULT, EngineConfig
from voltmill.operators.ingest import parse_deliveries
from voltmill.sources.store import Store
from voltmill.streaming.pipeline import begun

log = logging.getLogger(__name__)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # processors travel with their code

LIVE, DEAD = "LIVE", "DEAD"
STATUS = "source string, status string, at_ms long"


class Feed(StatefulProcessor):
    """Says when a lane begins to deliver, and, by a timer, when nothing has come from it for its time to live."""

    def __init__(self, live_s: int, backfill_s: int):
        self.ttl_ms = {"backfill": backfill_s * 1000}
        self.live_ms = live_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        until = now + self.ttl_ms.get(key[0], self.live_ms)
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        else:
            yield Row(source=key[0], status=LIVE, at_ms=now)
        self.until.update((until,))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.until.clear()
        yield Row(source=key[0], status=DEAD, at_ms=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def feed_changes(messages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(source, status, at) whenever a lane comes to life or falls silent; needs the state store of config.STATE_STORE."""
    parsed = parse_deliveries(messages).filter("not dead").select("source")
    feed = Feed(config.live_ttl_seconds, config.backfill_ttl_seconds)
    return parsed.groupBy("source").transformWithState(feed, STATUS, "update", "processingTime").select("source", "status", F.timestamp_millis("at_ms").alias("at"))


def start(messages: DataFrame, store: Store, checkpoint: str, config: EngineConfig = DEFAULT, available_now: bool = False) -> StreamingQuery:
    """Keep feed_status: the last change of each lane."""

    def run(changes: DataFrame, epoch: int) -> None:
        t, seen = store.begin(), store.folders("feed_status")
        rows = store.read("feed_status").unionByName(changes)
        newest = rows.groupBy("source").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
        t.replace("feed_status", newest, seen)
        t.commit("feed", epoch)

    writer = feed_changes(messages, config).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(run)
    return begun(messages.sparkSession, writer, config, available_now, True)


class Progress(StreamingQueryListener):
    """Appends the progress of each batch that read something to stream_progress; a failure to do so stops nothing."""

    def __init__(self, store: Store):
        self.store = store

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if not p.numInputRows:
            return
        try:
            row = (p.name, str(p.id), p.batchId, p.numInputRows, p.batchDuration / 1000.0, datetime.now(UTC))
            t = self.store.begin()
            t.append("stream_progress", self.store.spark.createDataFrame([row], "name string, query string, batch long, rows long, seconds double, at timestamp"))
            t.commit()
        except Exception:
            log.exception("progress of batch %d", p.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def health(store: Store) -> DataFrame:
    """One row: whether the live lane delivers, whether gaps are being filled, and whether the engine has read anything yet."""
    lanes = store.read("feed_status")
    alive = lambda source: F.coalesce(F.bool_or((F.col("source") == source) & (F.col("status") == LIVE)), F.lit(False))
    status = lanes.agg(F.when(alive("live") | alive("backfill"), LIVE).otherwise(DEAD).alias("feed"), alive("backfill").alias("filling_gaps"))
    batches = store.read("stream_progress").agg((F.count("*") > 0).alias("ready"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("at").alias("last_batch"))
    return status.crossJoin(batches)
