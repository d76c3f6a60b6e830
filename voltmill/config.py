"""Settings of the engine, and the session that its queries expect."""

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Every operator takes what it needs from here or as a parameter; none reads the environment or the clock."""

    trigger_seconds: int = 5
    messages_per_trigger: int = 500
    files_per_trigger: int = 500
    window_minutes: int = 30
    dedup_ttl_hours: int = 24
    silence_hours: float = 2.0
    silence_lookback_days: int = 30
    archive_after_days: int = 1
    reject_retain_days: int = 7
    live_ttl_seconds: int = 150
    backfill_ttl_seconds: int = 60
    quiet_gap_minutes: int = 5
    ewma_keep: float = 0.8
    kwh_low: float = 0.0
    kwh_high: float = 50.0
    page_limit: int = 1000


DEFAULT = EngineConfig()
#: Streaming state lives off the heap, on the executors' disks and in the checkpoint, and knows times to live.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(app: str = "voltmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time, Arrow transfer and streaming state in RocksDB; `conf` goes on top.

    Times are written with statistics, by which readers skip files; the default kind of Parquet times has none.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
