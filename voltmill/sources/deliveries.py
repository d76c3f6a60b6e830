"""Streams of raw delivery messages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill.config import DEFAULT, EngineConfig

TOPIC = "readings-raw"
#: Lanes are partitions of the topic. Live deliveries leave at once, backfill is bulk.
LIVE, BACKFILL = 0, 1


def source_options(servers: str, topic: str = TOPIC, config: EngineConfig = DEFAULT) -> dict[str, str]:
    """Options of the message scan: from the first offset on, a bounded number of messages in a trigger."""
    return {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(config.messages_per_trigger), "failOnDataLoss": "false",
    }


def sink_options(servers: str, lane: int, topic: str = TOPIC) -> dict[str, str]:
    """Options of the producers of a lane."""
    own = {"linger.ms": "5", "compression.type": "lz4"} if lane == LIVE else {"linger.ms": "100", "compression.type": "gzip"}
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "1", "kafka.retries": "5"} | {f"kafka.{k}": v for k, v in own.items()}


def from_kafka(spark: SparkSession, servers: str, topic: str = TOPIC, config: EngineConfig = DEFAULT) -> DataFrame:
    """Messages of a topic, its partition being the lane; the connector has to be on the class path."""
    stream = spark.readStream.format("kafka").options(**source_options(servers, topic, config)).load()
    return stream.select(F.col("value").cast("string").alias("value"), F.col("partition").alias("lane"))


def from_files(spark: SparkSession, path: str, config: EngineConfig = DEFAULT, lane: int = LIVE) -> DataFrame:
    """Messages that a gateway, or a pull of the archive, drops as lines of text files; files count for messages in the cap of a trigger."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", config.files_per_trigger).load(path).select("value", F.lit(lane).alias("lane"))


def to_messages(deliveries: DataFrame) -> DataFrame:
    return deliveries.select(F.to_json(F.struct("delivery_id", "source", "ingest_time", "readings")).alias("value"))


def to_kafka(deliveries: DataFrame, servers: str, lane: int, topic: str = TOPIC) -> None:
    """Deliveries as messages of one lane, stamped with the time at which they leave where they have none."""
    stamped = deliveries.withColumn("ingest_time", F.coalesce("ingest_time", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    to_messages(stamped).withColumn("partition", F.lit(lane)).write.format("kafka").options(**sink_options(servers, lane, topic)).save()
