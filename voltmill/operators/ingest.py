"""Deliveries from raw messages: parsing, dead letters, repeats, flattening and validation."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltmill import schemas
from voltmill.config import DEFAULT, EngineConfig
from voltmill.functions.columns import parsed_number, parsed_time


def parse_deliveries(messages: DataFrame, value: str = "value") -> DataFrame:
    """Delivery columns beside the message's own; `dead` marks messages that are no delivery.

    A message that is no JSON object, or whose readings are missing or null, is dead and never stops a batch.
    """
    parsed = F.from_json(F.col(value).cast("string"), schemas.DELIVERY_WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    rows = messages.withColumn("_d", parsed)
    return rows.select(
        *messages.columns,
        F.coalesce("_d.delivery_id", F.lit("")).alias("delivery_id"),
        F.coalesce("_d.source", F.lit("live")).alias("source"),
        parsed_time(F.col("_d.ingest_time")).alias("ingest_time"),
        F.col("_d.readings").alias("readings"),
        (F.col("_d").isNull() | F.col("_d.corrupt").isNotNull() | F.col("_d.readings").isNull()).alias("dead"),
    )


def flatten(deliveries: DataFrame) -> DataFrame:
    """One row a reading, with its delivery and its place in it; raw text stays raw.

    kwh is the text of the value as it came, and kwh_boolean tells true and false from such texts.
    """
    carried = [c for c in ("delivery_id", "source", "ingest_time", "batch") if c in deliveries.columns]
    rows = deliveries.select(*carried, F.posexplode("readings").alias("place", "r")).select(*carried, "place", "r.*")
    return rows.withColumns({"kwh_boolean": F.coalesce(F.schema_of_variant("kwh") == "BOOLEAN", F.lit(False)), "kwh": F.try_variant_get("kwh", "$", "string")})


def validate(readings: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Typed readings with rejection_type and rejection_detail, both null where a reading is valid.

    The first rule that fails names the reject: the time, a missing or non-numeric value, the range. A value that is
    not a number is kept as text, so one bad row cannot lose the rejects beside it. True and false, if kwh_boolean says
    that they are no texts, are 1 and 0.
    """
    boolean = F.col("kwh_boolean") if "kwh_boolean" in readings.columns else F.lit(False)
    raw, kwh, time = F.col("kwh_raw"), F.col("kwh"), F.col("reading_time")
    typed = readings.withColumns(
        {
            "kwh_raw": F.col("kwh"),
            "kwh": F.when(boolean, (F.col("kwh") == "true").cast("int").cast("double")).otherwise(parsed_number(F.col("kwh"))),
            "reading_time": parsed_time(F.col("reading_time")),
            "received_at": parsed_time(F.col("received_at")),
        }
    )
    outside = F.isnan(kwh) | (kwh < config.kwh_low) | (kwh > config.kwh_high)
    shown = F.when(F.isnan(kwh), "nan").when(kwh == float("inf"), "inf").when(kwh == float("-inf"), "-inf").otherwise(kwh.cast("string"))
    kind = (
        F.when(time.isNull(), "invalid_reading_time").when(kwh.isNull(), "missing_kwh").when(outside, "kwh_out_of_range")
    )
    detail = (
        F.when(time.isNull(), "reading_time absent or unparseable")
        .when(raw.isNull(), "kwh is null")
        .when(kwh.isNull(), F.concat(F.lit("kwh='"), raw, F.lit("' not numeric")))
        .when(outside, F.concat(F.lit("kwh="), shown, F.lit(f", expected [{config.kwh_low},{config.kwh_high}]")))
    )
    return typed.withColumns({"rejection_type": kind, "rejection_detail": detail}).drop("kwh_boolean")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid readings with a meter, and rejects; a valid reading without a meter belongs to neither."""
    ok = F.col("rejection_type").isNull()
    return validated.filter(ok & F.col("meter_id").isNotNull()).drop("rejection_type", "rejection_detail", "kwh_raw"), validated.filter(~ok)


def mark_repeats(deliveries: DataFrame, hours: int = DEFAULT.dedup_ttl_hours, order: str = "seq") -> DataFrame:
    """Deliveries with `repeat`: seen again less than `hours` after the sighting that last passed.

    A pass starts the time anew, a repeat does not. Sightings are put in order of id, ingest_time and `order` and pass by
    as a stream, of which one time is held, so an id may come as often as it likes; those that pass meet the deliveries
    again. A sighting without a time passes, and so does the one after it.
    """
    ttl = hours * 3_600_000_000
    kind = deliveries.schema[order].dataType.simpleString()
    seen = deliveries.select("delivery_id", F.unix_micros("ingest_time").alias("at"), F.col(order).alias("o"))
    ordered = seen.repartition("delivery_id").sortWithinPartitions("delivery_id", "at", "o")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, since, begun = None, None, False
        for batch in batches:
            keep = []
            for i, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or i != own:
                    own, since, begun = i, None, True
                again = since is not None and at is not None and at - since < ttl
                since = since if again else at
                keep.append(not again)
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    passed = ordered.mapInArrow(passing, f"delivery_id string, o {kind}").select("delivery_id", F.col("o").alias(order), F.lit(False).alias("_again"))
    return deliveries.join(passed, ["delivery_id", order], "left").withColumn("repeat", F.coalesce("_again", F.lit(True))).drop("_again")


def duplicates_log(marked: DataFrame) -> DataFrame:
    """At most one row an id: its first repeat, and how many there were."""
    first = F.min_by(F.struct("source", "reading_count"), F.struct("ingest_time", "seq"))
    found = marked.filter("repeat").groupBy("delivery_id").agg(F.min("ingest_time").alias("detected_at"), first.alias("f"), F.count("*").alias("repeats"))
    return found.select("delivery_id", "detected_at", "f.source", "f.reading_count", "repeats")


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows to append: of keys that the target lacks, the first in order; present keys stay unchanged."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.join(target.select(*keys).distinct(), keys, "left_anti")


def lane_union(live: DataFrame, backfill: DataFrame) -> DataFrame:
    return live.unionByName(backfill, allowMissingColumns=True)
