"""What analysts see: the engine's tables as views of the session."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill import schemas
from voltmill.sources.store import Store

#: Logs of which the first row of an id counts, and their time; later ones are of ids that came again.
FIRST = {"batch_log": "logged_at", "batch_duplicates": "detected_at"}


def first_of_ids(log: DataFrame, time: str, key: str = "delivery_id") -> DataFrame:
    """At most one row an id: the first by time, as if rows of ids that are there had not been inserted."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(time, *[c for c in others if c != time])).alias("r")).select(key, "r.*").select(*log.columns)


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Tables as temporary views, so that spark.sql can name them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_store(store: Store) -> None:
    """Every table of a store, as it stands now; tables that nobody has written yet are empty."""
    tables = {name: store.read(name) for name in schemas.TABLES}
    register(store.spark, tables | {name: first_of_ids(tables[name], time) for name, time in FIRST.items()})
