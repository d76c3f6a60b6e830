"""Byte-level tokenising shared by the operators that run in Python workers, and narrow input selection."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill.sources.store import shared_folder

#: A-Z to a-z; digits, letters and every byte of a non-ASCII character stay; the rest is a blank.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text; null has none."""
    return text.translate(WORD_TABLE).split() if text else []


def fold(c: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column | str) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold_of(key: Column | str, n: int) -> Column:
    """crc32 of the key's text modulo n; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_rows(docs: DataFrame) -> DataFrame:
    """The rows as one struct `_row`, so that no name of theirs meets one of an operator; `_row.*` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, text as UTF-8 bytes; one slice of a batch is turned into objects at a time."""
    for batch in batches:
        cols = [c.cast(pa.large_binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in batch.columns]
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.slice(at, 256).to_pylist() for c in cols), strict=True)


def in_batches(found: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches."""
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema
    )


def per_row(f: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, size: int = 2048):
    """A function for mapInArrow from one on iterators of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(f(rows(batches)), schema, size)

    return run


#: A table is broadcast only if its measured size, as rows in memory, is no larger.
BROADCAST_BYTES = 16 << 20


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, marked for broadcast if it has been counted and fits; else joins with it shuffle, and give the same."""
    width = F.lit(16 * len(df.columns) + 32)
    for c, k in df.dtypes:
        if k in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
        elif k.startswith("array"):
            width = width + 64 * F.greatest(F.size(F.col(f"`{c}`")), F.lit(0))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


#: A key is hot if more than one in 2^HOT_SHARE of all rows have it, so there are no more than 2^HOT_SHARE of them.
HOT_SHARE = 16
LEAST_HOT = 16


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The hot keys of `rows`, with `_rows`, how many rows have each, and `_parts`, into how many they are dealt."""
    most = max(LEAST_HOT, rows.count() >> HOT_SHARE)
    hot = rows.groupBy(*on).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > most)
    return durable(hot.withColumn("_parts", F.ceil(F.col("_rows") / most).cast("int")))


def places(rows: DataFrame, parts: int = 1 << HOT_SHARE) -> DataFrame:
    """Rows with `_part`, by which equal rows are dealt; they have to come from files, so that a lost task finds them in the same places."""
    return rows.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))


def join_spread(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None, small: bool = True) -> DataFrame:
    """Rows joined with a written table that has each key once, however many rows have one key.

    Keys are broadcast if their measured size allows, unless they grow with the rows and so are not `small`. Else hot keys, which are few by their definition, are counted; their
    rows are dealt to parts and the key goes to each part; rows without a key, as it is null, are dealt too. Rows are
    dealt by the columns `by`, or by place, for which they have to come from files.
    """
    found = measured(keys) if small else keys
    if found is not keys:
        return rows.join(found, on, how)
    hot = F.broadcast(hot_keys(rows.select(*on), on).select(*on, "_parts"))
    lacks = F.lit(False)
    for c in on:
        lacks = lacks | F.col(c).isNull()
    dealt = rows.withColumn("_spread", F.xxhash64(*(by or [F.monotonically_increasing_id()])))
    salt = F.pmod("_spread", F.when(lacks, F.lit(1 << HOT_SHARE)).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")
    dealt = dealt.join(hot, on, "left").withColumn("_salt", salt).drop("_parts", "_spread")
    every = keys.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(every, [*on, "_salt"], how).drop("_salt")


def counted_once(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows with `copies`: rows equal in `by`, without nulls, of which there are too many are one row with their number, others have 1."""
    hot = hot_keys(rows.select(*by), by).select(*by, "_rows")
    if hot.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    hot = F.broadcast(hot)
    rest = [c for c in rows.columns if c not in by]
    once = rows.join(hot, by).groupBy(*by).agg(*[F.first(c).alias(c) for c in rest], F.first("_rows").alias("copies"))
    return rows.join(hot, by, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(once)


def each_copy(rows: DataFrame, copies: str = "copies") -> DataFrame:
    """Every row as often as its `copies` say, without that column; dealt out in two steps, so that no list is long."""
    n = F.col(copies)
    some = rows.filter(n > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 4096))).alias("_part"))
    some = some.withColumn("_n", F.least(F.lit(4096).cast("long"), n - F.col("_part") * 4096))
    return some.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")).drop("_part", "_n", "_copy", copies)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the shared folder, which survives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
