"""An archive of readings as a stream of pages, and its pull into the backfill lane."""

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from voltmill.config import DEFAULT
from voltmill.functions.columns import content_hash
from voltmill.sources.deliveries import to_messages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TIME = pa.timestamp("us", tz="UTC")
READING = pa.schema([("meter_id", pa.string()), ("household_id", pa.string()), ("reading_time", TIME), ("kwh", pa.float64()), ("received_at", TIME)])
READING_DDL = "meter_id:string,household_id:string,reading_time:timestamp,kwh:double,received_at:timestamp"
SLOT = 30 * 60 * 1_000_000
#: Rows that one task reads and puts in order, about; a half hour is never parted.
TASK_ROWS = 500_000


@dataclass
class Span(InputPartition):
    """Rows after one cursor and up to another, and the row groups that may hold some; a cursor is a time and a meter."""

    after: tuple[int, str]
    upto: tuple[int, str]
    groups: list[tuple[str, int]]

    def __post_init__(self):
        super().__init__((self.after, self.upto))


class ArchiveReader(DataSourceStreamReader):
    """Parquet files of readings in order of (reading_time, meter_id), the last one read being the offset.

    The order of keys, not a place among all rows, is the cursor: what a run has read is never ranked or opened again.
    Footers say which row groups hold later rows and how many, and so into how many spans of time these are dealt; each
    is read and put in order by one task. Files whose times have no statistics may hold any time, so they are opened by
    every run; config.session writes such statistics. Rows that come to the archive behind the cursor are not seen.
    """

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("limit", DEFAULT.page_limit))
        self.start = {"time": int(options.get("since", 0)) - 1, "meter": ""}
        self.task_rows = int(options.get("taskRows", TASK_ROWS))
        self.known: dict[str, list[tuple[int, int, int]]] = {}

    def _files(self) -> tuple[fs.FileSystem, dict[str, list[tuple[int, int, int]]]]:
        """Least and greatest time and rows of each row group; footers of files seen before are not read again."""
        system, root = _located(self.path)
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = f.base_name
            if f.is_file and name.endswith(".parquet") and not name.startswith(("_", ".")) and f.path not in self.known:
                with system.open_input_file(f.path) as source:
                    meta = pq.read_metadata(source)
                at = meta.schema.to_arrow_schema().get_field_index("reading_time")
                held = []
                for k in range(meta.num_row_groups):
                    column = meta.row_group(k).column(at).statistics
                    if column is not None and column.has_min_max:
                        held.append((_micros(column.min), _micros(column.max), meta.row_group(k).num_rows))
                    else:  # no statistics: it may hold any time
                        held.append((-(1 << 62), 1 << 62, meta.row_group(k).num_rows))
                self.known[f.path] = held
        return system, self.known

    def initialOffset(self) -> dict:  # noqa: N802
        return self.start

    def latestOffset(self) -> dict:  # noqa: N802
        system, known = self._files()
        best: tuple[int, str] | None = None
        newest = max((hi for held in known.values() for _, hi, _ in held), default=None)
        for path, held in known.items():
            for k, (_, hi, _) in enumerate(held):
                if hi == newest:
                    rows = _rows(system, [(path, k)], None, None, ["reading_time", "meter_id"])
                    if len(rows):
                        last = rows.sort_by([("reading_time", "descending"), ("meter_id", "descending")]).slice(0, 1)
                        found = last.column("reading_time").cast(pa.int64())[0].as_py(), last.column("meter_id")[0].as_py()
                        best = max(best or found, found)
        best = max(best or (self.start["time"], ""), (self.start["time"], self.start["meter"]))
        return {"time": best[0], "meter": best[1]}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        after, upto = (start["time"], start["meter"]), (end["time"], end["meter"])
        _, known = self._files()
        groups = [(path, k, *held) for path, own in known.items() for k, held in enumerate(own) if held[1] >= after[0] and held[0] <= upto[0]]
        if not groups or after >= upto:
            return []
        first = max(after[0], min(g[2] for g in groups)) // SLOT
        slots = upto[0] // SLOT - first + 1
        parts = max(1, min(slots, -(-sum(g[4] for g in groups) // self.task_rows)))
        edges = [(first + slots * k // parts) * SLOT - 1 for k in range(1, parts)]
        cursors = [after, *((t, "\U0010ffff") for t in edges if t > after[0]), upto]
        return [Span(a, b, [(p, k) for p, k, lo, hi, _ in groups if hi >= a[0] and lo <= b[0]]) for a, b in zip(cursors, cursors[1:], strict=False)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        system, _ = _located(self.path)
        rows = _rows(system, partition.groups, partition.after, partition.upto, READING.names)
        rows = rows.sort_by([(c, "ascending") for c in ("reading_time", "meter_id", "kwh")]).combine_chunks()
        for at in range(0, len(rows), 64 * self.limit):
            some = rows.slice(at, 64 * self.limit).combine_chunks()
            cuts = [*range(0, len(some), self.limit), len(some)]
            readings = pa.StructArray.from_arrays([some.column(c).combine_chunks() if some.column(c).num_chunks != 1 else some.column(c).chunk(0) for c in READING.names], READING.names)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), readings)], ["readings"])


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _micros(t) -> int:
    return pa.scalar(t).cast(TIME if getattr(t, "tzinfo", None) else pa.timestamp("us")).cast(pa.int64()).as_py()


def _rows(system: fs.FileSystem, groups: list[tuple[str, int]], after: tuple[int, str] | None, upto: tuple[int, str] | None, columns: list[str]) -> pa.Table:
    """Rows of row groups, those without a time or a meter left out, between two cursors."""
    kinds = pa.schema([READING.field(c) for c in columns])
    out = [kinds.empty_table()]
    by: dict[str, list[int]] = {}
    for path, k in groups:
        by.setdefault(path, []).append(k)
    for path, own in by.items():
        with system.open_input_file(path) as source:
            table = pq.ParquetFile(source).read_row_groups(own, columns=columns)
        time = table.column("reading_time")
        table = table.select(columns).cast(kinds) if time.type == TIME else pa.table([_utc(table.column(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
        t, m = table.column("reading_time").cast(pa.int64()), table.column("meter_id")
        keep = pc.and_(pc.is_valid(t), pc.is_valid(m))
        if after is not None:
            keep = pc.and_(keep, pc.or_(pc.greater(t, after[0]), pc.and_(pc.equal(t, after[0]), pc.greater(m, after[1]))))
        if upto is not None:
            keep = pc.and_(keep, pc.or_(pc.less(t, upto[0]), pc.and_(pc.equal(t, upto[0]), pc.less_equal(m, upto[1]))))
        out.append(table.filter(pc.fill_null(keep, False)))
    return pa.concat_tables(out)


def _utc(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    """A column in the wanted type; times without a zone are in UTC."""
    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(column.type) and column.type.tz is None:
        return column.cast(pa.timestamp("us"), safe=False).cast(pa.int64()).cast(kind)
    return column.cast(kind, safe=False)


class ArchiveSource(DataSource):
    """`readings_archive`: pages of at most `limit` readings of the archive at `path`, from `since` (microseconds) on."""

    @classmethod
    def name(cls) -> str:
        return "readings_archive"

    def schema(self) -> str:
        return f"readings array<struct<{READING_DDL}>>"

    def streamReader(self, schema) -> ArchiveReader:  # noqa: N802
        return ArchiveReader(dict(self.options))


def pages(spark: SparkSession, path: str, limit: int = DEFAULT.page_limit, since: int = 0, task_rows: int = TASK_ROWS) -> DataFrame:
    """The pages of an archive as a stream."""
    spark.dataSource.register(ArchiveSource)
    return spark.readStream.format("readings_archive").options(limit=limit, since=since, taskRows=task_rows).load(path)


def deliveries_of(pages: DataFrame, ingest_time: Column, with_kwh: bool = True) -> DataFrame:
    """A delivery for each page, its id a hash of its content, so that a page that comes again is known as a repeat."""
    text = lambda r: F.struct(*[r[c].cast("string").alias(c) for c in READING.names])
    own = pages.select(F.transform("readings", text).alias("readings"))
    return own.select(content_hash(F.col("readings"), with_kwh).alias("delivery_id"), F.lit("backfill").alias("source"), ingest_time.cast("string").alias("ingest_time"), "readings")


def pull(spark: SparkSession, path: str, landing: str, checkpoint: str, ingest_time: Column | None = None, limit: int = DEFAULT.page_limit, since: int = 0, task_rows: int = TASK_ROWS) -> StreamingQuery:
    """Land what the archive has beyond the cursor as messages, and end; the checkpoint keeps the cursor.

    The cursor moves with the files that land, by the log of the file sink, so a run that dies is finished by the next
    one, and readers of `landing` see each page once.
    """
    made = deliveries_of(pages(spark, path, limit, since, task_rows), F.current_timestamp() if ingest_time is None else ingest_time)
    writer = to_messages(made).writeStream.format("text").option("path", landing).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
