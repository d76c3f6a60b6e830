"""The engine's tables in one folder: Parquet files, and a manifest that names the ones in force."""

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from itertools import accumulate
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill import schemas
from voltmill.operators.merge import KEY, corrections, outcome

FACTS = "clean_readings"
#: Sketches of a window become one where folders become one.
SKETCHES = "meter_sketches"
#: Rejects lie by the day on which they came; these days of theirs have been archived as a whole.
REJECTS, ARCHIVED = "rejected_readings", "archived_days"
#: As many folders of one tier of a table become one of the next tier, so a table has few and small ones stay rare.
FOLDERS_A_TIER = 8
#: Rows of facts of one file, about.
ROWS_A_FILE = 2_000_000
#: Manifests that stay, and seconds for which folders that are no longer named stay for readers that have them open.
KEEP = 20
KEEP_SECONDS = 3600


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, on one machine as in tests, a folder beside the warehouse."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


class Files:
    """Small files and folders of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession):
        sc = spark.sparkContext
        self.jvm, self.gateway, self.conf = sc._jvm, sc._gateway, sc._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file, seen whole or not at all; False if there is one already. The file system renames atomically."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        _, draft = self._at(f"{p.getParent().toString()}/.{uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        kinds = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(p), kinds)
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Store:
    """Tables under one folder.

    What a transaction writes is seen only once a new manifest names it, all of it at once, so a job that dies leaves
    every table as it was. Writers that meet take turns: the one that finds the next manifest taken applies its change
    to that one. Manifests say which batch each stream has finished, under the stream's own id, so a replayed batch does
    nothing, and a stream that begins anew with its first batch is none that has been here before.
    """

    def __init__(self, spark: SparkSession, base: str, keep_seconds: float = KEEP_SECONDS):
        self.spark, self.base, self.files, self.keep_seconds = spark, base, Files(spark), keep_seconds

    def state(self) -> dict:
        """The newest manifest: version, tables (name, part, folders with their tiers), batches, left folders."""
        at = f"{self.base}/_manifest"
        names = [n for n in self.files.names(at) if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.files.read(f"{at}/{max(names)}")) if names else {"version": 0, "tables": {}, "batches": {}, "left": []}

    def finished(self, stream: str, epoch: int) -> bool:
        return self.state()["batches"].get(stream, -1) >= epoch

    def commit(self, change: Callable[[dict], None]) -> None:
        while True:
            state = self.state()
            change(state)
            state["version"] += 1
            old = time.time() - self.keep_seconds
            gone = [p for at, p in state["left"] if at < old]
            state["left"] = [x for x in state["left"] if x[0] >= old]
            if self.files.create(f"{self.base}/_manifest/{state['version']:012d}.json", json.dumps(state)):
                break
        for p in gone:
            self.files.remove(f"{self.base}/{p}")
        self.files.remove(f"{self.base}/_manifest/{state['version'] - KEEP:012d}.json")

    def folders(self, name: str, parts: list[str] | None = None) -> list[str]:
        own = self.state()["tables"].get(name, {})
        return [f"{self.base}/{p}" for part, held in own.items() if parts is None or part in parts for p, _ in held]

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """Rows of a table, or of some of its parts; no row for a table that nobody has written yet.

        Only folders of these parts are listed, so months that no one asks for are never opened.
        """
        schema = schemas.schema(name)
        if name != FACTS:
            folders = self.folders(name, parts)
            return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        own = {part: held for part, held in self.state()["tables"].get(name, {}).items() if parts is None or part in parts}
        out = None
        for several in (False, True):  # a month of one folder has each key once
            folders = [f"{self.base}/{p}" for held in own.values() if (len(held) > 1) == several for p, _ in held]
            if folders:
                rows = _newest(self.spark.read.schema(f"{schemas.TABLES[name]}, _version long").parquet(*folders), several)
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def facts(self, months: list[str] | None = None) -> DataFrame:
        return self.read(FACTS, months)

    def newest(self) -> datetime | None:
        """Time of the newest fact; only its month is opened."""
        months = self.state()["tables"].get(FACTS, {})
        return self.facts([max(months)]).agg(F.max("reading_time")).first()[0] if months else None

    def facts_last(self, ago: timedelta, newest: datetime) -> DataFrame:
        """Facts of the time `ago` up to the newest one; months before that are never opened."""
        return self.facts_between(newest - ago, newest + timedelta(microseconds=1)).filter(F.col("reading_time") > F.lit(newest - ago))

    def facts_between(self, start: datetime, end: datetime) -> DataFrame:
        """Facts from `start` until before `end`; only the months between are opened."""
        lo, hi = start.astimezone(UTC), end.astimezone(UTC)  # as months go by UTC
        months = [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(lo.year * 12 + lo.month - 1, hi.year * 12 + hi.month)]
        return self.facts(months).filter((F.col("reading_time") >= F.lit(start)) & (F.col("reading_time") < F.lit(end)))

    def begin(self) -> "Transaction":
        return Transaction(self)

    def compact(self) -> None:
        """One folder in place of FOLDERS_A_TIER of a tier, for every part that has so many."""
        for name, parts in self.state()["tables"].items():
            for part, held in parts.items():
                for tier in sorted({t for _, t in held}):
                    own = [p for p, t in held if t == tier]
                    if len(own) >= FOLDERS_A_TIER:
                        self._merge(name, part, own, tier)

    def _merge(self, name: str, part: str, own: list[str], tier: int) -> None:
        t = self.begin()
        folders = [f"{self.base}/{p}" for p in own]
        if name == FACTS:
            rows = _newest(self.spark.read.schema(f"{schemas.TABLES[name]}, _version long").parquet(*folders), True, keep=True)
            to = t.put_facts(rows, {part: self.spark.read.parquet(*folders).count()})[part]  # from footers; older versions count too
        else:
            rows = self.spark.read.schema(schemas.schema(name)).parquet(*folders)
            to = t.put(name, rows.groupBy("window_start").agg(F.hll_union_agg("sketch").alias("sketch")) if name == SKETCHES else rows)

        def change(state: dict) -> None:
            held = state["tables"][name][part]
            state["tables"][name][part] = [[to, tier + 1]] + [x for x in held if x[0] not in own]
            state["left"] += [[time.time(), p] for p in own]

        self.commit(change)

    def vacuum(self) -> int:
        """Remove folders that no manifest in force names, which killed jobs leave; not while another job writes."""
        state = self.state()
        known = {p for parts in state["tables"].values() for held in parts.values() for p, _ in held} | {p for _, p in state["left"]}
        known |= {p.rsplit("/", 1)[0] for p in known}
        n = 0
        for name in schemas.TABLES:
            for folder in self.files.names(f"{self.base}/{name}"):
                if f"{name}/{folder}" not in known:
                    self.files.remove(f"{self.base}/{name}/{folder}")
                    n += 1
        return n


def _newest(rows: DataFrame, several: bool, keep: bool = False) -> DataFrame:
    """Of each key the row written last, where rows come from several folders of a month."""
    if several:
        values = [c for c in rows.columns if c not in KEY]
        rows = rows.groupBy(*KEY).agg(F.max_by(F.struct(*values), "_version").alias("r")).select(*KEY, "r.*")
    return rows if keep else rows.drop("_version")


def with_month(df: DataFrame, time: str = "reading_time") -> DataFrame:
    return df.withColumn("month", F.date_format(time, "yyyy-MM"))


class Transaction:
    """Folders that become parts of tables together, or not at all."""

    def __init__(self, store: Store):
        self.store, self.id = store, uuid4().hex
        self.changes: list[Callable[[dict], None]] = []

    def put(self, name: str, df: DataFrame) -> str:
        to = f"{name}/{self.id}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.schema(name)]).write.mode("overwrite").parquet(f"{self.store.base}/{to}")
        return to

    def put_facts(self, rows: DataFrame, months: dict[str, int]) -> dict[str, str]:
        """Rows with their _version as a folder for each month, in files of about ROWS_A_FILE rows, in order of time.

        Each file has a task of its own.
        """
        to = f"{FACTS}/{self.id}"
        files = {m: max(1, -(-n // ROWS_A_FILE)) for m, n in months.items()}
        own = lambda held: F.create_map(*[F.lit(x) for pair in held for x in pair])[F.col("month")]
        place = own(zip(files, accumulate(files.values(), initial=0))) + F.pmod(F.xxhash64("meter_id"), own(files.items()))
        dealt = with_month(rows).repartitionById(sum(files.values()), place.cast("int"))
        dealt.sortWithinPartitions("month", "reading_time", "meter_id").write.mode("overwrite").partitionBy("month").parquet(f"{self.store.base}/{to}")
        return {m: f"{to}/month={m}" for m in months}

    def append(self, name: str, df: DataFrame, seen: list[str] | None = None) -> None:
        """The rows beside those of the table; if it must not have others than those of the folders `seen`, RuntimeError at the commit."""
        to, base = self.put(name, df), self.store.base

        def change(state: dict) -> None:
            held = state["tables"].setdefault(name, {}).setdefault("", [])
            if seen is not None and not {f"{base}/{p}" for p, _ in held} <= set(seen):
                raise RuntimeError(f"another run has changed {name}")
            held.append([to, 0])

        self.changes.append(change)

    def put_days(self, name: str, df: DataFrame, at: str) -> dict[str, str]:
        """Rows as a folder for each day of the time `at`."""
        to = f"{name}/{self.id}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.schema(name)]).withColumn("day", F.date_format(at, "yyyy-MM-dd"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.store.base}/{to}")
        return {f.removeprefix("day="): f"{to}/{f}" for f in self.store.files.names(f"{self.store.base}/{to}") if f.startswith("day=")}

    def append_days(self, name: str, df: DataFrame, at: str) -> None:
        """Rows to the days on which they came; a day that gets some is not archived as a whole."""
        days = self.put_days(name, df, at)

        def change(state: dict) -> None:
            for day, to in days.items():
                state["tables"].setdefault(name, {}).setdefault(day, []).append([to, 0])
            state[ARCHIVED] = [d for d in state.get(ARCHIVED, []) if d not in days]

        self.changes.append(change)

    def replace_days(self, name: str, df: DataFrame | None, at: str, read: dict[str, list[str]], archived: list[str]) -> None:
        """The rows instead of the folders that have been `read`, by day; days that have none left leave. Other folders stay."""
        days, base = self.put_days(name, df, at) if df is not None else {}, self.store.base

        def change(state: dict) -> None:
            own = state["tables"].setdefault(name, {})
            for day, folders in read.items():
                held = own.pop(day, [])
                if not set(folders) <= {f"{base}/{p}" for p, _ in held}:
                    raise RuntimeError(f"another run has changed {name} of {day}")
                more = [x for x in held if f"{base}/{x[0]}" not in folders]
                state["left"] += [[time.time(), p] for p, _ in held if f"{base}/{p}" in folders]
                if day in days or more:
                    own[day] = [[days[day], 0]] * (day in days) + more
            whole = [d for d in archived if d in days and len(own[d]) == 1]  # nothing has come meanwhile
            state[ARCHIVED] = sorted(d for d in {*state.get(ARCHIVED, []), *whole} if d in own)

        self.changes.append(change)

    def replace(self, name: str, df: DataFrame, read: list[str] | None = None) -> None:
        """The rows instead of a table's, or instead of those of the folders that have been `read`; others stay."""
        to, base = self.put(name, df), self.store.base

        def change(state: dict) -> None:
            held = state["tables"].setdefault(name, {}).get("", [])
            if read is not None and not set(read) <= {f"{base}/{p}" for p, _ in held}:
                raise RuntimeError(f"another run has changed {name}")
            old = [x for x in held if read is None or f"{base}/{x[0]}" in read]
            state["tables"][name][""] = [[to, 0]] + [x for x in held if x not in old]
            state["left"] += [[time.time(), p] for p, _ in old]

        self.changes.append(change)

    def merge(self, batch: DataFrame, order: list[str], now: Column, then: Callable[[DataFrame], None] | None = None, held: bool = False) -> None:
        """Merge readings into the facts, and log the values that gave way; `then` gets the rows that change, while they are held.

        The batch is read twice, so it is kept meanwhile, unless its rows are `held` already.

        Only the months of the batch are read, of them only rows between its first and last time, and only rows that
        change are written; readers take the last version of a key. A null meter or time leaves. RuntimeError at the
        commit if another batch has come between in one of the months: the batch then has to be run again.
        """
        store = self.store
        keyed = batch.filter("meter_id is not null and reading_time is not null")
        if not held:
            keyed.persist()
        try:
            spans = with_month(keyed).groupBy("month").agg(F.min("reading_time").alias("lo"), F.max("reading_time").alias("hi"), F.count("*").alias("n")).collect()
            if not spans:
                return
            months = {r["month"]: r["n"] for r in spans}
            lo, hi = min(r["lo"] for r in spans), max(r["hi"] for r in spans)
            seen = set(store.folders(FACTS, list(months)))
            stored = store.facts(list(months)).filter(F.col("reading_time").between(F.lit(lo), F.lit(hi)))
            merged = outcome(stored, keyed, order, now).filter("changed").persist()
            try:
                version = store.state()["version"] + 1
                to = self.put_facts(merged.select(*schemas.schema(FACTS).names, F.lit(version).cast("long").alias("_version")), months)
                self.append("meter_corrections_log", corrections(merged, now))
                if then is not None:
                    then(merged)
            finally:
                merged.unpersist()
        finally:
            if not held:
                keyed.unpersist()
        written = set(store.files.names(f"{store.base}/{FACTS}/{self.id}"))

        def change(state: dict) -> None:
            own = state["tables"].setdefault(FACTS, {})
            for m, p in to.items():
                if any(tier == 0 and f"{store.base}/{held}" not in seen for held, tier in own.get(m, [])):
                    raise RuntimeError(f"another batch has changed {m}")
                if f"month={m}" in written:
                    own.setdefault(m, []).append([p, 0])

        self.changes.append(change)

    def commit(self, stream: str | None = None, epoch: int | None = None) -> None:
        def change(state: dict) -> None:
            for c in self.changes:
                c(state)
            if stream is not None:
                state["batches"][stream] = max(epoch, state["batches"].get(stream, -1))

        self.store.commit(change)
