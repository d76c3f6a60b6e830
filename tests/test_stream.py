import json
import random
import time
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltmill import schemas
from voltmill.config import EngineConfig
from voltmill.operators import ingest, live, maintenance
from voltmill.plans import catalog, testbed, views
from voltmill.sources import archive, deliveries, fixtures
from voltmill.sources import store as st
from voltmill.sources.store import FACTS, Store
from voltmill.sources.tables import archive_pages, page_deliveries
from voltmill.streaming import health, pipeline


def message(delivery, readings, at="2014-01-13T10:00:00Z", source="live", **more):
    rows = [{"meter_id": m, "household_id": "h", "reading_time": t, "kwh": k, "received_at": r} for m, t, k, r in readings]
    return json.dumps({"delivery_id": delivery, "source": source, "readings": rows} | ({"ingest_time": at} if at else {}) | more)


T1, T2 = "2014-01-13T09:00:00Z", "2014-02-01T09:30:00Z"
BATCHES = [
    [message("d1", [("a", T1, 1.0, T1), ("b", T1, 2.0, T1), ("c", T1, 99, T1)]), "broken"],
    [message("d1", [("a", T1, 1.0, T1), ("b", T1, 2.0, T1), ("c", T1, 99, T1)]), message("d2", [("a", T1, 1.5, "2014-01-13T11:00:00Z"), ("a", T2, 7.0, T2)])],
    [message("d3", [("b", T1, 9.0, "2014-01-13T08:00:00Z"), ("b", T2, None, T2)], source="backfill")],
]
ONE_FILE = EngineConfig(files_per_trigger=1)


def feed(spark, tmp, batches, dedup=True, checkpoint="checkpoint", first=0):
    """Each list of messages as one file and one run of the stream."""
    (tmp / "in").mkdir(exist_ok=True)
    for k, lines in enumerate(batches):
        (tmp / "in" / f"{first + k}.txt").write_text("\n".join(lines))
        pipeline.start(deliveries.from_files(spark, str(tmp / "in"), ONE_FILE), str(tmp / "out"), available_now=True, dedup=dedup, checkpoint=str(tmp / checkpoint)).awaitTermination(180)
    return Store(spark, str(tmp / "out"))


def kwh(store):
    return {(r["meter_id"], r["reading_time"].month): r["kwh"] for r in store.facts().collect()}


EXPECTED = {("a", 1): 1.5, ("b", 1): 2.0, ("a", 2): 7.0}


def test_stream_with_restarts(spark, tmp_path):
    store = feed(spark, tmp_path, BATCHES)
    assert kwh(store) == EXPECTED
    fixed = store.read("meter_corrections_log").collect()
    assert [(r["meter_id"], r["old_kwh"], r["new_kwh"], r["delta"]) for r in fixed] == [("a", 1.0, 1.5, 0.5)]
    rejected = store.read("rejected_readings").collect()
    assert sorted(r["rejection_type"] for r in rejected) == ["kwh_out_of_range", "missing_kwh"]
    assert len({r["id"] for r in rejected} - {None}) == 2
    assert sorted(r["delivery_id"] for r in store.read("batch_log").collect()) == ["d1", "d2", "d3"]
    assert [r["delivery_id"] for r in store.read("batch_duplicates").collect()] == ["d1"]
    assert [r["value"] for r in store.read("dead_letters").collect()] == ["broken"]
    lags = {r["meter_id"]: r["avg_lag_sec"] for r in store.read("meter_lag_stats").collect()}
    assert {m: round(v, 6) for m, v in lags.items()} == {"a": 720.0, "b": 0.0}  # b's second lag is negative
    window = store.read("live_window").collect()
    assert [(r["window_start"].month, r["kwh"], r["meters"]) for r in window] == [(2, 7.0, 1)]


def test_without_dedup_the_merge_gives_the_same(spark, tmp_path):
    assert kwh(feed(spark, tmp_path, BATCHES, dedup=False)) == EXPECTED


def test_nothing_is_too_late(spark, tmp_path):
    """Deliveries far behind, without a time of ingestion or without an id all arrive; repeats of each do not."""
    odd = [message("late", [("a", T1, 1.0, T1)], at="2014-01-02T00:00:00Z"), message("untimed", [("b", T1, 2.0, T1)], at=None), message("wrong", [("c", T1, 3.0, T1)], at="yesterday")]
    nameless = [message("", [("d", T1, 4.0, T1)]), message("", [("e", T1, 5.0, T1)])]
    store = feed(spark, tmp_path, [[message("now", [("f", T1, 6.0, T1)], at="2014-01-20T00:00:00Z")], odd + nameless, odd + nameless])
    assert kwh(store) == {(m, 1): float(k) for k, m in enumerate("abcdef", 1)}
    assert store.read("batch_log").count() == 6 and store.read("batch_duplicates").count() == 5


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    store = feed(spark, tmp_path, BATCHES)
    more = [[message("d4", [("z", T1, 4.0, T1), ("a", T1, 3.5, "2014-01-14T00:00:00Z")])]]
    feed(spark, tmp_path, more, checkpoint="another", first=9)
    assert kwh(store) == EXPECTED | {("z", 1): 4.0, ("a", 1): 3.5}
    assert len(store.state()["batches"]) == 2
    views.register_store(store)
    assert spark.sql("SELECT count(*) AS n, count(DISTINCT delivery_id) AS d FROM batch_log").first()[:] == (4, 4)
    # the other stream starts with all files, so what it finds again is logged again, and changes no fact
    assert store.read("batch_log").count() == 3 + 4 and store.read("meter_corrections_log").count() == 2


def test_a_replayed_batch_does_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    batch = spark.createDataFrame([(m, 0, False) for m in BATCHES[0]], "value string, lane int, repeat boolean")
    for _ in range(2):
        pipeline.write_batch(batch, 0, store, "s")
    assert store.facts().count() == 2 and store.read("batch_log").count() == 1 and store.read("dead_letters").count() == 1
    pipeline.write_batch(batch, 0, store, "other")
    assert store.facts().count() == 2 and store.read("batch_log").count() == 2


def test_a_batch_that_dies_leaves_the_tables(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    batch = spark.createDataFrame([(m, 0, False) for m in BATCHES[0]], "value string, lane int, repeat boolean")
    with monkeypatch.context() as m:
        m.setattr(st.Transaction, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pipeline.write_batch(batch, 0, store, "s")
    assert store.state()["version"] == 0 and store.facts().count() == 0
    pipeline.write_batch(batch, 0, store, "s")
    assert store.facts().count() == 2 and store.vacuum() > 0 and store.facts().count() == 2


class Clock:
    """State and timers of one key, as the engine keeps them, by a clock that the test sets."""

    def __init__(self, now=0):
        self.now, self.value, self.until, self.timers = now, None, None, set()

    def getValueState(self, name, schema, ttl_ms=None):  # noqa: N802
        self.ttl_ms = ttl_ms
        return self

    def exists(self):
        return self.value is not None and (self.ttl_ms is None or self.now < self.until)

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.until = value, self.now + (self.ttl_ms or 0)

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs  # noqa: N815


def test_repeats_expire():
    """A key passes again once its time is over, from the last time that it passed; a clock that goes back drops nothing."""
    hour, clock, marks = 3_600_000, Clock(), pipeline.Sightings(24 * 3_600_000)
    marks.init(clock)

    def mark(at, n=1):
        clock.now = int(at * hour)
        return [r["repeat"] for r in marks.handleInputRows(("k",), iter([{"value": "v", "lane": 0}] * n), None)]

    assert mark(0, 2) == [False, True] and mark(23) == [True] and mark(23.9) == [True]
    assert mark(24, 2) == [False, True] and mark(25) == [True]
    assert mark(10) == [True] and mark(47.9) == [True] and mark(48) == [False]


def test_feeds_fall_silent():
    """A lane lives from its first delivery on until nothing came for its time to live, which each delivery begins anew."""
    clock, feed = Clock(1000), health.Feed(150, 60)
    feed.init(clock)
    deliver = lambda key: [tuple(r) for r in feed.handleInputRows((key,), iter([1, 2]), clock)]
    assert deliver("live") == [("live", "LIVE", 1000)] and clock.timers == {151_000}
    clock.now = 100_000
    assert deliver("live") == [] and clock.timers == {250_000}
    clock.now = 250_000
    assert [tuple(r) for r in feed.handleExpiredTimer(("live",), None, clock)] == [("live", "DEAD", 250_000)] and not clock.exists()
    fill = Clock(5)
    feed.init(fill)
    assert [tuple(r) for r in feed.handleInputRows(("backfill",), iter([1]), fill)] == [("backfill", "LIVE", 5)] and fill.timers == {60_005}


def test_health_of_a_stream(spark, tmp_path):
    """Before anything came the engine is not ready; then its lanes live and its batches are on record."""
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "out"))
    empty = health.health(store).first()
    assert (empty["feed"], empty["filling_gaps"], empty["ready"], empty["rows"]) == ("DEAD", False, False, 0)
    (tmp_path / "in" / "0.txt").write_text("\n".join([message("a", []), message("b", [], source="backfill"), "broken"]))
    listener = health.Progress(store)
    spark.streams.addListener(listener)
    try:
        health.start(deliveries.from_files(spark, str(tmp_path / "in")), store, str(tmp_path / "c"), available_now=True).awaitTermination(180)
        for _ in range(100):
            if store.folders("stream_progress"):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    now = health.health(store).first()
    assert (now["feed"], now["filling_gaps"], now["ready"], now["rows"]) == ("LIVE", True, True, 3)
    assert {r["source"]: r["status"] for r in store.read("feed_status").collect()} == {"live": "LIVE", "backfill": "LIVE"}


def test_live_tables_follow_every_batch(spark, tmp_path):
    """After each batch the window kept by changes is the one that all facts give, and so are the meters of the sketches."""
    store = Store(spark, str(tmp_path))
    t = store.begin()
    t.append("homes", spark.createDataFrame([(f"h{k}", f"m{k}", "N1", 2, "A", "Std") for k in range(5)], schemas.schema("homes")))
    t.commit()
    at = lambda m, h=9, d=13: f"2014-01-{d}T{h:02d}:{m:02d}:00Z"
    batches = [
        [message("1", [("m1", at(0), 1.1, at(1)), ("m2", at(10), 2.2, at(11)), ("m1", at(20), 0.3, at(21)), ("m1", at(0, 8), 9, at(1, 8))])],
        [message("2", [("m1", at(0), 5.5, at(40)), ("m2", at(10), 7.0, at(5)), ("m3", at(29), 0.1, at(30))])],  # one value gives way, one does not
        [message("3", [("m1", at(0), 4.0, at(50)), ("m4", at(30, 7), 1.0, at(31, 7))])],  # again, and an older half hour
        [message("4", [("m9", at(31), 2.5, at(32)), ("m1", at(0), 3.0, at(55))])],  # a newer half hour
        [message("5", [("m2", at(30), 1.0, at(33)), ("m9", at(31), None, at(40)), ("m9", at(31), 0.5, at(59))])],
    ]
    for k, lines in enumerate(batches):
        pipeline.write_batch(spark.createDataFrame([(m, 0, False) for m in lines], "value string, lane int, repeat boolean"), k, store, "s")
        kept, whole = (df.select("window_start", "kwh", "meters", "forecast").collect() for df in (store.read("live_window"), live.current_window(store.facts(), store.read("homes"))))
        assert kept == whole and len(kept) == 1, k
        meters = {r["window_start"]: r["meters"] for r in live.meters_kept(store.read("meter_sketches")).collect()}
        assert meters == {r["window_start"]: r["meters"] for r in live.windows(store.facts(), store.read("homes")).collect()}, k
    assert store.read("live_meters").count() == 2


def test_counters_run_on_until_it_is_quiet(spark):
    """Batch by batch the counters are those of sessions over all events."""
    rnd = random.Random(3)
    start, kept, events = datetime(2024, 1, 1, tzinfo=UTC), spark.createDataFrame([], schemas.schema("live_counters")), []
    for _ in range(6):
        start += timedelta(minutes=rnd.choice([1, 4, 5, 9]))
        batch = [(kind, rnd.randrange(3), start) for kind in ("duplicates", "invalid")]
        events += [(kind, at) for kind, n, at in batch for _ in range(n)]
        kept = live.continued(kept, spark.createDataFrame(batch, "kind string, n long, at timestamp"), 5)
        kept = spark.createDataFrame(kept.collect(), schemas.schema("live_counters"))
    for kind in ("duplicates", "invalid"):
        whole = live.sessions(spark.createDataFrame([(at,) for k, at in events if k == kind], "at timestamp"), "at", 5)
        assert sorted(tuple(r) for r in whole.collect()) == sorted((r["first_at"], r["last_at"], r["n"]) for r in kept.collect() if r["kind"] == kind)


def test_live_counts_go_by_arrival(spark, tmp_path):
    """Deliveries of one run are counted together by lane, whenever they say that they were made."""
    (tmp_path / "in").mkdir()
    lines = [message("a", [], at="2014-01-01T00:00:00Z"), message("b", [], at=None), message("c", [], source="backfill"), "broken"]
    (tmp_path / "in" / "0.txt").write_text("\n".join(lines))
    counts = pipeline.live_counts(deliveries.from_files(spark, str(tmp_path / "in")))
    counts.writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r["source"]: r["count"] for r in spark.table("live").collect()} == {"live": 2, "backfill": 1}


def test_json_types_of_values(spark):
    """True is a number of a reading, the text "true" is not."""
    body = '{"delivery_id":"d","readings":[%s]}' % ",".join('{"meter_id":"m","reading_time":"2014-01-13T10:00:00Z","kwh":%s}' % k for k in ("true", '"true"', "false", "1.5", '"1.5"', "null", "1e1", "[1]", '"x"'))
    from voltmill.operators import ingest

    parsed = ingest.parse_deliveries(spark.createDataFrame([(body,)], "value string"))
    got = [(r["kwh"], r["rejection_type"]) for r in ingest.validate(ingest.flatten(parsed)).orderBy("place").collect()]
    assert got == [(1.0, None), (None, "missing_kwh"), (0.0, None), (1.5, None), (1.5, None), (None, "missing_kwh"), (10.0, None), (None, "missing_kwh"), (None, "missing_kwh")]


def test_merges_are_compacted_and_months_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FOLDERS_A_TIER", 3)
    store = Store(spark, str(tmp_path), keep_seconds=0)
    for k in range(7):
        rows = [("a", "2014-01-13 09:00:00", "h", float(k), f"2014-01-13 {10 + k}:00:00"), (f"m{k}", "2014-02-01 09:00:00", "h", 1.0, None)]
        batch = spark.createDataFrame(rows, "meter_id string, t string, household_id string, kwh double, r string")
        batch = batch.select("meter_id", F.col("t").cast("timestamp").alias("reading_time"), "household_id", "kwh", F.col("r").cast("timestamp").alias("received_at"))
        t = store.begin()
        t.merge(batch, ["meter_id"], F.lit(datetime(2024, 1, 1 + k, tzinfo=UTC)))
        t.commit("s", k)
        store.compact()
    held = store.state()["tables"][FACTS]
    assert all(len(x) <= 4 for x in held.values()) and max(t for x in held.values() for _, t in x) >= 1
    assert {(r["meter_id"]): r["kwh"] for r in store.facts(["2014-01"]).collect()} == {"a": 6.0}
    assert store.facts().count() == 8 and store.read("meter_corrections_log").count() == 6
    assert all("month=2014-02" in f for f in store.folders(FACTS, ["2014-02"]))
    january = store.facts_between(datetime(2014, 1, 13, 9), datetime(2014, 1, 31))
    assert january.count() == 1 and all("month=2014-01" in f for f in january.inputFiles())
    assert store.facts_between(datetime(2013, 12, 1), datetime(2014, 2, 1, 9)).count() == 1
    names = set(store.files.names(f"{tmp_path}/{FACTS}"))
    t = store.begin()
    t.append("dead_letters", spark.createDataFrame([], schemas.schema("dead_letters")))
    t.commit()
    assert store.vacuum() > 0 and set(store.files.names(f"{tmp_path}/{FACTS}")) < names and store.facts().count() == 8


def test_writers_that_meet(spark, tmp_path):
    """Two appends both stay; two merges into one month don't both count."""
    store = Store(spark, str(tmp_path))
    row = spark.createDataFrame([("x", 0, datetime(2024, 1, 1))], schemas.schema("dead_letters"))
    one, two = store.begin(), store.begin()
    one.append("dead_letters", row)
    two.append("dead_letters", row)
    one.commit()
    two.commit()
    assert store.read("dead_letters").count() == 2
    batch = spark.createDataFrame([("a", datetime(2014, 1, 13, 9), "h", 1.0, None)], "meter_id string, reading_time timestamp, household_id string, kwh double, received_at timestamp")
    one, two = store.begin(), store.begin()
    one.merge(batch, ["meter_id"], F.current_timestamp())
    two.merge(batch, ["meter_id"], F.current_timestamp())
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()
    assert store.facts().count() == 1


def test_runs_of_maintenance(spark, tmp_path):
    """Silence, orphans and the archive on written tables; two runs count once, and a reject that comes meanwhile stays."""
    homes = spark.createDataFrame([("h", "a", "N1", 2, "A", "Std")], schemas.schema("homes"))
    store = Store(spark, str(tmp_path))
    t = store.begin()
    t.append("homes", homes)
    t.commit()
    lines = [message("d", [("a", T1, 1.0, T1), ("b", T1, 99, T1), ("b", "2014-01-13T08:00:00Z", 2.0, T1), ("c", "2014-01-13T06:00:00Z", 2.0, T1), ("c", None, 1.0, T1)])]
    batch = spark.createDataFrame([(m, 0, False) for m in lines], "value string, lane int, repeat boolean")
    day0 = datetime(2024, 1, 1, 12, tzinfo=UTC)
    pipeline.write_batch(batch, 0, store, "s", now=day0)
    later = F.lit(day0 + timedelta(days=2))
    for _ in range(2):
        maintenance.run_silence(store, later)
        maintenance.run_orphans(store)
        maintenance.run_archive(store, later)
    assert [(r["meter_id"], r["silent_hours"]) for r in maintenance.latest_silence(store).collect()] == [("c", 3.0)] * 2
    assert sorted(r["meter_id"] for r in store.read("orphan_meters_summary").collect()) == ["b", "c"]
    totals = lambda: sorted((r["ts_hour"].hour, r["rejection_reason"], r["count"]) for r in store.read("rejection_hourly_summary").collect())
    assert totals() == [(9, "kwh_out_of_range", 1), (12, "invalid_reading_time", 1)]
    assert all(r["archived"] for r in store.read("rejected_readings").collect())
    pipeline.write_batch(batch, 1, store, "s", now=day0 + timedelta(days=2))
    maintenance.run_archive(store, F.lit(day0 + timedelta(days=8)))  # the first two are past retention
    assert store.read("rejected_readings").count() == 2 and totals() == [(9, "kwh_out_of_range", 2)] + [(12, "invalid_reading_time", 1)] * 2
    views.register_store(store)
    assert spark.sql("SELECT count(*) AS n FROM clean_readings JOIN homes USING (meter_id)").first()["n"] == 1


def test_options_of_lanes():
    live, fill = (deliveries.sink_options("k:9092", lane) for lane in (deliveries.LIVE, deliveries.BACKFILL))
    assert (live["kafka.compression.type"], fill["kafka.compression.type"]) == ("lz4", "gzip")
    assert (live["kafka.linger.ms"], fill["kafka.linger.ms"]) == ("5", "100") and live["kafka.acks"] == fill["kafka.acks"] == "1"
    scan = deliveries.source_options("k:9092", config=EngineConfig(messages_per_trigger=7, files_per_trigger=9))
    assert scan["maxOffsetsPerTrigger"] == "7" and scan["startingOffsets"] == "earliest" and scan["failOnDataLoss"] == "false"


def test_a_disorderly_replay_gives_the_clean_history(spark, tmp_path):
    readings = fixtures.sample_readings(spark)
    start = F.lit("2014-01-13 00:00:00").cast("timestamp")
    sent = fixtures.disorderly(fixtures.replay(readings, start, 60.0, size=3), duplicates=0.3, shuffled=0.5, late=0.2, outage=(2, 4), late_s=5)
    assert sent.count() > fixtures.replay(readings, start, 60.0, size=3).count()
    assert fixtures.write_in_order(sent, str(tmp_path / "in"), 2.0) > 1
    pipeline.start(deliveries.from_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), available_now=True).awaitTermination(180)
    got = {(r["meter_id"], r["reading_time"]): r["kwh"] for r in Store(spark, str(tmp_path / "out")).facts().collect()}
    assert got == {(r["meter_id"], r["reading_time"]): r["kwh"] for r in readings.collect()}


def test_backfill_pages_cover_the_archive(spark, sf):
    r = testbed.readings(spark, sf)
    since = F.lit("2024-01-05 00:00:00").cast("timestamp")
    pages = archive_pages(r, since, 100)
    sizes = [x["count"] for x in pages.groupBy("page").count().orderBy("page").collect()]
    assert sum(sizes) == r.filter(F.col("reading_time") >= since).count() and all(s == 100 for s in sizes[:-1])
    made = page_deliveries(pages, F.current_timestamp())
    assert made.count() == len(sizes) and made.filter("delivery_id like 'bf\\_%'").count() == len(sizes)


def test_live_and_backfill_give_the_clean_history(spark, tmp_path):
    """Pulling the archive, twice, beside live deliveries ends where the archive alone does."""
    rows = [(f"m{k % 3}", "h", f"2014-01-{13 + k // 6} {10 + k % 6}:00:00", float(k), f"2014-01-{13 + k // 6} {11 + k % 6}:00:00") for k in range(18)]
    kept = spark.createDataFrame(rows, "meter_id string, household_id string, t string, kwh double, r string")
    kept = kept.select("meter_id", "household_id", F.col("t").cast("timestamp").alias("reading_time"), "kwh", F.col("r").cast("timestamp").alias("received_at"))
    base = str(tmp_path / "archive")
    kept.filter("kwh < 12").write.mode("append").parquet(base)
    pull = lambda: archive.pull(spark, base, str(tmp_path / "fill"), str(tmp_path / "cursor"), F.lit("2014-02-01 00:00:00"), limit=5).awaitTermination(120)
    pull()
    kept.filter("kwh >= 12").write.mode("append").parquet(base)
    pull()
    pull()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "live.txt").write_text(message("live-1", [(m, f"{t}Z".replace(" ", "T"), k, f"{r}Z".replace(" ", "T")) for m, _, t, k, r in rows[3:9]]))
    both = deliveries.from_files(spark, str(tmp_path / "in")).unionByName(deliveries.from_files(spark, str(tmp_path / "fill"), lane=deliveries.BACKFILL))
    pipeline.start(both, str(tmp_path / "out"), available_now=True).awaitTermination(180)
    store = Store(spark, str(tmp_path / "out"))
    got = {(r["meter_id"], r["reading_time"]): r["kwh"] for r in store.facts().collect()}
    assert got == {(r["meter_id"], r["reading_time"]): r["kwh"] for r in kept.collect()}
    assert store.read("batch_log").filter("source = 'backfill'").agg(F.sum("reading_count")).first()[0] == 18


def landed(spark, path):
    rows = spark.read.text(path).withColumn("lane", F.lit(1))
    return Counter((r["meter_id"], r["reading_time"], r["kwh"]) for r in ingest.validate(ingest.flatten(ingest.parse_deliveries(rows))).collect())


def test_the_archive_is_read_once(spark, tmp_path, monkeypatch):
    """Runs that end and one that dies read each row once, ties at the cursor and odd rows included; old files stay shut."""
    rnd = random.Random(1)
    day = lambda d, h, m: datetime(2014, 1, d, h, m, tzinfo=UTC)
    base, at = str(tmp_path / "archive"), dict(limit=7, task_rows=20)
    rows = [[(f"m{k % 9}", "h", day(1 + n * 3 + k // 40, k % 24, rnd.choice([0, 30])), float(n * 1000 + k), None) for k in range(100)] for n in range(3)]
    for n in (1, 2):  # the last time of a run goes on in the next one, with greater meters
        last = max(r[2] for r in rows[n - 1])
        rows[n] += [(f"n{k}", "h", last, float(9000 + 10 * n + k), None) for k in range(5)]
    rows[0] += [(None, "h", day(1, 1, 0), 1.0, None), ("m1", "h", None, 1.0, None)]
    landing, cursor = str(tmp_path / "in"), str(tmp_path / "cursor")
    whole = Counter()
    for n in range(3):
        spark.createDataFrame(rows[n], archive.READING_DDL.replace(":", " ")).repartition(3).write.mode("append").parquet(base)
        whole += Counter((m, t.astimezone().replace(tzinfo=None), k) for m, _, t, k, _ in rows[n] if m and t)
        if n == 1:  # a run that dies when its first task ends
            broken = archive.deliveries_of(archive.pages(spark, base, **at), F.lit("2014-02-01")).withColumn("bad", F.assert_true(F.size("readings") > 7))
            query = deliveries.to_messages(broken.filter("bad is null")).writeStream.format("text").option("path", landing).option("checkpointLocation", cursor).trigger(availableNow=True).start()
            with pytest.raises(Exception, match="readings"):
                query.awaitTermination(120)
        archive.pull(spark, base, landing, cursor, F.lit("2014-02-01"), **at).awaitTermination(120)
        assert landed(spark, landing) == whole
    archive.pull(spark, base, landing, cursor, F.lit("2014-02-01"), **at).awaitTermination(120)
    assert landed(spark, landing) == whole
    reader = archive.ArchiveReader({"path": base, "limit": "7", "taskRows": "20"})
    spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(spans) > 5 and sum(b.num_rows for s in spans for b in reader.read(s)) >= sum(whole.values()) // 7
    assert max(len(s.groups) for s in spans) < len(reader.known)  # a span opens the files of its time alone
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_runs_open_the_months_they_need(spark, tmp_path):
    """Silence, the last day and the last days open two months at most, of many."""
    store = Store(spark, str(tmp_path))
    for k, month in enumerate(["2013-10", "2013-11", "2013-12", "2014-01", "2014-02"]):
        rows = [(m, datetime.fromisoformat(f"{month}-05T09:00:00+00:00") + timedelta(hours=h), "h", 1.0, None) for m, h in (("a", 0), ("b", 5))]
        t = store.begin()
        t.merge(spark.createDataFrame(rows, "meter_id string, reading_time timestamp, household_id string, kwh double, received_at timestamp"), ["meter_id"], F.current_timestamp())
        t.commit("s", k)
    opened = lambda df: {f.split("month=")[1][:7] for f in df.inputFiles()}
    newest = store.newest()
    assert opened(store.facts_last(timedelta(days=30), newest)) <= {"2014-01", "2014-02", "2014-03"}
    assert opened(store.facts_last(timedelta(hours=24), newest)) == {"2014-02"}
    assert opened(maintenance.last_day(store)) == {"2014-02"}
    maintenance.run_silence(store, F.current_timestamp())
    assert [(r["meter_id"], r["silent_hours"]) for r in maintenance.latest_silence(store).collect()] == [("a", 5.0)]
    assert [r["total_kwh"] for r in maintenance.last_day(store).collect()] == [1.0, 1.0]


def test_rejects_leave_by_day(spark, tmp_path):
    """The archive writes the days of its cuts alone: days before are noted and never read again, and go unread."""
    store = Store(spark, str(tmp_path))
    day0 = datetime(2024, 1, 10, 12, tzinfo=UTC)
    for k in range(12):
        lines = [message(f"d{k}", [("a", T1, 99, T1), ("b", None, 1.0, T1)])]
        pipeline.write_batch(spark.createDataFrame([(m, 0, False) for m in lines], "value string, lane int, repeat boolean"), k, store, "s", now=day0 + timedelta(days=k))
    held = lambda: store.state()["tables"]["rejected_readings"]
    assert len(held()) == 12
    maintenance.run_archive(store, F.lit(day0 + timedelta(days=5)))
    first = held()
    assert len(first) == 12 and len(store.state()["archived_days"]) == 4 and store.read("rejected_readings").filter("archived").count() == 8
    maintenance.run_archive(store, F.lit(day0 + timedelta(days=5)))
    assert {d: p for d, p in held().items() if d != "2024-01-14"} == {d: p for d, p in first.items() if d != "2024-01-14"}
    maintenance.run_archive(store, F.lit(day0 + timedelta(days=11, hours=1)))
    assert min(held()) == "2024-01-15" and store.read("rejected_readings").count() == 14
    total = store.read("rejection_hourly_summary").agg(F.sum("count")).first()[0]
    assert total == 2 * 11
    late = spark.createDataFrame([(m, 0, False) for m in [message("z", [("a", T1, 98, T1)])]], "value string, lane int, repeat boolean")
    pipeline.write_batch(late, 99, store, "s", now=day0 + timedelta(days=6))  # by a clock that goes back
    maintenance.run_archive(store, F.lit(day0 + timedelta(days=11, hours=1)))
    assert store.read("rejection_hourly_summary").agg(F.sum("count")).first()[0] == 23


def test_dimensions_are_loaded_once(spark, tmp_path):
    """Households and weather hours that are there stay as they are; two loads that meet do not both count."""
    store = Store(spark, str(tmp_path))
    raw = spark.createDataFrame([("h1", "m1", "N1", 2, "A", "ToU"), ("h2", "m2", "N1", 3, "B", "x"), (None, "m3", "N1", 3, "B", "x")], schemas.schema("homes"))
    maintenance.load_homes(store, raw.filter("household_id = 'h1'"))
    maintenance.load_homes(store, raw.withColumn("household_size", F.lit(9)))
    assert {r["household_id"]: (r["household_size"], r["tariff_type"]) for r in store.read("homes").collect()} == {"h1": (2, "ToU"), "h2": (9, "Std")}
    hours = [(datetime(2014, 1, 1, 9, m, tzinfo=UTC), float(m), kind, m) for m, kind in ((5, "FM-15"), (20, "FM-12"), (50, "FM-15"))]
    weather = spark.createDataFrame(hours, "observed_at timestamp, temp_c double, report_type string, file_order long")
    maintenance.load_weather(store, weather, "file_order")
    maintenance.load_weather(store, weather.withColumn("temp_c", F.lit(-1.0)), "file_order")
    assert [(r["temp_c"], r["station"]) for r in store.read("weather_hourly").collect()] == [(20.0, "EGLL-Heathrow")]
    one, two = store.begin(), store.begin()
    seen = store.folders("homes")
    for t in (one, two):
        t.append("homes", raw.limit(0), seen)
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()


def test_a_feed_is_one_batch_of_many_files(spark, tmp_path):
    """The feed of the catalog's stream is written by all tasks, not by one, and each feed still is one batch."""
    store = Store(spark, str(tmp_path / "tables"))
    for k in range(2):
        lines = [(message(f"d{k}{i}", [("a", T1, float(i), f"2014-01-13T{9 + k:02d}:00:{i:02d}Z")]),) for i in range(6)]
        catalog._fed(store, spark.createDataFrame(lines, "value string").repartition(3), str(tmp_path))
        assert len(list((tmp_path / "in").glob("part-*"))) == 3 * (k + 1)
        assert list(store.state()["batches"].values()) == [k] and store.read("batch_log").count() == 6 * (k + 1)
    assert kwh(store) == {("a", 1): 5.0}


def test_partitions_of_a_feed_follow_cores_and_rows():
    assert catalog._parts(4, 1000) == 8 and catalog._parts(12, 1000) == 12 and catalog._parts(8, 36_000_000) == 16 and catalog._parts(12, 200_000_000) == 60


def test_each_file_of_facts_has_a_task(spark, tmp_path, monkeypatch):
    """A month of many rows is written as so many files as it has ROWS_A_FILE, not as one by the task that got their hashes."""
    monkeypatch.setattr(st, "ROWS_A_FILE", 100)
    at = F.when(F.col("id") < 600, "2014-01-13 09:00:00").otherwise("2014-02-01 09:00:00").cast("timestamp")
    rows = spark.range(650).select(F.concat(F.lit("m"), "id").alias("meter_id"), at.alias("reading_time"), F.lit("h").alias("household_id"), F.lit(1.0).alias("kwh"), at.alias("received_at"))
    store = Store(spark, str(tmp_path))
    t = store.begin()
    t.merge(rows, ["meter_id"], F.lit(datetime(2024, 1, 1, tzinfo=UTC)))
    t.commit()
    files = lambda m: len(store.facts([m]).inputFiles())
    assert (files("2014-01"), files("2014-02")) == (6, 1)
    assert store.facts(["2014-01"]).count() == 600 and store.facts(["2014-02"]).count() == 50


def test_a_batch_is_kept_once(spark, tmp_path, monkeypatch):
    """The readings of a batch are kept for the whole of it, so the merge keeps no second copy, and only dead messages keep their text."""
    kept, persist = [], type(spark.range(0)).persist

    def counted(df, *level):
        kept.append(df)
        return persist(df, *level)

    monkeypatch.setattr(type(spark.range(0)), "persist", counted)
    batch = spark.createDataFrame([(message("d", [("a", T1, 1.0, T1)]), 0, False), ("dead", 0, False)], "value string, lane int, repeat boolean")
    store = Store(spark, str(tmp_path))
    pipeline.write_batch(batch, 0, store, "s")
    assert [r["value"] for r in kept[0].collect() if r["value"] is not None] == ["dead"]
    assert len([df for df in kept if "place" in df.columns]) == 1
    assert kwh(store) == {("a", 1): 1.0} and [r["value"] for r in store.read("dead_letters").collect()] == ["dead"]
