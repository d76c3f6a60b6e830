import hashlib

import pytest
from pyspark.sql import functions as F

from voltmill.functions import columns as c
from voltmill.operators import dims, ingest, jobs, lag, live
from voltmill.sources import fixtures

RAW = "meter_id string, household_id string, reading_time string, kwh string, received_at string"
T = "2014-01-13T10:00:00Z"

CASES = [
    (T, "75.5", "kwh_out_of_range", "kwh=75.5, expected [0.0,50.0]"),
    (T, "-3.0", "kwh_out_of_range", "kwh=-3.0, expected [0.0,50.0]"),
    (T, None, "missing_kwh", "kwh is null"),
    (T, "abc", "missing_kwh", "kwh='abc' not numeric"),
    ("not-a-timestamp", "1.0", "invalid_reading_time", "reading_time absent or unparseable"),
    (None, "1.0", "invalid_reading_time", "reading_time absent or unparseable"),
    ("not-a-timestamp", None, "invalid_reading_time", "reading_time absent or unparseable"),
    ("12:30", "1.0", "invalid_reading_time", "reading_time absent or unparseable"),
    ("2014", "1.0", "invalid_reading_time", "reading_time absent or unparseable"),
    (T, "NaN", "kwh_out_of_range", "kwh=nan, expected [0.0,50.0]"),
    (T, "inf", "kwh_out_of_range", "kwh=inf, expected [0.0,50.0]"),
    (T, "1d", "missing_kwh", "kwh='1d' not numeric"),
    (T, "true", "missing_kwh", "kwh='true' not numeric"),
    *[(T, k, None, None) for k in ("0", "50", "0.5", "1e1", " 3 ", "1_0", ".5")],
]


def test_validation(spark):
    df = spark.createDataFrame([("m", "h", t, k, T) for t, k, _, _ in CASES], RAW)
    got = [(r["rejection_type"], r["rejection_detail"]) for r in ingest.validate(df).collect()]
    assert got == [(a, b) for _, _, a, b in CASES]


def test_valid_and_rejected_are_all(spark):
    df = spark.createDataFrame([("m", "h", t, k, T) for t, k, _, _ in CASES] + [(None, "h", T, "1", T)], RAW)
    valid, rejected = ingest.split_valid(ingest.validate(df))
    assert (valid.count(), rejected.count()) == (7, 13)


def test_validation_finds_every_fault(spark):
    checked = ingest.validate(fixtures.faulty(fixtures.sample_readings(spark, 20, 48), every=3))
    got = {(r["fault"], r["rejection_type"]): r["count"] for r in checked.groupBy("fault", "rejection_type").count().collect()}
    assert set(got) == {(None, None), ("invalid_reading_time",) * 2, ("missing_kwh",) * 2, ("kwh_out_of_range",) * 2, ("below_range", "kwh_out_of_range")}
    assert 0.25 < 1 - got[None, None] / 960 < 0.42


def test_dead_messages_never_stop_a_batch(spark):
    good = '{"delivery_id":"d1","readings":[{"meter_id":"m","reading_time":"2014-01-13T10:00:00Z","kwh":1.5}],"ingest_time":"2014-01-13T10:01:00Z"}'
    df = spark.createDataFrame([(m,) for m in ("[1]", "7", "nonsense", '{"readings":null}', "{}", None, good)], "value string")
    p = ingest.parse_deliveries(df)
    assert p.filter("dead").count() == 6
    r = ingest.validate(ingest.flatten(p.filter("not dead"))).first()
    assert (r["delivery_id"], r["source"], r["kwh"], r["rejection_type"]) == ("d1", "live", 1.5, None)


def test_repeats_expire_from_the_first_sighting(spark):
    at = ["2014-01-01 00:00:00", "2014-01-01 23:00:00", "2014-01-01 23:59:59", "2014-01-02 00:00:00", "2014-01-02 01:00:00"]
    df = spark.createDataFrame([("a", "live", t, k, 1) for k, t in enumerate(at)] + [("b", "live", at[0], 9, 1)], "delivery_id string, source string, t string, seq long, reading_count int")
    marked = ingest.mark_repeats(df.withColumn("ingest_time", F.col("t").cast("timestamp")))
    assert {r["seq"]: r["repeat"] for r in marked.collect()} == {0: False, 1: True, 2: True, 3: False, 4: True, 9: False}
    log = ingest.duplicates_log(marked).collect()
    assert [(r["delivery_id"], r["repeats"]) for r in log] == [("a", 3)]


def test_content_hash(spark):
    rows = [{"meter_id": m, "reading_time": t, "kwh": "1"} for m, t in (("b", "2"), ("a", "9"), ("a", "1"))]
    df = spark.createDataFrame([(rows,)], "r array<struct<meter_id:string,reading_time:string,kwh:string>>")
    got = df.select(c.content_hash(F.col("r"), False).alias("x"), c.content_hash(F.col("r")).alias("y")).first()
    assert got["x"] == "bf_" + hashlib.sha256(b"a,1|a,9|b,2").hexdigest()[:16]
    assert got["x"] != got["y"]


@pytest.mark.parametrize("n,place", [(1, 1), (20, 19), (57, 54)])
def test_p95_place(spark, n, place):
    df = spark.range(n).select(F.lit("m").alias("meter_id"), F.lit("2014-01-01").cast("timestamp").alias("reading_time"), (F.lit("2014-01-01").cast("timestamp") + F.make_interval(secs=(F.col("id") + 1).cast("decimal(18,6)"))).alias("received_at"))
    assert lag.lag_stats(df).first()["p95_lag_sec"] == place


def test_smoothing(spark):
    df = spark.createDataFrame([("m", k, float(k), float(k), float(k)) for k in (1, 2, 3)], "meter_id string, b int, avg_lag_sec double, p95_lag_sec double, max_lag_sec double")
    r = lag.fold_lag(df, "b").first()
    assert round(r["avg_lag_sec"], 9) == 1.56 and r["max_lag_sec"] == 3
    one, two = df.filter("b = 1").drop("b"), df.filter("b = 2").drop("b")
    assert round(lag.upsert_lag(one, two).first()["avg_lag_sec"], 9) == 1.2


def test_negative_lag_is_ignored(spark):
    df = spark.createDataFrame([("m", "2014-01-01 10:00:00", "2014-01-01 09:00:00")], "meter_id string, a string, b string")
    assert lag.lags(df.select("meter_id", F.col("a").cast("timestamp").alias("reading_time"), F.col("b").cast("timestamp").alias("received_at"))).count() == 0


def test_forecast(spark):
    f = lambda kwh, seen, book: spark.range(1).select(live.forecast(F.lit(kwh), F.lit(seen), F.lit(book))).first()[0]
    assert f(900.0, 2540, 5083) == 1801.06
    assert f(900.0, 2540, 0) == 900.0
    assert f(900.0, 5083, 5083) == 900.0
    assert f(900.0, 6000, 5083) == 900.0


def test_buckets(spark):
    got = spark.createDataFrame([("2014-01-01 10:29:59",), ("2014-01-01 10:30:00",)], "t string").select(c.bucket(F.col("t").cast("timestamp")).cast("string")).collect()
    assert [r[0][11:16] for r in got] == ["10:00", "10:30"]


def test_window_rolls_forward_only(spark):
    data = [("a", "10:30:00", 1.0, 0), ("b", "10:00:00", 5.0, 1), ("c", "11:00:00", 2.0, 2), ("c", "10:30:00", 9.0, 2), ("d", "11:00:00", 3.0, 3), ("e", "10:59:00", 9.0, 4)]
    df = spark.createDataFrame([(m, f"2014-01-01 {t}", k, b) for m, t, k, b in data], "meter_id string, t string, kwh double, batch long").withColumn("reading_time", F.col("t").cast("timestamp"))
    r = live.rolling_window(df, spark.range(4)).first()
    assert (r["window_start"].hour, r["kwh"], r["meters"], r["forecast"]) == (11, 5.0, 2, 10.0)


def test_weather_hour(spark):
    data = [("X", "10:05", 1), ("FM-12", "10:20", 2), ("FM-12", "10:50", 3), ("X", "11:05", 4), ("Y", "11:20", 5)]
    df = spark.createDataFrame([(t, f"2014-01-01 {h}:00", float(o), o) for t, h, o in data], "report_type string, h string, temp_c double, o long").withColumn("observed_at", F.col("h").cast("timestamp"))
    assert {r["observed_at"].hour: r["o"] for r in dims.weather_hours(df, "o").collect()} == {10: 3, 11: 4}


def test_silence_is_strict(spark):
    df = spark.createDataFrame([("now", "12:00:00"), ("edge", "10:00:00"), ("silent", "09:59:59")], "meter_id string, t string").select("meter_id", F.concat(F.lit("2014-01-01 "), "t").cast("timestamp").alias("reading_time"))
    homes = spark.createDataFrame([("silent", "N1")], "meter_id string, postcode_area string")
    assert [(r["meter_id"], r["postcode_area"]) for r in jobs.silent_meters(df, homes).collect()] == [("silent", "N1")]


def test_archive_counts_each_reject_once(spark):
    now = F.lit("2014-01-10").cast("timestamp")
    df = spark.createDataFrame([(1, "2014-01-08", "2014-01-01 05:10:00", "a"), (2, "2014-01-08", None, "a"), (3, "2014-01-09 12:00:00", "2014-01-01 05:20:00", "a")], "id long, r string, t string, rejection_type string")
    df = df.select("id", "rejection_type", F.col("r").cast("timestamp").alias("rejected_at"), F.col("t").cast("timestamp").alias("reading_time"), F.lit(False).alias("archived"))
    summary = spark.createDataFrame([], "ts_hour timestamp, rejection_reason string, count long")
    for _ in range(2):
        taken = jobs.archivable(df, now)
        summary, df = jobs.roll_up(summary, taken), jobs.mark_archived(df, now)
    assert sorted((r["ts_hour"].day, r["count"]) for r in summary.collect()) == [(1, 1), (8, 1)]
    assert {r["id"] for r in jobs.purge(df, F.lit("2014-01-16").cast("timestamp"), 7).collect()} == {3}


def test_insert_if_absent_keeps_present_rows(spark):
    held = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert [tuple(r) for r in ingest.insert_if_absent(held, new, ["k"], ["v"]).collect()] == [("b", 3)]


def test_orphan_upsert(spark):
    kind = "meter_id string, first_seen int, last_seen int, reading_count long, total_kwh double"
    s, f = spark.createDataFrame([("a", 5, 6, 2, 1.0), ("c", 1, 1, 1, 1.0)], kind), spark.createDataFrame([("a", 3, 9, 7, 4.0), ("b", 1, 2, 3, 4.0)], kind)
    assert {tuple(r) for r in jobs.upsert_orphans(s, f).collect()} == {("a", 5, 9, 7, 4.0), ("b", 1, 2, 3, 4.0), ("c", 1, 1, 1, 1.0)}
    assert jobs.upsert_orphans(s, f, keep_first=False).filter("meter_id = 'a'").first()["first_seen"] == 3


def test_sessions(spark):
    df = spark.createDataFrame([(f"2014-01-01 {t}",) for t in ("10:00:00", "10:04:59", "10:09:58", "10:14:58", "10:30:00")], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert sorted((r["first_at"].minute, r["n"]) for r in live.sessions(df, "t").collect()) == [(0, 3), (14, 1), (30, 1)]


def test_zone_and_labels(spark):
    df = spark.createDataFrame([("2014-07-01 12:00:00",), ("2014-01-01 12:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("reading_time"))
    assert [r["reading_time"].hour for r in dims.to_utc(df).collect()] == [11, 12]
    homes = spark.range(3000).select(F.format_string("H%d", "id").alias("household_id"))
    share = {r[0]: r[1] / 3000 for r in dims.labelled(homes).groupBy("acorn_group").count().collect()}
    assert abs(share["Affluent"] - 0.3) < 0.05 and abs(share["Adversity"] - 0.4) < 0.05


def test_empty_tables(spark):
    none = spark.createDataFrame([], "meter_id string, reading_time timestamp, household_id string, kwh double, received_at timestamp, batch long, seq long")
    homes = spark.createDataFrame([], "meter_id string, postcode_area string")
    assert lag.lag_stats(none).count() == live.current_window(none, homes).count() == jobs.silent_meters(none, homes).count() == jobs.orphans(none, homes).count() == 0
