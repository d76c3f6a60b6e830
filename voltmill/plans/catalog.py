"""Every query of the engine on the test tables, with DuckDB SQL for it where SQL can express it."""

from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill.config import STATE_STORE, EngineConfig
from voltmill.functions.columns import content_hash, exact_sum
from voltmill.operators import dims, ingest, jobs, lag, live, maintenance, merge
from voltmill.plans import analytics, views
from voltmill.plans import testbed as t
from voltmill.sources import archive, deliveries, fixtures, tables
from voltmill.sources.store import Store, shared_folder
from voltmill.streaming import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _ts(text: str):
    return F.lit(text).cast("timestamp")


BUCKET = "time_bucket(INTERVAL '30 minutes', reading_time)"
SUM = "CAST(sum(CAST({} AS DECIMAL(28,9))) AS DOUBLE)".format
ROUND = "CAST(round(CAST({} AS DECIMAL(28,9)), {}) AS DOUBLE)".format
KWH = SUM("kwh")
_NOW = "2024-01-31 00:00:00"


# Analyst queries


@query(f"""WITH {t.FACTS}
SELECT {BUCKET} AS window_start, {ROUND(KWH, 2)} AS total_kwh, count(DISTINCT meter_id) AS meters_reporting, {ROUND(f"{KWH} / count(kwh)", 4)} AS avg_kwh_per_reading
FROM facts WHERE reading_time >= TIMESTAMP '2024-01-13 17:00:00' AND reading_time < TIMESTAMP '2024-01-13 22:00:00' GROUP BY 1 ORDER BY 1""")
def q1_half_hour(spark, sf):
    return analytics.half_hours(t.facts(spark, sf), _ts("2024-01-13 17:00:00"), _ts("2024-01-13 22:00:00"))


@query(f"""WITH {t.FACTS}, {t.HOMES}
SELECT household_id, meter_id, postcode_area, acorn_group, tariff_type, {ROUND(KWH, 3)} AS total_kwh_day, count(reading_time) AS readings_count
FROM (SELECT meter_id, reading_time, kwh FROM facts) JOIN homes USING (meter_id)
WHERE reading_time >= TIMESTAMP '2024-01-13' AND reading_time < TIMESTAMP '2024-01-14'
GROUP BY ALL ORDER BY total_kwh_day DESC, meter_id LIMIT 10""")
def q2_top_households(spark, sf):
    return analytics.top_households(t.facts(spark, sf), t.homes(spark, sf), _ts("2024-01-13 00:00:00"), _ts("2024-01-14 00:00:00"))


_Q3 = f"""WITH {t.FACTS}, {t.HOMES},
daily AS (SELECT meter_id, CAST(reading_time AS DATE) AS d, {KWH} AS day_kwh FROM facts {{}} GROUP BY 1, 2)
SELECT coalesce(acorn_group, 'Unknown') AS acorn_group, CASE WHEN tariff_type = 'ToU' THEN 'ToU' ELSE 'Std' END AS tariff_type, count(DISTINCT meter_id) AS meter_count,
  {ROUND(SUM("day_kwh") + " / count(day_kwh)", 3)} AS avg_daily_kwh, {ROUND("min(day_kwh)", 3)} AS min_daily_kwh, {ROUND("max(day_kwh)", 3)} AS max_daily_kwh
FROM daily JOIN homes USING (meter_id) GROUP BY 1, 2"""


@query(_Q3.format(""))
def q3_segment_daily(spark, sf):
    return analytics.segment_days(t.facts(spark, sf), t.homes(spark, sf))


@query(_Q3.format("WHERE reading_time > (SELECT max(reading_time) FROM facts) - INTERVAL 7 DAY"))
def q3_segment_recent(spark, sf):
    return analytics.segment_days(t.facts(spark, sf), t.homes(spark, sf), days=7)


@query(f"""WITH {t.FACTS}, {t.HOMES}
SELECT CAST(reading_time AS DATE) AS reading_date, count(DISTINCT meter_id) AS meters_reporting, (SELECT count(*) FROM homes) AS total_known_meters,
  {ROUND("CAST(100.0 AS DOUBLE) * count(DISTINCT meter_id) / nullif((SELECT count(*) FROM homes), 0)", 1)} AS coverage_pct
FROM facts GROUP BY 1""")
def q4_coverage(spark, sf):
    return analytics.coverage(t.facts(spark, sf), t.homes(spark, sf))


_NIGHT = SUM("CASE WHEN extract(hour FROM reading_time) < 6 THEN kwh ELSE 0 END")
_PCT = f"CAST(100.0 AS DOUBLE) * {_NIGHT} / nullif({KWH}, 0)"
_Q5 = f"""WITH {t.FACTS}, {t.HOMES}
SELECT {{}}count(DISTINCT meter_id) AS tou_meter_count, {ROUND(KWH, 2)} AS total_kwh, {ROUND(_NIGHT, 2)} AS off_peak_kwh, {ROUND(_PCT, 2)} AS off_peak_pct, {ROUND(_PCT + " - 25.0::DOUBLE", 2)} AS shift_vs_uniform_pct
FROM (SELECT meter_id, reading_time, kwh FROM facts) JOIN homes USING (meter_id) WHERE tariff_type = 'ToU'{{}}"""


@query(_Q5.format("", ""))
def q5_offpeak(spark, sf):
    return analytics.off_peak(t.facts(spark, sf), t.homes(spark, sf))


@query(_Q5.format("CAST(reading_time AS DATE) AS reading_date, ", " GROUP BY 1"))
def q5_offpeak_daily(spark, sf):
    return analytics.off_peak(t.facts(spark, sf), t.homes(spark, sf), daily=True)


_HOURLY = t.WEATHER + ", weather_hourly AS (SELECT date_trunc('hour', observed_at) AS observed_at, arg_min(temp_c, file_order) AS temp_c FROM weather GROUP BY 1)"


@query(f"""WITH {t.FACTS}, {_HOURLY},
daily AS (
  SELECT CAST(reading_time AS DATE) AS reading_date, {ROUND(SUM("temp_c") + " / count(temp_c)", 1)} AS avg_temp_c, {ROUND(KWH, 0)} AS total_kwh, count(DISTINCT meter_id) AS meters_reporting
  FROM facts JOIN weather_hourly ON observed_at = date_trunc('hour', reading_time) GROUP BY 1)
SELECT *, {ROUND("corr(avg_temp_c, total_kwh) OVER ()", 3)} AS r_temp_kwh FROM daily""")
def q6_temp_corr(spark, sf):
    hourly = t.weather(spark, sf).groupBy(F.date_trunc("hour", "observed_at").alias("observed_at")).agg(F.min_by("temp_c", "file_order").alias("temp_c"))
    return analytics.temperature(t.facts(spark, sf), hourly)


# Panels


@query(f"""WITH {t.FACTS}
SELECT {BUCKET} AS time, {KWH} AS total_kwh FROM facts WHERE reading_time > (SELECT max(reading_time) FROM facts) - INTERVAL 24 HOUR GROUP BY 1""")
def d8_slots_24h(spark, sf):
    return analytics.slots_last_day(t.facts(spark, sf))


@query(f"""WITH {t.REJECTS}
SELECT date_trunc('hour', reading_time) AS time, rejection_type AS metric, count(*) AS value FROM rejects
WHERE reading_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def d9_reject_hourly(spark, sf):
    return analytics.rejects_hourly(t.rejects(spark, sf), _ts("2024-01-10 00:00:00"), _ts("2024-01-20 00:00:00"))


_SILENT = """silent AS (
  SELECT meter_id, postcode_area, last_seen, epoch_us(now - last_seen) / 1e6 / 3600 AS silent_hours
  FROM (SELECT meter_id, max(reading_time) AS last_seen FROM facts WHERE reading_time > (SELECT max(reading_time) FROM facts) - INTERVAL 30 DAY GROUP BY 1)
  LEFT JOIN homes USING (meter_id), (SELECT max(reading_time) AS now FROM facts)
  WHERE epoch_us(now - last_seen) / 1e6 > 7200)"""


@query(f"WITH {t.FACTS}, {t.HOMES}, {_SILENT} SELECT * FROM silent")
def silence(spark, sf):
    return jobs.silent_meters(t.facts(spark, sf), t.homes(spark, sf))


@query(f"""WITH {t.FACTS}, {t.HOMES}, {_SILENT}
SELECT meter_id, postcode_area, last_seen, {ROUND("silent_hours", 1)} AS silent_hours, TIMESTAMP '{_NOW}' AS detected_at FROM silent ORDER BY silent_hours DESC, meter_id LIMIT 50""")
def d10_silent_top(spark, sf):
    return analytics.silent_top(jobs.silence_rows(jobs.silent_meters(t.facts(spark, sf), t.homes(spark, sf)), _ts(_NOW)))


def _log(spark, sf):
    return t.readings(spark, sf).select(F.col("received_at").alias("logged_at"))


@query(f"WITH {t.READINGS} SELECT max(received_at) AS last_delivery FROM readings")
def d11_last_delivery(spark, sf):
    return analytics.last_delivery(_log(spark, sf))


@query(f"""WITH {t.READINGS}
SELECT count(*) FILTER (WHERE received_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 5 MINUTE) AS last_5_min,
  {ROUND("count(*) FILTER (WHERE received_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 60 MINUTE) / 12.0::DOUBLE", 1)} AS baseline_5_min FROM readings""")
def d12_delivery_baseline(spark, sf):
    return analytics.delivery_rate(_log(spark, sf), _ts("2024-01-30 12:00:00"))


_BAND = "CASE WHEN {0} IS NULL THEN 'none' WHEN {0} >= {2} THEN 'high' WHEN {0} >= {1} THEN 'warn' ELSE 'ok' END".format
_WINDOWS = f"""book AS (SELECT count(*) AS book FROM homes),
windows AS (
  SELECT {BUCKET} AS window_start, {KWH} AS kwh, count(DISTINCT meter_id) AS meters FROM facts GROUP BY 1),
forecasts AS (
  SELECT window_start, kwh, meters, CASE WHEN book > 0 AND meters > 0 THEN {ROUND("kwh / least(meters / book, 1.0::DOUBLE)", 2)} ELSE kwh END AS forecast FROM windows, book)"""


@query(f"""WITH {t.FACTS}, {t.HOMES}, {_WINDOWS}
SELECT window_start, {_BAND("kwh", 4118, 4575)} AS kwh_band, {_BAND("forecast", 9720, 10800)} AS forecast_band,
  CASE WHEN meters >= 4900 THEN 'ok' WHEN meters >= 4500 THEN 'warn' ELSE 'low' END AS meters_band FROM forecasts""")
def threshold_bands(spark, sf):
    return live.banded(live.windows(t.facts(spark, sf), t.homes(spark, sf)))


@query(f"""WITH {t.READINGS}
SELECT max(reading_time) AS last_delivery, CASE WHEN epoch_us(TIMESTAMP '2024-01-30 23:58:00' - max(reading_time)) / 1e6 < 150 THEN 'LIVE' ELSE 'DEAD' END AS feed,
  coalesce(epoch_us(TIMESTAMP '2024-01-30 23:58:00' - max(reading_time) FILTER (WHERE source = 'backfill')) / 1e6 < 60, false) AS filling_gaps FROM readings""")
def feed_liveness(spark, sf):
    return live.feed_status(t.sightings(spark, sf), _ts("2024-01-30 23:58:00"))


# Validation and flattening


@query(f"""WITH {t.RAW}
SELECT coalesce(rejection_type, 'valid') AS outcome, source, count(*) AS n, count(DISTINCT meter_id) AS meters FROM validated GROUP BY 1, 2""")
def validate_split(spark, sf):
    checked = ingest.validate(t.raw_readings(spark, sf)).filter("rejection_type is not null or meter_id is not null")
    return checked.groupBy(F.coalesce("rejection_type", F.lit("valid")).alias("outcome"), "source").agg(F.count("*").alias("n"), F.countDistinct("meter_id").alias("meters"))


@query(f"WITH {t.RAW} SELECT event_id, reading_time, raw AS kwh_raw, rejection_type, rejection_detail FROM validated WHERE rejection_type IS NOT NULL")
def validate_detail(spark, sf):
    rejected = ingest.split_valid(ingest.validate(t.raw_readings(spark, sf)))[1]
    return rejected.select("event_id", "reading_time", "kwh_raw", "rejection_type", "rejection_detail")


def _deliveries(spark, sf):
    row = F.struct("meter_id", "household_id", "reading_time", "kwh", "received_at")
    by = t.raw_readings(spark, sf).groupBy(F.floor(F.col("event_id") / 10).alias("d")).agg(F.array_sort(F.collect_list(F.struct("event_id", row.alias("r")))).alias("rs"), F.min("source").alias("source"))
    return by.select(F.concat(F.lit("d"), "d").alias("delivery_id"), F.when(F.col("d") % 2 == 0, F.col("source")).alias("source"), F.lit("2024-02-01T00:00:00").alias("ingest_time"), F.col("rs.r").alias("readings"))


@query(f"""WITH {t.RAW}
SELECT 'd' || (event_id // 10) AS delivery_id, CASE WHEN (event_id // 10) % 2 = 0 THEN min(source) OVER (PARTITION BY event_id // 10) ELSE 'live' END AS source,
  CAST(event_id % 10 AS INTEGER) AS place, meter_id, raw AS kwh FROM raw""")
def flatten_deliveries(spark, sf):
    parsed = ingest.parse_deliveries(deliveries.to_messages(_deliveries(spark, sf)))
    return ingest.flatten(parsed.filter("not dead")).select("delivery_id", "source", "place", "meter_id", "kwh")


# Merge


@query(f"""WITH {t.READINGS}, hours AS (SELECT *, date_trunc('hour', reading_time) AS h FROM readings)
SELECT meter_id, h AS reading_time, arg_max(household_id, (received_at, event_id)) AS household_id, arg_max(kwh, (received_at, event_id)) AS kwh, max(received_at) AS received_at
FROM hours GROUP BY 1, 2""")
def merge_latest(spark, sf):
    return merge.latest(t.readings(spark, sf).withColumn("reading_time", F.date_trunc("hour", "reading_time")), "event_id")


_FOLD = (
    t.UPDATES
    + """,
winners AS (
  SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY meter_id, reading_time, batch ORDER BY received_at DESC NULLS LAST, event_id DESC) = 1),
steps AS (
  SELECT meter_id, reading_time, list({'i': batch, 'h': household_id, 'k': kwh, 'r': received_at, 'log': CAST([] AS STRUCT(i BIGINT, o DOUBLE, n DOUBLE)[])} ORDER BY batch) AS s
  FROM winners GROUP BY 1, 2),
folded AS (
  SELECT meter_id, reading_time, list_reduce(s, lambda a, x: CASE
    WHEN coalesce(x.r > a.r, false) OR (x.r IS NOT DISTINCT FROM a.r AND x.i > a.i AND x.k IS DISTINCT FROM a.k)
    THEN {'i': x.i, 'h': x.h, 'k': x.k, 'r': x.r, 'log': CASE WHEN x.k IS DISTINCT FROM a.k THEN list_append(a.log, {'i': x.i, 'o': a.k, 'n': x.k}) ELSE a.log END}
    ELSE a END) AS e
  FROM steps)"""
)


@query(f"WITH {_FOLD} SELECT meter_id, reading_time, e.i AS ingested_at, e.h AS household_id, e.k AS kwh, e.r AS received_at FROM folded")
def merge_conditional(spark, sf):
    return merge.fold_batches(t.updates(spark, sf), "batch", ["event_id"]).drop("log")


@query(f"WITH {_FOLD}, logs AS (SELECT meter_id, reading_time, unnest(e.log) AS l FROM folded) SELECT meter_id, reading_time, l.i AS batch, l.o AS old_kwh, l.n AS new_kwh, l.n - l.o AS delta FROM logs")
def corrections_log(spark, sf):
    logged = merge.fold_batches(t.updates(spark, sf), "batch", ["event_id"]).select("meter_id", "reading_time", F.explode("log").alias("l"))
    return logged.select("meter_id", "reading_time", F.col("l.ingested_at").alias("batch"), "l.old_kwh", "l.new_kwh", (F.col("l.new_kwh") - F.col("l.old_kwh")).alias("delta"))


_HALVES = t.UPDATES + """,
target AS (
  SELECT meter_id, reading_time, household_id, kwh, received_at FROM updates WHERE batch % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY meter_id, reading_time ORDER BY received_at DESC NULLS LAST, event_id DESC) = 1),
incoming AS (
  SELECT meter_id, reading_time, household_id, kwh, received_at FROM updates WHERE batch % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY meter_id, reading_time ORDER BY received_at DESC NULLS LAST, event_id DESC) = 1),
joined AS (
  SELECT coalesce(c.meter_id, e.meter_id) AS meter_id, coalesce(c.reading_time, e.reading_time) AS reading_time, c.meter_id IS NOT NULL AS had, c.kwh AS old_kwh,
    e.meter_id IS NOT NULL AND (c.meter_id IS NULL OR coalesce(e.received_at > c.received_at, false) OR (e.received_at IS NOT DISTINCT FROM c.received_at AND e.kwh IS DISTINCT FROM c.kwh)) AS wins,
    c.kwh AS ck, e.kwh AS ek, c.received_at AS cr, e.received_at AS er
  FROM target c FULL JOIN incoming e ON c.meter_id = e.meter_id AND c.reading_time = e.reading_time)"""


@query(f"WITH {_HALVES} SELECT meter_id, reading_time, CASE WHEN wins THEN ek ELSE ck END AS kwh, CASE WHEN wins THEN er ELSE cr END AS received_at, old_kwh, wins AND had AS replaced FROM joined")
def merge_batch(spark, sf):
    u = t.updates(spark, sf)
    target = merge.newest_in_batch(u.filter("batch % 2 = 0"), ["event_id"]).withColumn("ingested_at", _ts("2024-02-01 00:00:00"))
    return merge.merge(target, u.filter("batch % 2 = 1"), ["event_id"], _ts("2024-02-02 00:00:00")).select("meter_id", "reading_time", "kwh", "received_at", "old_kwh", "replaced")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""")
def in_batch_winner(spark, sf):
    rows = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return merge.newest_in_batch(rows, ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber"], "l_shipdate")


# Repeats


_MARKED = (
    t.SIGHTINGS
    + """,
seen AS (
  SELECT delivery_id, list({'at': epoch_us(ingest_time), 'o': seq, 'since': epoch_us(ingest_time), 'passed': [seq]} ORDER BY ingest_time, seq) AS s FROM sightings GROUP BY 1),
passed AS (
  SELECT delivery_id, list_reduce(s, lambda a, x: CASE WHEN x.at - a.since < 86400000000
    THEN {'at': x.at, 'o': x.o, 'since': a.since, 'passed': a.passed} ELSE {'at': x.at, 'o': x.o, 'since': x.at, 'passed': list_append(a.passed, x.o)} END).passed AS p
  FROM seen),
marked AS (SELECT sightings.*, NOT list_contains(p, seq) AS repeat FROM sightings JOIN passed USING (delivery_id))"""
)


@query(f"WITH {_MARKED} SELECT delivery_id, seq, repeat FROM marked")
def delivery_dedup(spark, sf):
    return ingest.mark_repeats(t.sightings(spark, sf)).select("delivery_id", "seq", "repeat")


@query(f"""WITH {_MARKED}
SELECT delivery_id, min(ingest_time) AS detected_at, arg_min(source, (ingest_time, seq)) AS source, arg_min(reading_count, (ingest_time, seq)) AS reading_count, count(*) AS repeats
FROM marked WHERE repeat GROUP BY 1""")
def delivery_duplicates_log(spark, sf):
    return ingest.duplicates_log(ingest.mark_repeats(t.sightings(spark, sf)))


@query(f"""WITH {t.SIGHTINGS}, first AS (SELECT * FROM sightings QUALIFY row_number() OVER (PARTITION BY delivery_id ORDER BY ingest_time, seq) = 1)
SELECT delivery_id, source, reading_count FROM first WHERE delivery_id NOT IN (SELECT 'd' || c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def insert_if_absent(spark, sf):
    held = t.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("d"), "c_custkey").alias("delivery_id"))
    return ingest.insert_if_absent(held, t.sightings(spark, sf), ["delivery_id"], ["ingest_time", "seq"]).select("delivery_id", "source", "reading_count")


@query(f"WITH {t.READINGS} SELECT source, count(*) AS n, {KWH} AS kwh FROM readings GROUP BY 1")
def lane_union(spark, sf):
    r = t.readings(spark, sf)
    both = ingest.lane_union(r.filter("source = 'live'"), r.filter("source = 'backfill'"))
    return both.groupBy("source").agg(F.count("*").alias("n"), exact_sum(F.col("kwh")).alias("kwh"))


def _pages(spark, sf):
    r = t.readings(spark, sf).withColumn("page", F.floor(F.col("event_id") / 20))
    row = F.struct("meter_id", F.date_format("reading_time", "yyyy-MM-dd HH:mm:ss").alias("reading_time"), F.col("kwh").cast("string").alias("kwh"))
    return r.groupBy("page").agg(F.collect_list(row).alias("readings"))


_PAGE = "'bf_' || left(sha256(string_agg({0}, '|' ORDER BY meter_id, strftime(reading_time, '%Y-%m-%d %H:%M:%S'), CAST(kwh AS VARCHAR))), 16)".format
_LINE = "meter_id || ',' || strftime(reading_time, '%Y-%m-%d %H:%M:%S')"


@query(f"WITH {t.READINGS} SELECT event_id // 20 AS page, {_PAGE(_LINE)} AS id_without_kwh, {_PAGE(_LINE + ' || chr(44) || CAST(kwh AS VARCHAR)')} AS delivery_id FROM readings GROUP BY 1")
def content_hash_pages(spark, sf):
    return _pages(spark, sf).select("page", content_hash(F.col("readings"), False).alias("id_without_kwh"), content_hash(F.col("readings")).alias("delivery_id"))


@query(f"""WITH {t.READINGS}
SELECT event_id, CAST((row_number() OVER (ORDER BY reading_time, meter_id, kwh) - 1) // 1000 AS BIGINT) AS page FROM readings WHERE reading_time >= TIMESTAMP '2024-01-05'""")
def archive_pages(spark, sf):
    return tables.archive_pages(t.readings(spark, sf), _ts("2024-01-05 00:00:00"), 1000).select("event_id", "page")


# Live state


@query(f"""WITH {t.FACTS}, {t.HOMES}, {_WINDOWS} SELECT * FROM forecasts WHERE window_start = (SELECT max(window_start) FROM windows)""")
def live_window(spark, sf):
    return live.current_window(t.facts(spark, sf), t.homes(spark, sf))


@query(f"""WITH {t.READINGS}, all_facts AS (SELECT * FROM readings WHERE kwh BETWEEN 0 AND 50), own AS (SELECT batch % 7 AS b, time_bucket(INTERVAL '30 minutes', max(reading_time)) AS w FROM all_facts GROUP BY 1),
facts AS (SELECT f.* FROM all_facts f JOIN own ON b = batch % 7 WHERE w = (SELECT max(w) FROM own) AND {BUCKET} = w), {t.HOMES}, {_WINDOWS}
SELECT * FROM forecasts""")
def rolling_window(spark, sf):
    return live.rolling_window(t.facts(spark, sf).withColumn("batch", F.col("batch") % 7), t.homes(spark, sf))


@query(f"WITH {t.FACTS}, {t.HOMES}, {_WINDOWS} SELECT * FROM forecasts")
def coverage_forecast(spark, sf):
    return live.windows(t.facts(spark, sf), t.homes(spark, sf))


@query(f"WITH {t.FACTS} SELECT {BUCKET} AS window_start, count(DISTINCT meter_id) AS meters FROM facts GROUP BY 1")
def active_meters_exact(spark, sf):
    return live.windows(t.facts(spark, sf), t.homes(spark, sf)).select("window_start", "meters")


@query(f"WITH {t.FACTS} SELECT {BUCKET} AS window_start, count(DISTINCT meter_id) AS meters, true AS within FROM facts GROUP BY 1")
def active_meters_hll(spark, sf):
    """The sketch's estimates beside exact counts, and whether they differ by a twentieth, or one, at most."""
    facts = t.facts(spark, sf)
    exact = live.windows(facts, t.homes(spark, sf)).select("window_start", "meters")
    both = exact.join(live.meters_sketch(facts).withColumnRenamed("meters", "estimate"), "window_start")
    return both.select("window_start", "meters", (F.abs(F.col("estimate") - F.col("meters")) <= F.greatest(F.lit(1.0), F.col("meters") / 20)).alias("within"))


@query(f"""WITH {t.READINGS}, s AS (
  SELECT reading_time, CASE WHEN epoch_us(reading_time) - lag(epoch_us(reading_time)) OVER (ORDER BY reading_time) < 300000000 THEN 0 ELSE 1 END AS new FROM readings),
r AS (SELECT reading_time, sum(new) OVER (ORDER BY reading_time ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT min(reading_time) AS first_at, max(reading_time) AS last_at, count(*) AS n FROM r GROUP BY run""")
def session_counter_5m(spark, sf):
    return live.sessions(t.readings(spark, sf), "reading_time")


@query(f"WITH {t.READINGS} SELECT count(*) AS n FROM readings WHERE received_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 MINUTE AND received_at <= TIMESTAMP '2024-01-20 12:00:00'")
def trailing_counter_5m(spark, sf):
    return live.trailing(t.readings(spark, sf), "received_at", _ts("2024-01-20 12:00:00"), 5)


# Lag


_LAGS = "lags AS (SELECT meter_id, CAST(reading_time AS DATE) AS day, epoch_us(received_at - reading_time) / 1e6 AS lag FROM readings)"
_STATS = """sum(CAST(lag * 1e6 AS HUGEINT))::DOUBLE / 1e6 / count(*) AS avg_lag_sec, list_sort(list(lag))[greatest(1, CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT))] AS p95_lag_sec, max(lag) AS max_lag_sec"""


@query(f"WITH {t.READINGS}, {_LAGS} SELECT meter_id, {_STATS}, count(*) AS n FROM lags GROUP BY 1")
def lag_stats(spark, sf):
    return lag.lag_stats(t.readings(spark, sf))


@query(f"""WITH {t.READINGS}, {_LAGS}, daily AS (SELECT meter_id, day, {_STATS} FROM lags GROUP BY 1, 2),
s AS (SELECT meter_id, list(avg_lag_sec ORDER BY day) AS a, list(p95_lag_sec ORDER BY day) AS p, max(max_lag_sec) AS m FROM daily GROUP BY 1)
SELECT meter_id, list_reduce(a, lambda x, y: x * 0.8::DOUBLE + y * (1 - 0.8::DOUBLE)) AS avg_lag_sec, list_reduce(p, lambda x, y: x * 0.8::DOUBLE + y * (1 - 0.8::DOUBLE)) AS p95_lag_sec, m AS max_lag_sec FROM s""")
def lag_ewma(spark, sf):
    r = t.readings(spark, sf).withColumn("day", F.to_date("reading_time"))
    return lag.fold_lag(lag.lag_stats(r, ["day"]), "day")


# Dimensions and preparation


@query(f"""WITH {t.WEATHER}, hours AS (SELECT *, date_trunc('hour', observed_at) AS h FROM weather)
SELECT h AS observed_at, 'EGLL-Heathrow' AS station, coalesce(arg_max(temp_c, file_order) FILTER (WHERE report_type = 'FM-12'), arg_min(temp_c, file_order)) AS temp_c,
  coalesce(max('FM-12') FILTER (WHERE report_type = 'FM-12'), arg_min(report_type, file_order)) AS report_type,
  coalesce(max(file_order) FILTER (WHERE report_type = 'FM-12'), min(file_order)) AS file_order FROM hours GROUP BY 1""")
def weather_hour_dedup(spark, sf):
    return dims.weather_hours(t.weather(spark, sf), "file_order")


@query(f"WITH {t.HOMES} SELECT * FROM homes")
def homes_dimension(spark, sf):
    h = t.homes(spark, sf)
    return dims.homes(h.unionByName(h))


@query(f"WITH {t.READINGS} SELECT event_id FROM readings WHERE reading_time >= TIMESTAMP '2024-01-25' - INTERVAL 10 DAY AND reading_time <= TIMESTAMP '2024-01-28'")
def replay_window(spark, sf):
    return dims.replay_window(t.readings(spark, sf), _ts("2024-01-25 00:00:00"), _ts("2024-01-28 00:00:00"), 10).select("event_id")


@query(f"WITH {t.READINGS}, big AS (SELECT household_id FROM readings GROUP BY 1 HAVING count(*) >= 0.5 * 140) SELECT event_id FROM readings WHERE household_id IN (SELECT household_id FROM big) AND kwh BETWEEN 0 AND 50")
def coverage_filter(spark, sf):
    return dims.without_outliers(dims.well_covered(t.readings(spark, sf), F.lit(140))).select("event_id")


@query(f"WITH {t.READINGS} SELECT event_id, timezone('UTC', timezone('Europe/London', reading_time + INTERVAL 180 DAY)) AS reading_time FROM readings")
def zone_to_utc(spark, sf):
    summer = t.readings(spark, sf).withColumn("reading_time", F.col("reading_time") + F.make_interval(days=F.lit(180)))
    return dims.to_utc(summer).select("event_id", "reading_time")


@query(f"""WITH {t.HOMES}, s AS (SELECT household_id, CAST('0x' || left(md5(household_id), 6) AS BIGINT) % 100 AS k FROM homes),
g AS (SELECT *, CASE WHEN k < 30 THEN 'Affluent' WHEN k < 60 THEN 'Comfortable' ELSE 'Adversity' END AS acorn_group FROM s)
SELECT household_id, 'N1-' || substr('ABCDEFGH', k % 8 + 1, 1) AS postcode_area, acorn_group,
  CAST(CASE acorn_group WHEN 'Affluent' THEN 4 WHEN 'Comfortable' THEN 3 ELSE 2 END AS INTEGER) AS household_size FROM g""")
def household_labels(spark, sf):
    return dims.labelled(t.homes(spark, sf).select("household_id"))


@query(f"""WITH {t.FACTS}
SELECT 'kwh' AS "column", count(kwh) AS n, count(DISTINCT kwh) AS "distinct", {ROUND(KWH + " / count(kwh)", 6)} AS mean, {ROUND("stddev_samp(kwh)", 6)} AS std,
  (SELECT kwh FROM facts GROUP BY kwh ORDER BY count(*) DESC, kwh LIMIT 1) AS top, min(kwh) AS least,
  quantile_cont(kwh, 0.25) AS q1, quantile_cont(kwh, 0.5) AS median, quantile_cont(kwh, 0.75) AS q3, max(kwh) AS most FROM facts""")
def column_profile(spark, sf):
    return dims.profile(t.facts(spark, sf), ["kwh"])


# Maintenance


_ORPHANS = f"""orphans AS (
  SELECT meter_id, min(reading_time) AS first_seen, max(reading_time) AS last_seen, count(*) AS reading_count, {KWH} AS total_kwh
  FROM {{}} WHERE meter_id NOT IN (SELECT meter_id FROM homes) GROUP BY 1)"""


@query(f"WITH {t.FACTS}, {t.HOMES}, {_ORPHANS.format('facts')} SELECT * FROM orphans")
def orphans_anti(spark, sf):
    return jobs.orphans(t.facts(spark, sf), t.homes(spark, sf))


@query(f"""WITH {t.FACTS}, {t.HOMES}, early AS (SELECT * FROM facts WHERE reading_time < TIMESTAMP '2024-01-10'), late AS (SELECT * FROM facts WHERE reading_time >= TIMESTAMP '2024-01-08'),
{_ORPHANS.format("early").replace("orphans AS", "s AS", 1)}, {_ORPHANS.format("late").replace("orphans AS", "f AS", 1)}
SELECT meter_id, coalesce(s.first_seen, f.first_seen) AS first_seen, coalesce(f.last_seen, s.last_seen) AS last_seen, coalesce(f.reading_count, s.reading_count) AS reading_count, coalesce(f.total_kwh, s.total_kwh) AS total_kwh
FROM s FULL JOIN f USING (meter_id)""")
def orphan_upsert(spark, sf):
    facts, homes = t.facts(spark, sf), t.homes(spark, sf)
    stored = jobs.orphans(facts.filter(F.col("reading_time") < _ts("2024-01-10 00:00:00")), homes)
    return jobs.upsert_orphans(stored, jobs.orphans(facts.filter(F.col("reading_time") >= _ts("2024-01-08 00:00:00")), homes))


_CUT = "rejected_at < TIMESTAMP '2024-02-08' - INTERVAL 1 DAY"


@query(f"""WITH {t.REJECTS}
SELECT date_trunc('hour', coalesce(reading_time, rejected_at)) AS ts_hour, rejection_type AS rejection_reason, count(*) AS count FROM rejects WHERE {_CUT} GROUP BY 1, 2""")
def archive_rollup(spark, sf):
    """What earlier runs archived is the summary, to which one more run adds the rest."""
    rejects, now = t.rejects(spark, sf), _ts("2024-02-08 00:00:00")
    nothing = spark.createDataFrame([], "ts_hour timestamp, rejection_reason string, count long")
    before = jobs.roll_up(nothing, rejects.filter(F.col("archived") & (F.col("rejected_at") < now - F.make_interval(days=F.lit(1)))))
    return jobs.roll_up(before, jobs.archivable(rejects, now))


@query(f"WITH {t.REJECTS} SELECT id, archived OR {_CUT} AS archived FROM rejects")
def archive_semi(spark, sf):
    return jobs.mark_archived(t.rejects(spark, sf), _ts("2024-02-08 00:00:00")).select("id", "archived")


@query(f"WITH {t.REJECTS} SELECT id, rejection_type FROM rejects WHERE NOT rejected_at < TIMESTAMP '2024-02-12' - INTERVAL 7 DAY")
def purge_retention(spark, sf):
    return jobs.purge(t.rejects(spark, sf), _ts("2024-02-12 00:00:00")).select("id", "rejection_type")


@query(f"WITH {t.FACTS}, {t.HOMES} SELECT postcode_area, count(*) AS n, count(DISTINCT meter_id) AS meters FROM (SELECT meter_id FROM facts) LEFT JOIN homes USING (meter_id) GROUP BY 1")
def book_join_left(spark, sf):
    meters = t.facts(spark, sf).groupBy("meter_id").agg(F.count("*").alias("m"))
    joined = meters.join(t.homes(spark, sf).select("meter_id", "postcode_area"), "meter_id", "left")
    return joined.groupBy("postcode_area").agg(F.sum("m").alias("n"), F.count("*").alias("meters"))


_SPREAD = "CAST('0x' || left(md5({}), 6) AS BIGINT) % {}".format


@query(f"""WITH {t.RAW}
SELECT count(*) FILTER (WHERE seen > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 MINUTE AND seen <= TIMESTAMP '2024-01-20 12:00:00' AND event_id % 3 = 0) AS duplicates,
  CASE WHEN duplicates >= 50 THEN 'high' WHEN duplicates >= 10 THEN 'warn' ELSE 'ok' END AS duplicates_band,
  count(*) FILTER (WHERE seen > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 MINUTE AND seen <= TIMESTAMP '2024-01-20 12:00:00' AND rejection_type IS NOT NULL) AS invalid,
  CASE WHEN invalid >= 100 THEN 'high' WHEN invalid >= 20 THEN 'warn' ELSE 'ok' END AS invalid_band
FROM (SELECT event_id, rejection_type, TIMESTAMP '2024-01-20 11:55:00' + to_seconds(event_id % 400) AS seen FROM validated)""")
def fault_bands(spark, sf):
    at = _ts("2024-01-20 11:55:00") + F.make_interval(secs=(F.col("event_id") % 400).cast("decimal(18,6)"))
    rows = ingest.validate(t.raw_readings(spark, sf)).withColumn("at", at)
    repeats = rows.filter("event_id % 3 = 0").select(F.col("at").alias("detected_at"))
    rejects = rows.filter("rejection_type is not null").select(F.col("at").alias("rejected_at"))
    return live.count_bands(repeats, rejects, _ts("2024-01-20 12:00:00"))


@query(f"""WITH {t.FACTS}, {t.HOMES}
SELECT postcode_area, tariff_type, count(*) AS readings, max(reading_time) AS newest FROM facts JOIN homes USING (meter_id) GROUP BY ALL""")
def analyst_sql(spark, sf):
    """Plain SQL over the views that analysts see."""
    views.register(spark, {"clean_readings": t.facts(spark, sf), "homes": t.homes(spark, sf)})
    return spark.sql("SELECT postcode_area, tariff_type, count(*) AS readings, max(reading_time) AS newest FROM clean_readings JOIN homes USING (meter_id) GROUP BY ALL")


# Fixtures


_FAULTY = f"""mixed AS (SELECT *, {_SPREAD("meter_id || ' ' || strftime(reading_time, '%Y-%m-%d %H:%M')", 20)} AS mix FROM readings),
sent AS (SELECT meter_id, reading_time, CASE mix WHEN 0 THEN 'invalid_reading_time' WHEN 1 THEN 'missing_kwh' WHEN 2 THEN 'kwh_out_of_range' WHEN 3 THEN 'below_range' END AS fault, kwh FROM mixed WHERE kwh <= 50)"""


@query(f"""WITH {t.READINGS}, {_FAULTY}
SELECT fault, CASE fault WHEN 'below_range' THEN 'kwh_out_of_range' ELSE fault END AS rejection_type, count(*) AS n FROM sent GROUP BY ALL""")
def fault_fixture(spark, sf):
    """What validation finds in readings that were given faults."""
    return ingest.validate(fixtures.faulty(t.facts(spark, sf))).groupBy("fault", "rejection_type").agg(F.count("*").alias("n"))


_REPLAY = f"""slots AS (SELECT *, {BUCKET} AS slot FROM readings WHERE reading_time >= TIMESTAMP '2024-01-10'),
parts AS (SELECT *, (row_number() OVER (PARTITION BY slot ORDER BY meter_id, reading_time) - 1) // 5 AS part FROM slots),
replayed AS (
  SELECT 'replay-' || epoch(slot)::BIGINT || '-' || part AS delivery_id, ((epoch(slot) + 1800 - epoch(TIMESTAMP '2024-01-10')) * 3 / 86400)::DOUBLE AS due_s, count(*) AS n
  FROM parts GROUP BY slot, part)"""


def _replayed(spark, sf):
    return fixtures.replay(t.readings(spark, sf), _ts("2024-01-10 00:00:00"), 3.0, size=5)


@query(f"WITH {t.READINGS}, {_REPLAY} SELECT delivery_id, {ROUND('due_s', 6)} AS due_s, n FROM replayed")
def replay_deliveries(spark, sf):
    return _replayed(spark, sf).select("delivery_id", F.round(F.col("due_s").cast("decimal(28,9)"), 6).cast("double").alias("due_s"), F.size("readings").cast("long").alias("n"))


@query(f"""WITH {t.READINGS}, {_REPLAY},
late AS (SELECT *, due_s + CASE WHEN {_SPREAD("'late ' || delivery_id", 10000)} < 200 THEN 3600 ELSE 0 END AS d FROM replayed),
off AS (SELECT *, CASE WHEN d >= 10 AND d < 20 THEN 20 ELSE d END AS sent_s, {_SPREAD("'again ' || delivery_id", 10000)} < 500 AS again FROM late)
SELECT delivery_id, {ROUND('sent_s', 6)} AS due_s, attempt FROM off, (SELECT unnest([0, 1]) AS attempt) WHERE attempt = 0 OR again""")
def disorderly_deliveries(spark, sf):
    sent = fixtures.disorderly(_replayed(spark, sf), outage=(10, 20))
    return sent.select("delivery_id", F.round(F.col("due_s").cast("decimal(28,9)"), 6).cast("double").alias("due_s"), "attempt")


# The stream and the runs on its tables


_SENT = f"""{t.UPDATES},
target AS (
  SELECT meter_id, reading_time, kwh, received_at FROM updates WHERE batch % 2 = 0 AND event_id % 17 <> 0
  QUALIFY row_number() OVER (PARTITION BY meter_id, reading_time ORDER BY received_at DESC NULLS LAST, event_id DESC) = 1),
incoming AS (
  SELECT meter_id, reading_time, kwh, received_at FROM updates WHERE batch % 2 = 1 AND event_id % 17 <> 0
  QUALIFY row_number() OVER (PARTITION BY meter_id, reading_time ORDER BY received_at DESC NULLS LAST, event_id DESC) = 1),
joined AS (
  SELECT coalesce(c.meter_id, e.meter_id) AS meter_id, coalesce(c.reading_time, e.reading_time) AS reading_time, c.meter_id IS NOT NULL AS had, c.kwh AS ck, e.kwh AS ek, c.received_at AS cr, e.received_at AS er,
    e.meter_id IS NOT NULL AND (c.meter_id IS NULL OR coalesce(e.received_at > c.received_at, false) OR (e.received_at IS NOT DISTINCT FROM c.received_at AND e.kwh IS DISTINCT FROM c.kwh)) AS wins
  FROM target c FULL JOIN incoming e ON c.meter_id = e.meter_id AND c.reading_time = e.reading_time)"""
_STORES: dict[tuple[str, str], Store] = {}
PART_ROWS = 4_000_000


def _streamed(spark, sf) -> Store:
    """Tables of a stream of two batches, even and then odd ones, a tenth of whose deliveries come again in the second."""
    key = spark.sparkContext.applicationId, sf
    if key in _STORES:
        return _STORES[key]
    own = spark.newSession()
    parts = str(_parts(spark.sparkContext.defaultParallelism, t.table(spark, sf, "events").count()))
    for k, v in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.shuffle.partitions", parts), ("spark.sql.streaming.stateStore.providerClass", STATE_STORE)):
        own.conf.set(k, v)
    base = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    row = F.struct("event_id", F.struct("meter_id", "household_id", stamp("reading_time"), F.when(F.col("event_id") % 17 == 0, "abc").otherwise(F.col("kwh").cast("string")).alias("kwh"), stamp("received_at")).alias("r"))
    made = t.updates(own, sf).groupBy("batch", F.floor(F.col("event_id") / 50).alias("d")).agg(F.array_sort(F.collect_list(row)).alias("rs"))
    made = made.select("batch", "d", F.format_string("d%012d", "d").alias("delivery_id"), F.lit("live").alias("source"), F.lit(None).cast("string").alias("ingest_time"), F.col("rs.r").alias("readings"))
    dead = own.createDataFrame([("no message",), ("[1]",)], "value string")
    first = deliveries.to_messages(made.filter("batch % 2 = 0"))
    second = deliveries.to_messages(made.filter("batch % 2 = 1 or d % 10 = 0")).unionByName(dead)
    store = Store(own, f"{base}/tables")
    t0 = store.begin()
    t0.append("homes", t.homes(own, sf))
    t0.commit()
    for messages in (first, second):
        _fed(store, messages, base)
    _STORES[key] = store
    return store


def _parts(cores: int, rows: int) -> int:
    """Partitions of the stream and its state: as many for each core, none with more than PART_ROWS rows of both batches, about."""
    return max(8, cores * -(-rows // (PART_ROWS * cores)))


def _fed(store: Store, messages: DataFrame, base: str) -> None:
    """Run the messages through the stream as one batch, in as many files as there are tasks that write them."""
    messages.write.mode("append").text(f"{base}/in")
    files = EngineConfig(files_per_trigger=sum(n.startswith("part-") for n in store.files.names(f"{base}/in")))
    pipeline.start(deliveries.from_files(store.spark, f"{base}/in", files), store.base, available_now=True, checkpoint=f"{base}/checkpoint").awaitTermination()


@query(f"WITH {_SENT} SELECT meter_id, reading_time, CASE WHEN wins THEN ek ELSE ck END AS kwh, CASE WHEN wins THEN er ELSE cr END AS received_at FROM joined")
def stream_facts(spark, sf):
    return _streamed(spark, sf).facts().select("meter_id", "reading_time", "kwh", "received_at")


@query(f"""WITH {_SENT}, d AS (SELECT event_id // 50 AS d, any_value(batch) AS batch, count(*) AS n FROM updates GROUP BY 1)
SELECT 'batch_log' AS name, count(*) AS n FROM d UNION ALL SELECT 'batch_duplicates', count(*) FROM d WHERE batch % 2 = 0 AND d % 10 = 0
UNION ALL SELECT 'dead_letters', 2 UNION ALL SELECT 'rejected_readings', count(*) FROM updates WHERE event_id % 17 = 0
UNION ALL SELECT 'meter_corrections_log', count(*) FROM joined WHERE wins AND had AND ck IS DISTINCT FROM ek""")
def stream_audit(spark, sf):
    store = _streamed(spark, sf)
    out = None
    for name in ("batch_log", "batch_duplicates", "dead_letters", "rejected_readings", "meter_corrections_log"):
        one = store.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {t.HOMES}, {_SENT}, facts AS (SELECT meter_id, reading_time, CASE WHEN wins THEN ek ELSE ck END AS kwh FROM joined), {_WINDOWS}
SELECT * FROM forecasts WHERE window_start = (SELECT max(window_start) FROM windows)""")
def stream_live_window(spark, sf):
    return _streamed(spark, sf).read("live_window").drop("updated_at")


_LEFT = f"{t.HOMES}, {_SENT}, facts AS (SELECT meter_id, reading_time, CASE WHEN wins THEN ek ELSE ck END AS kwh FROM joined)"


@query(f"WITH {_LEFT} SELECT {BUCKET} AS window_start, count(DISTINCT meter_id) AS meters, true AS within FROM facts GROUP BY 1")
def stream_meters_kept(spark, sf):
    """Distinct meters from the sketches that batches have left, beside exact counts; facts are not read for the former."""
    store = _streamed(spark, sf)
    kept = live.meters_kept(store.read("meter_sketches")).withColumnRenamed("meters", "estimate")
    exact = live.windows(store.facts(), store.read("homes")).select("window_start", "meters")
    within = F.abs(F.col("meters") - F.col("estimate")) <= F.greatest(F.lit(1.0), 0.05 * F.col("meters"))
    return exact.join(kept, "window_start", "left").select("window_start", "meters", F.coalesce(within, F.lit(False)).alias("within"))


@query(f"""WITH {_SENT}, d AS (SELECT event_id // 50 AS d, any_value(batch) AS batch FROM updates GROUP BY 1)
SELECT 'duplicates' AS kind, count(*) AS n FROM d WHERE batch % 2 = 0 AND d % 10 = 0 UNION ALL SELECT 'invalid', count(*) FROM updates WHERE event_id % 17 = 0""")
def stream_counters(spark, sf):
    """What the counters of repeats and rejects have counted, over all runs."""
    return _streamed(spark, sf).read("live_counters").groupBy("kind").agg(F.sum("n").alias("n"))


@query(f"""WITH {_LEFT}
SELECT {BUCKET} AS time, {KWH} AS total_kwh FROM facts WHERE reading_time > (SELECT max(reading_time) FROM facts) - INTERVAL 24 HOUR GROUP BY 1""")
def stream_last_day(spark, sf):
    return maintenance.last_day(_streamed(spark, sf))


@query(f"""WITH {_LEFT},
daily AS (SELECT meter_id, CAST(reading_time AS DATE) AS reading_date, {KWH} AS day_kwh FROM facts WHERE reading_time > (SELECT max(reading_time) FROM facts) - INTERVAL 7 DAY GROUP BY 1, 2)
SELECT acorn_group, tariff_type, count(DISTINCT meter_id) AS meter_count, {ROUND(SUM("day_kwh") + " / count(day_kwh)", 3)} AS avg_daily_kwh,
  {ROUND("min(day_kwh)", 3)} AS min_daily_kwh, {ROUND("max(day_kwh)", 3)} AS max_daily_kwh FROM daily JOIN homes USING (meter_id) GROUP BY 1, 2""")
def stream_recent_segments(spark, sf):
    return maintenance.recent_segments(_streamed(spark, sf), 7)


def _loaded(spark, sf, name: str) -> DataFrame:
    """A table after three loads: half of the rows, all of them, and all again with other values, which change nothing."""
    store = Store(spark, f"{shared_folder(spark)}/dimensions-{uuid4().hex}")
    if name == "homes":
        raw = t.homes(spark, sf)
        some, other = raw.filter(F.crc32("household_id") % 2 == 0), raw.withColumn("household_size", F.col("household_size") + 10)
        for rows in (some, raw, other):
            maintenance.load_homes(store, rows)
    else:
        raw = t.weather(spark, sf)
        some = raw.filter(F.hour("observed_at") % 2 == 0)
        for rows in (some, raw, raw.withColumn("temp_c", F.col("temp_c") - 100)):
            maintenance.load_weather(store, rows, "file_order")
    return store.read(name)


@query(f"WITH {t.HOMES} SELECT * FROM homes")
def homes_load(spark, sf):
    return _loaded(spark, sf, "homes")


@query(f"""WITH {t.WEATHER}, hours AS (SELECT *, date_trunc('hour', observed_at) AS h FROM weather)
SELECT h AS observed_at, 'EGLL-Heathrow' AS station, coalesce(arg_max(temp_c, file_order) FILTER (WHERE report_type = 'FM-12'), arg_min(temp_c, file_order)) AS temp_c,
  coalesce(max('FM-12') FILTER (WHERE report_type = 'FM-12'), arg_min(report_type, file_order)) AS report_type FROM hours GROUP BY 1""")
def weather_load(spark, sf):
    return _loaded(spark, sf, "weather_hourly")


@query(f"WITH {t.FACTS} SELECT meter_id, reading_time, kwh, received_at FROM facts")
def archive_stream(spark, sf):
    """What two runs of the archive stream land, of an archive that grows between them: each reading once."""
    base = f"{shared_folder(spark)}/archive-{uuid4().hex}"
    rows = t.facts(spark, sf).select("meter_id", "household_id", "reading_time", "kwh", "received_at")
    early = F.col("reading_time") < _ts("2024-01-16 00:00:00")
    for part in (rows.filter(early), rows.filter(~early)):
        part.repartitionByRange(4, "reading_time").write.mode("append").parquet(f"{base}/archive")
        archive.pull(spark, f"{base}/archive", f"{base}/landing", f"{base}/checkpoint", limit=100, task_rows=1000).awaitTermination()
    landed = spark.read.text(f"{base}/landing").withColumn("lane", F.lit(deliveries.BACKFILL))
    readings, _ = ingest.split_valid(ingest.validate(ingest.flatten(ingest.parse_deliveries(landed))))
    return readings.select("meter_id", "reading_time", "kwh", "received_at")


@query(f"""WITH {t.UPDATES}
SELECT date_trunc('hour', reading_time) AS ts_hour, 'missing_kwh' AS rejection_reason, count(*) AS count FROM updates WHERE event_id % 17 = 0 GROUP BY 1""")
def archive_run(spark, sf):
    """Hourly totals after two runs of the archive, two days on: each reject counts once."""
    store = _streamed(spark, sf)
    for _ in range(2):
        maintenance.run_archive(store, F.current_timestamp() + F.make_interval(days=F.lit(2)))
    return store.read("rejection_hourly_summary")


@query(f"""WITH {t.HOMES}, {_SENT}, facts AS (SELECT meter_id, reading_time, CASE WHEN wins THEN ek ELSE ck END AS kwh FROM joined), {_SILENT}
SELECT * FROM silent""")
def silence_run(spark, sf):
    store = _streamed(spark, sf)
    maintenance.run_silence(store, F.lit(datetime.now(UTC)))  # every run logs all of them again
    return maintenance.latest_silence(store).drop("detected_at")


@query(f"""WITH {t.HOMES}, {_SENT}, facts AS (SELECT meter_id, reading_time, CASE WHEN wins THEN ek ELSE ck END AS kwh FROM joined), {_ORPHANS.format('facts')}
SELECT * FROM orphans""")
def orphan_run(spark, sf):
    store = _streamed(spark, sf)
    maintenance.run_orphans(store)
    maintenance.run_orphans(store)
    return store.read("orphan_meters_summary")
