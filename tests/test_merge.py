import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltmill.operators import merge

KIND = "meter_id string, reading_time timestamp, household_id string, kwh double, received_at timestamp, seq long, batch long"


def rows(spark, data):
    """data: (meter, kwh, received hour or None, batch)"""
    made = [(m, "2014-01-13 10:00:00", "h", k, None if r is None else f"2014-01-13 {r:02d}:00:00", i, b) for i, (m, k, r, b) in enumerate(data)]
    df = spark.createDataFrame(made, "meter_id string, t string, household_id string, kwh double, r string, seq long, batch long")
    return df.select("meter_id", F.col("t").cast("timestamp").alias("reading_time"), "household_id", "kwh", F.col("r").cast("timestamp").alias("received_at"), "seq", "batch")


# (stored kwh, received), (incoming kwh, received) -> kwh, correction
GOLDEN = [
    ((1.0, 10), (2.0, 11), 2.0, True),
    ((1.0, 10), (1.0, 11), 1.0, False),
    ((1.0, 10), (2.0, 9), 1.0, False),
    ((1.0, 10), (2.0, 10), 2.0, True),
    ((1.0, 10), (1.0, 10), 1.0, False),
    ((1.0, 10), (2.0, None), 1.0, False),
    ((1.0, None), (2.0, None), 2.0, True),
    ((1.0, None), (2.0, 11), 1.0, False),
]


@pytest.mark.parametrize("fold", [True, False])
def test_golden_cases(spark, fold):
    data = list(itertools.chain(*[[(f"m{k}", *old, 0), (f"m{k}", *new, 1)] for k, (old, new, _, _) in enumerate(GOLDEN)]))
    df = rows(spark, data)
    if fold:
        out = {r["meter_id"]: (r["kwh"], bool(r["log"])) for r in merge.fold_batches(df, "batch", ["seq"]).collect()}
    else:
        t0, t1 = F.lit("2014-01-14").cast("timestamp"), F.lit("2014-01-15").cast("timestamp")
        first = merge.merge(df.limit(0).withColumn("ingested_at", t0), df.filter("batch = 0"), ["seq"], t0)
        target = first.select(*merge.KEY, *merge.VALUES)
        merged = merge.merge(target, df.filter("batch = 1"), ["seq"], t1)
        fixed = {r["meter_id"] for r in merge.corrections(merged, t1).collect()}
        out = {r["meter_id"]: (r["kwh"], r["meter_id"] in fixed) for r in merged.collect()}
    assert out == {f"m{k}": (kwh, fix) for k, (_, _, kwh, fix) in enumerate(GOLDEN)}


def test_newest_in_batch_wins_and_null_keys_leave(spark):
    df = rows(spark, [("a", 2.0, 11, 0), ("a", 3.0, 10, 0), (None, 9.0, 12, 0), ("b", 1.0, None, 0), ("b", 2.0, 1, 0)])
    assert {(r["meter_id"], r["kwh"]) for r in merge.newest_in_batch(df, ["seq"]).collect()} == {("a", 2.0), ("b", 2.0)}


def reference(data):
    """The rule, one batch after another, in plain Python."""
    state = {}
    for b in sorted({d[3] for d in data}):
        best = {}
        for i, (m, k, r, bb) in enumerate(data):
            if bb == b and m is not None and (m not in best or (r is not None, r or 0, i) >= best[m][0]):
                best[m] = ((r is not None, r or 0, i), k, r)
        for m, (_, k, r) in best.items():
            if m not in state:
                state[m] = (k, r)
                continue
            ok, orr = state[m]
            if (r is not None and orr is not None and r > orr) or (r == orr and k != ok):
                state[m] = (k, r)
    return {m: k for m, (k, _) in state.items()}


reading = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1.0, 2.0, 3.0]), st.sampled_from([None, 9, 10, 11]), st.integers(0, 3))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(reading, min_size=1, max_size=14))
def test_fold_equals_the_sequential_rule(spark, data):
    got = {r["meter_id"]: r["kwh"] for r in merge.fold_batches(rows(spark, data), "batch", ["seq"]).collect()}
    assert got == reference(data)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 20)), min_size=1, max_size=10, unique=True), st.randoms())
def test_any_order_split_and_repeat_gives_the_same_values(spark, keys, rnd):
    base = [(m, float(r), r, 0) for m, r in keys]
    again = base + rnd.sample(base, len(base) // 2)
    rnd.shuffle(again)
    split = [(m, k, r, rnd.randrange(3)) for m, k, r, _ in again]
    a = {r["meter_id"]: r["kwh"] for r in merge.latest(rows(spark, base), "seq").collect()}
    b = {r["meter_id"]: r["kwh"] for r in merge.fold_batches(rows(spark, split), "batch", ["seq"]).collect()}
    assert a == b
