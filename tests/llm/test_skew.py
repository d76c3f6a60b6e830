"""A third of all rows alike, long repetitive texts, repeated items: the same results, in time, without broadcasts too."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmill.llm import components, decontam, fingerprint, line_dedup, mixing, neardup, packing, text


@pytest.fixture
def unicast(monkeypatch):
    """No table of keys is small enough to be broadcast, and a few rows make a key hot."""
    monkeypatch.setattr(text, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(text, "measured", lambda df, limit=0: df)
    monkeypatch.setattr(neardup, "measured", lambda df, limit=0: df)
    monkeypatch.setattr(text, "LEAST_HOT", 3)


def test_hot_keys_are_dealt(spark, unicast):
    rows = spark.createDataFrame([(k % 3 and 7, k) for k in range(300)] + [(None, 1000 + k) for k in range(50)], "key long, x long")
    keys = spark.createDataFrame([(0, "a"), (7, "b"), (9, "c")], "key long, name string")
    for how, expected in (("inner", 300), ("left", 350), ("left_semi", 300), ("left_anti", 50)):
        out = text.join_spread(rows, keys, ["key"], how)
        assert out.count() == expected and out.select("x").distinct().count() == expected
    hot = {r["key"]: (r["_rows"], r["_parts"]) for r in text.hot_keys(rows, ["key"]).collect()}
    assert hot == {0: (100, 34), 7: (200, 67), None: (50, 17)}
    one = text.join_spread(rows.repartition(4), keys, ["key"]).groupBy(F.spark_partition_id()).count()
    assert sum(r["count"] for r in one.collect()) == 300


def test_rows_counted_once(spark, unicast):
    rows = spark.createDataFrame([(1, "x")] * 40 + [(2, "y")] * 3 + [(3, "z")], "id long, text string")
    out = text.counted_once(rows, ["id"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", 40), (2, "y", 1), (2, "y", 1), (2, "y", 1), (3, "z", 1)]
    assert Counter(r["id"] for r in text.each_copy(out).collect()) == {1: 40, 2: 3, 3: 1}
    many = spark.createDataFrame([(1, 9000), (2, 0), (3, 1)], "id long, copies long")
    assert Counter(r["id"] for r in text.each_copy(many).collect()) == {1: 9000, 3: 1}


HOT = [(7, "again and again the same words " * 3, "s0")] * 120 + [(None, "nobody knows", None)] * 30 + [(k, f"number {k} of some words " * (k % 5 + 1), f"s{k % 4}") for k in range(100, 250)]


@pytest.fixture
def hot(spark):
    return spark.createDataFrame(HOT, "doc_id long, text string, source string").repartition(3)


def both(f, monkeypatch):
    one = f()
    monkeypatch.setattr(text, "measured", lambda df, limit=0: df)
    monkeypatch.setattr(neardup, "measured", lambda df, limit=0: df)
    monkeypatch.setattr(text, "LEAST_HOT", 3)
    return one, f()


def test_mixing_of_hot_rows(hot, spark, monkeypatch, tmp_path):
    hot.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    one, two = both(lambda: sorted(map(str, mixing.mix(df).collect())), monkeypatch)
    assert one == two and len(one) == len(HOT)
    copies = sum((Counter({r["doc_id"]: r["copies"]}) for r in mixing.mix(df).collect()), Counter())
    assert Counter(r["doc_id"] for r in mixing.take(df).collect()) == +copies


def test_copies_add_up_to_the_rounded_rates(hot):
    """By force: every document of a cell has the same whole copies, some have one more, and their hashes say which."""
    cells = {}
    for r in mixing.mix(hot).withColumn("place", F.xxhash64("doc_id")).collect():
        cells.setdefault((r["source"], r["size"]), []).append(r["copies"])
    assert all(max(c) - min(c) <= 1 and max(c) <= 3 for c in cells.values())
    by = {}
    for r in mixing.mix(hot).collect():
        got = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        got[0] += r["taken"]
    assert all(abs(x - t) <= max(6, 0.02 * t) for x, t, _ in by.values())


def test_packing_of_hot_rows(hot, monkeypatch):
    monkeypatch.setattr(text, "LEAST_HOT", 3)
    monkeypatch.setattr(packing, "COPIES_AT_ONCE", 16)
    rows = packing.pack(hot, length=64, shard_bytes=400).collect()
    assert Counter(i for r in rows for i, s in zip(r["doc_ids"], r["doc_starts"], strict=True) if s == 0) == Counter(i for i, _, _ in HOT)
    shards = Counter(r["pack_id"] >> 32 for r in rows if 7 in r["doc_ids"])
    assert len(shards) > 3 and len({r["pack_id"] for r in rows}) == len(rows)
    ranks = packing.read_ranks(packing.TOKENIZER)
    encode = packing.Tokenizer(ranks)
    own = {i: encode(t).tolist() for i, t, _ in HOT}
    for r in rows:
        ids = np.frombuffer(r["ids"], encode.kind)
        for i, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert ids[a:b].tolist() == own[i][s : s + b - a]


def test_packs_are_best_fit_by_force():
    """Each item goes to the fullest bin that takes it, ties to any; by a plain search over all bins."""
    rnd = random.Random(5)
    for _ in range(30):
        sizes, length = [rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 60))], 50
        left = []
        for s in sorted(sizes, reverse=True):
            fit = [k for k, c in enumerate(left) if c >= s]
            k = min(fit, key=lambda k: left[k]) if fit else len(left)
            left[k:k + 1] = [(left[k] if fit else length) - s]
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(length - sum(sizes[i] for i in b) for b in got) == sorted(left)


def test_fingerprints_of_hot_rows(hot, monkeypatch):
    plain = lambda: sorted(map(str, fingerprint.with_next(hot.select("doc_id", "text"), range_bytes=500).collect()))
    one, two = both(plain, monkeypatch)
    assert one == two and len(one) == len(HOT)


def test_near_duplicates_of_hot_rows(hot, monkeypatch):
    rows = hot.unionByName(hot.filter("doc_id > 100").withColumn("doc_id", F.col("doc_id") + 1000)).select("doc_id", "text")
    one, two = both(lambda: sorted(map(str, neardup.near_duplicates(rows, words=2).collect())), monkeypatch)
    assert one == two and len(one) == rows.count()
    assert neardup.drop_near_duplicates(rows, words=2).filter("doc_id is null").count() == 30


def test_components_without_broadcast(spark, unicast):
    links = [(1, k) for k in range(2, 90)] + [(k, k + 1000) for k in range(2, 60)] + [(2000, 2001)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), 0).collect()}
    assert got == {x: 1 if x < 2000 else 2000 for e in links for x in e}


def test_tiles_lose_no_link(spark, monkeypatch):
    """Chunks and families of more sets than may meet at once are dealt to tiles, with the same groups."""
    rnd = random.Random(3)
    docs = []
    for _ in range(4):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        for _ in range(60):
            w = list(base)
            for k in rnd.sample(range(60), rnd.randrange(7)):
                w[k] = f"x{rnd.randrange(30)}"
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    one = sorted(map(tuple, neardup.near_duplicates(df, words=2).collect()))
    for tile in (4000, 20_000):
        monkeypatch.setattr(neardup, "TILE_BYTES", tile)
        monkeypatch.setattr(neardup, "BITS", 1)
        for region in (1024, 16):
            assert sorted(map(tuple, neardup.near_duplicates(df, words=2, region=region).collect())) == one


def test_templates_whose_documents_are_not_linked(spark):
    """5,000 documents that share a template, no two of them linked: far from all pairs in time."""
    rnd = random.Random(1)
    base, docs = [f"w{rnd.randrange(10**6)}" for _ in range(160)], []
    for i in range(5000):
        w = list(base)
        for k in rnd.sample(range(160), 24):
            w[k] = f"x{rnd.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    at = time.time()
    assert neardup.near_duplicates(df, words=2).filter("doc_id <> component_id").count() == 0
    assert time.time() - at < 120


def test_repeated_windows_and_items():
    """200,000 equal words on both sides, and 5,000 equal items: one pattern, one span, all names."""
    at = time.time()
    spans, names = [], set()
    decontam.Matcher([(["long"], b"x " * 200_000)])([b"x"] * 200_000, spans, names)
    assert decontam.merged(spans) == [(0, 200_000)] and len(spans) == 1 and names == {"long"}
    item = " ".join(f"w{k % 50}" for k in range(200))
    m = decontam.Matcher([([str(k)], item.encode()) for k in range(5000)])
    spans, names = [], set()
    m(item.encode().split() * 20, spans, names)
    assert decontam.merged(spans) == [(0, 4000)] and len(names) == 5000 and sum(len(s.start) for s in m.searches) == 50
    assert time.time() - at < 30


def test_repeated_items_are_sent_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "x " * 5000)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, "b c d e f g h i j k") for k in range(3000)] + [(9000 + k, "x " * 500) for k in range(500)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.digest(decontam.find_contamination(docs, bench, piece_bytes=1000)).collect()}
    assert (out[1]["n_hit"], out[1]["n_items"]) == (10, 3000) and (out[2]["n_hit"], out[2]["n_items"]) == (5000, 500)


def test_many_removed_lines_of_a_text(spark):
    """Five texts of 100,000 lines that all stand on five sites."""
    lines = "\n".join(f"line {k}" for k in range(100_000))
    df = spark.createDataFrame([(k, f"{lines}\nown {k}", f"s{k}") for k in range(5)], "doc_id long, text string, source string")
    at = time.time()
    out = line_dedup.drop_widespread_lines(df).select("doc_id", "text", F.size("removed").alias("n")).collect()
    assert {(r["doc_id"], r["text"], r["n"]) for r in out} == {(k, f"own {k}", 100_000) for k in range(5)}
    assert time.time() - at < 60
