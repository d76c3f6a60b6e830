"""Phrase collocations, importance resampling and suffix-sort dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltmill.llm import phrases, ranking, repeats, resample
from voltmill.llm.text import documents

ANY = settings(max_examples=80, deadline=None, suppress_health_check=list(HealthCheck))


# 11 phrases


@ANY
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=25), max_size=6), st.integers(1, 4))
def test_automaton_counts_substrings(sequences, longest):
    a = phrases.SuffixAutomaton()
    for k, s in enumerate(sequences):
        a.add(s, k % 3 + 1)
    joined = [x for s in sequences for x in s]
    got = {tuple(joined[e - k : e]): n for k, ends, counts in a.substrings(longest) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)}
    expected = Counter(tuple(s[i : i + k]) for j, s in enumerate(sequences) for _ in range(j % 3 + 1) for k in range(1, longest + 1) for i in range(len(s) - k + 1))
    assert got == expected
    assert len(a.next) <= 2 * len(joined) + 1


@ANY
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", "é".encode(), b"cc"]), min_size=1, max_size=30), min_size=1, max_size=5), st.integers(1, 3), st.integers(1, 5))
def test_blocks_of_a_shard(sequences, longest, buckets):
    """Long pieces are cut with an overlap that counts once; every phrase is in the bucket of its hash."""
    kept, phrases.PIECE_WORDS = phrases.PIECE_WORDS, 4
    try:
        shard = phrases.Shard(longest)
        for s in sequences:
            shard.add(b" ".join(s))
            shard.add(b"  ".join(s))
        got, where = Counter(), defaultdict(set)
        for bucket, lang, n, packed, counts in shard.blocks("en", buckets):
            own = phrases._unpacked(packed).split(b"\n")
            assert len(own) == n and lang == "en"
            for p, c in zip(own, np.frombuffer(phrases._unpacked(counts), np.int32).tolist(), strict=True):
                got[p] += c
                where[p].add(bucket)
    finally:
        phrases.PIECE_WORDS = kept
    assert +got == Counter(b" ".join(s[i : i + k]) for s in sequences * 2 for k in range(1, longest + 1) for i in range(len(s) - k + 1))
    assert all(len(b) == 1 for b in where.values())


def collocations_by_force(docs, least, longest=3, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        cands = {p: a for p, a in counts.items() if " " in p and a >= least}
        for p, a in cands.items():
            if any(f" {p} " in f" {q} " and 100 * b >= 50 * a for q, b in cands.items() if len(q.split(" ")) > len(p.split(" "))):
                continue
            w = p.split(" ")
            cuts = [(1000000 * a * a // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), counts[" ".join(w[:k])], counts[" ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = ["new", "york", "city", "the", "of", "Of", "é", "a\tb", "x.y", "z!"]
    docs = [(" ".join(rnd.choices(vocab, k=rnd.randrange(60))) + rnd.choice(["", "\r\nNew York city", " the the the the"]), rnd.choice(["en", "fr", None, "und"])) for _ in range(200)]
    docs += [(None, "en"), ("", None), ("new york city " * 300, "en")]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    for least, longest, top, shard in ((10, 3, 2000, 300_000), (3, 4, 7, 500), (2, 2, 50, 100)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, longest=longest, top=top, shard_words=shard).collect())
        assert got == collocations_by_force(docs, least, longest, top)


def test_scores_beyond_64_bits(spark):
    """Counts of ten thousand millions: the product passes 64 bits, the score is exact."""
    a, f = 10**10, 3 * 10**10 + 1
    counts = [("en", 0, "", 10**12), ("en", 1, "new", f), ("en", 1, "york", f + 2), ("en", 2, "new york", a)]
    df = spark.createDataFrame(counts, "lang string, words int, phrase string, f long")
    kept, phrases.phrase_counts = phrases.phrase_counts, lambda *_: df
    try:
        (row,) = phrases.collocations(df).collect()
    finally:
        phrases.phrase_counts = kept
    assert row["score"] == 1000000 * a * a // (f * (f + 2)) and row["n"] == 10**12 and row["rank"] == 1


# 12 resampling


def test_first_rows_and_places(spark):
    """The first rows of a composite key, whatever ties there are, and their places."""
    rnd = random.Random(9)
    data = [(rnd.choice([-(1 << 63), -5, 0, 3, 1 << 40]), rnd.randrange(-3, 3), k) for k in range(400)]
    df = spark.createDataFrame(data, "a long, b long, c long").repartition(3).checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(data, "a long, b long, c long")
    for need in (0, 1, 37, 200, 399, 400):
        chosen = df.filter(ranking.first_rows(df, ["a", "b", "c"], need, 400, digit_bits=3))
        assert sorted(map(tuple, chosen.collect())) == sorted(data)[:need]
    placed = {tuple(r)[:3]: r["place"] for r in ranking.placed(df, [F.col("a"), F.col("b"), F.col("c")], 400).collect()}
    assert placed == {row: k for k, row in enumerate(sorted(data))}


def resampled_by_force(docs, target, longest=1, least=20, percent=10):
    def found(text):
        w = [x.encode() for x in re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return w, [b" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda x: zlib.crc32(x) % 10000
    s, t = (Counter(bucket(x) for text in texts for x in found(text)[1]) for texts in (docs.values(), target))
    whole, wanted = sum(s.values()) + 10000, sum(t.values()) + 10000
    rows = {}
    for i, text in docs.items():
        w, own = found(text)
        weight = sum(math.floor(1000 * math.log((t[bucket(x)] + 1) * whole / ((s[bucket(x)] + 1) * wanted))) for x in own)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = (len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w))
    fit = sorted((-r[2], i) for i, r in rows.items() if r[3] >= least)
    rank = {i: k + 1 for k, (_, i) in enumerate(fit[: percent * len(fit) // 100])}
    return {i: (*r[:3], rank.get(i)) for i, r in rows.items()}


def test_resampling_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    target = [r["text"] for r in bench.collect()]
    for longest, least, percent in ((1, 20, 10), (2, 1, 100), (3, 50, 33)):
        out = resample.resample(documents(spark, sf), bench, longest=longest, least_words=least, percent=percent).collect()
        assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in out} == resampled_by_force(docs, target, longest, least, percent)


def test_resampling_of_repeated_rows(spark):
    """Equal rows have equal scores; each has a rank of its own, and just as many are drawn as there should be."""
    text = "one two three four"
    df = spark.createDataFrame([(7, text)] * 60 + [(None, text)] * 30 + [(k, f"{text} {k}") for k in range(10)], "doc_id long, text string")
    out = resample.resample(df, spark.createDataFrame([("one two",)], "text string"), least_words=2, percent=37).collect()
    drawn = sorted((r["rank"], -r["score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in out if r["rank"])
    assert [k for k, _, _ in drawn] == list(range(1, 38)) and len(out) == 100
    assert [d[1:] for d in drawn] == sorted(d[1:] for d in drawn)
    rest = [(-r["score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in out if not r["rank"]]
    assert max(d[1:] for d in drawn) <= min(rest)


# 13 repeats


def repeats_by_force(rows, length):
    """rows: (doc_id, text), each of its own."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = len(t), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()
    return out


@ANY
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", max_size=14)), min_size=1, max_size=12), st.booleans())
def test_suffixes_are_in_order(rows, collide):
    """Groups in order with their common bytes, also if hashes say that all texts are equal."""
    rows = sorted(rows, key=lambda r: r[0])
    raw = np.frombuffer("".join(t for _, t in rows).encode() or b"x", np.uint8)
    room = np.array([len(t) for _, t in rows])
    at, group = np.cumsum(room) - room, np.array([g for g, _ in rows])
    s = repeats.Suffixes(raw)
    if collide:
        s.hashes = lambda at, length: np.zeros(len(at), np.uint64)
    items, shared = s.order(at, room, group)
    assert [(rows[k][0], rows[k][1]) for k in items] == sorted(rows)
    for p in range(1, len(rows)):
        (g, x), (h, y) = rows[items[p - 1]], rows[items[p]]
        common = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert g != h or shared[p] == common


@ANY
@given(st.binary(min_size=0, max_size=120), st.integers(2, 9))
def test_anchors_follow_from_the_string(raw, length):
    """Each string has one anchor, at the same place in equal strings."""
    raw = bytes(97 + b % 2 for b in raw)
    g, place, first, last = repeats.anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]), length, 2)
    of = {s: (h, p - s) for h, p, a, b in zip(g.tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1)}
    assert sorted(of) == list(range(max(0, len(raw) - length + 1)))
    by = defaultdict(set)
    for s, own in of.items():
        by[raw[s : s + length]].add(own)
        assert 0 <= own[1] <= length - 2
    assert all(len(x) == 1 for x in by.values())


def test_repeats_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "é", "ü", str(rnd.randrange(10**6))]) for _ in range(n))
    shared, base = words(30), words(80)
    rows = [words(rnd.randrange(60)) for _ in range(60)]
    rows += [f"{words(5)} {shared} {words(5)}" for _ in range(40)]  # one passage
    rows += [base] * 15 + [base.replace(base.split()[k], "other", 1) for k in range(15)]  # copies
    rows += ["ab" * 200, "a" * 300, "a" * 299 + "b", "", None, "x" * 99, words(3000) + base, base * 3]
    rnd.shuffle(rows)
    rows = [(k * 3 - 50, t) for k, t in enumerate(rows)] + [(None, shared + base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = {n: repeats_by_force(rows, n) for n in (100, 30)}
    monkeypatch.setattr(repeats, "BLOCK", 2000)
    for length, gram, chunk, frequent in ((100, 32, 4 << 20, 1 << 14), (100, 32, 3000, 4), (30, 12, 6000, 1), (30, 30, 1 << 20, 1 << 14)):
        out = repeats.digest(repeats.repeated_spans(df, length=length, gram=gram, chunk_bytes=chunk, frequent=frequent)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == expected[length]
    kept = {r["doc_id"]: hashlib.sha256(bytes(r["kept"])).hexdigest() for r in repeats.drop_repeats(df).collect()}
    assert kept == {i: x[3] for i, x in expected[100].items()}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("repeats_")]


def test_equal_rows_are_one_document(spark):
    """Rows of one id and text come back as often as they are there, and keep their first strings."""
    text = "".join(random.Random(2).choices("abcdefgh", k=150))
    df = spark.createDataFrame([(1, text)] * 5000 + [(2, text + "x")] * 3, "doc_id long, text string").repartition(4)
    out = Counter((r["doc_id"], r["n_removed"], r["n_spans"]) for r in repeats.digest(repeats.repeated_spans(df)).collect())
    assert out == {(1, 0, 0): 5000, (2, 150, 1): 3}
