"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from voltmill.llm import decontam, fingerprint, langid, license_scan, line_dedup, mixing, neardup, packing, phrases, repeats, resample, secrets, toxicity

LONG = "lorem ipsum dolor sit amet " * 8000
TEXTS = [(1, "the cat sat on the mat and then it slept well", "en", "s0", 5), (1, "the cat sat on the mat and then it slept well", "en", "s0", 5), (2, None, None, None, None), (3, "", "en", "s1", 0),
         (None, "le chat est sur la table et il dort", "fr", "s1", None), (4, LONG, "la", None, 1), (5, "\n\n", None, "s2", 2), (6, "123 !!", "en", "s2", 6), (7, "the cat sat on the mat and then it slept well", "en", "s3", 5)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ["doc", "n", "size", "spans", "_id", "_text", "_k", "_copies", "component", "node", "h1", "target", "cell_n", "score", "values", "range", "label", "chunk", "version", "copies", "phrase", "words", "key", "place", "weight", "_part", "_salt"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, KIND).withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "sat on the mat"), (2, None), (None, "cat"), (3, ""), (1, "sat on the mat")], "item_id long, text string").withColumn("n_words", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (7, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))


def operators(docs, bench, labels):
    yield "near_dup", neardup.near_duplicates(docs, words=2), True
    yield "secrets", secrets.digest(secrets.find_secrets(docs)), True
    yield "mix", mixing.mix(docs), True
    yield "toxicity", toxicity.hold_out(docs, labels), True
    yield "decontam", decontam.digest(decontam.find_contamination(docs, bench)), True
    yield "decontam in blocks", decontam.digest(decontam.find_contamination(docs, bench, piece_bytes=50)), True
    yield "fingerprint", fingerprint.with_next(docs), True
    yield "fingerprints", fingerprint.fingerprints(docs), True
    yield "langid", langid.hold_out(docs), True
    yield "license", license_scan.digest(license_scan.find_licenses(docs)), True
    yield "lines", line_dedup.digest(line_dedup.drop_widespread_lines(docs)), True
    yield "resample", resample.resample(docs, bench), True
    yield "resample by pairs", resample.resample(docs, bench, longest=2, least_words=1, percent=50), True
    yield "repeats", repeats.digest(repeats.repeated_spans(docs, length=20, gram=8)), True
    yield "drop_repeats", repeats.drop_repeats(docs), True
    yield "collocations", phrases.collocations(docs, least=1), False
    yield "pack", packing.pack(docs), False
    yield "drop_toxic", toxicity.drop_toxic(docs, labels), False
    yield "drop_near", neardup.drop_near_duplicates(docs), False
    yield "drop_contaminated", decontam.drop_contaminated(docs, bench), False
    yield "take", mixing.take(docs), False


def test_odd_rows(docs, bench, labels):
    for name, out, by_row in operators(docs, bench, labels):
        rows = out.collect()
        if by_row:
            assert sorted(r["doc_id"] or -1 for r in rows) == [-1, 1, 1, 2, 3, 4, 5, 6, 7], name
            twice = [r for r in rows if r["doc_id"] == 1]
            assert name in ("mix", "fingerprint", "resample", "resample by pairs") or twice[0] == twice[1], name
    kept = {c for c in docs.columns}
    assert set(toxicity.drop_toxic(docs, labels).columns) == set(mixing.take(docs).columns) == kept


def test_empty_tables(docs, bench, labels):
    for name, out, _ in operators(docs.limit(0), bench.limit(0), labels.limit(0)):
        assert out.count() == 0, name


def test_empty_references(docs, bench, labels):
    assert decontam.digest(decontam.find_contamination(docs, bench.limit(0))).filter("contaminated").count() == 0
    assert toxicity.hold_out(docs, labels.limit(0)).filter("score < 0 or score > 1").count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn_profiles(docs.limit(0))).collect()} == {"und"}


def test_texts_without_words_are_linked_with_nothing(docs):
    out = {r["doc_id"]: r for r in neardup.near_duplicates(docs, words=2).collect()}
    assert out[7]["component_id"] == 1 and not out[7]["kept"]
    assert all(out[k]["component_id"] == k and out[k]["n_shingles"] == 0 for k in (2, 3, 5)) and out[6]["n_shingles"] == 1
    assert out[None]["component_id"] is None and out[None]["kept"]


def test_decontamination_in_blocks_is_the_same(docs, bench):
    one, many = (decontam.digest(decontam.find_contamination(docs, bench, piece_bytes=b)).collect() for b in (1 << 20, 40))
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert {r["doc_id"]: r["n_hit"] for r in one}[7] == 5  # "cat", whose item has no id, and "sat on the mat"


def test_contamination_is_of_rows_whatever_their_ids(spark):
    """Clean rows that share an id, or null, with contaminated ones; items without an id; one piece and many."""
    rows = [(1, "sat on the mat now"), (1, "all of it is clean"), (None, "see the secret text here"), (None, "nothing at all in it"), (2, None), (2, "sat on the mat now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    bench = spark.createDataFrame([(5, "sat on the mat"), (None, "the secret text"), (6, "x y z")] + [(k, f"w{k} w{k} w{k}") for k in range(10, 20)], "item_id long, text string")
    for size in (1 << 20, 10):
        got = decontam.digest(decontam.find_contamination(df, bench, piece_bytes=size)).collect()
        assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in got) == [(0, 5, 0, 0), (0, 5, 3, 0), (1, 5, 0, 0), (1, 5, 4, 1), (2, 0, 0, 0), (2, 5, 4, 1)]
        kept = decontam.drop_contaminated(df, bench, piece_bytes=size)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "nothing at all in it"), (1, "all of it is clean"), (2, "")]


def test_stages_of_the_pipeline(spark, docs, bench, labels, tmp_path):
    """Every stage, and the whole, on odd rows and on none; all but the last keep the columns."""
    import corpus_pipeline as c

    for rows, sf in ((docs, tmp_path / "odd"), (docs.limit(0), tmp_path / "none")):
        for name, df in (("documents", rows), ("benchmark", bench), ("labels", labels)):
            df.write.parquet(f"{sf}/{name}.parquet")
        for name, stage in c.STAGES:
            out = stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), str(sf))
            assert name == "packing" or out.count() <= 3 * rows.count(), name
            assert name == "packing" or out.columns == docs.columns, name
        assert (c.run(spark, str(sf)).count() > 0) == (rows.count() > 0)


def test_decisions_are_of_rows(spark, docs, labels):
    """What the stages drop: a near copy by its id, others by their own text."""
    kept = sorted(r["doc_id"] or -1 for r in neardup.drop_near_duplicates(docs).collect())
    assert kept == [-1, 1, 1, 2, 3, 4, 5, 6]  # 7 has the text of 1
    taken = {r["doc_id"] for r in mixing.take(docs).collect()}
    assert not taken & {2, 3, 5}  # no words
    same = toxicity.drop_toxic(docs, labels, threshold=2.0)
    assert same.count() == docs.count() and toxicity.drop_toxic(docs, labels, threshold=-1.0).count() == 0
