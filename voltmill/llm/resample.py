"""Importance resampling: documents weighed by how much likelier their words are in a target than in the corpus."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_rows, placed
from .text import alnum_words, durable, in_batches, rows

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Features remembered in each worker with what is known of them.
REMEMBERED = 1 << 17
_FIRST = -(1 << 63)

SCORED = pa.schema([(n, pa.int64()) for n in ("doc_id", "version", "n_words", "n_features", "weight", "score")])
SCORED_DDL = "doc_id long, version long, n_words long, n_features long, weight long, score long"


class Remembered(dict):
    """What a function gives for features; forgets all when there are too many."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = self.f(feature)
        return found


def features(words: list[bytes], longest: int = LONGEST) -> list[bytes]:
    """All runs of 1 to `longest` consecutive words, joined by a blank, repeats included."""
    out = list(words)
    for k in range(2, longest + 1):
        out += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; a task adds up its own before `buckets` numbers of it move."""

    def run(batches):
        own = Remembered(lambda feature: zlib.crc32(feature) % buckets)
        n = np.zeros(buckets, np.int64)
        for (value,) in rows(batches):
            found = features(alnum_words(value), longest)
            if found:
                n += np.bincount(np.fromiter(map(own.__getitem__, found), np.int64, len(found)), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """What a feature of each bucket adds to a document's weight: floor(1000 ln) of its smoothed odds in the target."""
    m = len(corpus)
    whole, wanted = float(corpus.sum() + m), float(target.sum() + m)
    return [math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the id; a null id counts as no digits."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED
) -> DataFrame:
    """(doc_id, version, n_words, n_features, weight, score) of each row; version is a hash of its text.

    Features are runs of 1 to `longest` words of the whole text, hashed to buckets; a document's weight is the sum of
    the gains of its features, read from one array, and score adds noise by which the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). Null and empty texts have no words and the weight 0.
    """
    value = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))

    def run(batches):
        own = Remembered(lambda feature: value[zlib.crc32(feature) % buckets])

        def scored():
            for i, version, body in rows(batches):
                words = alnum_words(body)
                found = features(words, longest)
                weight = sum(map(own.__getitem__, found))
                yield i, version, len(words), len(found), weight, weight + noise(i, seed)

        return in_batches(scored(), SCORED)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text")).mapInArrow(run, SCORED_DDL)


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row, repeated rows included; rank from 1, null if it isn't drawn.

    Of the rows with at least `least_words` words the floor of `percent` % with the highest scores are drawn. Ties go to
    the smaller doc_id, null first, rows of one id by a hash of their text; rows equal in all of this take ranks in the
    order in which they were written. Null texts have no words; other columns are ignored; no rows give none; without a
    target all weights follow from the corpus alone.

    Scores are written once, 48 bytes a row. Radix selection over the digits of (score, doc_id, hash, place) finds the
    last row that is drawn; only drawn rows are sorted, by ranges, and get their ranks.
    """
    scored = weigh(docs, target, doc_id, text, target_text, longest, buckets, seed)
    scored = scored.select("*", (-F.col("score")).alias("_down"), F.coalesce("doc_id", F.lit(_FIRST)).alias("_id"), F.monotonically_increasing_id().alias("_row"))
    scored = durable(scored)
    keys = ["_down", "_id", "version", "_row"]
    fit = scored.filter(F.col("n_words") >= least_words)
    total = fit.count()
    need = percent * total // 100
    drawn = (F.col("n_words") >= least_words) & first_rows(fit, keys, need, total)
    ranked = placed(scored.filter(drawn), [F.col(k) for k in keys], need)
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, (F.col("place") + 1).alias("rank")).unionByName(rest)
