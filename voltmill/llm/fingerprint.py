"""Document fingerprints: a homomorphic multiset hash of paragraphs."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import counted_once, each_copy, in_batches

#: 32-bit lanes that tell multisets of paragraphs apart, summed modulo 2^32.
IDENTITY = 16
#: 32-bit lanes that sketch the paragraphs' 8-byte grams, summed modulo 2^32; gram counts differ by their distance.
CONTENT = 128
GRAM = 8
#: Text of one range of documents in with_next(), and the most ranges, whose ends the driver holds.
RANGE_BYTES = 8 << 20
MAX_RANGES = 20_000
_FIRST = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def of_paragraphs(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the paragraphs' vectors. A paragraph's vector depends on its bytes only, so order does not matter."""
    identity = np.zeros(IDENTITY, np.uint32)
    content = np.zeros(CONTENT, np.int64)
    if paragraphs:
        digests = b"".join([hashlib.blake2b(p, digest_size=4 * IDENTITY).digest() for p in paragraphs])
        identity = np.frombuffer(digests, "<u4").reshape(-1, IDENTITY).sum(0, dtype=np.uint32)
        buffer = b"\n".join([p if len(p) >= GRAM else p.ljust(GRAM, b"\0") for p in paragraphs])
        n = len(buffer) - GRAM + 1
        grams = np.ndarray((n,), "<u8", buffer, strides=(1,)) * _MIX
        slot = (grams >> np.uint64(56)).astype(np.int64)
        counts = np.bincount(slot, minlength=2 * CONTENT)
        ends = np.cumsum([max(len(p), GRAM) + 1 for p in paragraphs[:-1]], dtype=np.int64) - 1
        if len(ends):  # grams across two paragraphs don't count; paragraphs are at least as long as a gram, so none is counted twice
            across = (ends[:, None] - np.arange(GRAM)).ravel()
            counts = counts - np.bincount(slot[across[across < n]], minlength=2 * CONTENT)
        content = counts[0::2] - counts[1::2]
    return identity, content.astype(np.uint32)


def of_text(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return of_paragraphs(text.split(b"\n") if text else [])


def combine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], insert: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint after the paragraphs of `b` are inserted into, or deleted from, those of `a`."""
    return (a[0] + b[0], a[1] + b[1]) if insert else (a[0] - b[0], a[1] - b[1])


def encode(f: tuple[np.ndarray, np.ndarray]) -> str:
    return f[0].astype("<u4").tobytes().hex() + f[1].astype("<u4").tobytes().hex()


def decode(s: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(s)
    return np.frombuffer(raw[: 4 * IDENTITY], "<u4"), np.frombuffer(raw[4 * IDENTITY :], "<u4")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints; else 1 less the squared distance of the sketches over their squared lengths, from 0 to 1."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].view(np.int32).astype(float), b[1].view(np.int32).astype(float)
    whole = (x * x).sum() + (y * y).sum()
    return float(min(1.0, max(0.0, 1 - ((x - y) ** 2).sum() / whole))) if whole else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, gives way to the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = pa.schema(
    [(n, pa.string() if n.endswith(("sha256", "print")) else pa.float64() if n.startswith("near") else pa.int64())
     for n in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")]
)
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COUNTED = RESULT.append(pa.field("copies", pa.int64()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row, repeated rows included; null and empty texts have the fingerprint of no paragraphs.

    Whole texts count, of any length; null ids stay null; other columns are ignored; no rows give no rows.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            found = [encode(of_text(x or b"")) for at in range(0, batch.num_rows, 256) for x in batch.column(1).slice(at, 256).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fingerprint string")


class Ranges:
    """Ranges of documents in order of (id, hash of text), from quantiles of the ids.

    An id that takes up several quantiles, as a null id may, is cut by the hash too, so it is no larger a range.
    """

    def __init__(self, quantiles: list[int]):
        ids, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        starts = [(int(i), _FIRST + (1 << 64) * j // int(n)) for i, n in zip(ids, times, strict=True) for j in range(int(n))]
        self.ids = np.array([i for i, _ in starts], np.int64)
        self.hashes = np.array([h for _, h in starts], np.int64)

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of each row's range: how many ranges begin at it or before."""
        low, at = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for k in np.unique(low[at - low > 1]).tolist():
            rows = np.flatnonzero((low == k) & (at - low > 1))
            at[rows] = k + np.searchsorted(self.hashes[k : at[rows[0]]], hashes[rows], "right")
        return at.astype(np.int32)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text, of its edit by the next document's text, and of their likeness; RESULT has the columns.

    Documents follow each other by doc_id, null first, then by a hash of text; after the last comes the first, so a lone
    document follows itself. Null texts are empty. Repeated rows each give a row; other columns are ignored; no rows
    give none. Texts are streamed, so only one and its successor are held.

    Texts are dealt once, into ranges of about `range_bytes`, or more beyond MAX_RANGES of them, each one task and
    sorted; the first document of a range is dealt to the range before it too, so no task needs another's rows. Rows that
    are repeated very often are counted and dealt once, as all but the last of them follow themselves.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST)).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    n, size = narrow.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], RESULT_DDL)
    narrow = counted_once(narrow, ["id", "hash"])
    wanted = max(1, min(MAX_RANGES, n, -(-size // range_bytes)))
    shares = [k / wanted for k in range(1, wanted)]
    ranges = Ranges(narrow.agg(F.percentile_approx("id", shares, 10 * wanted)).first()[0] if shares else [])

    def least(batches):
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = ranges.of(ids, hashes)
            order = np.lexsort((hashes, ids, at))
            rows = order[np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1])))] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(at[rows]), pa.array(ids[rows]), pa.array(hashes[rows])], ["range", "id", "hash"])

    first = narrow.select("id", "hash").mapInArrow(least, "range int, id long, hash long").groupBy("range").agg(F.min(F.struct("id", "hash")).alias("f"))
    firsts = sorted((r["range"], r["f"]["id"], r["f"]["hash"]) for r in first.collect())  # a row for each range
    number = np.array([r for r, _, _ in firsts], np.int32)
    first_id, first_hash = (np.array([f[k] for f in firsts], np.int64) for k in (1, 2))

    def deal(batches):
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = np.searchsorted(number, ranges.of(ids, hashes)).astype(np.int32)
            yield _dealt(batch, at, 0)
            rows = np.flatnonzero((ids == first_id[at]) & (hashes == first_hash[at]))
            rows = rows[np.unique(at[rows], return_index=True)[1]]  # repeated rows are equal, so one is enough
            if len(rows):
                before = (at[rows] - 1) % len(number)
                yield _dealt(batch.take(pa.array(rows)), before.astype(np.int32), 1)

    dealt = narrow.mapInArrow(deal, "range int, ahead int, id long, hash long, text string, copies long")
    ordered = dealt.repartitionById(len(number), "range").sortWithinPartitions("range", "ahead", "id", "hash")
    return each_copy(ordered.mapInArrow(_compare, RESULT_DDL + ", copies long"))


def _dealt(batch: pa.RecordBatch, at: np.ndarray, ahead: int) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(n, ahead, np.int32)), *batch.columns], ["range", "ahead", "id", "hash", "text", "copies"])


def _compare(batches):
    def pairs():
        held = None
        for batch in batches:
            cols = [batch.column(k) for k in (0, 1, 2, 4, 5)]
            for at in range(0, batch.num_rows, 256):
                for where, ahead, i, text, copies in zip(*(c.slice(at, 256).to_pylist() for c in cols), strict=True):
                    if held and held[0] == where and held[1]:
                        continue  # another copy of the first row of the next range
                    text = text or ""
                    now = (where, ahead, i, text, of_text(text.encode()))
                    if held and held[0] == where:
                        yield held, now, 1
                    if copies > 1 and not ahead:
                        yield now, now, copies - 1
                    held = now

    def rows():
        for (_, _, i, text, own), (_, _, _, following, other), copies in pairs():
            changed = edited(text, following).encode()
            f = of_text(changed)
            yield None if i == _FIRST else i, len(text), hashlib.sha256(changed).hexdigest(), encode(own), encode(f), likeness(own, f), likeness(own, other), copies

    return in_batches(rows(), COUNTED, 512)
