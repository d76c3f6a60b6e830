"""Toxicity by a factorization machine over hashed terms."""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import durable, fold_of, per_row

HASH_BITS = 20
#: Labelled rows that teach the model at most; more are sampled by a hash of doc_id.
MAX_TRAIN_ROWS = 16_000
#: Terms of all these rows together at most; with more, which very long texts have, fewer rows teach it.
MAX_TRAIN_TERMS = 20_000_000
RANK = 8
THRESHOLD = 0.7
#: A term counts fully from this chi square of its labels on, or if it is in this share of the training rows; others
#: count less, down to the least share, as one that is rare and as often in either label has nothing to say yet.
SURE, COMMON, LEAST = 25.0, 0.2, 0.02
#: Terms whose weight and vector are both shorter in the end don't score: hundreds of them together change no decision.
SMALL = 0.003
#: Words remembered with their terms in each worker.
CACHE_WORDS = 100_000

#: a-z and every byte of a non-ASCII character stay; the rest is a blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> set[bytes]:
    return set(text.decode().lower().encode().translate(_LETTERS).split()) if text else set()


def terms(word: bytes) -> tuple[int, ...]:
    """Hashed terms of a word: itself, and its first three to five letters, as inflected forms share them."""
    w = word.decode(errors="ignore")
    return tuple({zlib.crc32(f"{k}{w[:k]}".encode()) & ((1 << HASH_BITS) - 1) for k in (99, 5, 4, 3) if len(w) >= k or k == 99})


@dataclass
class FactorizationMachine:
    """Log odds: bias + sum of w over a document's terms + sum over pairs of terms of the product of their vectors."""

    term: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        self.at = {int(t): k for k, t in enumerate(self.term)}
        self.own = (self.v**2).sum(1)

    def score(self, found: np.ndarray) -> float:
        z = self.bias
        if len(found):
            z += self.w[found].sum() + ((self.v[found].sum(0) ** 2).sum() - self.own[found].sum()) / 2
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Batch:
    """Some training rows: their distinct terms, and for each of their terms which of these, and which row, it is."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, term: np.ndarray):
        n = np.diff(starts)[rows]
        self.rows, n = rows[n > 0], n[n > 0]
        found = np.concatenate([term[starts[r] : starts[r + 1]] for r in self.rows]) if len(self.rows) else np.empty(0, np.int32)
        self.terms, place = np.unique(found, return_inverse=True)
        # as small as they can be, for all batches are held together
        self.place = place.astype(np.uint16 if len(self.terms) < 1 << 16 else np.int32)
        self.row = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        self.first = np.cumsum(n) - n

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.place], self.first, axis=0)

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, weights=x[self.row], minlength=len(self.terms)).astype(np.float32)


def fit(
    starts: np.ndarray, term: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = 12, rate: float = 0.05, size: int = 256,
    shrink_w: float = 4e-3, shrink_v: float = 1e-4, spread: float = 0.01,
) -> FactorizationMachine:
    """Logistic loss over rows of terms, those of row k from starts[k] on; every term has its weight and its vector.

    Proximal AdaGrad over batches, whose order and start follow from a fixed seed, so reruns agree. Every step shrinks
    weights and vectors towards nothing, also those whose terms are not in its batch, when they come up next; in the end
    only terms that come to something are kept. Labels are weighted half way to balance.
    """
    m, n, rng = 1 << HASH_BITS, len(y), np.random.default_rng(7)
    share = float(y.mean()) if n else 0.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(term) or share in (0.0, 1.0):
        return FactorizationMachine(term[:0], bias, np.empty(0), np.empty((0, rank)))
    weight = np.sqrt(np.where(y == 1, 0.5 / share, 0.5 / (1 - share))).astype(np.float32)
    order = rng.permutation(n)
    batches = [_Batch(order[k : k + size], starts, term) for k in range(0, n, size)]
    a, b = np.zeros(m, np.float32), np.zeros(m, np.float32)
    for own in batches:
        a[own.terms] += own.by_term(np.ones(len(own.rows)))
        b[own.terms] += own.by_term(y[own.rows])
    chi = (b - a * share) ** 2 / (a * share * (1 - share) * (1 - a / (n + 1)) + 1e-9)
    scale = np.maximum(np.maximum(np.minimum(1, chi / SURE) ** 2, np.minimum(1, a / (COMMON * n))), LEAST).astype(np.float32)
    w, v = np.zeros(m, np.float32), rng.standard_normal((m, rank), np.float32) * np.float32(spread)
    slope_w, slope_v, slope_b = np.full(m, 1e-6, np.float32), np.full(m, 1e-6, np.float32), 1e-6
    seen, step = np.zeros(m, np.int32), 0

    def shrink(t: np.ndarray) -> None:
        k = (step - seen[t]).astype(np.float32)
        w[t] = np.sign(w[t]) * np.maximum(np.abs(w[t]) - k * rate * shrink_w / np.sqrt(slope_w[t]), 0)
        length = np.sqrt((v[t] ** 2).sum(1)) + 1e-12
        v[t] *= np.maximum(1 - k * rate * shrink_v / np.sqrt(slope_v[t]) / length, 0)[:, None]
        seen[t] = step

    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            own = batches[k]
            step += 1
            if not len(own.rows):
                continue
            t = own.terms
            if step > len(batches):
                shrink(t)
            seen[t] = step
            s = scale[t]
            ws, vs = w[t] * s, v[t] * s[:, None]
            sums = own.by_row(vs)
            z = bias + own.by_row(ws) + ((sums**2).sum(1) - own.by_row((vs**2).sum(1))) / 2
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own.rows]) * weight[own.rows] / len(own.rows)).astype(np.float32)
            down = own.by_term(g)
            dw = down * s
            dv = (np.stack([own.by_term(g * sums[:, j]) for j in range(rank)], 1) - down[:, None] * vs) * s[:, None]
            slope_w[t] += dw**2
            slope_v[t] += (dv**2).mean(1)
            slope_b += float(g.sum()) ** 2
            w[t] -= rate * dw / np.sqrt(slope_w[t])
            v[t] -= rate * dv / np.sqrt(slope_v[t])[:, None]
            bias -= rate * float(g.sum()) / np.sqrt(slope_b)
    met = np.flatnonzero(a)
    shrink(met)
    ws, vs = (w * scale)[met].astype(float), (v * scale[:, None])[met].astype(float)
    kept = (np.abs(ws) > SMALL) | ((vs**2).sum(1) > SMALL**2)
    return FactorizationMachine(met[kept].astype(np.int32), bias, ws[kept], vs[kept])


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = MAX_TRAIN_ROWS, max_terms: int = MAX_TRAIN_TERMS,
) -> FactorizationMachine:
    """A machine from the rows of `docs` that `labels` marks.

    At most about `max_rows` labelled rows of `max_terms` terms in all, chosen by a hash of doc_id, teach it, and the
    driver holds their terms as numbers; no term is left out. Null labels and ids teach nothing; of several labels of
    one id the greatest counts. Without labelled rows, or with one label only, every score is the labels' share.
    """
    marked = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y is not null")
    n = marked.count()
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    if n > max_rows:
        marked = marked.filter(place < int((1 << 30) * max_rows / n))
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))  # at most about max_rows rows of 12 bytes
    text_of = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = text_of.join(F.broadcast(marked), "_id").select("_id", "_text", "_y")

    def extract(rows):
        cache: dict[bytes, tuple[int, ...]] = {}
        for i, value, y in rows:
            found: set[int] = set()
            for w in words(value):
                found.update(cache[w] if w in cache else cache.setdefault(w, terms(w)))
            yield i, y, np.array(sorted(found), "<i4").tobytes()

    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("terms", pa.binary())])
    seen = durable(rows.mapInArrow(per_row(extract, schema, 256), "id long, y int, terms binary"))
    many = (seen.agg(F.sum(F.octet_length("terms").cast("long"))).first()[0] or 0) // 4
    if many > max_terms:
        rate = max_terms / many * min(1.0, max_rows / max(n, 1))
        seen = seen.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * rate))
    held = sorted((r["id"], r["y"], bytes(r["terms"])) for r in seen.coalesce(8).toLocalIterator())  # bytes, an eighth at a time
    y = np.array([x for _, x, _ in held], np.float32)
    starts = np.concatenate(([0], np.cumsum([len(t) // 4 for _, _, t in held]))).astype(np.int64)
    term = np.frombuffer(b"".join([t for _, _, t in held]), "<i4")
    del held
    return fit(starts, term, y)


class Scorer:
    """Scores texts in a worker and remembers the terms of words."""

    def __init__(self, model: FactorizationMachine):
        self.model, self.cache = model, {}

    def terms(self, word: bytes) -> tuple[int, ...]:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        at = self.model.at
        own = self.cache[word] = tuple(at[t] for t in terms(word) if t in at)
        return own

    def __call__(self, text: bytes | None) -> float:
        found: set[int] = set()
        get = self.cache.get
        for w in words(text):
            own = get(w)
            if own is None:
                own = self.terms(w)
            if own:
                found.update(own)
        return self.model.score(np.sort(np.fromiter(found, np.int64, len(found))))


def score(docs: DataFrame, model: FactorizationMachine, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of each row, repeated rows included.

    Null and empty texts have no terms and get the score of the bias alone. Whole texts count, of any length; null ids
    stay null; other columns are ignored; no rows give no rows.
    """

    def run(rows):
        scorer = Scorer(model)
        for i, value in rows:
            s = scorer(value)
            yield i, s, int(s >= threshold)

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(per_row(run, schema), "doc_id long, score double, predicted int")


def hold_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of rows whose crc32(doc_id) mod 3 is not 1 and score all."""
    model = learn(docs, labels.filter(fold_of("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs`, all columns kept, whose score is below the threshold; the model learns as in hold_out().

    Each row is judged by its own text: repeated rows stay or go together, whatever their ids; null and empty texts are
    scored as any other; no rows give no rows.
    """
    model = learn(docs, labels.filter(fold_of(doc_id, 3) != 1), doc_id, text)

    def keep(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(text)
            stays = [scorer(value) < threshold for at in range(0, batch.num_rows, 256) for value in texts.slice(at, 256).cast(pa.large_binary()).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
