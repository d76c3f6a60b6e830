"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import alnum_words, in_batches

WINDOW = 10
BLOCK = 3
#: The benchmark goes to the workers in pieces of about this many bytes of text, or of one item that is longer.
PIECE_BYTES = 2 << 20
#: A worker keeps the tables of this many pieces; if there are more it holds documents of HELD_BYTES against each in turn.
KEPT_PIECES = 3
HELD_BYTES = 32 << 20

FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("item_ids", pa.list_(pa.string())),
    ]
)
FOUND_DDL = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"


class WuManber:
    """Distinct patterns of one length: the windows of `length` words of some items.

    A block is the last `block` words under the pattern's end. A block that ends no pattern says how far the end may
    move, any that occurs in none allows the largest shift. Where it may not move, the hash of all words under the
    pattern names a bucket of patterns; comparison word by word confirms them. Equal windows are one pattern, however
    often they come, with the items that have them.
    """

    def __init__(self, length: int, block: int = BLOCK):
        self.length, self.block = length, min(block, length)
        self.most = length - self.block + 1
        self.words: list[bytes] = []
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[int, int | list[int]] = {}  # numbers of patterns
        self.start: list[int] = []  # where a pattern begins in `words`
        self.items: list[list[int] | int] = []  # that have it, or the number of the set of these

    def add(self, item: int, words: list[bytes]) -> None:
        """The windows of an item of at least `length` words, after those of smaller numbers."""
        first, block, shift = len(self.words), self.block, self.shift
        self.words += words
        for end in range(block, self.length):  # blocks within the first window
            key = tuple(words[end - block : end])
            shift[key] = min(shift.get(key, self.most), self.length - end)
        for end in range(self.length, len(words) + 1):  # each ends a window
            shift[tuple(words[end - block : end])] = 0
            under = words[end - self.length : end]
            known = self.find(under)
            if known is None:
                own = hash(tuple(under))
                held = self.bucket.get(own)
                self.bucket[own] = len(self.start) if held is None else [*(held if isinstance(held, list) else [held]), len(self.start)]
                self.start.append(first + end - self.length)
                self.items.append([item])
            elif self.items[known][-1] != item:
                self.items[known].append(item)

    def share(self, sets: dict[tuple[int, ...], int]) -> None:
        """Put numbers of sets of items in place of the sets; windows that follow each other mostly have the same."""
        self.items = [sets.setdefault(tuple(own), len(sets)) for own in self.items]

    def find(self, under: list[bytes]) -> int | None:
        found = self.bucket.get(hash(tuple(under)))
        for k in found if isinstance(found, list) else () if found is None else (found,):
            if self.words[self.start[k] : self.start[k] + self.length] == under:
                return k
        return None

    def search(self, words: list[bytes], spans: list[tuple[int, int]], sets: set[int]) -> None:
        """Add the spans under occurrences, merged as they come, and the sets of the items that have windows there."""
        length, block, most, get = self.length, self.block, self.most, self.shift.get
        end, n = length, len(words)
        first = last = -1
        while end <= n:
            step = get(tuple(words[end - block : end]), most)
            if step:
                end += step
                continue
            k = self.find(words[end - length : end])
            if k is not None:
                sets.add(self.items[k])
                if end - length > last:
                    if last >= 0:
                        spans.append((first, last))
                    first = end - length
                last = end
            end += 1
        if last >= 0:
            spans.append((first, last))


class Matcher:
    """A search for each length of window: the full one, and those of items that have fewer words."""

    def __init__(self, items: Iterable[tuple[list[str], bytes | None]], window: int = WINDOW):
        by_length: dict[int, WuManber] = {}
        known: dict[bytes, bytes] = {}
        same: dict[tuple[bytes, ...], list[str]] = {}  # items of equal words are one
        for names, text in items:
            words = tuple(known.setdefault(w, w) for w in alnum_words(text))
            if words:
                same.setdefault(words, []).extend(names)
        self.names = list(same.values())
        for k, words in enumerate(same):
            size = min(window, len(words))
            if size not in by_length:
                by_length[size] = WuManber(size)
            by_length[size].add(k, list(words))
        self.searches = [by_length[n] for n in sorted(by_length)]
        sets: dict[tuple[int, ...], int] = {}
        for s in self.searches:
            s.share(sets)
        self.sets = list(sets)

    def __call__(self, words: list[bytes], spans: list[tuple[int, int]], names: set[str]) -> None:
        """Add the spans under any occurrence, and the names of the items that have windows there."""
        found: set[int] = set()
        for s in self.searches:
            s.search(words, spans, found)
        for item in set().union(*(self.sets[k] for k in found)):
            names.update(self.names[item])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    for at in range(0, batch.num_rows, 256):
        yield from batch.column(column).slice(at, 256).cast(pa.large_binary()).to_pylist()


def _searched(batches: Iterable[pa.RecordBatch], column: int, pieces: list[Broadcast], window: int):
    """Yield each batch with (n_words, spans, names) of its rows, results of all pieces together."""
    few = len(pieces) <= KEPT_PIECES
    kept: dict[int, Matcher] = {}

    def matcher(k: int) -> Matcher:
        found = kept.get(k) or Matcher(pieces[k].value, window)
        pieces[k].__dict__.pop("_value", None)  # the tables hold what they need
        if few:
            kept[k] = found
        return found

    def found(held: list[pa.RecordBatch]):
        out = [[(0, [], set()) for _ in range(b.num_rows)] for b in held]
        for k in range(max(1, len(pieces))):
            search = matcher(k) if pieces else None
            for own, batch in zip(out, held, strict=True):
                for r, text in enumerate(_texts(batch, column)):
                    words = alnum_words(text)
                    _, spans, names = own[r]
                    own[r] = len(words), spans, names
                    if search:
                        search(words, spans, names)
        for own, batch in zip(out, held, strict=True):
            yield batch, [(n, merged(spans), names) for n, spans, names in own]

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if few or size >= HELD_BYTES:
            yield from found(held)
            held, size = [], 0
    if held:
        yield from found(held)


def _pieces(benchmark: DataFrame, item_id: str, item_text: str, piece_bytes: int) -> list[Broadcast]:
    """The distinct texts with the ids of their items, as files that workers fetch; the driver holds a piece at a time."""
    sc = benchmark.sparkSession.sparkContext
    out: list[Broadcast] = []
    held: list[tuple[list[str], bytes]] = []
    size = 0
    text = F.col(item_text).cast("binary")
    items = benchmark.filter(F.col(item_text).isNotNull()).groupBy(text.alias("text")).agg(F.collect_set(F.col(item_id).cast("string")).alias("names"))
    for item, names in items.toLocalIterator():
        held.append((names, bytes(item)))
        size += len(item) + 40 * (len(names) + 1)
        if size >= piece_bytes:
            out.append(sc.broadcast(held))
            held, size = [], 0
    if held:
        out.append(sc.broadcast(held))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Word spans of each document that benchmark windows cover: (doc_id, n_words, spans, item_ids).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. One row
    comes back for each input row, repeated rows included, whatever ids they have; null or empty text has no words and
    no spans; items without words match nothing; an item whose id is null covers words as any other but is never named;
    without rows in either table the result is empty or clean. Other columns of the inputs are ignored. item_ids are
    distinct, as text, in code point order.

    The benchmark is the stated query set, of any size: documents are read once, and each row meets all its pieces in
    the task that reads it.
    """
    pieces = _pieces(benchmark, item_id, item_text, piece_bytes)

    def run(batches):
        def rows():
            for batch, found in _searched(batches, 1, pieces, window):
                for i, (n, spans, names) in zip(batch.column(0).to_pylist(), found, strict=True):
                    yield i, n, [{"start": s, "end": e} for s, e in spans], sorted(names)

        return in_batches(rows(), FOUND)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FOUND_DDL)


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the item ids."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    max_share: float = 0.0,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Rows of `docs`, all columns kept, of which at most `max_share` of the words lie under benchmark windows.

    Each row is judged by its own text where it is read: null and repeated ids don't matter, repeated rows stay or go
    together, and rows of null or empty text stay. No rows give no rows.
    """
    pieces = _pieces(benchmark, item_id, item_text, piece_bytes)
    at = docs.columns.index(text)

    def run(batches):
        for batch, found in _searched(batches, at, pieces, window):
            stays = [sum(e - s for s, e in spans) <= max_share * n for n, spans, _ in found]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
