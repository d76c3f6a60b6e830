"""Removal of repeated passages by a suffix sort whose comparisons are made of prefix hashes.

Every string of LENGTH bytes has an anchor, the gram in it whose hash is smallest, so equal strings have equal anchors at
one place. Only texts around anchors that occur twice or more, at most two strings long each, go into the suffix sort.
"""

import hashlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import durable, each_copy, join_spread

#: Bytes of the strings that must not repeat, and of the grams that are anchors.
LENGTH = 100
GRAM = 32
#: Bytes of text of one chunk, which is held whole, and the most buckets into which chunks are written.
CHUNK_BYTES = 4 << 20
MAX_BUCKETS = 20_000
#: The surroundings of an anchor that occurs more often are dealt string by string, so that no anchor's group is larger.
FREQUENT = 1 << 14
#: Surroundings that are put in order together, unless one anchor has more, and bytes whose anchors are found together.
SORTED_AT_ONCE = 1 << 15
BLOCK = 1 << 19
_FIRST = -(1 << 63)
_BASE = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least `n` of each."""
    if n > len(_POWERS[0]):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(max(n, 1 << 20), np.uint64(base))
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Suffixes:
    """Suffixes of a buffer, compared by polynomial prefix hashes."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _powers(len(raw) + 1)
        self.raw = raw
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)))

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        """Hash of the `length` bytes from each place; depends on these bytes alone."""
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes, up to `most`, from places x and y on agree by their hashes: a binary search for each pair."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes(x, middle) == self.hashes(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _ahead(self, at: np.ndarray, room: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The byte after the common ones, or -1 at the end of a suffix."""
        return np.where(common < room, self.raw[np.minimum(at + common, len(self.raw) - 1)].astype(np.int16), -1)

    def _compare(self, at: np.ndarray, room: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        common = self.common(at[x], at[y], np.minimum(room[x], room[y]))
        return self._ahead(at[x], room[x], common) - self._ahead(at[y], room[y], common)

    def order(self, at: np.ndarray, room: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes of each group in order, and the bytes that each has in common with the one before it.

        A suffix has `room` bytes; groups are runs of equal numbers. Mergesort from below, all groups and all pairs of
        runs at once: a suffix moves by the number of suffixes of the other run before it, which a binary search finds.
        The result is verified byte by byte; groups in which hashes collided are sorted by their bytes.
        """
        n = len(at)
        place = np.arange(n)
        begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(begins, n))
        begin, end = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
        items, width = place, 1
        while width < sizes.max(initial=0):
            own = begin + (place - begin) // width * width
            right = (own - begin) // width % 2 == 1
            other = np.where(right, own - width, own + width)
            first = np.minimum(other, end)
            low, high = first.copy(), np.minimum(other + width, end)
            live = np.flatnonzero(low < high)
            while len(live):
                middle = (low[live] + high[live]) // 2
                less = self._compare(at, room, items[middle], items[live])
                on = (less < 0) | ((less == 0) & right[live])
                low[live], high[live] = np.where(on, middle + 1, low[live]), np.where(on, high[live], middle)
                live = live[low[live] < high[live]]
            merged = np.empty_like(items)
            merged[np.where(right, other, own) + place - own + low - first] = items
            items, width = merged, 2 * width
        before, now = items[:-1], items[1:]
        inner = group[1:] == group[:-1]
        common = np.where(inner, self.common(at[before], at[now], np.where(inner, np.minimum(room[before], room[now]), 0)), 0)
        wrong = inner & ((self._ahead(at[before], room[before], common) > self._ahead(at[now], room[now], common)) | ~self._verified(at[before], at[now], common))
        shared = np.concatenate((np.zeros(1, np.int64), common))[:n]
        for g in np.unique(group[1:][wrong]):
            k = np.flatnonzero(group == g)
            items[k] = sorted(k, key=lambda i: self.raw[at[i] : at[i] + room[i]].tobytes())
            for a, b in zip(k, k[1:], strict=False):
                x, y = (self.raw[at[items[j]] : at[items[j]] + room[items[j]]] for j in (a, b))
                m = min(len(x), len(y))
                differ = np.flatnonzero(x[:m] != y[:m])
                shared[b] = differ[0] if len(differ) else m
        return items, shared

    def _verified(self, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        steps = np.arange(common.max(initial=0))
        for a in range(0, len(x), 1 << 14):
            k = slice(a, a + (1 << 14))
            inside = steps < common[k, None]
            p, q = (np.where(inside, z[k, None] + steps, 0) for z in (x, y))
            out[k] = (self.raw[p] == self.raw[q]).all(1)
        return out


def anchors(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last) of each anchor: of the strings of `length` bytes from first to last it is the anchor.

    `ends` are the ends of the texts that `raw` joins; no string crosses them. Of equal smallest grams the first one counts.
    """
    n = len(raw) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    grams = _mixed(Suffixes(raw).hashes(np.arange(len(raw) - gram + 1), gram))
    value, best, width, span = grams, np.arange(len(grams), dtype=np.int32), 1, length - gram + 1
    while width < span:
        step = min(width, span - width)
        after = value[step:] < value[:-step]
        best = np.where(after, best[step:], best[:-step])
        value = np.where(after, value[step:], value[:-step])
        width += step
    sizes = np.diff(np.concatenate(([0], ends)))
    inside = np.arange(n) + length <= np.repeat(ends, sizes)[:n]
    edges = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (inside[1:] != inside[:-1]))))
    last = np.append(edges[1:], n) - 1
    kept = inside[edges]
    first, last = edges[kept], last[kept]
    place = best[first].astype(np.int64)
    return grams[place].view(np.int64), place, first, last


def _blocks(texts, length: int):
    """Texts joined to blocks, long ones cut with an overlap: (raw, ends, number of the text, its first byte) of each."""
    held, numbers, firsts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), BLOCK):
            piece = text[at : at + BLOCK + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > BLOCK + length:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(p) for p in held]), np.array(numbers), np.array(firsts)
                held, numbers, firsts, size = [], [], [], 0
            held.append(piece)
            numbers.append(k)
            firsts.append(at)
            size += len(piece)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(p) for p in held]), np.array(numbers), np.array(firsts)


def _signed(x: int) -> int:
    return (x & ((1 << 64) - 1)) - ((x & (1 << 63)) << 1)


def _rows_once(batches):
    """(doc, version, text, copies): equal rows of a batch as one row with their number."""
    for batch in batches:
        seen: dict[tuple[int, int], list[int]] = {}
        for r, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            seen.setdefault(own, []).append(r)
        rows = batch if len(seen) == batch.num_rows else batch.take(pa.array([r[0] for r in seen.values()]))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([len(r) for r in seen.values()], pa.int64())], ["doc", "version", "text", "copies"])


def _documents_once(batches):
    """Rows in order of (doc, version), equal ones as one row with the sum of their copies."""
    held, copies = None, 0
    for batch in batches:
        doc, version, n = (batch.column(c).to_numpy() for c in ("doc", "version", "copies"))
        if not len(doc):
            continue
        starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]))))
        sums = np.add.reduceat(n, starts)
        if held is not None and held.column("doc")[0].as_py() == doc[0] and held.column("version")[0].as_py() == version[0]:
            sums[0] += copies
        elif held is not None:
            yield held.set_column(held.schema.get_field_index("copies"), "copies", pa.array([copies], pa.int64()))
        rows = batch.take(pa.array(starts))
        rows = rows.set_column(rows.schema.get_field_index("copies"), "copies", pa.array(sums))
        yield rows.slice(0, len(starts) - 1)
        held, copies = rows.slice(len(starts) - 1), int(sums[-1])
    if held is not None:
        yield held.set_column(held.schema.get_field_index("copies"), "copies", pa.array([copies], pa.int64()))


def _count_anchors(length: int, gram: int):
    """(g, chunk, n) of the anchors of each chunk; the rows of a chunk stand together."""

    def run(batches):
        def counted(chunk, texts):
            found = [anchors(raw, ends, length, gram)[0] for raw, ends, _, _ in _blocks(texts, length)]
            g, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), chunk, np.int64)), pa.array(n.astype(np.int64))], ["g", "chunk", "n"])

        now, texts = None, []
        for batch in batches:
            chunks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if texts and chunks[a] != now:
                    yield counted(now, texts)
                    texts = []
                now = int(chunks[a])
                texts += batch.column(1).slice(a, b - a).to_pylist()
        if texts:
            yield counted(now, texts)

    return run


AROUND = pa.schema(
    [("key", pa.int64()), ("chunk", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()), ("at", pa.int32()), ("body", pa.binary())]
)
AROUND_DDL = "key long, chunk long, doc long, version long, first long, windows int, at int, body binary"


def _in_order(chunk: pa.Table) -> list[tuple[int, int, bytes]]:
    """(doc, version, text) of the rows of a chunk, the earliest first."""
    return sorted(zip(*(chunk.column(c).to_pylist() for c in ("doc", "version", "text")), strict=True), key=lambda r: r[:2])


def _surroundings(length: int, gram: int):
    """Of a chunk, the texts around anchors that occur elsewhere too, each once; what repeats them in the chunk is noted with no body."""

    def run(chunk: pa.Table, repeated: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        open_: list[int] = []  # doc, first string and behind the last one of a stretch that goes

        def close() -> None:
            if open_:
                k, first, end = open_
                rows.append((_signed(first * _BASE + docs[k][0] * 31 + docs[k][1]), number, docs[k][0], docs[k][1], first, end - first, 0, None))
                open_.clear()

        def gone(k: int, first: int, windows: int) -> None:
            if open_ and open_[0] == k and first <= open_[2]:
                open_[2] = max(open_[2], first + windows)
            else:
                close()
                open_.extend((k, first, first + windows))

        known = np.array(repeated.column("g").to_pylist(), np.int64) if not repeated.num_rows else repeated.column("g").to_numpy()
        if chunk.num_rows and len(known):
            number = chunk.column("chunk")[0].as_py()
            by = np.argsort(known)
            known, often = known[by], repeated.column("frequent").to_numpy(zero_copy_only=False).astype(bool)[by]
            docs, seen = _in_order(chunk), set()
            for raw, ends, texts, firsts in _blocks([d[2] for d in docs], length):
                g, place, first, last = anchors(raw, ends, length, gram)
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                hit = np.flatnonzero(known[at] == g)
                of = np.searchsorted(ends, place[hit], "right")
                begin = np.concatenate(([0], ends))[of]
                data = raw.tobytes()
                for key, p, lo, hi, frequent, k, shift in zip(
                    g[hit].tolist(), place[hit].tolist(), first[hit].tolist(), last[hit].tolist(), often[at[hit]].tolist(), texts[of].tolist(), (firsts[of] - begin).tolist(), strict=True
                ):
                    doc, version, _ = docs[k]
                    for a, b in ((s, s) for s in range(lo, hi + 1)) if frequent else ((lo, hi),):
                        body = data[a : b + length]
                        if frequent:
                            key = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True) ^ (p - a)
                        own = (key, p - a, body)
                        if own in seen:
                            gone(k, a + shift, b - a + 1)
                        else:
                            seen.add(own)
                            rows.append((key, number, doc, version, a + shift, b - a + 1, p - a, body))
            close()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), AROUND, strict=True)] if rows else [pa.array([], f.type) for f in AROUND], schema=AROUND)

    return run


def repeated_strings(key: np.ndarray, at: np.ndarray, windows: np.ndarray, bodies: list[bytes], length: int) -> np.ndarray:
    """Which strings of which surroundings stand in an earlier one of the same key: a row for each, a column for each place of the anchor.

    Rows of a key stand together, the earliest first. The suffixes from the anchors on, and the reversed texts before
    them, are sorted; where neighbours have enough bytes in common on either side, the strings are equal.
    """
    sizes = np.array([len(b) for b in bodies])
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    anchor = np.cumsum(sizes) - sizes + at
    after, shared_after = Suffixes(raw).order(anchor, sizes - at, key)
    before, shared_before = Suffixes(np.ascontiguousarray(raw[::-1])).order(len(raw) - anchor, at, key)
    other = np.concatenate(([True], key[1:] != key[:-1]))
    span = int(at.max()) + 1
    out = np.zeros((len(key), span), bool)
    right, left = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for o in range(span):
        k = np.flatnonzero((o <= at) & (o > at - windows))
        if not len(k):
            continue
        right[after] = np.cumsum(other | (shared_after < length - o))
        left[before] = np.cumsum(other | (shared_before < o))
        _, first = np.unique(right[k] * (len(key) + 1) + left[k], return_index=True)
        out[k, o] = True
        out[k[first], o] = False
    return out


def _resolve(length: int):
    """(chunk, doc, version, start, end) of bytes that go, from the surroundings of each key."""

    def found(table: pa.Table):
        names = ("key", "chunk", "doc", "version", "first", "windows", "at")
        key, chunk, doc, version, first, windows, at = (table.column(c).to_numpy() for c in names)
        bodies = table.column("body").to_pylist()
        out = [[], [], [], [], []]

        def put(k: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            for held, values in zip(out, (chunk[k], doc[k], version[k], start, end), strict=True):
                held.append(values)

        order = np.lexsort((first, version, doc, key))
        seen: set[tuple] = set()
        stays, goes = [], []
        for k in order.tolist():
            own = (key[k], at[k], bodies[k])
            if bodies[k] is None or own in seen:
                goes.append(k)
            else:
                seen.add(own)
                stays.append(k)
        k = np.array(goes, np.int64)
        put(k, first[k], first[k] + windows[k] - 1 + length)
        k = np.array(stays, np.int64)
        if len(k):
            _, of, n = np.unique(key[k], return_inverse=True, return_counts=True)
            k = k[n[of] > 1]
        if len(k):
            gone = repeated_strings(key[k], at[k].astype(np.int64), windows[k], [bodies[x] for x in k.tolist()], length)
            edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)  # strings of places low to high - 1 of the anchor
            own = k[row]
            put(own, first[own] + at[own] - high + 1, first[own] + at[own] - low + length)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["chunk", "doc", "version", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= SORTED_AT_ONCE:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                if cut:
                    yield found(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(table) - cut
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    return run


SPANS_DDL = "doc_id long, version long, copies long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string"
SPANS = pa.schema(
    [("doc_id", pa.int64()), ("version", pa.int64()), ("copies", pa.int64()), ("n_bytes", pa.int64()),
     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())]
)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text without the bytes of its spans, which are in order."""
    ends = [0, *(e for _, e in spans)]
    return b"".join([text[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(text)], strict=True)])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _without(chunk: pa.Table, gone: pa.Table) -> pa.Table:
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, version, start, end in zip(*(gone.column(c).to_pylist() for c in ("doc", "version", "start", "end")), strict=True):
        by.setdefault((doc, version), []).append((start, end))
    rows = []
    for doc, version, copies, text in zip(*(chunk.column(c).to_pylist() for c in ("doc", "version", "copies", "text")), strict=True):
        spans = _joined(by.get((doc, version), []))
        kept = hashlib.sha256(cut(text, spans)).hexdigest()
        rows.append((None if doc == _FIRST else doc, version, copies, len(text), [{"start": s, "end": e} for s, e in spans], kept))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SPANS, strict=True)] if rows else [pa.array([], f.type) for f in SPANS], schema=SPANS)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, version, copies, n_bytes, spans, kept_sha256) of each document: the spans of its bytes that go.

    A byte goes if a string of `length` bytes over it starts earlier too: in a document of smaller id, null first, or
    earlier in the same one; rows of one id follow each other by `version`, a hash of their text, and rows equal in both
    are one document with so many copies. Texts are UTF-8; null and empty ones have no bytes, and nothing goes from texts
    shorter than `length`. Strings are judged on the input. Other columns are ignored; no rows give no rows.

    Texts are dealt once, by a hash, to chunks of about `chunk_bytes`, and written as a table bucketed by chunk, which
    the later steps read without moving it: the anchors of each chunk are counted; texts around those that occur twice
    or more meet by anchor in the suffix sort, or string by string where an anchor occurs over `frequent` times; the
    spans come back to their chunks. One very long text is held whole. The table goes when the result is written.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    narrow = own.select("doc", F.xxhash64("t").alias("version"), F.col("t").cast("binary").alias("text"))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], SPANS_DDL)
    chunks = max(1, -(-size // chunk_bytes))
    buckets = min(MAX_BUCKETS, max(1, -(-chunks // 2)))
    once = narrow.mapInArrow(_rows_once, "doc long, version long, text binary, copies long")
    dealt = once.withColumn("chunk", F.pmod(F.xxhash64("doc", "version"), F.lit(chunks))).repartition(buckets, "chunk")
    dealt = dealt.sortWithinPartitions("chunk", "doc", "version").mapInArrow(_documents_once, dealt.schema)
    name = f"repeats_{uuid4().hex}"
    dealt.write.bucketBy(buckets, "chunk").option("compression", "zstd").saveAsTable(name)
    try:
        table = spark.table(name)
        counted = table.select("chunk", "text").mapInArrow(_count_anchors(length, gram), "g long, chunk long, n long")
        total = F.sum("n").over(Window.partitionBy("g"))
        repeated = counted.withColumn("total", total).filter("total > 1").select("chunk", "g", (F.col("total") > frequent).alias("frequent"))
        around = table.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_surroundings(length, gram), AROUND_DDL)
        gone = around.repartition("key").sortWithinPartitions("key").mapInArrow(_resolve(length), "chunk long, doc long, version long, start long, end long")
        return durable(table.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(_without, SPANS_DDL))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, spans, kept) of each row, repeated rows included: its bytes without the spans of repeated_spans().

    A cut may fall inside a character, so kept is binary. Null texts give no bytes; no rows give no rows.
    """
    found = repeated_spans(docs, doc_id, text, **options).filter(F.size("spans") > 0)
    found = found.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc"), "version", "spans")
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST)).alias("doc"), F.xxhash64(t).alias("version"), t.cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            doc, spans, texts = (batch.column(c).to_pylist() for c in ("doc", "spans", "text"))
            left = [cut(t, [(s["start"], s["end"]) for s in own or []]) for t, own in zip(texts, spans, strict=True)]
            ids = pa.array([None if d == _FIRST else d for d in doc], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([own or [] for own in spans], SPANS.field("spans").type), pa.array(left, pa.binary())], ["doc_id", "spans", "kept"])

    joined = join_spread(own, found, ["doc", "version"], "left").select("doc", "spans", "text")
    return joined.mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long>>, kept binary")


def digest(spans: DataFrame) -> DataFrame:
    """A row for each row of the documents: bytes, bytes and spans that go, and the hash of what is left."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return each_copy(spans).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
