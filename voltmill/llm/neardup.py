"""Near-duplicates by a MinHash LSH forest, with links confirmed on whole shingle sets."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import durable, in_batches, join_spread, measured, per_row, places, whole_rows

WORDS = 5
PERCENT = 80
#: Sorted orders of the signature, and the values that each takes.
TREES = 16
VALUES = 8
#: Neighbours in an order have a common prefix of so many values, or of more where many rows have that.
DEPTH = 4
#: Rows compared with each other at once.
REGION = 1024
#: Rows of all orders that one task puts in order, on average.
RANGE_ROWS = 1 << 17
#: Orders that each round adds; later rounds only look where components are still apart.
ROUNDS = (2, 4, 10)
#: Of 128 one-bit values, as many differ at most: for sets that are 0.8 alike, 13 with a deviation of 3.4.
BITS_APART = 30
#: Bytes of sets that meet at once; larger chunks and families are dealt to tiles of two such parts.
TILE_BYTES = 8 << 20
#: Bits of a tile's shingles that are held at once, and shingles that have one each at least.
BITS = 8 << 20
COLUMNS = 64
#: Rows of a block on one side at most, and how many are counted against all of them at once.
BLOCK_ROWS = 1 << 14
PROBES = 256
#: Counters of shingles, whose order by frequency the exact join follows; any order gives the same links.
COUNTERS = 1 << 18

_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_ODD = np.random.default_rng(11).integers(0, 1 << 63, (2, TREES * VALUES), np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


class Shingles:
    """Sorted 64-bit hashes of a text's distinct shingles of `words` words.

    A word's hash is that of its bytes as the digits of a number modulo 2^64: running sums give all words of a text at
    once. Powers of the base are kept up to the longest text so far.
    """

    def __init__(self, words: int):
        self.words = words
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 1 << 16)
            for name, base in (("power", _STEP), ("inverse", _inverse(_STEP))):
                full = np.full(n, base, np.uint64)
                full[0] = 1
                setattr(self, name, np.multiply.accumulate(full))

    def __call__(self, text: bytes | None) -> np.ndarray:
        raw = np.frombuffer(text or b"", np.uint8)
        inside = np.concatenate(([False], ~_BLANK[raw], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        self._grow(len(raw))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[raw] * self.power[: len(raw)], dtype=np.uint64)))
        word = _mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _MUL)
        k = min(self.words, len(word))
        found = word[: len(word) - k + 1].copy()
        for j in range(1, k):
            found = _mixed(found * _MUL + word[j : len(word) - k + 1 + j])
        return np.unique(_mixed(found + np.uint64(k)))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of 32 bits under TREES * VALUES hash functions."""
    least = np.full(TREES * VALUES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * _ODD[0] + _ODD[1]
        least = np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(0))
    return least


SIGNED = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("values", pa.binary()), ("b0", pa.int64()), ("b1", pa.int64())])


def _sign(docs: DataFrame, words: int) -> DataFrame:
    def run(rows):
        shingles = Shingles(words)
        for doc, text in rows:
            found = shingles(text)
            if not len(found):
                yield doc, 0, None, None, 0, 0
                continue
            least = signature(found)
            bits = np.packbits(_mixed(least.astype(np.uint64)).astype(np.uint8) & 1).view(np.int64)
            yield doc, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), least.astype(">u4").tobytes(), int(bits[0]), int(bits[1])

    return docs.mapInArrow(per_row(run, SIGNED), "doc long, n long, digest binary, values binary, b0 long, b1 long")


def _groups(batches, key: int):
    """Columns of the rows of each run of one key; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0].column(key)[0].as_py() != int(at[a]):
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> list:
    if len(held) == 1:
        return list(held[0].columns)
    return [c.combine_chunks() for c in pa.Table.from_batches(held).columns]


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of different bits."""
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16)


def _near(n: np.ndarray, b0: np.ndarray, b1: np.ndarray, rows: slice, percent: int) -> np.ndarray:
    """Which rows may be linked with each of `rows`, by set sizes and one-bit values."""
    apart = _apart(b0[rows, None], b0) + _apart(b1[rows, None], b1)
    sizes = 100 * np.minimum(n[rows, None], n) >= percent * np.maximum(n[rows, None], n)
    return (apart <= BITS_APART) & sizes


def _partnered(n: np.ndarray, b0: np.ndarray, b1: np.ndarray, percent: int) -> np.ndarray:
    """The rows that some other row may be linked with."""
    near = _near(n, b0, b1, slice(None), percent)
    np.fill_diagonal(near, False)
    return np.flatnonzero(near.any(1))


#: Kinds of rows that come out of an order: of a chunk, at an end of the task's range, and of a region that was split.
INNER, END, SPLIT = range(3)
SCANNED = ("kind", "chunk", "part", "tree", "doc", "n", "b0", "b1")
SCANNED_DDL = "kind int, chunk long, part int, tree int, doc long, n long, b0 long, b1 long"


def _regions_of(batches):
    """(first or last of the task, columns) of each region of two rows or more, and of the task's first and last one.

    The rows come in the order of (tree, key). Where the longest common prefix of two neighbours has fewer than DEPTH
    values a new region begins, so all rows of a region have a common prefix of DEPTH values.
    """
    held: list[list[np.ndarray]] = []
    n, first = 0, True

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)] if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, VALUES)
        cols = [_numbers(batch.column(0)), keys, *(_numbers(batch.column(k)) for k in range(2, 6))]
        prefix = np.cumprod(keys[1:] == keys[:-1], 1).sum(1)
        edges = [0, *(np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (prefix < DEPTH)) + 1).tolist(), batch.num_rows]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if 0 < k < len(edges) - 2 and b - a == 1:
                n = 0
                if held:
                    yield first, joined()
                    held, first = [], False
                continue
            piece = [c[a:b] for c in cols]
            if held and (held[-1][0][0] != piece[0][0] or (held[-1][1][0, :DEPTH] != piece[1][0, :DEPTH]).any()):
                if first or n > 1:
                    yield first, joined()
                held, first, n = [], False, 0
            held.append(piece)
            n += b - a
    if held:
        yield True, joined()


def _in_order(percent: int, region: int):
    """Candidates of the rows of a range, in their order.

    A region of up to `region` rows is a chunk: all of its rows are candidates of each other. A larger one is covered by
    windows of `region` rows, half a window apart, so that each row meets the half window before and after it: its
    neighbours of the longest common prefixes, as deep as the region is dense. Rows that have no possible partner leave.
    All rows of such regions are also noted as SPLIT. Regions at the ends of the range may go on in the next one: if
    they are no larger than a chunk their rows come out as they are, as END.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        out: list[list[np.ndarray]] = []
        rows, chunks = 0, 0

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], list(SCANNED))

        def put(kind: int, chunk: int, cols: list[np.ndarray], at) -> None:
            nonlocal rows
            tree, _, doc, n, b0, b1 = (c[at] for c in cols)
            m = len(doc)
            rows += m
            out.append([np.full(m, kind, np.int32), np.full(m, chunk, np.int64), np.full(m, part, np.int32), tree, doc, n, b0, b1])

        for at_end, cols in _regions_of(batches):
            size = len(cols[0])
            own = hashlib.blake2b(cols[0][:1].tobytes() + cols[1][0, :DEPTH].tobytes(), digest_size=8)
            name = int.from_bytes(own.digest(), "little", signed=True)
            if at_end and size <= region:
                put(END, name, cols, slice(None))
            else:
                if size > region:
                    put(SPLIT, name, cols, slice(None))
                for a in range(0, max(1, size - region // 2), max(1, region // 2)) if size > region else (0,):
                    window = [c[a : a + region] for c in cols]
                    stay = _partnered(*window[3:6], percent)
                    if len(stay):
                        chunks += 1
                        put(INNER, (part << 40) + chunks, window, stay)
            if rows >= 1 << 16:
                yield batch_of(out)
                out, rows = [], 0
        if out:
            yield batch_of(out)

    return run


def _with_partner(percent: int):
    """Of each chunk, the rows that some other row of it may be linked with."""

    def run(batches):
        held, rows = [], 0
        for cols in _groups(batches, 0):
            stay = _partnered(*(_numbers(c) for c in cols[3:6]), percent)
            if len(stay):
                held.append(pa.RecordBatch.from_arrays(cols, ["chunk", "tree", "doc", "n", "b0", "b1"]).take(pa.array(stay)))
                rows += len(stay)
            if rows >= 1 << 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def _candidates(first: DataFrame, percent: int, region: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, tree, doc, n, b0, b1) of candidates, and (chunk, doc) of the rows of regions that were split.

    Each of TREES orders sorts all documents by VALUES of their signature. All orders are one range sort: ranges are cut
    by (tree, key, doc), so a task gets its share of rows however many of them are alike. Regions that lie across ranges
    are put together from their ends.
    """
    tree = F.col("tree")
    orders = first.select("doc", "n", "b0", "b1", "values", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree", F.col("values").substr(tree * (4 * VALUES) + 1, F.lit(4 * VALUES)).alias("key"), "doc", "n", "b0", "b1"
    )
    ranges = max(int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-first.count() * TREES // RANGE_ROWS))
    ordered = orders.repartitionByRange(ranges, "tree", "key", "doc").sortWithinPartitions("tree", "key", "doc")
    scanned = durable(ordered.mapInArrow(_in_order(percent, region), SCANNED_DDL))
    own = ["chunk", "tree", "doc", "n", "b0", "b1"]
    sizes = scanned.filter(F.col("kind") != INNER).groupBy("chunk").agg(F.count("*").alias("size"), F.max("kind").alias("most"))
    ends = join_spread(scanned.filter(F.col("kind") == END), durable(sizes.filter("size > 1")), ["chunk"])
    small = (F.col("size") <= region) & (F.col("most") == END)
    chunk = F.when(small, F.col("chunk")).otherwise(F.xxhash64("chunk", "part"))
    split = scanned.filter(F.col("kind") == SPLIT).select("chunk", "doc").unionByName(ends.filter(~small).select("chunk", "doc"))
    ends = ends.withColumn("chunk", chunk).select(*own)
    met = ends.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_with_partner(percent), "chunk long, tree int, doc long, n long, b0 long, b1 long")
    return durable(scanned.filter(F.col("kind") == INNER).select(*own).unionByName(met)), split


def _alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, able: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of `able`, rows of `left` by rows of `right`, whose whole sets share `percent` of their union.

    Shingles that two sets or more hold become columns of bits; the common ones of a pair are the bits of both. Each pair
    is counted once, whole words of bits at a time.
    """
    n = np.array([len(x) for x in sets])
    met = np.flatnonzero(able.any(1))
    common = np.zeros(able.shape, np.int32)
    found = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(found, kind="stable")
    found, owner = found[order], owner[order]
    begins = np.concatenate(([True], found[1:] != found[:-1]))[: len(found)]
    column = np.cumsum(begins) - 1
    many = np.bincount(column)[column] > 1 if len(column) else begins
    owner, begins = owner[many], begins[many]
    column = np.cumsum(begins) - 1
    width = max(COLUMNS, BITS // max(1, len(sets)) // 64 * 64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        bits = np.zeros((len(sets), width), bool)
        bits[owner[a:b], column[a:b] - at] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        other = bits[right]
        for k in met.tolist():
            own = bits[left[k]]
            full = np.flatnonzero(own)
            j = np.flatnonzero(able[k])
            common[k, j] += np.bitwise_count(other[j[:, None], full] & own[full]).sum(1, dtype=np.int32)
    whole = n[left][:, None] + n[right] - common
    return np.nonzero(able & (100 * common.astype(np.int64) >= percent * whole))


def _joins(x: np.ndarray, y: np.ndarray):
    """Links (larger, smaller) that make one component of all that the pairs of components x, y connect."""
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for p, q in np.unique(np.stack((x, y), 1), axis=0).tolist() if len(x) else ():
        a, b = top(p), top(q)
        if a != b:
            root[max(a, b)] = min(a, b)
            yield max(a, b), min(a, b)


def _links(percent: int):
    """Links (a, b) between components, confirmed by whole sets; of a chunk's tile of two parts, only those across."""

    def run(batches):
        def found():
            for cols in _groups(batches, 0):
                part, comp, n, b0, b1 = (_numbers(c) for c in cols[1:6])
                able = _near(n, b0, b1, slice(None), percent) & (comp[:, None] < comp)
                if part.min() != part.max():
                    able &= part[:, None] != part
                if able.any():
                    sets = [np.frombuffer(s, np.uint64) for s in cols[6].to_pylist()]
                    every = np.arange(len(sets))
                    left, right = _alike(sets, every, every, able, percent)
                    yield from _joins(comp[left], comp[right])

        return in_batches(found(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _tiles(full: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows of groups with `tile` and `part`: a group of more than TILE_BYTES of sets of `n` shingles is dealt to parts, and each two parts meet in a tile."""
    sizes = full.groupBy(group).agg(F.ceil(F.sum("n") * 8 / TILE_BYTES).alias("parts"))
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = full.join(sizes, group).select(group, part, other, *columns)
    return dealt.select(F.xxhash64(group, F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "part", *columns)


def _whole(words: int):
    """(doc, whole): the set of each text."""

    def run(rows):
        shingles = Shingles(words)
        for doc, value in rows:
            yield doc, shingles(value).tobytes()

    return per_row(run, pa.schema([("doc", pa.int64()), ("whole", pa.binary())]), 256)


def _tally(rows):
    n = np.zeros(COUNTERS, np.int64)
    for _, whole in rows:
        n += np.bincount((np.frombuffer(whole, np.uint64) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    for k in np.flatnonzero(n).tolist():
        yield k, int(n[k])


def _rarest(found: np.ndarray, tally: np.ndarray, percent: int) -> np.ndarray:
    """So many of a set's rarest shingles that two sets which are `percent` alike have one of these in common."""
    order = np.lexsort((found, tally[(found % np.uint64(COUNTERS)).astype(np.int64)]))
    return found[order[: len(found) + percent * len(found) // -100 + 1]]


def _prefixes(tally: np.ndarray, percent: int):
    """(token, doc) of the rarest shingles of each set."""

    def run(rows):
        for doc, whole in rows:
            for token in _rarest(np.frombuffer(whole, np.uint64), tally, percent).view(np.int64).tolist():
                yield token, doc

    return per_row(run, pa.schema([("token", pa.int64()), ("doc", pa.int64())]))


def _across(tally: np.ndarray, percent: int):
    """Links (a, b) between components: of each block, rows of side 1 against the rows of side 0 that share one of their rarest shingles."""

    def run(batches):
        def found():
            for cols in _groups(batches, 0):
                side, comp = _numbers(cols[1]), _numbers(cols[2])
                sets = [np.frombuffer(s, np.uint64) for s in cols[3].to_pylist()]
                n = np.array([len(s) for s in sets])
                rest, probes = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                rare = [_rarest(sets[k], tally, percent) for k in rest]
                token = np.concatenate(rare) if rare else np.empty(0, np.uint64)
                order = np.argsort(token, kind="stable")
                token, holder = token[order], np.repeat(np.arange(len(rest)), [len(r) for r in rare])[order]
                for at in range(0, len(probes), PROBES):
                    own = probes[at : at + PROBES]
                    able = np.zeros((len(own), len(rest)), bool)
                    for k, p in enumerate(own.tolist()):
                        wanted = _rarest(sets[p], tally, percent)
                        for a, b in zip(np.searchsorted(token, wanted, "left").tolist(), np.searchsorted(token, wanted, "right").tolist(), strict=True):
                            able[k, holder[a:b]] = True
                    able &= (comp[own, None] != comp[rest]) & (100 * np.minimum(n[own, None], n[rest]) >= percent * np.maximum(n[own, None], n[rest]))
                    left, right = _alike(sets, own, rest, able, percent)
                    yield from _joins(comp[own[left]], comp[rest[right]])

        return in_batches(found(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _exact_links(narrow: DataFrame, split: DataFrame, labels: DataFrame, words: int, percent: int, region: int) -> DataFrame | None:
    """All links (a, b) that are left between components of documents of split regions; None if none can be left.

    A set-similarity join with a prefix filter, shingles in order of frequency. Regions and prefix shingles within one
    component leave. Documents that share any of the others, directly or by way of further ones, are a family; those
    outside of its largest component meet the whole family, in blocks of a sixteenth of it or of TILE_BYTES of sets if
    that is less, and of half of `region` rows at least: no task grows with a family, and a set is sent to as many
    blocks as the family has on the other side, 16 or one for each TILE_BYTES of the family.
    """
    known = labels.withColumnRenamed("node", "l")
    own = durable(split.join(known, F.col("doc") == F.col("l"), "left").select("chunk", "doc", F.coalesce("component", "doc").alias("comp")))
    mixed = own.groupBy("chunk").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("chunk")
    docs = durable(join_spread(own, durable(mixed), ["chunk"], "left_semi").select("doc", "comp").distinct())
    if docs.isEmpty():
        return None
    sets = durable(narrow.join(measured(docs.select("doc")), "doc").mapInArrow(_whole(words), "doc long, whole binary").filter("length(whole) > 0").distinct())
    counted = sets.mapInArrow(per_row(_tally, pa.schema([("k", pa.int64()), ("n", pa.int64())])), "k long, n long")
    counted = counted.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    tally = np.zeros(COUNTERS, np.int64)
    tally[counted.column("k").to_numpy()] = counted.column("n").to_numpy()
    tokens = durable(sets.mapInArrow(_prefixes(tally, percent), "token long, doc long").join(docs, "doc").select("token", "doc", "comp").distinct())
    shared = tokens.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("doc").alias("first")).filter("x < y").select("token", "first")
    stars = join_spread(tokens, durable(shared), ["token"]).select(F.col("doc").alias("a"), F.col("first").alias("b"))
    family = components(stars).withColumnsRenamed({"node": "doc", "component": "family"})
    length = sets.select("doc", (F.length("whole") / 8).cast("long").alias("n"))
    members = durable(family.join(docs, "doc").join(length.groupBy("doc").agg(F.max("n").alias("n")), "doc"))
    if members.isEmpty():
        return None
    parts = members.groupBy("family", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    by = parts.groupBy("family").agg(F.sum("c").alias("size"), F.sum("n").alias("n"), F.max(F.struct("c", "comp")).alias("most"))
    bound = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.col("size") * TILE_BYTES / (8 * F.col("n")))))
    width = F.least(F.greatest(F.ceil(F.col("size") / 16), F.lit(max(1, region // 2))), bound)
    by = by.select("family", F.col("most.comp").alias("most"), F.ceil(F.col("size") / width).alias("wide"), F.ceil((F.col("size") - F.col("most.c")) / width).alias("high"))
    met = join_spread(members, durable(by), ["family"]).filter("high > 0")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = met.select("family", "doc", "comp", F.lit(0).alias("side"), F.pmod(F.xxhash64("doc"), "wide").alias("i"), every("high").alias("j"))
    probes = met.filter("comp <> most").select("family", "doc", "comp", F.lit(1).alias("side"), every("wide").alias("i"), F.pmod(F.xxhash64("doc", "family"), "high").alias("j"))
    blocks = rest.unionByName(probes).select(F.xxhash64("family", "i", "j").alias("block"), "side", "comp", "doc")
    full = blocks.join(sets, "doc").select("block", "side", "comp", "whole")
    return full.repartition("block").sortWithinPartitions("block").mapInArrow(_across(tally, percent), "a long, b long")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after links between components."""
    merged = durable(components(links))
    if labels is None:
        return merged
    m = merged.select(F.col("node").alias("m"), F.col("component").alias("into"))
    moved = labels.join(m, F.col("component") == F.col("m"), "left").select("node", F.coalesce("into", "component").alias("component"))
    return durable(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti")))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, region: int = REGION
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row, repeated rows included.

    Words are parted by ASCII blanks, A-Z in lower case. A document's set are its distinct shingles of `words` words, or
    its whole sequence if it has fewer. Documents are linked if their sets share `percent` of their union, and
    component_id is the smallest doc_id that links reach. Null and empty texts have empty sets and are linked with
    nothing; a null doc_id is linked with nothing either, its component is null and it is kept. Rows with one doc_id are
    one document. Other columns are ignored; no rows give no rows.

    Equal sets are one class and only its smallest document goes on. TREES orders sort the documents by their
    signatures; neighbours with a common prefix of DEPTH values or, in dense regions, more are candidates if their
    one-bit values and sizes admit a link, and the whole sets decide. Rounds take up more orders, and leave out what has
    become one component. Documents of regions of over `region` rows go through an exact join of what is left at the end.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = durable(_sign(narrow, words))
    known = signed.filter("doc is not null and n > 0")
    classes = durable(known.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("digest", "first"))
    first = join_spread(known, classes, ["digest"], "left").filter("first is null or first = doc")
    rows, split = _candidates(first.select("doc", "n", "b0", "b1", "values"), percent, region)
    active = measured(rows.select("doc").distinct())

    sets = durable(narrow.join(active, "doc").mapInArrow(_whole(words), "doc long, whole binary")).withColumnRenamed("doc", "d")
    labels = None
    for lo, hi in zip(np.cumsum([0, *ROUNDS]).tolist(), np.cumsum(ROUNDS).tolist(), strict=False):
        own = rows.filter((F.col("tree") >= lo) & (F.col("tree") < hi))
        if labels is not None:
            own = own.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
        comp = F.col("doc") if labels is None else F.coalesce("component", "doc")
        own = durable(own.select("chunk", comp.alias("comp"), "n", "b0", "b1", "doc"))
        apart = own.groupBy("chunk").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("chunk")
        tiles = _tiles(own.join(apart, "chunk", "left_semi"), "chunk", ["comp", "n", "b0", "b1", "doc"])
        full = tiles.join(sets, F.col("doc") == F.col("d")).select("tile", "part", "comp", "n", "b0", "b1", "whole")
        links = full.repartition("tile").sortWithinPartitions("tile").mapInArrow(_links(percent), "a long, b long")
        labels = _merged(labels, links)
    if not split.isEmpty():
        links = _exact_links(narrow, split, labels, words, percent, region)
        labels = labels if links is None else _merged(labels, links)
    of_class = durable(join_spread(known.select("doc", "digest"), classes, ["digest"]).groupBy("doc").agg(F.min("first").alias("first")))
    joined = join_spread(places(signed.select("doc", "n")), of_class, ["doc"], "left", ["doc", "_part"]).withColumn("rep", F.coalesce("first", "doc"))
    joined = join_spread(joined, labels.withColumnRenamed("node", "rep"), ["rep"], "left", ["doc", "_part"])
    component = F.coalesce("component", "rep")
    return joined.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of `docs`, all columns kept, without documents that a smaller doc_id of their component stands for.

    Rows of one doc_id stay or go together; null ids and texts without words stay; no rows give no rows.
    """
    gone = durable(near_duplicates(docs, doc_id, text, **options).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    rows = whole_rows(docs).withColumn("_gone", F.col("_row")[doc_id].cast("long"))
    return join_spread(rows, gone, ["_gone"], "left_anti").select("_row.*")
