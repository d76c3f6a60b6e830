"""Token-ID output: documents tokenised and packed into rows of one length by best-fit decreasing."""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import counted_once, in_batches, rows

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
#: Documents are dealt by a hash to shards of about this many bytes of text; each is packed on its own.
SHARD_BYTES = 8 << 20
#: A shard that has more tokens, which texts of few letters or many short texts make, is packed in blocks of about so many.
BLOCK_TOKENS = 1 << 22
#: Of a row that is repeated very often, so many copies go to one shard.
COPIES_AT_ONCE = 1024
MAX_TASKS = 20_000
_FIRST = -(1 << 63)

PACK = pa.schema(
    [("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
     ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))]
)
PACK_DDL = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


class Tokenizer:
    """Byte-pair encoding of text as ordinary text, with the first free id for the end of a document."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values(), default=-1) + 1
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def __call__(self, text: str) -> np.ndarray:
        return np.append(self.encoding.encode_to_numpy(text, disallowed_special=()), self.end).astype(self.kind)


class Capacities:
    """A segment tree over capacities 0..most that says which ones some bin has left."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) of the smallest capacity that is at least `least`."""
        count, node = self.count, least + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right sibling holds a bin
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of items, each of at most `length` in all; items go from the largest, on ties from the first."""
    left, bins = Capacities(length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = left.take(sizes[k])
        capacity, b = found or (length, len(bins))
        if found is None:
            bins.append([])
        bins[b].append(k)
        left.put(capacity - sizes[k], b)
    return bins


def pack_block(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> Iterator[tuple]:
    """Rows without their pack_id: n_tokens, ids, cu_seqlens, position_resets, doc_ids, doc_starts."""
    pieces = [(i, at, ids[at : at + length]) for i, ids in docs for at in range(0, len(ids), length)]
    for own in best_fit_decreasing([len(p[2]) for p in pieces], length):
        row = np.full(length, pad, docs[0][1].dtype)
        ends = np.cumsum([len(pieces[k][2]) for k in own]).tolist()
        row[: ends[-1]] = np.concatenate([pieces[k][2] for k in own])
        yield ends[-1], row.tobytes(), [0, *ends], [0, *ends[:-1]], [pieces[k][0] for k in own], [pieces[k][1] for k in own]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH,
    shard_bytes: int = SHARD_BYTES, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each packed row of `length` ids.

    ids: the row's token ids, little-endian, two bytes each (four if the vocabulary needs them), padded with the end
    id; n_tokens are no padding. cu_seqlens: where segments begin, and where the last ends. position_resets: where
    positions start again from 0. doc_ids, doc_starts: each segment's document, and the place of its first token in it.

    Every document ends with the end id; a null or empty text is that id alone, repeated rows each give their segments,
    a longer document than `length` is cut into segments that doc_starts put together again, and no token is lost. A
    null id stays null; other columns are ignored; no rows give no rows.

    A hash of id and text deals documents to shards, as many as the bytes of all texts ask for; a row that is repeated very
    often is counted and sent once for COPIES_AT_ONCE copies, to many shards. A shard is packed in order of id: the packs and their ids follow from the documents alone, however files and tasks are cut. One very long
    text is held whole.
    """
    ranks = read_ranks(tokenizer)  # the vocabulary file is read here and sent, about 1 MB

    def run(batches):
        encode = Tokenizer(ranks)

        def blocks():
            held, tokens, now = [], 0, None
            for shard, i, _, copies, value in rows(batches):
                ids = encode((value or b"").decode())
                for _ in range(copies):
                    if held and (shard != now or tokens >= block_tokens):
                        yield now, held
                        held, tokens = [], 0
                    now = shard
                    held.append((i, ids))
                    tokens += len(ids)
            if held:
                yield now, held

        def packed():
            now, n = None, 0
            for shard, block in blocks():
                n = n if shard == now else 0
                now = shard
                for row in pack_block(block, length, encode.end):
                    yield (shard << 32) + n, *row
                    n += 1

        return in_batches(packed(), PACK, 512)

    narrow = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST)).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = narrow.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    often = counted_once(narrow, ["id", "hash"])
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE))).alias("part")
    own = often.select("doc_id", "hash", "text", "copies", parts)
    copies = F.least(F.lit(COPIES_AT_ONCE).cast("long"), F.col("copies") - F.col("part") * COPIES_AT_ONCE).alias("copies")
    shard = F.pmod(F.xxhash64("doc_id", "text", F.when(F.col("part") > 0, F.col("part"))), F.lit(shards)).alias("shard")
    dealt = own.select(shard, "doc_id", "hash", copies, "text").repartitionById(min(shards, MAX_TASKS), (F.col("shard") % MAX_TASKS).cast("int"))
    return dealt.sortWithinPartitions("shard", "doc_id", "hash").mapInArrow(run, PACK_DDL)


def write_packs(docs: DataFrame, path: str, **options) -> None:
    """Packed rows of pack() as Parquet files, the id matrix as one binary column of equal lengths; no rows give an empty table."""
    pack(docs, **options).write.mode("overwrite").parquet(path)


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position of each token, from 0 in every segment."""
    return np.concatenate([np.arange(b - a, dtype=np.int32) for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False)])
