"""Phrase collocations: word sequences counted by generalised suffix automata, one for each shard and language."""

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import placed
from .text import durable, measured, rows

LONGEST = 3
LEAST = 10
#: A phrase goes if a longer one has this share, in percent, of its occurrences.
SUBSUMED = 50
TOP = 2000
UNKNOWN = "und"
#: Words of one automaton, and of one piece of text in it; a longer piece is cut with an overlap that is counted once.
SHARD_WORDS = 100_000
PIECE_WORDS = 1 << 16
#: Bytes of text whose phrases are counted together, on average, and rows added up at once there.
BUCKET_BYTES = 4 << 20
MERGED_ROWS = 1 << 18
MAX_TASKS = 20_000

#: A-Z to a-z, marks and line ends to line feeds, tabs to blanks; all else stays.
_MARKS = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))


def pieces(text: bytes | None) -> list[bytes]:
    """The pieces between [.,;:!?\\x0A-\\x0D], A-Z in lower case, their words [^\\x20\\x09]+ parted by blanks."""
    return (text or b"").translate(_MARKS).split(b"\n")


class Numbers(dict):
    """Numbers of words, given as they come."""

    def __missing__(self, word: bytes) -> int:
        own = self[word] = len(self)
        return own


class SuffixAutomaton:
    """The smallest automaton of all substrings of some sequences; a state is a set of substrings that end at the same places.

    A state's substrings are suffixes of its longest one, down to one word more than its suffix link's longest. `end` is
    a place in the joined sequences where they end.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        #: States that began as copies, in which no sequence ended when they were made, and those in which one ended again.
        self.copies, self.again = [0], []
        #: Runs of states that began with a sequence that occurs more than once, and how often more.
        self.often: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, sequence: list[int], times: int = 1) -> None:
        """A sequence that occurs so many times."""
        first, before = len(self.next), len(self.again)
        self._follow(sequence)
        if times > 1:
            self.often.append((first, len(self.next), times - 1))
            self.again += self.again[before:] * (times - 1)

    def _follow(self, sequence: list[int]) -> None:
        following, link, length, end, copies, again = self.next, self.link, self.length, self.end, self.copies, self.again
        last, at, states = 0, self.size, len(following)
        for c in sequence:
            at += 1
            p, known = last, following[last].get(c)
            if known is None:
                state, reach = states, {}
                following.append(reach)
                length.append(length[last] + 1)
                end.append(at)
                states += 1
                while p >= 0:
                    reach = following[p]
                    if c in reach:
                        known = reach[c]
                        break
                    reach[c] = state
                    p = link[p]
                last = state
                if known is None:
                    link.append(0)
                    continue
                if length[known] == length[p] + 1:
                    link.append(known)
                    continue
                link.append(states)
            elif length[known] == length[last] + 1:
                again.append(known)
                last = known
                continue
            else:  # the sequence so far is within a state of longer ones
                again.append(states)
                last = states
            copies.append(states)
            following.append(following[known].copy())
            length.append(length[p] + 1)
            end.append(end[known])
            link.append(link[known])
            link[known] = states
            while p >= 0 and following[p].get(c) == known:
                following[p][c] = states
                p = link[p]
            states += 1
        self.size = at

    def substrings(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, ends, counts) of all distinct substrings of k words, k from 1 to `longest`.

        A state has as many occurrences as sequences end in it or in states that its suffix link is reached from. What
        ends in deep states is passed along the links at once to the first state with a substring of at most `longest`.
        """
        link, length, end = np.array(self.link), np.array(self.length), np.array(self.end)
        link[0] = 0
        shortest = length[link] + 1
        shortest[0] = 1 << 30
        up = np.where(shortest > longest, link, np.arange(len(link)))
        while (up != (further := up[up])).any():
            up = further
        own = np.ones(len(link))
        for first, last, more in self.often:
            own[first:last] += more
        own[self.copies] = 0
        own += np.bincount(np.array(self.again, np.int64), minlength=len(link))
        count = np.bincount(up, weights=own, minlength=len(link)).astype(np.int64)
        shallow = shortest <= longest
        for k in range(longest, 0, -1):
            states = np.flatnonzero(shallow & ((length == k) if k < longest else (length >= k)))
            np.add.at(count, link[states], count[states])
        for k in range(1, longest + 1):
            states = np.flatnonzero((shortest <= k) & (length >= k))
            yield k, end[states], count[states]


class Shard:
    """Pieces of one language and their automaton; a piece that comes again is followed once, words are numbered as they come."""

    def __init__(self, longest: int):
        self.longest = longest
        self.pieces: dict[bytes, int] = {}
        self.size = 0
        self.numbers = Numbers()
        self.words: list[int] = []
        self.automaton = SuffixAutomaton()
        self.twice: list[list[int]] = []

    def add(self, piece: bytes) -> int:
        """Takes a piece and returns about how many words are new to the shard."""
        times = self.pieces.get(piece, 0)
        self.pieces[piece] = times + 1
        more = 0 if times else piece.count(b" ") + 1
        self.size += more
        return more

    def follow(self) -> None:
        overlap = self.longest - 1
        for piece, times in self.pieces.items():
            words = piece.split(b" ")
            ids = list(map(self.numbers.__getitem__, [w for w in words if w] if b"" in words else words))
            for at in range(0, max(1, len(ids) - overlap), PIECE_WORDS) if ids else ():
                part = ids[at : at + PIECE_WORDS + overlap]
                if at:
                    self.twice += [part[:overlap]] * times
                self.words += part
                self.automaton.add(part, times)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases as rows of word numbers, -1 beyond their end, and how often each occurs; the counts of equal rows add up."""
        self.follow()
        words, found, counts = np.array(self.words, np.int64), [], []
        for k, ends, n in self.automaton.substrings(self.longest):
            ids = np.full((len(ends), self.longest), -1)
            ids[:, :k] = words[ends[:, None] - k + np.arange(k)]
            found.append(ids)
            counts.append(n)
        less = [p[i : i + k] for p in self.twice for k in range(1, len(p) + 1) for i in range(len(p) - k + 1)]
        found.append(np.array([p + [-1] * (self.longest - len(p)) for p in less], np.int64).reshape(-1, self.longest))
        counts.append(np.full(len(less), -1))
        return np.concatenate(found), np.concatenate(counts)

    def blocks(self, lang: str, buckets: int) -> Iterator[tuple]:
        """(bucket, lang, n, phrases, counts): phrases in order, joined by line feeds, with their counts, both packed."""
        ids, counts = self.counted()
        if not len(ids):
            return
        words = sorted(self.numbers)
        rank = np.empty(len(words) + 1, np.int64)
        rank[[self.numbers[w] for w in words]] = np.arange(len(words))
        rank[-1] = -1
        ids = rank[ids]
        code = np.zeros(len(ids), np.int64)
        spread = np.full(len(ids), zlib.crc32(lang.encode()), np.uint64)
        hashes = np.array([zlib.crc32(w) | zlib.adler32(w) << 32 for w in words] + [0], np.uint64)
        for k in range(self.longest):
            code = code * (len(words) + 1) + ids[:, k] + 1
            spread = np.where(ids[:, k] >= 0, (spread ^ (spread >> np.uint64(29)) ^ hashes[ids[:, k]]) * np.uint64(0x9E3779B97F4A7C15), spread)
        bucket = ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(code)
        order = order[np.argsort(bucket[order].astype(np.int16 if buckets < 1 << 15 else np.int64), kind="stable")]
        ids, counts, bucket = ids[order], counts[order].astype(np.int32), bucket[order]
        names = pa.array(words, pa.large_binary())
        phrase = names.take(pa.array(ids[:, 0]))
        for k in range(1, self.longest):
            more = names.take(pa.array(ids[:, k], mask=ids[:, k] < 0))
            phrase = pc.coalesce(pc.binary_join_element_wise(phrase, more, pa.scalar(b" ", pa.large_binary())), phrase)
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), phrase), pa.scalar(b"\n", pa.large_binary()))
        for a, b, text in zip(cuts, cuts[1:], joined, strict=False):
            yield int(bucket[a]), lang, b - a, _packed(text.as_buffer()), _packed(pa.py_buffer(counts[a:b].tobytes()))


def _packed(raw: pa.Buffer) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


BLOCKS = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])
BLOCKS_DDL = "bucket int, lang string, n int, phrases binary, counts binary"


def _by_shard(longest: int, buckets: int, shard_words: int):
    def run(batches):
        open_: dict[str, Shard] = {}
        held = 0

        def out(lang: str) -> pa.RecordBatch:
            found = list(zip(*open_.pop(lang).blocks(lang, buckets), strict=True)) or [[]] * len(BLOCKS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, BLOCKS, strict=True)], schema=BLOCKS)

        gc.disable()  # automata hold no cycles, and looking for some in them takes a third of the time
        try:
            for lang, text in rows(batches):
                name = UNKNOWN if lang is None else lang.decode()
                for piece in pieces(text):
                    if not piece:
                        continue
                    shard = open_.get(name) or open_.setdefault(name, Shard(longest))
                    held += shard.add(piece)
                    if held >= shard_words:  # the largest shard goes, so that rare languages go on in theirs
                        most = max(open_, key=lambda k: open_[k].size)
                        held -= open_[most].size
                        yield out(most)
            for lang in list(open_):
                yield out(lang)
        finally:
            gc.enable()

    return run


COUNTED = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
COUNTED_DDL = "lang string, words int, phrase string, f long"


def _added_up(least: int):
    """Phrases of each bucket and language with `least` occurrences or more, and in a row of no words the number of words."""

    def run(batches):
        held: list[pa.Table] = []
        now, n = None, 0

        def merged() -> pa.Table:
            table = pa.concat_tables(held).group_by("phrase", use_threads=False).aggregate([("f", "sum")])  # of binary, as large ones are far slower
            return table.rename_columns(["f", "phrase"] if table.column_names[0] == "f_sum" else ["phrase", "f"]).select(["phrase", "f"])

        def out() -> pa.RecordBatch:
            table = merged()
            gaps = pc.count_substring(table.column("phrase"), b" ")
            total = pc.sum(pc.filter(table.column("f"), pc.equal(gaps, 0))).as_py() or 0
            keep = pc.greater_equal(table.column("f"), least)
            phrase = pc.filter(table.column("phrase"), keep).to_pylist()
            words = [k + 1 for k in pc.filter(gaps, keep).to_pylist()]
            f = pc.filter(table.column("f"), keep).to_pylist()
            lang = [now[1].decode()] * (len(f) + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip((lang, [0, *words], ["", *(p.decode() for p in phrase)], [total, *f]), COUNTED, strict=True)], schema=COUNTED)

        for bucket, lang, many, phrases, counts in rows(batches):
            if now not in (None, (bucket, lang)):
                yield out()
                held, n = [], 0
            now = bucket, lang
            held.append(pa.table({"phrase": pa.array(_unpacked(phrases).split(b"\n"), pa.binary()), "f": pa.array(np.frombuffer(_unpacked(counts), np.int32).astype(np.int64))}))
            n += many
            if n >= MERGED_ROWS:
                held = [merged()]
                n = 0
        if held:
            yield out()

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, words, phrase, f): phrases of 1 to `longest` words that occur `least` times or more, and, with no words, how many words there are.

    Each task builds automata of about `shard_words` words of its documents, so memory does not grow with a task, and
    sends what they count in packed blocks to buckets by a hash of the phrase: a phrase that a third of all places hold
    is one row a shard. Rows of no words come once for each bucket.
    """
    narrow = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    blocks = narrow.mapInArrow(_by_shard(longest, buckets, shard_words), BLOCKS_DDL)
    return blocks.repartitionById(min(buckets, MAX_TASKS), F.col("bucket") % MAX_TASKS).sortWithinPartitions("bucket", "lang").mapInArrow(_added_up(least), COUNTED_DDL)


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language, the best first.

    A candidate has 2 to `longest` words and occurs a >= `least` times. Cut after its first words, these occur l times
    and the rest r times; its score is the floor of 10^6 a^2 / (l r) at the cut where that is least, the first such one.
    Candidates go if a longer one that holds them has `subsumed` % of their occurrences; as a phrase occurs at least as
    often as any that holds it, it is enough to look at those of one word more, from which the suffix link leads to the
    last words and the parent to the first ones. Ties go by a, then by the phrase's bytes.

    Null texts and pieces without words give nothing; null languages count as `und`, and an empty one is one of its own;
    repeated rows count each; other columns are ignored; no rows give no rows. Sums are decimals of 38 digits.
    """
    counts = durable(phrase_counts(docs, text, lang, longest, least, shard_words))
    n = counts.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    words = F.split("phrase", " ")
    found = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    parts = counts.filter((F.col("words") > 0) & (F.col("words") < longest)).select("lang", "phrase", "f")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(words, 1, F.col("k")).alias("first"), _part(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(1000000BD * cast(a AS decimal(15, 0)) * cast(a AS decimal(15, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    shorter = F.array(_part(words, 2, F.col("words") - 1), _part(words, 1, F.col("words") - 1))  # suffix link, parent
    within = found.filter("words > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a")))
    kept = durable(kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score"))
    ordered = durable(placed(kept, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], kept.count()))
    starts = ordered.groupBy("lang").agg(F.min("place").alias("start")).join(n, "lang")
    ranked = ordered.join(measured(durable(starts)), "lang").withColumn("rank", F.col("place") - F.col("start") + 1)
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
