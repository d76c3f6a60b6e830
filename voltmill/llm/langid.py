"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import fold_of, per_row

#: Length of profiles, and the distance of an n-gram that a profile lacks.
PROFILE = 400
#: Documents that teach one language at most; larger languages are sampled by a hash of doc_id.
MAX_DOCS_PER_LANG = 1000
UNKNOWN = "und"

SCORED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


#: Code points are the digits of an n-gram's code, with a blank as 0.
_BASE = 0x110001


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    return np.fromiter((k if chr(k).isalpha() else 0 for k in range(0x110000)), np.int64, 0x110000)


def counted(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and numbers of the distinct 1- to 3-grams of the words' letters in lower case, in order of code.

    A word's ends count as one blank each. Codes are in order of length, then of code points, and no two n-grams share
    one, whatever letters they are made of.
    """
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = s[:-1] * _BASE + s[1:]
    three = (two[:-1] * _BASE + s[2:])[s[1:-1] != 0]
    codes = np.concatenate((s[s != 0], two + _BASE, three + (_BASE + _BASE * _BASE)))
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


@dataclass
class Profiles:
    """Ranks of each language's most frequent n-grams, given as their codes from the most frequent on."""

    ranked: dict[str, list[int]]
    size: int = PROFILE
    langs: list[str] = field(init=False)

    def __post_init__(self):
        self.langs = sorted(self.ranked)
        self.codes = np.array(sorted({c for own in self.ranked.values() for c in own}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            own = np.array(self.ranked[lang], np.int64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def top(self, text: str, table: np.ndarray) -> np.ndarray:
        """Codes of the text's most frequent n-grams, by number, then code, as profiles are ranked."""
        found, n = counted(text, table)
        if len(found) > self.size:
            least = -np.partition(-n, self.size - 1)[self.size - 1]
            found, n = found[n >= least], n[n >= least]
        return found[np.argsort(-n, kind="stable")][: self.size]

    def nearest(self, top: np.ndarray) -> tuple[str, float]:
        """The language of least distance, the first in order on ties, and 1 less its share of the largest distance."""
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, top)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == top)
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        away = np.abs(ranks - np.arange(len(top))[:, None])
        far = np.where(ranks < 0, self.size, np.minimum(away, self.size)).sum(0)
        k = int(far.argmin())
        return self.langs[k], 1 - float(far[k]) / (self.size * len(top))


def learn_profiles(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, max_docs: int = MAX_DOCS_PER_LANG
) -> Profiles:
    """Profiles from rows with a text and a lang, at most about `max_docs` of each language, chosen by a hash of doc_id.

    Only the profiles reach the driver: `size` n-grams a language. Equal counts rank by code, as in texts. Repeated rows
    count each; null texts and langs teach nothing; without rows nothing is learned.
    """
    rows = docs.select(F.xxhash64(doc_id).alias("h"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in docs.select(F.col(lang).cast("string").alias("lang")).filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    large = {k: max_docs / n for k, n in counts.items() if n > max_docs}
    if large:
        rate = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("lang")], F.lit(1.0))
        rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30))

    def count(rows):
        table, by = letters(), {}
        for value, of in rows:
            n = by.setdefault(of, {})
            for code, k in zip(*(x.tolist() for x in counted(value.decode(), table)), strict=True):
                n[code] = n.get(code, 0) + k
        for of, n in by.items():
            for code, k in n.items():
                yield of.decode(), code, k

    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
    numbers = rows.select("text", "lang").mapInArrow(per_row(count, schema, 20_000), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = numbers.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= size)
    ranked: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, repeated rows included.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. Ties go to the first
    language in order. Whole texts count, of any length; other columns are ignored; no rows give no rows.
    """

    def score(rows):
        table = letters()
        for i, value in rows:
            yield i, *profiles.nearest(profiles.top(value.decode(), table) if value else ())

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(per_row(score, SCORED), "doc_id long, lang_pred string, score double")


def hold_out(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 4 is not 2 and score all."""
    profiles = learn_profiles(docs.filter(fold_of("doc_id", 4) != 2))
    return identify(docs, profiles).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
