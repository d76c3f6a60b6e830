"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings; built-in functions only."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, with the least length of a match (of the value, for assignments), in order of kind.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]"
HEX = r"[0-9a-f]"
KINDS = ("assign", "access", "hex", "entropy")
LEAST = {"assign": 12, "access": 18, "hex": 16}

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Least bits a character in a window, by the class of the whole candidate; the first pattern that fits names it.
CLASSES = ((r"^[0-9]+$", 3.0), (r"^[0-9a-fA-F]+$", 2.9), (r"^[A-Za-z0-9]+$", 3.5), (r"^[A-Za-z0-9+/_=-]+$", 3.6))
# The allow-list. Groups repeat without giving back, so that a long candidate needs no stack.
RULER = r"^[+/_=-]++$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Words, with at most four digits after each, or such digits alone, joined by signs: identifiers, paths, dates.
JOINED = r"^[+/_=-]*+(?:(?:[A-Za-z]++[0-9]{0,4}+|[0-9]{1,4}+)(?:[+/_=-]++|$))++$"
#: A word of such a candidate by its case: abc, Abc or ABC.
CASED = r"[A-Z]?[a-z]+|[A-Z]+"
CONSONANTS = 6
VOWELS = (0.2, 0.65)
#: Sums of n log n as whole numbers, so that what comes in and goes out again leaves nothing behind.
SCALE = 1 << 40
#: Spans gathered before they are put away; appending to one long list would copy it for each.
RUN = 256

SPAN = "array<struct<kind:int,start:long,end:long>>"
_PLACED = "array<struct<start:long,end:long,own:string>>"


def _found(text: Column, pattern: str, keep) -> Column:
    """(start, end, own) of the leftmost non-overlapping matches that `keep` accepts; the text between gives the places.

    own is the pattern's group, or the whole match where it has none.
    """
    between, hit = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if "(" in pattern.replace("(?", "") else hit
    step = F.zip_with(F.slice(between, 1, F.size(hit)), F.arrays_zip(hit.alias("hit"), own.alias("own")), lambda b, h: F.struct(F.length(b).alias("gap"), F.length(h["hit"]).alias("n"), h["own"].alias("own")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_PLACED).alias("now"), F.array().cast(f"array<{_PLACED}>").alias("done"))

    def walk(acc: Column, s: Column) -> Column:
        end = acc["at"] + s["gap"] + s["n"]
        span = F.array(F.struct((acc["at"] + s["gap"]).alias("start"), end.alias("end"), s["own"].alias("own"))).cast(_PLACED)
        full = F.size(acc["now"]) >= RUN
        return F.struct(
            end.alias("at"),
            F.when(full, span).otherwise(F.concat(acc["now"], span)).alias("now"),
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
        )

    return F.filter(F.aggregate(step, start, walk, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"])), keep)


def _spans(text: Column, pattern: str, kind: int, least: int) -> Column:
    found = _found(text, pattern, lambda s: F.length(s["own"]) >= least)
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _allowed(value: Column) -> Column:
    """Whether the allow-list suppresses a candidate: rulers, UUIDs, and words joined by signs if they look like words.

    They do if they have three letters each on average by their case, no long run of consonants and a usual share of
    vowels; random letters have not, whatever signs they are joined by.
    """
    only = lambda p: F.length(F.regexp_replace(value, p, ""))
    letters, vowels = only("[^A-Za-z]"), only("[^AEIOUYaeiouy]")
    worded = (
        (letters >= 3 * F.regexp_count(value, F.lit(CASED)))
        & ~value.rlike(f"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{{{CONSONANTS}}}")
        & (vowels >= VOWELS[0] * letters) & (vowels <= VOWELS[1] * letters)
    )
    return value.rlike(RULER) | value.rlike(UUID) | (value.rlike(JOINED) & worded)


def _narrowed(s: Column) -> Column:
    """The span from the first to the last window of WINDOW characters whose entropy reaches the class's least, or null ends.

    The window moves by one character. The sum of n log n over its counts changes by the counts of the character that
    goes out and of the one that comes in, and nothing else; the entropy is log WINDOW - sum / WINDOW.
    """
    value = s["own"]
    n_log = [round(n * math.log2(n) * SCALE) if n else 0 for n in range(WINDOW + 1)]
    more = F.array(*[F.lit(b - a).cast("long") for a, b in zip(n_log, n_log[1:])])  # from n of a character to n + 1
    most = F.coalesce(*[F.when(value.rlike(p), F.lit(int((math.log2(WINDOW) - bits + 1e-9) * WINDOW * SCALE))) for p, bits in CLASSES])
    none = F.lit(None).cast("int")
    start = F.struct(
        F.lit("").alias("window"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("sum"), most.cast("long").alias("most"), none.alias("first"), none.alias("last")
    )
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))

    def move(acc: Column, c: Column) -> Column:
        window, full = acc["window"], acc["i"] >= WINDOW
        left = F.when(full, F.substring(window, 2, WINDOW)).otherwise(window)
        less = F.when(full, F.element_at(more, count(window, F.substring(window, 1, 1)))).otherwise(F.lit(0).cast("long"))
        return F.struct(
            F.concat(left, c).alias("window"), (acc["i"] + 1).alias("i"), (acc["sum"] - less + F.element_at(more, count(left, c) + 1)).alias("sum"),
            acc["most"].alias("most"), acc["first"].alias("first"), acc["last"].alias("last"),
        )

    def mark(acc: Column) -> Column:
        high = (acc["i"] >= WINDOW) & (acc["sum"] <= acc["most"])
        return F.struct(
            *[acc[f].alias(f) for f in ("window", "i", "sum", "most")],
            F.when(high & acc["first"].isNull(), acc["i"]).otherwise(acc["first"]).alias("first"), F.when(high, acc["i"]).otherwise(acc["last"]).alias("last"),
        )

    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    ends = F.aggregate(F.split(value, ""), start, lambda acc, c: let(move(acc, c), mark), lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
    return let(ends, lambda e: F.struct(F.lit(3).alias("kind"), (s["start"] + e["first"] - WINDOW).cast("long").alias("start"), (s["start"] + e["last"]).cast("long").alias("end")))


def _by_entropy(text: Column) -> Column:
    candidates = _found(text, CANDIDATE, lambda s: ~_allowed(s["own"]))
    return F.filter(F.transform(candidates, _narrowed), lambda s: s["start"].isNotNull())


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of each row, repeated rows included; a span is (kind, start, end), an index of KINDS and code points.

    Null text is empty and has no spans; so has an empty text. Whole texts count, of any length. Spans are in order of
    start, then kind, and may overlap across kinds; within a kind they are the leftmost that don't overlap. Other
    columns are ignored; no rows give no rows. Each pattern runs only where a plain test of the text admits a match.
    """
    t = F.coalesce(F.col("_text"), F.lit(""))
    none = F.array().cast(SPAN)
    spans = F.concat(
        F.when(t.rlike(r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]"), _spans(t, ASSIGN, 0, LEAST["assign"])).otherwise(none),
        F.when(F.contains(t, F.lit("AKIA")), _spans(t, f"{ACCESS}{{{LEAST['access'] - 4},}}", 1, LEAST["access"])).otherwise(none),
        F.when(t.rlike(f"{HEX}{{{LEAST['hex']},}}"), _spans(t, f"{HEX}{{{LEAST['hex']},}}", 2, LEAST["hex"])).otherwise(none),
        F.when(t.rlike(CANDIDATE), _by_entropy(t)).otherwise(none),
    )
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return narrow.select("doc_id", in_order.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
