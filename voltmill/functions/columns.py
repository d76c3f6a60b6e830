"""Expressions shared by operators and plans; all stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c: Column) -> Column:
    """Sum of doubles through decimals, so that the order of rows does not show."""
    return F.sum(c.cast("decimal(28,9)")).cast("double")


def rounded(c: Column, scale: int) -> Column:
    """Half away from zero, on decimals as numeric rounding does."""
    return F.round(c.cast("decimal(28,9)"), scale).cast("double")


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return part / F.when(whole != 0, whole)


def bucket(ts: Column, minutes: int = 30) -> Column:
    """Start of the bucket that holds the time; minutes divides an hour."""
    return F.date_trunc("hour", ts) + F.make_interval(mins=F.floor(F.minute(ts) / minutes).cast("int") * F.lit(minutes))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def parsed_time(text: Column) -> Column:
    """ISO time or null; text without a full date is no time, and one without a zone is in the session's."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ].*)?$"), F.trim(text).try_cast("timestamp"))


def parsed_number(text: Column) -> Column:
    """Double of a number's text, and of nan and inf, else null."""
    t = F.lower(F.trim(text))
    plain = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?$"
    return (
        F.when(t.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
        .when(t.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(t.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
        .when(t.rlike(plain), F.translate(t, "_", "").cast("double"))
    )


def spread(text: Column, n: int) -> Column:
    """A number from 0 to n - 1 that follows from the text alone; n is small beside 2^24."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long") % n


def content_hash(readings: Column, with_kwh: bool = True) -> Column:
    """Id of a page: the start of a digest over its sorted readings.

    Without kwh, a corrected page keeps its id and would be dropped as a repeat for a day.
    """
    fields = ("meter_id", "reading_time", "kwh") if with_kwh else ("meter_id", "reading_time")
    text = lambda r, f: F.coalesce(r[f].cast("string"), F.lit(""))
    keys = F.array_sort(F.transform(readings, lambda r: F.struct(*[text(r, f).alias(f) for f in fields])))
    line = F.array_join(F.transform(keys, lambda k: F.concat_ws(",", *[k[f] for f in fields])), "|")
    return F.concat(F.lit("bf_"), F.substring(F.sha2(line.cast("binary"), 256), 1, 16))


def band(value: Column, warn: float, high: float) -> Column:
    return F.when(value.isNull(), "none").when(value >= high, "high").when(value >= warn, "warn").otherwise("ok")
