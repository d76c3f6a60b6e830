"""Line dedup: lines that spread over many sites, counted by HyperLogLog sketches; built-in functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import durable, join_spread

#: A line on this many sites is boilerplate.
MIN_SITES = 5
#: log2 of a sketch's registers; its relative error is about 1.04 / sqrt(registers).
LG_K = 10
#: Estimates as many standard errors from the threshold, and at least one site, are counted exactly.
MARGIN = 4

def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(doc_id: str) -> Column:
    """The id as text that is not null."""
    return F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))


def _hashed(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """A row for each line that is not blank: its document and place, and two hashes of 64 bits of its trimmed text."""
    rows = docs.select(
        _key(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_version"), F.col(site).cast("string").alias("_site"), F.posexplode(_lines(F.col(text))).alias("_at", "_line")
    )
    line = F.trim("_line")
    return rows.filter(line != "").select("_id", "_version", "_site", "_at", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def _held(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the lines whose hashes are among the keys; a line that many documents hold is no larger a task."""
    return join_spread(lines, keys, ["h1", "h2"], "left_semi")


def widespread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2) of lines on at least `min_sites` distinct sites; null is no site.

    Each task sketches the sites of its own lines before any row moves, so a line that a third of all rows hold costs
    one sketch a task. Estimates clearly above or below the threshold decide; lines near it are counted exactly.
    """
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("sites"))
    margin = max(1.0, MARGIN * 1.04 / 2 ** (lg_k / 2) * min_sites)
    likely = durable(sketched.filter(F.col("sites") >= min_sites - margin))
    near = likely.filter(F.col("sites") <= min_sites + margin).select("h1", "h2")
    exact = (
        _held(lines.filter("_site is not null"), near).groupBy("h1", "h2", "_site").count()
        .groupBy("h1", "h2").count().filter(F.col("count") >= min_sites).select("h1", "h2")
    )
    return likely.filter(F.col("sites") > min_sites + margin).select("h1", "h2").unionByName(exact)


def drop_widespread_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K
) -> DataFrame:
    """(doc_id, n_lines, removed, text) of each row, repeated rows included: its text without boilerplate lines.

    Lines are trimmed of blanks to be compared; blank lines are never boilerplate and stay. removed lists the places of
    the lines taken out, from 0, in order; the others stay as they are, joined by line feeds. A null text has one blank
    line and stays null; ids may be null or repeat, as rows are told apart by id and text. No rows give no rows.
    """
    lines = _hashed(docs, doc_id, text, site)
    wide = durable(widespread_lines(lines, min_sites, lg_k))
    hits = _held(lines, wide).groupBy("_id", "_version").agg(F.array_sort(F.collect_set("_at")).alias("_removed"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), _key(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_version"))
    joined = join_spread(own, durable(hits), ["_id", "_version"], "left", small=False)
    every = lambda lines: F.sequence(F.lit(0), F.size(lines) - 1)
    stay = lambda lines: F.transform(F.array_except(every(lines), "_removed"), lambda k: F.get(lines, k))
    left = F.element_at(F.transform(F.array(_lines(F.col("_text"))), lambda lines: F.array_join(stay(lines), "\n")), 1)
    return joined.select(
        "doc_id",
        F.size(_lines(F.col("_text"))).cast("long").alias("n_lines"),
        F.coalesce("_removed", F.array().cast("array<int>")).alias("removed"),
        F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(left).alias("text"),
    )


def digest(cleaned: DataFrame) -> DataFrame:
    kept = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.length(kept).cast("long").alias("n_chars"), F.sha2(kept.cast("binary"), 256).alias("text_sha256")
    )
