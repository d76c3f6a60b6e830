"""Mixing sources to target weights by entropy balancing."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import durable, each_copy, join_spread, places, whole_rows, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
#: Rates are rounded to this fraction, so that all later sums are exact and reruns agree.
UNIT = 1_000_000
MAX_STEPS = 60
TOLERANCE = 1e-7
#: Rates are rounded to this fraction in the sums of the dual, so that these don't depend on the order of rows either.
FINE = 1_000_000_000_000
#: Parts into which the cells of one source are dealt while the dual is solved.
SALTS = 16
#: Parts into which repeated rows are dealt that have to be numbered.
NUMBERED = 256


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, n, source_size, target) from rows of (source, size).

    Sources in order of their code points, null last, weigh `weights` over and over. Together they share the sum of all
    sizes by weight; no target exceeds `cap` times its source's size, and what is above is shared again by weight.
    """
    found = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = F.asc_nulls_last("source")
    parts = max(1, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A rank over ranges: the place within its range, and the sources of earlier ranges, one number a range.
    ranged = durable(
        found.repartitionByRange(parts, order)
        .sortWithinPartitions(order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    before, total = {}, 0
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        before[r["_range"]] = total
        total += r["count"]
    if not total:
        return ranged.select("source", "n", "source_size", F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_range")]
    place = ((F.col("_place") + offset) % len(weights)).cast("int") + 1
    ranked = ranged.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
    most = (F.col("source_size") * cap).cast("double")
    share, held, size = 0.0, -1, None
    while True:  # a source once held at its cap stays there, as the share only rises
        at_cap = most <= F.col("w") * share
        now, kept, free, whole = ranked.agg(
            F.count_if(at_cap), F.sum(F.when(at_cap, most).otherwise(0.0)), F.sum(F.when(~at_cap, F.col("w")).otherwise(0.0)), F.sum("source_size")
        ).first()
        if now == held or not free:
            break
        held, size = now, whole
        share = (size - kept) / free
    return ranked.select("source", "n", "source_size", F.least(most, F.col("w") * share).alias("target"))


def solve_rates(cells: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, mean, lam): the tilt of each source whose rates min(cap, exp(lam * size / mean)) bring its target.

    These rates are the nearest to 1, by relative entropy over documents, of all rates up to `cap` whose words meet the
    target; lam minimises the convex dual. Each step is one aggregation over all cells, one for each size of a source:
    tasks sum the slope and the curvature of every source's dual over the cells that they hold, a source's cells being
    dealt to SALTS parts, and each source moves by Newton, or halves its bracket where Newton would leave it. The state
    is a small table, written between steps. RuntimeError if a source has not met its target after MAX_STEPS.
    """
    top = F.lit(math.log(cap))
    lam, mean, target = F.col("lam"), F.col("mean"), F.col("target")
    full = target >= cap * F.col("source_size")
    keys = ["s", "target", "mean", "lam", "lo", "hi", "met"]
    state = durable(
        targets.filter("source_size > 0")
        .withColumn("mean", F.col("source_size") / F.col("n"))
        .select(
            F.col("source").alias("s"), "target", "mean", F.when(full, F.lit(1e9)).otherwise(F.log(target / F.col("source_size"))).alias("lam"),
            F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), full.alias("met"),
        )
    )
    dealt = durable(cells.withColumn("salt", F.pmod(F.xxhash64("size"), F.lit(SALTS)).cast("int")))
    for _ in range(MAX_STEPS):
        if state.filter("not met").isEmpty():
            return state.select(F.col("s").alias("source"), "mean", F.round("lam", 9).alias("lam"))
        wide = state.filter("not met").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        x = lam * F.col("size") / mean
        words = F.col("cell_n") * F.col("size")
        rate = F.round(F.exp(F.least(x, top)) * FINE).cast("decimal(20,0)")
        bend = F.when(x < top, words * F.col("size") / mean * F.exp(x)).otherwise(0.0)
        sums = (
            dealt.join(wide, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("part")))
            .groupBy(*keys)
            .agg((F.sum((words.cast("decimal(18,0)") * rate).cast("decimal(38,0)")).cast("double") / FINE).alias("got"), F.sum(bend.cast("decimal(38,6)")).cast("double").alias("bend"))
        )
        over, met = F.col("got") > target, F.abs(F.col("got") - target) <= TOLERANCE * target
        ends = sums.withColumns({"lo": F.when(over, F.col("lo")).otherwise(lam), "hi": F.when(over, lam).otherwise(F.col("hi")), "met": met})
        lo, hi = F.col("lo"), F.col("hi")
        newton = lam - F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("got") - target) / F.greatest(F.col("bend"), F.lit(1e-300))))
        half = (
            F.when((lo > float("-inf")) & (hi < float("inf")), (lo + hi) / 2)
            .when(lo > float("-inf"), lo + F.greatest(F.abs(lo), F.lit(1.0)))
            .otherwise(hi - F.greatest(F.abs(hi), F.lit(1.0)))
        )
        moved = ends.withColumn("next", newton).withColumn("lam", F.when(F.col("met"), lam).when((F.col("next") > lo) & (F.col("next") < hi), F.col("next")).otherwise(half))
        state = durable(moved.select(*keys).unionByName(state.filter("met")))
    raise RuntimeError(f"sources have not met their targets after {MAX_STEPS} Newton steps")


def round_rates(cells: DataFrame, targets: DataFrame, tilts: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, cell_n, whole, extra): every document of a cell gets `whole` copies and `extra` of them one more.

    Classes of sizes, a factor of 16 wide, go from the largest down. In each, the fractions of the rates add up over
    the cells of a source, and every full one is a copy; what the class misses of its words, or has too many, is made up
    by the rates of the next. So the last error is about the size of the smallest documents.
    """
    t = tilts.withColumnRenamed("source", "s")
    rate = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap))))
    cells = durable(
        cells.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
            "source", "size", "cell_n", F.round(rate * UNIT).cast("long").alias("r"), F.floor(F.log(16.0, "size") + 1e-12).cast("int").alias("k")
        )
    )
    rated = cells.groupBy("source").agg(F.sum(_words("r")).alias("rated"))
    carry = durable(
        targets.withColumnRenamed("source", "s")
        .join(rated, F.col("s").eqNullSafe(F.col("source")))
        .select("s", (F.round(F.col("target") * UNIT).cast("decimal(38,0)") - F.col("rated")).cast("decimal(38,0)").alias("carry"))
    )
    classes = [r["k"] for r in cells.select("k").distinct().orderBy(F.desc("k")).collect()]
    out = None
    for k in classes:
        own = cells.filter(F.col("k") == k)
        goal = own.groupBy(F.col("source").alias("s3")).agg(F.sum(_words("r")).alias("goal"))
        factor = F.greatest(F.lit(0.0), (F.col("goal") + F.col("carry")).cast("double") / F.col("goal").cast("double"))
        plan = goal.filter("goal > 0").join(carry, F.col("s3").eqNullSafe(F.col("s"))).select("s3", "goal", factor.alias("f"))
        scaled = own.join(plan, F.col("source").eqNullSafe(F.col("s3")), "left").withColumn(
            "r2", F.least(F.lit(cap * UNIT), F.round(F.col("r") * F.coalesce("f", F.lit(0.0))).cast("long"))
        )
        part = (F.col("r2") % UNIT) * F.col("cell_n")
        up_to = F.sum(part.cast("decimal(38,0)")).over(Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
        full = lambda c: F.floor((c + UNIT // 2) / UNIT).cast("long")
        rounded = durable(
            scaled.withColumn("up_to", up_to).select(
                "source", "size", "cell_n", F.floor(F.col("r2") / UNIT).cast("long").alias("whole"), (full(F.col("up_to")) - full(F.col("up_to") - part)).alias("extra"), "goal"
            )
        )
        words = (F.col("whole") * F.col("cell_n") + F.col("extra")).cast("decimal(38,0)") * F.col("size") * UNIT
        took = rounded.groupBy(F.col("source").alias("s4")).agg(F.sum(words.cast("decimal(38,0)")).alias("took"), F.max("goal").alias("goal"))
        if k != classes[-1]:
            carry = durable(
                carry.join(took, F.col("s").eqNullSafe(F.col("s4")), "left").select(
                    "s", (F.col("carry") + F.coalesce("goal", F.lit(0)) - F.coalesce("took", F.lit(0))).cast("decimal(38,0)").alias("carry")
                )
            )
        out = rounded.drop("goal") if out is None else out.unionByName(rounded.drop("goal"))
    return out


def _words(rate: str):
    return (F.col("cell_n").cast("decimal(20,0)") * F.col("size") * F.col(rate)).cast("decimal(38,0)")


def _named(source: Column) -> Column:
    """The source as text that is not null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _keys(doc_id: Column, text: Column, source: Column) -> list[Column]:
    """Source, its name, size and place of a row. Rows of one place have the same id and text."""
    return [source.cast("string").alias("source"), _named(source).alias("cell"), word_count(text).alias("size"), F.xxhash64(doc_id.cast("long"), text).alias("place")]


def _thresholds(sized: DataFrame, rounded: DataFrame) -> DataFrame:
    """`rounded` with the place up to which documents of a cell get one copy more.

    (cell, size, whole, at, tied, tied_extra): one more for places before `at`, and for `tied_extra` of the `tied` rows
    whose place it is. The documents of a cell are counted by ranges of their places, about as many ranges as each has
    documents; only the range in which the last copy falls is put in order.
    """
    r = durable(rounded.select(_named(F.col("source")).alias("cell"), "size", "cell_n", "whole", "extra"))
    some = durable(r.filter("extra > 0 and extra < cell_n").select("cell", "size", "extra", F.ceil(F.sqrt("cell_n")).alias("parts")))
    part = F.least(F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * F.col("parts")), F.col("parts") - 1)
    of = join_spread(places(sized.select("cell", "size", "place"), NUMBERED), some, ["cell", "size"], by=["place", "_part"])
    of = of.select("cell", "size", "extra", "place", part.alias("part"), "_part")
    n = of.groupBy("cell", "size", "extra", "part").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("cell", "size").orderBy("part")
    last = n.withColumn("upto", F.sum("n").over(so_far)).filter("upto >= extra and upto - n < extra")
    last = durable(last.select("cell", "size", "part", (F.col("extra") - F.col("upto") + F.col("n")).alias("need")))
    own = join_spread(of.drop("extra"), last, ["cell", "size", "part"], by=["place", "_part"])
    at_place = own.groupBy("cell", "size", "need", "place").agg(F.count("*").alias("tied"))
    at_place = at_place.withColumn("upto", F.sum("tied").over(Window.partitionBy("cell", "size").orderBy("place"))).filter("upto >= need and upto - tied < need")
    at = at_place.select("cell", "size", F.col("place").alias("at"), "tied", (F.col("need") - F.col("upto") + F.col("tied")).alias("tied_extra"))
    every = F.when(F.col("extra") >= F.col("cell_n"), F.lit(1)).otherwise(F.lit(0))
    return durable(r.join(at, ["cell", "size"], "left").select("cell", "size", (F.col("whole") + every).alias("whole"), "at", "tied", "tied_extra"))


def _copied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of (cell, size, place), which come from files, with their `copies` and `_part`.

    The plan has a row for each cell, not for each document; it is broadcast if its measured size allows, else rows of
    large cells are dealt to parts. Only among repeated rows, of one id and text, of which some get one copy more and
    others don't, are rows numbered: in parts, each from where the ones before it end.
    """
    joined = join_spread(places(rows, NUMBERED), plan, ["cell", "size"], "left", ["place", "_part"])
    whole = F.coalesce("whole", F.lit(0)).cast("long")
    some = F.coalesce((F.col("place") == F.col("at")) & (F.col("tied_extra") < F.col("tied")), F.lit(False))
    more = F.coalesce(F.col("place") <= F.col("at"), F.lit(False)).cast("long")
    done = lambda df, extra: df.withColumn("copies", whole + extra).drop("whole", "at", "tied", "tied_extra")
    if plan.filter("tied_extra < tied").isEmpty():
        return done(joined, more)
    key = ["cell", "size", "place"]
    repeated = joined.filter(some)
    own = Window.partitionBy(*key, "_part").orderBy("place")
    parts = repeated.groupBy(*key, "_part").agg(F.count("*").alias("_rows"))
    before = parts.withColumn("_before", F.sum("_rows").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_rows")).drop("_rows")
    numbered = join_spread(repeated.withColumn("_n", F.row_number().over(own)), durable(before), [*key, "_part"], by=["_n"])
    extra = (F.col("_n") + F.col("_before") <= F.col("tied_extra")).cast("long")
    return done(joined.filter(~some), more).unionByName(done(numbered, extra).drop("_n", "_before"))


def _solved(sized: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame | None]:
    """Targets, and the copies of each cell, or None if nobody has a word."""
    targets = durable(source_targets(sized.select("source", "size"), weights, cap))
    cells = durable(sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("cell_n")))
    rounded = round_rates(cells, targets, solve_rates(cells, targets, cap), cap)
    return targets, None if rounded is None else _thresholds(sized, rounded)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row, repeated rows included.

    size is the number of words; taken is copies * size. A document is copied 0 to `cap` times. Null sources are one
    source; null texts have no words, and documents without words get no copies. Which documents of a source and size
    get one copy more follows from a hash of doc_id and text. Other columns are ignored; no rows give no rows.
    """
    sized = durable(docs.select(F.col(doc_id).cast("long").alias("doc_id"), *_keys(F.col(doc_id), F.col(text), F.col(source))))
    targets, plan = _solved(sized, weights, cap)
    goal = durable(targets.select(_named(F.col("source")).alias("cell"), "source_size", "target"))
    mixed = places(sized, NUMBERED).withColumn("copies", F.lit(0).cast("long")) if plan is None else _copied(sized, plan)
    return join_spread(mixed, goal, ["cell"], by=["place", "_part"]).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP
) -> DataFrame:
    """Rows of `docs`, all columns kept, each as often as the mix copies it, as in mix().

    Texts stay where they are read: the copies of a row follow from its own source, size and hash and the plan of its
    cell. Null ids and null sources are as good as others, rows without words go, repeated rows share their cell's
    copies; no rows give no rows.
    """
    own = lambda c: F.col("_row")[c]
    rows = whole_rows(docs).select("_row", *_keys(own(doc_id), own(text), own(source)))
    _, plan = _solved(durable(rows.drop("_row")), weights, cap)
    if plan is None:
        return docs.limit(0)
    return each_copy(_copied(rows, plan).select("_row", "copies")).select("_row.*")
