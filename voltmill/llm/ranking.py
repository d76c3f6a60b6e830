"""Exact selection and ranks over tables of any size, by counts of digits and by ranges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import durable

#: Bits of a key that one counting step tells apart; the driver gets a number for each value of a digit.
DIGIT_BITS = 12
#: Rows of one range, on average.
ROWS_A_RANGE = 1 << 20


def first_rows(rows: DataFrame, keys: list[str], need: int, total: int, digit_bits: int = DIGIT_BITS) -> Column:
    """The condition that holds for the `need` first of `total` rows in ascending order of `keys`, long columns without nulls.

    Radix selection: each step counts the rows by the highest digit of the key that is still open and goes on with those
    of the digit in which the last wanted row lies, until a digit is wanted as a whole. The keys together have to tell
    all rows apart; `rows` is read once a step and should be written.
    """
    if need <= 0:
        return F.lit(False)
    steps: list[tuple[str, int, int]] = []
    for key in keys:
        if need == total:
            break
        least, most = rows.agg(F.min(key), F.max(key)).first()
        shift = 64 if (least < 0) != (most < 0) else (least ^ most).bit_length()
        while shift and need < total:
            shift = max(0, shift - digit_bits)
            digit = F.shiftright(key, shift)
            before = 0
            for value, n in sorted((r["digit"], r["count"]) for r in rows.groupBy(digit.alias("digit")).count().collect()):
                if before + n >= need:
                    need, total = need - before, n
                    break
                before += n
            steps.append((key, shift, value))
            rows = rows.filter(digit == value)
    if need != total:
        raise ValueError("the keys do not tell the rows apart")
    chosen = F.lit(True)
    for key, shift, value in reversed(steps):
        digit = F.shiftright(key, shift)
        chosen = (digit < value) | ((digit == value) & chosen)
    return chosen


def placed(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Rows with `place`, from 0 in `order`, over ranges of about ROWS_A_RANGE of the `n` rows.

    A row's place is the one within its range and the number of rows in the ranges before it, one number a range.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_RANGE))
    ranged = durable(
        rows.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    starts, so_far = [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):
        starts.append((r["_range"], so_far))
        so_far += r["count"]
    starts = spark.createDataFrame(starts, "_range int, _start long")
    return ranged.join(F.broadcast(starts), "_range").withColumn("place", F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")
