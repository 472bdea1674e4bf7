"""Ranks of rows by a least-significant-digit radix sort over integer keys.

Each pass is a stable counting sort by one digit. Rows are counted by digit and block
of the present order; prefix sums of these counts are the places where the rows of a
block that have a digit begin; a row's own place follows from its order among them.
No pass sorts more than one block, and a pass moves the rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

DIGIT_BITS = 10
BLOCK_BITS = 13
ALL_BEFORE = (Window.unboundedPreceding, -1)


def _digits(rows: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    """The digits in which keys differ at all, the least significant of the last key first."""
    asked = [f(F.col(name)) for name, _ in keys for f in (F.min, F.max, lambda c: F.count_if(c.isNull()))]
    found = rows.agg(*asked).first()
    digits = []
    for k, (name, falling) in reversed(list(enumerate(keys))):
        low, high, nulls = found[3 * k : 3 * k + 3]
        if low is not None:
            if high - low < 1 << 63:
                bits = (high - low).bit_length()
                offset = F.lit(high) - F.col(name) if falling else F.col(name) - F.lit(low)
            else:
                bits = 64
                offset = F.col(name).bitwiseXOR(F.lit(-(1 << 63)))
                offset = F.bitwise_not(offset) if falling else offset
            offset = F.coalesce(offset, F.lit(0).cast("long"))
            for shift in range(0, bits, DIGIT_BITS):
                digits.append(F.shiftrightunsigned(offset, shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int"))
        if nulls and low is not None:
            digits.append(F.col(name).isNull().cast("int"))
    return digits


def _counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """The rows with their places ``__at`` after a stable sort by ``digit``."""
    placed = rows.withColumns({"__digit": digit, "__block": F.shiftright("__at", BLOCK_BITS)})
    counts = placed.groupBy("__digit", "__block").agg(F.count("*").alias("__n"))
    # At most one row for each value of a digit.
    totals = counts.groupBy("__digit").agg(F.sum("__n").alias("__total"))
    smaller = F.sum("__total").over(Window.orderBy("__digit").rowsBetween(*ALL_BEFORE))
    begins = totals.select("__digit", F.coalesce(smaller, F.lit(0)).alias("__begin"))
    earlier = F.sum("__n").over(Window.partitionBy("__digit").orderBy("__block").rowsBetween(*ALL_BEFORE))
    starts = counts.join(F.broadcast(begins), "__digit").select(
        "__digit", "__block", (F.col("__begin") + F.coalesce(earlier, F.lit(0))).alias("__start")
    )
    among = F.row_number().over(Window.partitionBy("__digit", "__block").orderBy("__at"))
    moved = placed.join(starts, ["__digit", "__block"]).withColumn("__at", F.col("__start") + among - 1)
    return moved.select(*rows.columns)


def ranked(rows: DataFrame, keys: list[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """All rows with their rank from 1 on in the order of ``keys``.

    A key is the name of a column of whole numbers (long) and whether it falls. Nulls
    come last under either order. Rows that are equal in all keys get ranks in a row, in
    no given order. An empty table stays empty; a column called ``name`` is replaced;
    columns must not begin with two underscores. The rows are stored in the checkpoint
    folder once for each pass, and each pass deletes the rows of the one before.
    """
    spark = rows.sparkSession
    state, folder = stored(rows.drop(name).withColumn("__at", F.monotonically_increasing_id()))
    passes = _digits(state, keys) or [F.lit(0)]
    for digit in passes:
        after, written = stored(_counting_pass(state, digit))
        discard(spark, folder)
        state, folder = after, written
    return state.withColumn(name, F.col("__at") + 1).drop("__at")
