"""A filter of fixed size over hashes, broadcast because its size is bounded whatever is hashed into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^24 bits in 2^18 words: at most 2^18 rows of two numbers, some 6 MB.
BITS = 24


def _place(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS)


def may_hold(rows: DataFrame, h: Column, hashes: DataFrame) -> DataFrame:
    """The rows plus ``__may``: false only where the 64-bit hash ``h`` is surely none of ``hashes`` (one column h).

    Rows stay where they are. With many more hashes than bits the answer is mostly true, and whatever follows must be
    right without it.
    """
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) % 64 as int))")
    words = hashes.groupBy(F.shiftright(_place(F.col("h")), 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    at = rows.withColumn("__h", h).withColumn("__word", F.shiftright(_place(F.col("__h")), 6))
    held = at.join(F.broadcast(words), "__word", "left")
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__h, {64 - BITS}) % 64 as int))")
    return held.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(mask) != 0, F.lit(False))).drop("__word", "__bits", "__h")
