"""Semi-joins against key sets of any size without moving the large side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; its broadcast has at most 2 ** (BITS - 6) rows of two longs.
BITS = 25


def possibly_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``keys.column``: all that are, and a share of the others that falls with
    ``BITS`` (number of keys / 2 ** BITS).

    The keys become a bitmap of fixed size over their hashes, which is broadcast, so ``df`` is filtered where it is read
    whatever the number of keys. Null keys match nothing.
    """
    place = lambda name: F.pmod(F.xxhash64(F.col(name)), F.lit(1 << BITS))
    bit = F.expr("shiftleft(1L, cast(__x % 64 as int))")
    known = keys.where(F.col(column).isNotNull()).select(place(column).alias("__x"))
    marks = known.groupBy(F.expr("__x div 64").alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    marked = df.where(F.col(column).isNotNull()).withColumn("__x", place(column)).withColumn("__word", F.expr("__x div 64"))
    joined = marked.join(F.broadcast(marks), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
    return joined.select(*df.columns)
