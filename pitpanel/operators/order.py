"""Ranks and order statistics of growing samples, counted offline.

Nothing here stores a row's history. A question about all earlier rows is taken apart by
the bits of positions or of ranks, and each bit is one running sum of a window, so a key of n rows needs
n rows of memory and log2(n) sorts of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bits_of(df: DataFrame, pos: str = "pos") -> int:
    """Bits of the largest position: one number, read before the plan is made."""
    most = df.agg(F.max(pos)).first()[0]
    return int(most or 0).bit_length()


def earlier_smaller(df: DataFrame, x: str, keys, bits: int, out: str, pos: str = "pos") -> DataFrame:
    """`out`: how many earlier rows of the key have a strictly smaller x. Rows without x are not counted.

    Two positions differ first in one bit; the earlier one has a 0 there. So for every bit the rows of a
    block of positions are sorted by x, and a row of the block's second half counts those of the first half before it.
    """
    rows, total = df.repartition(*keys), F.lit(0)
    for b in range(bits):
        block, second = f"_block{b}", f"_second{b}"
        rows = rows.withColumns({block: F.shiftright(pos, b + 1), second: F.shiftright(pos, b).bitwiseAND(1)})
        upto = Window.partitionBy(*keys, block).orderBy(x, F.desc(second)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = F.col(x).isNotNull() & (F.col(second) == 0)
        rows = rows.withColumn(f"_c{b}", F.when(F.col(second) == 1, F.count(F.when(first, 1)).over(upto)).otherwise(0)).drop(block, second)
        total = total + F.col(f"_c{b}")
    return rows.withColumn(out, F.when(F.col(x).isNotNull(), total)).drop(*[f"_c{b}" for b in range(bits)])


def expanding_percentile(df: DataFrame, x: str, keys, out: str, minp: int = 36, bits: int | None = None) -> DataFrame:
    """Share of strictly smaller values among all earlier values; NULL until minp values exist (this one included)."""
    counted = earlier_smaller(df, x, keys, bits_of(df) if bits is None else bits, "_smaller")
    past = F.count(x).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    share = F.when(past >= minp - 1, F.try_divide(F.col("_smaller").cast("double"), past))
    return counted.withColumn(out, share).drop("_smaller")


def order_statistics(values: DataFrame, asks: DataFrame, keys, bits: int) -> DataFrame:
    """`v` of every ask: the j-th smallest (from 0) value among rows of the key at positions up to `upto`.

    `values` holds keys, pos and v (no nulls), `asks` keys, ask, upto, j and the number n of such values, which is above j.
    Values are ranked once; from the highest bit of the rank on, a running count by position tells how many of the
    values that an ask may see have a 0 there, which decides the bit of the answer's rank.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("v", "pos")) - 1
    own = values.repartition(*keys).select(*keys, F.col("pos").alias("at"), rank.alias("rank"), "v", *[F.lit(None).cast("int").alias(c) for c in ("ask", "j", "n")])
    other = asks.select(*keys, F.col("upto").alias("at"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("v"), *[F.col(c).cast("int") for c in ("ask", "j", "n")])
    rows = own.unionByName(other).repartition(*keys).withColumn("node", F.lit(0))
    for b in reversed(range(bits)):
        upto = Window.partitionBy(*keys, "node").orderBy("at", F.col("ask").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bit = F.shiftright("rank", b).bitwiseAND(1)
        rows = rows.withColumn("_zeros", F.count(F.when(bit == 0, 1)).over(upto).cast("int"))
        above = F.col("j") >= F.col("_zeros")
        rows = rows.withColumn("node", F.col("node") * 2 + F.when(F.col("rank").isNotNull(), bit).otherwise(above.cast("int")))
        rows = rows.withColumn("j", F.when(above, F.col("j") - F.col("_zeros")).otherwise(F.col("j"))).drop("_zeros")
    found = rows.withColumn("v", F.max("v").over(Window.partitionBy(*keys, "node")))
    return found.filter(F.col("ask").isNotNull()).select(*keys, F.col("at").alias("upto"), "ask", "n", "v")


def quantile_asks(n: Column, levels) -> Column:
    """The ranks around every quantile of n values, numbered 2i (below) and 2i + 1 (above)."""
    at = [(n - 1) * F.lit(q) for q in levels]
    each = [F.struct(F.lit(2 * i + k).alias("ask"), f(p).cast("int").alias("j")) for i, p in enumerate(at) for k, f in enumerate((F.floor, F.ceil))]
    return F.array(*each)


def quantiles_from(n: Column, levels) -> Column:
    """Aggregate of the answers to `quantile_asks`: the linear quantiles."""
    out = []
    for i, q in enumerate(levels):
        p = (n - 1) * F.lit(q)
        low, high = (F.max(F.when(F.col("ask") == 2 * i + k, F.col("v"))) for k in (0, 1))
        out.append(low + (p - F.floor(p)) * (high - low))
    return F.array(*out)
