"""Higher-order helpers on arrays whose length is bounded by the calendar or by a horizon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LCG_M = 2147483647


def quantile_sorted(arr: Column, q: float | Column) -> Column:
    """Linear-interpolated quantile of an ascending array without NULLs."""
    p = (F.size(arr) - 1) * (F.lit(q) if isinstance(q, float) else q)
    lo = F.floor(p).cast("int")
    hi = F.ceil(p).cast("int")
    a, b = F.get(arr, lo), F.get(arr, hi)
    return F.when(F.size(arr) > 0, a + (p - lo) * (b - a))


def array_mean(arr: Column) -> Column:
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr).cast("double"))


def median_of(arr: Column) -> Column:
    return quantile_sorted(F.array_sort(arr), 0.5)


def max_drawdown(arr: Column) -> Column:
    """min over i of x[i] / max(x[0..i]) - 1."""
    init = F.struct(F.get(arr, F.lit(0)).alias("top"), F.lit(0.0).alias("dd"))
    step = lambda a, x: F.struct(
        F.greatest(a["top"], x).alias("top"),
        F.least(a["dd"], x / F.greatest(a["top"], x) - 1.0).alias("dd"),
    )
    return F.aggregate(arr, init, step, lambda a: a["dd"])


def greedy_gap(sorted_candidates: Column, k: int, gap: int | Column, elem_type: str) -> Column:
    """First k candidates of an array sorted by preference that are at least `gap` apart in `.pos`."""
    gap = F.lit(gap) if isinstance(gap, int) else gap
    empty = F.array().cast(f"array<{elem_type}>")
    return F.aggregate(
        sorted_candidates,
        empty,
        lambda acc, x: F.when(
            (F.size(acc) < k) & F.forall(acc, lambda c: F.abs(c["pos"] - x["pos"]) >= gap),
            F.array_append(acc, x),
        ).otherwise(acc),
    )


def uniform_int(m: Column, rep: Column, block: Column | int, seed: int = 0) -> Column:
    """Arithmetic hash of (seed, rep, block) to an integer in [0, m); the same formula runs in plain SQL."""
    block = F.lit(block) if isinstance(block, int) else block
    rep, block = rep.cast("bigint"), block.cast("bigint")
    z = (rep * 1000003 + block * 7919 + F.lit(seed * 104729 + 12345).cast("bigint")) % LCG_M
    z = (z * z + rep * 31 + block) % LCG_M
    z = (z * z + 48271 * block + 7) % LCG_M
    return z % m.cast("bigint")
