"""Null-safe column arithmetic.

Missing is NULL everywhere: NaN and infinities are turned into NULL once, at
ingestion (`finite`), and every ratio goes through `try_divide`, so ANSI mode
never raises.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26, fixed values.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and +-infinity become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Winsorise; NULL stays NULL although least/greatest skip NULLs."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def stable(c: str | Column, digits: int = 12) -> Column:
    """Values equal in exact arithmetic become equal doubles, so ties and cut points do not depend on rounding noise."""
    return F.round(col(c), digits)


def whole(*keys: str, order: str = "pos") -> WindowSpec:
    """All rows of the key, with an order: shares one sort with the ordered windows of the same key."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def by_entity(*keys: str, order: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def diff(c: str | Column, k: int, w: WindowSpec) -> Column:
    return col(c) - F.lag(col(c), k).over(w)


def pct_change(c: str | Column, k: int, w: WindowSpec) -> Column:
    return ratio(c, F.lag(col(c), k).over(w)) - 1.0


def safe_pct_change(c: str | Column, k: int, w: WindowSpec, eps: float = 1e-12) -> Column:
    """Percent change, NULL when the base is (nearly) zero or the result is not finite."""
    prev = F.lag(col(c), k).over(w)
    return F.when(F.abs(prev) > eps, finite(col(c) / prev - 1.0))


def forward_return(c: str | Column, h: int, w: WindowSpec) -> Column:
    return ratio(F.lead(col(c), h).over(w), c) - 1.0


def rolling(agg, c: str | Column, n: int, minp: int, w: WindowSpec) -> Column:
    """Trailing aggregate over n rows, NULL until minp non-null values are in the frame."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) >= minp, agg(col(c)).over(frame))


def expanding(agg, c: str | Column, minp: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(col(c)).over(frame) >= minp, agg(col(c)).over(frame))


def ffill(c: str | Column, w: WindowSpec) -> Column:
    return F.last(col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def row_mean(*cols: str | Column) -> Column:
    """Mean of the members that exist (NULL when none does)."""
    cs = [col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    present = [c.isNotNull().cast("int") for c in cs]
    return F.try_divide(total, sum(present[1:], present[0]))


def erfc_pos(x: Column) -> Column:
    """Complementary error function for x >= 0 (abs error about 1.5e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = poly * t + F.lit(a)
    return poly * t * F.exp(-(x * x))


def two_sided_p(t: str | Column) -> Column:
    return erfc_pos(F.abs(col(t)) / F.sqrt(F.lit(2.0)))


def normal_cdf(z: Column) -> Column:
    half = F.lit(0.5) * erfc_pos(F.abs(z) / F.sqrt(F.lit(2.0)))
    return F.when(z >= 0, F.lit(1.0) - half).otherwise(half)


def avg_rank(c: str | Column, *keys: str, where: Column | None = None) -> Column:
    """Average rank of non-null values inside `keys` (Spark's rank() is the minimum rank)."""
    c = col(c)
    live = c.isNotNull() if where is None else where & c.isNotNull()
    v = F.when(live, c)
    lowest = F.rank().over(Window.partitionBy(*keys, live).orderBy(v))
    peers = F.count(v).over(Window.partitionBy(*keys, live, v))
    return F.when(live, lowest + (peers - 1) / F.lit(2.0))


def pearson(x: str | Column, y: str | Column, min_n: int = 8) -> Column:
    """Aggregate: Pearson correlation over complete pairs; NULL below min_n or for a constant side.

    Written on raw sums because the inputs are ranks (multiples of 1/2), for which
    the sums are exact and independent of row order.
    """
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    n = F.count(a)
    sx, sy, sxx, syy, sxy = F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)
    den = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.when(n >= min_n, F.try_divide(n * sxy - sx * sy, den))


def compound(r: str | Column, w: WindowSpec) -> Column:
    """Running product of 1+r; works for returns at or below -100% (no logarithm of the sign)."""
    g = F.lit(1.0) + col(r)
    mag = F.exp(F.sum(F.when(g != 0, F.ln(F.abs(g)))).over(w))
    neg = F.sum((g < 0).cast("int")).over(w)
    zero = F.max((g == 0).cast("int")).over(w)
    return F.when(zero == 1, 0.0).otherwise(F.when(neg % 2 == 0, mag).otherwise(-mag))


def nonneg_sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def rounded(df, digits: int = 6):
    """Round every double column: sums depend on row order in the last bits."""
    return df.select(
        *[F.round(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )
