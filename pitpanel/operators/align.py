"""Dating observations by publication and aligning mixed frequencies without look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def _picked(df: DataFrame, pick, keys, order, cols) -> DataFrame:
    """By several columns of order: first by the last one inside equal values of the others, and so on. Every step picks
    fixed-width values by a fixed-width one and stays a hash aggregate, where a struct as order would be sorted first."""
    rows = df.select(*keys, *[C.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    for last in reversed(range(len(order))):
        held = [f"_o{i}" for i in range(last)]
        rows = rows.groupBy(*keys, *held).agg(*[pick(F.col(f"_c{i}"), F.col(f"_o{last}")).alias(f"_p{i}") for i in range(len(cols))])
        rows = rows.withColumnsRenamed({f"_p{i}": f"_c{i}" for i in range(len(cols))})
    return rows.select(*keys, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])


def keep_last(df: DataFrame, keys, order, cols) -> DataFrame:
    """One row per key, the one with the greatest `order`; an aggregate, so hot keys combine map-side.

    `order` must be unique inside a key, otherwise which row wins is undefined.
    """
    return _picked(df, F.max_by, keys, order, cols)


def keep_first(df: DataFrame, keys, order, cols) -> DataFrame:
    """As `keep_last`, for the smallest `order`."""
    return _picked(df, F.min_by, keys, order, cols)


def lagged(obs: Column, months: Column | int, days: Column | int) -> Column:
    """Publication date by rule: months are added with month-end clipping, then days."""
    return F.date_add(F.add_months(obs, months), days)


def sane_release(obs: Column, release: Column, rule: Column, limit: int = 150) -> Column:
    """The real release date when it lies 0..limit days after the observation, else the rule."""
    return F.when(release.between(obs, F.date_add(obs, limit)), release).otherwise(rule)


def available(df: DataFrame, keys, obs: str, avail: Column, value: str) -> DataFrame:
    """Re-date by availability; of several values on one date the latest observation wins."""
    dated = df.withColumn("avail_date", avail)
    return keep_last(dated, [*keys, "avail_date"], [obs], [obs, value])


def outer_ffill(obs: DataFrame, series, keys=(), day: str = "d", name: str = "series_id", value: str = "value") -> DataFrame:
    """All series on one date axis, each carried forward: union + pivot, never a chain of outer joins."""
    wide = obs.groupBy(*keys, day).pivot(name, list(series)).agg(F.first(value))
    return fill_forward(wide, series, keys, day)


#: Days of a block of the forward fill.
BLOCK_DAYS = 64


def fill_forward(wide: DataFrame, cols, keys=(), day: str = "d") -> DataFrame:
    """Every column carried forward in order of `day`, as a prefix scan over blocks of days.

    A block is filled by itself; the last values of the blocks, one row each, are carried from block to block and
    reach the rows in which their own block has none yet. So a single long axis is filled by many tasks.
    """
    keys, cols = list(keys), list(cols)
    q = {c: F.col(f"`{c}`") for c in cols}
    rows = wide.withColumn("_block", F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BLOCK_DAYS))
    last = rows.groupBy(*keys, "_block").agg(*[F.max_by(q[c], F.when(q[c].isNotNull(), F.col(day))).alias(f"_l{i}") for i, c in enumerate(cols)])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_block", *[F.last(f"_l{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(cols))])
    upto = Window.partitionBy(*keys, "_block").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select(*keys, day, "_block", *[F.last(q[c], ignorenulls=True).over(upto).alias(f"_f{i}") for i, c in enumerate(cols)])
    joined = filled.join(carried, [*keys, "_block"])
    return joined.select(*keys, day, *[F.coalesce(f"_f{i}", f"_c{i}").alias(c) for i, c in enumerate(cols)])


def month_end_last(df: DataFrame, keys, day: str, cols) -> DataFrame:
    """Last non-null value per calendar month and column, populated months only."""
    out = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(day))).alias(c) for c in cols]
    return df.groupBy(*keys, F.last_day(day).alias("month")).agg(*out)


def interpolate_days(df: DataFrame, keys, day: str, value: str, limit: int = 10) -> DataFrame:
    """Daily axis with time-weighted interpolation of at most `limit` consecutive missing days.

    Each observation is expanded up to the next one, so the axis needs no join;
    days beyond the limit stay NULL and nothing is extrapolated.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    nxt = df.filter(F.col(value).isNotNull()).withColumns(
        {"_nd": F.lead(day).over(w), "_nv": F.lead(value).over(w), "_d0": F.col(day)}
    )
    span = F.coalesce(F.datediff("_nd", "_d0"), F.lit(1))
    days = nxt.withColumn("_span", span).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_span") - 1)))
    line = F.col(value) + (F.col("_nv") - F.col(value)) * (F.col("_o") / F.col("_span"))
    return days.select(
        *keys,
        F.date_add("_d0", F.col("_o")).alias(day),
        F.when(F.col("_o") == 0, F.col(value)).when(F.col("_o") <= limit, line).alias(value),
    )


def with_target(df: DataFrame, target: str) -> DataFrame:
    """The rows whose target is known and positive."""
    return df.filter(F.col(target).isNotNull() & (F.col(target) > 0))


def series_or(first: Column, other: Column, w) -> Column:
    """`first` where the key has any value of it, otherwise the whole of `other`: two sources are never mixed in one series."""
    return F.when(F.count(first).over(w) > 0, first).otherwise(other)


def splice(df: DataFrame, keys, day: str, spot: str, fut: str, out: str) -> DataFrame:
    """Spot carried forward while it exists; afterwards futures scaled to the last spot level."""
    w = Window.partitionBy(*keys)
    carried = C.ffill(fut, w.orderBy(day))
    d = df.withColumn("_f", carried)
    last = F.max(F.when(F.col(spot).isNotNull(), F.col(day))).over(w)
    d = d.withColumn("_last", last)
    at_last = F.max_by(F.struct(F.col(spot).alias("s"), F.col("_f").alias("f")), F.when(F.col(spot).isNotNull(), F.col(day))).over(w)
    d = d.withColumn("_a", at_last).withColumn("_s", C.ffill(spot, w.orderBy(day)))
    scale = F.when((F.col("_a.f") > 0) & (F.col("_a.s") > 0), F.col("_a.s") / F.nullif(F.col("_a.f"), F.lit(0.0)))
    price = (
        F.when(F.col("_last").isNull(), F.col("_f"))
        .when((F.col(day) <= F.col("_last")) | scale.isNull(), F.col("_s"))
        .otherwise(F.col("_f") * scale)
    )
    return d.withColumn(out, price).drop("_f", "_last", "_a", "_s")


def coverage(long: DataFrame, keys=("entity", "feature"), x: str = "x", when: str = "month") -> DataFrame:
    """First and last valid date and count per series; all-null series have NULL dates."""
    at = F.when(F.col(x).isNotNull(), F.col(when))
    return long.groupBy(*keys).agg(F.count(x).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def asof_value(df: DataFrame, keys, when: str, cols, months_back: int) -> DataFrame:
    """Latest row and the row at or before `months_back` months earlier, per key."""
    top = F.max(when).over(Window.partitionBy(*keys))
    d = df.withColumn("_top", top)
    ref = F.when(F.col(when) <= F.last_day(F.add_months("_top", -months_back)), F.col(when))
    aggs = [F.max_by(c, when).alias(c) for c in cols] + [F.max_by(c, ref).alias(f"{c}_ref") for c in cols]
    return d.groupBy(*keys).agg(F.max(when).alias(when), *aggs)


def months_since_event(d: Column, events: list[str]) -> Column:
    """Days since the latest event of a fixed list, in mean months; NULL before the first."""
    past = F.filter(F.array(*[F.to_date(F.lit(e)) for e in events]), lambda e: e <= d)
    return F.datediff(d, F.array_max(past)) / F.lit(30.4375)
