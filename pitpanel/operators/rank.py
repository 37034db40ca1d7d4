"""Ranking indicators by what they said about the outcome, in and out of sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import stats as ST


def high_low(df: DataFrame, keys, y: str = "y", dd: str | None = None, state: str = "state") -> DataFrame:
    """High minus Low: mean in points, in outcome deviations, and median drawdown in points."""
    hi, lo = F.col(state) == "High", F.col(state) == "Low"
    yh, yl = F.when(hi, F.col(y)), F.when(lo, F.col(y))
    enough = (F.count(yh) >= 4) & (F.count(yl) >= 4)
    gap, sd = F.avg(yh) - F.avg(yl), F.stddev_samp(y)
    aggs = [
        F.when(enough, gap * 100.0).alias("hl"),
        F.when(enough & (sd > 0), F.try_divide(gap, sd)).alias("eff"),
    ]
    if dd:
        dh, dl = F.when(hi, F.col(dd)), F.when(lo, F.col(dd))
        ok = (F.count(dh) >= 4) & (F.count(dl) >= 4)
        aggs.append(F.when(ok, (F.percentile(dh, 0.5) - F.percentile(dl, 0.5)) * 100.0).alias("hl_dd"))
    return df.groupBy(*keys).agg(*aggs)


def indicator_ranking(long: DataFrame, h: int, keys=("entity", "feature"), learn: str = "learn", unseen: str = "unseen") -> DataFrame:
    """One row per indicator: rank correlation in both periods, HAC t on ranks, hit rate and its interval, status.

    `long` has boolean columns for the two periods. Ranks of both periods come
    from one pass over the same partitioning.
    """
    keys = list(keys)
    rows = long.filter(F.col(learn) | F.col(unseen)).withColumn("period", F.when(F.col(learn), "l").otherwise("u"))
    w = Window.partitionBy(*keys)
    rows = rows.withColumns(
        {
            "mx": F.percentile(F.when(F.col(learn), F.col("x")), 0.5).over(w),
            "my": F.percentile(F.when(F.col(learn), F.col("y")), 0.5).over(w),
            "rx": C.avg_rank("x", *keys, "period"),
            "ry": C.avg_rank("y", *keys, "period"),
        }
    )
    sx, sy = F.signum(F.col("x") - F.col("mx")), F.signum(F.col("y") - F.col("my"))
    in_u = F.col("period") == "u"
    ok = in_u & (sx != 0) & (sy != 0)
    side = lambda p: C.pearson(F.when(F.col("period") == p, F.col("rx")), F.when(F.col("period") == p, F.col("ry")))
    g = rows.groupBy(*keys).agg(
        side("l").alias("ic_l"),
        side("u").alias("ic_u"),
        F.count(F.when(in_u, 1)).alias("n_u"),
        F.count(F.when(ok, 1)).alias("n_ok"),
        F.avg(F.when(ok, (sx == sy).cast("double"))).alias("agree"),
    )
    t = ST.hac_t(rows.filter(learn), keys, "ry", "rx", h, extra=(F.count(F.lit(1)).alias("n_l"),))
    g = g.join(t.withColumn("t", F.when(F.col("n_l") > 8, F.col("t"))), keys)
    rated = F.col("ic_l").isNotNull() & (F.col("ic_l") != 0) & (F.col("n_u") >= 8) & (F.col("n_ok") >= 8)
    same = F.coalesce(F.signum("ic_l") == F.signum("ic_u"), F.lit(False))
    return g.withColumns(
        {
            "hit": F.when(rated, F.when(F.col("ic_l") > 0, F.col("agree")).otherwise(1.0 - F.col("agree"))),
            "hit_ci": F.when(rated, 1.96 * F.sqrt(0.25 / F.greatest(F.col("n_ok") / F.lit(float(h)), F.lit(1.0)))),
            "same": same,
            "minic": F.when(same, F.least(F.abs("ic_l"), F.abs("ic_u")) * 100.0).otherwise(0.0),
            "status": F.when(F.col("ic_l").isNull() | F.col("ic_u").isNull(), "-")
            .when(~same, "flips on unseen data")
            .when(F.abs("t") >= 2, "consistent and significant")
            .otherwise("consistent but weak"),
        }
    ).drop("agree", "n_u", "n_ok", "n_l")


def links(long: DataFrame, h: int, signs: dict[str, int], keys=("entity", "feature")) -> DataFrame:
    """(keys, n_learn, ic_l, ic_u, t, status, textbook): how each indicator lined up with the outcome in the learn and in the unseen rows.

    Every indicator is ranked over the rows in which it and the outcome are known.
    """
    keys = list(keys)
    rows = long.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("part").isin("learn", "val", "test"))
    rows = rows.withColumn("learn", F.col("part") == "learn")
    rows = rows.withColumns({"rx": C.avg_rank("x", *keys, "learn"), "ry": C.avg_rank("y", *keys, "learn")})
    side = lambda on: C.pearson(F.when(on, F.col("rx")), F.when(on, F.col("ry")))
    g = rows.groupBy(*keys).agg(F.count(F.when(F.col("learn"), 1)).alias("n_learn"), side(F.col("learn")).alias("ic_l"), side(~F.col("learn")).alias("ic_u"))
    g = g.join(ST.hac_t(rows.filter("learn"), keys, "ry", "rx", h), keys).withColumn("t", F.when(F.col("n_learn") > 8, F.col("t")))
    status = (
        F.when(F.col("ic_l").isNull() | F.col("ic_u").isNull(), "-").when(F.signum("ic_l") != F.signum("ic_u"), "flips on unseen data")
        .when(F.abs("t") >= 2, "consistent and significant").otherwise("consistent but weak")
    )
    sign = F.create_map(*[F.lit(x) for kv in signs.items() for x in kv])[F.col("feature")]
    return g.withColumn("status", status).withColumn("textbook", F.when((sign != 0) & F.col("ic_l").isNotNull(), F.signum("ic_l") == sign))


def placed(df: DataFrame, keys, order, out: str = "place") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w))


def top_bottom(df: DataFrame, keys, by: Column, k: int, ties=()) -> DataFrame:
    """k best and k worst rows per key."""
    up = Window.partitionBy(*keys).orderBy(by.asc(), *ties)
    down = Window.partitionBy(*keys).orderBy(by.desc(), *ties)
    d = df.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    best = F.when(F.col("_d") <= k, F.struct(F.lit("best").alias("list"), F.col("_d").alias("place")))
    worst = F.when(F.col("_u") <= k, F.struct(F.lit("worst").alias("list"), F.col("_u").alias("place")))
    return d.withColumn("_p", F.explode(F.array_compact(F.array(best, worst)))).select("*", "_p.*").drop("_u", "_d", "_p")
