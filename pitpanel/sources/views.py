"""Panel views over the star-schema tables.

Each view reduces raw rows with a map-side-combined aggregate to one row per
(entity, period) before anything is windowed, so the largest group a window
ever sees is one entity's calendar (months or days), however many raw rows a
hot entity holds. Money is summed in integer cents: exact, and independent of
the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def months_apart(a: Column, b: Column) -> Column:
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("int")


PANEL_COLS = ("px", "px2", "qty", "disc", "tax", "ret", "nopen")


def monthly_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x part -> one row per (entity, month), only populated months."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    sums = (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy("entity", F.last_day("l_shipdate").alias("month"))
        .agg(
            F.sum(cents("l_extendedprice")).alias("pc"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("q"),
            F.sum(cents("l_discount")).alias("dc"),
            F.sum(cents("l_tax")).alias("tc"),
            F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("nr"),
            F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("no"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    n = F.col("n").cast("double")
    return sums.select(
        "entity",
        "month",
        F.try_divide(F.col("pc") / 100.0, F.col("q").cast("double")).alias("px"),
        ((F.col("pc") / 100.0) / n).alias("px2"),
        F.col("q").cast("double").alias("qty"),
        ((F.col("dc") / 100.0) / n).alias("disc"),
        ((F.col("tc") / 100.0) / n).alias("tax"),
        (F.col("nr").cast("double") / n).alias("ret"),
        (F.col("no").cast("double") / n).alias("nopen"),
    )


def dense_months(sparse: DataFrame, entity: str = "entity", month: str = "month") -> DataFrame:
    """Every month between first and last per entity, absent months carrying the previous row forward.

    One window and one explode, no spine join: each populated row is repeated
    until the next populated month, which is exactly a forward fill.
    """
    w = Window.partitionBy(entity).orderBy(month)
    gap = F.coalesce(months_apart(F.lead(month).over(w), F.col(month)), F.lit(1))
    return (
        sparse.withColumns({"_first": F.first(month).over(w), "_gap": gap})
        .withColumn("_off", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)))
        .withColumn("filled", F.col("_off") > 0)
        .withColumn(month, F.last_day(F.add_months(F.col(month), F.col("_off"))))
        .withColumn("pos", months_apart(F.col(month), F.col("_first")))
        .drop("_off", "_gap", "_first")
    )


PANEL_TABLES = ("lineitem", "part")


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense monthly panel, computed once per session and input version."""
    build = lambda: dense_months(monthly_sums(spark, sf_dir))
    return materialise(spark, sf_dir, "panel", PANEL_TABLES, build)


def daily_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value per (priority, order date): a daily series with gaps."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date")
        )
        .agg(((F.sum(cents("o_totalprice")) / 100.0) / F.count(F.lit(1)).cast("double")).alias("value"))
    )


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many releases per observation: order date is observed, ship date is the release."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("release_date"), F.col("l_extendedprice").alias("value")
    )
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date")
    )
    return li.join(o, li.l_orderkey == o.o_orderkey).select("series_id", "obs_date", "release_date", "value")


def weekly_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly long / short / open interest per supplier bucket, dated on the Tuesday of the week."""
    d = F.to_date("l_shipdate")
    week = F.date_add(F.to_date(F.date_trunc("week", d)), 1)
    qty = F.col("l_quantity").cast("bigint")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 10).alias("entity"), week.alias("week"))
        .agg(
            F.sum(F.when(F.col("l_returnflag") == "A", qty).otherwise(0)).cast("double").alias("long"),
            F.sum(F.when(F.col("l_returnflag") == "R", qty).otherwise(0)).cast("double").alias("short"),
            F.sum(qty).cast("double").alias("oi"),
        )
    )


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("symbol"),
        F.when(k % 2 == 0, "call").otherwise("put").alias("type"),
        (F.col("p_size") * 4).cast("int").alias("dte"),
        F.col("p_retailprice").alias("strike"),
        ((k % 97) / 100.0).alias("iv"),
        (k % 13).cast("double").alias("oi"),
        (k % 7).cast("double").alias("vol"),
        k.alias("row_id"),
    )


FEATURES = ("disc", "tax", "ret_d3", "qty_c3", "px_m6", "px_t10")
H = 3
TRAIN, VAL = 0.6, 0.2
