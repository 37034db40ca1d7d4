"""Landed provider responses to clean observations.

The parsers take a DataFrame of payload text, so the same code serves files on
storage (the read_* functions) and payload columns already in a table. Output
is `(series_id, obs_date, value)` with one row per date.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align

MACRO_SCHEMA = "struct<observations:array<struct<date:string,value:string>>>"
CHART_SCHEMA = "struct<values:array<struct<x:bigint,y:double>>>"
METRIC_SCHEMA = "struct<data:array<struct<time:string,value:string>>>"


def clean_series(df: DataFrame, keys, when: str, value: str, seq: str, positive: bool = False) -> DataFrame:
    """Floor to UTC days, coerce numbers, drop missing and infinite, keep the last arrival per day.

    `seq` is the arrival order, because a distributed table has no row order.
    """
    day = F.to_date(F.col(when).try_cast("timestamp"))
    x = C.finite(F.col(value).try_cast("double"))
    rows = df.select(*keys, day.alias("obs_date"), x.alias("value"), F.col(seq).alias("_seq"))
    rows = rows.filter(F.col("obs_date").isNotNull() & F.col("value").isNotNull())
    if positive:
        rows = rows.filter(F.col("value") > 0)
    return align.keep_last(rows, [*keys, "obs_date"], ["_seq"], ["value"])


def parse_macro_json(pages: DataFrame, keys, payload: str, seq: str) -> DataFrame:
    o = pages.select(*keys, seq, F.explode(F.from_json(payload, MACRO_SCHEMA)["observations"]).alias("o"))
    return clean_series(o.select(*keys, seq, "o.date", "o.value"), keys, "date", "value", seq)


def parse_macro_csv(lines: DataFrame, keys, line: str, seq: str) -> DataFrame:
    """First two columns of each line; '.' and the empty string are missing."""
    f = F.split(line, ",")
    if_ok = F.size(f) >= 2
    v = F.trim(F.get(f, F.lit(1)))
    cells = lines.filter(if_ok).select(*keys, seq, F.get(f, F.lit(0)).alias("date"), F.nullif(F.nullif(v, F.lit(".")), F.lit("")).alias("value"))
    return clean_series(cells, keys, "date", "value", seq)


def parse_metric_json(pages: DataFrame, keys, payload: str, seq: str) -> DataFrame:
    o = pages.select(*keys, seq, F.explode(F.from_json(payload, METRIC_SCHEMA)["data"]).alias("o"))
    return clean_series(o.select(*keys, seq, "o.time", "o.value"), keys, "time", "value", seq)


def parse_chart_json(pages: DataFrame, keys, payload: str, seq: str, limit: int = 10) -> DataFrame:
    """Epoch seconds to dates, then gap interpolation inside the observed range."""
    o = pages.select(*keys, seq, F.explode(F.from_json(payload, CHART_SCHEMA)["values"]).alias("o"))
    o = o.select(*keys, seq, F.timestamp_seconds("o.x").alias("when"), F.col("o.y").alias("value"))
    return align.interpolate_days(clean_series(o, keys, "when", "value", seq), keys, "obs_date", "value", limit)


def number_or_struct(payload: str, path: str, member: str) -> Column:
    """A JSON field that is either a number or an object holding it."""
    inner = F.get_json_object(payload, f"$.{path}.{member}").try_cast("double")
    return F.coalesce(inner, F.get_json_object(payload, f"$.{path}").try_cast("double"))


def read_macro_json(spark: SparkSession, path: str) -> DataFrame:
    """Directories `series=<id>/*.json` of whole-response files."""
    pages = spark.read.option("wholetext", True).option("basePath", path).text(path)
    pages = pages.select(F.col("series").cast("string").alias("series_id"), "value", F.input_file_name().alias("seq"))
    return parse_macro_json(pages, ["series_id"], "value", "seq")


def read_two_column_csv(spark: SparkSession, path: str, series_id: str, min_rows: int = 0) -> DataFrame | None:
    """Optional user file: NULL (None) when absent, ValueError when too short."""
    if "://" not in path and not os.path.exists(path):
        return None
    raw = spark.read.csv(path, header=True, nullValue=".")
    if len(raw.columns) < 2:
        raise ValueError(f"{path}: expected a date and a value column")
    a, b = raw.columns[:2]
    rows = raw.select(F.lit(series_id).alias("series_id"), F.col(a).alias("date"), F.col(b).alias("v"), F.monotonically_increasing_id().alias("seq"))
    out = clean_series(rows, ["series_id"], "date", "v", "seq")
    if min_rows and out.limit(min_rows).count() < min_rows:
        raise ValueError(f"{path}: fewer than {min_rows} observations")
    return out


def index_columns(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Case-insensitive lookup of the date (`month` or `date`) and value columns."""
    names = {c.strip().lower(): c for c in df.columns}
    day = names.get("month") or names.get("date")
    if day is None or value not in names:
        raise ValueError("date or value column not found")
    return df.select(*keys, F.to_date(F.col(f"`{day}`")).alias("obs_date"), C.finite(F.col(f"`{names[value]}`").try_cast("double")).alias("value"))


def first_release(df: DataFrame) -> DataFrame:
    """Earliest release of every observation, with its release date."""
    rows = df.filter(F.col("value").isNotNull())
    return align.keep_first(rows, ["series_id", "obs_date"], ["release_date", "value"], ["release_date", "value"])


def prices_wide(df: DataFrame, day: str, ticker: str, close: str, names: dict[str, str], min_rows: int = 100) -> DataFrame:
    """Tickers renamed to short keys and pivoted in fixed order; absent ones and those with too few rows are NULL columns."""
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    keyed = df.filter(F.col(day).isNotNull()).select(F.col(day).alias("d"), F.col(ticker).alias("t"), F.col(close).alias("close"))
    n = keyed.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    keyed = keyed.join(n, "t").select("d", F.when(F.col("n") >= min_rows, mapping[F.col("t")]).alias("key"), "close")
    wide = keyed.groupBy("d").pivot("key", list(names.values())).agg(F.max("close"))
    return wide.select("d", *names.values())


def with_min_rows(df: DataFrame, keys, need: Column | int) -> DataFrame:
    """Only series with enough rows (counts come from a window on the series key)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(F.col("_n") >= need).drop("_n")


def net_position(df: DataFrame, keys=("entity",), day: str = "week", min_rows: int = 100) -> DataFrame:
    """(long - short) / open interest in percent, dated by its estimated release."""
    from ..operators import calendar as K

    net = df.withColumn("value", C.ratio((F.col("long") - F.col("short")), "oi") * 100.0).filter(F.col("value").isNotNull())
    return align.available(with_min_rows(net, keys, min_rows), list(keys), day, K.report_release(F.col(day)), "value")


def source_fallback(df: DataFrame, metric: str = "metric", priority: str = "priority") -> DataFrame:
    """The best provider of each metric as a whole, never a mixture of providers."""
    best = F.min(priority).over(Window.partitionBy(metric))
    return df.withColumn("_best", best).filter(F.col(priority) == F.col("_best")).drop("_best")


def append_log(old: DataFrame, new: DataFrame, key, seq: str, cols) -> DataFrame:
    """Append a snapshot, keeping the last entry per key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return align.keep_last(both, key, ["_new", seq], cols)


def write_log(df: DataFrame, path: str) -> None:
    """Write to a fresh path: readers of the old log are never disturbed."""
    df.write.mode("errorifexists").option("header", True).csv(path)
