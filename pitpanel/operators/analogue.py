"""Nearest past environments.

The latest row is compared with each earlier one once. The walk-forward search keeps a key's rows in blocks of
neighbouring positions, each with the box of its vectors: a block is opened only while its box may hold a nearer row than the
picks so far, so a key needs memory for its rows and not for its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

CAND = "struct<d:double,pos:int,y:double>"


def vector(features) -> Column:
    return F.array(*[F.col(f) for f in features])


def distance(a: Column, b: Column, scale: Column) -> Column:
    """Euclidean distance with per-dimension scale (the means cancel)."""
    parts = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), scale, lambda d, s: (d / s) * (d / s))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v))


def analogues(df: DataFrame, features, h: int, k: int = 10, keys=("entity",), y: str = "y") -> DataFrame:
    """Descriptive search: the k rows nearest to each key's latest row, at least max(h, 3) rows apart.

    Returns one row per pick: place, pos, closeness, outcome.
    """
    w = Window.partitionBy(*keys)
    known = F.col(y).isNotNull()
    sd = [F.stddev_samp(F.when(known, F.col(f))).over(w) for f in features]
    now = F.max_by(vector(features), "pos").over(w)
    d = df.withColumn("_x", now).withColumn("_s", F.array(*[F.when(s > 0, s).otherwise(1.0) for s in sd]))
    d = d.filter(known).select(*keys, "pos", F.col(y).alias("y"), F.round(distance(vector(features), F.col("_x"), F.col("_s")), 12).alias("d"))
    median = d.groupBy(*keys).agg(F.percentile("d", 0.5).alias("_m"))
    g = nearest(d, keys, k, max(h, 3)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", F.col("pos").cast("int").alias("pos"), "y"))).alias("_c"))
    g = g.withColumn("_p", A.greedy_gap(F.col("_c"), k, max(h, 3), CAND)).join(median, list(keys))
    g = g.select(*keys, "_m", F.posexplode("_p").alias("place", "p"))
    return g.select(
        *keys, (F.col("place") + 1).alias("place"), "p.pos", (100.0 * F.exp(-F.col("p.d") / F.col("_m"))).alias("closeness"), F.col("p.y").alias("after")
    )


def nearest(d: DataFrame, keys, k: int, gap: int) -> DataFrame:
    """Rows among which a greedy pick of k rows at least `gap` positions apart surely ends.

    Of rows at one position only the nearest can be picked. A pick then rules out 2 * gap - 1 positions
    at most, so the picks are among the k * (2 * gap - 1) nearest positions.
    """
    keys = list(keys)
    one = d.groupBy(*keys, "pos").agg(F.min(F.struct("d", "y")).alias("_n")).select(*keys, "pos", "_n.*")
    if not keys:  # a distributed top-n
        return one.orderBy("d", "pos").limit(k * (2 * gap - 1))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("d", "pos"))
    return one.withColumn("_place", place).filter(F.col("_place") <= k * (2 * gap - 1)).drop("_place")


#: Rows of a block of the walk-forward search.
BLOCK = 64


def greedy(d: np.ndarray, pos: np.ndarray, order: np.ndarray, k: int, gap: int) -> list[int]:
    """The first k of the ordered rows that are at least `gap` positions apart."""
    picks: list[int] = []
    for i in order.tolist():
        if all(abs(pos[i] - pos[j]) >= gap for j in picks):
            picks.append(i)
            if len(picks) == k:
                break
    return picks


def search(x: np.ndarray, pos: np.ndarray, y: np.ndarray, scale: np.ndarray, asks: np.ndarray, h: int, k: int, gap: int, block: int = BLOCK) -> list[list[int]]:
    """For every asked row the picks among the rows with an outcome at least h rows before it, nearest first.

    Rows are in order of position; `scale` holds the deviations that an asked row's database has. Blocks are opened in the order of
    the least distance that their boxes allow, until the k-th pick is nearer than any closed block can be.
    """
    known, starts = np.flatnonzero(~np.isnan(y)), np.arange(0, len(x), block)
    where = np.searchsorted(known, np.append(starts, len(x)))
    low, high = np.full((len(starts), x.shape[1]), np.inf), np.full((len(starts), x.shape[1]), -np.inf)
    for b in range(len(starts)):
        rows = known[where[b] : where[b + 1]]
        if len(rows):
            low[b], high[b] = x[rows].min(axis=0), x[rows].max(axis=0)
    out = []
    for i in asks.tolist():
        last = int(np.searchsorted(known, i - h, side="right"))  # rows of the database
        blocks = np.flatnonzero((where[:-1] < last) & (where[:-1] < where[1:]))
        away = np.maximum(np.maximum(low[blocks] - x[i], x[i] - high[blocks]), 0.0) / scale[i]
        least = np.sqrt((away * away).sum(axis=1))
        order = np.argsort(least, kind="stable")
        blocks, least = blocks[order], least[order]
        opened, picks, rows, d = 0, [], np.zeros(0, np.int64), np.zeros(0)
        while opened < len(blocks):
            more = blocks[opened : max(2, 2 * opened)]
            opened += len(more)
            new = np.concatenate([known[where[b] : min(where[b + 1], last)] for b in more])
            off = (x[new] - x[i]) / scale[i]
            rows, d = np.concatenate([rows, new]), np.concatenate([d, np.round(np.sqrt((off * off).sum(axis=1)), 12)])
            picks = greedy(d, pos[rows], np.lexsort((y[rows], pos[rows], d)), k, gap)
            if len(picks) == k and opened < len(blocks) and d[picks[-1]] < least[opened] - 1e-9:
                break
        out.append([int(rows[j]) for j in picks])
    return out


def walk_forward(df: DataFrame, features, h: int, cut: str = "c1", k: int = 10, keys=("entity",), y: str = "y", min_db: int = 36, carry=("month",)) -> DataFrame:
    """(keys, pos, carried columns, med, pos_share) of every row from `cut` on: the outcomes of the nearest rows whose outcome was known by then.

    The database of a row ends h rows back; its size and deviations, which scale the distance, are running aggregates.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("pos")
    past = w.rowsBetween(Window.unboundedPreceding, -h)
    known = F.col(y).isNotNull()
    sd = [F.stddev_samp(F.when(known, F.col(f))).over(past) for f in features]
    ask = (F.col("pos") >= F.col(cut)) & (F.count(F.when(known, 1)).over(past) >= min_db)
    rows = df.select(*keys, "pos", *carry, F.col(y).cast("double").alias("_y"), vector(features).alias("_x"), F.array(*[F.when(s > 0, s).otherwise(1.0) for s in sd]).alias("_s"), ask.alias("_ask"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, "pos", *carry)) + ", med double, pos_share double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        outcome, asks = pdf["_y"].to_numpy(float), np.flatnonzero(pdf["_ask"])
        picks = search(np.stack(pdf["_x"]), pdf["pos"].to_numpy(), outcome, np.stack(pdf["_s"]), asks, h, k, max(h, 3))
        after = [outcome[p] for p in picks]
        return pdf.loc[asks, [*keys, "pos", *carry]].assign(med=[float(np.median(a)) for a in after], pos_share=[float((a > 0).mean()) for a in after])

    return rows.groupBy(*keys).applyInPandas(run, schema)


def share_positive(arr: Column) -> Column:
    return A.array_mean(F.transform(arr, lambda v: (v > 0).cast("double")))


def verdict(med: Column, pos: Column) -> Column:
    return F.when((med > 0) & (pos >= 0.6), "Favorable").when((med <= 0) & (pos <= 0.4), "Unfavorable").otherwise("Neutral")


def paths(picks: DataFrame, panel: DataFrame, px: str, h: int, keys=("entity",)) -> DataFrame:
    """Percent path after each pick, rows 0..h; picks without a complete path are dropped."""
    w = Window.partitionBy(*keys).orderBy("pos")
    ahead = panel.select(*keys, "pos", F.collect_list(px).over(w.rowsBetween(0, h)).alias("_v")).filter(F.size("_v") == h + 1)
    j = picks.join(ahead, [*keys, "pos"])
    j = j.select(*keys, "place", F.posexplode("_v").alias("step", "v"), F.get("_v", F.lit(0)).alias("v0"))
    return j.select(*keys, "place", "step", ((F.col("v") / F.col("v0") - 1.0) * 100.0).alias("path"))
