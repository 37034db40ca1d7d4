"""Merging correlated indicators into factors, without looking at any outcome."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def merge_groups(corr: np.ndarray, thr: float) -> list[list[int]]:
    """Average-linkage agglomeration on |correlation|, stopping below thr.

    Cluster similarities are updated as size-weighted means of the two merged
    rows, which equals the mean over all member pairs.
    """
    n = len(corr)
    sim = np.array(corr, float)
    np.fill_diagonal(sim, -np.inf)
    members = {i: [i] for i in range(n)}
    while len(members) > 1:
        i, j = np.unravel_index(int(np.argmax(sim)), sim.shape)
        if sim[i, j] < thr:
            break
        i, j = min(i, j), max(i, j)
        a, b = len(members[i]), len(members[j])
        merged = (a * sim[i] + b * sim[j]) / (a + b)
        sim[i], sim[:, i] = merged, merged
        sim[j], sim[:, j] = -np.inf, -np.inf
        sim[i, i] = -np.inf
        members[i] += members.pop(j)
    return sorted((sorted(m) for m in members.values()), key=lambda m: m[0])


def factor_table(pairs: DataFrame, features, thr: float | str, keys=("entity",)) -> DataFrame:
    """One p x p solve per key on the aggregated correlation matrix -> (keys, feature, factor, sign, lead).

    The matrix is the size of the catalogue, not of the data. `thr` is a number
    or the name of a key column holding it.
    """
    names = list(features)
    order = {f: i for i, f in enumerate(names)}
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", feature string, factor string, sign double, lead string"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = np.eye(len(names))
        for a, b, r in zip(pdf["feature_a"], pdf["feature_b"], pdf["rho"]):
            rho[order[a], order[b]] = rho[order[b], order[a]] = 0.0 if pd.isna(r) else r
        rows = []
        level = float(pdf[thr].iloc[0]) if isinstance(thr, str) else thr
        for g in merge_groups(np.abs(rho), level):
            lead = g[int(np.argmax(np.abs(rho)[np.ix_(g, g)].sum(axis=1)))]
            name = names[g[0]] if len(g) == 1 else "fac_" + "+".join(names[i] for i in g)
            rows += [(names[i], name, -1.0 if i != lead and rho[i, lead] < 0 else 1.0, names[lead]) for i in g]
        out = pd.DataFrame(rows, columns=["feature", "factor", "sign", "lead"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return pairs.groupBy(*keys).applyInPandas(solve, schema)


def factor_scores(long: DataFrame, table: DataFrame, learn: Column, keys=("entity",), carry=("month",)) -> DataFrame:
    """Mean of sign-aligned z-scores (learn mean and deviation, clipped at +-4); single members keep their values.

    `table` may hold several structures side by side, told apart by the extra `keys`.
    """
    w = Window.partitionBy("entity", "feature")
    xl = F.when(learn, F.col("x"))
    sd = F.stddev_samp(xl).over(w)
    sd = F.when(sd > 0, sd).otherwise(1.0)
    z = C.clip((F.col("x") - F.avg(xl).over(w)) / sd, -4.0, 4.0)
    j = long.withColumn("z", z).join(table, ["entity", "feature"])
    v = F.when(F.col("factor") == F.col("feature"), F.col("x")).otherwise(F.col("sign") * F.col("z"))
    return j.groupBy(*keys, "pos", *carry, "factor").agg(F.avg(v).alias("x"))


def merged_pair_overlap(table: DataFrame, key: str = "entity", half: str = "half") -> DataFrame:
    """Jaccard overlap of merged pairs between the two halves (pairs per factor are bounded by the catalogue)."""
    members = table.groupBy(key, half, "factor").agg(F.array_sort(F.collect_list("feature")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.concat_ws("|", a, b))))
    g = members.select(key, half, F.explode_outer(pairs).alias("pair"))
    side = lambda h: F.array_compact(F.collect_set(F.when(F.col(half) == h, F.col("pair"))))
    out = g.groupBy(key).agg(side(0).alias("a"), side(1).alias("b"))
    both, any_ = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return out.select(key, both.alias("shared"), any_.alias("total"), F.try_divide(both.cast("double"), any_).alias("jaccard"))
