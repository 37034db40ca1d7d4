"""Classifier scoring, and classifiers pooled over all entities."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def make_model(kind: str, n: int | None = None):
    """logistic (C = 0.3), forest (300 trees, depth 3, leaf 10) or boosting (100 trees, depth 2, rate 0.05, subsample 0.8)."""
    if kind == "logistic":
        reg = 1.0 / (0.3 * n) if n else 0.01  # summed loss with penalty 1/C expressed for a mean loss
        return LogisticRegression(featuresCol="z", labelCol="label", regParam=reg, elasticNetParam=0.0, maxIter=200)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="z", labelCol="label", numTrees=300, maxDepth=3, minInstancesPerNode=10, seed=0)
    return GBTClassifier(featuresCol="z", labelCol="label", maxIter=100, maxDepth=2, stepSize=0.05, subsamplingRate=0.8, seed=0)


def fit_pooled(train: DataFrame, features, kind: str = "logistic", n: int | None = None):
    """One model over the rows of all entities; the fit itself is distributed by MLlib."""
    labelled = train.filter(F.col("y").isNotNull()).withColumn("label", (F.col("y") > 0).cast("double"))
    if kind == "logistic" and n is None:
        n = labelled.count()
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="v"),
        StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True),
        make_model(kind, n),
    ]
    return Pipeline(stages=stages).fit(labelled)


def predict_pooled(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("v", "z", "rawPrediction", "probability", "prediction")


def known(rows: DataFrame, outcomes: DataFrame, keys=("entity", "pos"), y: str = "y") -> DataFrame:
    """Rows whose outcome is known (a semi-join, so rows never multiply)."""
    return rows.join(outcomes.filter(F.col(y).isNotNull()).select(*keys), list(keys), "left_semi")


def ml_verdict(p: Column, base: Column, margin: float) -> Column:
    d = p - base
    return F.when(d <= -margin, "Unfavorable").when(d >= margin, "Favorable").otherwise("Neutral")


def prob_metrics(df: DataFrame, keys, p: str = "p", base: str = "base", y: str = "y") -> DataFrame:
    """AUC, Brier, Brier skill, log loss, accuracy, naive accuracy and rank correlation per key; y is the outcome."""
    d = df.filter(F.col(y).isNotNull()).withColumn("_l", (F.col(y) > 0).cast("double"))
    d = d.withColumns(
        {"_p": C.clip(p, 0.01, 0.99), "_b": C.clip(base, 0.01, 0.99), "_rp": C.avg_rank(p, *keys), "_ry": C.avg_rank(y, *keys)}
    )
    n1 = F.sum("_l")
    n0 = F.count(F.lit(1)) - n1
    lab, pc, bc = F.col("_l"), F.col("_p"), F.col("_b")
    brier, brier_b = F.avg((pc - lab) * (pc - lab)), F.avg((bc - lab) * (bc - lab))
    share = F.avg(lab)
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(F.when(lab == 1, F.col("_rp"))) - n1 * (n1 + 1) / 2.0, n1 * n0).alias("auc"),
        brier.alias("brier"),
        (1.0 - F.try_divide(brier, brier_b)).alias("skill"),
        F.avg(-(lab * F.ln(pc) + (1.0 - lab) * F.ln(1.0 - pc))).alias("log_loss"),
        F.avg(((F.col(p) > 0.5) == (lab == 1)).cast("double")).alias("accuracy"),
        F.greatest(share, 1.0 - share).alias("naive"),
        C.pearson("_rp", "_ry").alias("ic"),
    )


def calibration(df: DataFrame, keys, bins: int = 5, p: str = "p", y: str = "y") -> DataFrame:
    """Mean probability and share positive per quantile bin; equal edges are merged, bins are closed on the right."""
    d = df.filter(F.col(y).isNotNull())
    qs = [i / bins for i in range(bins + 1)]
    edges = F.array_sort(F.array_distinct(F.percentile(p, qs).over(Window.partitionBy(*keys))))
    d = d.withColumn("_e", edges)
    above = F.size(F.filter("_e", lambda e: e < F.col(p)))
    d = d.withColumn("bin", F.greatest(above, F.lit(1)).cast("int"))
    return d.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("p_mean"), F.avg((F.col(y) > 0).cast("double")).alias("share")
    )
