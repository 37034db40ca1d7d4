"""Panels that are computed once and read many times.

Raw rows are by far the largest input, while the panel built from them holds
one row per entity and period. `materialise` cuts the lineage after such a
reduction with a reliable checkpoint in the cluster's shared folder, so losing
an executor never re-reads the raw tables and one session scans them once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple, DataFrame] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir of the session; only on one machine (tests) make a folder where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pitpanel-"))


def version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Modification time of a table's root, and files and bytes below it: a table that is rewritten, also in a partition alone, is read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    below = files.getContentSummary(p)
    return files.getFileStatus(p).getModificationTime(), below.getFileCount(), below.getLength()


def materialise(spark: SparkSession, sf_dir: str, name: str, tables, build: Callable[[], DataFrame]) -> DataFrame:
    """The checkpointed result of `build`, shared by every query of the session over the same input files."""
    stamp = tuple(version(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    key = (spark.sparkContext.applicationId, sf_dir, name, stamp)
    if key not in _kept:
        ensure_checkpoint_dir(spark)
        _kept[key] = build().checkpoint()
    return _kept[key]


def clear() -> None:
    _kept.clear()
