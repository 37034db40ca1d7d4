"""Embedding whitening on MLlib's BlockMatrix.

Entries c become whole numbers floor(256 * c). The fit list holds each distinct whole-number
vector once. Its rows, centred by the exact column sums, are indexed into distributed
blocks; transpose times matrix is the scatter matrix, whose eigenvectors are found
locally (its size is the dimension, whatever the number of rows). A second product, of the blocks of all
rows with the whitening matrix, projects them.

The middle dimension of the scatter product is split, so that no task multiplies more than a few
blocks; sums and deviations are whole numbers and exact.

Defined results: rows whose vector is null or holds a null, a NaN or an infinity are left out, and so are
vectors of another length than the most frequent one (of equally frequent lengths
the longer counts); a null vec_id stays null; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored. Products with 256 beyond a long become its limits. A
component without variance has no whitened values (null), nor, where no vector differs from another, an explained share.
A deviation beyond a long is null; `deviation_wide` (38 digits) holds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import record, table

#: Parameters: grid steps per unit, components returned, entries of a block and its columns, blocks that one
#: task of the scatter product multiplies, and its tasks at most.
STEPS = 256
COMPONENTS = 4
BLOCK_ENTRIES = 1 << 17
BLOCK_COLUMNS = 1024
BLOCKS_PER_SPLIT = 8
MAX_SPLITS = 512

#: A component counts as without variance below this share of the largest one.
FLAT = 1e-12

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"


def matrix_of(column: pa.Array, rows: int) -> np.ndarray:
    """The entries of a list column without nulls, all lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows with whole vectors of the most frequent length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column("v")
            flat = vector.flatten()
            length = vector.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)), dtype=np.int64)])
            end = np.cumsum(length)
            good = (length > 0) & (bad[end] == bad[end - length])
            yield batch.filter(pa.array(good))

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = rows.filter("v is not null").mapInArrow(run, "vec_id long, v array<double>")
    length = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.filter(F.size("v") == F.lit(length["d"] if length else 0))


def on_grid(rows: DataFrame) -> DataFrame:
    """vec_id and the whole-number vector x."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = np.floor(matrix_of(batch.column("v"), batch.num_rows) * STEPS)
            x = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.where(scaled < -(2.0**63), np.iinfo(np.int64).min, np.clip(scaled, -(2.0**63), 2.0**62 * 1.99).astype(np.int64)))
            yield record(vec_id=batch.column("vec_id"), x=pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), max(x.shape[1], 1)).cast(pa.list_(pa.int64())))

    return rows.mapInArrow(run, "vec_id long, x array<long>")


def indexed(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder, its rows numbered without gaps from 0 in `at`."""
    kept = table(df.withColumn("_id", F.monotonically_increasing_id()), name)
    kept = kept.withColumn("_part", F.shiftright("_id", 33))
    # one row for each partition that wrote
    parts = kept.groupBy(F.col("_part").alias("_of")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = parts.select("_of", before.alias("_first"))
    joined = kept.join(F.broadcast(first), F.col("_part") == F.col("_of"))
    return joined.withColumn("at", F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_of", "_first")


def times(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left * right; `splits` parts of the middle dimension are multiplied in tasks of their own and then added."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


@dataclass
class Fit:
    """What the fit list says: its size, column sums, eigenvalues in falling order and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def whitener(self, k: int) -> np.ndarray:
        """Projects centred rows on the first k components, to unit variance; zeros where there is no variance."""
        e = self.values[:k]
        scale = np.where(self.varies(k), 1 / np.sqrt(np.where(e > 0, e, 1)), 0.0)
        return self.vectors[:, :k] * scale

    def varies(self, k: int) -> np.ndarray:
        return self.values[:k] > FLAT * max(self.values[0], 0.0)


def blocks(rows: DataFrame, mean: list[float]) -> BlockMatrix:
    """The centred rows as distributed blocks, by their number `at`."""
    height = max(1, BLOCK_ENTRIES // min(len(mean), BLOCK_COLUMNS))
    centred = F.zip_with("x", F.array(*map(F.lit, mean)), lambda a, m: a.cast("double") - m)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("at").alias("index"), array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors).toBlockMatrix(height, min(len(mean), BLOCK_COLUMNS))


def gram(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, of the size of the columns."""
    splits = min(MAX_SPLITS, max(1, -(-matrix.numRowBlocks // BLOCKS_PER_SPLIT)))
    return times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def fit(listed: DataFrame) -> tuple[Fit, BlockMatrix]:
    """Sums, covariance and its eigenvectors over the numbered vectors, and their blocks."""
    found = listed.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()
    found.sort(key=lambda r: r["i"])
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    matrix = blocks(listed, [s / n for s in sums])
    values, vectors = np.linalg.eigh(gram(matrix) / n)
    return Fit(n, sums, values[::-1], vectors[:, ::-1]), matrix


def as_blocks(spark: SparkSession, local: np.ndarray) -> BlockMatrix:
    parts = [((i // BLOCK_COLUMNS, 0), DenseMatrix(len(p), p.shape[1], p.ravel(order="F").tolist())) for i in range(0, len(local), BLOCK_COLUMNS) for p in [local[i : i + BLOCK_COLUMNS]]]
    return BlockMatrix(spark.sparkContext.parallelize(parts, len(parts)), min(len(local), BLOCK_COLUMNS), local.shape[1], *local.shape)


def rows_of(spark: SparkSession, matrix: BlockMatrix) -> DataFrame:
    """(at, z) of a matrix with one column of blocks."""
    height = matrix.rowsPerBlock

    def run(block):
        (i, _), part = block
        return [(i * height + k, z) for k, z in enumerate(part.toArray().tolist())]

    return spark.createDataFrame(matrix.blocks.flatMap(run), "row long, z array<double>")


def deviations(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """vec_id, at and the exact sum over the dimensions of (n*x - S)^2."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(map(abs, sums))
        for batch in batches:
            x = matrix_of(batch.column("x"), batch.num_rows)
            most = n * max(abs(int(x.max())), abs(int(x.min()))) + wide if x.size else 0
            if most * most * max(len(sums), 1) < 1 << 63:
                off = n * x - np.array(sums, np.int64)
                exact = pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                off = n * x.astype(object) - np.array(sums, object)
                exact = pa.array([int(v) if v < 10**38 else None for v in (off * off).sum(axis=1)], pa.decimal128(38, 0))
            yield record(vec_id=batch.column("vec_id"), at=batch.column("at"), wide=exact)

    return rows.mapInArrow(run, "vec_id long, at long, wide decimal(38,0)")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: deviation, whitened value, explained share and the error of the whole."""
    spark = embeddings.sparkSession
    rows = indexed(on_grid(usable(embeddings)), "vectors")
    listed = indexed(rows.select("x").distinct(), "fit-list")
    if listed.isEmpty():
        return spark.createDataFrame([], RESULT)
    found, matrix = fit(listed)
    k = min(components, len(found.sums))
    whitener, varies, trace = as_blocks(spark, found.whitener(k)), found.varies(k), float(found.values.sum())
    off = np.abs(gram(times(matrix, whitener)) / found.n - np.eye(k))[np.ix_(varies, varies)]
    error = float(off.max()) if off.size else 0.0
    shares = [float(e) / trace if trace > 0 else None for e in found.values[:k]]
    projected = rows_of(spark, times(blocks(rows, found.mean), whitener))
    joined = deviations(rows, found.n, found.sums).join(projected, F.col("at") == F.col("row"))
    each = joined.select("vec_id", "wide", F.posexplode("z").alias("c", "w"))
    return each.select(
        "vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), F.col("wide").try_cast("long").alias("deviation"),
        F.when(F.array(*[F.lit(bool(v)) for v in varies])[F.col("c")], F.col("w")).alias("whitened"), F.array(*[F.lit(s).cast("double") for s in shares])[F.col("c")].alias("explained"),
        F.lit(error).alias("identity_error"), F.col("wide").alias("deviation_wide"),
    )
