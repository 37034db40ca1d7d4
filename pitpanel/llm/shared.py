"""Helpers of this subpackage: shared storage, hashed words and fixed-size vectors summed over all tasks."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# splitmix64: fixed values
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)

CHUNK = 4096


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on one machine (tests) a folder of its own where the setting is absent."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared folder; Spark removes the files when the frame is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def plain(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (`text` with null as empty); whatever else the input carries cannot clash."""
    return docs.select(*[F.coalesce(docs[n], F.lit("")).alias(n) if n in ("text", "html") else docs[n].alias(n) for n in names])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def packed(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's vector as rows of compressed pieces; pieces of zeros are left out."""
    parts = [(i // CHUNK, vector[i : i + CHUNK]) for i in range(0, len(vector), CHUNK)]
    parts = [(i, p) for i, p in parts if p.any()]
    yield record(chunk=pa.array([i for i, _ in parts], pa.int32()), data=pa.array([zlib.compress(p.tobytes(), 1) for _, p in parts], pa.binary()))


PACKED = "chunk int, data binary"


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["data"])
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "data": [zlib.compress(total.tobytes(), 1)]})


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors of `size` int64 entries. `size` is a parameter, so what reaches the driver never grows with the data."""
    out = np.zeros(-(-size // CHUNK) * CHUNK, np.int64)
    for row in parts.groupBy("chunk").applyInPandas(_add, PACKED).collect():
        part = np.frombuffer(zlib.decompress(row["data"]), np.int64)
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return out[:size]


def flat(column: pa.Array, dtype) -> np.ndarray:
    """What the bytes of a binary column without nulls hold, end to end."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if data is not None and len(column) else np.zeros(0, dtype)


def runs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: row i holds the values up to `ends[i]` that no row before it holds."""
    offsets = np.concatenate([np.zeros(1, np.int32), (ends * values.itemsize).astype(np.int32)])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def possible(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of fixed size over hashes of a long column, or one of runs of ints: where a bit is unset, the value is certainly absent."""

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            values = batch.column(column)
            seen[slot(flat(values, np.int32) if pa.types.is_binary(values.type) else values.to_numpy(zero_copy_only=False), bits)] = True
        words = np.packbits(seen).view(np.int64) if seen.any() else np.zeros(0, np.int64)
        yield from packed(words)

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["data"]])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "data": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros((1 << bits) // 64, np.int64)
    for row in df.select(column).mapInArrow(fill, PACKED).groupBy("chunk").applyInPandas(union, PACKED).collect():
        part = np.frombuffer(zlib.decompress(row["data"]), np.int64)
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return np.unpackbits(out.view(np.uint8)).astype(bool)


def slot(values: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(values.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about `size` bytes of a column, so that long texts need no more memory than short ones."""
    for batch in batches:
        if batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(lengths, dtype=np.int64) // size
            starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                yield batch.slice(a, b - a)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written once as a table in the shared folder and read back: columns can be pruned, and a lost executor recomputes nothing before it."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of the undirected `edges` (u, v): the label is the smallest node of its component.

    Large-star and small-star steps alternate until nothing changes. The large-star step is an aggregate with
    map-side combining and a join that Spark may split at a hot node; after it a node's smaller neighbours are
    the minima of its neighbourhood, which the small-star step takes by a window.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # one shuffle by the larger node serves distinct and minimum; a node has few different ones left below it
        small = large.repartition("u").distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = cut(small)
        # every edge points at its smallest neighbour; the state is unchanged when the stars are flat
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
