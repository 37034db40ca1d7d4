"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. A window is a run of sequences; each window
adds every queue's quantum, its target share of a window, to the queue's deficit, and serves the whole tokens
of it. The rest is carried into the next window, so after any number of windows each queue has had its target share
to within one token. Targets are given, or follow from the queues' sizes to the power `temper`: 1 mirrors the corpus,
less gives small sources a larger part while they last. When a queue is
exhausted, windows are shorter and the others go on in their own proportions; queues without a target follow
when those with one are through.

Because a queue's service is a closed form of the window's number, whatever the number of queues and however they end,
a document's place follows from its token offset in its queue. Offsets are sums
inside the task that tokenises, plus the sums of earlier tasks: the
deficits cross windows and partitions without any task seeing another's tokens.

The tokenised table is written once to the shared folder, so a lost executor
never changes an order that is already in use.

Defined results: null text is empty and holds only the end token; a null source
is a queue of its own; sources beyond the `OWN_QUEUES` with most documents (those with a target are always queues of their own)
share queues by hash, without changing a document's pieces; null ids stay null; repeated rows are separate documents;
an empty table gives no rows; other columns are ignored. Only the very last
sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import portions, record, table
from .token_counts import PreTokens, worker_table
from .words import bytes_of

SEQUENCE = 2048
#: Parameters: sequences of a window; the end token's id; sources with queues of their own, and queues of all others.
WINDOW_SEQUENCES = 64
END_ID = 1
OWN_QUEUES = 2048
HASHED_QUEUES = 1024
#: Quanta are whole multiples of a token's 65536th part.
FRACTION = 16

TOKENS = "doc_id long, queue string, part int, local long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


class Schedule:
    """Service of each queue after any number of windows, in whole numbers.

    Queues with a target, and then those without, are served from windows of their own; after k of them a queue of
    quantum q (in parts of a token) has had floor(k * q), or all it holds.
    """

    def __init__(self, sizes: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW_SEQUENCES * SEQUENCE, temper: float = 1.0):
        names = sorted(q for q in sizes if sizes[q])
        first = [q for q in names if (targets or {}).get(q, 0) > 0]
        self.rounds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # first token; quantum, size and windows of each queue
        self.place: dict[str, tuple[int, int]] = {}
        at = 0
        for queues in (first, [q for q in names if q not in set(first)]):
            size = np.array([sizes[q] for q in queues], np.int64)
            weight = np.array([targets[q] for q in queues], float) if queues is first else size.astype(float) ** temper
            quantum = np.maximum(1, np.rint(weight / weight.sum() * (window << FRACTION))).astype(np.int64) if len(queues) else size
            last = np.array([-(-(int(n) << FRACTION) // int(q)) for n, q in zip(size, quantum, strict=True)], np.int64)
            self.place.update({q: (len(self.rounds), i) for i, q in enumerate(queues)})
            self.rounds.append((at, quantum, size, last))
            at += int(size.sum())
        self.total, self._windows = at, {}

    def _served(self, number: int, k: int) -> np.ndarray:
        """What each queue has had after k windows."""
        _, quantum, size, last = self.rounds[number]
        return np.minimum(np.minimum(k, last) * quantum >> FRACTION, size)

    def _window(self, number: int, k: int) -> tuple[list[int], list[int], list[int]]:
        """What each queue has had before window k and after it, and where its tokens begin there."""
        if (number, k) not in self._windows:
            if len(self._windows) > 256:
                self._windows.clear()
            had, will = self._served(number, k), self._served(number, k + 1)
            begin = self.rounds[number][0] + int(had.sum()) + np.cumsum(will - had) - (will - had)
            self._windows[number, k] = had.tolist(), will.tolist(), begin.tolist()
        return self._windows[number, k]

    def place_of(self, queue: str, offset: int) -> tuple[int, int]:
        """Global position of a queue's token, and how many tokens of the queue follow in place there."""
        number, i = self.place[queue]
        # the last window before which the queue has had no more than offset
        k = (((offset + 1) << FRACTION) - 1) // int(self.rounds[number][1][i])
        had, will, begin = self._window(number, k)
        return begin[i] + offset - had[i], will[i] - offset


def id_type(path: str, end_id: int) -> str:
    """The narrowest of 16 and 32 bits that holds every id; the tables keep ids so."""
    return "<u2" if max(PreTokens(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID, kind: str = "<u4") -> DataFrame:
    """Token ids of every document (little-endian, of `kind`), with the offset in its task's part of its queue."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = worker_table(path, ids=True), {}
        last, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        for batch in portions(batches, size=1_500_000):
            flat, marks = known.ids_of(*bytes_of(batch.column("text")))
            flat = flat.astype(kind)
            ids = [flat[a:b].tobytes() + last for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]
            local = []
            for q, x in zip(batch.column("queue").to_pylist(), ids, strict=True):
                local.append(at.get(q, 0))
                at[q] = local[-1] + len(x) // width
            yield record(doc_id=batch.column("doc_id"), queue=batch.column("queue"), part=batch.column("part"), local=local, n=[len(x) // width for x in ids], ids=ids)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "queue")
    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(encode, TOKENS)


def queued(docs: DataFrame, targets: Iterable[str] = ()) -> DataFrame:
    """doc_id, text and queue: the source of the targets and of the sources with most documents, a hash of all others."""
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit(None).cast("string"))
    rows = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("name"))
    named = docs.sparkSession.createDataFrame([(f"={t}",) for t in targets], "own string")
    most = rows.groupBy("name").count().orderBy(F.desc("count"), "name").limit(OWN_QUEUES).select(F.col("name").alias("own"))
    # OWN_QUEUES names and those of the targets at most
    marked = rows.join(F.broadcast(most.union(named).distinct()), F.col("name") == F.col("own"), "left")
    return marked.select("doc_id", "text", F.coalesce("own", F.concat(F.lit("#"), F.pmod(F.xxhash64("name"), F.lit(HASHED_QUEUES)))).alias("queue"))


def pack(docs: DataFrame, path: str, targets: dict[str, float] | None = None, window: int = WINDOW_SEQUENCES, sequence: int = SEQUENCE, end_id: int = END_ID, temper: float = 1.0) -> DataFrame:
    """One row per piece of a document: where it starts, its length and checksum, and its place in a sequence.

    `targets` maps sources to token proportions; without it each window follows the sizes of the sources, tempered.
    """
    spark = docs.sparkSession
    kind = id_type(path, end_id)
    tokens = table(tokenise(queued(docs, targets or ()), path, end_id, kind), "tokens")
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("m"))
    sizes = {r["queue"]: r["m"] for r in parts.groupBy("queue").agg(F.sum("m").alias("m")).collect()}
    before = F.sum("m").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a table, whose size Spark knows: while it is small, the ids need no shuffle to meet it
    base = table(parts.select("queue", "part", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    schedule = Schedule(sizes, {f"={k}": v for k, v in targets.items()} if targets else None, window * sequence, temper)
    given = spark.sparkContext.broadcast(schedule)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = given.value
        for batch in portions(batches, "ids"):
            of, rows = [], []
            for i, (q, first, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("queue", "first", "n", "ids")), strict=True)):
                done, wide = 0, np.frombuffer(ids, kind).astype("<u4")
                while done < n:
                    spot, room = plan.place_of(q, first + done)
                    room = min(room, n - done)
                    while room:
                        size = min(room, sequence - spot % sequence)
                        of.append(i)
                        rows.append((done, size, zlib.crc32(wide[done : done + size]), n, spot // sequence, spot % sequence))
                        done, spot, room = done + size, spot + size, room - size
            c = np.array(rows, np.int64).T
            yield record(doc_id=batch.column("doc_id").take(pa.array(of)), start=c[0], length=c[1], ids_crc32=c[2], doc_tokens=c[3], sequence_id=c[4], offset=c[5], queue=batch.column("queue").take(pa.array(of)))

    placed = tokens.join(base, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("local")).alias("first"), "n", "ids")
    return placed.mapInArrow(place, PIECES)
