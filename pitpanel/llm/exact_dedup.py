"""Exact deduplication with Patricia tries as owners of byte strings.

Texts go to the partition of their length and content hash. There a compressed
radix trie takes the full byte strings; the terminal node of a string is its
owner and stores the identifier that stays and the number of copies. Equality
is therefore decided byte by byte, never by a hash.

Copies are merged in each map task first (by a trie too), so a text that makes
up a third of all rows reaches its partition once per task. A trie that outgrows
its memory writes its largest subtrees to a task-local scratch file, sends later
strings of that subtree there as well, and finishes each subtree on its own.
The documents then look up their owner by length and SHA-256 in an ordinary join,
whose skewed side Spark splits.

Defined results: null text counts as empty, and empty texts are equal; null ids
never stay if an equal text has an id (without any, keep_id is null and the rows
stay); rows that repeat both id and text are one document and are marked alike; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import plain, portions, record

#: Parameter: bytes of text a task's trie may hold before it spills.
TRIE_BYTES = 96 << 20

OWNED = "len int, hash long, sha binary, text binary, best long, copies long"


def common(a: bytes, b: bytes, i: int, j: int, most: int) -> int:
    """Length, at most `most`, of the common prefix of a[i:] and b[j:]."""
    most = min(len(a) - i, len(b) - j, most)
    if a[i : i + most] == b[j : j + most]:
        return most
    low, step = 0, 64
    while low + step < most and a[i + low : i + low + step] == b[j + low : j + low + step]:
        low, step = low + step, 2 * step
    high = min(most, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    """An edge label is string[start:end] of a string stored below, so no bytes are copied."""

    __slots__ = ("children", "end", "entry", "size", "spilled", "start", "string")

    def __init__(self, string: bytes, start: int, end: int):
        self.string, self.start, self.end = string, start, end
        self.children: dict[int, Node] = {}
        self.entry: list | None = None  # [best, copies, tag] of the string that ends here
        self.size, self.spilled = 0, None


class Patricia:
    """Byte strings with the identifier that stays (`better`), the number of copies, and a tag of the first one."""

    def __init__(self, budget: int = TRIE_BYTES, better=max):
        self.root, self.budget, self.better, self.held, self.count = Node(b"", 0, 0), budget, better, 0, 0

    def add(self, string: bytes, best: int | None, copies: int, tag=None) -> None:
        node, at, path = self.root, 0, []
        while True:
            path.append(node)
            if node.spilled is not None:
                pickle.dump((string, best, copies, tag), node.spilled)
                return
            if at == len(string):
                break
            child = node.children.get(string[at])
            if child is None:
                child = node.children[string[at]] = Node(string, at, len(string))
                path.append(child)
                node = child
                break
            shared = common(string, child.string, at, child.start, child.end - child.start)
            if shared < child.end - child.start:
                middle = Node(child.string, child.start, child.start + shared)
                middle.size = child.size
                child.start += shared
                middle.children[child.string[child.start]] = child
                node.children[string[at]] = middle
                child = middle
            at += shared
            node = child
        if node.entry is not None:
            self._merge(node.entry, best, copies)
            return
        node.entry = [best, copies, tag, string]
        for n in path:
            n.size += len(string) + 200
        self.held += len(string) + 200
        self.count += 1
        if self.held > self.budget and self.count > 1:
            self._spill()

    def _merge(self, entry: list, best: int | None, copies: int) -> None:
        entry[0] = best if entry[0] is None else entry[0] if best is None else self.better(entry[0], best)
        entry[1] += copies

    def _spill(self) -> None:
        """Write the largest subtrees to scratch files until half of the budget is free."""
        while self.held > self.budget // 2:
            node, path = self.root, [self.root]
            while node.children:
                largest = max(node.children.values(), key=lambda n: n.size)
                if not largest.size or (node.size < self.held and largest.size < self.held // 4):
                    break
                node = largest
                path.append(node)
            if node.size in (0, self.held):  # never all there is: a subtree's own trie must be smaller
                return
            node.spilled = tempfile.TemporaryFile()  # noqa: SIM115 - closed, and so removed, by entries()
            for string, best, copies, tag in self._walk(node):
                pickle.dump((string, best, copies, tag), node.spilled)
            for below in self._spilled(node):
                if below is not node:
                    below.spilled.seek(0)
                    shutil.copyfileobj(below.spilled, node.spilled)
                    below.spilled.close()
            freed = node.size
            node.children, node.entry = {}, None
            for n in path:
                n.size -= freed
            self.held -= freed

    @staticmethod
    def _walk(top: Node) -> Iterator[tuple]:
        stack = [top]
        while stack:
            node = stack.pop()
            if node.entry is not None:
                best, copies, tag, string = node.entry
                yield string, best, copies, tag
            stack.extend(n for n in node.children.values() if n.spilled is None)

    def entries(self) -> Iterator[tuple]:
        """(string, best, copies, tag) of each distinct string; spilled subtrees follow, one after another."""
        yield from self._walk(self.root)
        for node in self._spilled(self.root):
            below = Patricia(self.budget, self.better)
            node.spilled.seek(0)
            while True:
                try:
                    below.add(*pickle.load(node.spilled))
                except EOFError:
                    break
            node.spilled.close()
            yield from below.entries()

    @staticmethod
    def _spilled(top: Node) -> Iterator[Node]:
        stack = [top]
        while stack:
            node = stack.pop()
            stack.extend(node.children.values())
            if node.spilled is not None:
                yield node


def owners(rows: DataFrame, partial: bool, budget: int = TRIE_BYTES) -> DataFrame:
    """Merge equal byte strings of each partition. `partial`: the rows are a map task's, and merging may stop at the budget."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(trie: Patricia) -> Iterator[pa.RecordBatch]:
            block, size = [], 0
            for item in trie.entries():
                block.append(item)
                size += len(item[0])
                if size > 8 << 20:
                    yield flat(block)
                    block, size = [], 0
            if block:
                yield flat(block)

        def flat(block: list) -> pa.RecordBatch:
            return record(
                len=pa.array([len(x[0]) for x in block], pa.int32()), hash=pa.array([x[3][0] for x in block], pa.int64()), sha=pa.array([x[3][1] for x in block], pa.binary()),
                text=pa.array([x[0] if partial else None for x in block], pa.binary()), best=pa.array([x[1] for x in block], pa.int64()), copies=pa.array([x[2] for x in block], pa.int64()),
            )

        trie = Patricia(budget)
        for batch in portions(batches):
            for text, best, copies, h, sha in zip(*(batch.column(c).to_pylist() for c in ("text", "best", "copies", "hash", "sha")), strict=True):
                if partial and trie.held > budget // 2:
                    yield from out(trie)
                    trie = Patricia(budget)
                trie.add(text, best, copies, (h, sha))
        yield from out(trie)

    return rows.mapInArrow(run, OWNED)


def exact_dedup(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document; of equal texts the largest doc_id stays."""
    rows = plain(docs, "doc_id", "text")
    data = F.col("text").cast("binary")
    sha = F.unhex(F.sha2(data, 256))
    keyed = rows.select(data.alias("text"), F.col("doc_id").alias("best"), F.lit(1).cast("long").alias("copies"), F.xxhash64(data).alias("hash"), sha.alias("sha"))
    local = owners(keyed, True, budget)
    groups = owners(local.repartition("len", "hash"), False, budget).select(F.col("len").alias("g_len"), F.col("sha").alias("g_sha"), F.col("best").alias("keep_id"), F.col("copies").alias("group_size"))
    asked = rows.select("doc_id", F.octet_length(data).alias("len"), sha.alias("sha"))
    joined = asked.join(groups, (F.col("len") == F.col("g_len")) & (F.col("sha") == F.col("g_sha")))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
