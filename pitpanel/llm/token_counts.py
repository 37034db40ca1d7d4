"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

A pre-token is a run of bytes without white space, cut also between a letter or
digit and a comma or full stop. The tokenizer drops white space, joins nothing
across such a cut and lowers capitals (`PreTokens` checks this of the tokenizer; one of another
kind gets whole texts), so a text's tokens are those of its pre-tokens, one after another.

Tier one is a broadcast hash table, sorted 64-bit hashes and lengths, of the
pre-tokens that are most frequent in a bounded sample of documents; it only saves
work and decides no count. Tier two is a worker's own table of the same form, which
starts as tier one and takes up what the tokenizers library gives for misses. Its size is bounded;
when it is full, it starts again from tier one. Hashing, lookup and sums
are done for a batch of texts at once. A worker keeps its table from task to task.

Defined results: null text counts as empty, with 0 tokens; a null doc_id stays
null; repeated rows give repeated results; an empty table gives no rows; other
columns of the input are ignored. Special strings inside a text count as the
library counts them by default.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import plain, portions, record
from .words import WORDS, Tokens, bytes_of, span_hashes, tokens

#: Parameters: documents in the sample behind tier one, entries of tier one (12 bytes each), entries of a worker's table.
SAMPLE_DOCS = 2_000
TABLE_ENTRIES = 1 << 16
WORKER_ENTRIES = 500_000
LIMIT = 2048

RESULT = "doc_id long, n_bytes long, n_tokens long"

STOPS = WORDS.copy()
STOPS[list(b",.")] = 2
ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class PreTokens:
    """A worker's tokenizer, and how to cut texts where it does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        one = self._ids("ab")
        self.cuts = one and all(self._ids(f"ab{c}ab") == one * 2 for c in " \t\n\v\f\r") and not self._ids(" \t\n\v\f\r") and all(
            self._ids(f"ab{c}1") == one + self._ids(c) + self._ids("1") and self._ids(f"é{c}ab") == self._ids("é") + self._ids(c) + one for c in (",", ".", ",.", "..")
        )
        self.lowers = self.cuts and self._ids("ABCDEFGHIJKLMNOPQRSTUVWXYZ") == self._ids("abcdefghijklmnopqrstuvwxyz")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        """Pre-tokens of a batch of texts. Those with one hash have the same tokens."""
        if not self.cuts:
            full = np.flatnonzero(np.diff(offsets))
            return Tokens(span_hashes(data, offsets[full], offsets[full + 1]), offsets[full], offsets[full + 1], full)
        # special strings are told by case, so capitals are lowered only where there can be none
        hashed = LOWERED[data] if self.lowers and b"<|" not in data.tobytes() else data
        runs = tokens(hashed, offsets, STOPS)
        # a stop is cut from what precedes it only behind a letter or digit (ASCII, or two bytes from C3), and from what follows only before an ASCII one
        touch = np.flatnonzero((runs.start[1:] == runs.end[:-1]) & (runs.owner[1:] == runs.owner[:-1])) + 1
        at = runs.start[touch]
        before, stop = data[at - 1], STOPS[data[at]] == 2
        latin = (data[np.maximum(at - 2, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        joined = touch[~np.where(stop, ALNUM[before] | latin, ALNUM[data[at]])]
        if joined.size:
            keep = np.ones(len(runs.start), bool)
            keep[joined] = False
            start, owner = runs.start[keep], runs.owner[keep]
            end = runs.end[np.append(np.flatnonzero(keep)[1:], len(keep)) - 1]
            longer = np.flatnonzero(end > runs.end[keep])
            value = runs.hash[keep]
            value[longer] = span_hashes(hashed, start[longer], end[longer])
            runs = Tokens(value, start, end, owner)
        return runs

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class Table:
    """A worker's bounded table from hash to the number of tokens, and to the ids if they are kept."""

    def __init__(self, path: str, first: tuple[np.ndarray, np.ndarray] | None = None, ids: bool = False, size: int = WORKER_ENTRIES):
        self.cutter, self.size, self.keep_ids = PreTokens(path), size, ids
        self.first = first or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self._start()

    def _start(self) -> None:
        self.hash, self.length = self.first
        self.at, self.ids = np.zeros(len(self.hash), np.int64), np.zeros(0, np.uint32)

    def look_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, np.ndarray]:
        """Pre-tokens of a batch, and the place of each in the table, which then holds all of them."""
        if len(self.hash) > self.size:
            self._start()
        words = self.cutter.cut(data, offsets)
        distinct, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, distinct)
        new = np.flatnonzero((at == len(self.hash)) | (self.hash[np.minimum(at, len(self.hash) - 1)] != distinct)) if len(self.hash) else np.arange(len(distinct))
        if new.size:
            raw, a, b = data.tobytes(), words.start[first[new]].tolist(), words.end[first[new]].tolist()
            found = []
            for i in range(0, len(a), 4096):
                found += self.cutter.encode([raw[x:y].decode("utf-8", "replace") for x, y in zip(a[i : i + 4096], b[i : i + 4096], strict=True)])
            length = np.fromiter(map(len, found), np.int64, len(found))
            place = np.cumsum(length) - length + len(self.ids)
            if self.keep_ids:
                self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))])
            where = at[new]
            self.hash, self.length, self.at = (np.insert(x, where, y) for x, y in ((self.hash, distinct[new]), (self.length, length), (self.at, place)))
            at = np.searchsorted(self.hash, distinct)
        return words, at[number]

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, and where each text's begin (and the last one's end)."""
        words, at = self.look_up(data, offsets)
        length = self.length[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.at[at] - (ends - length), length) + np.arange(total)]
        per_text = np.bincount(words.owner, length, minlength=len(offsets) - 1).astype(np.int64)
        return flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])


_tables: dict[tuple[str, bool], Table] = {}


def worker_table(path: str, first: tuple[np.ndarray, np.ndarray] | None = None, ids: bool = False) -> Table:
    """The worker's table, kept from one task to the next."""
    if (path, ids) not in _tables:
        _tables[path, ids] = Table(path, first, ids)
    return _tables[path, ids]


def frequent(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Tier one: hashes in order, and lengths. Each task counts its part of the sample; only `entries` counts of each are sent."""
    ids = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = plain(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, n = Table(path), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in portions(batches):
            words, _ = table.look_up(*bytes_of(batch.column("text")))
            seen, inverse = np.unique(np.concatenate([seen, words.hash]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n, np.ones(len(words.hash), np.int64)])).astype(np.int64)
        top = np.argsort(-n, kind="stable")[:entries]
        top = top[np.isin(seen[top], table.hash)]
        yield record(h=seen[top].view(np.int64), n=n[top], length=table.length[np.searchsorted(table.hash, seen[top])])

    top = rows.coalesce(8).mapInArrow(count, "h long, n long, length long").groupBy("h", "length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(entries)
    found = top.select("h", "length").collect()
    h, length = np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.int64)
    order = np.argsort(h)
    return h[order], length[order]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, sample: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    first = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, sample, entries))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(path, first.value)
        for batch in portions(batches, size=1_500_000):
            data, offsets = bytes_of(batch.column("text"))
            words, at = table.look_up(data, offsets)
            n = np.bincount(words.owner, table.length[at], minlength=batch.num_rows).astype(np.int64)
            yield record(doc_id=batch.column("doc_id"), n_bytes=np.diff(offsets), n_tokens=n)

    return plain(docs, "doc_id", "text").mapInArrow(count, RESULT).withColumn("over_limit", F.col("n_tokens") > limit)
