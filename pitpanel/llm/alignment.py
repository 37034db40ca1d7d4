"""Alignment of the tokens of two tokenizers by merge-path partitioning.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model; A encodes a space and the
text, B the text (it adds the space). Both cut the same bytes, so an alignment is a
merge of two rising lists of end offsets, over all texts of a batch at once. Diagonals of that
merge, found by binary search, cut it into pieces of equal work; each piece emits
its overlaps alone, whatever lies in the others, so a text of any length is merged a piece at a time.
Where an end that both share falls on a border, the piece behind the border stitches it: it
closes the group without repeating the overlap.

A link is a pair of occurrences whose byte ranges overlap. An id pair's count is the
number of links in the whole corpus. The counts of the most frequent pairs are broadcast, as many
as a parameter says; all other pairs of a document are joined with the counts, so no pair is left out
and a pair of words that are everywhere meets no shuffle.

Texts are encoded by units, cut before a space or line end that follows another character than white space.
Neither tokenizer joins anything across such a cut (checked of the models when they are loaded; others
encode whole texts), so a worker remembers a unit's ids by the unit's text itself.

Defined results: texts that are null or empty, or that one of the tokenizers does not give back byte for
byte, have no tokens: zeros and ''. A null doc_id stays null; repeated rows are separate documents, which count
each for itself; an empty table gives no rows; other columns are ignored. Special strings inside texts are plain text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, plain, portions, record, table

#: Parameters: steps of a piece, units that a worker remembers, id pairs whose counts are broadcast (17 bytes
#: each), pairs that a task adds up before it sends them.
PIECE_WORK = 1 << 16
MEMO_UNITS = 250_000
FREQUENT_PAIRS = 1 << 18
TASK_PAIRS = 1 << 20

MARK = "▁"
BYTE_PIECE = 6
NEVER = re.compile(r"(?!)")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: White space beside white space or at an end, or of another kind than space and line end.
UNEVEN = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
SEEN = "row long, n_best long, count_sum long, missed array<long>, missed_times array<int>"


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, the rest for 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers in a worker, the bytes of their ids, and the units met so far."""

    def __init__(self, path_a: str, path_b: str, size: int = MEMO_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        model = proto.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        alphabet = byte_alphabet()
        entries = [self.a.id_to_token(i) or "" for i in range(max(self.a.get_vocab().values()) + 1)]
        self.bytes_a = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE_PIECE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.mark = self.b.piece_to_id(MARK)
        spec = model.normalizer_spec
        plainly = spec.add_dummy_prefix and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        own = [p.piece for p in model.pieces if p.type != BYTE_PIECE]
        apart = not any(MARK in p.lstrip(MARK) or "\n" in p for p in own) and model.trainer_spec.model_type == model.trainer_spec.BPE
        probe = ["a b", "a\nb", "a\n\nb  c"]
        self.cuts = bool(plainly and apart and all(self._a([" " + p]) == [[i for x in self._a(CUT.split(" " + p)) for i in x]] for p in probe))
        self.size = size
        self._start()

    def _start(self) -> None:
        self.number: dict[str, int] = {}
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64)]  # where each unit's ids begin, and the last one's end
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.good = np.zeros(0, bool)

    def _a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _b(self, units: list[str]) -> list[list[int]]:
        """B adds a space to what it gets: it takes the place of a unit's own, and is dropped where a unit has none."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.mark] if u == " " else x if u[0] == " " else x[1:] for u, x in zip(units, found, strict=True)]

    def units(self, text: str) -> list[str]:
        """The text in units. One that begins neither with a space nor a line end stands for itself behind a space."""
        if not text:
            return []
        if not self.cuts:
            return [" " + text]
        if UNEVEN.search(text):
            return [u if u[0] == "\n" or u[1:2].isspace() or len(u) == 1 else u[1:] for u in CUT.split(" " + text)]
        return (text.replace("\n", " \n") if "\n" in text else text).split(" ")

    def learn(self, keys: list[str]) -> None:
        for i in range(0, len(keys), 4096):
            part = keys[i : i + 4096]
            units = [k if k[0] in " \n" else " " + k for k in part]
            a, b = self._a(units), self._b(units)
            raw = [u.encode() for u in units]
            good = [b"".join(map(self.bytes_a.__getitem__, x)) == r and b"".join(map(self.bytes_b.__getitem__, y)) == r for x, y, r in zip(a, b, raw, strict=True)]
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
            for side, found in enumerate((a, b)):
                n = np.fromiter(map(len, found), np.int64, len(found))
                self.at[side] = np.concatenate([self.at[side], self.at[side][-1] + np.cumsum(n)])
                self.ids[side] = np.concatenate([self.ids[side], np.fromiter((i for x in found for i in x), np.int64, int(n.sum()))])
            self.good = np.concatenate([self.good, np.array(good, bool)])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts by A and by B, and how many of them each text has; none where bytes differ."""
        if len(self.number) > self.size:
            self._start()
        split = [self.units(t) for t in texts]
        number = self.number
        missing = dict.fromkeys(k for keys in split for k in keys if k not in number)
        if missing:
            self.learn(list(missing))
        n = np.fromiter(map(len, split), np.int64, len(split))
        unit = np.fromiter((number[k] for keys in split for k in keys), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(texts)), n)
        bad = np.bincount(owner[~self.good[unit]], minlength=len(texts)) > 0
        if bad.any():
            unit, owner = unit[~bad[owner]], owner[~bad[owner]]
        ids, counts = [], []
        for at, known in zip(self.at, self.ids, strict=True):
            first, length = at[unit], at[unit + 1] - at[unit]
            end = np.cumsum(length)
            ids.append(known[np.repeat(first - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)])
            counts.append(np.bincount(owner, length, minlength=len(texts)).astype(np.int64))
        return ids, counts


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of `work` steps of the merge of two rising lists begins in both (and the last one ends); of equal values a's comes first."""
    steps = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        more = a[mid] <= b[steps[open_] - mid - 1]
        low[open_[more]] = mid[more] + 1
        high[open_[~more]] = mid[~more]
    return low, steps - low


def overlaps(a: np.ndarray, b: np.ndarray, i: int, i_end: int, j: int, j_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece: the a and b tokens of each overlap that ends in it, and the a and b tokens of the ends that both share."""
    order = np.argsort(np.concatenate([a[i:i_end], b[j:j_end]]), kind="stable")
    is_a = order < i_end - i
    had_a = np.cumsum(is_a)
    left, right = i + had_a - is_a, j + np.arange(1, len(order) + 1) - had_a - ~is_a
    end = np.where(is_a, a[np.minimum(left, len(a) - 1)], b[np.minimum(right, len(b) - 1)])
    # a shared end comes twice, a's first; that of the piece before counts too
    before = np.concatenate([a[i - 1 : i] if i else [-1], end[:-1]])
    twice = ~is_a & (end == before)
    return left[~twice], right[~twice], left[twice] - 1, right[twice]


def merged(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two lists of ends, and which ends are shared, piece by piece."""
    at_a, at_b = diagonals(a, b, work)
    pieces = [overlaps(a, b, *piece) for piece in zip(at_a[:-1].tolist(), at_a[1:].tolist(), at_b[:-1].tolist(), at_b[1:].tolist(), strict=True)]
    left, right, shared_a, shared_b = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else [np.zeros(0, np.int64)] * 4
    ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ends_a[shared_a], ends_b[shared_b] = True, True
    return left, right, ends_a, ends_b


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits (size x most) and number of digits of 0 .. size-1."""
    text = [str(i) for i in range(size)]
    most = len(text[-1])
    return np.frombuffer("".join(t.ljust(most) for t in text).encode(), np.uint8).reshape(size, most), np.array([len(t) for t in text])


def written(ids: list[np.ndarray], ends: list[np.ndarray], last: np.ndarray, digits: np.ndarray, n_digits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Groups as `a1,a2|b1;a3|b2`: all texts' bytes, and how many of them each b token (`last`: its text's last) has brought to an end."""
    group = [np.cumsum(e) - e for e in ends]
    n = [np.bincount(g, minlength=int(ends[0].sum())) for g in group]
    through = [np.cumsum(x) for x in n]
    place = [np.arange(len(ids[0])) + (through[1] - n[1])[group[0]], np.arange(len(ids[1])) + through[0][group[1]]]
    total = len(ids[0]) + len(ids[1])
    token, mark = np.empty(total, np.int64), np.empty(total, np.uint8)
    for k, closing in enumerate(b"|;"):
        token[place[k]] = ids[k]
        mark[place[k]] = np.where(ends[k], closing, ord(","))
    silent = np.zeros(total, bool)
    silent[place[1][last]] = True
    length = n_digits[token] + ~silent
    end = np.cumsum(length)
    first, out = end - length, np.empty(int(end[-1]) if total else 0, np.uint8)
    for d in range(digits.shape[1]):
        some = np.flatnonzero(n_digits[token] > d)
        out[first[some] + d] = digits[token[some], d]
    loud = ~silent
    out[end[loud] - 1] = mark[loud]
    return out.tobytes(), end[place[1][last]]


def aligned(docs: DataFrame, path_a: str, path_b: str, work: int = PIECE_WORK) -> DataFrame:
    """Tokens, groups (as text) and links of every document, the links as distinct id pairs (a's id in the upper half) with their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(path_a, path_b)
        digits, n_digits = decimals(max(len(both.len_a), len(both.len_b)))
        for batch in portions(batches, size=1_500_000):
            texts = batch.num_rows
            ids, counts = both.encode(batch.column("text").to_pylist())
            ends = [np.cumsum(both.len_a[ids[0]]), np.cumsum(both.len_b[ids[1]])]
            left, right, *shared = merged(*ends, work)
            owner = [np.repeat(np.arange(texts), c) for c in counts]
            some = np.flatnonzero(counts[1])
            raw, upto = written(ids, shared, np.cumsum(counts[1])[some] - 1, digits, n_digits)
            stop = np.zeros(texts, np.int64)
            stop[some] = upto
            stop = np.maximum.accumulate(stop)
            groups = pa.StringArray.from_buffers(texts, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int32).tobytes()), pa.py_buffer(raw)) if len(raw) < 1 << 31 else pa.array([raw[a:b].decode() for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)], pa.large_string()).cast(pa.string())
            link, of = (ids[0][left] << 32) | ids[1][right], owner[0][left]
            order = np.lexsort((link, of))
            link, of = link[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], (link[1:] != link[:-1]) | (of[1:] != of[:-1])])) if len(link) else np.zeros(0, np.int64)
            marks = pa.array(np.searchsorted(of[first], np.arange(texts + 1)).astype(np.int32))
            yield record(
                doc_id=batch.column("doc_id"), n_a=counts[0], n_b=counts[1], n_groups=np.bincount(owner[0][shared[0]], minlength=texts), n_links=np.bincount(of, minlength=texts), groups=groups,
                pairs=pa.ListArray.from_arrays(marks, pa.array(link[first])), times=pa.ListArray.from_arrays(marks, pa.array(np.diff(np.append(first, len(link))).astype(np.int32))),
            )

    return plain(docs, "doc_id", "text").mapInArrow(run, ALIGNED)


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row", F.monotonically_increasing_id())


def pair_counts(links: DataFrame, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and whether no other pair of its B id has more."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, held, waiting = [], [], 0, 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            distinct, number = np.unique(np.concatenate(pair), return_inverse=True)
            return distinct, np.bincount(number, np.concatenate(n), minlength=len(distinct)).astype(np.int64)

        for batch in batches:
            pair.append(batch.column("pairs").flatten().to_numpy())
            n.append(batch.column("times").flatten().to_numpy().astype(np.int64))
            waiting += len(pair[-1])
            if waiting > max(task_pairs, held):
                found = total()
                if len(found[0]) > task_pairs:
                    yield record(pair=found[0], part=found[1])
                    found = found[0][:0], found[1][:0]
                pair, n, held, waiting = [found[0]], [found[1]], len(found[0]), 0
        if pair:
            found = total()
            yield record(pair=found[0], part=found[1])

    counts = cut(links.select("pairs", "times").mapInArrow(add, "pair long, part long").groupBy("pair").agg(F.sum("part").alias("n")))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    # one row for each id of B's vocabulary at most
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(links: DataFrame, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of the numbered documents' links by the counts of the whole corpus."""
    counts = cut(pair_counts(links))
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    known = links.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            listed = batch.column("pairs")
            pair, times = listed.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            # whole numbers throughout: bincount's weights would be floats
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(count_sum, owner[hit], times[hit] * n[at[hit]])
            np.add.at(n_best, owner[hit], times[hit] * best[at[hit]])
            marks = pa.array(np.searchsorted(owner[~hit], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield record(row=batch.column("row"), n_best=n_best, count_sum=count_sum, missed=pa.ListArray.from_arrays(marks, pa.array(pair[~hit])), missed_times=pa.ListArray.from_arrays(marks, pa.array(times[~hit].astype(np.int32))))

    seen = cut(links.select("row", "pairs", "times").mapInArrow(run, SEEN))
    rest = seen.select("row", F.explode(F.arrays_zip("missed", "missed_times")).alias("m")).select("row", F.col("m.missed").alias("of"), F.col("m.missed_times").alias("t"))
    rest = rest.join(counts, F.col("of") == F.col("pair")).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("b"), F.sum(F.col("t") * F.col("n")).alias("s"))
    both = seen.select("row", "n_best", "count_sum").join(rest.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    return both.select("row", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"))


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT_PAIRS, work: int = PIECE_WORK) -> DataFrame:
    """One row per document: tokens, groups, links and their counts, with a checksum of the groups."""
    found = aligned(docs, path_a, path_b, work)
    checksum = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    links = table(numbered(found.withColumn("groups_sha256", checksum).drop("groups")), "links")
    counted = link_counts(links, frequent).withColumnRenamed("row", "r")
    joined = links.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(counted, F.col("row") == F.col("r"))
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
