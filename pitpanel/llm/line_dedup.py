"""Line deduplication by an exact set-similarity join.

A line (between line feeds) is the set of its words. Over all documents, a line is
removed when an earlier line, by doc_id and line number, has a Jaccard
similarity of `PERCENT` or more with it. Lines without words stay.

Lines with equal sets form a class, of which only the first line can stay. For
the classes, the words of a line are ordered by rarity; two similar sets share a
word among their first ones (prefix filter), are of similar size (length filter),
and have enough words left behind the first shared one (positional filter). 32
small counters per set bound from below in how many words two sets differ. The
pairs that pass are compared exactly. Rarity comes from counters of a fixed size,
which may merge words: any order that is the same for all lines gives the same
result. Words that occur once in the corpus are never posted.

The posts are shuffled once by word and sorted within their partitions. Posts of a word
with more than `BLOCK` of them are dealt out by bands of set sizes and random blocks: each
goes to the cells of its own band and block with every band that its length and positional
filters allow and every block, so two classes that may be similar meet in one cell, which is of
bounded size, and cells without an opposite side compare nothing. A class is first
verified with the earliest class that passes the filters. Only classes that have
further partners and are not removed by it are verified with the next few, by the few words that
they post, turn by turn (each takes more than the one before) until none is left, so a passage with thousands of variants costs about one comparison for each
and no pair of a group is made before it is needed.

One sort by identity makes the classes, which are written once; a class is named by its first
line. What remains of a document are its classes that nothing removes, so lines
themselves are never joined.

Defined results: null and empty texts have no words and stay as they are; a null
doc_id comes after all others, and documents are told apart by id and text, so rows that
repeat both are one document; ties do not exist, for the order is total; an empty
table gives no rows; other columns are ignored by `removed_lines` and kept by
`without_lines`. A text all of whose lines go becomes empty and its row stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK, GOLDEN, PACKED, flat, mix, packed, portions, possible, record, runs, slot, table
from .words import WORDS, Tokens, bytes_of, spans, tokens

#: Parameters: least Jaccard similarity in percent, counters of rarity, bits of the bitmap of words that occur twice, bits of the bitmap of compared lines.
PERCENT = 80
COUNTER_BITS = 18
COUNTERS = 1 << COUNTER_BITS
TWICE_BITS = 25
BITMAP_BITS = 23
#: Bytes of text that are taken apart at a time.
PORTION = 1_000_000

LINE = ("no_id", "doc_id", "rid", "line_no")
#: The words that a line posts and their places are runs of numbers, each one value of a row.
POSTED = "no_id boolean, doc_id long, rid long, line_no int, k1 long, k2 long, n int, x long, y long, words binary, places binary"
#: A class by its first line; a null id counts as the largest, for the order only has to be one and the same.
CLASS = ("at", "rid", "line_no")
SIZED = (*CLASS, "n", "x", "y")
POST = np.dtype([("at", "<i8"), ("rid", "<i8"), ("line_no", "<i4"), ("n", "<i4"), ("x", "<i8"), ("y", "<i8"), ("place", "<i2")])
TRIED = np.dtype([("at", "<i8"), ("rid", "<i8"), ("line_no", "<i4")])
#: A key is the word (32 bits), its cell (30) and the side of the cell (2): 0 where all compare with all, otherwise 1 with 2.
#: What goes with it is one value, for there are many posts: a `POST`, and of an open class a `TRIED`, the last class that it was tried with.
POSTS = "key long, post binary, tried binary"
PAIR = ", ".join(f"{s}_at long, {s}_rid long, {s}_line_no int" for s in "ab")
#: Lines whose words are sorted at a time: their number, a rarity and a part of the hash are one number of 64 bits.
LINE_BITS, RARITY_BITS = 12, 7
#: How tables of hashes are written, which no dictionary makes smaller.
HASHES = {"parquet.enable.dictionary": "false", "compression": "lz4"}
#: Posts that are compared at a time, but for a word with more of them; a place beyond the largest counts as it, which only weakens its filter.
GATHERED = 1 << 17
#: Partners that a class is verified with in its second turn, after the first; each turn takes its square times more.
TURN = 8
#: Posts above which a word is dealt out to cells, and which a side of a cell has on average; sizes up to which a band is one size, then their ratio.
BLOCK = 1 << 15
EXACT_BANDS, BAND_RATIO = 16, 1.1
MAX_PLACE = (1 << 15) - 1


def telling(docs: DataFrame) -> Column:
    """What tells apart different texts under one id: a hash of the text; 0 where every id has one row, which leaves nothing to move."""
    again = docs.groupBy(F.coalesce("doc_id", F.lit((1 << 63) - 1))).agg(F.count("*").alias("c")).filter("c > 1")
    return F.lit(0).cast("long") if again.isEmpty() else F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def documents(docs: DataFrame, rid: Column) -> DataFrame:
    """doc_id, text and what tells apart different texts under one id."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("at"), rid.alias("rid"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def all_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: text, line number, first byte."""
    feeds = np.flatnonzero(data == 10)
    n_lines = np.diff(np.searchsorted(feeds, offsets)) + 1
    owner = np.repeat(np.arange(len(n_lines)), n_lines)
    number = np.arange(len(owner)) - (np.cumsum(n_lines) - n_lines)[owner]
    begin = np.empty(len(owner), np.int64)
    begin[number == 0], begin[number > 0] = offsets[:-1], feeds + 1
    return owner, number, begin


def lines_at(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that have words, which begin at `starts`: text, line number; then line (by position) of each word."""
    owner, number, begin = all_lines(data, offsets)
    held = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
    used = np.flatnonzero(held)
    return owner[used], number[used], np.repeat(np.arange(len(used)), held[used])


def lines_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tokens]:
    """`lines_at` of a batch, and the words."""
    data, offsets = bytes_of(batch.column("text"))
    words = tokens(data, offsets, WORDS)
    return *lines_at(data, offsets, words.start), words


def as_sets(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's distinct values in order: lines, values, and where each line begins."""
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    if len(of):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])])
        of, values = of[new], values[new]
    return of, values, np.searchsorted(of, np.arange(of[-1] + 1 if len(of) else 0))


def identity(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identity of each set of word hashes."""
    with np.errstate(over="ignore"):
        return tuple(np.add.reduceat(mix(hashes * GOLDEN + np.uint64(salt)), start).view(np.int64) for salt in (1, 2)) if len(start) else (np.zeros(0, np.int64),) * 2


def counters(of: np.ndarray, hashes: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each set fall to each of 32 bins, modulo 16, as two numbers of sixteen 4-bit counters."""
    with np.errstate(over="ignore"):
        bins = (mix(hashes + GOLDEN) & np.uint64(31)).astype(np.int64)
    count = (np.bincount(of * 32 + bins, minlength=sets * 32).reshape(-1, 2, 16) & 15).astype(np.uint64)
    both = np.bitwise_or.reduce(count << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
    return tuple(np.ascontiguousarray(both[:, i]).view(np.int64) for i in (0, 1))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the sixteen counters of a and b of how far they are apart modulo 16: at least so many words differ."""
    high, low, bytes_ = np.uint64(0x8888888888888888), np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x0101010101010101)
    a, b = a.view(np.uint64), b.view(np.uint64)
    with np.errstate(over="ignore"):
        # counters subtracted side by side, then those above 8 taken from 16
        c = ((a | high) - (b & ~high)) ^ ((a ^ ~b) & high)
        negative = (c & high) >> np.uint64(3)
        c = (c ^ (negative * np.uint64(15))) + negative
        return (((c & low) + ((c >> np.uint64(4)) & low)) * bytes_ >> np.uint64(56)).astype(np.int64)


class Frequencies:
    """Counters of rarity and the bitmap of words seen twice, over all documents; both of fixed size."""

    def __init__(self, docs: DataFrame):
        half = (1 << TWICE_BITS) // 64
        pieces = COUNTERS // CHUNK

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, seen = np.zeros(COUNTERS, np.int64), Twice()
            for batch in portions(batches, size=PORTION):
                h = tokens(*bytes_of(batch.column("text")), WORDS).hash
                counts += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                seen.add(h.view(np.int64))
            yield from packed(np.concatenate([counts, seen.words()]))

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = (np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["data"])
            total = reduce(np.add if pdf["chunk"].iloc[0] < pieces else either, parts)
            return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "data": [zlib.compress(total.tobytes(), 1)]})

        out = np.zeros(COUNTERS + 2 * half, np.int64)
        for row in docs.select("text").mapInArrow(count, PACKED).groupBy("chunk").applyInPandas(merge, PACKED).collect():
            out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["data"]), np.int64)
        # rarity in 1/4 steps of a power of two fits in seven bits
        self.rarity = np.minimum(np.log2(np.maximum(out[:COUNTERS], 1)) * 2, 127).astype(np.uint64)
        self.twice = twice_of(out[COUNTERS:])

    def sets(self, of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's distinct words, in an order that has rare words first and is the same for all lines: lines, hashes."""
        lines, hashes = [], []
        last = int(of[-1]) if len(of) else -1
        edges = np.searchsorted(of, np.arange(0, last + 1 + (1 << LINE_BITS), 1 << LINE_BITS))
        for a, b in zip(edges, edges[1:], strict=False):
            part, line = h[a:b], of[a:b]
            rank = self.rarity[(part & np.uint64(COUNTERS - 1)).astype(np.int64)] << np.uint64(64 - LINE_BITS - RARITY_BITS) | part >> np.uint64(LINE_BITS + RARITY_BITS)
            order = np.argsort((line & ((1 << LINE_BITS) - 1)).astype(np.uint64) << np.uint64(64 - LINE_BITS) | rank)
            part, line = part[order], line[order]
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (line[1:] != line[:-1])])
            lines.append(line[new])
            hashes.append(part[new])
        return np.concatenate([np.zeros(0, np.int64), *lines]), np.concatenate([np.zeros(0, np.uint64), *hashes])


class Twice:
    """Two bitmaps of fixed size: where values have been seen once, and where twice."""

    def __init__(self):
        self.once, self.twice = np.zeros(1 << TWICE_BITS, bool), np.zeros(1 << TWICE_BITS, bool)

    def add(self, values: np.ndarray) -> None:
        at = np.sort(slot(values, TWICE_BITS))
        self.twice[at[self.once[at]]] = True
        self.twice[at[1:][at[1:] == at[:-1]]] = True
        self.once[at] = True

    def words(self) -> np.ndarray:
        both = np.stack([np.packbits(x).view(np.int64).reshape(-1, CHUNK // 2) for x in (self.once, self.twice)], axis=1)
        return both.ravel()


def either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two tasks' pieces of both bitmaps."""
    half = CHUNK // 2
    return np.concatenate([a[:half] | b[:half], a[half:] | b[half:] | (a[:half] & b[:half])])


def twice_of(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words.reshape(-1, 2, CHUNK // 2)[:, 1]).ravel().view(np.uint8)


def is_set(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = slot(values, TWICE_BITS)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def shared_words(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap of the words that more than one class posts, and by counters of a fixed size into how many blocks a word's posts go."""
    pieces = COUNTERS // CHUNK

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, np.int64), Twice()
        for batch in batches:
            words = flat(batch.column("words"), np.int32)
            counts += np.bincount(slot(words, COUNTER_BITS), minlength=COUNTERS)
            seen.add(words)
        yield from packed(np.concatenate([counts, seen.words()]))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = (np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["data"])
        total = reduce(np.add if pdf["chunk"].iloc[0] < pieces else either, parts)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "data": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros(COUNTERS + 2 * (1 << TWICE_BITS) // 64, np.int64)
    for row in classes.select("words").mapInArrow(run, PACKED).groupBy("chunk").applyInPandas(merge, PACKED).collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["data"]), np.int64)
    return twice_of(out[COUNTERS:]), -(-out[:COUNTERS] // BLOCK)


def band(n: np.ndarray) -> np.ndarray:
    """A number that grows with the size of a set, the same for sizes that are close."""
    over = np.log(np.maximum(n, EXACT_BANDS) / EXACT_BANDS) / np.log(BAND_RATIO)
    return np.minimum(n, EXACT_BANDS) + np.ceil(over).astype(np.int64)


def cells(word: np.ndarray, n: np.ndarray, place: np.ndarray, name: np.ndarray, blocks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of posts, the index and the key of each of their copies: one for words of a block, otherwise one for every cell where a partner may be."""
    word, n, place = (v.astype(np.int64) for v in (word, n, place))
    k = blocks[slot(word, COUNTER_BITS)]
    key, one = word << 32, k <= 1
    if one.all():
        return np.arange(len(word)), key
    hot = np.flatnonzero(~one)
    n, k = n[hot], k[hot]
    least = -(-percent * n // 100)
    most = np.minimum(100 * n // percent, (100 + percent) * (n - place[hot]) // percent - n)
    low, copies = band(least), np.where(most < least, 0, (band(np.maximum(most, least)) - band(least) + 1) * k)
    of = np.repeat(np.arange(len(hot)), copies)
    step = np.arange(len(of)) - np.repeat(np.cumsum(copies) - copies, copies)
    own = band(n) << 32 | (mix(name[hot].view(np.uint64) + GOLDEN) % k.astype(np.uint64)).astype(np.int64)
    own, other = own[of], (low[of] + step // k[of]) << 32 | step % k[of]
    side = np.where(own == other, 0, np.where(own < other, 1, 2))
    with np.errstate(over="ignore"):
        both = mix(mix(np.minimum(own, other).view(np.uint64)) + np.maximum(own, other).view(np.uint64))
    cell = (both >> np.uint64(34)).astype(np.int64)
    return np.concatenate([np.flatnonzero(one), hot[of]]), np.concatenate([key[one], key[hot[of]] | cell << 2 | side])


def posts_of(classes: DataFrame, found: Broadcast, percent: int, tried: bool = False) -> DataFrame:
    """One row per class, word that it may share with another class by the bitmap in `found`, and cell of the word."""
    last = [f"t_{c}" for c in CLASS] if tried else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, blocks = found.value
        for batch in batches:
            words, places = flat(batch.column("words"), np.int32), flat(batch.column("places"), np.int16)
            of = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch.column("words")).to_numpy() // 4)
            keep = np.flatnonzero(is_set(bitmap, words))
            post, t = np.zeros(batch.num_rows, POST), np.zeros(batch.num_rows, TRIED)
            for c in SIZED:
                post[c] = batch.column(c).to_numpy()
            for c in last:
                t[c[2:]] = batch.column(c).to_numpy()
            names = name_bits(post["at"], post["rid"], post["line_no"].astype(np.int64))
            most = int(blocks[slot(words[keep], COUNTER_BITS)].max(initial=1))
            size = GATHERED if most <= 1 else max(1, GATHERED // (8 * most))
            for i in range(0, len(keep), size):
                part = keep[i : i + size]
                copy, key = cells(words[part], post["n"][of[part]], places[part], names[of[part]], blocks, percent)
                part = part[copy]
                out = post[of[part]]
                out["place"] = places[part]
                each = np.arange(1, len(part) + 1)
                yield record(key=key, post=runs(out, each), tried=runs(t[of[part]], each) if tried else pa.nulls(len(part), pa.binary()))

    return classes.select("words", "places", *SIZED, *last).mapInArrow(run, POSTS)


def posted(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every line with words: who it is, its set's identity and size, and its prefix of words that others may share."""
    found = docs.sparkSession.sparkContext.broadcast(Frequencies(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = found.value
        for batch in portions(batches, size=PORTION):
            owner, number, of, words = lines_of(batch)
            if not len(owner):
                continue
            of, h = frequency.sets(of, words.hash)
            start = np.searchsorted(of, np.arange(len(owner)))
            (k1, k2), (x, y) = identity(h, start), counters(of, h, len(owner))
            n = np.diff(np.append(start, len(of)))
            place = np.arange(len(of)) - start[of]
            prefix = n - (percent * n + 99) // 100 + 1
            # a set smaller than 100 / (100 - percent) - 1 has no other set close enough
            post = np.flatnonzero(place < np.where((n + 1) * (100 - percent) >= 100, prefix, 0)[of])
            post = post[is_set(frequency.twice, h[post].view(np.int64)) > 0]
            marks = np.searchsorted(of[post], np.arange(len(owner)), "right")
            ids, rids = batch.column("doc_id").take(pa.array(owner)), batch.column("rid").take(pa.array(owner))
            lines = record(
                no_id=ids.is_null(), doc_id=ids, rid=rids, line_no=number.astype(np.int32), k1=k1, k2=k2, n=n.astype(np.int32), x=x, y=y,
                words=runs((h[post] >> np.uint64(8)).astype(np.uint32), marks),
                places=runs(np.minimum(place[post], MAX_PLACE).astype(np.int16), marks),
            )
            yield from first_lines([lines.take(pa.array(np.argsort(k1)))])

    return docs.mapInArrow(run, POSTED)


def first_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of `POSTED` sorted by k1, the first line of each class; only that of the last class is held back."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        k1, k2, rid, line_no = (batch.column(c).to_numpy() for c in ("k1", "k2", "rid", "line_no"))
        no_id, at = batch.column("no_id").to_numpy(zero_copy_only=False), batch.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
        firsts = np.arange(len(k1))
        if (k1[1:] == k1[:-1]).any():
            order = np.lexsort((line_no, rid, at, no_id, k2, k1))
            new = np.concatenate([[True], (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])])
            firsts = order[new]
        upto = int(np.searchsorted(k1[firsts], k1[-1]))
        yield batch.take(pa.array(firsts[:upto]))
        held = batch.take(pa.array(firsts[upto:]))
    if held is not None:
        yield held


def classes_of(lines: DataFrame) -> DataFrame:
    """One row per class: its first line. A line that is everywhere was counted once for each portion of text."""
    return lines.repartition("k1").sortWithinPartitions("k1").mapInArrow(first_lines, POSTED)


def name_bits(at, rid, line_no):
    """A number of a line for bitmaps; of columns and of numpy arrays alike."""
    if isinstance(at, Column):
        return at.bitwiseXOR(rid).bitwiseXOR(F.shiftleft(line_no.cast("long"), 32))
    return at ^ rid ^ (line_no << 32)


def sets_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Name and word hashes of the lines in `pairs`, found by a bitmap of fixed size; few others may come along."""
    names = pairs.select(F.explode(F.array(*[name_bits(*[F.col(f"{s}_{c}") for c in CLASS]) for s in "ab"], *[F.col(f"{s}_at").bitwiseXOR(F.col(f"{s}_rid")) for s in "ab"])).alias("name"))
    marked = rows.sparkSession.sparkContext.broadcast(possible(names, "name", BITMAP_BITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, size=PORTION):
            batch = batch.filter(pa.array(marked.value[slot(batch.column("at").to_numpy() ^ batch.column("rid").to_numpy(), BITMAP_BITS)]))
            owner, number, of, words = lines_of(batch)
            if not len(owner):
                continue
            at, rid = (batch.column(c).to_numpy()[owner] for c in ("at", "rid"))
            keep = np.flatnonzero(marked.value[slot(name_bits(at, rid, number), BITMAP_BITS)])
            wanted = np.zeros(len(owner), bool)
            wanted[keep] = True
            of, h, start = as_sets(*(v[wanted[of]] for v in (of, words.hash)))
            start, end = start[keep] if len(of) else start, np.searchsorted(of, keep, "right")
            yield record(at=at[keep], rid=rid[keep], line_no=number[keep].astype(np.int32), hashes=pa.array([h[i:j].tobytes() for i, j in zip(start, end, strict=True)], pa.binary()))

    # repeated rows give the same line again
    return rows.select("at", "rid", "text").mapInArrow(run, "at long, rid long, line_no int, hashes binary").dropDuplicates([*CLASS])


def named(side: str) -> list[str]:
    return [f"{side}_{c}" for c in CLASS]


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs of lines a and b, the names of the b that are similar enough to their a."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "a"):
            good = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield record(**{c: kept.column(f"b_{c}") for c in CLASS})

    side = lambda x: sets.select(*[F.col(c).alias(f"{x}_{c}") for c in CLASS], F.col("hashes").alias(x))
    both = pairs.join(side("a"), named("a")).join(side("b"), named("b"))
    return both.select(*named("b"), "a", "b").mapInArrow(run, "at long, rid long, line_no int").distinct()


def words_whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted posts in runs that hold all posts of each of their words, or of each cell of a word."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        word = batch.column("key").to_numpy() >> 2
        cut = int(np.searchsorted(word, word[-1]))
        if held and size + cut >= GATHERED and (cut or last != word[-1]):
            yield from pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size, last = size + batch.num_rows, word[-1]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def in_order(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The posts of a run, sorted by key, in the order of key and class: what they hold, and where each was in the run."""
    key, post = batch.column("key").to_numpy(), flat(batch.column("post"), POST)
    at, rid, line_no = (post[c] for c in CLASS)
    run = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    low, bits = int(at.min()), int(line_no.max()).bit_length()
    across = (int(at.max()) - low).bit_length() + bits
    if (rid == rid[0]).all() and across + int(run[-1]).bit_length() < 64:
        order = np.argsort(run << across | (at - low) << bits | line_no)
    else:
        order = np.lexsort((line_no, rid, at, run))
    post = post[order]
    return key, *(np.ascontiguousarray(post[c]) for c in ("place", *SIZED)), order


def sizes_of_partners(n: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest size of a set that may be similar to one of size n with which it first shares the word at the place."""
    n, rest = n.astype(np.int64), n.astype(np.int64) - place
    return -(-percent * n // 100), np.minimum(100 * n // percent, (100 + percent) * rest // percent - n)


def opposite(key: np.ndarray, at: np.ndarray, rid: np.ndarray, line_no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sorted post, where the posts begin and end that it is compared with: those before it on its cell's other side."""
    side = key & 3
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    start, stop = np.repeat(new, np.diff(np.append(new, len(key)))), np.arange(len(key))
    if side.any():
        order = np.empty(len(key), np.int64)
        order[np.lexsort((line_no, rid, at))] = np.arange(len(key))
        other = key + np.array([0, 1, -1])[side]
        begin, end = np.searchsorted(key, other), np.searchsorted(key, other, "right")
        # runs of a key by number, so that number and order together ascend
        run = np.searchsorted(np.unique(key), key)
        before = np.searchsorted(run * len(key) + order, run[np.minimum(begin, len(key) - 1)] * len(key) + order)
        cross = side > 0
        start[cross], stop[cross] = begin[cross], np.where(begin < end, np.clip(before, begin, end), begin)[cross]
    return start, stop


def first_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Of every class b, the earliest class a that passes the filters by some word, and whether others pass too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words_whole(batches):
            key, place, at, rid, line_no, n, x, y, _ = in_order(batch)
            least, most = sizes_of_partners(n, place, percent)
            start, stop = opposite(key, at, rid, line_no)
            first, more = np.full(len(key), -1), np.zeros(len(key), bool)
            # all classes against the first class of their word, then the second and so on; who has two partners is done
            rank, b = 0, np.arange(len(key))
            while True:
                a = start[b] + rank
                b, a = b[a < stop[b]], a[a < stop[b]]
                if not len(b):
                    break
                n_a = n[a]
                good = np.flatnonzero((least[b] <= n_a) & (n_a <= most[b]) & (n[b] <= most[a]))
                hit, of = b[good], a[good]
                differ = distance(x[of], x[hit]) + distance(y[of], y[hit])
                near = (100 + percent) * differ <= (100 - percent) * (n[of] + n[hit])
                near &= (at[of] != at[hit]) | (rid[of] != rid[hit]) | (line_no[of] != line_no[hit])
                hit, of = hit[near], of[near]
                new = first[hit] < 0
                more[hit[~new]] = True
                first[hit[new]] = of[new]
                b, rank = b[~more[b]], rank + 1
            b = np.flatnonzero(first >= 0)
            yield record(**{f"{s}_{c}": v[i] for s, i in (("a", first[b]), ("b", b)) for c, v in zip(CLASS, (at, rid, line_no), strict=True)}, more=more[b])

    pairs = posts.select("key", "post").repartition(F.shiftright("key", 2)).sortWithinPartitions("key").mapInArrow(run, f"{PAIR}, more boolean")
    a = F.struct(*named("a"))
    return pairs.groupBy(*named("b")).agg(F.min(a).alias("a"), F.max(a).alias("z"), F.max("more").alias("more")).select("a.*", *named("b"), (F.col("more") | (F.col("a") != F.col("z"))).alias("more"))


def next_pairs(posts: DataFrame, percent: int, most: int = TURN) -> DataFrame:
    """Of every open class b the next `most` classes a, in order behind the one that it was tried with last, that pass the filters, and whether there are more.

    `posts` holds those of all classes, and those of the open ones once more with the last class tried.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words_whole(batches):
            key, place, at, rid, line_no, n, x, y, order = in_order(batch)
            open_, tried = batch.column("tried").is_valid().to_numpy(zero_copy_only=False), np.zeros(len(key), TRIED)
            tried[open_] = flat(batch.column("tried").drop_null(), TRIED)
            open_, (t_at, t_rid, t_line) = open_[order], (tried[c][order] for c in CLASS)
            least, most_words = sizes_of_partners(n, place, percent)
            start, stop = opposite(key, at, rid, line_no)
            b, rank, got, pairs, held = np.flatnonzero(open_), 0, np.zeros(len(key), np.int64), [], 0
            while len(b):
                a = start[b] + rank
                b, a = b[a < stop[b]], a[a < stop[b]]
                later = (at[a] > t_at[b]) | ((at[a] == t_at[b]) & ((rid[a] > t_rid[b]) | ((rid[a] == t_rid[b]) & (line_no[a] > t_line[b]))))
                good = ~open_[a] & later & (least[b] <= n[a]) & (n[a] <= most_words[b]) & (n[b] <= most_words[a])
                hit, of = b[good], a[good]
                near = (100 + percent) * (distance(x[of], x[hit]) + distance(y[of], y[hit])) <= (100 - percent) * (n[of] + n[hit])
                near &= (at[of] != at[hit]) | (rid[of] != rid[hit]) | (line_no[of] != line_no[hit])
                got[hit[near]] += 1
                pairs.append((of[near], hit[near]))
                b, rank, held = b[got[b] <= most], rank + 1, held + int(near.sum())
                if held and (held >= GATHERED or not len(b)):
                    both = zip("ab", map(np.concatenate, zip(*pairs, strict=True)), strict=True)
                    yield record(**{f"{s}_{c}": v[i] for s, i in both for c, v in zip(CLASS, (at, rid, line_no), strict=True)})
                    pairs, held = [], 0

    found = posts.repartition(F.shiftright("key", 2)).sortWithinPartitions("key").mapInArrow(run, PAIR)
    # a class posts few words, each with most + 1 at the most
    found = found.groupBy(*named("b")).agg(F.sort_array(F.collect_set(F.struct(*named("a")))).alias("c"))
    return found.select(*named("b"), F.slice("c", 1, most).alias("c"), (F.size("c") > most).alias("more"))


def staying(docs: DataFrame, rid: Column, percent: int = PERCENT) -> DataFrame:
    """doc_id, rid and the numbers of the lines with words that stay, for documents that keep any."""
    rows = documents(docs, rid)
    classes = classes_of(posted(rows, percent))
    at = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("at")
    classes = table(classes.select(at, *LINE, "n", "x", "y", "words", "places"), "classes", **HASHES)
    bitmap, blocks = shared_words(classes)
    shared = rows.sparkSession.sparkContext.broadcast((bitmap, blocks))
    posts = posts_of(classes, shared, percent)
    # first every class against its earliest possible partner
    firsts = table(first_pairs(posts, percent), "firsts")
    gone = table(similar(firsts, sets_of(rows, firsts), percent), "found")
    tried = [F.col(f"a_{c}").alias(f"t_{c}") for c in CLASS]
    open_ = table(firsts.filter("more").select(*[F.col(f"b_{c}").alias(c) for c in CLASS], *tried).join(gone, [*CLASS], "left_anti"), "open")
    # then those that have others and are still there against the next few, until none has any left
    most = TURN
    while not open_.isEmpty():
        own = table(classes.join(open_, [*CLASS]).select("words", "places", *SIZED, *[f"t_{c}" for c in CLASS]), "again", **HASHES)
        # both bitmaps have the same places, so what they share is the words that `own` posts; taken from the lists, so that a task needs one Python worker
        words = own.select(F.col("words").alias("word"))
        asked = rows.sparkSession.sparkContext.broadcast((np.packbits(possible(words, "word", TWICE_BITS)) & bitmap, blocks))
        posts = posts_of(classes, asked, percent).unionByName(posts_of(own, shared, percent, tried=True))
        pairs = table(next_pairs(posts, percent, most), "next")
        each = pairs.select(*named("b"), F.explode("c").alias("a")).select("a.*", *named("b"))
        found = table(similar(each, sets_of(rows, each), percent), "found")
        gone, most = gone.union(found), most * TURN * TURN
        last = F.element_at("c", -1)
        open_ = table(pairs.filter("more").select(*[F.col(f"b_{c}").alias(c) for c in CLASS], *[last[f"a_{c}"].alias(f"t_{c}") for c in CLASS]).join(found, [*CLASS], "left_anti"), "open")
    return classes.select(*CLASS, "doc_id").join(gone, [*CLASS], "left_anti").groupBy("doc_id", "rid").agg(F.collect_list("line_no").alias("stays"))


def worded_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many lines each text has; then text and number of the lines with words, without looking for the words."""
    owner, number, begin = all_lines(data, offsets)
    filled = np.flatnonzero(np.diff(np.append(begin, len(data))))
    if len(filled):
        filled = filled[np.maximum.reduceat(WORDS[data], begin[filled]) > 0]
    return np.bincount(owner, minlength=len(offsets) - 1), owner[filled], number[filled]


def worded(rows: DataFrame) -> DataFrame:
    """One row per document: its number of lines, and the numbers of those with words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, size=PORTION):
            data, offsets = bytes_of(batch.column("text"))
            n_lines, owner, number = worded_lines(data, offsets)
            marks = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(marks), pa.array(number.astype(np.int32)))
            yield record(doc_id=batch.column("doc_id"), rid=batch.column("rid"), n_lines=n_lines, lines=lists)

    return rows.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, n_lines long, lines array<int>")


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: its lines, how many are removed, and their numbers (from 0)."""
    rid = telling(docs)
    stays = staying(docs, rid, percent).withColumnsRenamed({"doc_id": "s_id", "rid": "s_rid"})
    rows = worded(documents(docs, rid))
    found = rows.join(stays, (F.col("rid") == F.col("s_rid")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left")
    found = found.withColumn("removed", F.array_except("lines", F.coalesce("stays", F.array().cast("array<int>"))))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.col("removed").alias("removed_lines"))


def without_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, their repeated lines removed from `text`; a null text stays null."""
    key = telling(docs)
    stays = staying(docs, key, percent).withColumnsRenamed({"doc_id": "_stays_id", "rid": "_stays_rid", "stays": "_stays"})
    # a line without words stays; the others do if they are listed
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~line.rlike(r"[^\x20\x09-\x0D]") | F.array_contains(F.coalesce("_stays", F.array().cast("array<int>")), i))
    joined = docs.join(stays, (key == stays["_stays_rid"]) & docs["doc_id"].eqNullSafe(stays["_stays_id"]), "left")
    return joined.withColumn("text", F.array_join(lines, "\n")).select(*docs.columns)
