"""Similarity join of documents by word shingles: count vectors in R-trees, overlap bounds, exact verification.

A document is the set of its distinct shingles of `WIDTH` words. Its shingles are hashed
into `GROUPS` groups, and the numbers in the groups are a point. Two sets share at most the sum of
the smaller coordinates of their points, and what lies in two rectangles at most the sum of the smaller
upper corners, so pairs of subtrees and of points that cannot reach the similarity are never looked at.
Differences of long sets cancel out within a group, so pairs of points that pass are also held to parities (every shingle
flips one of 1024): two sets differ in at least as many shingles as parities.

The points are spread over the cluster by cells. Sets whose sizes could be similar differ in at most d shingles
(d follows from the sizes), so when the hash also deals the shingles into d + 1 bundles, one bundle is
the same in both. A cell holds the sets of one range of sizes that agree in one whole bundle. Every pair
that can be a link shares a cell, and texts that only share a common passage hardly ever do. Near copies share most of
their bundles, so a cell is named by its sets: those that hold the same ones are one cell.

In a cell each set is first held against the smallest, which settles groups of copies at one comparison for
each member. The components of the links that are verified this way name what is still apart; then R-trees
of the cells that hold more than one component are searched for pairs of different components, in cells of
many such pairs first for each set's likeliest partner. Cells of more than `CELL` sets are split into
blocks, and every pair of blocks is a cell. Pairs that pass are verified on the sets of their whole texts, equal sets counting once.

Defined results: texts without words (null, empty, blank) have no shingles and are linked with nothing; fewer words than a
shingle are one shingle; null ids join the component of their text, and have a null one if nothing else
is in it; repeated rows are one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import PARITIES, parities
from .shared import GOLDEN, components, cut, mix, plain, portions, possible, record, slot, table
from .words import WORDS, bytes_of, tokens, windows

#: Parameters: words of a shingle, least Jaccard similarity in percent, groups (the dimension of the points), points of a
#: leaf, sets of a cell, bits of the bitmaps of documents (those with copies, in cells, or whose sets are verified).
WIDTH = 3
PERCENT = 90
GROUPS = 64
LEAF = 32
CELL = 4096
BITMAP_BITS = 23

LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SIGNED = "doc_id long, key binary, n long, point binary, parity binary, sigs array<long>"


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch of texts and the number of the text that each is in, in order of text and hash."""
    data, offsets = bytes_of(column)
    words = tokens(LOWERED[data], offsets, WORDS)
    value, at = windows(words, width)
    owner, n = words.owner[at], words.per_owner(len(column))
    few = np.flatnonzero((n > 0) & (n < width))
    if few.size:
        end = np.cumsum(n)
        own = np.array([xxhash.xxh3_64_intdigest(words.hash[end[i] - n[i] : end[i]].tobytes()) for i in few], np.uint64)
        value, owner = np.concatenate([value, own]), np.concatenate([owner, few])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, bool)
    return value[first], owner[first]


def points(value: np.ndarray, owner: np.ndarray, texts: int, groups: int = GROUPS) -> np.ndarray:
    """How many shingles of each text are in each group."""
    with np.errstate(over="ignore"):
        group = (mix(value ^ GOLDEN) % np.uint64(groups)).astype(np.int64)
    return np.bincount(owner * groups + group, minlength=texts * groups).reshape(texts, groups).astype(np.uint32)


def parity_rows(value: np.ndarray, owner: np.ndarray, texts: int) -> list[bytes]:
    """The parities of each text's set as bytes."""
    return [p.tobytes() for p in parities(mix(value ^ GOLDEN), np.ones(len(value), np.int64), owner, texts)]


def packed_points(point: np.ndarray) -> list[bytes]:
    """Each point behind the size of its numbers: one byte where all of them fit, else four."""
    small = point.max(axis=1, initial=0) < 256
    return [b"\1" + p.astype(np.uint8).tobytes() if fits else b"\4" + p.tobytes() for p, fits in zip(point, small.tolist(), strict=True)]


def unpacked_points(column: pa.Array) -> np.ndarray:
    """The points of a column that is not empty."""
    return np.stack([np.frombuffer(p, np.uint8 if p[0] == 1 else np.uint32, offset=1) for p in column.to_pylist()]).astype(np.int64)


def unpacked(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of a column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def ranges(most: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """First size of each range and its number of bundles. Partners are in one range or in neighbouring ones.

    The first range begins where two different sets can be similar at all.
    """
    first, bundles, size = [], [], next(s for s in range(1, 10**6) if 100 * s >= percent * (s + 1)) if percent < 100 else most + 1
    while size <= most:
        last = size * 100 // percent
        first.append(size)
        # |A| + |B| - 2 * shared, where 100 * shared >= percent * (|A| + |B| - shared)
        bundles.append((last + last * 100 // percent) * (100 - percent) // (100 + percent) + 1)
        size = last + 1
    return np.array(first, np.int64), np.array(bundles, np.int64)


def signatures(value: np.ndarray, owner: np.ndarray, texts: int, percent: int = PERCENT) -> list[np.ndarray]:
    """Hashes of the bundles of each text, for its own range of sizes and, as the larger partner, for the one below."""
    size = np.bincount(owner, minlength=texts)
    first, bundles = ranges(int(size.max(initial=0)), percent)
    own = np.searchsorted(first, size, "right") - 1
    found: list[list[np.ndarray]] = [[] for _ in range(texts)]
    with np.errstate(over="ignore"):
        for step in (0, 1):
            of = own - step
            m = np.where(of >= 0, bundles[np.maximum(of, 0)], 0) if len(bundles) else np.zeros(texts, np.int64)
            end = np.cumsum(m)
            base = end - m
            inside = np.flatnonzero(m[owner] > 0)
            text, h = owner[inside], mix(value[inside] + GOLDEN)
            total = np.zeros(int(end[-1]) if texts else 0, np.uint64)
            np.add.at(total, base[text] + (h % m[text].astype(np.uint64)).astype(np.int64), mix(h ^ (h >> np.uint64(7))))
            label = np.repeat(of, m) * (1 << 32) + np.arange(len(total)) - np.repeat(base, m)
            sig = mix(total ^ mix(label.astype(np.uint64) + GOLDEN)).view(np.int64)
            for i in np.flatnonzero(m).tolist():
                found[i].append(sig[base[i] : end[i]])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def sign(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, groups: int = GROUPS) -> DataFrame:
    """doc_id, identity and size of the set, its point, its parities and the hashes of its bundles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, size=1_500_000):
            value, owner = shingle_sets(batch.column("text"), width)
            marks = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            keys = [xxhash.xxh3_128_digest(value[a:b].tobytes()) if b > a else None for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]
            point = packed_points(points(value, owner, batch.num_rows, groups))
            yield record(doc_id=batch.column("doc_id"), key=pa.array(keys, pa.binary()), n=np.diff(marks), point=pa.array(point, pa.binary()), parity=pa.array(parity_rows(value, owner, batch.num_rows), pa.binary()), sigs=pa.array(signatures(value, owner, batch.num_rows, percent), pa.list_(pa.int64())))

    return plain(docs, "doc_id", "text").mapInArrow(run, SIGNED)


def shared_cells(posts: DataFrame) -> DataFrame:
    """(sig, node, lead) of the cells that hold more than one set; the lead is the smallest node.

    `sig` becomes a hash of the cell's nodes, so that cells of the same sets are one; only a cell that goes on in
    another batch keeps its own. Where two cells got one number, they would be searched as one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, lead, waits = None, None, False  # the last cell so far; it waits while it has one set
        for batch in batches:
            if not batch.num_rows:
                continue
            s, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
            if waits:
                s, node = np.concatenate([[sig], s]), np.concatenate([[lead], node])
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(start, len(s)))
            first = node[start].copy()
            known = not waits and s[0] == sig  # the cell began in an earlier batch, its lead is out
            if known:
                first[0] = lead
            out = size > 1
            out[0] |= known
            mask = np.repeat(out, size)
            with np.errstate(over="ignore"):
                name = mix(np.add.reduceat(mix(node.view(np.uint64) + GOLDEN), start) ^ size.astype(np.uint64)).view(np.int64)
            name[-1] = s[-1]
            if known:
                name[0] = s[0]
            sig, lead, waits = s[-1], first[-1], not out[-1]
            yield record(sig=np.repeat(name, size)[mask], node=node[mask], lead=np.repeat(first, size)[mask])

    return posts.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "sig long, node long, lead long").distinct()


class Sketches:
    """One signed row of every set, that of its smallest doc_id, named `node`.

    Only rows that may have a copy, by a bitmap of fixed size, are shuffled to find it; nearly all others are certainly alone.
    """

    def __init__(self, signed: DataFrame, nodes: DataFrame):
        self.rows = signed.filter("doc_id is not null")
        again = nodes.filter("node is not null").groupBy("node").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("node").alias("mark"))
        marks = nodes.filter("copies > 1").select(F.xxhash64("of").alias("mark")).union(again)
        self.copied = signed.sparkSession.sparkContext.broadcast(possible(marks, "mark", BITMAP_BITS))
        columns = ["doc_id", "key", "point", "parity", "sigs"]
        several = self._picked(columns, True, None).join(nodes, (F.col("key") == F.col("of")) & (F.col("doc_id") == F.col("node")))
        self.several = cut(several.select("node", *columns[2:]).dropDuplicates(["node"]))

    def _picked(self, columns: list[str], copied: bool, marked: Broadcast | None) -> DataFrame:
        bitmap = self.copied

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_numpy()
                keep = (bitmap.value[slot(ids, BITMAP_BITS)] | bitmap.value[slot(batch.column("mark").to_numpy(), BITMAP_BITS)]) == copied
                if marked is not None:
                    keep &= marked.value[slot(ids, BITMAP_BITS)]
                yield batch.select(columns).filter(pa.array(keep))

        rows = self.rows.select(*columns, F.xxhash64("key").alias("mark"))
        return rows.mapInArrow(run, self.rows.select(*columns).schema)

    def take(self, *columns: str, of: DataFrame | None = None) -> DataFrame:
        """node and the named columns; with `of`, of the nodes in it, found by a bitmap, and few others."""
        marked = None if of is None else self.rows.sparkSession.sparkContext.broadcast(possible(of, "node", BITMAP_BITS))
        single = self._picked(["doc_id", *columns], False, marked)
        return single.withColumnRenamed("doc_id", "node").union(self.several.select("node", *columns))


def enough(shared: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these summed sizes that share so much are similar."""
    return (100 + percent) * shared >= percent * sizes


def tighter(bound: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bound of what two sets of these summed sizes share, lowered to what their parities allow."""
    return np.minimum(bound, (sizes - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)) // 2)


class RTree:
    """Points in leaves of at most `leaf`, split at the median of the widest coordinate; nodes know their upper corner and smallest size."""

    def __init__(self, point: np.ndarray, leaf: int = LEAF):
        self.order, self.point, self.size = np.arange(len(point)), point, point.sum(axis=1, dtype=np.int64)
        self.first, self.last, self.child, self.high, self.least = [], [], [], [], []
        todo = [(0, len(point), -1)]
        while todo:
            a, b, parent = todo.pop()
            own, number = self.order[a:b], len(self.first)
            inside = point[own]
            self.first.append(a)
            self.last.append(b)
            self.child.append([])
            self.high.append(inside.max(axis=0))
            self.least.append(int(self.size[own].min()))
            if parent >= 0:
                self.child[parent].append(number)
            if b - a > leaf:
                spread = inside.max(axis=0).astype(np.int64) - inside.min(axis=0)
                mid = (b - a) // 2
                self.order[a:b] = own[np.argpartition(inside[:, int(spread.argmax())], mid)]
                todo += [(a, a + mid, number), (a + mid, b, number)]
        self.high, self.least = np.array(self.high), np.array(self.least)

    def close_pairs(self, percent: int, apart) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of points (each once) that may be similar, with the bound of what they share; `apart(i, j)` says which pairs count."""
        pairs = [(0, 0)]
        while pairs:
            a, b = np.array(pairs[:4096]).T
            del pairs[:4096]
            bound = np.minimum(self.high[a], self.high[b]).sum(axis=1, dtype=np.int64)
            for x, y in zip(*(z[enough(bound, self.least[a] + self.least[b], percent)].tolist() for z in (a, b)), strict=True):
                left, right = self.child[x], self.child[y]
                if not left and not right:
                    yield from self._leaves(x, y, percent, apart)
                elif x == y:
                    pairs += [(left[0], left[0]), (left[0], left[1]), (left[1], left[1])]
                else:
                    pairs += [(c, y) for c in left] if left and (not right or self.last[x] - self.first[x] >= self.last[y] - self.first[y]) else [(x, c) for c in right]

    def _leaves(self, x: int, y: int, percent: int, apart) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        i, j = self.order[self.first[x] : self.last[x]], self.order[self.first[y] : self.last[y]]
        i, j = np.repeat(i, len(j)), np.tile(j, len(i))
        some = apart(i, j) & (i < j if x == y else True)
        i, j = i[some], j[some]
        if len(i):
            bound = np.minimum(self.point[i], self.point[j]).sum(axis=1, dtype=np.int64)
            good = enough(bound, self.size[i] + self.size[j], percent)
            yield i[good], j[good], bound[good]


def cells_of(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """One batch per run of equal keys of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
            change[0] |= not held or held[-1].column(k)[held[-1].num_rows - 1].as_py() != v[0]
        marks = [*np.flatnonzero(change).tolist(), batch.num_rows]
        if held and marks[0] > 0:
            held.append(batch.slice(0, marks[0]))
        for a, b in zip(marks, marks[1:], strict=False):
            if held:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def tree_pairs(left: DataFrame, sketch: DataFrame, nearest: bool, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """Pairs (u, v) of different components that share a cell and may be similar; with `nearest` only each set's likeliest partner in a cell."""
    blocks = left.groupBy("sig").agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks")).withColumnRenamed("sig", "s")
    rows = left.join(blocks, F.col("sig") == F.col("s")).drop("s").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    rows = rows.join(sketch.select(F.col("node").alias("n"), "point", "parity"), F.col("node") == F.col("n")).select("sig", "one", "two", "node", "label", "block", "point", "parity")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, n = [], [], 0
        for part in cells_of(batches, "sig", "one", "two"):
            node, label, block = (part.column(c).to_numpy() for c in ("node", "label", "block"))
            crossing = part.column("one")[0] != part.column("two")[0]
            tree = RTree(unpacked_points(part.column("point")))
            apart = lambda i, j: (label[i] != label[j]) & ((block[i] != block[j]) if crossing else True)  # noqa: B023, E731
            parity, found = unpacked(part.column("parity"), np.uint64, PARITIES), []
            for i, j, bound in tree.close_pairs(percent, apart):
                sizes = tree.size[i] + tree.size[j]
                bound = tighter(bound, sizes, parity[i], parity[j])
                good = enough(bound, sizes, percent)
                if good.any():
                    found.append((i[good], j[good], bound[good]))
            if not found:
                continue
            i, j, bound = (np.concatenate(x) for x in zip(*found, strict=True))
            if nearest:
                slack = (100 + percent) * bound - percent * (tree.size[i] + tree.size[j])
                who, partner, slack = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([slack, slack])
                order = np.lexsort((node[partner], -slack, who))
                _, best = np.unique(who[order], return_index=True)
                i, j = who[order][best], partner[order][best]
            u.append(np.maximum(node[i], node[j]))
            v.append(np.minimum(node[i], node[j]))
            n += len(i)
            if n > 100_000:
                yield record(u=np.concatenate(u), v=np.concatenate(v))
                u, v, n = [], [], 0
        if u:
            yield record(u=np.concatenate(u), v=np.concatenate(v))

    return rows.repartition("sig", "one", "two").sortWithinPartitions("sig", "one", "two").mapInArrow(run, "u long, v long").distinct()


def near(pairs: DataFrame, sketch: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose points and parities allow a link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (unpacked_points(batch.column(c)) for c in ("a", "b"))
            p, q = (unpacked(batch.column(c), np.uint64, PARITIES) for c in ("p", "q"))
            sizes = a.sum(axis=1) + b.sum(axis=1)
            good = pa.array(enough(tighter(np.minimum(a, b).sum(axis=1), sizes, p, q), sizes, percent))
            yield record(u=batch.column("u").filter(good), v=batch.column("v").filter(good))

    both = pairs.join(sketch.select(F.col("node").alias("x"), F.col("point").alias("a"), F.col("parity").alias("p")), F.col("u") == F.col("x")).join(sketch.select(F.col("node").alias("y"), F.col("point").alias("b"), F.col("parity").alias("q")), F.col("v") == F.col("y"))
    return both.select("u", "v", "a", "b", "p", "q").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of documents whose whole sets are similar."""
    marked = docs.sparkSession.sparkContext.broadcast(possible(pairs.select(F.explode(F.array("u", "v")).alias("node")), "node", BITMAP_BITS))

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(marked.value[slot(ids, BITMAP_BITS)]))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for half in portions(batches, "a", 1_500_000) for part in portions([half], "b", 1_500_000)):
            good, sides = [], []
            for side in "ab":
                value, owner = shingle_sets(batch.column(side), width)
                marks = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
                sides.append([value[i:j] for i, j in zip(marks, marks[1:], strict=False)])
            for a, b in zip(*sides, strict=True):
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                shared = int((b[at] == a).sum())
                good.append(100 * shared >= percent * (len(a) + len(b) - shared))
            kept = pa.array(good, pa.bool_())
            yield record(u=batch.column("u").filter(kept), v=batch.column("v").filter(kept))

    # texts are less to move than the hashes of their shingles; one shuffle serves both sides
    found = plain(docs, "doc_id", "text").filter("doc_id is not null").mapInArrow(texts, "id long, text string").dropDuplicates(["id"])
    both = pairs.join(found.select(F.col("id").alias("x"), F.col("text").alias("a")), F.col("u") == F.col("x")).join(found.select(F.col("id").alias("y"), F.col("text").alias("b")), F.col("v") == F.col("y"))
    return both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def unsettled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, node, label) of the cells that hold more than one component, and each node's link to its label, which stand for all links."""
    found = components(links)
    known = members.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select(F.col("sig").alias("s"))
    return cut(known.join(mixed, F.col("sig") == F.col("s"), "left_semi")), found.select(F.col("node").alias("u"), F.col("label").alias("v"))


def open_pairs(left: DataFrame) -> int:
    """How many pairs of different components the cells hold."""
    sizes = left.groupBy("sig", "label").agg(F.count("*").cast("double").alias("n")).groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return int(sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0] or 0)


def shingle_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, groups: int = GROUPS, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every document."""
    signed = table(sign(docs, width, percent, groups), "signed")
    nodes = table(signed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).withColumnRenamed("key", "of"), "nodes")
    sketches = Sketches(signed, nodes)
    # a set without bundles is too small to be like another one
    members = cut(shared_cells(sketches.take("sigs").select("node", F.explode("sigs").alias("sig"))))
    sketch = cut(sketches.take("point", "parity", of=members))
    stars = members.filter("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()
    links = cut(verified(cut(near(stars, sketch, percent)), docs, width, percent))
    left, links = unsettled(members, links)
    if open_pairs(left) > 4 * left.count():
        links = cut(links.union(verified(cut(tree_pairs(left, sketch, True, percent, cell)), docs, width, percent)))
        left, links = unsettled(members, links)
    final = components(links.union(verified(cut(tree_pairs(left, sketch, False, percent, cell)), docs, width, percent))).withColumnRenamed("node", "n_")
    classes = nodes.join(final, F.col("node") == F.col("n_"), "left").select("of", F.coalesce("label", "node").alias("found"))
    out = signed.select("doc_id", "n", "key").join(classes, F.col("key") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("doc_id")).alias("component_id"))
