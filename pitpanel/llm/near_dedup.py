"""Near-duplicate detection with BagMinHash signatures over the multiset of word shingles.

Every shingle of `WIDTH` words owns a hierarchy of Poisson processes over its
discretised weight: one process for the unit [0, 1) and one for each dyadic range
[2^j, 2^(j+1)), of rate 2^j, whose points carry their place in the range and a
register. A shingle that occurs c times shows the points below c. Each register
keeps the earliest point it meets, so two documents agree in a register with
exactly the probability of their weighted Jaccard similarity. The processes are
run in time order only until all registers are full, for a whole batch of documents
at once in numpy.

Bands of registers propose pairs, weights and parities (every shingle of a bag flips
one of 1024) drop those that cannot be links, and the multisets themselves decide: a
link is a weighted Jaccard similarity of `SIMILARITY` or more. Equal multisets are one
node. In a bucket each node is first compared with the smallest, then with a few random
ones; the links' components are formed; then only nodes of one bucket that are still in
different components are compared, all of them. So a group of thousands of copies costs about one
comparison for each, and no link that a bucket proposes is left out of the classes.

Classes are the connected components of the links; class_id is the smallest
doc_id. Defined results: texts without words (null, empty, blank) are linked to nothing and
are their own class; fewer words than a shingle are one shingle; null ids join the class of their
text, and have a null class if nothing else is in it; rows that repeat an id are one
document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import GOLDEN, components, cut, mix, plain, portions, possible, record, slot
from .words import WORDS, bytes_of, tokens, windows

#: Parameters: words of a shingle, least similarity of a link, bands and their registers (at similarity 0.8 a pair
#: shares no band with probability 5e-5), bits of the bitmap of candidate documents.
WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
BITMAP_BITS = 23
#: Turns of comparing with one other node of a bucket before all remaining pairs of components are compared.
TURNS = 1

PARITIES = 16  # words of 64 parities
SIGNED = "doc_id long, text_hash long, key binary, weight long, bands array<long>, " + ", ".join(f"p{i} long" for i in range(PARITIES))


def bags(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and texts (by number, in order) of the shingles of a batch of texts."""
    words = tokens(*bytes_of(column), WORDS)
    value, at = windows(words, width)
    owner, n = words.owner[at], words.per_owner(len(column))
    few = np.flatnonzero((n > 0) & (n < width))  # all their words are one shingle
    if few.size:
        ends = np.cumsum(n)
        own = np.array([xxhash.xxh3_64_intdigest(words.hash[ends[i] - n[i] : ends[i]].tobytes()) for i in few], np.uint64)
        value, owner = np.concatenate([value, own]), np.concatenate([owner, few])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])) if len(value) else np.zeros(0, np.int64)
    return value[first], np.diff(np.append(first, len(value))), owner[first]


def parities(element: np.ndarray, count: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Parities of each text's bag: every shingle flips one of them, so two bags differ in at least as many shingles as parities."""
    out, odd = np.zeros((texts, PARITIES), np.uint64), (count & 1) == 1
    with np.errstate(over="ignore"):
        bit = mix(element[odd] + GOLDEN) & np.uint64(64 * PARITIES - 1)
    np.bitwise_xor.at(out, (owner[odd], (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def packed_bags(element: np.ndarray, count: np.ndarray, owner: np.ndarray, texts: int) -> list[bytes]:
    """Each text's bag as bytes: its hashes in order, then its counts."""
    marks = np.searchsorted(owner, np.arange(texts + 1)).tolist()
    weight = count.astype(np.uint64)
    return [element[a:b].tobytes() + weight[a:b].tobytes() for a, b in zip(marks, marks[1:], strict=False)]


def bag_minhash(element: np.ndarray, count: np.ndarray, owner: np.ndarray, owners: int, registers: int) -> np.ndarray:
    """Signatures (owners x registers) of bags given as flat arrays; every owner must have an element."""
    # the processes: (element, low end of the range, rate)
    which, low, rate, j = [np.arange(len(element))], [np.zeros(len(element))], [np.ones(len(element))], 0
    while (more := np.flatnonzero(count > (1 << j))).size:
        which.append(more)
        low.append(np.full(len(more), float(1 << j)))
        rate.append(np.full(len(more), float(1 << j)))
        j += 1
    process = np.concatenate([np.full(len(w), k, np.uint64) for k, w in enumerate(which)])
    which, low, rate = np.concatenate(which), np.concatenate(low), np.concatenate(rate)
    owner, count = owner[which], count[which]
    with np.errstate(over="ignore"):
        seed = mix(element[which] + GOLDEN * (process + np.uint64(1)))
        total = np.bincount(owner, np.minimum(rate, count - low), minlength=owners)
        until = registers * (np.log(registers) + 1) / total
        best = np.full(owners * registers, np.inf)

        def draw(at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bits = mix(seed[at] + GOLDEN * number.astype(np.uint64))
            return bits, -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740993.0) / rate[at]

        active, number = np.arange(len(seed)), np.zeros(len(seed), np.int64)
        bits, time = draw(active, number)
        while True:
            hits = np.flatnonzero(time < until[owner])
            while hits.size:
                spot = mix(bits[hits] ^ GOLDEN)
                place = low[hits] + np.floor((spot >> np.uint64(40)).astype(np.float64) / 16777216.0 * rate[hits])
                seen = hits[place < count[hits]]
                register = ((spot & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)[place < count[hits]]
                np.minimum.at(best, owner[seen] * registers + register, time[seen])
                number[hits] += 1
                bits[hits], step = draw(hits, number[hits])
                time[hits] += step
                hits = hits[time[hits] < until[owner[hits]]]
            empty = np.isinf(best.reshape(owners, registers)).any(axis=1)
            if not empty.any():
                return best.reshape(owners, registers).view(np.uint64)
            until[empty] *= 2


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix(h * GOLDEN + parts[:, :, r])
    return h.view(np.int64)


def sign(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, identity and weight of the bag, and band hashes of every document; without words all but doc_id is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, size=1_500_000):
            element, count, owner = bags(batch.column("text"), width)
            some, number = np.unique(owner, return_inverse=True)
            keys, weights, lists = ([None] * batch.num_rows for _ in range(3))
            if some.size:
                hashes = band_hashes(bag_minhash(element, count, number, len(some), bands * rows), bands, rows)
                bag, total = packed_bags(element, count, owner, batch.num_rows), np.bincount(number, count)
                for k, i in enumerate(some.tolist()):
                    keys[i], weights[i], lists[i] = xxhash.xxh3_128_digest(bag[i]), int(total[k]), hashes[k]
            parity = parities(element, count, owner, batch.num_rows)
            yield record(
                doc_id=batch.column("doc_id"), text_hash=batch.column("text_hash"), key=pa.array(keys, pa.binary()), weight=pa.array(weights, pa.int64()), bands=pa.array(lists, pa.list_(pa.int64())),
                **{f"p{i}": np.ascontiguousarray(parity[:, i]) for i in range(PARITIES)},
            )

    return plain(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNED)


def bags_of(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, bag) of the documents whose id is among `nodes`, found by a bitmap of fixed size; few others may come along."""
    marked = docs.sparkSession.sparkContext.broadcast(possible(nodes, "node", BITMAP_BITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part in portions([batch.filter(pa.array(marked.value[slot(ids, BITMAP_BITS)]))]):
                yield record(id=part.column("doc_id"), bag=pa.array(packed_bags(*bags(part.column("text"), width), part.num_rows), pa.binary()))

    return plain(docs, "doc_id", "text").filter("doc_id is not null").mapInArrow(run, "id long, bag binary")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    (ea, na), (eb, nb) = (np.frombuffer(x, np.uint64).reshape(2, -1) for x in (a, b))
    at = np.searchsorted(eb, ea)
    at[at == len(eb)] = 0
    both = eb[at] == ea
    shared = int(np.minimum(na[both], nb[at[both]]).sum())
    return shared / (int(na.sum()) + int(nb.sum()) - shared)


def verified(pairs: DataFrame, docs: DataFrame, least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The pairs (u, v) of documents whose bags are similar enough."""
    bag = cut(bags_of(docs, pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))), width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "a"):
            good = [similarity(a.as_buffer(), b.as_buffer()) >= least for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            kept = batch.filter(pa.array(good))
            yield record(u=kept.column("u"), v=kept.column("v"))

    both = pairs.join(bag.select(F.col("id").alias("u"), F.col("bag").alias("a")), "u").join(bag.select(F.col("id").alias("v"), F.col("bag").alias("b")), "v")
    return both.mapInArrow(run, "u long, v long")


MEMBER = ("weight", *[f"p{i}" for i in range(PARITIES)])


def may_link(least: float) -> Column:
    """What weights and parities allow of the sides `a_` and `b_`: a test that no link fails."""
    flips = " + ".join(f"bit_count(a_p{i} ^ b_p{i})" for i in range(PARITIES))
    differ = F.expr(flips) * (1 + least) <= (F.col("a_weight") + F.col("b_weight")) * (1 - least + 1e-9)
    return differ & (F.col("a_weight") >= F.col("b_weight") * (least - 1e-9)) & (F.col("b_weight") >= F.col("a_weight") * (least - 1e-9))


def side(members: DataFrame, name: str, *more: str) -> DataFrame:
    return members.select(F.col("bucket").alias(f"{name}_bucket"), F.col("node").alias(f"{name}_node"), *[F.col(c).alias(f"{name}_{c}") for c in (*MEMBER, *more)])


def unsettled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members, with the label of their component, of buckets that hold more than one component; and each node's link to its label, which stand for all links."""
    found = components(links)
    label = found.withColumnRenamed("node", "n")
    known = members.join(label, F.col("node") == F.col("n"), "left").select("bucket", "node", *MEMBER, F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select(F.col("bucket").alias("b"))
    return cut(known.join(mixed, F.col("bucket") == F.col("b"), "left_semi")), found.select(F.col("node").alias("u"), F.col("label").alias("v"))


def open_pairs(left: DataFrame) -> int:
    """How many pairs of different components the buckets hold."""
    sizes = left.groupBy("bucket", "label").agg(F.count("*").cast("double").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return int(sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0] or 0)


def near_classes(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, kept and a hash of the text of every document; the smallest doc_id of a class is kept."""
    signed = cut(sign(docs, width, bands, rows))
    nodes = signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("node")).withColumnRenamed("key", "of")
    of_node = (F.col("key") == F.col("of")) & (F.col("doc_id") == F.col("node"))
    sketch = signed.join(nodes, of_node).select("node", "bands", *MEMBER).dropDuplicates(["node"])
    spread = sketch.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last").select(F.col("bucket").alias("b"), "lead")
    members = spread.join(shared, F.col("bucket") == F.col("b")).select("bucket", "node", "lead")
    members = cut(members.join(sketch.select(F.col("node").alias("n"), *MEMBER), F.col("node") == F.col("n")).drop("n"))
    # each node against the first of its buckets
    leads, others = side(members.filter("node = lead"), "b"), side(members.filter("node <> lead"), "a")
    stars = cut(others.join(leads, (F.col("a_bucket") == F.col("b_bucket")) & may_link(least)).select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct())
    links = cut(verified(stars, docs, least, width))
    # as long as the buckets hold many pairs of different components, each node against another, random one of its buckets
    left, links = unsettled(members, links)
    for turn in range(TURNS):
        count, pairs = left.count(), open_pairs(left)
        if pairs <= 4 * count:
            break
        pick = left.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pick")).withColumnRenamed("bucket", "b")
        leads = side(left.join(pick, (F.col("bucket") == F.col("b")) & (F.col("node") == F.col("pick"))), "b", "label")
        stars = side(left, "a", "label").join(leads, (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_label") != F.col("b_label")) & may_link(least))
        links = cut(links.union(verified(cut(stars.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct()), docs, least, width)))
        left, links = unsettled(members, links)
    # then all pairs of different components in a bucket
    apart = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
    # a pair counts in the smallest bucket that both nodes are in
    buckets = left.groupBy("node").agg(F.collect_set("bucket").alias("buckets")).withColumnRenamed("node", "n")
    left = left.join(buckets, F.col("node") == F.col("n")).drop("n")
    here = F.array_min(F.array_intersect("a_buckets", "b_buckets")) == F.col("a_bucket")
    cross = side(left, "a", "label", "buckets").join(side(left, "b", "label", "buckets"), apart & may_link(least) & here).select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct()
    final = components(links.union(verified(cut(cross), docs, least, width))).withColumnRenamed("node", "n")
    classes = nodes.join(final, F.col("node") == F.col("n"), "left").select("of", F.coalesce("label", "node").alias("class_id"))
    found = signed.select("doc_id", "text_hash", "key").join(classes, F.col("key") == F.col("of"), "left")
    found = found.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "text_hash")
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "text_hash")
