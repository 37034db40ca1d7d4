"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Unigrams and bigrams of every whole text, over its runs of letters and its runs of
other marks, case kept, fall into a fixed number of buckets. Two multinomials are counted over all documents: the raw corpus and
the trusted target. A document's score is the mean over its n-grams of
log(p_target / p_raw), and the verdict compares that mean with one threshold.

The base rules take words as runs of characters other than space and \\t\\n\\v\\f\\r.

Defined results: null or empty text has zero counts, fails the base rules and
scores 0; a null doc_id is kept as null; repeated rows give repeated results; an
empty table gives no rows; without any trusted document every score is 0 and
only the base rules decide; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PACKED, packed, plain, portions, record, summed
from .words import LETTERS_AND_MARKS, LINES, WORDS, Tokens, bytes_of, counted, keyed, tokens, windows

#: Parameters: n-gram buckets (the size of everything sent to the driver or broadcast), the additive
#: smoothing of each bucket, and the least mean log-likelihood ratio a document must reach.
BUCKETS = 1 << 16
SMOOTHING = 1.0
THRESHOLD = -0.5
#: Bytes of text that are counted at a time.
PORTION = 1_500_000

# The base rules: fixed values
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS)] = True

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each unigram and bigram of a batch of texts, and the text it is in."""
    t = tokens(data, offsets, LETTERS_AND_MARKS)
    pairs, at = windows(t, 2)
    return (np.concatenate([t.hash, pairs]) & np.uint64(size - 1)).astype(np.int64), np.concatenate([t.owner, t.owner[at]])


def repeated_words(words: Tokens, texts: int, width: int = WINDOW) -> np.ndarray:
    """How many words of each text lie in a window of `width` words that the text holds more than once."""
    value, at = windows(words, width)
    if not len(value):
        return np.zeros(texts, np.int64)
    value = keyed(value, words.owner[at])
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    change = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + width, -1)
    return np.bincount(words.owner[np.cumsum(change)[:-1] > 0], minlength=texts)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base rules' counts of each text of a batch."""
    texts, words, lines = len(offsets) - 1, tokens(data, offsets, WORDS), tokens(data, offsets, LINES)
    inside = WORDS[data] > 0
    filled = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside, dtype=np.int64)])
    real = filled[lines.end] > filled[lines.start]
    owner = lines.owner[real]
    _, first = np.unique(keyed(lines.hash[real], owner), return_index=True)
    return {
        "n_words": words.per_owner(texts),
        "word_chars": counted(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": counted(SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(owner, minlength=texts) - np.bincount(owner[first], minlength=texts),
        "n_repeat_words": repeated_words(words, texts),
    }


def multinomials(docs: DataFrame, trusted: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """Bucket counts over all documents: the raw corpus in the first half, the target in the second."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in portions(batches, size=PORTION):
            bucket, owner = ngram_buckets(*bytes_of(batch.column("text")), size)
            good = batch.column("good").to_numpy(zero_copy_only=False)
            total[:size] += np.bincount(bucket, minlength=size)
            total[size:] += np.bincount(bucket[good[owner]], minlength=size)
        yield from packed(total)

    marks = trusted.select(F.col("doc_id").alias("good_id")).dropna().distinct()
    rows = plain(docs, "doc_id", "text")
    # labels grow with the documents: the plan is the same shuffled join at every size
    rows = rows.join(marks.hint("merge"), rows["doc_id"] == marks["good_id"], "left").select("text", F.col("good_id").isNotNull().alias("good"))
    return summed(rows.mapInArrow(count, PACKED), 2 * size)


def log_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(p_target / p_raw) of each bucket; zeros where there is no trusted text."""
    raw, target = np.split(counts.astype(np.float64), 2)
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + smoothing) / (target.sum() + smoothing * len(raw))) - np.log((raw + smoothing) / (raw.sum() + smoothing * len(raw)))


def verdicts(column: pa.Array, ratio: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """Base counts, mean log-likelihood ratio and verdict of each whole text of a batch."""
    data, offsets = bytes_of(column)
    bucket, owner = ngram_buckets(data, offsets, len(ratio))
    n, out = np.bincount(owner, minlength=len(column)), base_counts(data, offsets)
    out["score"] = np.bincount(owner, ratio[bucket], minlength=len(column)) / np.maximum(n, 1)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, size: int = BUCKETS) -> DataFrame:
    """One row per document with its base counts, its score and the verdict. `trusted` names the target's doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(multinomials(docs, trusted, size)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, size=PORTION):
            yield record(doc_id=batch.column("doc_id"), **verdicts(batch.column("text"), shared.value, threshold))

    return plain(docs, "doc_id", "text").mapInArrow(run, RESULT)


def kept_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, size: int = BUCKETS) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(log_ratios(multinomials(docs, trusted, size))), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions([batch], batch.schema.names[at], PORTION):
                yield part.filter(pa.array(verdicts(pc.fill_null(part.column(at), ""), shared.value, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The target: documents that are marked as good and nowhere as bad."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
