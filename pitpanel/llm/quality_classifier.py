"""Quality classifier: a sparse rule ensemble.

A random forest is grown on text statistics of labelled documents. Each path
from a root to a node is a conjunction of comparisons, a rule. A lasso logistic
regression over the rules keeps few of them, and those are compiled, with
their weights, into one Spark column expression that scores every document.

The statistics come from one Arrow pass over the whole text; fitting uses a bounded sample
of labelled rows (FIT_ROWS, documented), scoring all documents.

Defined results: null or empty text has all statistics 0 and gets a score like
any other; null ids are scored, and belong to the training rows never; documents
labelled more than once count as good only if all labels say so; without labels,
or with one class only, the score is the share of good labels (0.5 without any);
repeated rows give repeated results; an empty table gives no rows; other columns
of the input, `lang` and `source` among them, are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, plain, portions, record, utf8

#: Parameters: labelled rows that are fitted at most (chosen by hash), trees, depth, features tried, lasso strength.
FIT_ROWS = 20_000
TREES = 30
DEPTH = 3
LASSO = 0.002
SEED = 7

SYMBOLS = b"#*$%&|<>{}[]\\/~^_=+@"
STATISTICS = (
    "log_words", "mean_word", "longest_word", "unique_words", "top_word", "upper", "digits", "punctuation", "symbols", "not_ascii", "spaces", "entropy",
    "words_per_line", "repeated_lines", "short_lines", "ended_lines", "repeated_pairs", "marked_words", "exclamations", "bars", "capital_words", "one_letter_words",
)
CLASSES = np.zeros((8, 256), bool)
for _row, _bytes in enumerate((range(65, 91), range(48, 58), b".,;:!?'\"()-", SYMBOLS, range(128, 256), b" \t", b"!", b"|")):
    CLASSES[_row, list(_bytes)] = True


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    data = utf8(text)
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits, punctuation, symbols, high, spaces, marks, bars = (CLASSES @ seen / size).tolist()
    p = seen[seen > 0] / size
    lengths, counts = np.fromiter(map(len, words), np.int64, n), Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], strict=False))
    marked = sum(c for w, c in counts.items() if w[-1] in SYMBOLS or w[-1:] == b"!")
    capital = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    ended = sum(x.rstrip()[-1] in b".!?:;\"'" for x in lines)
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.max()), len(counts) / n, max(counts.values()) / n, upper, digits, punctuation, symbols, high, spaces, float(-(p * np.log2(p)).sum()),
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), ended / len(lines), (1 - len(pairs) / (n - 1)) if n > 1 else 0.0,
        marked / n, marks, bars, capital / n, float((lengths == 1).mean()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            values = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64).T
            yield record(doc_id=batch.column("doc_id"), **dict(zip(STATISTICS, values, strict=True)))

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: 1 marks what is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Statistics and label `y` of at most `rows` labelled documents that are not held out, chosen by a hash of the id."""
    marked = labels.filter(F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "y_id")
    near = docs.join(F.broadcast(chosen.select("y_id")), F.col("doc_id") == F.col("y_id"), "left_semi")
    found = with_statistics(near).join(F.broadcast(chosen), F.col("doc_id") == F.col("y_id")).drop("y_id")
    return cut(found)


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(description: str) -> list[Rule]:
    """All root-to-node paths of the trees in MLlib's printed form; a step is (statistic, at most?, bound)."""
    rules, path = [], []
    for line in description.splitlines():
        if "Tree" in line:
            path = []
        elif m := re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, (int(m[3]), m[4] == "<=", float(m[5])))]
            rules.append(tightened(x for _, x in path))
    return list(dict.fromkeys(rules))


def tightened(steps: Iterable[tuple[int, bool, float]]) -> Rule:
    """Of several bounds on one side of a statistic, only the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for i, upper, bound in steps:
        old = best.get((i, upper), bound)
        best[i, upper] = min(old, bound) if upper else max(old, bound)
    return tuple(sorted((i, upper, bound) for (i, upper), bound in best.items()))


def compiled(rule: Rule) -> Column:
    return reduce(and_, [F.col(STATISTICS[i]) <= bound if upper else F.col(STATISTICS[i]) > bound for i, upper, bound in rule])


class RuleEnsemble:
    """Weighted rules; `score` is the column expression."""

    def __init__(self, intercept: float, rules: list[tuple[float, Rule]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(compiled(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Grow the trees, extract their rules, and fit lasso logistic weights."""
    share, n = sample.agg(F.avg("y"), F.count("*")).first()
    if not n or share in (0.0, 1.0):
        p = min(max(0.5 if not n else share, 1e-3), 1 - 1e-3)
        return RuleEnsemble(math.log(p / (1 - p)), [])
    ready = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(sample.coalesce(8))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, maxBins=64, seed=SEED).fit(ready)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleEnsemble(math.log(share / (1 - share)), [])
    design = cut(sample.coalesce(8).select("y", array_to_vector(F.array(*[compiled(r).cast("double") for r in rules])).alias("x")))
    model = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=40).fit(design)
    weights = model.coefficients.toArray()
    return RuleEnsemble(model.intercept, [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6])


def classify(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    scored = with_statistics(docs).select("doc_id", held.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
