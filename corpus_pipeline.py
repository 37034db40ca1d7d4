"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, pseudonyms, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns of
documents. Rows keep their other columns; `text` changes where lines go or values
are replaced, and `n_chars`, where present, is brought up to date with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm.line_dedup import without_lines
from pitpanel.llm.near_dedup import near_classes
from pitpanel.llm.packing import pack
from pitpanel.llm.pii import KINDS, pseudonymise
from pitpanel.llm.quality_rules import kept_documents, trusted_ids
from pitpanel.llm.queries import vocabulary
from pitpanel.llm.shared import shared_dir

#: SQL cannot express hashed likelihood ratios, signatures, Feistel networks or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted target is what labels mark as good."""
    return kept_documents(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat earlier ones."""
    return _measured(without_lines(docs), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id. Rows are told apart by doc_id and text.

    Documents without words, such as copies of which line dedup left nothing, are equal texts: one of them stays too.
    """
    kept = near_classes(docs).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_text")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["_kept_text"])
    blank = ~F.coalesce(docs["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = docs.filter(blank).agg(F.min("doc_id")).scalar()  # one value
    return docs.join(kept, same, "left_semi").filter(~blank | F.col("doc_id").eqNullSafe(first))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by pseudonyms."""
    columns = docs.columns
    clash = [c for c in columns if c in {f"pii_{k}" for k in KINDS}]
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    out = pseudonymise(renamed).select(*renamed.columns).withColumnsRenamed({f"_own_{c}": c for c in clash})
    return _measured(out, columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", rules_stage), ("line dedup", lines_stage), ("near dedup", near_stage), ("pseudonyms", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
