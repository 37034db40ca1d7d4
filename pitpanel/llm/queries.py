"""The operators as registered queries over the given tables, with their SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import alignment_counts
from .exact_dedup import exact_dedup
from .line_dedup import removed_lines
from .near_dedup import near_classes
from .packing import pack
from .piece_codec import round_trip
from .pii import findings
from .quality_classifier import classify, fit, training_sample
from .quality_rules import quality_rules, trusted_ids
from .shingle_join import shingle_components
from .token_counts import token_counts
from .warc import archive_pages
from .whitening import whiten


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The mixture that is packed: token proportions follow the sources' sizes to this power.
MIXTURE = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classify(docs, fit(training_sample(docs, _table(spark, sf_dir, "labels"))))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(_table(spark, sf_dir, "documents"))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents"))


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), temper=MIXTURE)


def op10_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), trusted_ids(_table(spark, sf_dir, "labels")))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(_table(spark, sf_dir, "documents"))


def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_rule_ensemble, op2_feistel_pseudonyms, op3_token_counts, op4_exact_dedup, op5_piece_round_trip, op6_line_join, op7_bag_minhash, op8_warc_normaliser, op9_mixture_packing, op10_target_ratio, op11_block_whitening, op12_vector_rtree, op13_merge_path)
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
    """,
}
