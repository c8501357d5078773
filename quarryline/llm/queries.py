"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarryline.llm import leaks, overlaps, provenance, quality, splits, syntax, tokens, vectors
from quarryline.llm.oracles import ORACLES  # noqa: F401  registered beside QUERIES
from quarryline.plans.lineage import spread, table as scanned


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows the Python stages of all cores share, also where it is one small file."""
    return spread(scanned(spark, folder, name))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.similarity_clusters(table(spark, folder, "embedding"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.cluster_report(table(spark, folder, "embedding"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.neighbour_pairs(table(spark, folder, "embedding"))


def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest fragments, at any distance, of every fragment whose id is divisible by 100."""
    return vectors.nearest_search(table(spark, folder, "embedding"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.grouped_files(table(spark, folder, "dataset"), table(spark, folder, "repo_aliases"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.grouped_splits(table(spark, folder, "dataset"), table(spark, folder, "repo_aliases"), table(spark, folder, "split_plan"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps.overlapping_files(table(spark, folder, "dataset"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps.overlap_report(table(spark, folder, "dataset"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p7_use(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.vocabulary_use(table(spark, folder, "documents"))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The digest and length of every text as its ids decode: those of the text itself."""
    found = tokens.decode_corpus(tokens.encode_corpus(table(spark, folder, "documents")))
    return found.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("characters"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The longest verbatim match of each document with each item it holds, and where it begins in both."""
    return leaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each source when the affected documents are removed."""
    kept = leaks.clean_corpus(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("characters"), F.sum("doc_id").alias("id_sum"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.not_hand_written(table(spark, folder, "dataset"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.provenance_report(table(spark, folder, "dataset"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.unparsable_files(table(spark, folder, "dataset"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.syntax_report(table(spark, folder, "dataset"), table(spark, folder, "source_evidence"), table(spark, folder, "cpp_lexical_analysis"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.other_than_prose(table(spark, folder, "documents"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_statistics(table(spark, folder, "documents"))


def p9_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """The plain counts and ratios among the statistics."""
    found = quality.text_statistics(table(spark, folder, "documents"))
    return found.select("doc_id", "words", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "ended_lines", "common_words")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_splits, p3_found, p3_report, p4_found, p4_nearest, p5_found, p5_report, p6_found, p6_report, p7_ids, p7_use, p7_decoded, p8_found, p8_passages, p8_report, p8_clean, p9_found, p9_statistics, p9_ratios)}
