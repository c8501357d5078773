"""Source files that do not parse, flagged per file and rated per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm.grammars import classify
from quarryline.llm.provenance import source_texts


def verdicts_of(texts: DataFrame) -> DataFrame:
    """``file_id, repository, verdict, detail`` of each file id of ``source_texts``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v for v, _ in found], pa.string()), pa.array([d for _, d in found], pa.string())], ["file_id", "repository", "verdict", "detail"])

    found = texts.select("file_id", "repository", "text").mapInArrow(judge, "file_id long, repository string, verdict string, detail string")
    return found.groupBy("file_id").agg(F.max("repository").alias("repository"), F.min("verdict").alias("verdict"), F.min_by("detail", "verdict").alias("detail"))


def syntax_verdicts(files: DataFrame) -> DataFrame:
    """``file_id, repository, verdict, detail`` of every file with a text that isn't blank.

    ``verdict`` is ``valid``, ``foreign`` (another language's grammar accepts the
    text; ``detail`` names it) or ``corrupt`` (no grammar does; ``detail`` says what
    fails in C++).  Null ids and null, empty or blank texts give no row.
    Deliveries of one file give one row; extra columns are ignored.
    """
    return verdicts_of(source_texts(files))


def unparsable_files(files: DataFrame) -> DataFrame:
    """``file_id`` of the files whose text isn't C++ that can be parsed."""
    return syntax_verdicts(files).where("verdict != 'valid'").select("file_id")


def syntax_report(files: DataFrame, evidence: DataFrame, lexical: DataFrame) -> DataFrame:
    """Rates per repository and language, with the recorded evidence beside them.

    ``recorded_errors``: files whose latest record shows errors that do not come
    from macros, or a failed status; ``recorded_invalid``: files with a function
    recorded as not parsed; ``agreed``: invalid files that either record names.
    """
    verdicts = syntax_verdicts(files).withColumn("language", F.when(F.col("verdict") == "foreign", F.col("detail")).otherwise("c++"))
    latest = evidence.where("file_id is not null").groupBy("file_id").agg(F.max_by(F.struct("status", "error_ranges", "macro_related_error_count"), "scanned_at").alias("r"))
    errors = F.coalesce(F.size("r.error_ranges") > F.coalesce("r.macro_related_error_count", F.lit(0)), F.lit(False))
    recorded = latest.select("file_id", (errors | F.lower("r.status").isin("failed", "error", "read_error")).alias("recorded_error"))
    lexed = lexical.where("file_id is not null").groupBy("file_id").agg(F.bool_or(~F.col("parse_valid")).alias("recorded_invalid"))
    joined = verdicts.join(recorded, "file_id", "left").join(lexed, "file_id", "left")
    bad = F.col("verdict") != "valid"
    a, b = F.coalesce("recorded_error", F.lit(False)), F.coalesce("recorded_invalid", F.lit(False))
    return joined.groupBy("repository", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(bad).alias("invalid"),
        F.count_if(a).alias("recorded_errors"),
        F.count_if(b).alias("recorded_invalid"),
        F.count_if(bad & (a | b)).alias("agreed"),
    ).withColumn("rate", F.col("invalid") / F.col("files"))
