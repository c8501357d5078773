"""Matches of code patterns, exact by template and structural with gaps."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.functions.patterns import CONTROL, OPERATORS, with_template

#: Share of a pattern's tokens that must be met in order, and the longest match in lengths of the pattern.
THRESHOLD, LONGEST = 0.72, 2.5


def template_groups(df: DataFrame, code: str, by: list[str]) -> DataFrame:
    """Codes that agree but for local names and literals: ``template_key, template_length, members, variants``.

    Rows with a null code take no part.  Only hashes are shuffled.
    """
    keyed = with_template(df.where(F.col(code).isNotNull()), code)
    rows = keyed.select(*by, F.xxhash64("template").alias("template_key"), F.size("template").alias("template_length"), F.xxhash64("tokens").alias("_exact"))
    return rows.groupBy(*by, "template_key", "template_length").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("_exact").alias("variants"))


def structural_matches(patterns: DataFrame, candidates: DataFrame) -> DataFrame:
    """``pattern_id, candidate_id, share`` of candidates that follow a pattern with gaps.

    Both sides have an id (``pattern_id``, ``candidate_id``) and ``code``.  A match
    has all the pattern's anchors, control words and operators, is at most 2.5 times
    as long, and meets at least 0.72 of its tokens in order.  The join key is the
    pattern's rarest anchor among the candidates; a pattern without anchors, and
    null codes, match nothing.
    """
    p = with_template(patterns.where("code is not null").select("pattern_id", "code"), "code").where("size(anchors) > 0").select("pattern_id", F.col("template").alias("p"), F.col("anchors").alias("p_anchors"))
    c = with_template(candidates.where("code is not null").select("candidate_id", "code"), "code").select("candidate_id", F.col("template").alias("c"), "anchors")
    postings = c.select(F.explode("anchors").alias("anchor"), "candidate_id")
    counts = postings.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    rarest = p.select("pattern_id", F.explode("p_anchors").alias("anchor")).join(counts, "anchor", "left").groupBy("pattern_id").agg(F.min_by("anchor", F.struct(F.coalesce("n", F.lit(0)), "anchor")).alias("anchor"))
    met = p.join(rarest, "pattern_id").join(postings, "anchor").join(c, "candidate_id")
    within = lambda words: F.size(F.array_except(F.array_intersect("p", F.array(*map(F.lit, words))), "c")) == 0
    met = met.where((F.size("c") > 0) & (F.size("c") <= LONGEST * F.size("p")) & (F.size(F.array_except("p_anchors", "anchors")) == 0)).where(within(CONTROL) & within(OPERATORS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [
                sum(b.size for b in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], ["pattern_id", "candidate_id", "share"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    scored = met.select("pattern_id", "candidate_id", "p", "c").mapInArrow(score, f"pattern_id {kinds['pattern_id']}, candidate_id {kinds['candidate_id']}, share double")
    return scored.where(F.col("share") >= THRESHOLD)
