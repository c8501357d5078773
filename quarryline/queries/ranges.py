"""Queries on trees, extents and byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarryline.functions import text
from quarryline.operators import intervals, trees
from quarryline.plans.lineage import table
from quarryline.queries.files import first_rows, fragments_of, latest_evidence
from quarryline.queries.registry import FILES, FRAGMENTS, LATEST, Registry

_R = Registry()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_NODES = f"""{FILES},
functions AS (SELECT file_id, unnest(func_ast) AS tree, CAST(generate_subscripts(func_ast, 1) - 1 AS INT) AS func_idx FROM files),
nodes AS (SELECT file_id, func_idx, unnest(tree) AS node, CAST(generate_subscripts(tree, 1) - 1 AS INT) AS node_idx FROM functions)"""


def placed(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    return trees.placed_nodes(first_rows(spark, folder, "func_ast"), fields)


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    return trees.function_nodes(first_rows(spark, folder, "func_ast"))


@query(
    f"""WITH {_NODES} SELECT a.file_id, a.func_idx, a.node_idx, max(CASE WHEN b.node_idx < a.node_idx AND b.node.depth = a.node.depth - 1 THEN b.node_idx END) AS parent_idx,
    coalesce(min(CASE WHEN b.node_idx > a.node_idx AND b.node.depth <= a.node.depth THEN b.node_idx END), max(b.node_idx) + 1) - a.node_idx AS span
    FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND a.func_idx = b.func_idx GROUP BY a.file_id, a.func_idx, a.node_idx"""
)
def tree_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Parent and subtree rows of every node."""
    return placed(spark, folder).select("file_id", "func_idx", "node_idx", "parent_idx", "span")


@query(
    f"""WITH {_NODES}, parents AS (SELECT a.node.kind AS kind, arg_max(b.node.kind, b.node_idx) AS parent_kind FROM nodes a LEFT JOIN nodes b
    ON a.file_id = b.file_id AND a.func_idx = b.func_idx AND b.node_idx < a.node_idx AND b.node.depth = a.node.depth - 1 GROUP BY a.file_id, a.func_idx, a.node_idx, a.node.kind)
    SELECT kind, parent_kind, count(*) AS nodes FROM parents GROUP BY kind, parent_kind"""
)
def tree_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of nodes under kinds of parents."""
    return placed(spark, folder).groupBy("kind", "parent_kind").agg(F.count(F.lit(1)).alias("nodes"))


_KINDS = lambda kinds: ", ".join(f"'{k}'" for k in kinds)
_CANDIDATES = f"""{_NODES},
coded AS (SELECT file_id, func_idx, node_idx, node.kind AS kind, coalesce(node.subtree_size, 0) AS size, coalesce(node.ast_num, 0) AS kids, node.code_snippet AS code FROM nodes WHERE coalesce(node.code_snippet, '') <> ''),
roots AS (SELECT * FROM coded WHERE node_idx = 0 AND kind = 'function_definition' AND size >= 10),
inside AS (SELECT c.*, kind IN ({_KINDS(trees.REGION_KINDS)}) AND size >= 10 AS big FROM coded c SEMI JOIN roots USING (file_id, func_idx) WHERE c.node_idx > 0),
region AS (SELECT *, least(size, 500) AS a, -size AS b FROM inside WHERE big AND (kind = 'lambda_expression' OR kids >= 3)),
statement AS (SELECT *, CASE kind WHEN 'throw_statement' THEN 5 WHEN 'co_return_statement' THEN 5 WHEN 'return_statement' THEN 4 WHEN 'expression_statement' THEN 3 WHEN 'declaration' THEN 2 ELSE 1 END AS a, least(size, 120) AS b
  FROM inside WHERE NOT big AND kind IN ({_KINDS(trees.STATEMENT_KINDS)}) AND strlen(code) <= 4000 AND size >= CASE WHEN kind IN ({_KINDS(trees.JUMP_KINDS)}) THEN 3 ELSE 5 END),
both_ AS (SELECT 'region' AS level, * EXCLUDE (big) FROM region UNION ALL SELECT 'statement', * EXCLUDE (big) FROM statement),
heads AS (SELECT *, row_number() OVER (PARTITION BY level, file_id, func_idx, kind ORDER BY a DESC, b DESC, node_idx) AS head FROM both_),
ranked AS (SELECT *, row_number() OVER (PARTITION BY level, file_id, func_idx ORDER BY CASE WHEN head = 1 THEN 0 ELSE 1 END, a DESC, b DESC, node_idx) AS r FROM heads),
chosen AS (SELECT file_id, func_idx, node_idx, 'function' AS level FROM roots UNION ALL SELECT file_id, func_idx, node_idx, level FROM ranked WHERE r <= 2)"""


@query(f"WITH {_CANDIDATES} SELECT file_id, func_idx, node_idx, level FROM chosen")
def quality_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Functions, regions and statements worth keeping; of regions and statements the two most diverse."""
    return trees.quality_candidates(nodes_of(spark, folder))


@query(f"WITH {_CANDIDATES} SELECT corpus, level, count(*) AS candidates, count(DISTINCT chosen.file_id) AS files FROM chosen JOIN files USING (file_id) GROUP BY corpus, level")
def candidate_counts(spark: SparkSession, folder: str) -> DataFrame:
    chosen = trees.quality_candidates(nodes_of(spark, folder))
    corpora = first_rows(spark, folder, "corpus").select("file_id", "corpus")
    return chosen.join(corpora, "file_id").groupBy("corpus", "level").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("file_id").alias("files"))


def _ranges(evidence: DataFrame, column: str) -> DataFrame:
    return evidence.select("file_id", F.explode(column).alias("r")).select("file_id", F.col("r.start_byte").alias("start"), F.col("r.end_byte").alias("end"))


_RANGES = f"""{LATEST},
errors AS (SELECT file_id, unnest(error_ranges) AS r FROM latest), preprocessor AS (SELECT file_id, unnest(preprocessor_ranges) AS r FROM latest), missing AS (SELECT file_id, unnest(missing_ranges) AS r FROM latest)"""


@query(
    f"""WITH {_RANGES} SELECT file_id, count(*) AS errors FROM errors e WHERE EXISTS
    (SELECT 1 FROM preprocessor p WHERE p.file_id = e.file_id AND e.r.start_byte < p.r.end_byte AND p.r.start_byte < e.r.end_byte) GROUP BY file_id"""
)
def interval_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Errors that touch a preprocessor range, per file."""
    evidence = latest_evidence(spark, folder, "error_ranges", "preprocessor_ranges")
    found = intervals.overlapping(_ranges(evidence, "error_ranges"), _ranges(evidence, "preprocessor_ranges"), ["file_id"])
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("errors"))


@query(
    f"""WITH {_RANGES} SELECT file_id, count(*) AS errors FROM errors e WHERE NOT EXISTS
    (SELECT 1 FROM preprocessor p WHERE p.file_id = e.file_id AND p.r.start_byte <= e.r.start_byte AND e.r.end_byte <= p.r.end_byte) GROUP BY file_id"""
)
def containment_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Errors outside every preprocessor range, per file."""
    evidence = latest_evidence(spark, folder, "error_ranges", "preprocessor_ranges")
    found = intervals.not_contained(_ranges(evidence, "error_ranges"), _ranges(evidence, "preprocessor_ranges"), ["file_id"])
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("errors"))


_UNION = """marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT {by}, s, e FROM spans) WHERE s < e),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
joined AS (SELECT {by}, island, min(s) AS s, max(e) AS e FROM islands GROUP BY {by}, island)"""


@query(
    f"""WITH {_RANGES}, spans AS (SELECT file_id, r.start_byte AS s, r.end_byte AS e FROM errors UNION ALL SELECT file_id, r.start_byte, r.end_byte FROM preprocessor UNION ALL SELECT file_id, r.start_byte, r.end_byte FROM missing),
    {_UNION.format(by="file_id")} SELECT file_id, count(*) AS stretches, CAST(sum(e - s) AS BIGINT) AS bytes FROM joined GROUP BY file_id"""
)
def interval_union(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each file that errors, gaps or directives cover."""
    evidence = latest_evidence(spark, folder, "error_ranges", "preprocessor_ranges", "missing_ranges")
    spans = _ranges(evidence, "error_ranges").union(_ranges(evidence, "preprocessor_ranges")).union(_ranges(evidence, "missing_ranges"))
    return intervals.merged(spans, ["file_id"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("stretches"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query(
    f"""WITH {FRAGMENTS}, spans AS (SELECT lower(trim(pros_info.project)) AS project, lower(pros_info.file) AS file, pros_info.node.start_byte AS s, pros_info.node.end_byte AS e FROM fragments WHERE pros_info.file IS NOT NULL AND pros_info.project IS NOT NULL),
    {_UNION.format(by="project, file")} SELECT project, file, count(*) AS stretches, CAST(sum(e - s) AS BIGINT) AS bytes FROM joined GROUP BY project, file"""
)
def interval_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each file that its fragments cover."""
    i = "pros_info"
    spans = fragments_of(spark, folder, i).where(f"{i}.file is not null and {i}.project is not null").select(
        F.lower(F.trim(f"{i}.project")).alias("project"), F.lower(f"{i}.file").alias("file"), F.col(f"{i}.node.start_byte").alias("start"), F.col(f"{i}.node.end_byte").alias("end")
    )
    return intervals.merged(spans, ["project", "file"]).groupBy("project", "file").agg(F.count(F.lit(1)).alias("stretches"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query(
    """WITH good AS (SELECT DISTINCT file_id, func_idx FROM cpp_lexical_analysis WHERE file_id IS NOT NULL AND func_idx IS NOT NULL AND parse_valid),
    marked AS (SELECT *, func_idx - row_number() OVER (PARTITION BY file_id ORDER BY func_idx) AS run FROM good)
    SELECT file_id, min(func_idx) AS first, max(func_idx) AS last FROM marked GROUP BY file_id, run"""
)
def runs_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of neighbouring functions recorded as parsed."""
    good = table(spark, folder, "cpp_lexical_analysis").where("file_id is not null and func_idx is not null and parse_valid")
    return intervals.runs(good, ["file_id"], "func_idx")


@query(
    """WITH tokens AS (SELECT DISTINCT file_id, func_idx, analyzed_at FROM cpp_lexical_analysis WHERE file_id IS NOT NULL AND analyzed_at IS NOT NULL),
    scans AS (SELECT file_id, scanned_at, max(byte_count) AS byte_count FROM source_evidence WHERE file_id IS NOT NULL AND scanned_at IS NOT NULL GROUP BY 1, 2)
    SELECT t.file_id, t.func_idx, t.analyzed_at, arg_max(s.byte_count, s.scanned_at) FILTER (s.byte_count IS NOT NULL) AS byte_count FROM tokens t LEFT JOIN scans s ON s.file_id = t.file_id AND s.scanned_at <= t.analyzed_at GROUP BY ALL"""
)
def scan_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The size recorded by the latest scan before each lexical analysis."""
    tokens = table(spark, folder, "cpp_lexical_analysis").select("file_id", "func_idx", "analyzed_at").where("file_id is not null and analyzed_at is not null").distinct()
    return intervals.as_of(tokens, table(spark, folder, "source_evidence"), "file_id", "analyzed_at", "scanned_at", "byte_count")


_EXTENT = lambda e: ", ".join(f"CAST(string_split({e}, '-')[{i}] AS INT)" for i in (1, 2, 3, 4))


@query(
    f"""WITH {FRAGMENTS}, parsed AS (SELECT pros_info.node.kind AS kind, [{_EXTENT("pros_info.node.extent")}] AS i, [{_EXTENT("pros_info.function_extent")}] AS o FROM fragments
    WHERE regexp_full_match(pros_info.node.extent, '\\d+-\\d+-\\d+-\\d+') AND regexp_full_match(pros_info.function_extent, '\\d+-\\d+-\\d+-\\d+'))
    SELECT kind, count(*) AS fragments, count(*) FILTER (o[1:2] <= i[1:2] AND i[3:4] <= o[3:4]) AS inside, CAST(sum(i[3] - i[1] + 1) AS BIGINT) AS lines FROM parsed GROUP BY kind"""
)
def extent_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments whose extent lies inside that of their function."""
    rows = fragments_of(spark, folder, "pros_info").select(F.col("pros_info.node.kind").alias("kind"), text.extent(F.col("pros_info.node.extent")).alias("i"), text.extent(F.col("pros_info.function_extent")).alias("o")).where("i is not null and o is not null")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("fragments"), F.count_if(text.within(F.col("i"), F.col("o"))).alias("inside"), F.sum(F.col("i.el") - F.col("i.sl") + 1).alias("lines"))


@query(
    f"""WITH {FILES}, texts AS (SELECT file_id, lower(trim(corpus)) AS corpus, string_split(array_to_string(func_src, chr(10) || chr(10)), chr(10)) AS l,
      lower(regexp_replace(regexp_replace(replace(cppFile, '\\', '/'), '^(\\./)+', ''), '^repos/(project|library)/[^/]+/', '')) AS path FROM files WHERE func_src IS NOT NULL AND cppFile IS NOT NULL),
    one AS (SELECT path, min(file_id) AS file_id FROM texts GROUP BY path HAVING count(*) = 1),
    {FRAGMENTS},
    wanted AS (SELECT emb_id, lower(regexp_replace(regexp_replace(replace(pros_info.file, '\\', '/'), '^(\\./)+', ''), '^repos/(project|library)/[^/]+/', '')) AS path, [{_EXTENT("pros_info.node.extent")}] AS x FROM fragments
      WHERE regexp_full_match(pros_info.node.extent, '\\d+-\\d+-\\d+-\\d+') AND pros_info.file IS NOT NULL)
    SELECT emb_id, CASE WHEN one.file_id IS NULL THEN 'no file' WHEN x[3] > len(l) THEN 'beyond the end' WHEN x[3] - x[1] >= 300 THEN 'too long' ELSE 'found' END AS outcome
    FROM wanted LEFT JOIN one USING (path) LEFT JOIN texts ON texts.file_id = one.file_id"""
)
def verified_context(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the source lines of each fragment can be read: the file is unique, long enough, and the extent within 300 lines."""
    clean = lambda p: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"^(\./)+", ""), "^repos/(project|library)/[^/]+/", ""))
    files = first_rows(spark, folder, "cppFile", "func_src").where("func_src is not null and cppFile is not null")
    lengths = files.select(clean(F.col("cppFile")).alias("path"), F.size(F.split(F.array_join("func_src", "\n\n"), "\n")).alias("lines"))
    one = lengths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("lines").alias("lines")).where("n = 1").drop("n")
    wanted = fragments_of(spark, folder, "pros_info").where("pros_info.file is not null").select("emb_id", clean(F.col("pros_info.file")).alias("path"), text.extent(F.col("pros_info.node.extent")).alias("x")).where("x is not null")
    outcome = F.when(F.col("lines").isNull(), "no file").when(F.col("x.el") > F.col("lines"), "beyond the end").when(F.col("x.el") - F.col("x.sl") >= 300, "too long").otherwise("found")
    return wanted.join(one, "path", "left").select("emb_id", outcome.alias("outcome"))
