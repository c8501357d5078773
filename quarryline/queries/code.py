"""Queries on code as templates, definitions and uses, and choices among fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quarryline.functions import text
from quarryline.functions.patterns import KEYWORDS
from quarryline.operators import defuse, matching, windows
from quarryline.plans.lineage import table
from quarryline.queries.files import first_rows, fragments_of
from quarryline.queries.mining import _CLUSTERS, clusters_of
from quarryline.queries.ranges import _NODES, nodes_of
from quarryline.queries.registry import FILES, FRAGMENTS, Registry

_R = Registry()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query


@query()
def template_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments of a project that agree but for local names and literals."""
    rows = fragments_of(spark, folder, "pros_name", "pros_src").select(F.lower(F.trim("pros_name")).alias("project"), "pros_src")
    return matching.template_groups(rows, "pros_src", ["project"])


@query()
def structural_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments that follow the centre of a recorded cluster with gaps, counted by cluster."""
    patterns = clusters_of(spark, folder).select(F.col("cluster_key").alias("pattern_id"), F.col("center_point").alias("code"))
    candidates = fragments_of(spark, folder, "pros_src").select(F.col("emb_id").alias("candidate_id"), F.col("pros_src").alias("code"))
    found = matching.structural_matches(patterns, candidates)
    return found.groupBy(F.col("pattern_id").alias("cluster_key")).agg(F.count(F.lit(1)).alias("fragments"), F.round(F.max("share"), 6).alias("best"))


_TOKENS = f"list_filter(regexp_extract_all(center_point, '{text.CODE_TOKEN.replace(chr(39), chr(39) * 2)}'), lambda t: NOT (t LIKE '//%' OR t LIKE '/*%'))"


@query(
    f"""WITH {_CLUSTERS}, keyed AS (SELECT lower(trim(center_point_info.project)) AS project, label, cluster_size, array_to_string({_TOKENS}, chr(1)) AS k FROM own WHERE center_point IS NOT NULL AND label IS NOT NULL)
    SELECT project, min(label) AS label, count(*) AS merged, CAST(sum(cluster_size) AS BIGINT) AS members FROM keyed GROUP BY project, k"""
)
def merged_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of a project whose centres have the same tokens, as one; the smallest label stays."""
    keyed = clusters_of(spark, folder).where("center_point is not null and label is not null").select("project", "label", "cluster_size", F.array_join(text.code_tokens(F.col("center_point")), "\x01").alias("k"))
    return keyed.groupBy("project", "k").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("merged"), F.sum("cluster_size").alias("members")).drop("k")


_FACTS = rf"""{_NODES},
stated AS (SELECT file_id, func_idx, node_idx, node.kind AS kind, node.code_snippet AS code FROM nodes WHERE node_idx > 0 AND node.code_snippet IS NOT NULL),
named AS (SELECT file_id, func_idx, node_idx, list_concat(regexp_extract_all(code, '{defuse.ASSIGNED}', 1), regexp_extract_all(code, '{defuse.STEPPED}', 1), CASE WHEN kind = 'declaration' THEN regexp_extract_all(code, '{defuse.DECLARED}', 1) ELSE [] END) AS d,
  regexp_matches(code, '{defuse.UPDATED}') AS updated, unnest(regexp_extract_all(code, '{defuse.NAME}')) AS symbol FROM stated),
grouped AS (SELECT file_id, func_idx, node_idx, symbol, count(*) AS n, bool_or(list_contains(d, symbol)) AS defines, bool_or(updated) AS updated FROM named WHERE symbol NOT IN ({", ".join(f"'{k}'" for k in KEYWORDS)}) GROUP BY ALL),
latest AS (SELECT *, max(CASE WHEN defines THEN node_idx END) OVER (PARTITION BY file_id, func_idx, symbol ORDER BY node_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM grouped),
links AS (SELECT file_id, func_idx, source, node_idx AS target, symbol FROM latest WHERE (NOT defines OR n > 1 OR updated) AND source IS NOT NULL)"""


@query(f"WITH {_FACTS} SELECT * FROM links")
def defuse_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Uses with the latest earlier definition of their name."""
    return defuse.edges(defuse.facts(nodes_of(spark, folder).where("node_idx > 0")))


@query(
    f"""WITH {_FACTS}, steps AS (SELECT DISTINCT file_id, func_idx, source, target FROM links),
    one AS (SELECT file_id, func_idx, target AS anchor, source AS node_idx FROM steps),
    reached AS (SELECT file_id, func_idx, source AS anchor, source AS node_idx FROM steps UNION SELECT file_id, func_idx, target, target FROM steps UNION SELECT * FROM one
      UNION SELECT one.file_id, one.func_idx, one.anchor, s.source FROM one JOIN steps s ON one.file_id = s.file_id AND one.func_idx = s.func_idx AND one.node_idx = s.target UNION SELECT file_id, func_idx, source, target FROM steps)
    SELECT file_id, func_idx, anchor, count(*) AS statements, max(node_idx) - min(node_idx) + 1 AS span FROM reached GROUP BY file_id, func_idx, anchor"""
)
def defuse_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Size and span of the statements near each anchor."""
    reached = defuse.closure(defuse.edges(defuse.facts(nodes_of(spark, folder).where("node_idx > 0"))))
    return reached.groupBy("file_id", "func_idx", "anchor").agg(F.count(F.lit(1)).alias("statements"), (F.max("node_idx") - F.min("node_idx") + 1).alias("span"))


@query()
def nonoverlap_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Up to six fragments of each function that hardly overlap, larger ones first."""
    i = "pros_info"
    rows = fragments_of(spark, folder, i).where(f"{i}.file is not null and {i}.node.start_byte < {i}.node.end_byte")
    piece = F.struct((-F.col(f"{i}.node.subtree_size")).alias("o"), F.col(f"{i}.node.start_byte").alias("start"), F.col(f"{i}.node.end_byte").alias("end"), "emb_id")
    regions = rows.groupBy(F.lower(F.trim(f"{i}.project")).alias("project"), F.col(f"{i}.file").alias("file"), F.col(f"{i}.function_extent").alias("extent")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    chosen = regions.select("project", "file", "extent", F.size("pieces").alias("fragments"), windows.non_overlapping(F.col("pieces"), 6, 0.6).alias("chosen"))
    return chosen.select("project", "file", "extent", "fragments", F.size("chosen").alias("kept"), F.get(F.col("chosen"), F.lit(0))["emb_id"].alias("first"))


@query(
    f"""WITH {_CLUSTERS}, members AS (SELECT DISTINCT unnest(infos) AS info FROM own), {FRAGMENTS},
    taken AS (SELECT DISTINCT lower(trim(info.project)) AS p, info.file AS f, info.function_extent AS fe, info.node.extent AS e FROM members)
    SELECT lower(trim(pros_info.project)) AS project, count(*) AS fragments FROM fragments WHERE pros_info IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM taken WHERE p = lower(trim(pros_info.project)) AND f = pros_info.file AND fe = pros_info.function_extent AND e = pros_info.node.extent) GROUP BY 1"""
)
def retain_unmerged(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments that no recorded cluster holds, by project."""
    parts = lambda i: [F.lower(F.trim(f"{i}.project")).alias("project"), F.col(f"{i}.file").alias("f"), F.col(f"{i}.function_extent").alias("fe"), F.col(f"{i}.node.extent").alias("e")]
    taken = clusters_of(spark, folder).select(F.explode("infos").alias("info")).select(*parts("info")).distinct()
    rest = fragments_of(spark, folder, "pros_info").where("pros_info is not null").select(*parts("pros_info")).join(taken, ["project", "f", "fe", "e"], "left_anti")
    return rest.groupBy("project").agg(F.count(F.lit(1)).alias("fragments"))


@query(
    rf"""WITH {FILES}, functions AS (SELECT corpus, unnest(func_src) AS code FROM files),
    plain AS (SELECT corpus, code, regexp_replace(code, '{text.COMMENT.replace(chr(39), chr(39) * 2)}', '\1', 'g') AS p FROM functions WHERE code IS NOT NULL)
    SELECT corpus, count(*) AS functions, CAST(sum(length(code)) AS BIGINT) AS characters, CAST(sum(length(p)) AS BIGINT) AS without_comments,
    CAST(sum(len(list_filter(string_split(p, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g')) <> ''))) AS BIGINT) AS effective_lines FROM plain GROUP BY corpus"""
)
def comment_share(spark: SparkSession, folder: str) -> DataFrame:
    """Characters with and without comments, and lines that hold code."""
    lines = lambda p: F.size(F.filter(F.split(p, "\n"), lambda x: text.fold(x) != ""))
    codes = F.filter("func_src", lambda c: c.isNotNull())
    measured = lambda c, p: F.struct(F.length(c).alias("all"), F.length(p).alias("plain"), lines(p).alias("lines"))
    sizes = F.transform(codes, lambda c: F.get(F.transform(F.array(text.stripped(c)), lambda p: measured(c, p)), F.lit(0)))
    rows = first_rows(spark, folder, "corpus", sizes=sizes).select("corpus", F.explode("sizes").alias("s"))
    return rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("functions"), F.sum("s.all").alias("characters"), F.sum("s.plain").alias("without_comments"), F.sum("s.lines").alias("effective_lines"))


@query(
    """SELECT event_type, count(*) AS events, count(*) FILTER (json_valid(props)) AS valid, count(*) FILTER (json_valid(props) AND TRY_CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL) AS with_k,
    max(CASE WHEN json_valid(props) THEN TRY_CAST(json_extract(props, '$.k') AS BIGINT) END) AS largest FROM events GROUP BY event_type"""
)
def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads that are JSON objects and hold the wanted field, by kind of event."""
    parsed = F.from_json("props", "k long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = table(spark, folder, "events").select("event_type", "props", parsed.alias("j"))
    valid = F.col("props").isNotNull() & F.col("j._corrupt").isNull()
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(valid).alias("valid"), F.count("j.k").alias("with_k"), F.max("j.k").alias("largest"))


@query(
    """SELECT event_type, window_start, events, users, round(total, 4) AS total FROM (SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS events, count(DISTINCT user_id) AS users, sum(value) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"""
)
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day, as the streaming form counts them."""
    rows = table(spark, folder, "events").where("ts is not null")
    grouped = rows.groupBy("event_type", F.date_trunc("day", "ts").alias("window_start"))
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
