"""Queries on templates over syntax trees, and on slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarryline.functions import text
from quarryline.functions.patterns import DECLARING, KEYWORDS, with_template
from quarryline.operators import coverage, defuse, slices, trees
from quarryline.plans.lineage import cut
from quarryline.queries.code import _FACTS
from quarryline.queries.files import first_rows, fragments_of
from quarryline.queries.mining import TEST, TRAIN, clusters_of
from quarryline.queries.ranges import _NODES, nodes_of
from quarryline.queries.registry import FRAGMENTS, Registry

_R = Registry()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_NAME = lambda x: f"(regexp_full_match({x}, '[A-Za-z_$][A-Za-z0-9_$]*') AND {x} NOT IN ({_IN(KEYWORDS)}))"
_LITERAL = lambda x: f"regexp_matches({x}, '^(?:\\d|(?:u8|u|U|L)?R?\"|(?:u8|u|U|L)?'')')"
_AT = lambda k: f"coalesce(t[i + {k}], '')" if k >= 0 else f"CASE WHEN i > {-k} THEN t[i - {-k}] ELSE '' END"
_KEPT = f"""(regexp_matches(x, '^[A-Z]') OR x LIKE '%\\_' ESCAPE '\\' OR x LIKE 'm\\_%' ESCAPE '\\' OR {_AT(-1)} IN ('.', '->', '::', {_IN(DECLARING)}) OR {_AT(1)} IN ('(', '::') OR {_NAME(_AT(1))}
  OR ({_AT(1)} IN ('*', '&', '&&') AND ({_NAME(_AT(2))} OR {_NAME(_AT(3))} OR {_NAME(_AT(4))})))"""
#: Templates in SQL: a blank is numbered by the place of its token's first use, which tells the same templates apart.
_TEMPLATES = f"""{_NODES},
depths AS (SELECT n.file_id, n.func_idx, n.node_idx, f.corpus, lower(trim(f.split)) AS split, n.node.kind AS kind, n.node.code_snippet AS code, coalesce(n.node.depth, 0) AS depth FROM nodes n JOIN files f USING (file_id)),
spans AS (SELECT a.*, coalesce((SELECT min(b.node_idx) FROM depths b WHERE b.file_id = a.file_id AND b.func_idx = a.func_idx AND b.node_idx > a.node_idx AND b.depth <= a.depth),
  (SELECT max(b.node_idx) + 1 FROM depths b WHERE b.file_id = a.file_id AND b.func_idx = a.func_idx)) - a.node_idx AS span FROM depths a),
lexed AS (SELECT * , list_filter(regexp_extract_all(code, '{text.CODE_TOKEN.replace("'", "''")}'), lambda t: NOT (t LIKE '//%' OR t LIKE '/*%')) AS t FROM spans WHERE trim(code) <> ''),
shaped AS (SELECT * EXCLUDE (code), list_transform(t, lambda x, i: CASE WHEN {_LITERAL('x')} THEN '<LIT_' || list_position(t, x) || '>' WHEN {_NAME('x')} AND NOT {_KEPT} THEN '<VAR_' || list_position(t, x) || '>' ELSE x END) AS template,
  list_transform(t, lambda x: CASE WHEN {_LITERAL('x')} THEN '<LIT>' WHEN {_NAME('x')} THEN '<ID>' ELSE x END) AS shape FROM lexed WHERE len(t) > 0),
patterns AS (SELECT corpus, kind, template, any_value(shape) AS shape FROM shaped WHERE split IN ('train', 'training') GROUP BY 1, 2, 3 HAVING count(DISTINCT (file_id, func_idx)) >= 2),
pairs AS (SELECT s.corpus, s.file_id, s.func_idx, s.node_idx, s.span, s.kind, p.template, s.t FROM shaped s JOIN patterns p ON s.corpus = p.corpus AND s.kind = p.kind AND s.shape = p.shape WHERE s.split = 'test'),
met AS (SELECT * FROM pairs WHERE len(list_filter(template, lambda x, i: NOT (regexp_matches(x, '^<(VAR|LIT)_\\d+>$') OR x = t[i]))) = 0
  AND len(list_distinct(list_filter(list_transform(template, lambda x, i: x || chr(1) || t[i]), lambda y: regexp_matches(y, '^<(VAR|LIT)_\\d+>' || chr(1))))) = len(list_distinct(list_filter(template, lambda x: regexp_matches(x, '^<(VAR|LIT)_\\d+>$'))))),
inside AS (SELECT DISTINCT corpus, file_id, func_idx, unnest(range(node_idx, node_idx + span)) AS i FROM met),
hits AS (SELECT corpus, file_id, count(*) AS covered FROM inside GROUP BY 1, 2),
sizes AS (SELECT corpus, file_id, count(*) AS nodes FROM depths WHERE split = 'test' GROUP BY 1, 2),
grains AS (SELECT s.corpus, count(*) AS files, sum(nodes) AS nodes, sum(coalesce(covered, 0)) AS covered, avg(coalesce(covered, 0) / nodes) AS macro FROM sizes s LEFT JOIN hits h ON s.file_id = h.file_id GROUP BY GROUPING SETS ((s.corpus), ())),
totals AS (SELECT corpus, count(*) AS patterns FROM patterns GROUP BY GROUPING SETS ((corpus), ())),
matched AS (SELECT corpus, count(*) AS matched FROM (SELECT DISTINCT corpus, kind, template FROM met) GROUP BY GROUPING SETS ((corpus), ()))"""


@query(
    f"""WITH {_TEMPLATES} SELECT coalesce(g.corpus, 'all') AS corpus, files, CAST(nodes AS BIGINT) AS nodes, CAST(covered AS BIGINT) AS covered, round(macro, 6) AS ic_macro, round(covered / nodes, 6) AS ic_micro,
    coalesce(patterns, 0) AS patterns, coalesce(matched, 0) AS matched, round(coalesce(matched / patterns, 0), 6) AS isp, round(CASE WHEN macro > 0 AND matched > 0 THEN 2 * macro * (matched / patterns) / (macro + matched / patterns) ELSE 0 END, 6) AS f1
    FROM grains g LEFT JOIN totals t ON g.corpus IS NOT DISTINCT FROM t.corpus LEFT JOIN matched m ON g.corpus IS NOT DISTINCT FROM m.corpus"""
)
def node_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of test trees that the recurring templates of train trees cover."""
    rows = first_rows(spark, folder, "func_ast", "corpus", split=F.lower(F.trim("split"))).where(F.col("split").isin(*TRAIN, *TEST))
    sides = rows.select("file_id", "corpus", "split")
    nodes = cut(trees.placed_nodes(rows, ("code_snippet",)).join(sides, "file_id"))
    return coverage.node_coverage(nodes.where(F.col("split").isin(*TRAIN)), nodes.where(F.col("split").isin(*TEST)))


@query()
def pattern_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where the centres of recorded clusters, as templates, stand in the fragments of the corpus."""
    centres = with_template(clusters_of(spark, folder).where("center_point is not null").select(F.col("cluster_key").alias("pattern_id"), "center_point"), "center_point")
    centres = centres.select("pattern_id", F.array_join("template", " ").alias("code"))
    codes = fragments_of(spark, folder, "pros_src").select(F.col("emb_id").alias("code_id"), F.col("pros_src").alias("code"))
    found = coverage.template_spans(centres, codes)
    return found.groupBy(F.col("pattern_id").alias("cluster_key")).agg(F.count(F.lit(1)).alias("places"), F.count_distinct("code_id").alias("fragments"))


_CORE = lambda code: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({code}, '{p}') THEN '{k}' END" for k, p in slices.CORE.items()) + "], lambda k: k IS NOT NULL)"
_SLICES = f"""{_FACTS}, steps AS (SELECT DISTINCT file_id, func_idx, source, target FROM links),
one AS (SELECT file_id, func_idx, target AS anchor, source AS node_idx FROM steps),
reached AS (SELECT file_id, func_idx, source AS anchor, source AS node_idx FROM steps UNION SELECT file_id, func_idx, target, target FROM steps UNION SELECT * FROM one
  UNION SELECT one.file_id, one.func_idx, one.anchor, s.source FROM one JOIN steps s ON one.file_id = s.file_id AND one.func_idx = s.func_idx AND one.node_idx = s.target UNION SELECT file_id, func_idx, source, target FROM steps),
near AS (SELECT * FROM reached WHERE abs(node_idx - anchor) < 12),
inner_ AS (SELECT DISTINCT l.file_id, l.func_idx, a.anchor, l.source, l.target, l.symbol FROM links l JOIN near a ON a.file_id = l.file_id AND a.func_idx = l.func_idx AND a.node_idx = l.source
  JOIN near b ON b.file_id = l.file_id AND b.func_idx = l.func_idx AND b.node_idx = l.target AND b.anchor = a.anchor),
edge_counts AS (SELECT file_id, func_idx, anchor, count(*) AS edges FROM inner_ GROUP BY 1, 2, 3),
ends AS (SELECT file_id, func_idx, anchor, min(node_idx) AS first, max(node_idx) AS last, count(*) AS selected FROM near GROUP BY 1, 2, 3),
gated AS (SELECT *, selected / (last - first + 1) AS cohesion FROM ends JOIN edge_counts USING (file_id, func_idx, anchor) WHERE selected >= 2 AND last - first + 1 <= 12 AND selected / (last - first + 1) >= 0.5),
facts AS (SELECT file_id, func_idx, node_idx, {_CORE('node.code_snippet')} AS kinds, strlen(node.code_snippet) AS bytes, TRY_CAST(split_part(node.extent, '-', 1) AS INT) AS sl, TRY_CAST(split_part(node.extent, '-', 3) AS INT) AS el FROM nodes WHERE node_idx > 0 AND node.code_snippet IS NOT NULL),
whole AS (SELECT g.file_id, g.func_idx, g.anchor, sum(bytes) + count(*) - 1 AS bytes, max(el) - min(sl) + 1 AS lines, list_distinct(flatten(list(kinds))) AS kinds, coalesce(any_value(CASE WHEN f.node_idx = g.anchor THEN kinds END), []) AS own
  FROM gated g JOIN facts f ON f.file_id = g.file_id AND f.func_idx = g.func_idx AND f.node_idx BETWEEN g.first AND g.last GROUP BY 1, 2, 3),
kept AS (SELECT * FROM gated JOIN whole USING (file_id, func_idx, anchor) WHERE bytes <= 4000 AND lines BETWEEN 2 AND 80 AND NOT (len(list_filter(own, lambda k: k NOT IN ('assignment_expression', 'update_expression'))) = 0 AND cohesion < 1)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, func_idx, first, last ORDER BY cohesion DESC, edges DESC, anchor) AS n FROM kept) WHERE n = 1)"""


@query(
    f"""WITH {_SLICES} SELECT file_id, func_idx, anchor, first, last, selected, edges, round(cohesion, 6) AS cohesion, CAST(bytes AS BIGINT) AS bytes, lines, row_number() OVER (PARTITION BY file_id, func_idx ORDER BY
    list_contains(own, 'call_expression') DESC, list_has_any(own, [{_IN(slices.LEAVING)}]) DESC, len(own) DESC, list_contains(kinds, 'call_expression') DESC, len(kinds) DESC, cohesion DESC, edges DESC, bytes, first, anchor) AS position FROM best"""
)
def semantic_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of each function, ranked."""
    nodes = nodes_of(spark, folder)
    links = defuse.edges(defuse.facts(nodes.where("node_idx > 0")))
    return slices.slices(nodes, defuse.closure(links), links)


_FRAGMENT_TEMPLATES = f"""{FRAGMENTS}, lexed AS (SELECT coalesce(lower(trim(pros_name)), 'unknown') AS project, list_filter(regexp_extract_all(pros_src, '{text.CODE_TOKEN.replace("'", "''")}'), lambda t: NOT (t LIKE '//%' OR t LIKE '/*%')) AS t FROM fragments WHERE pros_src IS NOT NULL),
classed AS (SELECT project, t, list_transform(t, lambda x, i: CASE WHEN {_LITERAL('x')} THEN 'l' WHEN {_NAME('x')} THEN CASE WHEN {_KEPT} THEN 'k' ELSE 'v' END ELSE 'o' END) AS kinds FROM lexed)"""


@query(
    f"""WITH {_FRAGMENT_TEMPLATES} SELECT project, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(kinds, lambda k: k = 'v'))) AS BIGINT) AS variables, CAST(sum(len(list_filter(kinds, lambda k: k = 'l'))) AS BIGINT) AS literals,
    CAST(sum(len(list_filter(kinds, lambda k: k = 'k'))) AS BIGINT) AS kept FROM classed GROUP BY 1"""
)
def token_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of fragments: names that a template makes blanks, literals, and names it keeps."""
    codes = fragments_of(spark, folder, "pros_name", "pros_src").select(F.coalesce(F.lower(F.trim("pros_name")), F.lit("unknown")).alias("project"), "pros_src").where("pros_src is not null")
    rows = with_template(codes, "pros_src")
    n = lambda prefix: F.size(F.filter("template", lambda t: t.startswith(prefix)))
    kept = F.size(F.filter(F.arrays_zip("template", coverage.coarse(F.col("tokens")).alias("c")), lambda x: (x["c"] == "<ID>") & ~x["template"].startswith("<VAR_")))
    return rows.groupBy("project").agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(n("<VAR_")).alias("variables"), F.sum(n("<LIT_")).alias("literals"), F.sum(kept).alias("kept"))


@query(
    f"""WITH {_FRAGMENT_TEMPLATES}, keyed AS (SELECT project, array_to_string(list_transform(t, lambda x, i: CASE kinds[i] WHEN 'l' THEN '<LIT_' || list_position(t, x) || '>' WHEN 'v' THEN '<VAR_' || list_position(t, x) || '>' ELSE x END), chr(1)) AS k FROM classed),
    classes AS (SELECT project, k, count(*) AS n FROM keyed GROUP BY 1, 2) SELECT project, count(*) AS templates, max(n) AS largest, CAST(sum(n) FILTER (n >= 2) AS BIGINT) AS shared FROM classes GROUP BY 1"""
)
def template_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of fragments that agree but for local names and literals: how many, the largest, and fragments in one of two or more."""
    codes = fragments_of(spark, folder, "pros_name", "pros_src").select(F.coalesce(F.lower(F.trim("pros_name")), F.lit("unknown")).alias("project"), "pros_src").where("pros_src is not null")
    keyed = with_template(codes, "pros_src").select("project", F.sha2(F.array_join("template", "\x01"), 256).alias("k"))
    classes = keyed.groupBy("project", "k").agg(F.count(F.lit(1)).alias("n"))
    return classes.groupBy("project").agg(F.count(F.lit(1)).alias("templates"), F.max("n").alias("largest"), F.sum(F.when(F.col("n") >= 2, F.col("n"))).alias("shared"))
