"""Queries on records: identities, keys, contracts, counters and summaries of nodes, fragments and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quarryline.functions import text
from quarryline.functions.patterns import KEYWORDS
from quarryline.operators import trees
from quarryline.operators.coverage import coarse
from quarryline.plans.lineage import table
from quarryline.queries.files import _PATH, first_rows, fragments_of, latest_evidence
from quarryline.queries.mining import _CLUSTERS, _MEMBERS, clusters_of, members_of
from quarryline.queries.ranges import _NODES, placed
from quarryline.queries.registry import FILES, FRAGMENTS, LATEST, Registry
from quarryline.sources import scan

_R = Registry()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_FOLD = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_POSIX = lambda x: f"lower(regexp_replace(replace({x}, '\\', '/'), '^(\\./)+', ''))"
_TOKENS = lambda x: f"list_filter(regexp_extract_all({x}, '{text.CODE_TOKEN.replace(chr(39), chr(39) * 2)}'), lambda t: NOT (t LIKE '//%' OR t LIKE '/*%'))"
_NAMED = "coalesce(lower(trim({0})), 'unknown')"


def spelled(name: str) -> Column:
    return F.coalesce(F.lower(F.trim(name)), F.lit("unknown"))


def path(column: str) -> Column:
    return F.lower(scan.posix(F.col(column)))


@query(
    f"""WITH {FILES} SELECT lower(trim(project)) AS project, count(*) AS files FROM files
    WHERE trim(project) <> '' AND trim(project) NOT LIKE '.%' AND NOT regexp_matches(project, '[/\\\\]|\\.\\.') GROUP BY 1"""
)
def project_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Projects by name, without hidden ones and names that lead out of the folder."""
    return scan.projects(first_rows(spark, folder, "project"))


@query(
    f"""WITH {LATEST} SELECT coalesce(len(error_ranges), 0) = 0 AND coalesce(len(missing_ranges), 0) = 0 AND coalesce(root_covers_source, false) AS complete, count(*) AS files, CAST(sum(byte_count) AS BIGINT) AS bytes FROM latest GROUP BY 1"""
)
def complete_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of whole trees: no errors, nothing missing, a root that covers the source."""
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    rows = latest_evidence(spark, folder, "error_ranges", "missing_ranges", "root_covers_source", "byte_count")
    return rows.groupBy((none("error_ranges") & none("missing_ranges") & F.coalesce("root_covers_source", F.lit(False))).alias("complete")).agg(F.count(F.lit(1)).alias("files"), F.sum("byte_count").alias("bytes"))


@query(
    f"""WITH {_NODES}, roots AS (SELECT file_id, func_idx, node.extent AS function_extent FROM nodes WHERE node_idx = 0)
    SELECT n.file_id, n.func_idx, n.node_idx, coalesce({_POSIX('f.cppFile')}, '') AS path, r.function_extent FROM nodes n JOIN files f USING (file_id) JOIN roots r ON n.file_id = r.file_id AND n.func_idx = r.func_idx"""
)
def node_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Every node with the path of its file and the extent of its function, which it inherits."""
    rows = first_rows(spark, folder, "func_ast", path=F.coalesce(path("cppFile"), F.lit("")))
    functions = rows.select("file_id", "path", F.posexplode("func_ast").alias("func_idx", "tree"))
    return functions.select("file_id", "func_idx", F.posexplode("tree").alias("node_idx", "node"), "path", F.get("tree", F.lit(0))["extent"].alias("function_extent")).drop("node")


_TYPE = f"CASE WHEN kind = 'function_definition' THEN 'function' WHEN kind IN ({_IN(trees.REGION_KINDS)}) THEN 'region' WHEN kind IN ({_IN(trees.STATEMENT_KINDS)}) THEN 'statement' ELSE 'other' END"


def candidate_type(kind: Column) -> Column:
    return F.when(kind == "function_definition", "function").when(kind.isin(trees.REGION_KINDS), "region").when(kind.isin(trees.STATEMENT_KINDS), "statement").otherwise("other")


@query(
    f"""WITH {FRAGMENTS}, kinds AS (SELECT emb_id, pros_info.node.kind AS kind, concat_ws('|', lower(trim(pros_info.project)), {_POSIX('pros_info.file')}, pros_info.function_extent, pros_info.node.extent) AS key FROM fragments)
    SELECT emb_id, {_TYPE} AS type, key FROM kinds"""
)
def candidate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Type and composite key of every fragment."""
    key = F.concat_ws("|", F.lower(F.trim("pros_info.project")), path("pros_info.file"), "pros_info.function_extent", "pros_info.node.extent")
    return fragments_of(spark, folder, "pros_info").select("emb_id", candidate_type(F.col("pros_info.node.kind")).alias("type"), key.alias("key"))


@query(f"WITH {FRAGMENTS} SELECT {_NAMED.format('pros_name')} AS project, count(*) AS fragments FROM fragments GROUP BY 1 HAVING count(*) >= 100")
def sized_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects with a hundred fragments or more."""
    return fragments_of(spark, folder, "pros_name").groupBy(spelled("pros_name").alias("project")).agg(F.count(F.lit(1)).alias("fragments")).where("fragments >= 100")


@query(
    f"""WITH {FRAGMENTS} SELECT {_NAMED.format('pros_name')} AS project, count(*) AS fragments, count(*) FILTER (pros_src IS NULL OR trim(pros_src) = '') AS without_code, coalesce(bool_or(contains(pros_src, 'ToBeDetermined')), false) AS undetermined FROM fragments GROUP BY 1"""
)
def flagged_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects with fragments whose code is missing or stands for something undetermined."""
    bad = F.coalesce(F.trim("pros_src") == "", F.lit(True))
    rows = table(spark, folder, "embedding").select("emb_id", "ingested_at", "pros_name", bad.alias("bad"), F.contains("pros_src", F.lit("ToBeDetermined")).alias("open"))
    return scan.first_deliveries(rows, "emb_id", "ingested_at").groupBy(spelled("pros_name").alias("project")).agg(F.count(F.lit(1)).alias("fragments"), F.count_if("bad").alias("without_code"), F.coalesce(F.bool_or("open"), F.lit(False)).alias("undetermined"))


@query(
    f"""WITH {FRAGMENTS} SELECT CASE WHEN pros_info.node.kind IN ({_IN(trees.REGION_KINDS + trees.STATEMENT_KINDS)}) AND coalesce(pros_info.node.ast_num, 0) >= 5 THEN pros_info.node.kind ELSE 'none' END AS candidate_group, count(*) AS fragments,
    CAST(sum(coalesce(pros_info.node.ast_num, 0)) AS BIGINT) AS children FROM fragments WHERE trim(coalesce(pros_info.node.code_snippet, '')) <> '' GROUP BY 1"""
)
def candidate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments with code by the group they are mined in: their kind, if they have five children or more."""
    kind, n = F.col("pros_info.node.kind"), F.coalesce("pros_info.node.ast_num", F.lit(0))
    group = F.when(kind.isin(trees.REGION_KINDS + trees.STATEMENT_KINDS) & (n >= 5), kind).otherwise("none")
    rows = fragments_of(spark, folder, "pros_info").where("trim(coalesce(pros_info.node.code_snippet, '')) != ''")
    return rows.groupBy(group.alias("candidate_group")).agg(F.count(F.lit(1)).alias("fragments"), F.sum(n).alias("children"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


@query(
    f"""WITH {FRAGMENTS} SELECT emb_id, len(pros_emb) AS components, len(list_filter(pros_emb, lambda x: x IS NOT NULL AND isfinite(x))) AS finite FROM fragments WHERE pros_emb IS NOT NULL AND len(list_filter(pros_emb, lambda x: x IS NULL OR NOT isfinite(x))) > 0"""
)
def unsafe_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with components that JSON cannot hold; ``functions`` of the library write them as null."""
    finite = F.size(F.filter("pros_emb", _finite)).cast("long")
    rows = table(spark, folder, "embedding").select("emb_id", "ingested_at", F.size("pros_emb").cast("long").alias("components"), finite.alias("finite")).where("pros_emb is not null")
    return scan.first_deliveries(rows, "emb_id", "ingested_at").where("finite < components").select("emb_id", "components", "finite")


@query(
    f"""WITH {FRAGMENTS} SELECT emb_id, coalesce(pros_info.node.kind, '') AS kind, coalesce(pros_info.node.extent, '') AS extent, coalesce(pros_info.node.ast_num, 0) AS ast_num, coalesce(pros_info.node.subtree_size, 0) AS subtree_size,
    coalesce(pros_info.node.end_byte - pros_info.node.start_byte, 0) AS bytes FROM fragments WHERE pros_info.node IS NOT NULL"""
)
def node_records(spark: SparkSession, folder: str) -> DataFrame:
    """The plain fields of each fragment's node, with defaults."""
    n = "pros_info.node"
    rows = fragments_of(spark, folder, "pros_info").where(f"{n} is not null")
    field = lambda name, default: F.coalesce(f"{n}.{name}", F.lit(default)).alias(name)
    return rows.select("emb_id", field("kind", ""), field("extent", ""), field("ast_num", 0), field("subtree_size", 0), F.coalesce(F.col(f"{n}.end_byte") - F.col(f"{n}.start_byte"), F.lit(0)).alias("bytes"))


@query(
    f"""WITH {_MEMBERS}, {FILES}, train AS (SELECT DISTINCT {_POSIX('cppFile')} AS p FROM files WHERE lower(trim(split)) IN ('train', 'training'))
    SELECT cluster_key, count(*) AS members, count(DISTINCT {_FOLD('info.node.code_snippet')}) AS codes FROM members JOIN train ON {_POSIX('info.file')} = p GROUP BY 1"""
)
def reference_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Members and different codes of each cluster that come from train files."""
    train = first_rows(spark, folder, split=F.lower(F.trim("split")), p=path("cppFile")).where("split in ('train', 'training')").select("p").distinct()
    rows = members_of(spark, folder).withColumn("p", path("info.file")).join(train, "p")
    return rows.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("members"), F.count_distinct(text.fold(F.col("info.node.code_snippet"))).alias("codes"))


@query(
    f"""WITH {LATEST}, a AS (SELECT DISTINCT file_id, r.start_byte AS s, r.end_byte AS e FROM (SELECT file_id, unnest(error_ranges) AS r FROM latest)), b AS (SELECT DISTINCT file_id, r.start_byte AS s, r.end_byte AS e FROM (SELECT file_id, unnest(missing_ranges) AS r FROM latest))
    SELECT CASE WHEN a.s IS NULL THEN 'missing' WHEN b.s IS NULL THEN 'error' ELSE 'both' END AS origin, count(*) AS ranges, CAST(sum(coalesce(a.e, b.e) - coalesce(a.s, b.s)) AS BIGINT) AS bytes
    FROM a FULL JOIN b ON a.file_id = b.file_id AND a.s = b.s AND a.e = b.e GROUP BY 1"""
)
def range_preference(spark: SparkSession, folder: str) -> DataFrame:
    """Error ranges and missing ranges matched by their ends; the error range is preferred where both have one."""
    rows = latest_evidence(spark, folder, "error_ranges", "missing_ranges")
    side = lambda c, name: rows.select("file_id", F.explode(c).alias("r")).select("file_id", F.col("r.start_byte").alias("s"), F.col("r.end_byte").alias("e")).distinct().withColumn(name, F.lit(True))
    joined = side("error_ranges", "a").join(side("missing_ranges", "b"), ["file_id", "s", "e"], "full")
    origin = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "error").otherwise("both")
    return joined.groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("e") - F.col("s")).alias("bytes"))


@query(
    f"""WITH {_NODES}, {FRAGMENTS}, known AS (SELECT {_POSIX('f.cppFile')} AS p, n.node.extent AS e, n.node.kind AS k, min(n.func_idx * 100000 + n.node_idx) AS first FROM nodes n JOIN files f USING (file_id) GROUP BY 1, 2, 3)
    SELECT pros_info.node.kind AS kind, count(*) AS fragments, count(first) AS located FROM fragments LEFT JOIN known ON {_POSIX('pros_info.file')} = p AND pros_info.node.extent = e AND pros_info.node.kind = k WHERE pros_info.node IS NOT NULL GROUP BY 1"""
)
def fragment_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments that are nodes of their file's trees by extent and kind; the first such node counts."""
    rows = first_rows(spark, folder, "func_ast", p=path("cppFile"))
    nodes = rows.select("p", F.posexplode("func_ast").alias("func_idx", "tree")).select("p", "func_idx", F.posexplode("tree").alias("node_idx", "n"))
    known = nodes.groupBy("p", F.col("n.extent").alias("e"), F.col("n.kind").alias("kind")).agg(F.min(F.struct("func_idx", "node_idx")).alias("first"))
    wanted = fragments_of(spark, folder, "pros_info").where("pros_info.node is not null").select(path("pros_info.file").alias("p"), F.col("pros_info.node.extent").alias("e"), F.col("pros_info.node.kind").alias("kind"))
    return wanted.join(known, ["p", "e", "kind"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("fragments"), F.count("first").alias("located"))


@query(
    f"""WITH {_NODES}, {FRAGMENTS}, domain AS (SELECT DISTINCT {_POSIX('f.cppFile')} AS p, n.node.extent AS e FROM nodes n JOIN files f USING (file_id) WHERE n.node_idx = 0)
    SELECT {_NAMED.format('pros_name')} AS project, count(*) AS fragments, count(e) AS in_domain FROM fragments LEFT JOIN domain ON {_POSIX('pros_info.file')} = p AND pros_info.function_extent = e GROUP BY 1"""
)
def fragment_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments whose function, by file and extent, is one of the corpus."""
    functions = first_rows(spark, folder, p=path("cppFile"), roots=F.transform("func_ast", lambda t: F.get(t, F.lit(0))["extent"]))
    domain = functions.select("p", F.explode("roots").alias("e")).where("p is not null and e is not null").distinct().withColumn("hit", F.lit(1))
    wanted = fragments_of(spark, folder, "pros_name", "pros_info").select(spelled("pros_name").alias("project"), path("pros_info.file").alias("p"), F.col("pros_info.function_extent").alias("e"))
    return wanted.join(domain, ["p", "e"], "left").groupBy("project").agg(F.count(F.lit(1)).alias("fragments"), F.count("hit").alias("in_domain"))


_REGISTRY = f"""{FILES}, registry AS (SELECT file_id, CAST(unnest(range(len(func_src))) AS INT) AS func_idx FROM files), refs AS (SELECT DISTINCT file_id, func_idx FROM cpp_lexical_analysis WHERE file_id IS NOT NULL AND func_idx IS NOT NULL)"""


@query(
    f"""WITH {_REGISTRY} SELECT 'missing' AS problem, count(*) AS functions FROM (SELECT file_id, func_idx FROM registry EXCEPT SELECT * FROM refs)
    UNION ALL SELECT 'unknown', count(*) FROM (SELECT * FROM refs EXCEPT SELECT file_id, func_idx FROM registry)"""
)
def reference_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Functions without a lexical record, and records of functions that don't exist."""
    registry = first_rows(spark, folder, n=F.size("func_src")).where("n > 0").select("file_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("func_idx"))
    refs = table(spark, folder, "cpp_lexical_analysis").where("file_id is not null and func_idx is not null").select("file_id", "func_idx").distinct()
    # one full join tells both directions
    joined = registry.withColumn("a", F.lit(True)).join(refs.withColumn("b", F.lit(True)), ["file_id", "func_idx"], "full")
    counts = joined.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("unknown"))
    return counts.select(F.expr("stack(2, 'missing', missing, 'unknown', unknown) AS (problem, functions)"))


@query(
    f"""WITH {_NODES}, {FRAGMENTS}, coded AS (SELECT {_POSIX('f.cppFile')} AS p, n.func_idx, n.node_idx, coalesce(n.node.subtree_size, 0) AS size, {_FOLD('n.node.code_snippet')} AS code FROM nodes n JOIN files f USING (file_id) WHERE n.node.code_snippet IS NOT NULL),
    wanted AS (SELECT emb_id, {_POSIX('pros_info.file')} AS p, {_FOLD('pros_src')} AS code FROM fragments WHERE trim(pros_src) <> ''),
    ranked AS (SELECT emb_id, CASE WHEN c.code = w.code THEN 'exact' ELSE 'inside' END AS matched, size, row_number() OVER (PARTITION BY emb_id ORDER BY c.code <> w.code, size, func_idx, node_idx) AS n FROM wanted w JOIN coded c ON w.p = c.p AND contains(c.code, w.code))
    SELECT emb_id, matched, size FROM ranked WHERE n = 1"""
)
def text_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node of its file that each fragment's text is, else the smallest that holds it."""
    rows = first_rows(spark, folder, "func_ast", p=path("cppFile")).where("p is not null")
    nodes = rows.select("p", F.posexplode("func_ast").alias("func_idx", "tree")).select("p", "func_idx", F.posexplode("tree").alias("node_idx", "n")).where("n.code_snippet is not null")
    coded = nodes.select("p", "func_idx", "node_idx", F.coalesce("n.subtree_size", F.lit(0)).alias("size"), text.fold(F.col("n.code_snippet")).alias("code"))
    wanted = fragments_of(spark, folder, "pros_src", "pros_info").where("trim(pros_src) != ''").select("emb_id", path("pros_info.file").alias("p"), text.fold(F.col("pros_src")).alias("wanted"))
    met = wanted.join(coded, "p").where(F.contains("code", "wanted"))
    best = met.groupBy("emb_id").agg(F.min(F.struct((F.col("code") != F.col("wanted")).alias("inner"), "size", "func_idx", "node_idx")).alias("b"))
    return best.select("emb_id", F.when(F.col("b.inner"), "inside").otherwise("exact").alias("matched"), "b.size")


@query(
    f"""WITH {_CLUSTERS}, keyed AS (SELECT cluster_key, chr(1) || array_to_string({_TOKENS('center_point')}, chr(1)) || chr(1) AS k, else_point FROM own WHERE center_point IS NOT NULL)
    SELECT cluster_key, len(coalesce(else_point, [])) AS codes, len(list_filter(coalesce(else_point, []), lambda x: contains(chr(1) || array_to_string({_TOKENS('x')}, chr(1)) || chr(1), k))) AS holding FROM keyed"""
)
def token_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of a cluster that hold the tokens of its centre one after the other."""
    joined = lambda c: F.concat(F.lit("\x01"), F.array_join(text.code_tokens(c), "\x01"), F.lit("\x01"))
    rows = clusters_of(spark, folder).where("center_point is not null").select("cluster_key", F.coalesce("else_point", F.array().cast("array<string>")).alias("codes"), joined(F.col("center_point")).alias("k"))
    return rows.select("cluster_key", F.size("codes").cast("long").alias("codes"), F.size(F.filter("codes", lambda c: F.contains(joined(c), F.col("k")))).cast("long").alias("holding"))


@query(
    f"""WITH {FILES}, {LATEST}, lexed AS (SELECT file_id, count(*) AS functions, count(*) FILTER (bad) AS invalid FROM (SELECT file_id, func_idx, bool_or(NOT parse_valid) AS bad FROM cpp_lexical_analysis WHERE file_id IS NOT NULL AND func_idx IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
    SELECT corpus, count(*) AS files, count(l.file_id) AS recorded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (len(error_ranges) > 0) AS with_errors, count(*) FILTER (len(missing_ranges) > 0) AS with_missing,
    CAST(sum(byte_count) AS BIGINT) AS bytes, CAST(sum(function_definition_count) AS BIGINT) AS definitions, CAST(sum(macro_related_error_count) AS BIGINT) AS macro_errors, CAST(sum(functions) AS BIGINT) AS lexed, CAST(sum(invalid) AS BIGINT) AS invalid
    FROM files LEFT JOIN latest l USING (file_id) LEFT JOIN lexed x USING (file_id) GROUP BY corpus"""
)
def parser_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The parser's and the lexer's records beside the files of each corpus."""
    latest = latest_evidence(spark, folder, "status", "error_ranges", "missing_ranges", "byte_count", "function_definition_count", "macro_related_error_count").withColumn("known", F.lit(1))
    lexical = table(spark, folder, "cpp_lexical_analysis").where("file_id is not null and func_idx is not null").groupBy("file_id", "func_idx").agg(F.bool_or(~F.col("parse_valid")).alias("bad"))
    lexed = lexical.groupBy("file_id").agg(F.count(F.lit(1)).alias("functions"), F.count_if("bad").alias("invalid"))
    joined = first_rows(spark, folder, "corpus").select("file_id", "corpus").join(latest, "file_id", "left").join(lexed, "file_id", "left")
    return joined.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("files"), F.count("known").alias("recorded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.size("error_ranges") > 0).alias("with_errors"), F.count_if(F.size("missing_ranges") > 0).alias("with_missing"),
        F.sum("byte_count").alias("bytes"), F.sum("function_definition_count").alias("definitions"), F.sum("macro_related_error_count").alias("macro_errors"), F.sum("functions").alias("lexed"), F.sum("invalid").alias("invalid"),
    )


_APPROXIMATE = "coalesce(CAST(floor((length({0}) - length(regexp_replace({0}, '[一-鿿]', '', 'g'))) / 1.5 + length(regexp_replace({0}, '[一-鿿]', '', 'g')) / 4.0) AS INT), 0)"
#: Approximate tokens that a fragment may take.
BUDGET = 40
_BUDGETED = f"""{FRAGMENTS}, sized AS (SELECT emb_id, {_NAMED.format('pros_name')} AS project, {_POSIX('pros_info.file')} AS file, pros_info.function_extent AS fe, pros_info.node.kind AS kind, {_APPROXIMATE.format('pros_src')} AS tokens, coalesce(trim(pros_src), '') = '' AS blank FROM fragments)"""


def budgeted(spark: SparkSession, folder: str) -> DataFrame:
    """Each fragment with its approximate tokens, reduced to small columns before repeated deliveries are dropped."""
    i = "pros_info"
    rows = table(spark, folder, "embedding").select("emb_id", "ingested_at", spelled("pros_name").alias("project"), path(f"{i}.file").alias("file"), F.col(f"{i}.function_extent").alias("fe"), F.col(f"{i}.node.kind").alias("kind"), text.approximate_tokens(F.col("pros_src")).alias("tokens"), (F.coalesce(F.trim("pros_src"), F.lit("")) == "").alias("blank"))
    return scan.first_deliveries(rows, "emb_id", "ingested_at")


@query(
    f"""WITH {_BUDGETED} SELECT {_TYPE} AS type, count(*) AS raw, count(*) FILTER (NOT blank AND tokens <= {BUDGET}) AS ready, count(*) FILTER (NOT blank AND tokens > {BUDGET}) AS rejected, count(*) FILTER (blank) AS blank FROM sized GROUP BY 1"""
)
def fragment_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments by type: all, those within the budget, those beyond it, and those without code."""
    fits = F.col("tokens") <= BUDGET
    return budgeted(spark, folder).groupBy(candidate_type(F.col("kind")).alias("type")).agg(F.count(F.lit(1)).alias("raw"), F.count_if(~F.col("blank") & fits).alias("ready"), F.count_if(~F.col("blank") & ~fits).alias("rejected"), F.count_if("blank").alias("blank"))


@query(
    f"""WITH {_BUDGETED}, ready AS (SELECT DISTINCT project, file, fe FROM sized WHERE NOT blank AND tokens <= {BUDGET})
    SELECT emb_id, CASE WHEN EXISTS (SELECT 1 FROM ready r WHERE r.project = s.project AND r.file = s.file AND r.fe = s.fe) THEN 'degraded' ELSE 'excluded' END AS action, tokens FROM sized s WHERE NOT blank AND tokens > {BUDGET}"""
)
def budget_rejections(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments beyond the budget: degraded where a smaller one of their function fits, else excluded."""
    rows = budgeted(spark, folder).where(~F.col("blank"))
    fits = F.col("tokens") <= BUDGET
    ready = rows.where(fits).select("project", "file", "fe").distinct().withColumn("there", F.lit(True))
    joined = rows.where(~fits).join(ready, ["project", "file", "fe"], "left")
    return joined.select("emb_id", F.when(F.col("there"), "degraded").otherwise("excluded").alias("action"), "tokens")


@query(f"""WITH {FRAGMENTS} SELECT pros_info.node.kind AS kind, count(*) AS fragments, count(DISTINCT pros_src) AS snippets FROM fragments WHERE pros_src IS NOT NULL GROUP BY 1""")
def unique_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Different texts among the fragments of a kind, told by SHA-256: what a tokenizer must see once."""
    rows = table(spark, folder, "embedding").where("pros_src is not null").select("emb_id", "ingested_at", F.col("pros_info.node.kind").alias("kind"), F.unhex(F.sha2("pros_src", 256)).alias("code"))
    return scan.first_deliveries(rows, "emb_id", "ingested_at").groupBy("kind").agg(F.count(F.lit(1)).alias("fragments"), F.count_distinct("code").alias("snippets"))


@query("SELECT slug, corpus, parse.analysis.source.effective_line_count IS NOT NULL AND parse.analysis.source.effective_line_count >= 0 AND parse.analysis.source.selected_file_count IS NOT NULL AND parse.analysis.source.selected_file_count > 0 AS valid FROM project_classification")
def metric_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the numbers of a project are all there and in range."""
    s = "parse.analysis.source"
    numbers = F.array(F.col(f"{s}.effective_line_count").cast("double"), F.col(f"{s}.selected_file_count") - F.lit(1.0))
    return table(spark, folder, "project_classification").select("slug", "corpus", F.forall(numbers, lambda x: F.coalesce(_finite(x) & (x >= 0), F.lit(False))).alias("valid"))


@query(f"WITH {FRAGMENTS} SELECT {_NAMED.format('pros_name')} AS project, round(coalesce(avg(pros_info.node.subtree_size), 0), 6) AS mean_size, round(coalesce(avg(pros_info.node.ast_num), 0), 6) AS mean_children FROM fragments GROUP BY 1")
def average_sizes(spark: SparkSession, folder: str) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(f"pros_info.node.{c}"), F.lit(0.0)), 6)
    return fragments_of(spark, folder, "pros_name", "pros_info").groupBy(spelled("pros_name").alias("project")).agg(mean("subtree_size").alias("mean_size"), mean("ast_num").alias("mean_children"))


@query(
    f"""WITH {FILES}, {LATEST}, sized AS (SELECT file_id, corpus, {_NAMED.format('project')} AS project, list_filter(coalesce(func_src, []), lambda x: x IS NOT NULL) AS codes FROM files),
    counted AS (SELECT file_id, corpus, project, len(codes) AS functions, coalesce(list_sum(list_transform(codes, lambda x: length(x))), 0) AS characters, coalesce(list_sum(list_transform(codes, lambda x: length(x) - length(replace(x, chr(10), '')) + 1)), 0) AS lines,
      coalesce(list_sum(list_transform(codes, lambda x: len(regexp_extract_all(x, '\\b([A-Za-z_][A-Za-z0-9_:]*)\\s*\\(')))), 0) AS calls FROM sized)
    SELECT c.corpus, c.project, count(*) AS files, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(coalesce(len(error_ranges), 0)) AS BIGINT) AS errors
    FROM counted c LEFT JOIN latest USING (file_id) GROUP BY 1, 2"""
)
def repository_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Files, functions, characters, lines, calls and recorded errors of each project."""
    codes = F.filter(F.coalesce("func_src", F.array().cast("array<string>")), lambda c: c.isNotNull())
    total = lambda f: F.aggregate(F.transform(codes, f), F.lit(0), lambda a, b: a + b).cast("long")
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    files = first_rows(spark, folder, "corpus", project=spelled("project"), functions=F.size(codes).cast("long"), characters=total(F.length), lines=total(lines), calls=total(lambda c: F.size(text.declared_calls(c))))
    joined = files.drop("ingested_at").join(latest_evidence(spark, folder, "error_ranges").select("file_id", F.greatest(F.size("error_ranges"), F.lit(0)).alias("errors")), "file_id", "left")
    return joined.groupBy("corpus", "project").agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("functions", "characters", "lines", "calls")], F.sum(F.coalesce("errors", F.lit(0))).alias("errors"))


@query(
    f"""WITH {FRAGMENTS}, {_CLUSTERS} SELECT 'deliveries' AS stage, count(*) AS n FROM embedding UNION ALL SELECT 'fragments', count(*) FROM fragments UNION ALL SELECT 'with code', count(*) FROM fragments WHERE pros_src IS NOT NULL
    UNION ALL SELECT 'with vector', count(*) FROM fragments WHERE len(pros_emb) = 64 UNION ALL SELECT 'clusters', count(*) FROM own UNION ALL SELECT 'members', coalesce(CAST(sum(len(infos)) AS BIGINT), 0) FROM own"""
)
def stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What each stage of the mining holds."""
    rows = table(spark, folder, "embedding").select("emb_id", "ingested_at", F.col("pros_src").isNotNull().alias("code"), (F.size("pros_emb") == 64).alias("vector"))
    n = lambda df, stage, value: df.agg(value.alias("n")).select(F.lit(stage).alias("stage"), "n")
    first = scan.first_deliveries(rows, "emb_id", "ingested_at").agg(F.count(F.lit(1)).alias("f"), F.count_if("code").alias("c"), F.count_if("vector").alias("v"))
    first = first.select(F.expr("stack(3, 'fragments', f, 'with code', c, 'with vector', v) AS (stage, n)"))
    own = clusters_of(spark, folder).agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum(F.greatest(F.size("infos"), F.lit(0))), F.lit(0)).alias("m")).select(F.expr("stack(2, 'clusters', c, 'members', m) AS (stage, n)"))
    return n(rows, "deliveries", F.count(F.lit(1))).union(first).union(own)


@query(
    f"""WITH {FRAGMENTS} SELECT coalesce(pros_info.node.kind, 'none') AS kind, count(*) AS fragments, min(length(pros_src)) AS shortest, round(quantile_cont(length(pros_src), 0.5), 6) AS median, max(length(pros_src)) AS longest, round(avg(pros_info.node.subtree_size), 6) AS mean_size FROM fragments GROUP BY 1"""
)
def export_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of fragments with the lengths of their codes."""
    rows = table(spark, folder, "embedding").select("emb_id", "ingested_at", F.coalesce("pros_info.node.kind", F.lit("none")).alias("kind"), F.length("pros_src").alias("n"), F.col("pros_info.node.subtree_size").alias("size"))
    rows = scan.first_deliveries(rows, "emb_id", "ingested_at")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("fragments"), F.min("n").cast("long").alias("shortest"), F.round(F.expr("percentile(n, 0.5)"), 6).alias("median"), F.max("n").cast("long").alias("longest"), F.round(F.avg("size"), 6).alias("mean_size"))


@query(f"""WITH {FRAGMENTS} SELECT kind, emb_id, n FROM (SELECT pros_info.node.kind AS kind, emb_id, length(pros_src) AS n, row_number() OVER (PARTITION BY pros_info.node.kind ORDER BY length(pros_src) DESC, emb_id) AS r FROM fragments WHERE pros_src IS NOT NULL) WHERE r <= 10""")
def longest_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The ten longest codes of each kind."""
    rows = table(spark, folder, "embedding").where("pros_src is not null").select("emb_id", "ingested_at", F.col("pros_info.node.kind").alias("kind"), F.length("pros_src").cast("long").alias("n"))
    rank = Window.partitionBy("kind").orderBy(F.desc("n"), "emb_id")
    return scan.first_deliveries(rows, "emb_id", "ingested_at").withColumn("r", F.row_number().over(rank)).where("r <= 10").select("kind", "emb_id", "n")


@query(f"""WITH {_CLUSTERS} SELECT project, cluster_key, cluster_size, r AS position FROM (SELECT {_NAMED.format('center_point_info.project')} AS project, cluster_key, cluster_size, row_number() OVER (PARTITION BY {_NAMED.format('center_point_info.project')} ORDER BY cluster_size DESC NULLS LAST, cluster_key) AS r FROM own) WHERE r <= 5""")
def preview_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest clusters of each project."""
    rows = clusters_of(spark, folder).withColumn("project", F.coalesce("project", F.lit("unknown")))
    rank = Window.partitionBy("project").orderBy(F.desc_nulls_last("cluster_size"), "cluster_key")
    return rows.withColumn("position", F.row_number().over(rank)).where("position <= 5").select("project", "cluster_key", "cluster_size", "position")


@query(
    f"""WITH {FRAGMENTS}, codes AS (SELECT {_FOLD('pros_src')} AS code, pros_info.file AS f, pros_info.node.subtree_size AS size FROM fragments WHERE trim(pros_src) <> ''),
    found AS (SELECT code, count(DISTINCT f) AS support, count(*) AS occurrences, max(size) AS nodes FROM codes GROUP BY code HAVING count(DISTINCT f) >= 2)
    SELECT code, support, occurrences, nodes FROM (SELECT *, row_number() OVER (ORDER BY support DESC, occurrences DESC, nodes DESC NULLS LAST, code) AS r FROM found) WHERE r <= 100"""
)
def pattern_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred codes with the widest support, by files, occurrences, nodes and text."""
    codes = fragments_of(spark, folder, "pros_src", "pros_info").where("trim(pros_src) != ''").select(text.fold(F.col("pros_src")).alias("code"), F.col("pros_info.file").alias("f"), F.col("pros_info.node.subtree_size").alias("size"))
    found = codes.groupBy("code").agg(F.count_distinct("f").alias("support"), F.count(F.lit(1)).alias("occurrences"), F.max("size").alias("nodes")).where("support >= 2")
    return found.orderBy(F.desc("support"), F.desc("occurrences"), F.desc_nulls_last("nodes"), "code").limit(100)


@query(
    f"""WITH {_CLUSTERS}, folded AS (SELECT cluster_key, list_transform(coalesce(else_point, []), lambda x: {_FOLD('x')}) AS l FROM own), firsts AS (SELECT cluster_key, list_filter(l, lambda x, i: x IS NOT NULL AND x <> '' AND list_position(l, x) = i) AS l FROM folded)
    SELECT cluster_key, len(l) AS variants, md5(array_to_string(l[1:3], chr(10))) AS examples FROM firsts"""
)
def distinct_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first three codes of a cluster that differ by more than white space, as one digest."""
    codes = F.array_distinct(F.transform(F.coalesce("else_point", F.array().cast("array<string>")), text.fold))
    rows = clusters_of(spark, folder).select("cluster_key", F.filter(codes, lambda c: c != "").alias("l"))
    return rows.select("cluster_key", F.size("l").cast("long").alias("variants"), F.md5(F.array_join(F.slice("l", 1, 3), "\n")).alias("examples"))


_KEY = lambda i: f"concat_ws('|', lower(trim({i}.project)), {i}.file, {i}.function_extent, {i}.node.extent)"


def member_key(i: str) -> Column:
    return F.concat_ws("|", F.lower(F.trim(f"{i}.project")), f"{i}.file", f"{i}.function_extent", f"{i}.node.extent")


@query(
    f"""WITH {_MEMBERS}, {FRAGMENTS}, both_ AS (SELECT {_KEY('info')} AS k, 0 AS o FROM members UNION ALL SELECT {_KEY('pros_info')}, 1 FROM fragments WHERE pros_info IS NOT NULL)
    SELECT CASE WHEN o = 0 THEN 'cluster' ELSE 'fragment' END AS origin, count(*) AS regions FROM (SELECT k, min(o) AS o FROM both_ GROUP BY k) GROUP BY 1"""
)
def first_wins_union(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of clusters and fragments together, each once; a cluster's record wins."""
    a = members_of(spark, folder).select(member_key("info").alias("k"), F.lit(0).alias("o"))
    b = fragments_of(spark, folder, "pros_info").where("pros_info is not null").select(member_key("pros_info").alias("k"), F.lit(1).alias("o"))
    first = a.unionByName(b).groupBy("k").agg(F.min("o").alias("o"))
    return first.groupBy(F.when(F.col("o") == 0, "cluster").otherwise("fragment").alias("origin")).agg(F.count(F.lit(1)).alias("regions"))


@query(
    f"""WITH {_MEMBERS}, {FRAGMENTS} SELECT project, origin, count(*) AS records FROM (SELECT {_NAMED.format('info.project')} AS project, 'cluster' AS origin FROM members UNION ALL SELECT {_NAMED.format('pros_info.project')}, 'fragment' FROM fragments) GROUP BY 1, 2"""
)
def all_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of clusters and fragments together, repeated ones too."""
    a = members_of(spark, folder).select(spelled("info.project").alias("project"), F.lit("cluster").alias("origin"))
    b = fragments_of(spark, folder, "pros_info").select(spelled("pros_info.project").alias("project"), F.lit("fragment").alias("origin"))
    return a.unionByName(b).groupBy("project", "origin").agg(F.count(F.lit(1)).alias("records"))


@query(f"WITH {_MEMBERS} SELECT {_NAMED.format('info.project')} AS project, count(DISTINCT cluster_key) AS clusters, count(DISTINCT info.file) AS files FROM members GROUP BY 1")
def matched_files(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and files that the members of clusters come from, each once a project."""
    return members_of(spark, folder).groupBy(spelled("info.project").alias("project")).agg(F.count_distinct("cluster_key").alias("clusters"), F.count_distinct("info.file").alias("files"))


@query(
    f"""WITH {FILES} SELECT file_id, len(list_filter([{_IN(trees.REGION_KINDS)}], lambda k: list_contains(list_transform(flatten(func_ast), lambda n: n.kind), k))) AS regions, len(list_distinct(list_transform(flatten(func_ast), lambda n: n.kind))) AS kinds FROM files WHERE func_ast IS NOT NULL"""
)
def kind_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of regions among the kinds of each file's nodes."""
    kinds = F.array_distinct(F.transform(F.flatten("func_ast"), lambda n: n["kind"]))
    rows = first_rows(spark, folder, kinds=kinds).where("kinds is not null")
    return rows.select("file_id", F.size(F.array_intersect("kinds", F.array(*map(F.lit, trees.REGION_KINDS)))).cast("long").alias("regions"), F.size(F.array_compact("kinds")).cast("long").alias("kinds"))


@query(
    f"""WITH {_CLUSTERS} SELECT cluster_key, len(coalesce(else_point, [])) AS codes, len(list_distinct(list_transform(list_filter(coalesce(else_point, []), lambda x: x IS NOT NULL), lambda x: array_to_string({_TOKENS('x')}, chr(1))))) AS variants FROM own"""
)
def lexical_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of a cluster that differ by a token, comments and white space aside."""
    codes = F.coalesce("else_point", F.array().cast("array<string>"))
    keys = F.array_distinct(F.transform(F.filter(codes, lambda c: c.isNotNull()), lambda c: F.array_join(text.code_tokens(c), "\x01")))
    return clusters_of(spark, folder).select("cluster_key", F.size(codes).cast("long").alias("codes"), F.size(keys).cast("long").alias("variants"))


@query(f"""WITH {FRAGMENTS}, counted AS (SELECT {_NAMED.format('pros_name')} AS project, pros_info.node.kind AS kind, count(*) AS n FROM fragments WHERE pros_info.node.kind IS NOT NULL GROUP BY 1, 2) SELECT project, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM counted GROUP BY 1""")
def kind_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of kinds in the order of their names, as one text a project."""
    counted = fragments_of(spark, folder, "pros_name", "pros_info").where("pros_info.node.kind is not null").groupBy(spelled("pros_name").alias("project"), F.col("pros_info.node.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    # a project has as many rows here as there are kinds
    return counted.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("k")).select("project", F.array_join(F.transform("k", lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), ",").alias("kinds"))


@query(
    """WITH keyed AS (SELECT slug, corpus, coalesce(parse.analysis.candidates, MAP {}) AS c FROM project_classification), entries AS (SELECT slug, corpus, unnest(list_distinct(list_concat(['function', 'region', 'statement'], map_keys(c)))) AS k, c FROM keyed)
    SELECT slug, corpus, string_agg(k || '=' || coalesce(c[k], 0), ',' ORDER BY k) AS candidates FROM entries GROUP BY 1, 2"""
)
def merged_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of candidates of a project over defaults of zero; the project's own win."""
    defaults = F.create_map(*[F.lit(x) for k in ("function", "region", "statement") for x in (k, 0)]).cast("map<string,bigint>")
    own = F.coalesce("parse.analysis.candidates", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    merged = F.map_zip_with(defaults, own, lambda k, a, b: F.coalesce(b, a, F.lit(0)))
    entries = F.array_sort(F.map_entries(merged))
    return table(spark, folder, "project_classification").select("slug", "corpus", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("candidates"))


_SHAPED = f"""{FRAGMENTS}, lexed AS (SELECT {_NAMED.format('pros_name')} AS project, {_TOKENS('pros_src')} AS t FROM fragments WHERE pros_src IS NOT NULL),
shaped AS (SELECT project, t, md5(array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^(?:<LIT_|\\d|(?:u8|u|U|L)?R?"|(?:u8|u|U|L)?'')') THEN '<LIT>' WHEN regexp_full_match(x, '[A-Za-z_$][A-Za-z0-9_$]*') AND x NOT IN ({_IN(KEYWORDS)}) THEN '<ID>' ELSE x END), chr(1))) AS shape FROM lexed WHERE len(t) > 0)"""


@query(
    f"""WITH {_SHAPED}, placed AS (SELECT project, shape, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM shaped), sizes AS (SELECT project, shape, count(*) AS members FROM shaped GROUP BY 1, 2 HAVING count(*) >= 3),
    tokens AS (SELECT project, shape, pos, token, count(*) AS n FROM placed GROUP BY ALL), positions AS (SELECT project, shape, pos, count(*) AS variants, max(n) AS most FROM tokens GROUP BY 1, 2, 3 HAVING count(*) >= 3)
    SELECT project, shape, CAST(pos AS INT) - 1 AS position, members, variants, round(most / members, 6) AS dominance FROM positions JOIN sizes USING (project, shape)"""
)
def abstraction_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Places at which fragments of one shape, three or more, hold three different tokens or more."""
    codes = fragments_of(spark, folder, "pros_name", "pros_src").where("pros_src is not null").select(spelled("pros_name").alias("project"), text.code_tokens(F.col("pros_src")).alias("t")).where("size(t) > 0")
    shaped = codes.select("project", F.md5(F.array_join(coarse(F.col("t")), "\x01")).alias("shape"), "t")
    sizes = shaped.groupBy("project", "shape").agg(F.count(F.lit(1)).alias("members")).where("members >= 3")
    # tokens are counted before the shuffle, so a shape of any size costs its variants only
    tokens = shaped.select("project", "shape", F.posexplode("t").alias("position", "token")).groupBy("project", "shape", "position", "token").agg(F.count(F.lit(1)).alias("n"))
    places = tokens.groupBy("project", "shape", "position").agg(F.count(F.lit(1)).alias("variants"), F.max("n").alias("most")).where("variants >= 3")
    return places.join(sizes, ["project", "shape"]).select("project", "shape", "position", "members", "variants", F.round(F.col("most") / F.col("members"), 6).alias("dominance"))


@query(
    f"""WITH {_NODES}, parents AS (SELECT a.file_id, a.func_idx, a.node_idx, a.node.kind AS kind, max(b.node_idx) AS p FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND a.func_idx = b.func_idx AND b.node_idx < a.node_idx AND b.node.depth = a.node.depth - 1 GROUP BY 1, 2, 3, 4),
    rules AS (SELECT n.node.kind AS parent, string_agg(c.kind, ' ' ORDER BY c.node_idx) AS children FROM parents c JOIN nodes n ON n.file_id = c.file_id AND n.func_idx = c.func_idx AND n.node_idx = c.p GROUP BY n.file_id, n.func_idx, n.node_idx, n.node.kind)
    SELECT parent, md5(children) AS children, count(*) AS uses FROM rules GROUP BY 1, 2"""
)
def tree_productions(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of the trees: a kind, its children's kinds in order as a digest, and how often they occur."""
    nodes = placed(spark, folder).where("parent_idx is not null")
    rules = nodes.groupBy("file_id", "func_idx", "parent_idx", F.col("parent_kind").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node_idx", "kind"))).alias("c"))
    return rules.groupBy("parent", F.md5(F.array_join(F.transform("c", lambda x: x["kind"]), " ")).alias("children")).agg(F.count(F.lit(1)).alias("uses"))


@query(
    f"""WITH {_NODES}, spans AS (SELECT a.file_id, a.func_idx, a.node_idx, a.node.kind AS kind, coalesce(min(CASE WHEN b.node_idx > a.node_idx AND b.node.depth <= a.node.depth THEN b.node_idx END), max(b.node_idx) + 1) AS ended FROM nodes a JOIN nodes b ON a.file_id = b.file_id AND a.func_idx = b.func_idx GROUP BY 1, 2, 3, 4)
    SELECT s.kind, count(*) AS nodes, count(*) FILTER (EXISTS (SELECT 1 FROM nodes e WHERE e.file_id = s.file_id AND e.func_idx = s.func_idx AND e.node_idx >= s.node_idx AND e.node_idx < s.ended AND e.node.kind IN ('ERROR', 'try_statement'))) AS holding FROM spans s GROUP BY 1"""
)
def holding_subtrees(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes whose subtree holds an error or a try statement, by kind."""
    functions = first_rows(spark, folder, "func_ast").select("file_id", F.posexplode("func_ast").alias("func_idx", "tree")).where("tree is not null")
    spans = trees.spans(F.transform("tree", lambda n: F.coalesce(n["depth"], F.lit(0))))
    kinds = F.transform("tree", lambda n: n["kind"])
    rows = functions.select(kinds.alias("k"), F.posexplode(spans).alias("i", "span"))
    held = F.exists(F.slice("k", F.col("i") + 1, F.col("span")), lambda k: k.isin("ERROR", "try_statement"))
    return rows.groupBy(F.get("k", F.col("i")).alias("kind")).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce(held, F.lit(False))).alias("holding"))


@query(
    f"""WITH {_CLUSTERS}, keyed AS (SELECT lower(trim(center_point_info.project)) AS project, cluster_key, label, cluster_size, array_to_string({_TOKENS('center_point')}, chr(1)) AS k FROM own WHERE center_point IS NOT NULL)
    SELECT project, count(*) AS merged, min(cluster_key) AS first_part, max(cluster_key) AS last_part, arg_max(cluster_key, (coalesce(cluster_size, -1), -cluster_key)) AS representative, CAST(sum(cluster_size) AS BIGINT) AS members FROM keyed GROUP BY project, k HAVING count(*) >= 2"""
)
def merge_records(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with equal centres as one record: how many, the first and last of them, the largest as representative, and all members."""
    keyed = clusters_of(spark, folder).where("center_point is not null").select("project", "cluster_key", "cluster_size", F.array_join(text.code_tokens(F.col("center_point")), "\x01").alias("k"))
    best = F.max(F.struct(F.coalesce("cluster_size", F.lit(-1)).alias("s"), (-F.col("cluster_key")).alias("c"))).alias("b")
    grouped = keyed.groupBy("project", "k").agg(F.count(F.lit(1)).alias("merged"), F.min("cluster_key").alias("first_part"), F.max("cluster_key").alias("last_part"), best, F.sum("cluster_size").alias("members")).where("merged >= 2")
    return grouped.select("project", "merged", "first_part", "last_part", (-F.col("b.c")).alias("representative"), "members")


_CHECKS = {
    "no centre": ("center_point IS NULL OR trim(center_point) = ''", lambda: F.coalesce(F.trim("center_point") == "", F.lit(True))),
    "no label": ("label IS NULL", lambda: F.col("label").isNull()),
    "no members": ("coalesce(len(infos), 0) = 0", lambda: F.coalesce(F.size("infos") <= 0, F.lit(True))),
    "wrong size": ("cluster_size IS DISTINCT FROM len(infos)", lambda: ~F.col("cluster_size").eqNullSafe(F.when(F.col("infos").isNotNull(), F.size("infos")))),
    "foreign members": ("len(list_filter(infos, lambda i: lower(trim(i.project)) <> lower(trim(center_point_info.project)))) > 0", lambda: F.coalesce(F.exists("infos", lambda i: F.lower(F.trim(i["project"])) != F.lower(F.trim("center_point_info.project"))), F.lit(False))),
}


@query(f"WITH {_CLUSTERS} " + " UNION ALL ".join(f"SELECT '{name}' AS contract, count(*) FILTER ({sql}) AS violations FROM own" for name, (sql, _) in _CHECKS.items()))
def contract_checks(spark: SparkSession, folder: str) -> DataFrame:
    """How many recorded clusters break each contract, in one pass."""
    counts = clusters_of(spark, folder).agg(*[F.count_if(column()).alias(f"c{i}") for i, (_, column) in enumerate(_CHECKS.values())])
    pairs = ", ".join(f"'{name}', c{i}" for i, name in enumerate(_CHECKS))
    return counts.select(F.expr(f"stack({len(_CHECKS)}, {pairs}) AS (contract, violations)"))


@query(
    f"""WITH {_MEMBERS} SELECT 'cluster:' || m.cluster_key AS record_id, md5({_FOLD('any_value(o.center_point)')}) AS code, count(DISTINCT (info.file, info.function_extent)) AS support, count(*) AS occurrences, round(avg(info.node.subtree_size), 6) AS mean_size FROM members m JOIN own o USING (cluster_key) WHERE o.center_point IS NOT NULL GROUP BY m.cluster_key"""
)
def pattern_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each cluster: its id, the digest of its code, its support and mean size."""
    rows = clusters_of(spark, folder).where("center_point is not null").select("cluster_key", F.md5(text.fold(F.col("center_point"))).alias("code"), F.explode("infos").alias("info"))
    grouped = rows.groupBy("cluster_key", "code").agg(F.count_distinct(F.struct("info.file", "info.function_extent")).alias("support"), F.count(F.lit(1)).alias("occurrences"), F.round(F.avg("info.node.subtree_size"), 6).alias("mean_size"))
    return grouped.select(F.concat(F.lit("cluster:"), F.col("cluster_key").cast("string")).alias("record_id"), "code", "support", "occurrences", "mean_size")


@query(
    """SELECT corpus, count(*) AS projects, count(*) = count(DISTINCT slug) AS unique_slugs, count(*) BETWEEN 20 AND 30 AS in_range, count(*) FILTER (classification.primary_domain IS NULL) AS without_domain, CAST(sum(parse.analysis.source.selected_file_count) AS BIGINT) AS files FROM project_classification GROUP BY corpus"""
)
def manifest_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What a manifest must keep: unique names, a number of projects in range, and domains."""
    n = F.count(F.lit(1))
    return table(spark, folder, "project_classification").groupBy("corpus").agg(
        n.alias("projects"), (n == F.count_distinct("slug")).alias("unique_slugs"), n.between(20, 30).alias("in_range"), F.count_if(F.col("classification.primary_domain").isNull()).alias("without_domain"), F.sum("parse.analysis.source.selected_file_count").alias("files")
    )


@query(
    f"""WITH {FRAGMENTS}, parsed AS (SELECT {_NAMED.format('pros_name')} AS project, lower(trim(pros_name)) = lower(trim(pros_info.project)) AND regexp_full_match(pros_info.node.extent, '\\d+-\\d+-\\d+-\\d+') AS valid, pros_info.node.extent AS e FROM fragments)
    SELECT project, count(*) AS fragments, count(*) FILTER (valid) AS identified, CAST(sum(CASE WHEN valid THEN CAST(split_part(e, '-', 3) AS INT) - CAST(split_part(e, '-', 1) AS INT) + 1 END) AS BIGINT) AS lines FROM parsed GROUP BY 1"""
)
def region_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments with a region of their own project whose extent can be read, and its lines."""
    place = text.extent(F.col("pros_info.node.extent"))
    identity = F.when(F.lower(F.trim("pros_name")) == F.lower(F.trim("pros_info.project")), place)
    rows = fragments_of(spark, folder, "pros_name", "pros_info").select(spelled("pros_name").alias("project"), identity.alias("p"))
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("fragments"), F.count("p").alias("identified"), F.sum(F.col("p.el") - F.col("p.sl") + 1).alias("lines"))


@query(
    f"""WITH {_CLUSTERS}, folded AS (SELECT cluster_key, infos, coalesce(list_position(list_transform(infos, lambda i: {_FOLD('i.node.code_snippet')}), {_FOLD('center_point')}), 0) AS found FROM own WHERE len(infos) > 0)
    SELECT cluster_key, CAST(greatest(found, 1) - 1 AS INT) AS position, found > 0 AS by_text, infos[greatest(found, 1)].node.extent AS extent FROM folded"""
)
def representative_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The first member with the centre's text, else the first member."""
    at = F.coalesce(F.array_position(F.transform("infos", lambda i: text.fold(i["node"]["code_snippet"])), text.fold(F.col("center_point"))), F.lit(0).cast("long")).cast("int")
    rows = clusters_of(spark, folder).where("size(infos) > 0").select("cluster_key", "infos", at.alias("at"))
    position = F.greatest(F.col("at"), F.lit(1)) - 1
    return rows.select("cluster_key", position.alias("position"), (F.col("at") > 0).alias("by_text"), F.get("infos", position)["node"]["extent"].alias("extent"))


@query(
    f"""WITH {_CLUSTERS}, sets AS (SELECT cluster_key, unnest(list_concat(list_transform(coalesce(infos, []), lambda i: coalesce(i.node.kind, '') || '|' || trim(i.node.code_snippet)), [coalesce(infos[1].node.kind, '') || '|' || trim(center_point)])) AS p FROM own)
    SELECT cluster_key, count(DISTINCT p) AS patterns FROM sets WHERE p IS NOT NULL GROUP BY 1"""
)
def pattern_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Different patterns of a cluster: kinds and codes of its members, and its centre with the first member's kind."""
    pattern = lambda kind, code: F.concat(F.coalesce(kind, F.lit("")), F.lit("|"), F.trim(code))
    infos = F.transform("infos", lambda i: pattern(i["node"]["kind"], i["node"]["code_snippet"]))
    centre = F.array(pattern(F.get("infos", F.lit(0))["node"]["kind"], F.col("center_point")))
    patterns = F.array_compact(F.array_distinct(F.concat(F.coalesce(infos, F.array().cast("array<string>")), centre)))
    return clusters_of(spark, folder).select("cluster_key", F.size(patterns).cast("long").alias("patterns")).where("patterns > 0")


@query(
    f"""WITH {_CLUSTERS} SELECT cluster_key, round(coalesce(center_point_info.node.subtree_size, list_avg(list_transform(infos, lambda i: i.node.subtree_size)), 1 + list_avg(list_transform(infos, lambda i: i.node.ast_num)), 0), 6) AS size FROM own"""
)
def representative_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Size of a cluster's representative: its own, else the members' mean, else one more than their mean children."""
    known = lambda f: F.filter(F.transform("infos", lambda i: i["node"][f].cast("double")), lambda x: x.isNotNull())
    mean = lambda values: F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), F.size(values))
    size = F.coalesce(F.col("center_point_info.node.subtree_size").cast("double"), F.when(F.size(known("subtree_size")) > 0, mean(known("subtree_size"))), F.when(F.size(known("ast_num")) > 0, 1 + mean(known("ast_num"))), F.lit(0.0))
    return clusters_of(spark, folder).select("cluster_key", F.round(size, 6).alias("size"))


@query(
    f"""WITH {_MEMBERS} SELECT m.cluster_key, count(*) AS occurrences, count(DISTINCT (info.file, info.function_extent)) AS regions, coalesce(bool_and(lower(trim(info.project)) = project), false) AS one_project FROM members m GROUP BY 1"""
)
def group_context(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and regions of a cluster, and whether all are of its project."""
    rows = members_of(spark, folder)
    return rows.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(F.struct("info.file", "info.function_extent")).alias("regions"), F.coalesce(F.every(F.lower(F.trim("info.project")) == F.col("project")), F.lit(False)).alias("one_project"))


_REGION = "CASE WHEN pros_info.file IS NULL OR pros_info.function_extent IS NULL THEN 'unlocated:' || emb_id ELSE lower(trim(pros_info.project)) || '|' || pros_info.file || '|' || pros_info.function_extent END"


def region_key() -> Column:
    there = F.concat(F.lower(F.trim("pros_info.project")), F.lit("|"), "pros_info.file", F.lit("|"), "pros_info.function_extent")
    return F.when(F.col("pros_info.file").isNull() | F.col("pros_info.function_extent").isNull(), F.concat(F.lit("unlocated:"), F.col("emb_id").cast("string"))).otherwise(there)


@query(
    f"""WITH {FRAGMENTS}, keyed AS (SELECT emb_id, {_REGION} AS region, pros_info.node.start_byte AS s, pros_info.node.end_byte AS e, pros_info.node.extent AS x FROM fragments)
    SELECT emb_id, region, row_number() OVER (PARTITION BY region ORDER BY s NULLS FIRST, e NULLS FIRST, x NULLS FIRST, emb_id) AS position FROM keyed"""
)
def occurrence_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The function each fragment occurs in, and its place among the fragments there."""
    n = "pros_info.node"
    rows = fragments_of(spark, folder, "pros_info").select("emb_id", region_key().alias("region"), F.col(f"{n}.start_byte").alias("s"), F.col(f"{n}.end_byte").alias("e"), F.col(f"{n}.extent").alias("x"))
    return rows.select("emb_id", "region", F.row_number().over(Window.partitionBy("region").orderBy("s", "e", "x", "emb_id")).alias("position"))


@query(
    f"""WITH {FRAGMENTS}, keyed AS (SELECT emb_id, {_REGION} AS region FROM fragments) SELECT region, count(*) AS fragments, concat_ws('+', 'combination:' || min(emb_id), CAST(max(emb_id) AS VARCHAR), CAST(sum(emb_id) AS VARCHAR)) AS combination FROM keyed GROUP BY 1 HAVING count(*) >= 2"""
)
def combination_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A key for the fragments of a function together: their smallest, largest and summed ids, which need no list of them."""
    rows = fragments_of(spark, folder, "pros_info").select("emb_id", region_key().alias("region"))
    grouped = rows.groupBy("region").agg(F.count(F.lit(1)).alias("fragments"), *[f("emb_id").cast("string").alias(n) for f, n in ((F.min, "low"), (F.max, "high"), (F.sum, "all"))]).where("fragments >= 2")
    return grouped.select("region", "fragments", F.concat_ws("+", F.concat(F.lit("combination:"), F.col("low")), "high", "all").alias("combination"))


@query(
    f"""WITH {LATEST}, sized AS (SELECT *, coalesce(len(error_ranges), 0) AS errors, coalesce(len(missing_ranges), 0) AS missing, coalesce(list_sum(list_transform(error_ranges, lambda r: r.end_byte - r.start_byte)), 0) AS error_bytes FROM latest)
    SELECT file_id, {_NAMED.format('project')} AS project, {_POSIX('source_path')} AS path, coalesce(status, 'unknown') AS status, byte_count, ast_node_count, named_node_count, function_definition_count, CAST(errors AS INT) AS errors, CAST(missing AS INT) AS missing,
    CAST(error_bytes AS BIGINT) AS error_bytes, coalesce(macro_related_error_count, 0) AS macro_errors, coalesce(root_covers_source, false) AS covers, round(coalesce(reliable_significant_byte_count / nullif(significant_byte_count, 0), 0), 6) AS reliable, errors + missing = 0 AS clean FROM sized"""
)
def evidence_records(spark: SparkSession, folder: str) -> DataFrame:
    """The parser's latest record of each file with what follows from it."""
    rows = latest_evidence(spark, folder, "project", "source_path", "byte_count", "ast_node_count", "named_node_count", "function_definition_count", "error_ranges", "missing_ranges", "macro_related_error_count", "root_covers_source", "significant_byte_count", "reliable_significant_byte_count")
    count = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    spread = F.coalesce(F.aggregate("error_ranges", F.lit(0).cast("long"), lambda a, r: a + r["end_byte"] - r["start_byte"]), F.lit(0).cast("long"))
    reliable = F.coalesce(F.try_divide(F.col("reliable_significant_byte_count").cast("double"), F.col("significant_byte_count")), F.lit(0.0))
    return rows.select(
        "file_id", spelled("project").alias("project"), path("source_path").alias("path"), F.coalesce("status", F.lit("unknown")).alias("status"), "byte_count", "ast_node_count", "named_node_count", "function_definition_count",
        count("error_ranges").alias("errors"), count("missing_ranges").alias("missing"), spread.alias("error_bytes"), F.coalesce("macro_related_error_count", F.lit(0)).alias("macro_errors"), F.coalesce("root_covers_source", F.lit(False)).alias("covers"),
        F.round(reliable, 6).alias("reliable"), (count("error_ranges") + count("missing_ranges") == 0).alias("clean"),
    )
