"""Queries on files: scanning, splits, paths, code texts and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quarryline.functions import scores, text
from quarryline.operators import windows
from quarryline.plans.lineage import spread, table
from quarryline.queries.registry import FILES, FRAGMENTS, LATEST, Registry
from quarryline.sources import scan

_R = Registry()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_PATH = r"lower(regexp_replace(replace(cppFile, '\', '/'), '^(\./)+', ''))"
_REASON = rf"""
paths AS (SELECT file_id, corpus, {_PATH} AS p FROM files),
parts AS (SELECT file_id, unnest(string_split(p, '/')) AS x, generate_subscripts(string_split(p, '/'), 1) AS i, len(string_split(p, '/')) AS n FROM paths),
barred AS (SELECT file_id, arg_min(CASE WHEN x LIKE '.%' THEN 'hidden-directory' ELSE 'excluded-directory' END, i) AS r FROM parts
  WHERE i < n AND (x LIKE '.%' OR x LIKE 'bazel-%' OR x LIKE 'cmake-build-%' OR x IN ({", ".join(f"'{d}'" for d in scan.EXCLUDED_FOLDERS)})) GROUP BY file_id),
reasons AS (SELECT paths.file_id, corpus, CASE WHEN r IS NOT NULL THEN r
  WHEN regexp_matches(regexp_replace(regexp_extract(p, '[^/]*$'), '\.[^.]*$', ''), '(^|[^a-z0-9])(test|tests|unittest|unittests)([^a-z0-9]|$)') THEN 'test-file'
  WHEN {" OR ".join(f"regexp_matches(regexp_extract(p, '[^/]*$'), '{g}')" for g in scan.GENERATED_NAMES)} THEN 'generated-file' ELSE 'kept' END AS reason
  FROM paths LEFT JOIN barred USING (file_id))"""


def _project() -> Column:
    """A project in one spelling; files and records without one stay together."""
    return F.coalesce(F.lower(F.trim("project")), F.lit("unknown"))


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    return scan.first_deliveries(table(spark, folder, "dataset"), "file_id", "ingested_at")


def first_rows(spark: SparkSession, folder: str, *columns: str, **derived: Column) -> DataFrame:
    """The first delivery of each file: some of its columns, and what is derived from others before deliveries meet."""
    files = table(spark, folder, "dataset")
    rows = (spread(files) if derived else files).select("file_id", "ingested_at", *columns, *[c.alias(n) for n, c in derived.items()])
    return scan.first_deliveries(rows, "file_id", "ingested_at")


def fragments_of(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return scan.first_deliveries(table(spark, folder, "embedding").select("emb_id", "ingested_at", *columns), "emb_id", "ingested_at")


def latest_evidence(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    newest = Window.partitionBy("file_id").orderBy(F.desc("scanned_at"), F.asc_nulls_last("status"))
    rows = table(spark, folder, "source_evidence").where("file_id is not null and scanned_at is not null").select("file_id", "scanned_at", *dict.fromkeys(("status", *columns)))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


@query(f"WITH {FILES}, {_REASON} SELECT file_id, reason FROM reasons")
def exclusion_reasons(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.coalesce(scan.exclusion_reason(F.col("cppFile")), F.lit("kept"))
    return first_rows(spark, folder, "cppFile").select("file_id", reason.alias("reason"))


@query(f"WITH {FILES}, {_REASON} SELECT corpus, reason, count(*) AS files FROM reasons GROUP BY corpus, reason")
def scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.coalesce(scan.exclusion_reason(F.col("cppFile")), F.lit("kept"))
    return first_rows(spark, folder, "corpus", "cppFile").groupBy("corpus", reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"))


@query(
    f"""WITH {FILES} SELECT file_id, coalesce(lower(trim(split)), 'train') AS split, len(list_filter(func_src, lambda x: x IS NOT NULL AND x <> '')) AS functions
    FROM files WHERE len(list_filter(func_src, lambda x: x IS NOT NULL AND x <> '')) > 0"""
)
def valid_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files with functions; a null split is train."""
    functions = F.size(F.filter("func_src", lambda x: x.isNotNull() & (x != ""))).cast("long")
    rows = first_rows(spark, folder, split=F.coalesce(F.lower(F.trim("split")), F.lit("train")), functions=functions)
    return rows.where("functions > 0").select("file_id", "split", "functions")


@query("SELECT file_id, count(*) AS deliveries, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM dataset WHERE file_id IS NOT NULL GROUP BY file_id HAVING count(*) > 1")
def repeated_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dataset").where("file_id is not null").groupBy("file_id")
    return rows.agg(F.count(F.lit(1)).alias("deliveries"), F.min("ingested_at").alias("first_at"), F.max("ingested_at").alias("last_at")).where("deliveries > 1")


@query("SELECT emb_id, count(*) AS deliveries, count(DISTINCT lower(trim(pros_name))) AS names FROM embedding GROUP BY emb_id HAVING count(*) > 1")
def repeated_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments delivered more than once, with the number of spellings-apart project names."""
    rows = table(spark, folder, "embedding").groupBy("emb_id")
    return rows.agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct(F.lower(F.trim("pros_name"))).alias("names")).where("deliveries > 1")


@query(
    f"""WITH {FILES}, names AS (SELECT corpus, coalesce(lower(trim(project)), 'unknown') AS project, regexp_extract({_PATH}, '[^/]*$') AS name FROM files)
    SELECT corpus, project, name, count(*) AS files FROM names GROUP BY corpus, project, name HAVING count(*) > 1"""
)
def basename_collisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = first_rows(spark, folder, "corpus", project=_project(), name=F.lower(scan.file_name(F.col("cppFile"))))
    grouped = rows.groupBy("corpus", "project", "name")
    return grouped.agg(F.count(F.lit(1)).alias("files")).where("files > 1")


@query(
    f"""WITH {FILES}, paths AS (SELECT lower(trim(corpus)) AS corpus, {_PATH} AS p FROM files),
    names AS (SELECT DISTINCT regexp_replace(p, '^repos/(project|library)/[^/]+/', '') AS path FROM paths),
    firsts AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM names),
    unique_names AS (SELECT name FROM firsts GROUP BY name HAVING count(*) = 1),
    {FRAGMENTS},
    wanted AS (SELECT emb_id, lower(regexp_replace(replace(pros_info.file, '\\', '/'), '^(\\./)+', '')) AS file FROM fragments WHERE pros_info.file IS NOT NULL)
    SELECT CASE WHEN a.path IS NOT NULL THEN 'exact' WHEN b.path IS NOT NULL THEN 'suffix' WHEN u.name IS NOT NULL THEN 'name' ELSE 'none' END AS matched, count(*) AS fragments
    FROM wanted LEFT JOIN names a ON a.path = file LEFT JOIN names b ON b.path = regexp_replace(file, '^repos/(project|library)/[^/]+/', '')
    LEFT JOIN unique_names u ON u.name = regexp_extract(file, '[^/]*$') GROUP BY 1"""
)
def path_fallback_join(spark: SparkSession, folder: str) -> DataFrame:
    """Files of fragments found by whole path, then by path within the repository, then by a unique name."""
    inner = lambda p: F.regexp_replace(p, "^repos/(project|library)/[^/]+/", "")
    paths = first_rows(spark, folder, "cppFile").select(inner(F.lower(scan.posix(F.col("cppFile")))).alias("path")).distinct()
    unique = paths.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("name", F.lit(True).alias("by_name"))
    wanted = fragments_of(spark, folder, "pros_info").where("pros_info.file is not null").select(F.lower(scan.posix(F.col("pros_info.file"))).alias("file"))
    # one row for each spelling, so the joins meet distinct paths only
    counted = wanted.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", "n", inner(F.col("file")).alias("inner_path"), F.substring_index("file", "/", -1).alias("name"))
    joined = counted.join(paths.select(F.col("path").alias("file"), F.lit(True).alias("exact")), "file", "left")
    joined = joined.join(paths.select(F.col("path").alias("inner_path"), F.lit(True).alias("suffix")), "inner_path", "left").join(unique, "name", "left")
    kind = F.when(F.col("exact"), "exact").when(F.col("suffix"), "suffix").when(F.col("by_name"), "name").otherwise("none")
    return joined.groupBy(kind.alias("matched")).agg(F.sum("n").alias("fragments"))


@query(
    f"""WITH {FILES}, known AS (SELECT DISTINCT file_id FROM source_evidence WHERE file_id IS NOT NULL), own AS (SELECT file_id FROM files)
    SELECT 'without record' AS side, count(*) AS files FROM own WHERE file_id NOT IN (SELECT file_id FROM known)
    UNION ALL SELECT 'without file', count(*) FROM known WHERE file_id NOT IN (SELECT file_id FROM own)"""
)
def label_join_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Files without a record and records without a file."""
    own = table(spark, folder, "dataset").select("file_id").where("file_id is not null").distinct()
    known = table(spark, folder, "source_evidence").select("file_id").where("file_id is not null").distinct()
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("files")).select(F.lit(side).alias("side"), "files")
    return count(own.join(known, "file_id", "left_anti"), "without record").union(count(known.join(own, "file_id", "left_anti"), "without file"))


@query(
    """SELECT file_id FROM (SELECT DISTINCT file_id FROM dataset WHERE file_id IS NOT NULL) WHERE file_id NOT IN
    (SELECT file_id FROM source_evidence WHERE file_id IS NOT NULL AND status IN ('clean', 'recovered', 'recovered_no_function'))"""
)
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a resumed run must still parse."""
    work = table(spark, folder, "dataset").select("file_id").where("file_id is not null").distinct()
    done = table(spark, folder, "source_evidence").where(F.col("status").isin("clean", "recovered", "recovered_no_function"))
    return scan.pending(work, done, "file_id")


@query(f"WITH {LATEST} SELECT coalesce(status, 'unknown') AS status, count(*) AS files, CAST(sum(byte_count) AS BIGINT) AS bytes FROM latest GROUP BY 1")
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_evidence(spark, folder, "byte_count")
    return rows.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("files"), F.sum("byte_count").alias("bytes"))


@query(
    f"""WITH {LATEST} SELECT CASE WHEN grouping(p) = 1 THEN 'all' ELSE p END AS project, count(*) AS files, CAST(sum(byte_count) AS BIGINT) AS bytes, CAST(sum(function_definition_count) AS BIGINT) AS functions,
    CAST(sum(len(error_ranges)) AS BIGINT) AS errors, round(coalesce(sum(reliable_significant_byte_count) / nullif(sum(significant_byte_count), 0), 0), 6) AS reliable
    FROM (SELECT *, coalesce(lower(trim(project)), 'unknown') AS p FROM latest) GROUP BY GROUPING SETS ((p), ())"""
)
def project_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the parser's records per project and over all, with the micro ratio of reliable bytes."""
    rows = latest_evidence(spark, folder, "project", "byte_count", "function_definition_count", "error_ranges", "significant_byte_count", "reliable_significant_byte_count")
    rolled = rows.withColumn("project", _project()).rollup("project").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("byte_count").alias("bytes"),
        F.sum("function_definition_count").alias("functions"),
        F.sum(F.size("error_ranges")).cast("long").alias("errors"),
        F.round(scores.ratio(F.sum("reliable_significant_byte_count"), F.sum("significant_byte_count")), 6).alias("reliable"),
    )
    return rolled.withColumn("project", F.coalesce("project", F.lit("all")))


@query(
    f"""WITH {FILES}, functions AS (SELECT file_id, unnest(func_src) AS code FROM files),
    tokens AS (SELECT file_id, list_filter(regexp_extract_all(code, '{text.CODE_TOKEN.replace("'", "''")}'), lambda t: NOT (t LIKE '//%' OR t LIKE '/*%')) AS t FROM functions WHERE code IS NOT NULL)
    SELECT file_id, CAST(sum(len(t)) AS BIGINT) AS tokens, max(len(t)) AS longest FROM tokens GROUP BY file_id"""
)
def code_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each file's functions, comments aside."""
    sizes = F.transform(F.filter("func_src", lambda c: c.isNotNull()), lambda c: F.size(text.code_tokens(c)))
    counted = first_rows(spark, folder, sizes=sizes).select("file_id", F.explode("sizes").alias("n"))
    return counted.groupBy("file_id").agg(F.sum("n").alias("tokens"), F.max("n").cast("long").alias("longest"))


@query(
    f"""WITH {FILES}, functions AS (SELECT coalesce(lower(trim(project)), 'unknown') AS project, unnest(func_src) AS code FROM files),
    calls AS (SELECT project, unnest(list_distinct(regexp_extract_all(code, '\\b([A-Za-z_][A-Za-z0-9_:]*)\\s*\\(', 1))) AS target FROM functions WHERE code IS NOT NULL)
    SELECT project, count(*) AS calls, count(DISTINCT target) AS targets FROM calls WHERE target NOT IN ({", ".join(f"'{n}'" for n in text.NO_CALLS)}) GROUP BY project"""
)
def call_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Functions' call targets per project: how many, and how many different ones."""
    targets = F.flatten(F.transform(F.filter("func_src", lambda c: c.isNotNull()), text.call_targets))
    calls = first_rows(spark, folder, project=_project(), targets=targets).select("project", F.explode("targets").alias("target"))
    return calls.groupBy("project").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("target").alias("targets"))


@query(
    f"""WITH {FRAGMENTS}, codes AS (SELECT pros_info.node.kind AS kind, pros_src AS code, trim(regexp_replace(pros_src, '\\s+', ' ', 'g')) AS folded FROM fragments WHERE pros_src IS NOT NULL)
    SELECT kind, count(*) AS fragments, count(*) - count(DISTINCT code) AS exact_copies, count(*) - count(DISTINCT folded) AS folded_copies FROM codes GROUP BY kind"""
)
def duplicate_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Copies among fragments of a kind, as they are and with white space folded; texts count as equal by their SHA-256."""
    code = lambda c: F.unhex(F.sha2(c, 256))
    rows = table(spark, folder, "embedding").where("pros_src is not null").select("emb_id", "ingested_at", F.col("pros_info.node.kind").alias("kind"), code(F.col("pros_src")).alias("code"), code(text.fold(F.col("pros_src"))).alias("folded"))
    rows = scan.first_deliveries(rows, "emb_id", "ingested_at")
    n = F.count(F.lit(1))
    return rows.groupBy("kind").agg(n.alias("fragments"), (n - F.count_distinct("code")).alias("exact_copies"), (n - F.count_distinct("folded")).alias("folded_copies"))


@query(
    """WITH sizes AS (SELECT source, coalesce(length(text), 0) AS n, coalesce(length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')), 0) AS cjk FROM documents)
    SELECT coalesce(source, 'unknown') AS source, count(*) AS docs, CAST(sum(CAST(floor(cjk / 1.5 + (n - cjk) / 4.0) AS INT)) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS characters FROM sizes GROUP BY 1"""
)
def approximate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("source", "text")
    grouped = rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"))
    return grouped.agg(F.count(F.lit(1)).alias("docs"), F.sum(text.approximate_tokens(F.col("text"))).alias("tokens"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("characters"))


@query(
    f"""WITH {FILES}, counts AS (SELECT file_id, func_idx, max(token_count) AS n FROM cpp_lexical_analysis WHERE file_id IS NOT NULL AND func_idx IS NOT NULL AND token_count IS NOT NULL GROUP BY ALL)
    SELECT coalesce(corpus, 'all') AS corpus, count(*) AS functions, count(*) FILTER (n > 512) AS over_budget, min(n) AS shortest, max(n) AS longest,
    round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99
    FROM counts JOIN files USING (file_id) GROUP BY GROUPING SETS ((corpus), ())"""
)
def token_summary_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Token lengths of functions per corpus and over all, and how many exceed 512."""
    lexical = table(spark, folder, "cpp_lexical_analysis").where("file_id is not null and func_idx is not null and token_count is not null")
    counts = lexical.groupBy("file_id", "func_idx").agg(F.max("token_count").alias("n"))
    joined = counts.join(first_rows(spark, folder, "corpus").select("file_id", "corpus"), "file_id")
    rolled = joined.rollup("corpus").agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.col("n") > 512).alias("over_budget"), F.min("n").alias("shortest"), F.max("n").alias("longest"), *scores.percentiles("n", (0.5, 0.9, 0.99)))
    return rolled.withColumn("corpus", F.coalesce("corpus", F.lit("all")))


@query(
    f"""WITH {FILES}, sizes AS (SELECT corpus, coalesce(len(list_filter(func_src, lambda x: x IS NOT NULL)), 0) AS functions, list_sum(list_transform(func_src, lambda x: length(coalesce(x, '')) - length(replace(coalesce(x, ''), chr(10), '')) + 1)) AS lines FROM files)
    SELECT corpus, CASE WHEN lines IS NULL THEN 'none' WHEN lines < 50 THEN '1-49' WHEN lines < 100 THEN '50-99' WHEN lines < 200 THEN '100-199' ELSE '200+' END AS bucket, count(*) AS files, CAST(sum(functions) AS BIGINT) AS functions FROM sizes GROUP BY 1, 2"""
)
def bucket_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Files by their number of lines."""
    breaks = F.aggregate(F.transform("func_src", lambda x: F.length(F.coalesce(x, F.lit(""))) - F.length(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(""))) + 1), F.lit(0), lambda a, b: a + b)
    lines = F.when(F.size("func_src") > 0, breaks)
    functions = F.coalesce(F.when(F.col("func_src").isNotNull(), F.size(F.filter("func_src", lambda x: x.isNotNull()))), F.lit(0))
    rows = first_rows(spark, folder, "corpus", lines=lines, functions=functions)
    bucket = F.when(F.col("lines").isNull(), "none").when(F.col("lines") < 50, "1-49").when(F.col("lines") < 100, "50-99").when(F.col("lines") < 200, "100-199").otherwise("200+")
    return rows.groupBy("corpus", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("files"), F.sum("functions").alias("functions"))


@query(
    """WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(l) AS lines, list_max(list_transform(l, lambda x: length(x))) AS longest, CAST(list_sum(list_transform(l, lambda x: strlen(x) + 1)) - strlen(l[-1]) - 1 AS BIGINT) AS last_offset FROM lines"""
)
def line_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each text, the longest, and the byte at which the last one begins."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text", F.split("text", "\n").alias("l"))
    last = F.octet_length("text") - F.octet_length(F.element_at("l", -1))
    return rows.select("doc_id", F.size("l").cast("long").alias("lines"), F.array_max(F.transform("l", F.length)).cast("long").alias("longest"), last.cast("long").alias("last_offset"))


@query(
    """SELECT source, project, doc_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY source, project ORDER BY created_at DESC, doc_id) AS n FROM documents
    WHERE source IS NOT NULL AND project IS NOT NULL AND created_at IS NOT NULL) WHERE n <= 5"""
)
def history_trim(spark: SparkSession, folder: str) -> DataFrame:
    """The five newest documents of each source and project."""
    rows = table(spark, folder, "documents").where("source is not null and project is not null and created_at is not null").select("source", "project", "doc_id", "created_at")
    return windows.last_rows(rows, ["source", "project"], [F.desc("created_at"), F.col("doc_id")], 5)


@query()
def budget_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 128 approximate tokens that each document's lines fall into, in their order."""
    sizes = F.transform(F.split("text", "\n"), text.approximate_tokens)
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", windows.budget_chunks(sizes, 128).alias("chunks"))
    return rows.select("doc_id", F.size("chunks").alias("n"), F.array_max("chunks").alias("largest"))


@query(
    """SELECT slug, corpus, round((rank() OVER o - 1 + (count(*) OVER (PARTITION BY corpus, v) - 1) / 2) / greatest(count(*) OVER (PARTITION BY corpus) - 1, 1), 6) AS percentile
    FROM (SELECT slug, corpus, parse.analysis.source.effective_line_count AS v FROM project_classification) WINDOW o AS (PARTITION BY corpus ORDER BY v)"""
)
def avg_rank_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """Where a project's line count stands in its corpus; ties share their average rank."""
    rows = table(spark, folder, "project_classification").select("slug", "corpus", F.col("parse.analysis.source.effective_line_count").alias("v"))
    return rows.select("slug", "corpus", F.round(windows.average_rank(["corpus"], "v"), 6).alias("percentile"))


@query(
    """SELECT corpus, coalesce(classification.primary_domain, 'unknown') AS domain, t AS tier, count(*) AS projects FROM (SELECT *, CAST(least(floor((row_number() OVER (PARTITION BY corpus ORDER BY parse.analysis.source.selected_file_count, slug) - 1) * 3 /
    count(*) OVER (PARTITION BY corpus)), 2) AS INT) AS t FROM project_classification) GROUP BY 1, 2, 3"""
)
def tertile_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Projects by domain and size tier."""
    rows = table(spark, folder, "project_classification").select("corpus", "slug", F.coalesce("classification.primary_domain", F.lit("unknown")).alias("domain"), F.col("parse.analysis.source.selected_file_count").alias("files"))
    tiered = rows.withColumn("tier", windows.tier(["corpus"], [F.col("files"), F.col("slug")]))
    return tiered.groupBy("corpus", "domain", "tier").agg(F.count(F.lit(1)).alias("projects"))


@query(
    f"""WITH {FILES}, used AS (SELECT lower(trim(project)) AS slug, corpus, count(*) AS files FROM files WHERE project IS NOT NULL GROUP BY 1, 2)
    SELECT m.slug, m.corpus, coalesce(files, 0) AS files, selection.status AS status FROM project_classification m LEFT JOIN used ON used.slug = lower(trim(m.slug)) AND used.corpus = m.corpus"""
)
def manifest_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that each project of the catalogue has in the corpus."""
    used = first_rows(spark, folder, "project", "corpus").where("project is not null").groupBy(F.lower(F.trim("project")).alias("key"), "corpus").agg(F.count(F.lit(1)).alias("n"))
    catalogue = table(spark, folder, "project_classification").select("slug", "corpus", F.lower(F.trim("slug")).alias("key"), F.col("selection.status").alias("status"))
    return catalogue.join(used, ["key", "corpus"], "left").select("slug", "corpus", F.coalesce("n", F.lit(0).cast("long")).alias("files"), "status")
