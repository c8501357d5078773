"""Queries on budgets, places in sources, samples and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quarryline.functions import text
from quarryline.operators import intervals, windows
from quarryline.plans.lineage import table
from quarryline.queries.files import first_rows, fragments_of, latest_evidence
from quarryline.queries.mining import _CLUSTERS, _MEMBERS, clusters_of, members_of
from quarryline.queries.ranges import _NODES, _RANGES, _UNION
from quarryline.queries.records import _BUDGETED, _FOLD, _NAMED, _POSIX, _TOKENS, _TYPE, BUDGET, budgeted, candidate_type, path, spelled
from quarryline.queries.registry import FILES, FRAGMENTS, LATEST, Registry
from quarryline.sources import scan, sinks

_R = Registry()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_SPLIT = "CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) = 'test' THEN 'test' END"


@query(f"WITH {FILES} SELECT {_SPLIT} AS split, {_NAMED.format('project')} AS project, count(*) AS files, CAST(sum(len(func_src)) AS BIGINT) AS functions, count(*) FILTER (len(func_src) = len(func_ast)) AS aligned FROM files WHERE {_SPLIT} IS NOT NULL GROUP BY 1, 2")
def split_view(spark: SparkSession, folder: str) -> DataFrame:
    """Train and test files of each project, and those whose columns of functions are equally long."""
    name = F.lower(F.trim("split"))
    split = F.when(name.isin("train", "training"), "train").when(name == "test", "test")
    rows = first_rows(spark, folder, split=split, project=spelled("project"), n=F.when(F.col("func_src").isNotNull(), F.size("func_src")), m=F.when(F.col("func_ast").isNotNull(), F.size("func_ast"))).where("split is not null")
    return rows.groupBy("split", "project").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("functions"), F.count_if(F.col("n") == F.col("m")).alias("aligned"))


@query(
    f"""WITH {_NODES}, lined AS (SELECT file_id, string_split(array_to_string(func_src, chr(10) || chr(10)), chr(10)) AS l FROM files WHERE func_src IS NOT NULL),
    placed AS (SELECT n.file_id, n.func_idx, l, CAST(split_part(n.node.extent, '-', 1) AS INT) AS sl, CAST(split_part(n.node.extent, '-', 2) AS INT) AS sc, CAST(split_part(n.node.extent, '-', 3) AS INT) AS el, CAST(split_part(n.node.extent, '-', 4) AS INT) AS ec
      FROM nodes n JOIN lined USING (file_id) WHERE n.node_idx = 0 AND regexp_full_match(n.node.extent, '\\d+-\\d+-\\d+-\\d+'))
    SELECT file_id, func_idx, CASE WHEN sl BETWEEN 1 AND len(l) THEN CAST(coalesce(list_sum(list_transform(l[1:sl - 1], lambda x: strlen(x) + 1)), 0) + strlen(left(l[sl], sc)) AS BIGINT) END AS start_byte,
    CASE WHEN el BETWEEN 1 AND len(l) THEN CAST(coalesce(list_sum(list_transform(l[1:el - 1], lambda x: strlen(x) + 1)), 0) + strlen(left(l[el], ec)) AS BIGINT) END AS end_byte FROM placed"""
)
def extent_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The byte range of each function in its file's text by its extent; null where the text has no such line."""
    rows = first_rows(spark, folder, lines=F.split(F.array_join("func_src", "\n\n"), "\n"), roots=F.transform("func_ast", lambda t: F.get(t, F.lit(0))["extent"])).where("lines is not null")
    # the bytes before each line once a file, before its functions become rows
    offsets = F.aggregate("lines", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(x) + 1)))
    functions = rows.select("file_id", "lines", offsets.alias("offsets"), F.posexplode("roots").alias("func_idx", "e")).withColumn("x", text.extent(F.col("e"))).where("x is not null")
    at = lambda line, column: F.when(F.col(line).between(1, F.size("lines")), (F.get("offsets", F.col(line) - 1) + F.octet_length(F.left(F.get("lines", F.col(line) - 1), F.col(column)))).cast("long"))
    return functions.select("file_id", "func_idx", at("x.sl", "x.sc").alias("start_byte"), at("x.el", "x.ec").alias("end_byte"))


_TEXTS = f"""{FILES}, {FRAGMENTS}, one AS (SELECT {_POSIX('cppFile')} AS p, count(*) AS n, any_value(string_split(array_to_string(func_src, chr(10) || chr(10)), chr(10))) AS l FROM files WHERE cppFile IS NOT NULL AND func_src IS NOT NULL GROUP BY 1),
wanted AS (SELECT emb_id, pros_info, pros_name, {_POSIX('pros_info.file')} AS p, TRY_CAST(split_part(pros_info.node.extent, '-', 1) AS INT) AS sl, TRY_CAST(split_part(pros_info.node.extent, '-', 3) AS INT) AS el, regexp_full_match(coalesce(pros_info.node.extent, ''), '\\d+-\\d+-\\d+-\\d+') AS readable FROM fragments),
found AS (SELECT w.*, one.n, len(l) AS lines, array_to_string(l[sl:el], chr(10)) AS body FROM wanted w LEFT JOIN one ON one.p = w.p)"""
#: Most lines and characters of a context.
MOST_LINES, MOST_CHARACTERS = 20, 800


@query(
    f"""WITH {_TEXTS} SELECT emb_id, CASE WHEN pros_info IS NULL OR pros_info.file IS NULL THEN 'no source' WHEN lower(trim(pros_info.project)) IS DISTINCT FROM lower(trim(pros_name)) THEN 'foreign project' WHEN NOT readable THEN 'no extent' WHEN n IS NULL THEN 'no file' WHEN n > 1 THEN 'ambiguous file'
    WHEN el < sl OR sl < 1 THEN 'reversed extent' WHEN el > lines THEN 'beyond the end' WHEN el - sl + 1 > {MOST_LINES} THEN 'too many lines' WHEN length(body) > {MOST_CHARACTERS} THEN 'too many characters' ELSE 'found' END AS outcome FROM found"""
)
def context_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the source of each fragment can be read within the budgets, or why not."""
    files = first_rows(spark, folder, p=path("cppFile"), l=F.split(F.array_join("func_src", "\n\n"), "\n")).where("p is not null and l is not null")
    # of each line only its length is kept, so no text meets the fragments
    sizes = files.select("p", F.transform("l", F.length).alias("sizes"))
    one = sizes.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.first("sizes").alias("sizes"))
    i = "pros_info"
    wanted = fragments_of(spark, folder, "pros_name", i).select("emb_id", (F.col(i).isNull() | F.col(f"{i}.file").isNull()).alias("sourceless"), (~F.lower(F.trim(f"{i}.project")).eqNullSafe(F.lower(F.trim("pros_name")))).alias("foreign"), path(f"{i}.file").alias("p"), text.extent(F.col(f"{i}.node.extent")).alias("x"))
    joined = wanted.join(one, "p", "left")
    length = F.col("x.el") - F.col("x.sl") + 1
    characters = F.aggregate(F.slice("sizes", F.greatest(F.col("x.sl"), F.lit(1)), F.greatest(length, F.lit(0))), F.lit(-1), lambda a, n: a + n + 1)
    outcome = (
        F.when(F.col("sourceless"), "no source").when(F.col("foreign"), "foreign project").when(F.col("x").isNull(), "no extent").when(F.col("n").isNull(), "no file").when(F.col("n") > 1, "ambiguous file")
        .when((length < 1) | (F.col("x.sl") < 1), "reversed extent").when(F.col("x.el") > F.size("sizes"), "beyond the end").when(length > MOST_LINES, "too many lines").when(characters > MOST_CHARACTERS, "too many characters").otherwise("found")
    )
    return joined.select("emb_id", outcome.alias("outcome"))


@query(f"WITH {_MEMBERS}, counted AS (SELECT cluster_key, count(DISTINCT lower(trim(info.project))) AS projects FROM members GROUP BY 1) SELECT projects, count(*) AS clusters FROM counted GROUP BY 1")
def single_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters by the number of projects their members are of: one, by contract."""
    counted = members_of(spark, folder).groupBy("cluster_key").agg(F.count_distinct(F.lower(F.trim("info.project"))).alias("projects"))
    return counted.groupBy("projects").agg(F.count(F.lit(1)).alias("clusters"))


_EIGHT = lambda i: f"concat_ws('|', lower(trim({i}.project)), {i}.file, {i}.function_extent, {i}.node.extent, {i}.node.kind, {i}.node.start_byte, {i}.node.end_byte, {i}.node.subtree_size)"


def eight_part_key(i: str) -> Column:
    return F.concat_ws("|", F.lower(F.trim(f"{i}.project")), f"{i}.file", f"{i}.function_extent", f"{i}.node.extent", f"{i}.node.kind", *[F.col(f"{i}.node.{f}").cast("string") for f in ("start_byte", "end_byte", "subtree_size")])


@query(
    f"""WITH {_MEMBERS}, {FRAGMENTS}, keys AS (SELECT {_EIGHT('pros_info')} AS k, count(*) AS n FROM fragments WHERE pros_info IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'one' END AS matched, count(*) AS members FROM members LEFT JOIN keys ON {_EIGHT('info')} = k GROUP BY 1"""
)
def member_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Members by the number of fragments with their eight-part key: one, by contract."""
    keys = fragments_of(spark, folder, "pros_info").where("pros_info is not null").groupBy(eight_part_key("pros_info").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = members_of(spark, folder).select(eight_part_key("info").alias("k")).join(keys, "k", "left")
    return joined.groupBy(F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("one").alias("matched")).agg(F.count(F.lit(1)).alias("members"))


@query(
    f"""WITH {_CLUSTERS}, {_NODES}, patterns AS (SELECT cluster_key, CASE WHEN label IS NULL THEN '' ELSE coalesce(center_point_info.node.kind, '') END AS kind, {_FOLD('center_point')} AS code FROM own WHERE center_point IS NOT NULL),
    coded AS (SELECT node.kind AS kind, {_FOLD('node.code_snippet')} AS code FROM nodes WHERE node.code_snippet IS NOT NULL)
    SELECT cluster_key, p.kind = '' AS any_kind, count(*) AS nodes FROM patterns p JOIN coded c ON p.code = c.code AND (p.kind = '' OR p.kind = c.kind) GROUP BY 1, 2"""
)
def kind_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with a centre's code and kind; a centre without a kind or label takes nodes of any kind."""
    kind = F.when(F.col("label").isNull(), "").otherwise(F.coalesce("center_point_info.node.kind", F.lit("")))
    patterns = clusters_of(spark, folder).where("center_point is not null").select("cluster_key", kind.alias("kind"), text.fold(F.col("center_point")).alias("code"))
    coded = F.transform(F.flatten("func_ast"), lambda n: F.struct(n["kind"].alias("kind"), F.sha2(text.fold(n["code_snippet"]), 256).alias("code")))
    nodes = first_rows(spark, folder, coded=coded).select(F.explode("coded").alias("n")).select("n.*").where("code is not null").groupBy("kind", "code").agg(F.count(F.lit(1)).alias("nodes"))
    keyed = patterns.select("cluster_key", (F.col("kind") == "").alias("any_kind"), "kind", F.sha2("code", 256).alias("code"))
    met = keyed.where(~F.col("any_kind")).join(nodes, ["kind", "code"]).select("cluster_key", "any_kind", "nodes")
    met = met.union(keyed.where("any_kind").drop("kind").join(nodes, "code").select("cluster_key", "any_kind", "nodes"))
    return met.groupBy("cluster_key", "any_kind").agg(F.sum("nodes").alias("nodes"))


_REGIONS = f"{FRAGMENTS}, located AS (SELECT emb_id, lower(trim(pros_info.project)) AS p, pros_info.file AS f, pros_info.function_extent AS fe, pros_info.node.start_byte AS s, pros_info.node.end_byte AS e FROM fragments WHERE pros_info.node.start_byte < pros_info.node.end_byte)"


@query(f"WITH {_REGIONS} SELECT DISTINCT i.emb_id FROM located i JOIN located o ON i.p = o.p AND i.f = o.f AND i.fe = o.fe AND o.s <= i.s AND i.e <= o.e AND (o.s < i.s OR i.e < o.e)")
def nested_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments that lie inside a larger one of their function.

    One ordered pass a function: a range is inside another if one that begins no
    later ends no earlier; equal ranges are not inside each other.
    """
    i = "pros_info"
    rows = fragments_of(spark, folder, i).where(f"{i}.node.start_byte < {i}.node.end_byte").select("emb_id", F.lower(F.trim(f"{i}.project")).alias("p"), F.col(f"{i}.file").alias("f"), F.col(f"{i}.function_extent").alias("fe"), F.col(f"{i}.node.start_byte").alias("s"), F.col(f"{i}.node.end_byte").alias("e"))
    rows = rows.where("p is not null and f is not null and fe is not null")
    by = Window.partitionBy("p", "f", "fe")
    earlier = F.max("e").over(by.orderBy("s").rangeBetween(Window.unboundedPreceding, -1))
    longest = F.max("e").over(Window.partitionBy("p", "f", "fe", "s"))
    return rows.withColumn("earlier", earlier).withColumn("longest", longest).where((F.coalesce("earlier", F.lit(-1)) >= F.col("e")) | (F.col("longest") > F.col("e"))).select("emb_id")


@query(
    f"""WITH {_BUDGETED}, typed AS (SELECT {_TYPE} AS type, tokens, tokens <= {BUDGET} AS fits FROM sized WHERE NOT blank)
    SELECT coalesce(type, 'total') AS type, count(*) AS raw, max(tokens) AS longest, round(quantile_cont(tokens, 0.5), 6) AS median, count(*) FILTER (fits) AS ready, max(tokens) FILTER (fits) AS longest_ready FROM typed GROUP BY GROUPING SETS ((type), ())"""
)
def budget_report(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of fragments by type and in total, all of them and those within the budget."""
    rows = budgeted(spark, folder).where(~F.col("blank")).select(candidate_type(F.col("kind")).alias("type"), "tokens")
    fits = F.col("tokens") <= BUDGET
    rolled = rows.rollup("type").agg(F.count(F.lit(1)).alias("raw"), F.max("tokens").alias("longest"), F.round(F.expr("percentile(tokens, 0.5)"), 6).alias("median"), F.count_if(fits).alias("ready"), F.max(F.when(fits, F.col("tokens"))).alias("longest_ready"))
    return rolled.withColumn("type", F.coalesce("type", F.lit("total")))


@query(
    f"""WITH {FRAGMENTS}, {FILES}, known AS (SELECT DISTINCT {_POSIX('cppFile')} AS p FROM files), ranges AS (SELECT emb_id, pros_info.node.kind AS kind, concat_ws('|', lower(trim(pros_info.project)), pros_info.file, pros_info.node.start_byte, pros_info.node.end_byte) AS r, {_POSIX('pros_info.file')} AS p, pros_info.node.extent AS x FROM fragments WHERE pros_info.node IS NOT NULL)
    SELECT kind, count(*) AS fragments, count(*) - count(DISTINCT r) AS repeated_ranges, round(count(known.p) / count(*), 6) AS mapped, round(count(*) FILTER (regexp_full_match(coalesce(x, ''), '\\d+-\\d+-\\d+-\\d+')) / count(*), 6) AS complete FROM ranges LEFT JOIN known ON ranges.p = known.p GROUP BY 1"""
)
def candidate_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments of a kind whose range another one has, whose file is known, and whose extent can be read."""
    i = "pros_info"
    known = first_rows(spark, folder, p=path("cppFile")).select("p").where("p is not null").distinct().withColumn("known", F.lit(1))
    key = F.concat_ws("|", F.lower(F.trim(f"{i}.project")), f"{i}.file", F.col(f"{i}.node.start_byte").cast("string"), F.col(f"{i}.node.end_byte").cast("string"))
    rows = fragments_of(spark, folder, i).where(f"{i}.node is not null").select(F.col(f"{i}.node.kind").alias("kind"), key.alias("r"), path(f"{i}.file").alias("p"), text.extent(F.col(f"{i}.node.extent")).alias("x"))
    n = F.count(F.lit(1))
    return rows.join(known, "p", "left").groupBy("kind").agg(n.alias("fragments"), (n - F.count_distinct("r")).alias("repeated_ranges"), F.round(F.count("known") / n, 6).alias("mapped"), F.round(F.count("x") / n, 6).alias("complete"))


@query(
    f"""WITH {_RANGES}, spans AS (SELECT file_id, r.start_byte AS s, r.end_byte AS e FROM errors UNION ALL SELECT file_id, r.start_byte, r.end_byte FROM missing), {_UNION.format(by="file_id")},
    gaps AS (SELECT file_id, coalesce(lag(e) OVER w, 0) AS s, s AS e FROM joined WINDOW w AS (PARTITION BY file_id ORDER BY s) UNION ALL SELECT file_id, max(e), any_value(byte_count) FROM joined JOIN latest USING (file_id) GROUP BY 1)
    SELECT file_id, count(*) AS stretches, CAST(sum(e - s) AS BIGINT) AS bytes FROM gaps WHERE s < e GROUP BY 1"""
)
def uncovered_runs(spark: SparkSession, folder: str) -> DataFrame:
    """What no error or missing range covers of the files that have some: stretches and bytes."""
    rows = latest_evidence(spark, folder, "error_ranges", "missing_ranges", "byte_count")
    ranges = rows.select("file_id", F.explode(F.concat(F.coalesce("error_ranges", F.array().cast(rows.schema["error_ranges"].dataType)), F.coalesce("missing_ranges", F.array().cast(rows.schema["error_ranges"].dataType)))).alias("r"))
    spans = ranges.select("file_id", F.col("r.start_byte").alias("start"), F.col("r.end_byte").alias("end")).where("start < end")
    joined = intervals.merged(spans, ["file_id"])
    before = F.coalesce(F.lag("end").over(Window.partitionBy("file_id").orderBy("start")), F.lit(0))
    gaps = joined.select("file_id", before.alias("s"), F.col("start").alias("e"))
    tails = joined.groupBy("file_id").agg(F.max("end").alias("s")).join(rows.select("file_id", F.col("byte_count").alias("e")), "file_id")
    return gaps.union(tails.select("file_id", "s", "e")).where("s < e").groupBy("file_id").agg(F.count(F.lit(1)).alias("stretches"), F.sum(F.col("e") - F.col("s")).alias("bytes"))


_BUCKET = "CASE WHEN n IS NULL THEN 'none' WHEN n < 50 THEN '1-49' WHEN n < 200 THEN '50-199' WHEN n < 1000 THEN '200-999' ELSE '1000+' END"


@query(
    f"""WITH sized AS (SELECT corpus, parse.analysis.source.selected_file_count AS n, parse.analysis.source.effective_line_count AS lines FROM project_classification)
    SELECT corpus, {_BUCKET} AS bucket, count(*) AS projects, min(lines) AS least, round(quantile_cont(lines, 0.5), 6) AS median, max(lines) AS most, CAST(sum(lines) AS BIGINT) AS lines FROM sized GROUP BY 1, 2"""
)
def corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Projects by their number of files, with the spread of their lines."""
    s = "parse.analysis.source"
    rows = table(spark, folder, "project_classification").select("corpus", F.col(f"{s}.selected_file_count").alias("n"), F.col(f"{s}.effective_line_count").alias("lines"))
    return rows.groupBy("corpus", F.expr(_BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("projects"), F.min("lines").alias("least"), F.round(F.expr("percentile(lines, 0.5)"), 6).alias("median"), F.max("lines").alias("most"), F.sum("lines").alias("lines"))


@query(
    """WITH rows_ AS (SELECT doc_id, source, coalesce(project, 'none') AS project, created_at, row_number() OVER (PARTITION BY source, coalesce(project, 'none') ORDER BY created_at, doc_id) = 1 AS opening FROM documents WHERE source IS NOT NULL AND created_at IS NOT NULL)
    SELECT source, project, doc_id, opening FROM (SELECT *, row_number() OVER (PARTITION BY source, project, opening ORDER BY created_at DESC, doc_id DESC) AS n FROM rows_) WHERE opening OR n <= 3"""
)
def kept_history(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of each source and project, and the last three others."""
    rows = table(spark, folder, "documents").where("source is not null and created_at is not null").select("doc_id", "source", F.coalesce("project", F.lit("none")).alias("project"), "created_at")
    return windows.opening_and_last(rows, ["source", "project"], ["created_at", "doc_id"], 3).select("source", "project", "doc_id", "opening")


#: Fragments that a sample takes of the short, middle and long ones of a project.
SHARES = (6, 4, 2)


@query(
    f"""WITH {FRAGMENTS}, sized AS (SELECT emb_id, {_NAMED.format('pros_name')} AS project, pros_info.node.kind AS kind, CASE WHEN pros_info.node.subtree_size < 12 THEN 0 WHEN pros_info.node.subtree_size < 40 THEN 1 ELSE 2 END AS bucket FROM fragments WHERE pros_info.node.subtree_size IS NOT NULL AND pros_info.node.kind IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY project, bucket, kind ORDER BY emb_id) AS turn FROM sized), dealt AS (SELECT *, row_number() OVER (PARTITION BY project, bucket ORDER BY turn, kind) AS n FROM ranked)
    SELECT project, bucket, emb_id, CAST(n AS INT) AS n FROM dealt WHERE n <= CASE bucket WHEN 0 THEN {SHARES[0]} WHEN 1 THEN {SHARES[1]} ELSE {SHARES[2]} END"""
)
def budgeted_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of each project with a budget for each size, in which kinds take turns."""
    size = F.col("pros_info.node.subtree_size")
    rows = fragments_of(spark, folder, "pros_name", "pros_info").where(size.isNotNull() & F.col("pros_info.node.kind").isNotNull())
    rows = rows.select("emb_id", spelled("pros_name").alias("project"), F.col("pros_info.node.kind").alias("kind"), F.when(size < 12, 0).when(size < 40, 1).otherwise(2).alias("bucket"))
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy("project", "bucket", "kind").orderBy("emb_id"))).where(F.col("turn") <= max(SHARES))
    dealt = turns.withColumn("n", F.row_number().over(Window.partitionBy("project", "bucket").orderBy("turn", "kind")))
    share = F.when(F.col("bucket") == 0, SHARES[0]).when(F.col("bucket") == 1, SHARES[1]).otherwise(SHARES[2])
    return dealt.where(F.col("n") <= share).select("project", "bucket", "emb_id", "n")


@query(
    f"""WITH {FRAGMENTS} SELECT emb_id, len(pros_emb) AS components, round(sqrt(list_sum(list_transform(pros_emb, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm, round(CAST(pros_emb[1] AS DOUBLE), 4) AS head FROM fragments
    WHERE len(pros_emb) > 0 AND len(list_filter(pros_emb, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
)
def vector_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Components, norm and first component of each finite vector; only these are shuffled."""
    finite = F.forall("pros_emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("pros_emb", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = table(spark, folder, "embedding").where(F.col("emb_id").isNotNull()).select("emb_id", "ingested_at", F.size("pros_emb").cast("long").alias("components"), (finite & (F.size("pros_emb") > 0)).alias("finite"), F.round(norm, 4).alias("norm"), F.round(F.get("pros_emb", F.lit(0)).cast("double"), 4).alias("head"))
    return scan.first_deliveries(rows, "emb_id", "ingested_at").where("finite").select("emb_id", "components", "norm", "head")


@query(
    f"""WITH {FILES}, {LATEST}, used AS (SELECT lower(trim(project)) AS slug, count(*) AS files FROM files GROUP BY 1), parsed AS (SELECT lower(trim(project)) AS slug, count(*) AS records, count(*) FILTER (status = 'clean') AS clean FROM latest GROUP BY 1)
    SELECT slug, corpus, parse.analysis.source.selected_file_count AS selected, coalesce(files, 0) AS files, coalesce(records, 0) AS records, coalesce(clean, 0) AS clean FROM project_classification p LEFT JOIN used u ON u.slug = lower(trim(p.slug)) LEFT JOIN parsed x ON x.slug = lower(trim(p.slug))""".replace("SELECT slug, corpus, parse", "SELECT p.slug AS slug, corpus, parse")
)
def frozen_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue's projects with their files and the parser's records."""
    used = first_rows(spark, folder, key=F.lower(F.trim("project"))).groupBy("key").agg(F.count(F.lit(1)).alias("files"))
    parsed = latest_evidence(spark, folder, "project", "status").groupBy(F.lower(F.trim("project")).alias("key")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "clean").alias("clean"))
    frozen = table(spark, folder, "project_classification").select("slug", "corpus", F.lower(F.trim("slug")).alias("key"), F.col("parse.analysis.source.selected_file_count").alias("selected"))
    joined = frozen.join(used, "key", "left").join(parsed, "key", "left")
    return joined.select("slug", "corpus", "selected", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("files", "records", "clean")])


_CALLED = lambda x: f"list_filter(regexp_extract_all({x}, '\\b([A-Za-z_][A-Za-z0-9_:]*)\\s*\\(', 1), lambda t: t NOT IN ({', '.join(repr(n) for n in text.NO_CALLS)}))"


@query(
    f"""WITH {_CLUSTERS}, targets AS (SELECT cluster_key, {_CALLED('center_point')} AS allowed, flatten(list_transform(list_filter(coalesce(else_point, []), lambda x: x IS NOT NULL), lambda x: {_CALLED('x')})) AS called FROM own WHERE center_point IS NOT NULL)
    SELECT cluster_key, len(list_distinct(allowed)) AS allowed, len(list_distinct(list_filter(called, lambda t: NOT list_contains(allowed, t)))) AS new_targets FROM targets"""
)
def new_call_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of a cluster's codes that its centre doesn't make."""
    rows = clusters_of(spark, folder).where("center_point is not null").select("cluster_key", text.call_targets(F.col("center_point")).alias("allowed"), F.filter(F.coalesce("else_point", F.array().cast("array<string>")), lambda c: c.isNotNull()).alias("codes"))
    called = F.array_distinct(F.flatten(F.transform("codes", text.call_targets)))
    return rows.select("cluster_key", F.size(F.array_distinct("allowed")).cast("long").alias("allowed"), F.size(F.array_except(called, F.col("allowed"))).cast("long").alias("new_targets"))


@query(
    f"""WITH {FRAGMENTS} SELECT emb_id, left(pros_name, 60) AS pros_name, length(pros_name) > 60 AS pros_name_cut, left(pros_src, 60) AS pros_src, coalesce(length(pros_src) > 60, false) AS pros_src_cut FROM fragments ORDER BY emb_id LIMIT 50""".replace("length(pros_name) > 60 AS", "coalesce(length(pros_name) > 60, false) AS")
)
def fragment_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty fragments with their texts cut for reading."""
    return sinks.preview(fragments_of(spark, folder, "pros_name", "pros_src").drop("ingested_at"), ["emb_id"], 50, 60)


@query(
    f"""WITH {FILES} SELECT coalesce(lower(trim(split)), 'none') AS split, count(*) AS files FROM files WHERE file_id IN (SELECT file_id FROM source_evidence) GROUP BY 1"""
)
def manifest_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a manifest, those with a record, by split; a listed file that isn't there is an error."""
    recorded = table(spark, folder, "source_evidence").select("file_id").where("file_id is not null").distinct()
    listing = first_rows(spark, folder, split=F.coalesce(F.lower(F.trim("split")), F.lit("none"))).select("file_id", "split")
    manifest = recorded.join(listing.select("file_id"), "file_id", "left_semi")
    return scan.manifest_scan(manifest, listing, ["file_id"]).groupBy("split").agg(F.count(F.lit(1)).alias("files"))


@query(
    f"""WITH {FILES}, functions AS (SELECT file_id, unnest(func_src) AS code FROM files), lines AS (SELECT file_id, unnest(string_split(code, chr(10))) AS l FROM functions WHERE code IS NOT NULL)
    SELECT file_id, count(*) FILTER (regexp_matches(l, '^\\s*#')) AS directives, CAST(sum(strlen(l)) AS BIGINT) AS bytes FROM lines GROUP BY 1 HAVING count(*) FILTER (regexp_matches(l, '^\\s*#')) > 0"""
)
def directive_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Files with preprocessor lines, and the bytes of all their lines."""
    lines = F.flatten(F.transform(F.filter("func_src", lambda c: c.isNotNull()), lambda c: F.split(c, "\n")))
    directives = F.size(F.filter("lines", lambda x: x.rlike(r"^\s*#"))).cast("long")
    sizes = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    rows = table(spark, folder, "dataset").select("file_id", "ingested_at", lines.alias("lines")).select("file_id", "ingested_at", directives.alias("directives"), sizes.alias("bytes"))
    return scan.first_deliveries(rows, "file_id", "ingested_at").where("directives > 0").select("file_id", "directives", "bytes")


@query(
    """SELECT event_type, CASE WHEN NOT json_valid(props) THEN 'no json' WHEN json_type(props) <> 'OBJECT' THEN 'no object' WHEN json_type(props, '$.k') IS NULL THEN 'k missing' WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'k no integer'
    WHEN len(json_keys(props)) > 1 THEN 'more fields' ELSE 'valid' END AS verdict, count(*) AS events FROM events WHERE props IS NOT NULL GROUP BY 1, 2"""
)
def schema_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads against a schema: an object with one required integer and nothing else."""
    rows = table(spark, folder, "events").where("props is not null").select("event_type", "props", F.expr("try_parse_json(props)").alias("v"))
    kind = F.expr("schema_of_variant(v)")
    field = F.expr("schema_of_variant(try_variant_get(v, '$.k', 'variant'))")
    verdict = (
        F.when(F.col("v").isNull(), "no json").when(~kind.startswith("OBJECT"), "no object").when(F.expr("try_variant_get(v, '$.k', 'variant')").isNull(), "k missing").when(field != "BIGINT", "k no integer")
        .when(F.size(F.json_object_keys("props")) > 1, "more fields").otherwise("valid")
    )
    return rows.groupBy("event_type", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("events"))




@query(
    f"""WITH {FILES}, named AS (SELECT trim(project) AS project, count(*) AS files FROM files WHERE project IS NOT NULL GROUP BY 1), slugs AS (SELECT DISTINCT slug FROM project_classification), lowered AS (SELECT DISTINCT lower(trim(slug)) AS low FROM project_classification)
    SELECT CASE WHEN slug IS NOT NULL THEN 'exact' WHEN low IS NOT NULL THEN 'any case' ELSE 'none' END AS matched, count(*) AS spellings, CAST(sum(files) AS BIGINT) AS files FROM named LEFT JOIN slugs ON slug = project LEFT JOIN lowered ON low = lower(project) GROUP BY 1"""
)
def metadata_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of projects that the catalogue holds exactly, or but for case."""
    named = first_rows(spark, folder, project=F.trim("project")).where("project is not null").groupBy("project").agg(F.count(F.lit(1)).alias("files")).withColumn("low", F.lower("project"))
    slugs = table(spark, folder, "project_classification").select("slug")
    exact = slugs.select(F.col("slug").alias("project")).distinct().withColumn("exact", F.lit(True))
    lowered = slugs.select(F.lower(F.trim("slug")).alias("low")).distinct().withColumn("any", F.lit(True))
    joined = named.join(exact, "project", "left").join(lowered, "low", "left")
    return joined.groupBy(F.when(F.col("exact"), "exact").when(F.col("any"), "any case").otherwise("none").alias("matched")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("files").alias("files"))


@query("SELECT slug, corpus, coalesce(classification.primary_domain, 'unknown') AS domain FROM project_classification WHERE lower(trim(coalesce(selection.status, ''))) IN ('selected', 'accepted', 'frozen')")
def selected_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects of the catalogue whose selection was accepted."""
    status = F.lower(F.trim(F.coalesce("selection.status", F.lit(""))))
    return table(spark, folder, "project_classification").where(status.isin("selected", "accepted", "frozen")).select("slug", "corpus", F.coalesce("classification.primary_domain", F.lit("unknown")).alias("domain"))


@query(
    f"""WITH {_CLUSTERS}, kept AS (SELECT cluster_key, coalesce(infos, []) AS infos, list_filter(coalesce(infos, []), lambda i: trim(coalesce(i.node.code_snippet, '')) <> '' AND (i.node.code_snippet = center_point OR list_contains(coalesce(else_point, []), i.node.code_snippet))) AS k FROM own WHERE trim(coalesce(center_point, '')) <> '')
    SELECT cluster_key, len(infos) AS members, len(k) AS kept FROM kept"""
)
def kept_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members with code that is one of the cluster's recorded texts, of clusters with a centre."""
    rows = clusters_of(spark, folder).where("trim(coalesce(center_point, '')) != ''")
    none = F.array().cast("array<string>")
    infos = F.coalesce("infos", F.array().cast(rows.schema["infos"].dataType))
    known = F.concat(F.array("center_point"), F.coalesce("else_point", none))
    kept = F.filter(infos, lambda i: (F.trim(F.coalesce(i["node"]["code_snippet"], F.lit(""))) != "") & F.coalesce(F.array_contains(known, i["node"]["code_snippet"]), F.lit(False)))
    return rows.select("cluster_key", F.size(infos).cast("long").alias("members"), F.size(kept).cast("long").alias("kept"))


@query(
    """WITH found AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', 1))) AS target FROM documents WHERE text IS NOT NULL)
    SELECT target, count(*) AS docs, count(DISTINCT source) AS sources FROM found GROUP BY 1"""
)
def include_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Headers that texts include, with the texts and sources that do."""
    targets = F.array_distinct(F.regexp_extract_all("text", F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'), 1))
    found = table(spark, folder, "documents").where("text is not null").select("source", F.explode(targets).alias("target"))
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("sources"))


_LEXED = _TOKENS("pros_src")
_PAIRED = " AND ".join(f"len(list_filter(t, lambda x: x = '{a}')) = len(list_filter(t, lambda x: x = '{b}'))" for a, b in ("()", "[]", "{}"))


@query(
    f"""WITH {FRAGMENTS}, lexed AS (SELECT pros_info.node.kind AS kind, pros_info.node.subtree_size AS size, {_LEXED} AS t FROM fragments WHERE pros_src IS NOT NULL)
    SELECT kind, count(*) AS fragments, count(*) FILTER (len(t) > 0 AND {_PAIRED}) AS paired, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(size) AS BIGINT) AS nodes FROM lexed GROUP BY 1"""
)
def fragment_syntax(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments whose brackets pair, literals and comments aside, with their tokens and nodes."""
    n = lambda t, mark: F.size(F.filter(t, lambda x: x == mark))
    measured = lambda t: F.struct(F.size(t).alias("tokens"), ((F.size(t) > 0) & (n(t, "(") == n(t, ")")) & (n(t, "[") == n(t, "]")) & (n(t, "{") == n(t, "}"))).alias("paired"))
    sizes = F.get(F.transform(F.array(text.code_tokens(F.col("pros_src"))), measured), F.lit(0))
    rows = table(spark, folder, "embedding").where("pros_src is not null").select("emb_id", "ingested_at", F.col("pros_info.node.kind").alias("kind"), F.col("pros_info.node.subtree_size").alias("size"), sizes.alias("m"))
    rows = scan.first_deliveries(rows, "emb_id", "ingested_at")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("fragments"), F.count_if("m.paired").alias("paired"), F.sum("m.tokens").alias("tokens"), F.sum("size").alias("nodes"))
