"""Queries on fragments, clusters and the measures of a pattern library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quarryline.functions import scores, text
from quarryline.operators import clusters
from quarryline.plans.lineage import cut, table
from quarryline.queries.files import first_rows, fragments_of, latest_evidence
from quarryline.queries.registry import FILES, FRAGMENTS, LATEST, Registry
from quarryline.sources import scan

_R = Registry()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

TRAIN, TEST = ("train", "training"), ("test",)
#: Fixed value: what makes a fragment more than a bare name.
MEANINGFUL = r"(?:\w+\s*\(|=|\b(?:if|for|while|switch|try|catch|throw|co_await)\b)"

_LINES = f"""{FILES}, functions AS (SELECT file_id, corpus, lower(trim(split)) AS split, unnest(func_src) AS code FROM files),
raw AS (SELECT file_id, corpus, split, unnest(string_split(code, chr(10))) AS line FROM functions WHERE code IS NOT NULL),
lines AS (SELECT file_id, corpus, split, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM raw),
patterns AS (SELECT corpus, line FROM lines WHERE split IN ('train', 'training') AND length(line) >= 20 GROUP BY corpus, line HAVING count(DISTINCT file_id) >= 2),
tested AS (SELECT l.file_id, l.corpus, l.line, length(l.line) AS n, p.line IS NOT NULL AS hit FROM lines l LEFT JOIN patterns p ON l.corpus = p.corpus AND l.line = p.line WHERE l.split = 'test'),
per_file AS (SELECT corpus, file_id, sum(n) AS total, sum(CASE WHEN hit THEN n ELSE 0 END) AS covered FROM tested GROUP BY corpus, file_id HAVING sum(n) > 0),
grains AS (SELECT corpus, sum(covered) AS covered, sum(total) AS total, avg(covered / total) AS ic_macro FROM per_file GROUP BY GROUPING SETS ((corpus), ())),
recur AS (SELECT corpus, count(*) AS recurring FROM (SELECT DISTINCT corpus, line FROM tested WHERE hit) GROUP BY GROUPING SETS ((corpus), ())),
totals AS (SELECT corpus, count(*) AS patterns FROM patterns GROUP BY GROUPING SETS ((corpus), ()))"""


def code_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Folded lines of all functions: ``file_id, corpus, split, line`` (its hash) and ``n``, its length.

    Lines become hashes before repeated deliveries are dropped, so no text is shuffled.
    """
    lines = F.flatten(F.transform(F.filter("func_src", lambda c: c.isNotNull()), lambda c: F.split(c, "\n")))
    hashed = F.transform(lines, lambda x: F.get(F.transform(F.array(text.fold(x)), lambda y: F.struct(F.xxhash64(y).alias("line"), F.length(y).alias("n"))), F.lit(0)))
    rows = first_rows(spark, folder, "corpus", split=F.lower(F.trim("split")), lines=hashed)
    return rows.select("file_id", "corpus", "split", F.explode("lines").alias("l")).select("file_id", "corpus", "split", "l.line", "l.n")


@query(
    f"""WITH {_LINES} SELECT coalesce(g.corpus, 'all') AS corpus, patterns, coalesce(recurring, 0) AS recurring, CAST(covered AS BIGINT) AS covered, CAST(total AS BIGINT) AS total,
    round(ic_macro, 6) AS ic_macro, round(covered / total, 6) AS ic_micro, round(coalesce(recurring, 0) / patterns, 6) AS isp,
    round(CASE WHEN ic_macro > 0 AND recurring > 0 THEN 2 * ic_macro * (recurring / patterns) / (ic_macro + recurring / patterns) ELSE 0 END, 6) AS f1
    FROM grains g JOIN totals t ON g.corpus IS NOT DISTINCT FROM t.corpus LEFT JOIN recur r ON g.corpus IS NOT DISTINCT FROM r.corpus"""
)
def coverage_ic_isp_f1(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the test files the patterns of the train files cover, and how many of these recur.

    A pattern is a folded line of 20 characters or more in at least two train
    files of a corpus.  Three grains: test file (macro mean), corpus, all.
    """
    # one row for each line of a file, written once: train, test and all measures read it
    lines = cut(code_lines(spark, folder).where(F.col("split").isin(*TRAIN, *TEST)).groupBy("corpus", "split", "file_id", "line").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("times")))
    counted = lines.where(F.col("split").isin(*TRAIN) & (F.col("n") >= 20)).select("corpus", "line", "file_id").distinct().groupBy("corpus", "line").agg(F.count(F.lit(1)).alias("files"))
    patterns = cut(counted.where("files >= 2").select("corpus", "line", F.lit(True).alias("hit")))
    tested = lines.where(F.col("split").isin(*TEST)).select("corpus", "file_id", "line", (F.col("n") * F.col("times")).alias("n"))
    tested = cut(tested.join(patterns, ["corpus", "line"], "left"))
    per_file = tested.groupBy("corpus", "file_id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("covered")).where("total > 0")
    grains = per_file.rollup("corpus").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"), F.avg(F.col("covered") / F.col("total")).alias("macro"))
    recur = tested.where("hit").select("corpus", "line").distinct().rollup("corpus").agg(F.count(F.lit(1)).alias("recurring"))
    totals = patterns.rollup("corpus").agg(F.count(F.lit(1)).alias("patterns"))
    named = lambda df: df.withColumn("corpus", F.coalesce("corpus", F.lit("all")))
    joined = named(grains).join(named(totals), "corpus").join(named(recur), "corpus", "left").withColumn("recurring", F.coalesce("recurring", F.lit(0).cast("long")))
    isp = scores.ratio(F.col("recurring"), F.col("patterns"))
    return joined.select(
        "corpus",
        "patterns",
        "recurring",
        "covered",
        "total",
        F.round("macro", 6).alias("ic_macro"),
        F.round(scores.ratio(F.col("covered"), F.col("total")), 6).alias("ic_micro"),
        F.round(isp, 6).alias("isp"),
        F.round(scores.f1(F.col("macro"), isp), 6).alias("f1"),
    )


_CLUSTERS = "own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY run_at) AS n FROM clusters WHERE cluster_key IS NOT NULL) WHERE n = 1)"
_MEMBERS = f"{_CLUSTERS}, members AS (SELECT cluster_key, label, lower(trim(center_point_info.project)) AS project, unnest(infos) AS info FROM own)"


def clusters_of(spark: SparkSession, folder: str) -> DataFrame:
    """Each recorded cluster once, with ``project`` in one spelling."""
    return scan.first_deliveries(table(spark, folder, "clusters"), "cluster_key", "run_at").withColumn("project", F.lower(F.trim("center_point_info.project")))


def members_of(spark: SparkSession, folder: str) -> DataFrame:
    return clusters_of(spark, folder).select("cluster_key", "label", "project", F.explode("infos").alias("info"))


@query(
    f"""WITH {_MEMBERS}, {FRAGMENTS}, totals AS (SELECT lower(trim(pros_name)) AS project, count(*) AS fragments FROM fragments WHERE pros_name IS NOT NULL GROUP BY 1),
    sizes AS (SELECT project, cluster_key, count(*) AS size, count(DISTINCT info.file) AS files FROM members WHERE project IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT project, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS members, max(size) AS largest, round(avg(size), 6) AS mean_size, round(quantile_cont(size, 0.5), 6) AS median_size, count(*) FILTER (files >= 2) AS cross_file,
    round(sum(size) / max(fragments), 6) AS coverage, round(max(size) / max(fragments), 6) AS largest_share FROM sizes JOIN totals USING (project) GROUP BY project"""
)
def cluster_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Size, spread and coverage of each project's recorded clusters of two or more members."""
    return _metrics(spark, folder)


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    sizes = members_of(spark, folder).where("project is not null").groupBy("project", "cluster_key").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("info.file").alias("files")).where("size >= 2")
    totals = fragments_of(spark, folder, "pros_name").where("pros_name is not null").groupBy(F.lower(F.trim("pros_name")).alias("project")).agg(F.count(F.lit(1)).alias("fragments"))
    grouped = sizes.groupBy("project").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("size").cast("long").alias("members"),
        F.max("size").alias("largest"),
        F.round(F.avg("size"), 6).alias("mean_size"),
        F.round(F.expr("percentile(size, 0.5)"), 6).alias("median_size"),
        F.count_if(F.col("files") >= 2).alias("cross_file"),
    )
    joined = grouped.join(totals, "project")
    return joined.withColumn("coverage", F.round(F.col("members") / F.col("fragments"), 6)).withColumn("largest_share", F.round(F.col("largest") / F.col("fragments"), 6)).drop("fragments")


@query(
    f"""WITH {_MEMBERS}, codes AS (SELECT project, cluster_key, count(DISTINCT trim(regexp_replace(info.node.code_snippet, '\\s+', ' ', 'g'))) AS variants, count(DISTINCT info.file) AS files, max(info.node.subtree_size) AS size, count(*) AS members FROM members GROUP BY 1, 2)
    SELECT project, count(*) AS clusters, count(*) FILTER (variants = 1) AS copies, count(*) FILTER (variants >= 2 AND files >= 2 AND size >= 10) AS strong FROM codes GROUP BY project"""
)
def cluster_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of nothing but copies, and clusters that vary, spread and have size."""
    codes = members_of(spark, folder).groupBy("project", "cluster_key").agg(F.count_distinct(text.fold(F.col("info.node.code_snippet"))).alias("variants"), F.count_distinct("info.file").alias("files"), F.max("info.node.subtree_size").alias("size"))
    strong = (F.col("variants") >= 2) & (F.col("files") >= 2) & (F.col("size") >= 10)
    return codes.groupBy("project").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("variants") == 1).alias("copies"), F.count_if(strong).alias("strong"))


@query(
    f"""WITH {_CLUSTERS}, eligible AS (SELECT *, lower(trim(center_point_info.project)) AS project FROM own WHERE cluster_size >= 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY cluster_size DESC, CAST(label AS VARCHAR) NULLS LAST, cluster_key) AS r, count(*) OVER (PARTITION BY project) AS c FROM eligible)
    SELECT project, cluster_key, cluster_size FROM ranked WHERE r <= least(100, greatest(1, ceil(c * 0.5)))"""
)
def frequency_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The larger half of each project's clusters of three or more, a hundred at most; labels compare as texts."""
    eligible = clusters_of(spark, folder).where("cluster_size >= 3")
    order = Window.partitionBy("project").orderBy(F.desc("cluster_size"), F.asc_nulls_last(F.col("label").cast("string")), "cluster_key")
    ranked = eligible.withColumn("r", F.row_number().over(order)).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("project")))
    return ranked.where(F.col("r") <= F.least(F.lit(100), F.greatest(F.lit(1), F.ceil(F.col("c") * 0.5)))).select("project", "cluster_key", "cluster_size")


_CODES = f"""{_CLUSTERS}, coded AS (SELECT cluster_key, list_concat([center_point], list_filter(coalesce(else_point, []), lambda x: trim(x) <> '')) AS codes, infos FROM own WHERE center_point IS NOT NULL)"""


@query(
    f"""WITH {_CODES}, facts AS (SELECT cluster_key, len(codes) AS members, len(list_distinct(list_transform(codes, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))))) AS variants,
    len(list_distinct(list_transform(infos, lambda i: i.file))) AS files, list_sort(list_transform(infos, lambda i: coalesce(i.node.subtree_size, 0))) AS sizes, len(list_filter(codes, lambda x: regexp_matches(x, '{MEANINGFUL}'))) > 0 AS meaningful FROM coded)
    SELECT cluster_key, members, variants, files, round(least(100, least(25, 10 * log2(greatest(1, members))) + least(20, 8 * log2(greatest(1, variants))) + CASE WHEN files >= 2 THEN 20 ELSE 5 END
    + least(20, coalesce(sizes[len(sizes) // 2 + 1] / 2, 0)) + CASE WHEN meaningful THEN 15 ELSE 0 END), 4) AS score FROM facts"""
)
def rule_score(spark: SparkSession, folder: str) -> DataFrame:
    """Points for support, variety, spread, size and substance of each cluster."""
    codes = F.concat(F.array("center_point"), F.filter(F.coalesce("else_point", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    infos = F.coalesce("infos", F.array().cast(table(spark, folder, "clusters").schema["infos"].dataType))
    facts = clusters_of(spark, folder).where("center_point is not null").select("cluster_key", codes.alias("codes"), infos.alias("infos"))
    facts = facts.select(
        "cluster_key",
        F.size("codes").cast("long").alias("members"),
        F.size(F.array_distinct(F.transform("codes", text.fold))).cast("long").alias("variants"),
        F.size(F.array_compact(F.array_distinct(F.transform("infos", lambda i: i["file"])))).cast("long").alias("files"),
        F.transform("infos", lambda i: F.coalesce(i["node"]["subtree_size"], F.lit(0))).alias("sizes"),
        F.exists("codes", lambda c: c.rlike(MEANINGFUL)).alias("meaningful"),
    )
    score = scores.rule_score(F.col("members"), F.col("variants"), F.col("files"), F.col("sizes"), F.col("meaningful"))
    return facts.select("cluster_key", "members", "variants", "files", F.round(score, 4).alias("score"))


@query(
    f"""WITH {_CODES}, checked AS (SELECT own.cluster_key, own.cluster_size, codes, coded.infos, lower(trim(own.center_point_info.project)) AS project FROM own JOIN coded USING (cluster_key))
    SELECT cluster_key, cluster_size < 2 OR len(codes) < 2 AS few, trim(codes[1]) = '' AS blank, cluster_size <> len(infos) AS wrong_size, len(list_filter(infos, lambda i: lower(trim(i.project)) <> project)) > 0 AS foreign_members FROM checked"""
)
def cluster_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts that a recorded cluster may break."""
    others = F.filter(F.coalesce("else_point", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    rows = clusters_of(spark, folder).where("center_point is not null").withColumn("n", F.size(others) + 1)
    return rows.select(
        "cluster_key",
        ((F.col("cluster_size") < 2) | (F.col("n") < 2)).alias("few"),
        (F.trim("center_point") == "").alias("blank"),
        (F.col("cluster_size") != F.size("infos")).alias("wrong_size"),
        (F.size(F.filter("infos", lambda i: F.lower(F.trim(i["project"])) != F.col("project"))) > 0).alias("foreign_members"),
    )


@query(
    f"""WITH {_CLUSTERS} SELECT project, cluster_key, cluster_size FROM (SELECT *, lower(trim(center_point_info.project)) AS project, row_number() OVER (PARTITION BY lower(trim(center_point_info.project)) ORDER BY cluster_size DESC NULLS LAST, label NULLS LAST, cluster_key) AS r FROM own) WHERE r = 1 AND project IS NOT NULL"""
)
def argmax_ties(spark: SparkSession, folder: str) -> DataFrame:
    """The largest cluster of each project; ties go to the smaller label, then the smaller key."""
    big, rank = F.coalesce(F.col("cluster_size"), F.lit(-1)), F.coalesce(-F.col("label"), F.lit(-(1 << 31)))
    best = clusters_of(spark, folder).where("project is not null").groupBy("project").agg(F.max(F.struct(big.alias("s"), rank.alias("l"), (-F.col("cluster_key")).alias("k"), "cluster_size")).alias("b"))
    return best.select("project", (-F.col("b.k")).alias("cluster_key"), "b.cluster_size")


@query(
    f"""WITH {_MEMBERS}, each_ AS (SELECT project, cluster_key, count(*) AS size, count(DISTINCT (info.file, info.function_extent)) AS support, avg(info.node.subtree_size) AS ast FROM members GROUP BY 1, 2)
    SELECT CASE WHEN grouping(project) = 1 THEN 'all' ELSE project END AS project, count(*) AS types, CAST(sum(size) AS BIGINT) AS instances, CAST(sum(support) AS BIGINT) AS support, round(avg(size), 6) AS mean_size, round(avg(support), 6) AS mean_support, round(avg(ast), 6) AS mean_ast FROM (SELECT * REPLACE (coalesce(project, 'unknown') AS project) FROM each_) GROUP BY GROUPING SETS ((project), ())"""
)
def library_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Types, instances, functions that support them, and mean tree size by type, per project and over all."""
    each = members_of(spark, folder).withColumn("project", F.coalesce("project", F.lit("unknown"))).groupBy("project", "cluster_key").agg(F.count(F.lit(1)).alias("size"), F.count_distinct(F.struct("info.file", "info.function_extent")).alias("support"), F.avg("info.node.subtree_size").alias("ast"))
    rolled = each.rollup("project").agg(
        F.count(F.lit(1)).alias("types"),
        F.sum("size").alias("instances"),
        F.sum("support").alias("support"),
        F.round(F.avg("size"), 6).alias("mean_size"),
        F.round(F.avg("support"), 6).alias("mean_support"),
        F.round(F.avg("ast"), 6).alias("mean_ast"),
    )
    return rolled.withColumn("project", F.coalesce("project", F.lit("all")))


@query(
    f"""WITH {_MEMBERS}, {FRAGMENTS}, known AS (SELECT DISTINCT lower(trim(pros_info.project)) AS p, pros_info.file AS f, pros_info.function_extent AS fe, pros_info.node.extent AS e, pros_info.node.start_byte AS s FROM fragments)
    SELECT project, count(*) AS members, count(*) FILTER (k.s IS NOT NULL) AS found FROM members LEFT JOIN known k ON lower(trim(info.project)) = k.p AND info.file = k.f AND info.function_extent = k.fe AND info.node.extent = k.e AND info.node.start_byte = k.s GROUP BY project"""
)
def member_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Members of recorded clusters that are fragments of the corpus, by project."""
    parts = lambda i: [F.lower(F.trim(f"{i}.project")).alias("p"), F.col(f"{i}.file").alias("f"), F.col(f"{i}.function_extent").alias("fe"), F.col(f"{i}.node.extent").alias("e"), F.col(f"{i}.node.start_byte").alias("s")]
    known = fragments_of(spark, folder, "pros_info").select(*parts("pros_info")).distinct().withColumn("hit", F.lit(1))
    members = members_of(spark, folder).select("project", *parts("info"))
    return members.join(known, ["p", "f", "fe", "e", "s"], "left").groupBy("project").agg(F.count(F.lit(1)).alias("members"), F.count("hit").alias("found"))


@query(
    f"""WITH {FRAGMENTS}, sizes AS (SELECT pros_info.node.kind AS kind, pros_info.node.subtree_size AS n FROM fragments WHERE pros_info.node.subtree_size IS NOT NULL)
    SELECT kind, count(*) AS fragments, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.95), 6) AS p95 FROM sizes GROUP BY kind"""
)
def size_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = fragments_of(spark, folder, "pros_info").select(F.col("pros_info.node.kind").alias("kind"), F.col("pros_info.node.subtree_size").alias("n")).where("n is not null")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("fragments"), F.round(F.avg("n"), 6).alias("mean"), *scores.percentiles("n"))


@query(
    f"""WITH {FRAGMENTS}, regions AS (SELECT lower(trim(pros_info.project)) AS project, pros_info.file AS file, pros_info.function_extent AS extent, count(*) AS fragments, count(DISTINCT pros_info.node.kind) AS kinds FROM fragments WHERE pros_info.file IS NOT NULL GROUP BY 1, 2, 3)
    SELECT project, count(*) AS regions, count(*) FILTER (fragments >= 2) AS shared, count(*) FILTER (kinds >= 2) AS mixed, max(fragments) AS largest FROM regions GROUP BY project"""
)
def region_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Functions in which several fragments occur together."""
    rows = fragments_of(spark, folder, "pros_info").where("pros_info.file is not null")
    regions = rows.groupBy(F.lower(F.trim("pros_info.project")).alias("project"), "pros_info.file", "pros_info.function_extent").agg(F.count(F.lit(1)).alias("fragments"), F.count_distinct("pros_info.node.kind").alias("kinds"))
    return regions.groupBy("project").agg(F.count(F.lit(1)).alias("regions"), F.count_if(F.col("fragments") >= 2).alias("shared"), F.count_if(F.col("kinds") >= 2).alias("mixed"), F.max("fragments").alias("largest"))


@query(
    f"""WITH {FRAGMENTS} SELECT emb_id, project, kind FROM (SELECT emb_id, lower(trim(pros_name)) AS project, pros_info.node.kind AS kind, row_number() OVER (PARTITION BY lower(trim(pros_name)), pros_info.node.kind ORDER BY md5(CAST(emb_id AS VARCHAR)), emb_id) AS r FROM fragments) WHERE r <= 2"""
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Two fragments of each project and kind, chosen by the hash of their id."""
    rows = fragments_of(spark, folder, "pros_name", "pros_info").select("emb_id", F.lower(F.trim("pros_name")).alias("project"), F.col("pros_info.node.kind").alias("kind"))
    order = Window.partitionBy("project", "kind").orderBy(F.md5(F.col("emb_id").cast("string").cast("binary")), "emb_id")
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 2").select("emb_id", "project", "kind")


@query(
    f"""WITH {FRAGMENTS}, checked AS (SELECT lower(trim(pros_name)) AS project, pros_emb AS v, CASE WHEN pros_emb IS NULL THEN 'null' WHEN len(pros_emb) <> 64 THEN 'length' WHEN len(list_filter(pros_emb, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite'
    WHEN len(list_filter(pros_emb, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'usable' END AS state FROM fragments)
    SELECT project, state, count(*) AS fragments, round(max(CASE WHEN state = 'usable' THEN sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) END), 4) AS longest FROM checked GROUP BY project, state"""
)
def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Usable and unusable vectors per project, and the longest of the usable ones."""
    v = F.col("pros_emb")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    state = F.when(v.isNull(), "null").when(F.size(v) != 64, "length").when(~finite, "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("usable")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = fragments_of(spark, folder, "pros_name", "pros_emb").select(F.lower(F.trim("pros_name")).alias("project"), state.alias("state"), F.when(state == "usable", norm).alias("norm"))
    return rows.groupBy("project", "state").agg(F.count(F.lit(1)).alias("fragments"), F.round(F.max("norm"), 4).alias("longest"))


@query(
    f"""WITH {LATEST}, {FILES}, said AS (SELECT file_id, bool_and(parse_valid) AS valid FROM cpp_lexical_analysis WHERE file_id IS NOT NULL AND parse_valid IS NOT NULL GROUP BY 1),
    pairs AS (SELECT corpus, NOT valid AS predicted, status <> 'clean' AS actual FROM files JOIN said USING (file_id) JOIN latest USING (file_id) WHERE status IS NOT NULL),
    counts AS (SELECT corpus, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM pairs GROUP BY GROUPING SETS ((corpus), ()))
    SELECT coalesce(corpus, 'all') AS corpus, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_ FROM counts"""
)
def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical verdicts against the parser's status, per corpus and over all."""
    said = table(spark, folder, "cpp_lexical_analysis").where("file_id is not null and parse_valid is not null").groupBy("file_id").agg(F.bool_and("parse_valid").alias("valid"))
    latest = latest_evidence(spark, folder).where("status is not null").select("file_id", (F.col("status") != "clean").alias("actual"))
    pairs = first_rows(spark, folder, "corpus").join(said, "file_id").join(latest, "file_id").withColumn("predicted", ~F.col("valid"))
    p, a = F.col("predicted"), F.col("actual")
    counts = pairs.rollup("corpus").agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    precision, recall = scores.ratio(F.col("tp"), F.col("tp") + F.col("fp")), scores.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("corpus", F.coalesce("corpus", F.lit("all"))).withColumn("precision_", F.round(precision, 6)).withColumn("recall_", F.round(recall, 6))


@query(
    f"""WITH {FILES}, functions AS (SELECT file_id, unnest(func_src) AS code, generate_subscripts(func_src, 1) - 1 AS func_idx FROM files),
    names AS (SELECT DISTINCT file_id, func_idx, unnest(list_distinct(local_identifiers)) AS name FROM cpp_lexical_analysis WHERE file_id IS NOT NULL),
    used AS (SELECT file_id, func_idx, unnest(list_distinct(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM functions WHERE code IS NOT NULL),
    judged AS (SELECT n.file_id, n.func_idx, count(*) AS names, count(u.name) AS found FROM names n JOIN (SELECT DISTINCT file_id, func_idx FROM functions WHERE code IS NOT NULL) f USING (file_id, func_idx) LEFT JOIN used u ON u.file_id = n.file_id AND u.func_idx = n.func_idx AND u.name = n.name GROUP BY 1, 2)
    SELECT file_id, count(*) AS functions, count(*) FILTER (names = found) AS complete, CAST(sum(names - found) AS BIGINT) AS missing FROM judged GROUP BY file_id"""
)
def subset_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Functions whose recorded local names all occur in their code, per file."""
    functions = first_rows(spark, folder, "func_src").select("file_id", F.posexplode("func_src").alias("func_idx", "code")).where("code is not null")
    used = functions.select("file_id", "func_idx", F.array_distinct(F.regexp_extract_all("code", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)).alias("used"))
    recorded = table(spark, folder, "cpp_lexical_analysis").where("file_id is not null").groupBy("file_id", "func_idx").agg(F.array_distinct(F.flatten(F.collect_set("local_identifiers"))).alias("names"))
    judged = recorded.where("size(names) > 0").join(used, ["file_id", "func_idx"]).select("file_id", F.size(F.array_except("names", "used")).alias("missing"))
    return judged.groupBy("file_id").agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.col("missing") == 0).alias("complete"), F.sum("missing").alias("missing"))


@query(
    f"""WITH {_MEMBERS}, {FRAGMENTS}, known AS (SELECT emb_id, [CAST(x AS DOUBLE) FOR x IN pros_emb] AS v, lower(trim(pros_info.project)) AS p, pros_info.file AS f, pros_info.function_extent AS fe, pros_info.node.extent AS e, pros_info.node.start_byte AS s FROM fragments
      WHERE len(pros_emb) = 64 AND len(list_filter(pros_emb, lambda x: isfinite(x))) = 64 AND len(list_filter(pros_emb, lambda x: x <> 0)) > 0),
    m AS (SELECT DISTINCT cluster_key, emb_id, v FROM members JOIN known ON lower(trim(info.project)) = p AND info.file = f AND info.function_extent = fe AND info.node.extent = e AND info.node.start_byte = s),
    dims AS (SELECT cluster_key, d, avg(x) AS c FROM (SELECT cluster_key, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM m) GROUP BY 1, 2),
    centres AS (SELECT cluster_key, list(c ORDER BY d) AS c FROM dims GROUP BY 1),
    far AS (SELECT cluster_key, emb_id, round(1 - list_inner_product(v, c) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(c, c))), 6) AS far FROM m JOIN centres USING (cluster_key))
    SELECT cluster_key, count(*) AS size, arg_min(emb_id, (far, emb_id)) AS medoid, min(far) AS far FROM far GROUP BY cluster_key"""
)
def cluster_medoids(spark: SparkSession, folder: str) -> DataFrame:
    """The fragment nearest the mean vector of each recorded cluster."""
    parts = lambda i: [F.lower(F.trim(f"{i}.project")).alias("p"), F.col(f"{i}.file").alias("f"), F.col(f"{i}.function_extent").alias("fe"), F.col(f"{i}.node.extent").alias("e"), F.col(f"{i}.node.start_byte").alias("s")]
    v = F.col("pros_emb")
    usable = (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    known = fragments_of(spark, folder, "pros_emb", "pros_info").where(usable).select("emb_id", "pros_emb", *parts("pros_info"))
    members = members_of(spark, folder).select("cluster_key", *parts("info")).distinct().join(known, ["p", "f", "fe", "e", "s"]).select("cluster_key", "emb_id", "pros_emb")
    return clusters.medoids(members, "cluster_key", "emb_id", "pros_emb")


@query(
    f"""WITH {_MEMBERS}, {FRAGMENTS}, totals AS (SELECT lower(trim(pros_name)) AS project, count(*) AS total FROM fragments WHERE pros_name IS NOT NULL GROUP BY 1),
    sizes AS (SELECT m.project, lower(coalesce(o.loc_label, 'none')) AS rank, m.cluster_key, count(*) AS size, count(DISTINCT info.file) AS files FROM members m JOIN own o USING (cluster_key) WHERE m.project IS NOT NULL GROUP BY 1, 2, 3),
    candidates AS (SELECT project, rank, max(total) AS total, sum(size) AS members, max(size) AS largest, count(*) FILTER (files >= 2) AS cross_file FROM sizes JOIN totals USING (project) GROUP BY 1, 2),
    gated AS (SELECT *, CASE WHEN members / total BETWEEN 0.5 AND 0.8 AND largest / total <= greatest(0.15, least(0.5, 5.0 / greatest(total, 1))) THEN 0 WHEN members / total BETWEEN 0.4 AND 0.85 AND largest / total <= greatest(0.2, least(0.5, 5.0 / greatest(total, 1))) THEN 1
      WHEN largest / total <= greatest(0.25, least(0.5, 5.0 / greatest(total, 1))) THEN 2 ELSE 3 END AS gate FROM candidates),
    pool AS (SELECT * FROM (SELECT *, min(gate) OVER (PARTITION BY project) AS best FROM gated) WHERE gate = best),
    scored AS (SELECT *, round(0.6 * coalesce(cross_file / nullif(max(cross_file) OVER (PARTITION BY project), 0), 0) + 0.4 * (0.5 * greatest(0, 1 - abs(members / total - 0.65) / 0.15) + 0.5 * greatest(0, 1 - (largest / total) / 0.15)), 6) AS score FROM pool)
    SELECT project, rank AS level, CAST(gate AS INT) AS gate, score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, rank) AS n FROM scored) WHERE n = 1"""
)
def tuner_gate_select(spark: SparkSession, folder: str) -> DataFrame:
    """Of a project's clusterings by level, the one with the best balance."""
    levels = clusters_of(spark, folder).select("cluster_key", F.lower(F.coalesce("loc_label", F.lit("none"))).alias("rank"))
    sizes = members_of(spark, folder).where("project is not null").groupBy("project", "cluster_key").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("info.file").alias("files")).join(levels, "cluster_key")
    totals = fragments_of(spark, folder, "pros_name").where("pros_name is not null").groupBy(F.lower(F.trim("pros_name")).alias("project")).agg(F.count(F.lit(1)).alias("total"))
    found = sizes.groupBy("project", "rank").agg(F.sum("size").alias("members"), F.max("size").alias("largest"), F.count_if(F.col("files") >= 2).alias("cross_file")).join(totals, "project")
    return clusters.choose(found, ["project"]).select("project", F.col("rank").alias("level"), "gate", "score")
