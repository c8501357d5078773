"""Coverage of syntax trees by the templates of other trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions import scores
from quarryline.functions.patterns import KEYWORDS, with_template
from quarryline.functions.text import code_tokens, is_literal
from quarryline.plans.lineage import cut

BLANK = r"^<(?:VAR|LIT)_\d+>$"


def coarse(tokens: Column) -> Column:
    """Tokens with every name as ``<ID>`` and every literal as ``<LIT>``: equal wherever a template can match."""
    name = lambda t: t.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$") & ~t.isin(KEYWORDS)
    return F.transform(tokens, lambda t: F.when(is_literal(t), "<LIT>").when(name(t), "<ID>").otherwise(t))


def binds(template: Column, tokens: Column) -> Column:
    """Whether tokens of the template's coarse form match it: fixed tokens equal, each blank bound to one token."""
    pairs = F.arrays_zip(template.alias("p"), tokens.alias("t"))
    fixed = F.forall(pairs, lambda x: x["p"].rlike(BLANK) | (x["p"] == x["t"]))
    bound = F.array_distinct(F.filter(pairs, lambda x: x["p"].rlike(BLANK)))
    return fixed & (F.size(bound) == F.size(F.array_distinct(F.transform(bound, lambda x: x["p"]))))


def template_spans(patterns: DataFrame, codes: DataFrame) -> DataFrame:
    """``pattern_id, code_id, start``: every place, counted in tokens, where a pattern stands in a code without gaps.

    Patterns (``pattern_id, code``) may hold blanks; codes have ``code_id, code``.
    The join key is the pattern's rarest fixed token among the codes; a pattern
    without fixed tokens, and null codes, match nothing.
    """
    p = patterns.where("code is not null").select("pattern_id", code_tokens(F.col("code")).alias("p")).where("size(p) > 0")
    c = codes.where("code is not null").select("code_id", code_tokens(F.col("code")).alias("t"))
    places = c.select("code_id", F.posexplode("t").alias("at", "token"))
    fixed = p.select("pattern_id", F.posexplode("p").alias("offset", "token")).where(~F.col("token").rlike(BLANK))
    counts = places.join(fixed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    key = fixed.join(counts, "token").groupBy("pattern_id").agg(F.min(F.struct("n", "offset", "token")).alias("k")).select("pattern_id", "k.offset", "k.token")
    met = key.join(places, "token").select("pattern_id", "code_id", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
    met = met.join(p, "pattern_id").join(c, "code_id").withColumn("w", F.slice("t", F.col("start") + 1, F.size("p"))).where(F.size("w") == F.size("p"))
    kinds = F.forall(F.arrays_zip(F.col("p"), coarse(F.col("w")).alias("k")), lambda x: ~x["p"].rlike(BLANK) | (x["p"].startswith("<VAR") & (x["k"] == "<ID>")) | (x["p"].startswith("<LIT") & (x["k"] == "<LIT>")))
    return met.where(kinds & binds(F.col("p"), F.col("w"))).select("pattern_id", "code_id", "start")


def recurring(nodes: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Templates of nodes in at least ``least`` functions: ``by, kind, template, shape``.

    ``nodes`` has ``file_id, func_idx, kind, code_snippet``.  Templates are counted
    as hashes; their arrays are taken from one node each.
    """
    coded = with_template(nodes.where("trim(code_snippet) != ''").select(*by, "file_id", "func_idx", "kind", "code_snippet"), "code_snippet").where("size(template) > 0")
    keyed = coded.select(*by, "kind", F.sha2(F.array_join("template", "\x01"), 256).alias("key"), F.struct("file_id", "func_idx").alias("f"), "template", coarse(F.col("tokens")).alias("shape"))
    found = keyed.groupBy(*by, "kind", "key").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.count_distinct("f").alias("functions"), F.first("template").alias("template"), F.first("shape").alias("shape"))
    return found.where(F.col("functions") >= least).select(*by, "kind", "key", "template", F.sha2(F.array_join("shape", "\x01"), 256).alias("shape"))


def covered(matches: DataFrame, by: list[str]) -> DataFrame:
    """``by, covered``: nodes of each function inside any of its matched subtrees, each once."""
    ranges = matches.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("node_idx", (F.col("node_idx") + F.col("span")).alias("end")))).alias("r"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(r["end"] - F.greatest(r["node_idx"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], r["end"]).alias("upto"))
    return ranges.select(*by, F.aggregate("r", start, step, lambda s: s["n"]).alias("covered"))


def node_coverage(train: DataFrame, test: DataFrame, least: int = 2) -> DataFrame:
    """How much of test trees the recurring templates of train trees cover, per corpus and over all.

    Both sides have ``corpus, file_id, func_idx, node_idx, span, kind, code_snippet``.
    Gives ``corpus, files, nodes, covered, ic_macro, ic_micro, patterns, matched, isp, f1``.
    A template is one of at least ``least`` train functions; it matches a node of its kind whose tokens are those of the template,
    each blank standing for one name or literal throughout; it covers the subtree.
    """
    patterns = cut(recurring(train, ["corpus"], least))
    coded = with_template(test.where("trim(code_snippet) != ''"), "code_snippet").select("corpus", "file_id", "func_idx", "node_idx", "span", "kind", "tokens", F.sha2(F.array_join(coarse(F.col("tokens")), "\x01"), 256).alias("shape"))
    met = coded.join(patterns, ["corpus", "kind", "shape"]).where(binds(F.col("template"), F.col("tokens")))
    met = cut(met.select("corpus", "file_id", "func_idx", "node_idx", "span", "kind", "key"))
    sizes = test.groupBy("corpus", "file_id").agg(F.count(F.lit(1)).alias("nodes"))
    hits = covered(met, ["corpus", "file_id", "func_idx"]).groupBy("corpus", "file_id").agg(F.sum("covered").alias("covered"))
    files = sizes.join(hits, ["corpus", "file_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    named = lambda df: df.withColumn("corpus", F.coalesce("corpus", F.lit("all")))
    grains = named(files.rollup("corpus").agg(F.count(F.lit(1)).alias("files"), F.sum("nodes").alias("nodes"), F.sum("covered").alias("covered"), F.avg(F.col("covered") / F.col("nodes")).alias("macro")))
    totals = named(patterns.rollup("corpus").agg(F.count(F.lit(1)).alias("patterns")))
    matched = named(met.select("corpus", "kind", "key").distinct().rollup("corpus").agg(F.count(F.lit(1)).alias("matched")))
    joined = grains.join(totals, "corpus", "left").join(matched, "corpus", "left").na.fill(0, ["patterns", "matched"])
    isp = scores.ratio(F.col("matched"), F.col("patterns"))
    return joined.select(
        "corpus", "files", "nodes", "covered", F.round("macro", 6).alias("ic_macro"), F.round(scores.ratio(F.col("covered"), F.col("nodes")), 6).alias("ic_micro"), "patterns", "matched",
        F.round(isp, 6).alias("isp"), F.round(scores.f1(F.col("macro"), isp), 6).alias("f1"),
    )
