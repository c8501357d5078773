"""Splits that keep the files of one repository or source unit together.

Entities (names of client repositories, units of projects) are the nodes of a
graph; renames are its edges.  Its components come from concurrent breadth-first
searches (``components``); each file belongs to the component of its entity, and
components are dealt to splits in the order of their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quarryline.llm.components import frontier_components

#: Endings of a unit's inline part and of its platform variants.
INLINE = "inl|inline"
PLATFORMS = "windows|win32|win64|win|android|linux|unix|darwin|macos|mac|osx|ios|posix|freebsd|bsd|solaris|wasm"
CAMEL_PLATFORMS = "Windows|Win32|Win64|Win|Android|Linux|Unix|Darwin|MacOS|Macos|Mac|OSX|Osx|IOS|Ios|Posix|FreeBSD|Bsd|Solaris|Wasm"
#: Buckets of the hash order; their number bounds the table that places the cuts.
BUCKETS = 8192


def clean_path(path: Column) -> Column:
    """A path with forward slashes, without leading dots and without the corpus folder."""
    slashed = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    return F.regexp_replace(slashed, r"^(\./)*(?i:repos/(project|library)/[^/]+/)?", "")


def repository_name(name: Column) -> Column:
    """One spelling of ``owner/repo``: lower case, no blanks, no ``.git``."""
    return F.regexp_replace(F.lower(F.trim(name)), r"(\.git)?/*$", "")


def unit_name(path: Column) -> Column:
    """The unit of a file name: no folder, suffix, inline or platform ending; lower case."""
    stem = F.regexp_replace(F.substring_index(clean_path(path), "/", -1), r"\.[A-Za-z0-9+]+$", "")
    for _ in range(2):
        stem = F.regexp_replace(stem, rf"(?i)(?<=.)[._-]({INLINE})$", "")
        stem = F.regexp_replace(stem, rf"(?<=[a-z0-9])(Inl|Inline)$", "")
        stem = F.regexp_replace(stem, rf"(?i)(?<=.)[._-]({PLATFORMS})$", "")
        stem = F.regexp_replace(stem, rf"(?<=[a-z0-9])({CAMEL_PLATFORMS})$", "")
    return F.lower(stem)


def entity(corpus: Column, project: Column, path: Column) -> Column:
    """The entity a file belongs to, or null where neither project nor path tells.

    Library corpus: ``library:owner/repo``.  Project corpus: ``project:name:unit``;
    a null or blank project is read from the corpus folder in the path.
    """
    client = F.regexp_extract(clean_path(path), r"^([^/]+?)__([^/]+)/", 1), F.regexp_extract(clean_path(path), r"^([^/]+?)__([^/]+)/", 2)
    folder = F.regexp_extract(F.regexp_replace(path, r"[\\/]+", "/"), r"(?i)^(?:\./)*repos/project/([^/]+)/", 1)
    name = F.lower(F.coalesce(F.nullif(F.trim(project), F.lit("")), F.nullif(folder, F.lit(""))))
    library = F.when(client[0] != "", F.concat(F.lit("library:"), repository_name(F.concat_ws("/", *client))))
    unit = F.when(unit_name(path) != "", F.concat(F.lit("project:"), name, F.lit(":"), unit_name(path)))
    kind = F.lower(F.trim(corpus))
    return F.when(kind == "library", library).when(kind == "project", unit)


def related_files(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """The group of every file id, as ``file_id, group_id``; the group's smallest file id names it.

    Null ids are dropped; repeated deliveries of an id count once, and if they
    name several entities these belong together.  A file without an entity is a
    group of its own.  Renames with a null or blank name are ignored.
    """
    named = files.where("file_id is not null").select("file_id", entity(F.col("corpus"), F.col("project"), F.col("cppFile")).alias("entity"))
    named = named.select("file_id", F.coalesce("entity", F.concat(F.lit("file:"), F.col("file_id").cast("string"))).alias("entity")).distinct()
    renames = aliases.select(
        F.concat(F.lit("library:"), repository_name(F.col("old_name"))).alias("src"), F.concat(F.lit("library:"), repository_name(F.col("new_name"))).alias("dst")
    ).where("src != 'library:' and dst != 'library:'")
    several = named.groupBy("file_id").agg(F.min("entity").alias("src"), F.max("entity").alias("dst")).where("src != dst").select("file_id", "src")
    bridges = several.join(named, "file_id").select("src", F.col("entity").alias("dst"))
    components = frontier_components(renames.union(bridges))
    placed = named.join(components, named["entity"] == components["node"], "left").select("file_id", F.coalesce("component", "entity").alias("key"))
    placed = placed.groupBy("file_id").agg(F.min("key").alias("key"))
    # the smallest id of a key is aggregated before the shuffle, so a hot key costs one row a task
    groups = placed.groupBy("key").agg(F.min("file_id").alias("group_id"))
    return placed.join(groups, "key").select("file_id", "group_id")


def grouped_files(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """``related_files`` without groups of one file."""
    groups = related_files(files, aliases)
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("group_id")
    return groups.join(sizes, "group_id").select("file_id", "group_id")


def grouped_splits(files: DataFrame, aliases: DataFrame, plan: DataFrame) -> DataFrame:
    """A split for every file id, near the shares of ``plan``: ``file_id, group_id, split``.

    Groups are ordered by a hash of their id; a group goes to the split in whose
    stretch of the files, in this order, the middle of its hash bucket lies.  The
    order of the splits is that of falling share, then name.  A plan row with a
    null name or share is ignored; shares are taken relative to their sum.
    """
    groups = related_files(files, aliases).withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(BUCKETS)).cast("int"))
    buckets = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bucket")  # over at most BUCKETS rows
    middle = (F.sum("n").over(order) - F.col("n") / 2) / F.sum("n").over(Window.partitionBy())
    places = buckets.select("bucket", middle.alias("at"))
    ranks = Window.orderBy(F.desc("share"), "split_name")  # over the rows of the plan
    shares = plan.where("split_name is not null and share is not null").withColumn("upper", F.sum("share").over(ranks) / F.sum("share").over(Window.partitionBy()))
    cuts = shares.select(F.col("split_name"), "upper")
    dealt = places.join(F.broadcast(cuts), F.col("at") <= F.col("upper") + 1e-12).groupBy("bucket").agg(F.min_by("split_name", "upper").alias("split"))
    return groups.join(dealt, "bucket").select("file_id", "group_id", "split")
