"""Scanning of source trees: relative paths, exclusion rules, manifests and first deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Suffixes of sources, folders left out, their prefixes, and words of test files.
SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".c++", ".h", ".hh", ".hpp", ".hxx")
EXCLUDED_FOLDERS = (
    "__pycache__ _build _deps 3rd-party 3rdparty benchmark benchmarks build builds deps dist example examples extern external gen generated node_modules "
    "out sample samples subprojects test testdata testing tests third-party third_party vendor vendors"
).split()
EXCLUDED_PREFIXES = ("bazel-", "cmake-build-")
TEST_WORDS = ("test", "tests", "unittest", "unittests")
GENERATED_NAMES = (r"(^|[._-])generated([._-]|$)", r"\.(pb|grpc)\.(cc|h)$", r"^(moc_|ui_).+\.(cc|cpp|h|hpp)$")


def posix(path: Column) -> Column:
    """A path with forward slashes and without a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def folders(path: Column) -> Column:
    """Lower-case folder names of a path, outermost first."""
    parts = F.split(F.lower(posix(path)), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def file_name(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def exclusion_reason(path: Column) -> Column:
    """Why a scan leaves a file out: the first folder that bars it, else its name; null if it stays.

    A null path has no reason.
    """
    def bars(folder: Column) -> Column:
        found = folder.startswith(".") | folder.isin(EXCLUDED_FOLDERS)
        for prefix in EXCLUDED_PREFIXES:
            found = found | folder.startswith(prefix)
        return found

    barred = F.filter(folders(path), bars)
    first = F.get(barred, F.lit(0))
    stem = F.regexp_replace(F.lower(file_name(path)), r"\.[^.]*$", "")
    words = F.split(stem, "[^a-z0-9]+")
    generated = F.lit(False)
    for pattern in GENERATED_NAMES:
        generated = generated | F.lower(file_name(path)).rlike(pattern)
    return (
        F.when(first.startswith("."), "hidden-directory")
        .when(first.isNotNull(), "excluded-directory")
        .when(F.arrays_overlap(words, F.array(*map(F.lit, TEST_WORDS))), "test-file")
        .when(generated, "generated-file")
    )


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """All source files below ``root``: ``path`` relative to it, ``byte_count``, ``content`` and ``reason``.

    Files left out stay as rows with their reason, so that diagnostics can count them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^(file:)?/*", "/")
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    relative = F.when(path.startswith(base), F.substring(path, len(base) + 1, 4096))
    rows = found.select(relative.alias("path"), F.col("length").alias("byte_count"), "content")
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z+]+)$", 1))
    return rows.where(suffix.isin(list(SUFFIXES))).withColumn("reason", F.when(F.col("path").isNull(), "path_escape").otherwise(exclusion_reason(F.col("path"))))


def manifest_scan(manifest: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """The listed files of a frozen manifest; a manifest row without a file is an error at run time."""
    joined = manifest.join(listing.withColumn("_there", F.lit(True)), keys, "left")
    missing = F.concat(F.lit("not listed: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return joined.where(F.when(F.col("_there").isNull(), F.raise_error(missing)).otherwise(F.lit(True))).drop("_there")


def first_deliveries(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows with a null key are dropped."""
    first = Window.partitionBy(key).orderBy(order)
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key isn't done yet: how an interrupted run is taken up again."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def projects(files: DataFrame, names: list[str] | None = None, project: str = "project") -> DataFrame:
    """``project, files`` of all projects, or of those named exactly.

    Null, blank and hidden names and names that lead out of the folder are no
    projects; asking for such a name, or for none at all, is an error.
    """
    if names is not None and (not names or any(not n.strip() or n.startswith(".") or ".." in n or "/" in n or "\\" in n for n in names)):
        raise ValueError(f"no names of projects: {names!r}")
    name = F.trim(project)
    rows = files.where((name != "") & ~name.startswith(".") & ~F.col(project).rlike(r"[/\\]|\.\."))
    found = rows.groupBy(F.lower(name).alias("project")).agg(F.count(F.lit(1)).alias("files"))
    return found if names is None else found.where(F.col("project").isin([n.strip().lower() for n in names]))
