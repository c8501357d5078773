import pytest

from quarryline.llm import splits

FILES = "file_id long, project string, corpus string, cppFile string, entity string, key string"
ALIASES = "old_name string, new_name string, renamed_at timestamp, src string"


def files(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], FILES)


ROWS = [
    (1, "lib", "library", "Owner__Repo/src/a.cc"),
    (2, "other", "library", "./owner__repo-old\\src\\b.cc"),
    (3, "other", "library", "repos/library/other/oldest__repo/c.cc"),
    (4, "lib", "library", "owner__repo2/a.cc"),
    (5, "Proj", "project", "src/net/FooBar3Win32.cpp"),
    (6, "proj ", "project", "include\\FooBar3.h"),
    (7, "PROJ", "project", "repos/project/proj/base/FooBar3-inl.h"),
    (8, "proj", "project", "src/FooBar3_window.cc"),
    (9, "proj2", "project", "src/FooBar3.cc"),
    (10, None, "project", "repos/project/Proj/src/os/foobar3_linux.c"),
    (11, None, "library", "nothing.cc"),
    (12, None, None, None),
    (1, "lib", "library", "owner__repo/src/a.cc"),
    (None, "lib", "library", "owner__repo/src/a.cc"),
]
RENAMES = [("owner/repo-old", "OWNER/repo", None, "z"), ("oldest/repo", "Owner/repo-old", None, "z"), ("unused/a", "unused/b", None, "z"), (None, "x/y", None, "z"), ("", "x/y", None, "z")]


def test_groups(spark):
    got = {r.file_id: r.group_id for r in splits.related_files(files(spark, ROWS), spark.createDataFrame(RENAMES, ALIASES)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 5, 11: 11, 12: 12}
    pairs = {tuple(r) for r in splits.grouped_files(files(spark, ROWS), spark.createDataFrame(RENAMES, ALIASES)).collect()}
    assert pairs == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (10, 5)}


@pytest.mark.parametrize("name, unit", [("a/foo.inl.h", "foo"), ("foo_unixtime.cc", "foo_unixtime"), ("foo_inline_cache.cc", "foo_inline_cache"), ("fooWindows.cpp", "foo"), ("Win.cpp", "win"), ("foo_win32-inl.h", "foo"), ("fooPort.cc", "fooport")])
def test_unit_names(spark, name, unit):
    assert spark.createDataFrame([(name,)], "p string").select(splits.unit_name(splits.F.col("p"))).first()[0] == unit


def test_splits_hold_shares_and_groups(spark):
    rows = [(i, f"p{i % 400}", "project", f"src/u{i % 7}.cc") for i in range(4000)]
    plan = spark.createDataFrame([("train", 0.7, 1), ("validation", 0.15, 2), ("test", 0.15, 3), (None, 0.5, 4)], "split_name string, share double, bucket int")
    got = splits.grouped_splits(files(spark, rows), spark.createDataFrame([], ALIASES), plan).toPandas()
    assert len(got) == 4000 and got.groupby("group_id").split.nunique().max() == 1
    share = got.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["test"] - 0.15) < 0.03


def test_empty(spark):
    plan = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    assert splits.grouped_splits(files(spark, []), spark.createDataFrame([], ALIASES), plan).count() == 0
    assert splits.grouped_files(files(spark, []), spark.createDataFrame([], ALIASES)).count() == 0
