"""The registered training-data queries on the smallest tables, against SQL where there is some."""

import glob
import os

import pytest

from quarryline.llm import queries
from quarryline.llm.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLES:
        assert len(got.columns) >= 1
        return
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = connection.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got[sorted(got.columns)].values.tolist())) == sorted(map(tuple, want[sorted(got.columns)].values.tolist()))


@pytest.mark.parametrize("name, columns", [("p1_found", "emb_id cluster_id"), ("p2_found", "file_id group_id"), ("p3_found", "file_id"), ("p4_found", "emb_id_a emb_id_b"), ("p5_found", "file_id"), ("p6_found", "file_id_a file_id_b"), ("p8_found", "doc_id item_id"), ("p9_found", "doc_id")])
def test_found_columns(spark, name, columns):
    found = queries.QUERIES[name](spark, FOLDER)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [(c, "bigint") for c in columns.split()]
    assert found.count() == found.distinct().count()
