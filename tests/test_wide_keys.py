"""Queries against their SQL where keys are larger, or scores finer, than on the tables at hand."""

import shutil

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from voxelmetry.operators import access as A
from voxelmetry.sources.views import BASE

SMALLEST = "/root/testdata/sf0.001"


def copied(folder, changed, sql):
    for t in BASE:
        if t != changed:
            shutil.copy(f"{SMALLEST}/{t}.parquet", folder)
    duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/{changed}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["f11_morton", "t6_morton_order"])
def test_morton_sql_takes_as_many_bits_as_the_query(spark, tmp_path, name):
    sql = f"""SELECT * REPLACE (l_partkey * 7919 AS l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey + 30000 ELSE l_suppkey END AS l_suppkey)
              FROM '{SMALLEST}/lineitem.parquet'"""
    folder = copied(tmp_path, "lineitem", sql)
    ok, message = compare(spark, connect(folder), folder, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_z_order_of_wide_indices(spark):
    rng = np.random.default_rng(3)
    pts = [tuple(int(v) for v in rng.integers(0, 1 << bits, 3)) for bits in (3, 20, 22, 30, 41) for _ in range(40)]
    key = lambda p: sum(((c >> b) & 1) << (3 * b + 2 - k) for b in range(42) for k, c in enumerate(p))
    got = [(r.bz, r.by, r.bx) for r in A.in_morton_order(spark.createDataFrame(pts, "bz LONG, by LONG, bx LONG"), 1).collect()]
    assert got == sorted(pts, key=key)


def test_review_sql_scores_features_that_are_not_rounded():
    """Only the score is rounded: features rounded before they are scored turn some scores round."""
    sql = entry.oracle_sql()["e2_patch_review"]
    assert "round(ln(1 + size), 6)" not in sql and "round(coalesce(linked / CAST(pairs AS DOUBLE), 0), 6)" not in sql
    assert "ln(1 + size) AS log_size" in sql and "coalesce(linked / CAST(pairs AS DOUBLE), 0) AS clustering" in sql
