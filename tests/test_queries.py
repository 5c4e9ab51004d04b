"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from voxelmetry.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name, entry.queries()[name], SQLS.get(name))
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["population", "field", "n", "median"]
    assert df.count() > 0


def test_only_inexpressible_queries_lack_sql():
    assert set(QUERIES) - set(SQLS) <= {
        "g7_fold_weights", "g8_deployment_model", "g10_held_out_evaluation",
        "g13_wrap_potentials", "v12_across_sheet_normals", "v14_ridge_offset", "v15_sheet_contrast", "v16_resolvability", "v17_label_placement",
        "v18_margin_relabel", "v19_label_thinning", "v20_ridge_nms", "a50_margin_classes", "v22_localisation_error", "v24_half_max_width", "v20_gain_of_both_arms",
    }
