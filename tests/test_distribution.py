"""Order statistics against numpy, with a hot group and under different partitionings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelmetry.operators import distribution as D
from voxelmetry.operators import stats as T
from voxelmetry.operators.distribution import cumulative, quantiles
from voxelmetry.operators.sampling import sample_per_group, top_per_group


def hot_frame(n=6000, seed=1):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))  # group 0 holds two fifths
    value = np.where(rng.random(n) < 0.3, np.round(rng.normal(size=n), 1), rng.lognormal(0, 3, n))
    return pd.DataFrame({"g": group, "v": value, "y": rng.integers(0, 2, n)})


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_match_numpy(spark, parts):
    pdf = hot_frame()
    got = quantiles(spark.createDataFrame(pdf).repartition(parts), "v", {"a": 0.1, "b": 0.5, "c": 0.88, "d": 1.0}, ["g"]).toPandas().set_index("g")
    for g, vs in pdf.groupby("g")["v"]:
        assert np.allclose(got.loc[g, ["a", "b", "c", "d"]].to_numpy(float), np.quantile(vs, [0.1, 0.5, 0.88, 1.0]), rtol=1e-12)
        assert got.loc[g, "n"] == len(vs)


def test_global_quantile_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,), (2.0,)], "v DOUBLE")
    row = quantiles(df, "v", {"m": 0.5}).first()
    assert (row["n"], row["m"]) == (3, 2.0)


def test_running_counts_are_exact(spark):
    pdf = hot_frame(2000)
    got = cumulative(spark.createDataFrame(pdf), "v", ["g"], {"pos": F.col("y")}).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("v")
        assert (part["n"].cumsum() == part["cum"]).all()
        assert (part["pos"].cumsum() == part["cum_pos"]).all()
        assert (part["total"] == (pdf.g == g).sum()).all()


def test_ranges_of_a_hot_group_give_the_same_counts(spark, monkeypatch):
    """With few values a range, the group of two fifths of all rows lies in many of them."""
    pdf = hot_frame(3000)
    df = spark.createDataFrame(pdf)
    whole = cumulative(df, "v", ["g"], {"pos": F.col("y")}).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    monkeypatch.setattr(D, "PER_RANGE", 100)
    cut = cumulative(df, "v", ["g"], {"pos": F.col("y")})
    pd.testing.assert_frame_equal(cut.toPandas().sort_values(["g", "v"]).reset_index(drop=True)[whole.columns], whole)
    got = quantiles(df, "v", {"m": 0.5}).first()
    assert got["m"] == pytest.approx(np.median(pdf.v)) and got["n"] == len(pdf)


def test_mann_whitney_against_pairs(spark):
    pdf = hot_frame(400)
    pdf["v"] = pdf["v"].round(0)
    got = T.mann_whitney(spark.createDataFrame(pdf), "v", F.col("y") == 1, with_p=True).first()
    x, z = pdf.v[pdf.y == 1].to_numpy(), pdf.v[pdf.y == 0].to_numpy()
    u = (x[:, None] > z[None, :]).sum() + 0.5 * (x[:, None] == z[None, :]).sum()
    assert got["u"] == u
    assert got["auc"] == pytest.approx(u / (len(x) * len(z)))
    assert 0 <= got["p"] <= 1


def test_wilcoxon_small_case(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (2.0,), (3.0,)], "d DOUBLE")
    got = T.wilcoxon(df, "d").first()
    assert (got["n"], got["w_plus"], got["w_minus"]) == (4, 8.5, 1.5)


@pytest.mark.parametrize("parts", [1, 5])
def test_rank_rows_with_one_hot_group_and_ties(spark, parts):
    pdf = hot_frame(3000)
    pdf["v"], pdf["name"] = pdf["v"].round(0), np.arange(len(pdf))
    df = spark.createDataFrame(pdf).repartition(parts)
    got = T.rank_rows(df, ["g"], [F.desc("v"), F.asc("name")]).toPandas().set_index("name")["rank"]
    want = pdf.sort_values(["g", "v", "name"], ascending=[True, False, True])
    want["rank"] = want.groupby("g").cumcount() + 1
    assert (got.sort_index() == want.set_index("name")["rank"].sort_index()).all()


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": [0] * 500 + [1] * 20, "i": range(520)}))
    pick = lambda d: {tuple(r) for r in sample_per_group(d, ["g"], ["g", "i"], 15, seed=3).select("g", "i").collect()}
    a, b = pick(df.repartition(1)), pick(df.repartition(6))
    assert a == b and len(a) == 30


def test_top_per_group(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": [0] * 300, "i": range(300), "s": [i % 7 for i in range(300)]}))
    got = [tuple(r) for r in top_per_group(df, ["g"], [F.desc("s")], ["i"], 3).orderBy("rank").select("i", "rank").collect()]
    assert got == [(6, 1), (13, 2), (20, 3)]


def test_lift_of_perfect_and_constant_rankings(spark):
    pdf = pd.DataFrame({"g": 0, "i": range(100), "y": [1] * 10 + [0] * 90})
    perfect = T.rank_rows(spark.createDataFrame(pdf), ["g"], [F.desc("y"), F.asc("i")])
    assert T.lift_at(perfect, ["g"], "y", [0.1]).first()["lift"] == pytest.approx(10.0)


def test_two_peaks(spark):
    v = [1.0] * 50 + [1.6] * 10 + [9.1] * 30 + [5.0] * 2
    got = T.two_peaks(spark.createDataFrame([(x,) for x in v], "v DOUBLE"), "v").first()
    assert got["bimodal"] and got["upper_ok"] and got["dip"] == 0
