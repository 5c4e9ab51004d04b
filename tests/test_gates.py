"""Population gates, thinning gain, model records and table functions against plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelmetry.functions.names import register_table_functions, window_starts
from voxelmetry.operators import gates as GT
from voxelmetry.operators import learn as L
from voxelmetry.operators import profiles as PR
from voxelmetry.operators import stats as T


def test_gates_against_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"close_pairs": rng.integers(0, 12, 40), "components": rng.integers(1, 9, 40), "median_resolvability": rng.random(40), "sheet_fraction": rng.random(40), "frac_background": rng.random(40), "vol_frac_ignore": rng.random(40)})
    df = spark.createDataFrame(pdf)
    p = GT.close_pair_gate(df).first()
    assert p["median_close_pairs"] == np.median(pdf.close_pairs) and p["share_with_pair"] == pytest.approx((pdf.close_pairs >= 1).mean())
    assert p["median_components"] == np.median(pdf.components) and p["gate_passed"] == (np.median(pdf.close_pairs) >= 5 and (pdf.close_pairs >= 1).mean() >= 0.6)
    r = GT.resolvability_gate(df).first()
    assert r["iqr_ratio"] == pytest.approx(np.quantile(pdf.median_resolvability, 0.75) / np.quantile(pdf.median_resolvability, 0.25))
    assert r["rho"] == pytest.approx(pdf.median_resolvability.rank().corr(pdf.sheet_fraction.rank()))
    m = GT.margin_gate(df).first()
    assert m["q10"] == pytest.approx(np.quantile(pdf.frac_background, 0.1)) and m["corr_ignore"] == pytest.approx(pdf.frac_background.corr(pdf.vol_frac_ignore))
    assert not m["gate_passed"]


def test_thinning_gain_is_the_best_cut_over_all_thresholds(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"v": 1, "p": rng.random(n).round(2), "label": rng.choice([0, 1, 2], n, p=[0.5, 0.3, 0.2]), "kept": rng.random(n) < 0.5})
    pdf.loc[(pdf.label == 1) & (rng.random(n) < 0.6), "kept"] = True
    got = PR.thinning_gain(spark.createDataFrame(pdf), ["v"]).first()
    s = pdf[pdf.label != 2]
    sheet = s.label == 1
    pr = lambda m: ((m & sheet).sum() / sheet.sum(), (m & sheet).sum() / max(m.sum(), 1))
    plain = [pr(s.p > c) for c in PR.PLAIN_CUTS]
    best = None
    for c in PR.NMS_CUTS:
        r, pc = pr(s.kept & (s.p > c))
        ref = max((q for t, q in plain if t >= r), default=None)
        if r >= 0.05 and ref is not None and (best is None or pc - ref > best[1]):
            best = (c, pc - ref)
    assert got["cut"] == best[0] and got["gain"] == pytest.approx(best[1])
    few = spark.createDataFrame(pdf.head(50))
    assert PR.thinning_gain(few, ["v"]).count() == 0


def test_hashed_directions_are_unit_vectors_all_around():
    at = np.argwhere(np.ones((20, 20, 20)))
    n = PR.hashed_directions(3, at)
    assert np.allclose(np.linalg.norm(n, axis=1), 1) and np.abs(n.mean(axis=0)).max() < 0.03 and np.abs((n**2).mean(axis=0) - 1 / 3).max() < 0.02
    assert np.array_equal(n[:50], PR.hashed_directions(3, at[:50])) and not np.allclose(n, PR.hashed_directions(4, at))


def test_arm_warnings(spark):
    rows = [("B", "dark", 0.1, 0.2), ("B", "bright", 0.1, 0.3), ("B", "recall", 0.1, 0.1), ("B", "dice", -0.1, -0.1), ("C", "dark", 0.1, 0.4), ("C", "bright", 0.1, 0.3), ("C", "recall", 0.1, 0.1), ("C", "dice", 0.1, 0.1)]
    df = spark.createDataFrame(rows, "arm STRING, metric STRING, delta DOUBLE, headroom_gain DOUBLE")
    got = {r["arm"]: (r["not_selective"], r["traded_precision"]) for r in T.arm_warnings(df, "arm", "dark", ["bright"], "recall", "dice").collect()}
    assert got == {"B": (True, True), "C": (False, False)}


def test_model_records_are_checked_and_name_their_training(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"slab": np.repeat([1, 2, 3], 40), "item": np.arange(120), "a": rng.random(120), "b": rng.random(120)})
    pdf["y"] = (pdf.a + rng.normal(0, 0.3, 120) > 0.5).astype(int)
    df = spark.createDataFrame(pdf)
    model = L.fit_deployment(df, ["a", "b"], "y", "slab", "item", {"lift10": 2.0})
    again = L.fit_deployment(df.repartition(5), ["a", "b"], "y", "slab", "item")
    assert model["training"]["n_slabs"] == 3 and model["training"]["bad_rate"] == pytest.approx(pdf.y.mean()) and model["validation"] == {"lift10": 2.0}
    assert model["training"]["manifest_sha256"] == again["training"]["manifest_sha256"] and len(model["training"]["manifest_sha256"]) == 64
    other = L.fit_deployment(df.withColumn("a", F.when(F.col("item") == 5, 9.0).otherwise(F.col("a"))), ["a", "b"], "y", "slab", "item")
    assert other["training"]["manifest_sha256"] != model["training"]["manifest_sha256"]
    assert L.checked_model(model, ["a", "b"]) is model
    with pytest.raises(ValueError, match="features"):
        L.checked_model(model, ["a"])
    with pytest.raises(ValueError, match="weights_intercept_then_features has 2 values, not 3"):
        L.score_with(df, model | {"weights_intercept_then_features": [1.0, 2.0]})


def test_window_starts_in_sql_text_equal_the_column_form(spark):
    register_table_functions(spark)
    df = spark.createDataFrame([(s,) for s in (10, 64, 65, 100, 127, 128, 1000)] + [(None,)], "n INT")
    by_sql = spark.sql("SELECT n, start FROM {df}, LATERAL window_starts(n, 64, CAST(0.5 AS DOUBLE))", df=df)
    by_column = df.where("n IS NOT NULL").select("n", F.explode(window_starts("n", 64, 0.5)).alias("start"))
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, by_column.collect()))
