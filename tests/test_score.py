"""Scoring: null controls with known answers, edge rules, one-pass sweep against numpy."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelmetry.operators import score as S
from voxelmetry.operators.integrity import content_digests


def bag(n=4000, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"v": rng.integers(0, 2, n), "p": rng.random(n).round(3), "label": rng.integers(0, 3, n), "ct": rng.integers(0, 4, n)})


def test_endpoints_against_numpy(spark):
    pdf = bag()
    got = S.endpoints(spark.createDataFrame(pdf), ["v"], min_sheet=1, min_scored=1).toPandas().set_index("v")
    for v, d in pdf.groupby("v"):
        sheet, scored, p = d.label == 1, d.label != 2, d.p
        t = np.quantile(p[scored], 0.88)
        assert got.loc[v, "budget_threshold"] == pytest.approx(t)
        for pre, cut in (("", 0.2), ("budget_", t)):
            pred = p > cut
            tp, fp = (pred & sheet).sum(), (pred & scored & ~sheet).sum()
            assert got.loc[v, pre + "recall"] == pytest.approx(tp / sheet.sum())
            assert got.loc[v, pre + "precision"] == pytest.approx(tp / (tp + fp))
            assert got.loc[v, pre + "on_empty_share"] == pytest.approx((pred & (d.ct == 0)).sum() / (pred & scored).sum())


def test_random_predictor_has_lift_one_and_perfect_has_inverse_base_rate(spark):
    df = spark.createDataFrame(bag(60000))
    rnd = S.endpoints(df, ["v"]).toPandas()
    assert np.allclose(rnd.precision_lift, 1.0, atol=0.05)
    perfect = S.endpoints(df.withColumn("p", (F.col("label") == 1).cast("double")), ["v"]).toPandas()
    assert np.allclose(perfect.precision_lift, 1 / perfect.base_rate)


def test_minimum_support_gives_a_status(spark):
    e = S.endpoints(spark.createDataFrame(bag(100)), ["v"]).toPandas()
    assert set(e.status) == {"no_sheet"} and e.recall.isna().all()


def test_two_empty_masks_agree_fully(spark):
    df = spark.createDataFrame([(1, False, False)], "v INT, a BOOLEAN, b BOOLEAN")
    r = S.mask_agreement(df, ["v"], F.col("a"), F.col("b")).first()
    assert (r["dice"], r["iou"], r["agreement"]) == (1.0, 1.0, 1.0)


def test_sweep_and_first_strictly_better_cut(spark):
    pdf = bag(1500)
    pdf["m"] = pdf.p + np.random.default_rng(3).normal(0, 0.2, len(pdf)) > 0.5
    df = spark.createDataFrame(pdf)
    sweep = S.threshold_sweep(df, ["v"], F.col("m"))
    base = S.mask_agreement(df, ["v"], F.col("p") > 0.2, F.col("m"))
    got = S.best_threshold(sweep, base, ["v"], 0.2).toPandas().set_index("v")
    for v, d in pdf.groupby("v"):
        dice = lambda t: 2 * ((d.p > t) & d.m).sum() / ((d.p > t).sum() + d.m.sum())
        best, at = dice(0.2), 0.2
        for t in S.SWEEP_CUTS:
            if dice(t) > best:
                best, at = dice(t), t
        assert got.loc[v, "best_dice"] == pytest.approx(best) and got.loc[v, "best_threshold"] == at


def test_equal_content_has_equal_digest_wherever_it_lies(spark):
    a = [("a", 1 + z, 2, x, 5) for z in range(2) for x in range(2)] + [("a", 0, 0, 0, 0)]
    b = [("b", 3 + z, 0, 1 + x, 5) for z in range(2) for x in range(2)] + [("b", 0, 0, 0, 0)]
    d = content_digests(spark.createDataFrame(a + b, "v STRING, z INT, y INT, x INT, ct INT"), ["v"]).toPandas()
    assert d.content_digest.nunique() == 1 and d.raw_digest.nunique() == 2


def test_digests_are_those_of_the_arrays_bytes(spark):
    rng = np.random.default_rng(3)
    vols = {"a": rng.integers(0, 256, (6, 5, 4)), "b": rng.integers(0, 256, (6, 5, 4)) * (rng.random((6, 5, 4)) < 0.1), "empty": np.zeros((6, 5, 4), int)}
    vols["b"][[0, 2, 5]] = 0  # planes without a stored voxel
    rows = [(v, *map(int, p), int(a[tuple(p)])) for v, a in vols.items() for p in np.argwhere(a > 0)] + [("empty", 1, 1, 1, 0)]
    df = spark.createDataFrame(rows, "v STRING, z INT, y INT, x INT, ct INT").repartition(4)
    got = content_digests(df, ["v"], shape=(6, 5, 4)).toPandas().set_index("v")
    for v, a in vols.items():
        assert got.raw_digest[v] == hashlib.sha256(a.astype("u1").tobytes()).hexdigest()
        at = np.argwhere(a > 0)
        crop = None if not len(at) else hashlib.sha256(np.ascontiguousarray(a[tuple(slice(lo, hi + 1) for lo, hi in zip(at.min(0), at.max(0)))].astype("u1")).tobytes()).hexdigest()
        assert got.content_digest[v] == crop
