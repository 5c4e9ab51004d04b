"""Neighbourhood operators and block kernels against brute force, with and without a block cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelmetry.operators import blocks as B
from voxelmetry.operators import components as C
from voxelmetry.operators import profiles as PR
from voxelmetry.operators import volumes as V
from voxelmetry.operators.blocks import across_sheet_normals, gaussian_filter

SHAPE = (12, 14, 13)
BY = ["v"]


def table(spark, **arrays):
    at = np.indices(SHAPE).reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame({"v": 1, **dict(zip("zyx", at.astype("int32"))), **{k: a.reshape(-1) for k, a in arrays.items()}}))


def mask_of(df):
    m = np.zeros(SHAPE, bool)
    for r in df.select("z", "y", "x").collect():
        m[r["z"], r["y"], r["x"]] = True
    return m


@pytest.fixture(scope="module")
def mask():
    return np.random.default_rng(0).random(SHAPE) < 0.3


def neighbours(m, op, start):
    out = m.copy()
    for axis in range(3):
        for s in (1, -1):
            moved = np.roll(m, s, axis)
            edge = [slice(None)] * 3
            edge[axis] = 0 if s == 1 else -1
            moved[tuple(edge)] = start
            out = op(out, moved)
    return out


def brute_components(m):
    label, seen = {}, set()
    for p in map(tuple, np.argwhere(m)):
        if p in seen:
            continue
        stack, seen = [p], seen | {p}
        while stack:
            q = stack.pop()
            label[q] = p
            for d in V.FACES:
                r = (q[0] + d[0], q[1] + d[1], q[2] + d[2])
                if r not in seen and all(0 <= c < n for c, n in zip(r, SHAPE)) and m[r]:
                    seen.add(r)
                    stack.append(r)
    return label


def test_dilation_and_erosion(spark, mask):
    df = table(spark, m=mask).where("m")
    assert (mask_of(V.dilate(df, BY, SHAPE)) == neighbours(mask, np.logical_or, False)).all()
    assert (mask_of(V.erode(df, BY)) == neighbours(mask, np.logical_and, False)).all()


def test_distance_is_exact(spark, mask):
    sparse = mask & (np.random.default_rng(1).random(SHAPE) < 0.02)
    t = table(spark, m=sparse)
    got = V.distance(t.drop("m"), t.where("m"), BY, SHAPE).toPandas()
    targets = np.argwhere(sparse)
    at = got[["z", "y", "x"]].to_numpy()
    want = np.sqrt(((at[:, None, :] - targets[None]) ** 2).sum(axis=2).min(axis=1))
    assert np.allclose(got["distance"].to_numpy(), want)


def test_distance_without_target_is_null(spark):
    t = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0)], "v INT, z INT, y INT, x INT")
    got = {r["v"]: r["distance"] for r in V.distance(t, t.where("v = 1"), BY, (1, 1, 1)).collect()}
    assert got == {1: 0.0, 2: None}


@pytest.mark.parametrize("block", [3, 5, 64])
def test_components(spark, mask, block):
    got = C.label_voxels(table(spark, m=mask).where("m"), BY, block).collect()
    want = brute_components(mask)
    assert len(got) == len(want)
    for r in got:
        z, y, x = want[(r["z"], r["y"], r["x"])]
        assert r["component"] == (int(z) << 42) | (int(y) << 21) | int(x)


def test_long_chain_is_one_component(spark):
    n = 400
    df = spark.range(n).select(F.lit(1).alias("v"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    got = C.label_voxels(df, BY, 2)
    assert got.select("component").distinct().count() == 1 and got.count() == n


def test_cavity(spark):
    shell = np.zeros(SHAPE, bool)
    shell[2:7, 2:7, 2:7] = True
    shell[3:6, 3:6, 3:6] = False
    shell[8:11, 2:5, 2:5] = True  # solid
    t = table(spark, m=shell)
    assert mask_of(C.cavities(t.where("m"), t, BY, SHAPE, 4)).sum() == 27


def test_relational_gaussian_equals_kernel(spark):
    a = np.random.default_rng(2).random(SHAPE)
    got = V.gaussian(table(spark, a=a), BY, SHAPE, 1.0, "a").toPandas()
    want = gaussian_filter(a, 1.0)
    assert np.allclose(got["a"].to_numpy(), want[got.z, got.y, got.x])


def test_box_statistics(spark):
    a = np.random.default_rng(3).random(SHAPE)
    got = V.box_statistics(table(spark, a=a), BY, SHAPE, "a", 5).toPandas()
    p = np.pad(a, 2, mode="symmetric")
    for r in got.sample(40, random_state=0).itertuples():
        w = p[r.z : r.z + 5, r.y : r.y + 5, r.x : r.x + 5]
        assert r.local_mean == pytest.approx(w.mean()) and r.local_std == pytest.approx(w.std(), abs=1e-7)


def test_gradient(spark):
    a = np.random.default_rng(4).random(SHAPE)
    got = V.gradient(table(spark, a=a), BY, SHAPE, "a").toPandas()
    for k, g in zip("zyx", np.gradient(a)):
        assert np.allclose(got[f"g{k}"].to_numpy(), g[got.z, got.y, got.x])


def sheet_volume(centre=6.3, width=1.5):
    """One flat bright sheet across z, with its label and a known ridge."""
    z = np.arange(SHAPE[0])[:, None, None] + np.zeros(SHAPE)
    ct = 200 * np.exp(-0.5 * ((z - centre) / width) ** 2)
    return ct, (np.abs(z - centre) <= 1.5).astype(int)


def profile_rows(spark, side, **kw):
    ct, label = sheet_volume()
    return PR.sample_profiles(table(spark, ct=ct, label=label), BY, SHAPE, "label = 1", side=side, **kw)


def test_profiles_do_not_depend_on_blocks(spark):
    noise = np.random.default_rng(5).normal(0, 5, SHAPE)
    ct, label = sheet_volume()
    t = table(spark, ct=ct + noise, label=label)
    cut = [PR.sample_profiles(t, BY, SHAPE, "label = 1", side=s).toPandas().sort_values(["z", "y", "x"]) for s in (5, 64)]
    assert np.allclose(np.stack(cut[0].profile), np.stack(cut[1].profile))
    assert np.allclose(cut[0][["nz", "ny", "nx"]], cut[1][["nz", "ny", "nx"]], atol=1e-6)
    assert (np.stack(cut[0]["labels"]) == np.stack(cut[1]["labels"])).all()


def test_ridge_is_found_to_a_quarter_voxel(spark):
    got = profile_rows(spark, 6).select("z", "nz", PR.ridge_offset(F.col("profile"), 4.0).alias("off")).toPandas()
    inner = got.dropna()
    assert len(inner) > 100
    assert np.allclose(np.abs(inner.nz), 1, atol=1e-3)
    assert (np.abs(inner.z + np.sign(inner.nz) * inner.off - 6.3) < 0.25).all()


def test_runs_margins_and_thinning(spark):
    p = profile_rows(spark, 64)
    thin = PR.thin_labels(p, BY, width=1.0).toPandas()
    assert 0 < thin.kept.sum() < len(thin)
    m = PR.margin_classes(p, BY).first()
    assert m["frac_background"] == 1.0 and m["frac_surface"] == 0.0


def test_relabelling_only_turns_background_to_ignore(spark):
    ct, label = sheet_volume()
    v = table(spark, ct=ct, label=label)
    out = PR.relabel_margin(v, profile_rows(spark, 64), BY, SHAPE)
    j = v.select("z", "y", "x", F.col("label").alias("old")).join(out.select("z", "y", "x", "label"), ["z", "y", "x"])
    pairs = {(r["old"], r["label"]): r["count"] for r in j.groupBy("old", "label").count().collect()}
    assert set(pairs) <= {(0, 0), (1, 1), (0, 2)} and pairs[(0, 2)] > 0


def test_non_maxima(spark):
    ct, label = sheet_volume()
    p = table(spark, p=ct / 200, label=label)
    kept = PR.suppress_non_maxima(p, BY, SHAPE, low=0.5, side=5).where("kept").toPandas()
    assert set(kept.z) == {6}  # the crest nearest to 6.3
    control = [PR.suppress_non_maxima(p, BY, SHAPE, low=0.5, random_seed=1, side=s).where("kept").count() for s in (5, 64)]
    assert control[0] == control[1] >= len(kept)


def test_profile_measures_on_arrays(spark):
    rng = np.random.default_rng(6)
    prof = rng.random((20, 33))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(prof)], "i INT, profile ARRAY<DOUBLE>")
    got = df.select("i", PR.resolvability(F.col("profile"), half=4.0).alias("r"), PR.half_max_width(F.col("profile")).alias("w")).toPandas().set_index("i")
    ts = np.arange(-4, 4.01, 0.25)
    for i, r in enumerate(prof):
        d2 = np.diff(r, 2)
        noise = max(1.4826 * np.median(np.abs(d2 - np.median(d2))) / np.sqrt(6), 1e-3)
        assert got.loc[i, "r"] == pytest.approx((r.max() - np.median(r[np.abs(ts) >= 0.7 * 4])) / noise)
        above = r >= r.min() + 0.5 * (r.max() - r.min())
        if not above[16]:
            assert np.isnan(got.loc[i, "w"])
            continue
        lo = hi = 16
        while lo > 0 and above[lo - 1]:
            lo -= 1
        while hi < 32 and above[hi + 1]:
            hi += 1
        assert got.loc[i, "w"] == pytest.approx((hi - lo + 1) * 0.25)


def test_normals_of_a_tilted_sheet():
    z, y, x = np.indices((24, 24, 24))
    n = np.array([0.8, 0.6, 0.0])
    field = np.exp(-0.5 * ((z * n[0] + y * n[1] - 16) / 1.5) ** 2) * 100
    got = across_sheet_normals(field, np.array([[11, 12, 12], [14, 8, 10]]))
    assert np.allclose(got, n, atol=0.05)


def test_attenuation_never_brightens(spark):
    ct, label = sheet_volume()
    v = table(spark, ct=ct / 255, label=label)
    out = PR.attenuate_sheet(v, BY, SHAPE, 0.4, side=6).withColumnRenamed("ct", "after").join(v.select("z", "y", "x", "ct"), ["z", "y", "x"]).toPandas()
    assert (out.after <= out.ct + 1e-12).all() and out.after.min() >= 0
    core = out[(out.z == 6)]
    assert np.allclose(core.after.max() / core.ct.max(), 0.6, atol=0.05)


def test_contact_masks_do_not_depend_on_the_blocks(spark, mask):
    """All radii in one pass, with and without a cut, against whole-array dilation and erosion."""
    def grown(m, r, fn, outside):
        for _ in range(r):
            m = neighbours(m, fn, outside)
        return m

    df = table(spark, m=mask).where("m")
    for side in (4, 64):
        got = V.contact(df, BY, SHAPE, (1, 2, 3), side)
        for r in (1, 2, 3):
            closed = grown(grown(mask, r, np.logical_or, False), r, np.logical_and, False)
            want = grown(closed & ~mask, r, np.logical_or, False) & mask
            assert {tuple(c) for c in got.where(f"radius = {r}").select("z", "y", "x").collect()} == {tuple(int(v) for v in c) for c in np.argwhere(want)}


def test_blocks_without_own_voxels_are_passed_over(spark):
    """A voxel in the corner of a block reaches eight, one on a face two; a kernel that answers at stored voxels runs in its own alone."""
    df = spark.createDataFrame([(1, 0, 0, 0, 1.0), (2, 64, 3, 70, 1.0)], "v INT, z INT, y INT, x INT, m DOUBLE")
    once = lambda b: pd.DataFrame({"z": [0], "y": [0], "x": [0], "_": [True]})
    for at_voxels, calls in ((True, 2), (False, 8 + 2)):
        spec = B.KernelSpec("once", 1, "_ BOOLEAN", once, at_voxels)
        assert B.run_kernel(df, BY, None, ["m"], spec).count() == calls
    line = spark.createDataFrame([(1, 1, 1, x) for x in range(60, 70)], "v INT, z INT, y INT, x INT")
    assert sorted(r.x for r in V.erode(line, BY, [(0, 0, 1), (0, 0, -1)]).collect()) == list(range(61, 69))


def test_many_small_planes_are_answered_together(spark, monkeypatch):
    """Distances in many volumes, answered in a few batches or one by one, against all pairs."""
    rng = np.random.default_rng(6)
    shape = (5, 6, 7)
    draw = lambda n: sorted({tuple(map(int, r)) for r in np.stack([rng.integers(0, k, n) for k in (30, *shape)], axis=1)})
    points, targets = draw(300), [t for t in draw(120) if t[0] != 7]
    df = lambda rows: spark.createDataFrame(rows, "v INT, z INT, y INT, x INT")
    want = {p: min((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p[1:], t[1:])))) for t in targets if t[0] == p[0]), default=None) for p in points}
    for cells, span in ((1 << 15, 1 << 28), (0, 1 << 28), (40, 100)):
        monkeypatch.setattr(V, "CELLS", cells)
        monkeypatch.setattr(V, "SPAN", span)
        for limit in (None, 1.5):
            got = {(r.v, r.z, r.y, r.x): r.distance for r in V.distance(df(points), df(targets), BY, shape, limit).collect()}
            near = {p: d if d is not None and (limit is None or d <= limit) else None for p, d in want.items()}
            assert got.keys() == near.keys() and all((got[p] is None) == (d is None) and (d is None or abs(got[p] - d) < 1e-12) for p, d in near.items())


def test_displacements_count_pairs_of_voxels_whatever_the_blocks(spark):
    """Offsets of scattered, repeated and far voxels against plain loops, and the totals that a contrast needs."""
    from voxelmetry.operators import alignment as AL

    rng = np.random.default_rng(4)
    rows = [(v, *map(int, at), int(c)) for v in (1, 2) for at, c in zip(rng.integers(0, 9, (60, 3)), rng.integers(0, 200, 60))] + [(1, 500, 500, 500, 7), (3, 4, 4, 4, 9)]
    rows += rows[:5]
    masked = [r[:4] for r in rows[::3]] + [(2, 100, 0, 0), (4, 4, 4, 4)]
    scan, mask = spark.createDataFrame(rows, "vol INT, z INT, y INT, x INT, ct INT"), spark.createDataFrame(masked, "vol INT, z INT, y INT, x INT")
    want = {}
    for v, *c, ct in rows:
        for w, *m in masked:
            d = tuple(b - a for a, b in zip(c, m))
            if v == w and max(map(abs, d)) <= 2:
                n, s = want.get(d, (0, 0.0))
                want[d] = (n + 1, s + ct)
    for side in (4, 64):
        got = {(r.dz, r.dy, r.dx): (r.n_on, r.s_on) for r in AL.displacements(scan, mask, ["vol"], 2, side).where("n_on > 0").collect()}
        assert got == want
    totals = AL._displacements(scan, mask, ["vol"], 2).select("n", "s").distinct().collect()
    assert [tuple(r) for r in totals] == [(len(rows), float(sum(r[4] for r in rows)))]


def test_packed_rows_are_those_of_plain_loops():
    """Every voxel goes to the blocks in whose padded region it lies, in any order of rows and with far coordinates."""
    from itertools import product

    import pyarrow as pa

    rng = np.random.default_rng(3)
    far = 1 << 21
    for side, halo, shape in ((4, 0, None), (4, 1, (9, 7, 5)), (3, 5, None), (64, 2, None), (4, 9, (9, 7, 5))):
        at = np.stack([rng.integers(0, n, 50) for n in (9, 7, 5)], axis=1)
        if shape is None:
            at[:2] = [[far - 1] * 3, [-far] * 3]
        keys = rng.integers(0, 3, 50).tolist()
        batch = pa.RecordBatch.from_arrays([pa.array([k or None for k in keys]), *[pa.array(a.astype(np.int32)) for a in at.T], pa.array(np.arange(50.0))], ["vol", "z", "y", "x", "v"])
        cut = B.Cut(side, halo, None if shape is None else np.array(shape))
        want = set()
        reach = -(-halo // side)
        for i, p in enumerate(at):
            for d in product(range(-reach, reach + 1), repeat=3):
                block = p // side + d
                lo, hi = cut.region(block)
                if cut.exists(block[None])[0] and (p >= lo).all() and (p < hi).all():
                    want.add((keys[i] or None, *block.tolist(), int(np.ravel_multi_index(p - lo, hi - lo)), float(i)))
        got = [(r["vol"], r["_bz"], r["_by"], r["_bx"], a, v) for out in B.packer(1, cut)([batch]) for r in out.to_pylist() for a, v in zip(np.frombuffer(r["_at"], np.int32).tolist(), np.frombuffer(r["_v0"]).tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_on_long_empty_lines(spark):
    """Lines of 5,000 cells with a few sites: the work follows the sites, and answers come at the asked points only."""
    rng = np.random.default_rng(8)
    shape = (3, 4, 5000)
    targets = [(1, int(z), int(y), int(x)) for z, y, x in zip(rng.integers(0, 3, 12), rng.integers(0, 4, 12), rng.integers(0, 5000, 12))]
    points = [(v, int(z), int(y), int(x)) for v in (1, 2) for z, y, x in zip(rng.integers(0, 3, 40), rng.integers(0, 4, 40), rng.integers(0, 5000, 40))]
    df = lambda rows: spark.createDataFrame(rows, "vol LONG, z INT, y INT, x INT")
    at = np.array([t[1:] for t in targets])
    for limit in (None, 90.0):
        got = V.distance(df(points), df(targets), ["vol"], shape, limit).collect()
        assert len(got) == len(points)
        for r in got:
            want = np.sqrt(((at - [r.z, r.y, r.x]) ** 2).sum(1).min()) if r.vol == 1 else None
            if want is not None and limit is not None and want > limit:
                want = None
            assert (r.distance is None) == (want is None) and (want is None or abs(r.distance - want) < 1e-9)


def test_envelope_against_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(30):
        n, m = rng.integers(1, 60), rng.integers(1, 60)
        line, pos, val = rng.integers(0, 4, n), rng.integers(0, 100, n), rng.integers(0, 400, n).astype(float)
        ask_line, ask = rng.integers(0, 5, m), rng.integers(0, 100, m)
        want = [min((v + (q - p) ** 2 for k, p, v in zip(line, pos, val) if k == a), default=np.inf) for a, q in zip(ask_line, ask)]
        assert np.array_equal(V.nearest_on_lines(line, pos, val, ask_line, ask), want)


def test_packed_fields_join_block_by_block_and_refuse_unequal_shapes(spark):
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 3, (6, 7, 9)), rng.integers(0, 3, (6, 7, 9))
    rows = lambda m: [("v", *map(int, p), int(m[tuple(p)])) for p in np.argwhere(m > 0)]
    df = lambda m: spark.createDataFrame(rows(m), "vol STRING, z INT, y INT, x INT, v INT").repartition(3)
    pack = lambda m, shape=(6, 7, 9): B.pack_field(df(m), ["vol"], shape, "v", 4)
    both = B.per_block(B.join_fields(pack(a), pack(b), ["vol"]), ["vol"], "n BIGINT", lambda x, y: {"n": int((x == y).sum())})
    assert both.agg(F.sum("n")).first()[0] == (a == b).sum()
    a[:, :, 4:] = 0  # blocks of one field only
    halves = B.per_block(B.join_fields(pack(a), pack(b), ["vol"]), ["vol"], "n BIGINT", lambda x, y: {"n": int((y if x is None else (x == 0) * y).sum())})
    assert halves.agg(F.sum("n")).first()[0] == b[a == 0].sum()
    with pytest.raises(Exception, match="fields differ in shape"):
        B.join_fields(pack(a), pack(b, (6, 7, 10)), ["vol"]).count()
    with pytest.raises(Exception, match="fields differ in shape"):
        B.join_fields(pack(a), pack(b).where("false"), ["vol"]).count()


def test_packed_rows_hold_no_voxel_rows(spark):
    """What a kernel's shuffle moves: one row for each task, block and target, whatever the number of voxels."""
    full = spark.range(16**3).selectExpr("1L AS vol", "cast(id div 256 as int) AS z", "cast(id div 16 % 16 as int) AS y", "cast(id % 16 as int) AS x", "1 AS v").coalesce(1)
    rows = B.packed(full, ["vol"], ["v"], B.Cut(8, 2, np.array([16, 16, 16])))
    assert rows.count() == 8
    assert sum(len(r["_at"]) for r in rows.collect()) == 4 * 8 * 10**3


def test_ridge_nms_joins_written_voxels_without_a_broadcast(spark, monkeypatch):
    """Files of voxels are far smaller than their rows in memory, so their size mustn't choose a broadcast."""
    from voxelmetry.plans import volume_queries as Q
    from voxelmetry.plans.registry import QUERIES

    plans = {}
    write = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, name))
    assert QUERIES["v20_ridge_nms"](spark, "/root/testdata/sf0.001").count()
    assert "strategy=merge" in plans["nms"]


def test_scattered_voxels_are_packed_by_whole_blocks(spark):
    """However voxels are dealt over tasks, a block and target has about one packed row."""
    rng = np.random.default_rng(4)
    rows = [(v, *map(int, p), 1.0) for v in range(20) for p in rng.integers(0, 8, (60, 3))]
    df = spark.createDataFrame(list(dict.fromkeys(rows)), "v INT, z INT, y INT, x INT, f DOUBLE").repartition(16)
    cut = B.Cut(4, 0, np.array((8, 8, 8)))
    got = B.packed(df, BY, ["f"], cut).toPandas()
    assert not got.duplicated(["v", "_bz", "_by", "_bx"]).any() and got._at.map(len).sum() == 4 * df.count()


def test_kernels_of_volumes_without_a_border_see_only_what_lies_around_the_voxels(spark):
    df = spark.createDataFrame([(1, 70, -3, 5, 1.0), (1, 72, -3, 5, 1.0), (1, 130, 9, 9, 1.0)], "v INT, z INT, y INT, x INT, f DOUBLE")

    def kernel(b):
        at = b.core_points(b.arrays["f"] > 0)
        return pd.DataFrame({**dict(zip("zyx", at.T.astype("int32"))), "cells": b.arrays["f"].size}) if len(at) else B.nothing(["z", "y", "x", "cells"])

    got = B.run_kernel(df, BY, None, ["f"], B.KernelSpec("size", 1, "cells BIGINT", kernel)).collect()
    assert sorted((r.z, r.y, r.x) for r in got) == [(70, -3, 5), (72, -3, 5), (130, 9, 9)]
    assert max(r.cells for r in got) <= 5 * 3 * 3
