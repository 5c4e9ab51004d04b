"""Which scan and level a prediction belongs to, when a scroll has several scans."""


from voxelmetry.operators import catalog as C
from voxelmetry.operators import components as P
from voxelmetry.plans.lifecycle import recall_records

NAME = "{ct}-surface-20240101000000-base-L{level}-th0.2.zarr"
FIRST, SECOND = "20230101000000", "20250101000000"


def status(spark, scans, level, ct=FIRST, shape=4):
    """actual_level and status of a prediction; scans: (stamp, level, side)."""
    runs = spark.createDataFrame([("s", NAME.format(ct=ct, level=level), [shape] * 3)], "scroll STRING, name STRING, shape ARRAY<INT>")
    rows = [("s", f"{stamp}-2.4um-77keV.zarr", k, [side] * 3) for stamp, k, side in scans]
    r = C.build_catalogue(runs, spark.createDataFrame(rows, "scroll STRING, ct_volume STRING, level INT, shape ARRAY<INT>")).first()
    return r.actual_level, r.status


def test_levels_of_another_scan_do_not_count(spark):
    one = [(FIRST, 0, 16), (FIRST, 1, 8), (FIRST, 2, 4)]
    two = [(SECOND, 0, 4), (SECOND, 1, 2), (SECOND, 2, 1)]
    assert status(spark, one, 2) == (2, "verifiable")
    assert status(spark, one + two, 2) == (2, "verifiable")
    assert status(spark, [(FIRST, 0, 16), *two], 0) == (None, "no_matching_level")
    assert status(spark, one + two, 0, ct=SECOND) == (0, "verifiable")


def test_levels_beyond_a_gap_do_not_count(spark):
    assert status(spark, [(FIRST, 0, 16), (FIRST, 2, 4), (SECOND, 1, 9)], 2) == (None, "no_matching_level")
    assert status(spark, [(SECOND, 0, 4)], 0) == (None, "ct_missing")


def test_fragments_count_pieces_beyond_the_first_of_every_component(spark):
    at = "vol INT, z INT, y INT, x INT, component LONG"
    sheet = [(1, 0, 3 * c, x, c) for c in range(60) for x in range(5)]
    pred = [(1, 0, 3 * c, x, 2 * c + (x > 2)) for c in range(50, 60) for x in (0, 1, 3)]
    got = P.fragments(spark.createDataFrame(sheet, at), spark.createDataFrame(pred, at), ["vol"], min_size=5).first()
    assert (got.measured, got.fragments) == (60, 10 / 60)


def test_missed_sheet_is_measured_to_the_nearest_prediction(spark):
    rows = [(1, 0, 0, x, 0.9 if x in (0, 7) else 0.1, 1 if x < 5 else 0, 9) for x in range(8)]
    rows += [(2, 0, 0, x, 0.9, 1 if x < 5 else 0, 9) for x in range(8)] + [(3, 0, 0, x, 0.1, 1 if x < 5 else 0, 9) for x in range(8)]
    vox = spark.createDataFrame(rows, "vol INT, z INT, y INT, x INT, p DOUBLE, label INT, ct INT")
    got = {r.vol: r for r in recall_records(vox, ["vol"], (1, 1, 8), 0.5, min_sheet=1, min_scored=1).collect()}
    # missed at 1, 2, 3, 4, which are 1, 2, 3, 3 away
    assert (got[1].orphan_dist_median, got[1].missed_far_frac) == (2.5, 0.0)
    assert (got[2].orphan_dist_median, got[2].missed_far_frac) == (0.0, 0.0)
    assert (got[3].orphan_dist_median, got[3].missed_far_frac) == (None, 1.0)
    assert got[1].sheet_mean_depth == 3.0
