"""Sources, sinks, guards and incremental streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelmetry.functions import names as N
from voxelmetry.operators import access as A
from voxelmetry.operators import catalog as C
from voxelmetry.operators import integrity as I
from voxelmetry.operators import sampling as P
from voxelmetry.operators import blocks as B
from voxelmetry.sources import chunks as K
from voxelmetry.sources import store as ST
from voxelmetry.sources import patches as PT
from voxelmetry.sources import records as R
from voxelmetry.streaming import incremental as S


def test_records_have_a_declared_schema_and_their_file_name(spark, tmp_path):
    (tmp_path / "sample_00001.json").write_text(json.dumps({"status": "ok", "recall": 0.5, "recall_by_threshold": {"0.2": 0.5}}, indent=1))
    (tmp_path / "sample_00002.json").write_text(json.dumps({"sample": "given", "status": "no_sheet_in_region", "unknown": 1}))
    (tmp_path / "notes.txt").write_text("no record")
    got = {r["sample"]: r for r in R.read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"sample_00001", "given"}
    assert got["sample_00001"]["recall_by_threshold"] == {"0.2": 0.5} and got["given"]["recall"] is None


def test_catalogue_file(spark, tmp_path):
    rows = [{"scroll": "S1", "prediction": "p", "model": "base", "pred_shape": [1, 2, 3], "declared_level": 2, "status": "verifiable"}]
    (tmp_path / "catalog.json").write_text(json.dumps(rows))
    df = R.read_catalogue(spark, str(tmp_path / "catalog.json"))
    assert df.first()["pred_shape"] == [1, 2, 3]
    assert C.resolve_artifact(df, "S1", "base", 2).first()["prediction"] == "p"
    with pytest.raises(Exception, match="no prediction for S2"):
        C.resolve_artifact(df, "S2").collect()
    with pytest.raises(Exception, match="several predictions for S1: model base level 2; model base level 2"):
        C.resolve_artifact(df.union(df), "S1").collect()


def test_chunk_store(spark, tmp_path):
    vol = np.random.default_rng(0).integers(0, 255, (8, 8, 8)).astype("u1")
    for i in range(2):
        for j in range(2):
            for k in range(2):
                if (i, j, k) != (1, 1, 1):  # an absent chunk
                    (tmp_path / f"{i}.{j}.{k}").write_bytes(vol[i * 4 : i * 4 + 4, j * 4 : j * 4 + 4, k * 4 : k * 4 + 4].tobytes())
    (tmp_path / ".zarray").write_text(json.dumps({"shape": [8, 8, 8], "chunks": [4, 4, 4], "dtype": "|u1", "compressor": None}))
    got = K.read_chunks(spark, str(tmp_path), (8, 8, 8), (4, 4, 4), box=(2, 7, 0, 8, 3, 6)).toPandas()
    assert (got.value.to_numpy() == vol[got.z, got.y, got.x]).all()
    assert len(got) == 5 * 8 * 3 - 3 * 4 * 2
    m = K.parse_array_metadata(spark.createDataFrame([((tmp_path / ".zarray").read_text(),), ("{broken",)], "t STRING"), "t").collect()
    assert m[0]["shape"] == [8, 8, 8] and m[0]["compressor"] is None and m[1]["shape"] is None


def make_store(folder, vol, side, skip=(), fill=7, separator="."):
    """Chunk files of an array, the last ones padded, and the metadata beside them."""
    folder.mkdir()
    grid = [-(-n // side) for n in vol.shape]
    padded = np.full([g * side for g in grid], 99, "<i2")
    padded[tuple(slice(0, n) for n in vol.shape)] = vol
    for index in np.ndindex(*grid):
        if index not in skip:
            path = folder / separator.join(map(str, index))
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(padded[tuple(slice(i * side, i * side + side) for i in index)].tobytes())
    meta = {"shape": vol.shape, "chunks": [side] * 3, "dtype": "<i2", "compressor": None, "fill_value": fill, "dimension_separator": separator}
    (folder / ".zarray").write_text(json.dumps(meta))


@pytest.mark.parametrize("separator, run", [(".", 16), ("/", 1)])
def test_store_source_reads_whole_volumes_and_fills_missing_chunks(spark, tmp_path, separator, run):
    vol = np.random.default_rng(1).integers(-300, 300, (7, 9, 5))
    make_store(tmp_path / "s", vol, 4, skip={(0, 1, 1)}, separator=separator)
    want = vol.copy()
    want[0:4, 4:8, 4:5] = 7
    got = ST.read_store(spark, str(tmp_path / "s"), run).toPandas()
    assert len(got) == vol.size and not got.duplicated(["z", "y", "x"]).any()
    assert (got.value.to_numpy() == want[got.z, got.y, got.x]).all()
    assert set(got[~got.stored][["cz", "cy", "cx"]].itertuples(index=False, name=None)) == {(0, 1, 1)}


def test_store_source_opens_only_the_files_of_a_box(spark, tmp_path):
    vol = np.random.default_rng(2).integers(0, 300, (8, 8, 8))
    for name in ("a", "b"):
        make_store(tmp_path / name, vol, 2)
    inside = {(1, 2, z) for z in range(4)}
    for name in ("a", "b"):  # every other file is broken, and opening it fails
        for index in np.ndindex(4, 4, 4):
            if name == "b" or index not in inside:
                (tmp_path / name / ".".join(map(str, index))).write_bytes(b"broken")
    store = ST.read_store(spark, str(tmp_path))
    got = store.where("store = 'a' AND z >= 2 AND z < 4 AND y > 3 AND y <= 5 AND value >= 100").toPandas()
    box = vol[2:4, 4:6]
    assert len(got) == (box >= 100).sum() and (got.value.to_numpy() == vol[got.z, got.y, got.x]).all()
    assert store.where("z < 0").count() == 0 and store.where("z = 3 AND z = 4").count() == 0
    with pytest.raises(Exception, match="are not a chunk"):
        store.where("store = 'a'").count()


def test_store_round_trip_and_metadata(spark, tmp_path):
    vol = {v: np.random.default_rng(v).integers(0, 255, (5, 6, 7)) for v in (1, 2)}
    vol[2][:, :, 4:] = 0
    rows = [(v, *map(int, p), int(a[tuple(p)])) for v, a in vol.items() for p in np.argwhere(a > 0)]
    df = spark.createDataFrame(rows, "vol LONG, z INT, y INT, x INT, v INT").repartition(3)
    fields = B.pack_field(df, ["vol"], (5, 6, 7), "v", 4)
    assert ST.write_store(fields, "vol", str(tmp_path)) == 8 + 4
    assert ST.write_store(fields, "vol", str(tmp_path)) == 12  # a repeated write leaves the same files
    assert not list(tmp_path.rglob("*.part"))
    got = ST.read_store(spark, str(tmp_path)).toPandas()
    for v, a in vol.items():
        own = got[got.store == str(v)]
        assert len(own) == a.size and (own.value.to_numpy() == a[own.z, own.y, own.x]).all()
    meta = {r["store"]: r for r in ST.read_array_metadata(spark, str(tmp_path)).collect()}
    assert meta.keys() == {"1", "2"} and meta["1"]["shape"] == [5, 6, 7] and meta["1"]["chunks"] == [4, 4, 4]


def test_guards_fail_the_job(spark):
    two = spark.createDataFrame([("a", b"x"), ("a", b"y")], "patch STRING, content BINARY")
    with pytest.raises(Exception, match="duplicate patch: a"):
        R.require_unique(two, ["patch"], "patch").collect()
    with pytest.raises(Exception, match="digest differs"):
        R.require_digest(two, "content", "00").collect()
    with pytest.raises(Exception, match="fewer than 5 slabs"):
        PT.enough_slabs(spark.createDataFrame([(1, 2.0)], "slab INT, f DOUBLE")).collect()


def test_missing_indices_and_quarantine(spark):
    have = spark.createDataFrame([(i,) for i in (0, 1, 3)], "id LONG")
    assert {r["id"] for r in R.missing_indices(have, "id", 0, 5).collect()} == {2, 4}
    good, bad = R.split_by_integrity(spark.createDataFrame([(1,), (None,), (5,)], "v INT"), F.col("v") < 3)
    assert good.count() == 1 and bad.count() == 2


def test_ranking_sink_has_fixed_columns_and_sidecar(spark, tmp_path):
    df = spark.createDataFrame([(f"p{k:02}", 40 - k, 0.5) for k in range(40)], "patch STRING, rank INT, score DOUBLE").repartition(4)
    skipped = spark.createDataFrame([("q", "few nodes")], "patch STRING, reason STRING")
    R.write_ranking(df, str(tmp_path / "r"), ["rank", "patch"], {"budget": 0.1}, order=["rank"], model={"weights": [1.0]}, skipped=skipped)
    files = [f.read_text().splitlines() for f in sorted((tmp_path / "r" / "ranking").glob("*.csv"))]
    assert all(f[0] == "rank,patch" and len(f) > 1 for f in files)
    assert [line for f in files for line in f[1:]] == [f"{r},p{40 - r:02}" for r in range(1, 41)]
    side = json.loads(next((tmp_path / "r" / "sidecar").glob("*.txt")).read_text())
    assert (side["budget"], side["n_ranked"], side["n_skipped"]) == (0.1, 40, 1)
    assert side["model"]["weights"] == [1.0] and len(side["model"]["sha256"]) == 64


@pytest.mark.parametrize("files", [1, 1000])
def test_batches_never_change_a_score(spark, tmp_path, files):
    """Rows of an entity that come in several files count in full, whatever the size of a batch."""
    src = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame([(e, float(k)) for e in range(5)], "entity LONG, v DOUBLE").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    sums, finish = {"n": F.count("*"), "total": F.sum("v")}, {"n": F.col("n"), "total": F.col("total")}
    stream = lambda: S.file_stream(spark, src, schema, files_per_batch=files)
    got = S.score_new_entities(stream(), "entity", sums, finish, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {tuple(r) for r in got.collect()} == {(e, 4, 6.0) for e in range(5)}
    # a later run reads the new rows alone, and the entities without any keep their score
    spark.createDataFrame([(2, 10.0), (9, 1.0)], "entity LONG, v DOUBLE").coalesce(1).write.mode("append").parquet(src)
    read = []
    kept = stream().groupBy("entity").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    q = kept.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, b: S.write_batch(df, str(tmp_path / "out"), b)).start()
    q.awaitTermination()
    read = [p["numInputRows"] for p in q.recentProgress]
    assert sum(read) == 2
    assert {tuple(r) for r in S.latest(spark, str(tmp_path / "out"), ["entity"]).collect()} == {(e, 4, 6.0) for e in (0, 1, 3, 4)} | {(2, 5, 16.0), (9, 1, 1.0)}


@pytest.mark.parametrize("files", [1, 1000])
def test_running_quantiles_keep_one_histogram_an_entity(spark, tmp_path, files):
    src, rng = str(tmp_path / "in"), np.random.default_rng(5)
    values = {e: rng.random((4, 25)) * 10 for e in ("a", "b")}
    for k in range(4):
        rows = [(e, float(v)) for e in values for v in values[e][k]] + [("c", None)]
        spark.createDataFrame(rows, "entity STRING, v DOUBLE").coalesce(1).write.mode("append").parquet(src)
    S.state_store(spark)
    stream = S.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=files)
    S.run_available(S.running_quantiles(stream, "entity", "v", 0.0, 10.0, 1000, {"median": 0.5}), lambda df, b: S.write_batch(df, str(tmp_path / "out"), b), str(tmp_path / "ck"), "update")
    got = {r["entity"]: (r["n"], r["median"]) for r in S.latest(spark, str(tmp_path / "out"), ["entity"]).collect()}
    assert got["c"] == (0, None)
    for e, v in values.items():
        assert got[e][0] == 100 and abs(got[e][1] - np.sort(v.ravel())[49]) <= 0.005 + 1e-9


def test_stream_queries_read_a_folder_of_part_files(spark, tmp_path):
    from voxelmetry.plans.registry import QUERIES
    from voxelmetry.plans.stream_queries import r2  # noqa: F401 - registers the queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("r1_incremental_scoring", "r2_batch_manifest", "r3_progress_windows"):
        parts, whole = ({tuple(r) for r in QUERIES[name](spark, d).collect()} for d in (str(tmp_path), "/root/testdata/sf0.001"))
        assert parts == whole and whole


def test_feature_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(s, float(s)) for s in range(6)], "slab INT, degree DOUBLE")
    PT.write_features(df, str(tmp_path / "f"))
    assert PT.read_features(spark, str(tmp_path / "f"), ["degree"], [2, 3]).count() == 2
    with pytest.raises(ValueError):
        PT.read_features(spark, str(tmp_path / "f"), ["clustering"])


@pytest.mark.parametrize("size, patch, step", [(100, 192, 0.5), (192, 192, 0.5), (500, 192, 0.5), (641, 128, 0.25)])
def test_window_starts(spark, size, patch, step):
    n = int(np.ceil((size - patch) / (patch * step))) + 1
    want = [0] if size <= patch else [int(round(v)) for v in np.linspace(0, size - patch, n)]
    df = spark.createDataFrame([(size,)], "s INT")
    assert df.select(N.window_starts("s", patch, step)).first()[0] == want
    wins = A.windows(df.select(*[F.col("s").alias(f"n{a}") for a in "zyx"]), patch, step)
    chunks = A.touched_chunks(wins, patch, 128)
    per_axis = sum((w + patch - 1) // 128 - w // 128 + 1 for w in want)
    assert chunks.count() == per_axis**3


def test_record_files_are_few_and_bounded(spark, monkeypatch):
    """A file holds a stretch of PER_FILE numbers, not a hundred, and all rows come back."""
    import os

    from voxelmetry.plans import catalog_queries as Q

    rows = spark.range(25_000).select(F.col("id").alias("no"), F.col("id").cast("string").alias("sample"), F.lit("ok").alias("status"))
    for per_file, n_files in ((10_000, 3), (4_000, 7)):
        monkeypatch.setattr(Q, "PER_FILE", per_file)
        path = Q.written_arrays(rows, "no", "records")
        assert len([f for f in os.listdir(path) if f.endswith(".txt")]) == n_files
        back = R.read_records(spark, path, glob="*.txt")
        assert sorted(int(r.sample) for r in back.select("sample").collect()) == list(range(25_000))


def test_chunk_touches_are_those_of_all_windows_and_windows_are_no_rows(spark, monkeypatch):
    """Counts by axes equal those of windows as rows, for repeated, small and unsized volumes; no task holds many chunks."""
    rows = [(0, 700, 192, 256), (0, 300, 100, 641), (1, 0, 192, 193), (2, None, 192, 192), (3, 1000, 500, 384), (3, 1000, 500, 384)]
    volumes = spark.createDataFrame(rows, "v INT, nz INT, ny INT, nx INT")
    counted = lambda df: sorted(map(tuple, df.select("v", "cz", "cy", "cx", "n").collect()))
    for step in (0.5, 2.0):  # windows two apart pass chunks over
        plain = A.touched_chunks(A.windows(volumes, 192, step), 192, 128).groupBy("v", "cz", "cy", "cx").agg(F.count("*").alias("n"))
        got = A.chunk_touches(volumes, ["v"], 192, step, 128)
        assert counted(got) == counted(plain)
    assert A.chunk_touches(volumes.where("false"), ["v"], 192, 0.5, 128).count() == 0
    by_row = A.read_amplification(A.touched_chunks(A.windows(volumes, 192, 0.5), 192, 128), ["cz", "cy", "cx"], ["v"])
    by_sum = A.read_amplification(A.chunk_touches(volumes, ["v"], 192, 0.5, 128), ["cz", "cy", "cx"], ["v"], "n")
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, by_sum.collect()))
    # tasks follow the number of chunks, not the bytes of the volumes
    monkeypatch.setattr(A, "PER_TASK", 2)
    assert A.chunk_touches(volumes, ["v"], 192, 0.5, 128).rdd.getNumPartitions() >= 50


def test_morton_orders_by_interleaved_bits(spark):
    pts = [(z, y, x) for z in range(4) for y in range(4) for x in range(4)] + [(2**21 - 1, 5, 0)]
    got = spark.createDataFrame(pts, "z INT, y INT, x INT").select("z", "y", "x", N.morton("z", "y", "x").alias("m")).collect()
    for r in got:
        want = 0
        for b in range(21):
            want |= ((r["z"] >> b) & 1) << (3 * b + 2) | ((r["y"] >> b) & 1) << (3 * b + 1) | ((r["x"] >> b) & 1) << (3 * b)
        assert r["m"] == want


def test_names_that_do_not_follow_the_pattern(spark):
    df = spark.createDataFrame([("202301-surface-202401-wide-2um-ps256-L0-th0.2.zarr",), ("x.zarr",)], "name STRING")
    a, b = [r["a"] for r in df.select(N.parse_prediction("name").alias("a")).collect()]
    assert (a["model"], a["level"], a["threshold"]) == ("wide-2um-ps256", 0, 0.2) and b is None


def test_split_is_disjoint_and_seeded(spark):
    ids = spark.range(200).withColumn("t", F.col("id") < 30)
    one = P.seeded_split(ids, "id", F.col("t"), 20, seed=1)
    assert {r["part"]: r["count"] for r in one.groupBy("part").count().collect()} == {"test": 30, "val": 20, "train": 150}
    two = P.seeded_split(ids.repartition(5), "id", F.col("t"), 20, seed=1)
    assert one.exceptAll(two.select(one.columns)).isEmpty()


def test_greedy_picks_keep_their_distance(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": 0, "s": rng.random(300), **{a: rng.integers(0, 30, 300) for a in "zyx"}})
    picks = P.greedy_spaced(spark.createDataFrame(pdf), ["g"], [F.col("s")], ["z", "y", "x"], gap=8, rounds=4).toPandas()
    at = picks[["pick_z", "pick_y", "pick_x"]].to_numpy()
    assert len(at) == 4
    assert all(np.abs(at[i] - at[j]).max() >= 8 for i in range(4) for j in range(i))


def test_gates_treat_missing_values_as_failed(spark):
    df = spark.createDataFrame([(2.0, None)], "a DOUBLE, b DOUBLE")
    r = I.gate_table(df, [("a", ">=", 1.5), ("b", "<=", 1.0)]).first()
    assert (r["gate_1"], r["gate_2"], r["passed"]) == (True, False, False)


def write_events(spark, folder, start, n):
    spark.range(start, start + n).select(
        F.col("id").alias("entity"), (F.col("id") % 10 / 10).alias("recall"), F.timestamp_seconds(1700000000 + F.col("id")).alias("ts"), F.lit("ok").alias("status")
    ).coalesce(1).write.mode("append").parquet(folder)


def test_resume_scores_each_entity_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    score = lambda: S.score_new_entities(S.file_stream(spark, src, schema), "entity", {"best": F.max("recall")}, {"recall": F.col("best")}, out, ck)
    write_events(spark, src, 0, 20)
    schema = spark.read.parquet(src).schema
    assert score().count() == 20
    write_events(spark, src, 10, 20)  # ten known entities, ten new ones
    assert score().count() == 30
    assert score().count() == 30


def test_running_summary_over_several_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    write_events(spark, src, 0, 15)
    write_events(spark, src, 15, 15)
    stream = S.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
    S.run_available(S.running_summary(stream, ["status"], "recall"), lambda df, b: S.write_batch(df, out, b), ck, "update")
    assert S.latest(spark, out, ["status"]).first()["n"] == 30


def test_progress_and_duplicates(spark, tmp_path):
    src = str(tmp_path / "in")
    write_events(spark, src, 0, 12)
    write_events(spark, src, 0, 12)
    schema = spark.read.parquet(src).schema
    out = str(tmp_path / "p")
    S.run_available(S.progress(S.file_stream(spark, src, schema), "ts", "recall"), lambda df, b: S.write_batch(df, out, b), str(tmp_path / "c1"), "update")
    got = S.latest(spark, out, ["start"]).orderBy("start").collect()
    assert [r["n"] for r in got] == [10, 10, 4] and got[0]["low"] == 0.0
    out = str(tmp_path / "d")
    firsts = S.first_occurrences(S.file_stream(spark, src, schema), "ts", F.sha2(F.col("entity").cast("string"), 256), "1 hour")
    S.run_available(firsts, lambda df, b: S.write_batch(df, out, b), str(tmp_path / "c2"))
    assert spark.read.parquet(out).count() == 12


def test_many_small_stores_share_the_partitions_of_a_scan(spark, tmp_path, monkeypatch):
    vol = np.arange(8).reshape(2, 2, 2)
    for k in range(60):
        make_store(tmp_path / str(k), vol + k, 2)
    store = ST.read_store(spark, str(tmp_path))
    got = store.where("z = 1").toPandas()
    assert len(got) == 240 and (got.value.to_numpy() == vol[got.z, got.y, got.x] + got.store.astype(int)).all()
    assert store.rdd.getNumPartitions() <= 4  # 60 chunks, 16 to a partition
    reader = ST.StoreReader({"path": str(tmp_path), "run": "1"})
    monkeypatch.setattr(ST, "PARTITIONS", 7)
    parts = reader.partitions()
    assert len(parts) <= 7 and sorted((r.store, r.start) for p in parts for r in p.runs) == sorted((str(k), 0) for k in range(60))
