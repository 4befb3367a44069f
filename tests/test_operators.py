from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import rotation as R
from plumbline.operators import alignment, asof, fill, hooks, masks, records, segments
from plumbline.sources import tracks


def lookup(spark, times, queries, **options):
    t = spark.createDataFrame([("a", x, f"v{x}") for x in times], "k string, ts long, v string")
    q = spark.createDataFrame([("a", x) for x in queries], "k string, ts long")
    return {r.ts: (r.match.ts if r.match else None, r.delta) for r in asof.asof_join(q, t, ["k"], **options).collect()}


@pytest.mark.parametrize("bucket", [None, 7])
def test_asof_ties_edges_and_tolerance(spark, bucket):
    times, queries = [10, 20, 40], [5, 10, 15, 30, 31, 50]
    assert lookup(spark, times, queries, bucket=bucket) == {5: (10, -5), 10: (10, 0), 15: (10, 5), 30: (20, 10), 31: (40, -9), 50: (40, 10)}
    assert lookup(spark, times, queries, mode="before", bucket=bucket) == {5: (None, None), 10: (10, 0), 15: (10, 5), 30: (20, 10), 31: (20, 11), 50: (40, 10)}
    assert lookup(spark, times, queries, mode="after", bucket=bucket)[50] == (None, None)
    assert lookup(spark, times, queries, tolerance=5, bucket=bucket) == {5: (10, -5), 10: (10, 0), 15: (10, 5), 30: (None, None), 31: (None, None), 50: (None, None)}
    assert lookup(spark, times, queries, tolerance=0) == {q: (q, 0) if q == 10 else (None, None) for q in queries}
    with pytest.raises(ValueError):
        lookup(spark, times, queries, mode="nearest")


def test_bracket_takes_an_exact_match_as_upper(spark):
    t = spark.createDataFrame([("a", 10), ("a", 20)], "k string, ts long")
    q = spark.createDataFrame([("a", 5), ("a", 10), ("a", 15), ("a", 20), ("a", 25)], "k string, ts long")
    got = {r.ts: (r.lower.ts if r.lower else None, r.upper.ts if r.upper else None, r.alpha) for r in asof.bracket(q, t, ["k"]).collect()}
    assert got == {5: (None, 10, None), 10: (None, 10, None), 15: (10, 20, 0.5), 20: (10, 20, 1.0), 25: (20, None, None)}


def test_repeated_frames_split_islands(spark):
    d = spark.createDataFrame([("a", f) for f in (1, 2, 2, 3, 7)], "k string, frame long")
    assert sorted((r.start, r.end, r.n) for r in segments.islands(d, ["k"]).collect()) == [(1, 2, 2), (2, 3, 2), (7, 7, 1)]


def test_vote_tie_is_right(spark):
    d = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "k string, right boolean")
    assert {r.k: r.hand for r in segments.vote(d, ["k"], F.col("right"), F.lit(True)).collect()} == {"a": 1, "b": 0}


def test_masks_raise_on_keys_that_differ(spark):
    a = spark.createDataFrame([("s", "1", True), ("s", "2", False)], "stream string, ts string, mask boolean")
    assert {r.ts: r.mask for r in masks.combine([a, a], ["stream", "ts"], "or").collect()} == {"1": True, "2": False}
    with pytest.raises(Exception, match="differ"):
        masks.combine([a, a.where("ts = '1'")], ["stream", "ts"]).collect()
    with pytest.raises(ValueError):
        masks.combine([], ["ts"])


def test_fill_needs_two_points_and_clamps(spark):
    rows = [("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, None), ("b", 0, 5.0), ("b", 1, None)]
    d = spark.createDataFrame(rows, "k string, i long, v double")
    assert [r.v for r in fill.fill_linear(d, ["k"], "i", "v").orderBy("k", "i").collect()] == [2.0, 2.0, 4.0, 6.0, 6.0, 5.0, None]
    q = spark.createDataFrame([("a", 0, [1.0, 0.0, 0.0, 0.0]), ("a", 1, None), ("a", 2, [0.0, 1.0, 0.0, 0.0])], "k string, i long, q array<double>")
    half = fill.fill_rotations(q, ["k"], "i", "q").where("i = 1").first().q
    assert np.allclose(half, [np.sqrt(0.5), np.sqrt(0.5), 0, 0])


def test_rotations_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(v.tolist(),) for v in rng.normal(size=(40, 3))] + [([0.0, 0.0, 0.0],), ([np.pi, 0.0, 0.0],)]
    d = spark.createDataFrame(rows, "v array<double>")
    for r in d.select("v", R.matrix_from_axis_angle(F.col("v")).alias("m"), R.axis_angle_from_matrix(R.matrix_from_axis_angle(F.col("v"))).alias("b")).collect():
        a = np.linalg.norm(r.v)
        k = np.array(r.v) / a if a else np.zeros(3)
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        want = np.eye(3) + np.sin(a) * cross + (1 - np.cos(a)) * cross @ cross
        assert np.allclose(r.m, want, atol=1e-12)
        assert np.allclose(np.abs(r.b) if a == np.pi else r.b, r.v if a <= np.pi else k * (a - 2 * np.pi), atol=1e-7)


def test_similarity_is_found_from_sums(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    y = 2.5 * x @ turn.T + [1, 2, 3]
    d = spark.createDataFrame([("a", p.tolist(), q.tolist()) for p, q in zip(x, y)], "k string, x array<double>, y array<double>")
    r = alignment.fit(alignment.sums(d, ["k"], "x", "y"), ["k"]).first()
    assert np.allclose([r.scale], 2.5) and np.allclose(r.r, turn) and np.allclose(r.t, [1, 2, 3])
    moved = alignment.align(d, ["k"], "x", "y").collect()
    assert np.allclose([m.aligned for m in moved], [m.y for m in moved])


def test_frechet_of_equal_and_moved(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    rows = [(0, v.tolist()) for v in x] + [(1, (v + [3, 0, 4]).tolist()) for v in x]
    m = {r.k: (r.n, r.m) for r in alignment.gaussian_sums(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 3).collect()}
    assert abs(alignment.frechet(m[0], m[0], 3)) < 1e-9 and abs(alignment.frechet(m[0], m[1], 3) - 25) < 1e-9


def test_hooks_pad_and_cut(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, i long, v double")
    seen = hooks.in_windows(d, ["k"], "i", lambda w: w.assign(v=len(w) + w.v.iloc[-1]), "k string, i long, v double", 3)
    assert {r.i: r.v for r in seen.collect()} == {0: 5.0, 1: 5.0, 2: 5.0, 3: 7.0, 4: 7.0}
    mask = np.random.default_rng(4).random((5, 7)) > 0.5
    assert (hooks.decode_rle(hooks.encode_rle(mask), 5, 7) == mask).all()


def test_wrap(spark):
    text = spark.createDataFrame([("aa bb cc dddddddd e",)], "t string")
    assert text.select(records.wrap(F.col("t"), 5)).first()[0] == ["aa bb", "cc", "dddddddd", "e"]


def test_box_files(spark, tmp_path):
    head = "stream_id,hand_index,timestamp[ns],x_min[pixel],x_max[pixel],y_min[pixel],y_max[pixel],visibility_ratio[%]\n"
    (tmp_path / "b.csv").write_text(head + "214-1,0,56773008264542,1,2,3,4,0.5\n214-1,0,56773008264542,5,6,7,8,1.0\n214-1,1,56773008264542,,,,,\n")
    got = {r.hand_index: r for r in tracks.hand_boxes(spark, str(tmp_path / "b.csv")).collect()}
    assert tuple(got[0].box) == (5.0, 7.0, 6.0, 8.0) and got[0].ts_ns == 56773008264542 and got[1].box is None and got[1].visibility is None
    assert tracks.hand_boxes(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(ValueError, match="not expected"):
        tracks.object_boxes(spark, str(tmp_path / "b.csv"))


def test_pose_mask_and_json_files(spark, tmp_path):
    head = "q_wo_w,object_uid,timestamp[ns],t_wo_x[m],t_wo_y[m],t_wo_z[m],q_wo_x,q_wo_y,q_wo_z\n"
    (tmp_path / "p.csv").write_text(head + "1,7,10,1,2,3,0,0,0\n1,8,10,4,5,6,0,0,0\n1,7,10,9,9,9,0,0,0\n")
    got = {r.object_uid: r.pose for r in tracks.object_poses(spark, str(tmp_path / "p.csv")).collect()}
    assert got["7"].t == [9.0, 9.0, 9.0] and got["8"].q == [1.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="other than one id"):
        tracks.headset_poses(spark, str(tmp_path / "p.csv")).collect()
    (tmp_path / "m.csv").write_text("timestamp[ns],stream_id,mask\n1,s,True\n2,s,true\n3,s,False\n")
    assert {r.ts: r.mask for r in tracks.mask_series(spark, str(tmp_path / "m.csv")).collect()} == {"1": True, "2": False, "3": False}
    hand = lambda t, b=None: {"wrist_xform": {"q_wxyz": [1, 0, 0, 0], "t_xyz": t}, "pose": [0.5], **({"betas": b} if b else {})}
    lines = [{"timestamp_ns": 1, "hand_poses": {}}, {"timestamp_ns": 2, "hand_poses": {"0": hand([1, 1, 1]), "1": hand([2, 2, 2], [7])}}, {"timestamp_ns": 2, "hand_poses": {"1": hand([3, 3, 3], [8])}}]
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {(r.ts_ns, r.hand): r.wrist.t for r in tracks.hand_poses(spark, str(tmp_path / "h.jsonl")).collect()}
    assert got == {(2, 0): [1.0, 1.0, 1.0], (2, 1): [3.0, 3.0, 3.0]}
    assert tracks.hand_shape(spark, str(tmp_path / "h.jsonl")).first().betas == [7.0]


def test_other_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"1": {"instance_name": "cup", "instance_type": "object", "motion_type": "dynamic"}, "2": {"instance_name": "head", "instance_type": "headset"}}))
    assert [r.name for r in tracks.dynamic_objects(tracks.object_library(spark, str(tmp_path / "i.json"))).collect()] == ["cup"]
    (tmp_path / "c.json").write_text(json.dumps([{"label": "l", "projectionParams": [1, 2, 3, 4]}]))
    assert tracks.camera_models(spark, str(tmp_path / "c.json")).first().projection == [1.0, 3.0, 4.0]
    (tmp_path / "s.txt").write_text("a 5 x\nb\n\nc  7\n")
    assert [r.frame for r in tracks.segment_lines(spark, str(tmp_path / "s.txt")).orderBy("line").collect()] == [5, 7]
    (tmp_path / "t.txt").write_text("1 2 3 0 0 0 1\n")
    assert tracks.trajectory(spark, str(tmp_path / "t.txt")).first()[1:] == ([1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0])
    (tmp_path / "cam/left").mkdir(parents=True)
    (tmp_path / "cam/left/10_11.json").write_text(json.dumps({"init_trans": [[[1, 1, 1], [2, 2, 2]]], "init_betas": [[[9]]]}))
    assert sorted((r.hand, r.frame, r.trans, r.betas) for r in tracks.chunk_predictions(spark, str(tmp_path / "cam")).collect()) == [("left", 10, [1.0, 1.0, 1.0], [9.0]), ("left", 11, [2.0, 2.0, 2.0], [9.0])]
    assert tracks.focal_length(None, spark, str(tmp_path / "none")) == 600.0
    made = []
    for _ in range(2):
        tracks.resume(spark, str(tmp_path / "out"), lambda: made.append(1) or spark.range(3))
    assert len(made) == 1
