"""Paths of recordings, box fill and weighted fits against plain Python."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import rigid
from plumbline.operators import alignment, fill, records
from plumbline.plans import alignment as plans
from plumbline.sources import recordings


def test_recordings_are_whole_or_name_what_they_lack(spark, tmp_path):
    def make(name, headset, kinds):
        folder = tmp_path / "root" / name
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(json.dumps({"headset": headset, "other": 1}, indent=1))
        for k in kinds:
            (folder / recordings.FILES[k]).write_text("x")

    make("P1", "Aria", recordings.NEEDED["Aria"])
    make("P2", "Quest3", recordings.NEEDED["Aria"])
    make("P3", "Aria", ["recording"])
    (tmp_path / "root" / "P1" / "mps").mkdir()
    (tmp_path / "root" / "P1" / "mps" / "part.csv").write_text("1")
    files = recordings.recording_files(spark, f"file://{tmp_path}/root/")
    rows = {(r.recording, r.kind): r for r in files.collect()}
    assert len(rows) == 8 * 3
    assert rows["P1", "mps"].present and not rows["P3", "mps"].present and rows["P1", "metadata"].present and not rows["P1", "metadata"].required
    assert rows["P2", "camera_models"].path == f"file://{tmp_path}/root/P2/camera_models.json" and ("P1", "camera_models") not in rows
    assert sorted((r.recording, r.valid, r.missing) for r in recordings.validity(files).collect()) == [
        ("P1", True, []), ("P2", False, ["camera_models"]), ("P3", False, ["dynamic_objects", "headset_trajectory", "mano_hand_poses"])]
    make("P4", "Glass", [])
    with pytest.raises(Exception, match="P4: headset Glass is not supported"):
        recordings.recording_files(spark, f"file://{tmp_path}/root").collect()


def test_boxes_at_the_ends_are_extrapolated(spark):
    boxes = {0: [0, 0], 1: [0, 0], 2: [1, 10], 3: [0, 0], 4: [3, 14], 7: [9, 20], 9: [0, 0]}
    one = {0: [0, 0], 1: [5, 5], 2: [0, 0]}
    df = spark.createDataFrame([(k, t, list(map(float, b))) for k, own in (("a", boxes), ("b", one)) for t, b in own.items()] + [("c", 0, None)], "k string, t long, box array<double>")
    got = {(r.k, r.t): r.box for r in fill.fill_boxes(df, ["k"], "t", "box").collect()}
    assert [got["a", t] for t in boxes] == [[-1, 6], [0, 8], [1, 10], [2, 12], [3, 14], [9, 20], [13, 24]]
    assert [got["b", t] for t in one] == [[0, 0], [5, 5], [0, 0]] and got["c", 0] is None


def similarity(x, y, w=None, scaled=True):
    w = np.ones(len(x)) if w is None else w
    mx, my = (w[:, None] * x).sum(0) / w.sum(), (w[:, None] * y).sum(0) / w.sum()
    x0, y0 = x - mx, y - my
    u, d, vt = np.linalg.svd((w[:, None] * y0).T @ x0 / w.sum())
    s = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    r = u @ s @ vt
    c = (d * np.diag(s)).sum() / ((w[:, None] * x0 * x0).sum() / w.sum()) if scaled else 1.0
    return c, r, my - c * r @ mx


def test_weights_of_a_fit(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(40, 3)), (rng.random(40) < 0.6).astype(float)
    y = 2 * x @ np.linalg.qr(rng.normal(size=(3, 3)))[0].T + rng.normal(size=(40, 3)) * (0.01 + 5 * (w == 0)[:, None])
    df = spark.createDataFrame([(1, a.tolist(), b.tolist(), float(v)) for a, b, v in zip(x, y, w, strict=True)], "k int, x array<double>, y array<double>, w double")
    got = alignment.fit(alignment.sums(df, ["k"], "x", "y", F.col("w")), ["k"]).first()
    c, r, t = similarity(x, y, w)
    assert np.allclose(got.scale, c) and np.allclose(got.r, r) and np.allclose(got.t, t)


def test_alignment_queries_on_their_tables(spark, sf_dir):
    rows = plans.tracks(spark, sf_dir).orderBy("label", "vec_id").collect()
    own = {k: [r for r in rows if r.label == k] for k in {r.label for r in rows}}
    points = {k: (np.array([r.x for r in v]), np.array([r.y for r in v])) for k, v in own.items()}
    for query, scaled in ((plans.rigid_align, False), (plans.similarity_align, True)):
        for r in query(spark, sf_dir).collect():
            c, turn, t = similarity(*points[r.label], scaled=scaled)
            assert abs(r.scale - c) < 1e-5 and np.allclose(r.r, turn.ravel(), atol=1e-5) and np.allclose(r.t, t, atol=1e-5)
    errors = {}
    for k, (x, y) in points.items():
        c, turn, t = similarity(x, y)
        errors[k] = np.linalg.norm(c * x @ turn.T + t - y, axis=1)
    for r in plans.ate_stats(spark, sf_dir).collect():
        e = errors[r.label]
        assert np.allclose([r.rmse, r["mean"], r.median, r.std, r["min"], r["max"]], [np.sqrt((e * e).mean()), e.mean(), np.median(e), e.std(), e.min(), e.max()], atol=1e-5)
    for r in plans.rte(spark, sf_dir).collect():
        x, y = points[r.label]
        c, turn, t = similarity(x, y, scaled=False)
        at = [v.vec_id for v in own[r.label]].index(r.vec_id)
        assert abs(r.rte - np.linalg.norm(x[at] @ turn.T + t - y[at]) / np.linalg.norm(np.diff(y, axis=0), axis=1).sum()) < 1e-5
    for r in plans.first_two_frames_align(spark, sf_dir).where("label = 3").collect():
        x, y = points[3]
        c, turn, t = similarity(x[:2], y[:2])
        at = [v.vec_id for v in own[3]].index(r.vec_id)
        # two points leave the turn about their line open; what they share is the scale and their own places
        if at < 2:
            assert np.allclose(r.aligned, c * turn @ x[at] + t, atol=1e-4)


def test_wrapped_lines(spark):
    texts = ["", None, "aaa bb c", "a" * 9 + " b", " x\ty z \n w ", "ab cd ef gh"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(records.wrap(F.col("t"), 5)).collect()]
    assert got == [[], [], ["aaa", "bb c"], ["a" * 9, "b"], ["x y z", "w"], ["ab cd", "ef gh"]]


def test_camera_chain_is_a_matrix_product(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(4, 4)), rng.normal(size=(4, 4))
    a[3] = b[3] = [0, 0, 0, 1]
    turn = np.eye(4)
    turn[:3, :3] = rigid.QUARTER
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<array<double>>")
    got = df.select(rigid.camera_in_world(F.col("a"), F.col("b")).alias("p")).first().p
    want = a @ b @ turn
    assert np.allclose(got.r, want[:3, :3]) and np.allclose(got.t, want[:3, 3])
