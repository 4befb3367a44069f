"""Matches, masks, references, normals and status against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import association, metrics, references, runs, updates
from plumbline.sources import status


def greedy(truth, found, bound, offset):
    pairs = sorted((abs(t - f - offset), t, f + offset) for t in set(truth) for f in set(found) if abs(t - f - offset) <= bound)
    out, ts, fs = [], set(), set()
    for _, t, f in pairs:
        if t not in ts and f not in fs:
            out.append((t, f - offset))
            ts.add(t)
            fs.add(f)
    return out


@pytest.mark.parametrize(("bound", "offset"), [(0, 0), (4, 0), (7, -3)])
def test_matches_one_to_one(spark, bound, offset):
    rng = random.Random(bound)
    own = {k: ([rng.randrange(60) for _ in range(25)], [rng.randrange(60) for _ in range(30)]) for k in range(3)}
    own[3] = ([10, 13, 16, 19, 22], [12, 15, 18, 21, 24])  # each contest hangs on the next
    own[4] = ([-5, 5], [0])
    side = lambda i: spark.createDataFrame([(k, t) for k, v in own.items() for t in v[i]] + [(None, 1), (0, None)], "k int, ts long")
    got = sorted(map(tuple, association.matched(side(0), side(1), ["k"], "ts", bound, offset).collect()))
    assert got == sorted((k, t, f) for k, v in own.items() for t, f in greedy(*v, bound, offset))
    assert association.matched(side(0).limit(0), side(1), ["k"], "ts", bound).count() == 0


def run_lengths(mask):
    flat = mask.ravel(order="F").tolist()
    out, was = [0], False
    for p in flat:
        if p != was:
            out.append(0)
            was = p
        out[-1] += 1
    return out if flat else []


def masks():
    rng = np.random.default_rng(8)
    own = [(rng.random((13, 9)) < share, k) for k, share in enumerate((0.5, 0.5, 0.1, 0.9, 0.0, 1.0)) for _ in range(3)]
    return own + [(np.ones((13, 9), bool), 6), (np.zeros((13, 9), bool), 7)]


def test_masks_as_runs(spark):
    own = masks()
    df = spark.createDataFrame([(i, k, m.tolist()) for i, (m, k) in enumerate(own)], "i int, k int, rows array<array<boolean>>")
    made = df.select("i", "k", "rows", runs.encode(runs.by_columns(F.col("rows"))).alias("runs"))
    made = made.select("*", runs.area(F.col("runs")).alias("area"), runs.by_rows(runs.decode(F.col("runs")), 13).alias("back"))
    for r in made.collect():
        assert r.runs == run_lengths(own[r.i][0]) and r.area == own[r.i][0].sum() and r.back == r["rows"]
    for least in (1, 2, None):
        got = {r.k: (r.runs, r.n) for r in runs.combined(made, ["k"], "runs", least).collect()}
        for key in range(8):
            stack = np.array([m for m, k in own if k == key])
            assert got[key] == (run_lengths(stack.sum(axis=0) >= (len(stack) if least is None else least)), len(stack))


def test_odd_masks(spark):
    df = spark.createDataFrame([(0, []), (1, [None, True]), (2, [False]), (3, [True])], "k int, p array<boolean>")
    assert [r[0] for r in df.orderBy("k").select(runs.encode(F.col("p"))).collect()] == [[], [1, 1], [1], [0, 1]]
    other = spark.createDataFrame([(0, [3]), (0, [1, 3]), (1, None), (1, [0, 2])], "k int, runs array<int>")
    assert [tuple(r) for r in runs.combined(other.where("k = 1"), ["k"], "runs").collect()] == [(1, [0, 2], 1)]
    with pytest.raises(Exception, match='different sizes under the key .*"k":0'):
        runs.combined(other, ["k"], "runs").collect()
    assert runs.combined(other.limit(0), ["k"], "runs").count() == 0


def test_unknown_keys_are_named(spark):
    q = spark.createDataFrame([("a", 5), ("b", 6)], "stream string, ts long")
    t = spark.createDataFrame([("a", 4, 1), ("c", 1, 2)], "stream string, ts long, v int")
    lazy = references.strict_asof(q, t, ["stream"])
    with pytest.raises(Exception, match='stream is not available: no .*"stream":"b"'):
        lazy.collect()
    both = t.unionByName(t.where("v = 2").withColumn("stream", F.lit("b")))
    assert sorted((r.stream, r.match.v) for r in references.strict_asof(q, both, ["stream"], mode="before").collect()) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, references.known_only(q, q.unionByName(q), ["stream"], "x").collect())) == [("a", 5), ("b", 6)]
    with pytest.raises(Exception, match='no .*"stream":null'):
        references.known_only(spark.createDataFrame([(None, 1)], "stream string, ts long"), q, ["stream"], "x").collect()


def test_lookup_keeps_nulls_of_rows_that_are_there(spark):
    q = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    t = spark.createDataFrame([("a", None)], "k string, v int")
    assert sorted(map(tuple, references.looked_up(q, t, ["k"], v=F.lit(0)).collect()), key=str) == [("a", None), ("b", 0), (None, 0)]


def test_normals_of_shared_vertices(spark):
    rng = np.random.default_rng(0)
    points, faces = rng.normal(size=(6, 3)), np.array([(0, 1, 2), (0, 2, 3), (0, 3, 4), (4, 0, 5), (2, 2, 1)])
    rows = [(1, n, *map(int, f), *(points[v].tolist() for v in f)) for n, f in enumerate(faces)]
    df = spark.createDataFrame(rows, "mesh int, face int, i int, j int, k int, a array<double>, b array<double>, c array<double>")

    def scaled(v):
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-5)

    tris = points[faces]
    n = scaled(np.cross(tris[:, 1] - tris[:, 0], tris[:, 2] - tris[:, 0]))
    whole, last = np.zeros((6, 3)), np.zeros((6, 3))
    for corner in range(3):
        np.add.at(whole, faces[:, corner], n)
        last[faces[:, corner]] += n
    for want, option in ((whole, None), (last, "face")):
        got = {r.vertex: r.normal for r in updates.vertex_normals(df, "mesh", option).collect()}
        assert set(got) == set(range(6)) and all(np.allclose(got[v], scaled(want)[v]) for v in range(6))


def test_lines_of_a_report(spark):
    df = spark.createDataFrame([("s1", 1.0), ("s1", 2.0), ("s2", 6.0), (None, 7.0)], "s string, w double")
    got = {r.line for r in metrics.report_lines(df, "s", ["w"], "All").collect()}
    assert got == {"s1 1.5000", "s2 6.0000", "7.0000", "All W, 4.00"}


def test_status_is_whole_or_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/status"
    read = lambda *g: dict(map(tuple, status.read_status(spark, path, list(g)).collect()))
    assert read("a", "b") == {"a": False, "b": False}
    status.set_done(spark, path, ["a", "b"], "b")
    assert read("a", "b") == {"a": False, "b": True} and read("a") == {"a": False, "b": True}
    assert read("a", "b", "c") == {"a": False, "b": False, "c": False}
    half = tmp_path / "status" / "version=000000002"
    half.mkdir()
    (half / "part-0.json").write_text('{"data_group": "a", "done": true}\n')
    assert read("a", "b") == {"a": False, "b": True}
    status.set_done(spark, path, ["a", "b"], "a")
    assert read("a", "b") == {"a": True, "b": True}
    with pytest.raises(ValueError, match="not supported"):
        status.set_done(spark, path, ["a"], "z")
    files = spark.createDataFrame([("x", "a"), ("y", "d")], "filename string, data_type string")
    assert [r.filename for r in status.sequences_to_fetch(files, status.read_status(spark, path, ["a", "b"])).collect()] == ["y"]


def test_places_over_ranges(spark):
    rng = random.Random(1)
    values = [rng.randrange(10_000) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert [r.v for r in updates.placed(df, F.desc("v")).orderBy("place").collect()] == sorted(values, reverse=True)
    assert sorted(r.place for r in updates.placed(df, "v").collect()) == list(range(1, 3001))
    assert updates.placed(df.limit(0), "v").count() == 0


def test_clips_for_repeated_and_missing_times(spark):
    from plumbline.operators import asof

    q = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("a", None, 2), ("b", 5, 3), (None, 5, 4)], "k string, t long, x int")
    clips = spark.createDataFrame([("a", 0, 10, 2), ("a", 3, 6, 1), ("a", 5, 5, 0), ("b", 6, 9, 0)], "k string, s long, e long, o int")
    got = sorted(((r.k, r.t, r.x, r.clip and r.clip.o) for r in asof.interval_join(q, clips, "t", "s", "e", "o", 4, ["k"]).collect()), key=str)
    assert got == sorted([("a", 5, 1, 1), ("a", 5, 1, 1), ("a", None, 2, None), ("b", 5, 3, None), (None, 5, 4, None)], key=str)


def test_hooks_see_padded_windows_in_order(spark):
    from plumbline.operators import hooks

    seen = spark.createDataFrame([(k, t) for k, n in (("a", 37), ("b", 3)) for t in range(n)], "k string, t long")
    made = hooks.in_windows(seen, ["k"], "t", lambda w: w.assign(first=w["t"].iloc[0], n=len(w))[["k", "t", "first", "n"]], "k string, t long, first long, n long", length=8, together=2)
    got = sorted(map(tuple, made.collect()))
    assert got == sorted((k, t, t // 8 * 8, 8) for k, n in (("a", 37), ("b", 3)) for t in range(n))
