"""Record files written by the test: both shape forms, natural order, corrupt files."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import records


def chunk(folder, track, start, n, shape, betas):
    rng = np.random.default_rng(start)
    record = {
        "init_root_orient": rng.normal(size=(*shape(n), 3, 3)), "init_hand_pose": rng.normal(size=(*shape(n), 15, 3, 3)),
        "init_trans": rng.normal(size=(*shape(n), 3)), "init_betas": rng.normal(size=betas(n)),
    }
    place = folder / str(track)
    place.mkdir(exist_ok=True)
    (place / f"{start}_{start + n}.json").write_text(json.dumps({k: v.tolist() for k, v in record.items()}))
    return record


def test_chunk_forms(spark, tmp_path):
    records.register(spark)
    forms = {
        (0, 2): (3, lambda n: (1, n), lambda n: (1, n, 10)), (0, 10): (4, lambda n: (n,), lambda n: (10,)), (0, 100): (1, lambda n: (1, 1), lambda n: (1, 10)), (1, 5): (1, lambda n: (), lambda n: (10,)),
    }
    made = {key: chunk(tmp_path, *key, *form) for key, form in forms.items()}
    df = spark.read.format("hand_chunks").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == len(forms)
    got = {(int(r.track), r.frame): r for r in df.collect()}
    assert len(got) == 9
    for (track, start), record in made.items():
        n = forms[track, start][0]
        for i in range(n):
            row = got[track, start + i]
            assert (row.start, row.end) == (start, start + n)
            assert np.allclose(row.root_orient, record["init_root_orient"].reshape(-1, 3, 3)[i]) and np.allclose(row.hand_pose, record["init_hand_pose"].reshape(-1, 15, 3, 3)[i])
            betas = record["init_betas"].reshape(-1, 10)
            assert np.allclose(row.trans, record["init_trans"].reshape(-1, 3)[i]) and np.allclose(row.betas, betas[i if len(betas) > 1 else 0])
    assert [p.rpartition("/")[2] for p in records.listed(str(tmp_path), ".json")] == ["2_5.json", "10_14.json", "100_101.json", "5_6.json"]


def test_corrupt_files_are_named_or_skipped(spark, tmp_path):
    records.register(spark)
    chunk(tmp_path, 0, 7, 2, lambda n: (1, n), lambda n: (10,))
    (tmp_path / "0" / "9_11.json").write_text('{"init_trans": [')
    short = chunk(tmp_path, 1, 3, 2, lambda n: (n,), lambda n: (10,))
    short["init_trans"] = short["init_trans"][:1]
    (tmp_path / "1" / "3_5.json").write_text(json.dumps({k: np.asarray(v).tolist() for k, v in short.items()}))
    (tmp_path / "1" / "notes.json").write_text("{}")
    read = spark.read.format("hand_chunks")
    for bad, why in (("0", "9_11.json can't be read"), ("1", "2 orientations, 2 poses, 1 places|has to be")):
        with pytest.raises(Exception, match=why):
            read.load(f"{tmp_path}/{bad}").collect()
    assert sorted(r.frame for r in read.option("corrupt", "skip").load(str(tmp_path)).collect()) == [7, 8]
    with pytest.raises(Exception, match="no_such"):
        read.load(f"{tmp_path}/no_such").collect()


def test_trajectories(spark, tmp_path):
    records.register(spark)
    poses = np.arange(21.0).reshape(3, 7)
    np.savez(tmp_path / "a.npz", traj=poses, scale=2.5, other=np.zeros(2))
    np.savez(tmp_path / "b.npz", traj=poses[:1].astype("f4"), scale=np.array([3.0]))
    np.savez(tmp_path / "empty.npz", traj=np.zeros((0, 7)), scale=1.0)
    rows = spark.read.format("trajectory_records").load(f"file://{tmp_path}").orderBy("name", "row").collect()
    assert [(r.name, r.row, r.scale) for r in rows] == [("a", 0, 2.5), ("a", 1, 2.5), ("a", 2, 2.5), ("b", 0, 3.0)]
    assert rows[1].pose == poses[1].tolist()
    (tmp_path / "bad.npz").write_bytes(b"PK no archive")
    with pytest.raises(Exception, match="bad.npz can't be read"):
        spark.read.format("trajectory_records").load(str(tmp_path)).collect()


def test_written_again_gives_the_same_files(spark, tmp_path):
    records.register(spark)
    df = spark.createDataFrame([("a", [[1.0] * 7], 2.0), ("b", [[2.0] * 7] * 3, 1.0)], "name string, traj array<array<double>>, scale double")
    for _ in range(2):
        df.write.format("trajectory_records").mode("append").save(f"{tmp_path}/t")
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["a.npz", "b.npz"]
    df.where("name = 'b'").write.format("trajectory_records").mode("overwrite").save(f"{tmp_path}/t")
    back = spark.read.format("trajectory_records").load(f"{tmp_path}/t")
    assert back.agg(F.count("*"), F.sum("scale")).first() == (3, 3.0)


def test_many_files_share_partitions(spark, tmp_path):
    records.register(spark)
    for i in range(300):
        np.savez(tmp_path / f"{i}.npz", traj=np.full((1 + i % 3, 7), float(i)), scale=1.0)
    df = spark.read.format("trajectory_records").load(str(tmp_path))
    assert 16 < df.rdd.getNumPartitions() <= 32
    assert sorted((r.name, r.row, r.pose[0]) for r in df.collect()) == sorted((str(i), k, float(i)) for i in range(300) for k in range(1 + i % 3))
    (tmp_path / "150.npz").write_bytes(b"PK no archive")
    with pytest.raises(Exception, match="150.npz can't be read"):
        df.collect()
    left = spark.read.format("trajectory_records").option("corrupt", "skip").load(str(tmp_path))
    assert sorted({int(r.name) for r in left.collect()}) == [i for i in range(300) if i != 150]


def test_large_files_get_partitions_by_their_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PARTITION", 3 * records.OPEN)
    for i in range(200):
        (tmp_path / f"{i}.npz").write_bytes(bytes(8 * records.OPEN if i == 100 else 10))
    parts = [p.paths for p in records.TrajectoryReader({"path": str(tmp_path)}).partitions()]
    assert [p for paths in parts for p in paths] == records.listed(str(tmp_path), ".npz")
    assert max(map(len, parts)) <= 4 and next(len(paths) for paths in parts if f"{tmp_path}/100.npz" in paths) <= 3
