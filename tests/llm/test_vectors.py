from __future__ import annotations

import numpy as np
import pytest

from plumbline.llm import vectors
from plumbline.llm.queries import op10_vectors


def brute(x: np.ndarray, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


@pytest.mark.parametrize("sizes", [(4096, 16384), (7, 11)])
def test_all_links_of_groups_and_copies(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "HOME_ROWS", sizes[0])
    monkeypatch.setattr(vectors, "MEMBER_ROWS", sizes[1])
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.15, base, base[:5], np.repeat(base[:1], 30, axis=0), base[1:2] + rng.normal(size=(80, 16)) * 0.1]).astype("f4")
    want_links, want = brute(x.astype("f8"))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n_links int")
    got = sorted(vectors.near_vectors(frame, cell_rows=20, margin=2.0).collect())
    assert [r.n_links for r in got] == want_links.tolist()
    assert [r.component_id for r in got] == want.tolist()
    assert [r.kept for r in got] == (want == np.arange(len(x))).tolist()


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.1]), (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (11, []), (12, [0.0, 2.0, 0.0, 1.0]), (13, [0.0, 4.0, 0.0, 2.0]), (14, [1.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect())
    want = [("1", 2, 1, True), ("2", 2, 1, False), ("2", 2, 1, False), ("None", 0, None, False), ("9", 1, 9, True), ("10", 1, 9, False)] + [(str(i), 0, i, True) for i in (3, 4, 5, 6, 7, 8, 11, 14)]
    want += [("12", 1, 12, True), ("13", 1, 12, False)]
    assert got == sorted(want)
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_recall_of_query(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    want_links, want = brute(np.array([r.embedding for r in data], "f8"))
    got = {r.vec_id: r for r in op10_vectors(spark, sf_dir).collect()}
    assert len(got) == len(data)
    links = np.array([got[r.vec_id].n_links for r in data])
    assert (links <= want_links).all() and links.sum() >= 0.9 * want_links.sum()


@pytest.mark.parametrize("spread", [1.0, 0.1])
def test_no_link_is_lost_over_hundreds_of_cells_without_a_margin(spark, spread):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 24))[rng.integers(0, 60, 700)] + rng.normal(size=(700, 24)) * spread
    off = rng.normal(size=base.shape)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    off -= (off * unit).sum(axis=1, keepdims=True) * unit
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([unit, unit * 0.905 + off * np.sqrt(1 - 0.905**2)]).astype("f4")
    want_links, want = brute(x.astype("f8"))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(vectors.near_vectors(frame, cell_rows=5, margin=None).collect())
    assert [r.n_links for r in got] == want_links.tolist()
    assert [r.component_id for r in got] == want.tolist()


@pytest.mark.parametrize("dimensions", [64, 8])
def test_recall_of_planted_links_over_many_cells(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    base = rng.normal(size=(1500, dimensions))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.901, 1, (1500, 1))
    x = np.concatenate([base, base * cosine + off * np.sqrt(1 - cosine**2)])
    centres = vectors.fit_cells(x, 100)
    assert vectors._visits(x @ centres.T, centres, 0.9, vectors.MARGIN).mean() < 0.1
    want_links, _ = brute(x)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = np.array([r.n_links for r in sorted(vectors.near_vectors(frame, cell_rows=30).collect())])
    assert want_links.sum() >= 3000 and (links <= want_links).all() and links.sum() >= 0.98 * want_links.sum()
