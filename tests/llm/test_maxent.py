from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from plumbline.llm import maxent
from plumbline.llm.queries import op5_maxent


def brute_base(rows, taught):
    """(n_tokens, n_known, train_tokens, base_score) of each text."""
    words = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    c = Counter(w for ws, t in zip(words, taught, strict=True) if t for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws in words]


def check_base(got, rows, taught):
    want = sorted((str(i), *b) for (i, _), b in zip(rows, brute_base(rows, taught), strict=True))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [w[:4] for w in want] == [g[:4] for g in got]
    assert np.allclose([w[4] for w in want], [g[4] for g in got], rtol=1e-9, atol=1e-9)


def test_places_have_room_and_differ():
    rng = np.random.default_rng(4)
    near = np.abs(rng.normal(size=(3000, 8)))
    near[5] = 0
    places = maxent._places(near)
    assert places[5] == -1 and len(set(places[places >= 0])) == 2999
    assert places.max() < maxent.GROUPS * 16**3 and (places[places >= 0] // 256 % 16 != maxent.LOOSE).all()


def test_query_counts_and_held_out_gain(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    taught = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    got = op5_maxent(spark, sf_dir).collect()
    check_base(got, rows, taught)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for (i, _), t in zip(rows, taught, strict=True) if not t}
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_odd_rows_and_rare_tokens_by_join(spark, monkeypatch):
    monkeypatch.setattr(maxent, "KNOWN", 3)
    monkeypatch.setattr(maxent, "CLASSED", 2)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "É", "dd", f"w{i}"], k=20))) for i in range(40)]
    rows += [(41, None), (42, ""), (None, "a b new"), (3, rows[3][1]), (50, "a zz " * 20_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    learn = maxent.F.col("doc_id") < 30
    got = maxent.score_texts(docs, learn).collect()
    check_base(got, rows, [i is not None and i < 30 for i, _ in rows])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert maxent.score_texts(docs.limit(0), learn).count() == 0


def test_probabilities_of_last_words_sum_below_one(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, weights=range(30, 0, -1), k=60))) for i in range(60)]
    # one text for each word after the same beginning: their probabilities differ by the last word and the end alone
    asked = [(1000 + i, f"w0 w1 {w}") for i, w in enumerate([*words, "unseen"])]
    got = {r.doc_id: r.score for r in maxent.score_texts(spark.createDataFrame(rows + asked, "doc_id long, text string"), maxent.F.col("doc_id") < 60).collect()}
    alone = {r.doc_id: r.score for r in maxent.score_texts(spark.createDataFrame(rows + [(2000, "w0 w1")], "doc_id long, text string"), maxent.F.col("doc_id") < 60).collect()}
    # of a text and its end, the end's own part is below one, so the sum over last words is at most that of the beginning
    assert sum(10 ** got[i] for i, _ in asked) < 1 and 10 ** alone[2000] < 1


def test_softmaxes_are_distributions_and_learn():
    rng = np.random.default_rng(0)
    layer = maxent.Softmax(rng.normal(size=(256, 16)).astype("f4"))
    rows, bias = rng.integers(0, 256, (3, 400)), np.where(rng.random((1, 16)) < 0.3, -1e9, 0).astype("f4")
    assert np.allclose(np.exp(layer.logs(rows, bias)).sum(axis=1), 1, atol=1e-5)
    goals = rng.choice(np.flatnonzero(bias[0] == 0), 400)
    before = layer.logs(rows, bias)[np.arange(400), goals].mean()
    layer.learn()
    for _ in range(30):
        layer.step(rows, goals, bias)
    assert layer.logs(rows, bias)[np.arange(400), goals].mean() > before + 1


def test_words_of_a_part_depend_on_context(spark):
    # "a" is always followed by x1 or x2 as the word before it says; all are of the same kind and count
    rng = random.Random(6)
    rows = []
    for i in range(300):
        ws = []
        for _ in range(40):
            s = rng.randrange(2)
            ws += [f"s{s}", "a", f"x{s}", rng.choice(["p", "q", "r"])]
        rows.append((i, " ".join(ws)))
    rows += [(1000, "p s0 a x0 p"), (1001, "p s0 a x1 p")]
    got = {r.doc_id: r.score for r in maxent.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), maxent.F.col("doc_id") < 300).collect()}
    assert got[1000] > got[1001] + 1


def test_nothing_to_learn_from(spark):
    rows = [(1, "a b"), (2, None), (3, "c " * 40_000)]
    got = maxent.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), maxent.F.col("doc_id") > 5).collect()
    check_base(got, rows, [False] * 3)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_step_on_touched_rows_equals_the_dense_one():
    from plumbline.llm import maxent

    rng = np.random.default_rng(5)
    own = maxent.Softmax(rng.normal(size=(512, maxent.WIDE)).astype(np.float32))
    own.learn()
    w, slope, seen = own.w.copy(), own.slope.copy(), own.seen.copy()
    bias = np.full((1, maxent.WIDE), 0.1, np.float32)
    for n in (1, 40, 200):
        rows, goals = rng.integers(0, 300, (7, n)), rng.integers(0, maxent.WIDE, n)
        z = np.minimum(w[rows].sum(axis=0) + bias, maxent.HIGHEST)
        error = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        error[np.arange(n), goals] -= 1
        gradient = np.zeros_like(w)
        for r in rows:
            np.add.at(gradient, r, error / np.float32(np.sqrt(n)))
        slope += (gradient * gradient).sum(axis=1, keepdims=True) / maxent.WIDE
        w -= gradient * (maxent.RATE / np.sqrt(slope))
        seen[np.unique(rows)] += 1
        own.step(rows, goals, bias)
    assert np.allclose(own.w, w, atol=1e-4) and np.allclose(own.slope, slope, rtol=1e-3) and (own.seen == seen).all()


def test_spans_are_read_as_by_plain_splitting_and_in_order_of_hashes():
    rng = random.Random(1)
    letters = ["a", "B", "É", "İ", "\x1c", "\x85", "\u3000", "\xa0", "😀", "^", "$", "\x00", *" \t\n\x0b\x0c\r  "]
    texts = [None, "", "  ", " a ", "x" * 39, "x" * 40, "y" * 41, "z" * 100 + "é", *("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(300))]
    for part in (texts, [None], [""], [" "]):
        sizes, facts, at = maxent.span_of(pa.array(["before", *part, "after"]).slice(1, len(part)))
        words = [[*(t or "").encode().lower().split(), maxent.END] for t in part]
        flat = [w for ws in words for w in [maxent.PAD] * 3 + ws]
        assert sizes.tolist() == [len(ws) for ws in words]
        assert facts[at].tolist() == [[maxent.token_hash(w), maxent.shape_of(w)] for w in flat]
        assert (facts[1:, 0] > facts[:-1, 0]).all()


def test_sums_of_rows_with_few_and_with_many_tokens():
    rng = np.random.default_rng(7)
    for n, top in ((1, 5), (40, 1), (5000, 300), (16384, 1 << 18), (70_000, 1 << 18)):
        rows = np.concatenate([rng.integers(0, top, (5, n)), np.minimum(rng.geometric(0.2, (2, n)), top - 1)])
        error = rng.normal(size=(n, maxent.WIDE)).astype(np.float32)
        want = np.zeros((top, maxent.WIDE))
        for r in rows:
            np.add.at(want, r, error)
        ids, sums = maxent.row_sums(rows, error)
        assert sorted(ids.tolist()) == np.unique(rows).tolist()
        assert np.allclose(sums, want[ids], rtol=1e-4, atol=1e-2)


def test_one_output_as_of_all():
    rng = np.random.default_rng(2)
    layer = maxent.Softmax(rng.normal(size=(256, 16)).astype("f4"))
    rows, goals, bias = rng.integers(0, 256, (3, 50)), rng.integers(0, 16, 50), np.zeros((1, 16), "f4")
    assert np.allclose(layer.logs_of(rows, goals, bias), layer.logs(rows, bias)[np.arange(50), goals], atol=1e-5)


def test_short_ids_and_several_spans_in_a_batch(spark, monkeypatch):
    monkeypatch.setattr(maxent, "SPAN", 50)
    rows = [(i, "a b " * (i % 7)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    spans = maxent.read_spans(docs.select("doc_id", maxent.F.lit(True).alias("learnt"), "text")).collect()
    assert len(spans) > 5 and sorted((i, n) for s in spans for i, n in zip(s.doc_ids, s.sizes, strict=True)) == [(i, 2 * (i % 7) + 1) for i, _ in rows]
