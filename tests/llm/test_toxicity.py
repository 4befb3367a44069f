from __future__ import annotations

import random

import numpy as np

from plumbline.llm import toxicity
from plumbline.llm.queries import op4_toxicity
from plumbline.llm.toxicity import EXACT, NEAR, STEM, Automaton, Scorer, keep_clean, score_toxicity


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_what_is_one_edit_away():
    terms = {"stupid": 1.0, "moron": 0.9, "scum": 0.8, "worthless": 0.7}
    automaton, rng = Automaton(terms, {"lowei": 0.5}), random.Random(4)
    words = list(terms) + ["loweixyz", "lowe", "x"]
    for _ in range(3000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(1, len(w))  # the first character is fixed
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "o", "zz"][: rng.randint(1, 4)])
        words.append("".join(w))
    for w in words:
        near = [t for t in terms if len(t) >= 5 and len(w) >= 4 and w[0] == t[0] and edit_distance(w[1:], t[1:]) == 1]
        kind = EXACT if w in terms else STEM if w.startswith("lowei") else NEAR if near else None
        got = automaton.find(w)
        assert (got[0] if got else None) == kind, w
        assert kind != NEAR or got[1] == max(terms[t] for t in near)


def test_context_weakens_quotation():
    scorer = Scorer({"moron": 1.0}, {})
    weights = toxicity.PRIOR
    direct, quoted, clean, spelt = (float(np.dot(scorer.features(t), weights)) for t in ("you are a moron", 'he said "moron" in the report', "nothing of the kind", "what a m0r0n"))
    assert clean < quoted < spelt < direct


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_odd_rows_and_no_labels(spark):
    rows = [(1, "you utter moron, you moron"), (1, "you utter moron, you moron"), (2, None), (3, ""), (None, "calm words"), (4, "calm " * 50_000)]
    docs = frame(spark, [(*r, "x") for r in rows])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert sorted((str(r.doc_id), r.predicted) for r in got) == [("1", 1), ("1", 1), ("2", 0), ("3", 0), ("4", 0), ("None", 0)]
    assert sorted(str(r.doc_id) for r in keep_clean(docs, labels).collect()) == ["2", "3", "4", "None"]
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_learns_terms_and_stems_that_no_seed_has(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choices(["ra", "ti", "mo", "lu", "ke"], k=3)) for _ in range(80)]
    rows, marks = [], []
    for i in range(240):
        words = rng.choices(plain, k=40)
        if i % 5 == 0:
            words[3:3] = [f"zorg{rng.choice(plain)}", f"zorg{rng.choice(plain)}", "blurgh"]
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(i % 5 == 0)))
    marks += [(0, None), (None, 1), (10_000, 1)]
    got = score_toxicity(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"), learn=toxicity.F.col("doc_id") < 160).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in got)


def test_query_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = op4_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    found = [r.predicted for r in got if r.toxic == 1]
    assert right > 0.95 and sum(found) >= 0.8 * len(found)


def test_texts_that_share_two_words_all_count(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices(["ra", "ti", "mo", "lu", "ke"], k=3)) for _ in range(60)]
    licence = " ".join(f"licence{i}" for i in range(400))  # holds the smallest hash of nearly all texts
    rows = [(i % 2, licence + " " + " ".join(rng.choices(plain, k=10) + ["blurgh"] * (i % 2))) for i in range(120)]
    terms, _ = toxicity.learn_lexicon(spark.createDataFrame(rows + rows[:1] * 50, "toxic int, text string"))
    assert terms.get("blurgh") == 1.0


def test_fit_ends_at_the_least_loss():
    rng = np.random.default_rng(5)
    y = (np.arange(12_000) < 1000).astype(float)
    x = np.zeros((len(y), toxicity.FEATURES))
    x[:, 0], x[:, 1], x[:, 4] = 1, y * 3, y  # classes that part without fault, where an undamped step overshoots
    x[:, 2] = rng.exponential(2, len(y))
    x[:, 3] = rng.exponential(5, len(y)) * (rng.random(len(y)) < 0.5)
    w = toxicity.fit(x, y)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert p[y == 1].min() > 0.3 > p[y == 0].max()
    assert np.abs(x.T @ (p - y) + (w - toxicity.PRIOR)).max() < 1e-2


def test_near_copies_speak_once(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(7)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(200):
        toxic = i % 10 == 0
        rows.append((i, " ".join([*rng.choices(names, k=60), *(["grobnik"] if toxic else [])]), ""))
        labels.append((i, int(toxic)))
    base = rng.choices(names, k=150) + ["onlyinthiscopy"]
    for i in range(200, 240):  # near copies of one toxic text
        words = list(base)
        words[rng.randrange(150)] = rng.choice(names)
        rows.append((i, " ".join(words), ""))
        labels.append((i, 1))
    sample = frame(spark, rows).join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id")
    terms, stems = toxicity.learn_lexicon(sample)
    assert "grobnik" in terms or any("grobnik".startswith(s) for s in stems)
    assert "onlyinthiscopy" not in terms and not any("onlyinthiscopy".startswith(s) for s in stems)
