from __future__ import annotations

import math
import random
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences  # noqa: E402

from plumbline.llm import lexical  # noqa: E402
from plumbline.llm.common import lower_ascii  # noqa: E402
from plumbline.llm.queries import oracle_sql, queries  # noqa: E402


def terms(text):
    return [w.decode() for w in lexical.TERM.findall(lower_ascii(text or ""))]


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in own:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["çé", "A1", "a1", "x", "x"]
    docs = [(i, ". ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(300)]
    docs += [(7, docs[7][1]), (None, "rare words x"), (None, None), (400, ""), (401, "--"), (402, "x " * 40_000), *((500 + i, "one line that many share") for i in range(80))]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 12])))) for i in range(25)] + [(90, "share SHARE line"), (91, None), (92, "unseen"), (93, "rare words"), (93, "rare words"), (None, "w1 w2")]
    return docs, items


def test_matches_brute_force_over_segments_and_blocks(spark, tmp_path):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, m int, term string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for segment_terms, block_terms in ((1 << 20, 1 << 17), (700, 8)):
        folder = f"file://{tmp_path}/{segment_terms}"
        lexical.build_index(d, folder, segment_terms=segment_terms)
        got = sorted(map(tuple, lexical.search(spark, folder, b, block_terms=block_terms).collect()), key=str)
        assert got == want


def test_strata_below_the_bound_are_not_visited():
    rows = [(i, f"common {'rare ' * (i % 7 == 0)}{'pad ' * i}") for i in range(1, 400)]
    size = [len(terms(t)) for _, t in rows]
    codes, vocabulary = [], {}
    for _, t in rows:
        codes.append([vocabulary.setdefault(w.encode(), len(vocabulary)) for w in terms(t)])
    import numpy as np

    batches = list(lexical.segment_rows(0, [i for i, _ in rows], size, [np.array(c) for c in codes], list(vocabulary), len(rows), sum(size)))
    segment = lexical.Segment(pa.Table.from_batches(batches), {"common": 1, "rare": 1000, "pad": 1})
    seen = []
    whole = lexical._ranges
    lexical._ranges = lambda start, length: seen.append(int(length.sum())) or whole(start, length)
    try:
        score, ids = segment.best({"rare": 1, "common": 1}, 10, np.zeros(0, np.int64), np.zeros(0, np.int64))
    finally:
        lexical._ranges = whole
    assert ids.tolist() == [7 * k for k in range(1, 11)] and (np.diff(score) <= 0).all()
    assert sum(seen[1:]) < 399 // 2


def test_counts_from_buffers():
    texts = ["", None, "a b", "--", "é9 Z_z", "end", "start"]
    array = pa.array([*texts, "cut off"]).slice(0, len(texts))
    assert lexical.count_terms(array).tolist() == [len(terms(t)) for t in texts]
    assert lexical.count_terms(array.slice(2, 3)).tolist() == [2, 0, 3]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(d.limit(0), b).count() == 0
    assert lexical.rank_documents(d, b.limit(0)).count() == 0


def test_query_against_its_sql(spark, sf_dir):
    name = "op12_lexical"
    assert differences(spark, name, queries()[name], oracle_sql()[name], sf_dir) is None
