from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences  # noqa: E402

from plumbline.llm import suffixes  # noqa: E402
from plumbline.llm.queries import oracle_sql, queries  # noqa: E402


def brute(rows, window=50):
    """doc_id, n_words, n_removed, kept of each row, by a table of all windows."""
    cut = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for own, words in cut:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            least[key] = min(own, least.get(key, own))
    out = []
    for (doc_id, _), (own, words) in zip(rows, cut, strict=True):
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < own:
                gone.update(range(k, k + window))
        out.append((doc_id, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["çé", "A", "a"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, other = text(70), text(50)
    rows = [(i, text(rng.choice([0, 3, 49, 50, 120, 400]))) for i in range(40)]
    rows += [(100 + i, f"{text(rng.choice([0, 5, 90]))} {passage} {text(rng.choice([0, 7, 60]))}") for i in range(30)]
    rows += [(200, f"{other} {text(9)} {other}"), (201, other), (150, other + "\n\t " + text(30)), (202, " ".join(other.split()[1:])), (203, f"{other} {other} {other}")]
    rows += [(300 + i, rows[7][1] if i % 2 else rows[8][1] + " end") for i in range(12)]
    rows += [(5, rows[5][1]), (5, passage), (None, passage), (None, None), (400, None), (401, ""), (402, "e " * 3000), (403, "e " * 60), (404, "a b c " * 500), (405, "c a b " * 40), (-3, rows[60][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, own int, spans string")


@pytest.mark.parametrize(("hot", "tree_words", "gram"), [(1 << 15, 1 << 20, 8), (5, 1 << 20, 8), (1 << 15, 300, 3), (0, 1, 50)])
def test_matches_brute_force(spark, hot, tree_words, gram):
    rows = cases()
    options = {"hot": hot, "tree_words": tree_words, "gram": gram}
    want = brute(rows)
    assert sum(w[2] for w in want) > 2000
    assert sorted(map(tuple, suffixes.remove_repeats(frame(spark, rows), **options).collect()), key=str) == want
    digests = [(i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in want]
    assert sorted(map(tuple, suffixes.removal_digests(frame(spark, rows), **options).collect()), key=str) == sorted(digests, key=str)


def test_spans_are_maximal_repeats(spark):
    rng = random.Random(2)
    words = [f"u{i}" for i in range(2000)]
    passage = " ".join(rng.sample(words, 200))
    rows = [(1, "x y " + passage), (2, "z " + passage + " q"), (3, passage[: len(passage) // 2])]
    got = {r.doc_id: suffixes.removed(300, r.spans).nonzero()[0] for r in suffixes.repeats(frame(spark, rows)).collect()}
    assert set(got) == {2, 3} and got[2].tolist() == list(range(1, 201))


def test_other_windows(spark):
    rows = cases()[:80]
    for window in (3, 8, 33):
        assert sorted(map(tuple, suffixes.remove_repeats(frame(spark, rows), window=window).collect()), key=str) == brute(rows, window)


def test_nodes_are_classes_of_equal_windows():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2, 4000)
    for window in (1, 2, 5, 8, 13):
        starts = np.arange(len(words) - window + 1)
        node = suffixes.nodes(words, starts, window)
        seen = {}
        assert all(seen.setdefault(int(k), tuple(words[i : i + window])) == tuple(words[i : i + window]) for i, k in zip(starts, node, strict=True))
        assert len(seen) == len({tuple(words[i : i + window]) for i in starts})


def test_empty_table(spark):
    assert suffixes.removal_digests(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_query_against_its_sql(spark, sf_dir):
    name = "op11_suffixes"
    assert differences(spark, name, queries()[name], oracle_sql()[name], sf_dir) is None
