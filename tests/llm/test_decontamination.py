from __future__ import annotations

import random

from plumbline.llm.decontamination import WORD, decontaminate
from plumbline.llm.common import lower_ascii


def brute(text, items, window=10):
    words = WORD.findall(lower_ascii(text or ""))
    hit, found = set(), set()
    for item, body in items:
        pattern = WORD.findall(lower_ascii(body or ""))
        m = min(window, len(pattern))
        for i in range(len(pattern) - m + 1) if m else ():
            for j in range(len(words) - m + 1):
                if words[j : j + m] == pattern[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def cases():
    rng = random.Random(3)
    vocab = ["a", "B", "çé", "d1", "e"]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([0, 1, 2, 3, 9, 10, 11, 25, 12, 40])] + [(None, "zz yy"), (99, None), (7, "d1 d1 e e a a")]
    items[1] = (1, "qq")
    docs = [(i, ", ".join(rng.choices(vocab, k=rng.choice([0, 3, 40, 120])))) for i in range(40)]
    for i, (_, body) in enumerate(items):
        docs.append((100 + i, f"x x {body} QQ {body} zz YY"))
    return docs + [(5, docs[5][1]), (None, None), (200, ""), (201, ("e " * 30_000) + "qq")], items


def test_matches_brute_force_in_one_and_many_passes(spark):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n_hit int, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i if i is not None else -1), *brute(t, items)) for i, t in docs)
    for chars in (10**6, 60):
        got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_hit, r["items"]) for r in decontaminate(d, b, pass_chars=chars).collect())
        assert got == want


def test_clean_documents_keep_all_columns(spark):
    from plumbline.llm.decontamination import keep_clean

    docs, items = cases()
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n_hit int, __k1 string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i if i is not None else -1), 7, "x") for i, t in docs if not brute(t, items)[1])
    for chars in (10**6, 60):
        got = keep_clean(d, b, pass_chars=chars)
        assert got.columns == d.columns and sorted(((r.doc_id if r.doc_id is not None else -1), r.n_hit, r["__k1"]) for r in got.collect()) == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate(d, b).collect()] == [(2, 0, False)]
    assert decontaminate(d.limit(0), b).count() == 0
