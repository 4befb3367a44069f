from __future__ import annotations

import random

import numpy as np
import xxhash

from plumbline.llm import simhash
from plumbline.llm.graph import components, local_components
from plumbline.llm.queries import op9_simhash


def brute_print(text):
    words = bytes((text or "").encode()).lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: dict[int, int], k=2):
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= k
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return {i: ids[c] for i, c in zip(ids, label, strict=True)}
        label = new


def families(n_families, size, seed):
    rng, out = random.Random(seed), set()
    for _ in range(n_families):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                x ^= 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
    return sorted(out)


def test_trie_join_finds_all_pairs(monkeypatch):
    values = np.array(families(30, 12, 5), np.uint64)
    want = {(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2}
    for pairs in (1 << 20, 16):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        got = [(max(p), min(p)) for a, b in simhash.trie_join(values, np.zeros(len(values), np.int64), 2) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_links_connect_as_all_pairs_do(spark, monkeypatch):
    values = families(20, 10, 6)
    for hot in (20_000, 1):
        monkeypatch.setattr(simhash, "HOT", hot)
        prints = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fingerprint long")
        roots = {r.node: r.root for r in components(simhash.near_links(prints)).collect()}
        got = {v: roots.get(v - (v >> 63 << 64), v - (v >> 63 << 64)) for v in values}
        want = brute_components({v: v for v in values})
        classes = lambda m: {frozenset(v for v in values if m[v] == c) for c in set(m.values())}
        assert classes(got) == classes(want)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 500 for i in range(501, 560)} | {901: 900}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert local_components(5, np.array([4, 1]), np.array([3, 3])).tolist() == [0, 1, 2, 1, 1]


def test_query_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_components(prints)
    got = op9_simhash(spark, sf_dir).collect()
    assert len(got) == len(texts)
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id]) for r in got)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "One two"), (8, "one  TWO"), (None, "one two"), (2, long), (1, long + " end"), (6, "É é x"), (6, "É é x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("5", 3), ("3", 3), ("4", 3), ("9", 8), ("8", 8), ("None", 8), ("2", 1), ("1", 1), ("6", 6), ("6", 6)])
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(docs, similarity=None).collect()) == ["1", "3", "6", "6", "8", "None"]
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(docs).collect()) == ["1", "3", "6", "6", "8", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_are_linked_as_brute_force_says(spark, monkeypatch):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for n in (30, 60, 120, 200):
        for _ in range(6):
            base = rng.choices(vocab, k=n)
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.choice([0, 1, 1, n // 40, n // 20])):
                    copy[rng.randrange(n)] = rng.choice(vocab)
                texts.append(" ".join(copy))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    label = local_components(len(texts), *np.array(near).T)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (20_000, 2):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
        wrong = sum(got[i] != label[i] for i in range(len(texts)))
        assert wrong <= (1 if hot > 2 else 4)  # fingerprints of texts at the very threshold may be too far apart
        assert all(label[i] == label[got[i]] for i in got)


def altered(rng, n, every, name):
    """A text of n different words and a copy with each every-th word replaced, five shingles lost each."""
    words = [f"{name}{i}" for i in range(n)]
    copy = [f"{name}x{i}" if i % every == every // 2 else w for i, w in enumerate(words)]
    return " ".join(words), " ".join(copy)


def test_long_texts_near_the_threshold_are_decided_exactly(spark):
    texts = []
    for k in range(60):
        texts += altered(random.Random(k), 900, (44, 45, 46, 47, 48, 49)[k % 6], f"t{k}w")
    similar = [jaccard(*texts[i : i + 2]) for i in range(0, len(texts), 2)]
    assert any(0.77 < s < 0.8 for s in similar) and any(0.8 <= s < 0.82 for s in similar)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(60)] == [s >= 0.8 for s in similar]


def test_repeated_lines_do_not_part_copies(spark):
    texts = []
    for k in range(40):
        line, body = " ".join(f"l{k}w{i}" for i in range(9)), " ".join(f"b{k}w{i}" for i in range(400))
        texts += [body + " " + " ".join([line] * 300), body + " " + " ".join([line] * 2)]
    assert all(jaccard(*texts[i : i + 2]) > 0.95 for i in range(0, len(texts), 2))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(c == i - i % 2 for i, c in got.items())


def test_hot_buckets_are_cut_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    prints = spark.createDataFrame([(i, [7, 8, 100 + i // 2]) for i in range(40)] + [(i, [7]) for i in range(40, 50)], "node long, keys array<long>")
    rows = simhash._tiles(prints).collect()
    buckets = {}
    for r in rows:
        buckets.setdefault(r.bucket, []).append(r)
    assert max(map(len, buckets.values())) <= 30  # two blocks of four, unevenly hashed
    met = {frozenset((a.node, b.node)) for rs in buckets.values() for a in rs for b in rs if a.node != b.node and (a.side < 0 or a.side != b.side)}
    assert len(met) == 50 * 49 // 2


def test_undecided_pairs_are_all_met_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNDECIDED", 1)
    base = [f"w{i}" for i in range(800)]
    texts = [" ".join(f"c{k}x{i}" if i % 75 == 37 + k else w for i, w in enumerate(base)) for k in range(14)]
    near = [(i, j) for i in range(14) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    label = local_components(14, *np.array(near).reshape(-1, 2).T)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(14)] == label.tolist()
