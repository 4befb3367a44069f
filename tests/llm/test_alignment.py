from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm.alignment import align_tokens, byte_of_sign
from plumbline.llm.queries import op13_alignment, tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(rows):
    """By the libraries over whole texts, token by token."""
    lib = Tokenizer.from_file(tokenizer(A))
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(B))
    sign, found = byte_of_sign(), []
    for doc_id, text in rows:
        raw, groups, links, n_a, n_b = b" " + (text or "").encode(), [], [], 0, 0
        if text:
            a = [(i, bytes(sign[c] for c in lib.id_to_token(i))) for i in lib.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
            if b"".join(x[1] for x in a) == raw == b"".join(x[1] for x in b):
                n_a, n_b = len(a), len(b)
                at_a = at_b = 0
                own_a, own_b = [], []
                while a or b:
                    if at_a <= at_b:
                        i, piece = a.pop(0)
                        at_a += len(piece)
                        own_a.append(i)
                    else:
                        i, piece = b.pop(0)
                        at_b += len(piece)
                        own_b.append(i)
                    if at_a == at_b:
                        groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                        links.append((own_a[-1], own_b[-1]))
                        own_a, own_b = [], []
        found.append((doc_id, n_a, n_b, groups, links))
    counts = Counter(x for f in found for x in f[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(
        ((d, n_a, n_b, len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n_a, n_b, g, k in found),
        key=str,
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = [
    (None, "first text"), (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n and lines\t."), (5, "a▁b"), (6, "<|endoftext|> and <s> </s> <0x41>"), (7, "你好 \U0001f600\U0001f680 naïve रि"),
    (8, "x" * 5000), (9, "plain words here"), (9, "plain words here"), (10, "long " * 20_000), (11, "a\x00b \r\n   c "), (12, "﻿mark é"), (13, "don't I'LL 12345 +-*/"),
]


@pytest.mark.parametrize("block_pairs", [1 << 21, 20])
def test_matches_brute_force(spark, block_pairs):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, pairs string, row int")
    got = align_tokens(docs, tokenizer(A), tokenizer(B), block_pairs=block_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == brute(ODD)


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(op13_alignment(spark, sf_dir)) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokens(docs, tokenizer(A), tokenizer(B)).count() == 0
