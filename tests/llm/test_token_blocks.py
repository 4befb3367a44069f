from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

from plumbline.llm.queries import op1_token_blocks, tokenizer
from plumbline.llm.token_blocks import ChunkEncoder, Segment, pack, read_tokens, token_files, write_tokens

BPE = "byte_bpe_50k.json"


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 20_000):
        for top in (1, 2, 300, 50_257, 2**31):
            ids = (rng.random(n) ** 3 * top).astype("u4")
            segment = Segment(pack(ids))
            assert (segment.ids() == ids).all()
            assert all((segment.block(k) == ids[k * 512 : (k + 1) * 512]).all() for k in range(segment.blocks))


def test_chunks_encode_as_the_whole_text():
    encoder, lib = ChunkEncoder(tokenizer(BPE)), Tokenizer.from_file(tokenizer(BPE))
    for text in ["", " ", "  a  b\n c \n  d  <|endoftext|> x  ", "\x1c a", "a　 \xa0b  c don't I'LL", "x" * 50_000, "a​ b\x85 c", "<|endoftext|>" * 3]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def expected(rows):
    lib, at, out = Tokenizer.from_file(tokenizer(BPE)), 0, []
    for doc_id, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_of_odd_rows(spark, tmp_path):
    rows = [(None, "first"), (-4, None), (0, ""), (3, "a b c"), (3, "a b c"), (9, "long " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in reversed(rows)], "doc_id long, text string, start string")
    assert sorted(map(tuple, token_files(docs, tokenizer(BPE), segment_tokens=20).collect()), key=lambda r: r[1]) == expected(rows)
    write_tokens(docs, f"file://{tmp_path}/t", tokenizer(BPE))
    got = sorted(read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [len(r.ids) // 4 for r in got] == [r[2] for r in expected(rows)]
    assert token_files(docs.limit(0), tokenizer(BPE)).count() == 0


def test_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(map(tuple, op1_token_blocks(spark, sf_dir).collect())) == expected(rows)
