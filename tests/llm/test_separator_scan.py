from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm.queries import op3_separators, tokenizer
from plumbline.llm.separator_scan import count_tokens, document_tokens, end_outside, find_ends, write_flat

BPE = "byte_bpe_50k.json"


def cut(stream, end):
    """(doc, start, n_tokens, ended) by a plain loop."""
    out, start = [], 0
    for i, t in enumerate(stream):
        if t == end:
            out.append((len(out), start, i + 1 - start, True))
            start = i + 1
    return out + [(len(out), start, len(stream) - start, False)] * (start < len(stream))


def rows_of(df):
    return sorted((r.doc, r.start, r.n_tokens, r.ended) for r in df.collect())


def test_blocks_are_stitched():
    rng = np.random.default_rng(1)
    for top in (2, 5, 400):
        ids = rng.integers(0, top, 1000).astype("<u2")
        for block in (1, 7, 1000, 5000):
            places, last = [], -1
            for k, n, docs, before, ends in find_ends(ids.tobytes(), 1, 2, block):
                assert (docs, before, n) == (len(places), last, min(block, 1000 - k * block))
                places += ends.tolist()
                last = places[-1] if places else -1
            assert places == np.flatnonzero(ids == 1).tolist()
    with pytest.raises(ValueError):
        list(find_ends(b"abc", 1, 2))


@pytest.mark.parametrize("width", [2, 4])
def test_documents_over_files_and_blocks(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    # 0x0201 and 0x0102 hold the end id's bytes across tokens
    stream = rng.choice([0x0201, 0x0102, 2, 0x0200, 9], 3000, p=[0.3, 0.3, 0.01, 0.3, 0.09]).astype(f"<u{width}")
    stream[-1] = 9
    for k, part in enumerate(np.split(stream, [0, 10, 1500, 1501, 2990])):  # an empty file, and one after another cut anywhere
        (tmp_path / f"shard-{k * 3}").write_bytes(part.tobytes())
    assert rows_of(count_tokens(spark, f"file://{tmp_path}", 2, width, block=64)) == cut(stream.tolist(), 2)


def test_odd_rows(spark, tmp_path):
    lib, end = Tokenizer.from_file(tokenizer(BPE)), end_outside(tokenizer(BPE))
    texts = [None, "", "a # b\n", "a # b\n", "<|endoftext|>", "long é " * 30_000]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, file int").coalesce(1)
    stream = [i for t in texts for i in [*lib.encode(t or "", add_special_tokens=False).ids, end]]
    got = document_tokens(docs, tokenizer(BPE), f"file://{tmp_path}/a")
    assert rows_of(got) == cut(stream, end)
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("part*"))) == np.array(stream, "<u2").tobytes()
    write_flat(docs, f"file://{tmp_path}/b", tokenizer(BPE), end_id=70_000)
    assert rows_of(count_tokens(spark, f"file://{tmp_path}/b", 70_000)) == cut([70_000 if i == end else i for i in stream], 70_000)
    assert document_tokens(docs.limit(0), tokenizer(BPE)).count() == 0


def test_query(spark, sf_dir):
    lib = Tokenizer.from_file(tokenizer(BPE))
    want = sorted(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = rows_of(op3_separators(spark, sf_dir))
    assert sorted(r[2] for r in got) == want
    assert [r[0] for r in got] == list(range(len(want)))
    assert all(a[1] + a[2] == b[1] and b[3] for a, b in zip(got, got[1:], strict=False))
