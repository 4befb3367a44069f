from __future__ import annotations

import hashlib
import random

import sentencepiece

from plumbline.llm.pieces import Pieces, encode_digests, encode_texts
from plumbline.llm.queries import op7_pieces, tokenizer

MODEL = "piece_bpe_32k.model"


def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer(MODEL))


def odd_texts():
    rng = random.Random(1)
    fixed = ["", " ", "  a  b ", "ﬁ Ａ é 　x", "a\tb\nc\n\n d", "▁a ▁ b", "\x00a", "<s> </s> <unk> x", "\U0001f600", "a" * 3000, " " * 37 + "x" + " " * 100, "\n", "\n \n", "?" * 500 + "#" * 900, "x\r\n y;\r"]
    return fixed + ["".join(rng.choices(" \n▁abthein'#*=é\t\U0001f600", k=rng.choice([5, 30, 200]))) for _ in range(200)]


def test_agenda_is_the_librarys_encoding():
    lib, own = library(), Pieces(tokenizer(MODEL), check=False)
    for text in odd_texts():
        ids, n, decoded = own.encode([text])[0]
        want = lib.encode(text, add_eos=True)
        assert ([int(i) for i in ids.split()], n, decoded) == (want, len(want), lib.decode(want))


def test_heap_and_batch_agree():
    own = Pieces(tokenizer(MODEL), check=False)
    units = sorted({u for t in odd_texts() for u in own.units.findall("▁" + t.replace(" ", "▁"))})
    assert own.agenda_together(units) == [own.agenda_alone(u) for u in units]


def test_rows_and_query(spark, sf_dir):
    lib = library()
    rows = [(1, None), (2, ""), (1, "a b"), (None, "a b")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    got = encode_texts(docs, tokenizer(MODEL)).collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in got] == [(i, lib.encode(t or "", add_eos=True), t or "") for i, t in rows]
    assert encode_digests(docs.limit(0), tokenizer(MODEL)).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op7_pieces(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
