from __future__ import annotations

import corpus_pipeline
from plumbline.llm import decontamination, pieces, secrets, simhash
from plumbline.llm.queries import op4_toxicity, tokenizer


def test_each_stage_works_on_what_the_one_before_kept(spark, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = whole, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == whole.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id: r for r in docs.collect()})
    toxic = {r.doc_id for r in op4_toxicity(spark, sf_dir).collect() if r.predicted}
    assert set(kept[0]) == {r.doc_id for r in whole.select("doc_id").collect()} - toxic
    assert 0 < len(kept[1]) < len(kept[0])
    assert len({r.text for r in kept[1].values()}) == len(kept[1])  # of exact copies one is left
    assert set(kept[3]) == set(kept[2]) == set(kept[4])
    changed = [i for i in kept[2] if kept[2][i].text != kept[3][i].text]
    assert changed and all("[SECRET]" in kept[3][i].text and len(kept[3][i].text) == kept[3][i].n_chars for i in changed)
    own = pieces.Pieces(tokenizer("piece_bpe_32k.model"))
    for i, r in kept[4].items():
        assert r.ids == own.library.encode(kept[3][i].text, add_eos=True) and r.decoded == kept[3][i].text


def test_run_is_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and 0 < got.count() < 200


def test_copies_by_fingerprint_go_too_and_join_groups(spark, sf_dir):
    line, same = " ".join(f"l{i}" for i in range(9)), [f"s{i}" for i in range(900)]
    texts = [" ".join([line] * 300 + [f"{name}{i}" for i in range(200)]) for name in "abc"]  # one fingerprint, shingle sets apart
    texts += [" ".join(same), " ".join(f"x{i}" if i % 150 == 75 else w for i, w in enumerate(same)), "by itself it stays"]  # similar sets, prints over two bits apart
    texts += [" ".join([line] * 2 + [f"c{i}" for i in range(200)])]  # a chain: only its set is like that of the third, whose print is the first's
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.fingerprint(t) % (1 << 64) for t in texts]
    assert max((prints[0] ^ p).bit_count() for p in prints[1:3]) <= 2 < min((prints[3] ^ prints[4]).bit_count(), (prints[0] ^ prints[6]).bit_count())
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, sf_dir).collect()}
    assert kept == {0, 3, 5}
    by_print = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(by_print[i] == i for i in kept)
