"""The queries op<N>_<name> and pipeline, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, decontamination, html_text, lexical, maxent, pieces, secrets, separator_scan, simhash, suffixes, token_blocks, toxicity, vectors
from plumbline.session import load


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(load(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.document_tokens(load(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def remainder(divisor: int):
    """crc32 of the doc_id as text, modulo divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), learn=remainder(4) != 2)
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = maxent.score_texts(load(spark, sf_dir, "documents"), learn=remainder(10) != 0)
    return scored.withColumn("held_out", ~F.col("learnt")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(load(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(load(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(load(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(load(spark, sf_dir, "embeddings"))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digests(load(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(load(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_blocks": op1_token_blocks,
        "op2_decontamination": op2_decontamination,
        "op3_separators": op3_separators,
        "op4_toxicity": op4_toxicity,
        "op5_maxent": op5_maxent,
        "op6_secrets": op6_secrets,
        "op7_pieces": op7_pieces,
        "op8_html": op8_html,
        "op9_simhash": op9_simhash,
        "op10_vectors": op10_vectors,
        "op11_suffixes": op11_suffixes,
        "op12_lexical": op12_lexical,
        "op13_alignment": op13_alignment,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": DECONTAMINATION, "op11_suffixes": SUFFIXES, "op12_lexical": LEXICAL}


DECONTAMINATION = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS gram
  FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT item_id, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0))
), g AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM p) WHERE len(ws) >= m)
), h AS (
  SELECT g.doc_id, g.i, g.m, p.item_id FROM g JOIN p ON g.m = p.m AND g.gram = p.gram
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0
), p AS (
  SELECT r, doc_id, 25 + (75 * len(ws) * n) // l AS m, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT r, doc_id, ws, unnest(ws) AS term FROM d), c GROUP BY r, doc_id, ws, n, l, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL) JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

SUFFIXES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
), least AS (
  SELECT gram, min(doc_id) AS least FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT r, list_distinct(list(k)) AS ks FROM (SELECT r, unnest(range(i, i + 50)) AS k FROM g JOIN least USING (gram) WHERE doc_id > least) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(ks, k)), lambda k: ws[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
