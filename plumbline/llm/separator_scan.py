"""Token counts of documents in flat, unindexed token files.

A flat file holds little-endian token ids of two or four bytes and nothing else; a
document is what ends with the end-of-document id. Files are slices of one stream, in the order of
their names, and may be cut anywhere: a document may run over blocks and files.

Each file is searched a block at a time for the end id. A prefix scan over the blocks (a running
sum of ends, a running maximum of the last end's place) tells each block which document it begins in and where
that began. A second scan, over one row a file, does the same for files. What was
found is written once as places of ends, four or eight bytes a document; tokens are read once.

Null and empty texts are the end id alone. Repeated rows are documents of their own. Empty
tables, folders without files and empty files have no documents. Tokens after the last end are
a document with ended = false. A file whose length isn't a multiple of the width is an
error. A file is read whole by one task, so Spark's limit of 2 GB a file holds; write_flat keeps
files below that by their number of documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import batched, named, shared_dir, texts_of, written
from plumbline.llm.token_blocks import encoder

#: Tokens searched together, and documents a file that is written.
BLOCK = 1 << 16
FILE_DOCS = 16_384
FOUND = "file string, block int, n_tokens long, docs_before long, end_before long, ends array<long>"


def end_outside(tokenizer: str) -> int:
    """An end id that no text can hold: the first beyond the vocabulary."""
    return encoder(tokenizer).library.get_vocab_size()


def width_of(end_id: int) -> int:
    """Bytes a token if no id is above the end id."""
    return 2 if end_id < 1 << 16 else 4


def write_flat(docs: DataFrame, folder: str, tokenizer: str, text_col: str = "text", end_id: int | None = None, width: int | None = None) -> None:
    """Writes the ids of all documents as flat files, in the order that docs has them; nothing is shuffled.

    The end id is what the text writer puts after each row, in place of a line feed.
    """
    end_id = end_outside(tokenizer) if end_id is None else end_id
    width = width or width_of(max(end_id, end_outside(tokenizer) - 1))
    kind = f"<u{width}"

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer)
        for batch in batched(it):
            yield pa.RecordBatch.from_pydict({"ids": pa.array([np.frombuffer(ids, "<u4").astype(kind).tobytes() for ids in work.encode(texts_of(batch))], pa.binary())})

    rows = named(docs, text=text_col).mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    end = int(end_id).to_bytes(width, "little").decode("latin-1")
    rows.write.mode("overwrite").option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_DOCS).text(folder)


def find_ends(data: bytes, end_id: int, width: int, block: int = BLOCK) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """For each block of a file: its number and tokens, ends before it, the last end's place before it (-1: none), places of its ends."""
    if len(data) % width:
        raise ValueError(f"{len(data)} bytes are no whole number of {width}-byte tokens")
    ids = np.frombuffer(data, f"<u{width}")
    starts = range(0, len(ids), block)
    ends = [np.flatnonzero(ids[a : a + block] == end_id) + a for a in starts]
    counts = np.cumsum([0] + [len(e) for e in ends])
    last = np.maximum.accumulate([-1] + [int(e[-1]) if len(e) else -1 for e in ends])
    for k, a in enumerate(starts):
        yield k, min(block, len(ids) - a), int(counts[k]), int(last[k]), ends[k]


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc (its place in the stream, from 0), file (where it ends), start (tokens of the stream before it), n_tokens (with the end id), ended."""
    width = width or width_of(end_id)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(it, 1):
            file = batch.column("path")[0].as_py()
            for k, n, docs, last, ends in find_ends(batch.column("content")[0].as_buffer(), end_id, width, block):
                yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([k], pa.int32()), "n_tokens": [n], "docs_before": [docs], "end_before": [last], "ends": pa.array([ends], pa.list_(pa.int64()))})

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = written(files.mapInArrow(run, FOUND))
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.sum(F.size("ends")).alias("docs"), F.max(F.array_max("ends")).alias("last"))
    # one row a file, as many as Spark's own list of the files has; the order is by name, longer names later
    scan, tokens, docs, end = [], 0, 0, -1
    for r in sorted(sums.collect(), key=lambda r: (len(r["file"]), r["file"])):
        scan.append((r["file"], tokens, docs, end))
        end = end if r["last"] is None else tokens + r["last"]
        tokens, docs = tokens + r["n"], docs + r["docs"]
    bases = spark.createDataFrame(scan, "file string, tokens long, docs long, carry long")
    before = F.when(F.col("end_before") < 0, F.col("carry")).otherwise(F.col("tokens") + F.col("end_before"))
    each = found.where(F.size("ends") > 0).join(bases, "file").select("file", "tokens", (F.col("docs") + F.col("docs_before")).alias("first"), before.alias("before"), "ends", F.posexplode("ends").alias("at", "end"))
    start = F.when(F.col("at") == 0, F.col("before")).otherwise(F.col("tokens") + F.get("ends", F.col("at") - 1)) + 1
    out = each.select((F.col("first") + F.col("at")).alias("doc"), "file", start.alias("start"), (F.col("tokens") + F.col("end") + 1 - start).alias("n_tokens"), F.lit(True).alias("ended"))
    if tokens > end + 1:
        out = out.unionByName(spark.createDataFrame([(docs, scan[-1][0], end + 1, tokens - end - 1, False)], out.schema))
    return out


def document_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes flat token files of all documents and counts the tokens in them by their ends."""
    folder, end_id = folder or shared_dir(docs.sparkSession), end_outside(tokenizer)
    write_flat(docs, folder, tokenizer, end_id=end_id)
    return count_tokens(docs.sparkSession, folder, end_id).withColumn("file", F.element_at(F.split("file", "/"), -1))
