"""Token ids in patched frame-of-reference blocks.

A shard is a run of segments; a segment holds the ids of whole documents in
ascending doc_id order, cut into blocks of a fixed length. Each block stores its
minimum, the differences from it at a width chosen by percentile, and a list
of exceptions for the differences that don't fit. An index of block starts makes
any block readable alone.

Segments are rows of a Parquet table, so any store that Spark reaches can hold
them and a lost executor's shard is written again by Spark's commit protocol.

Null texts are empty; an empty text is the end id alone. Repeated rows are kept,
ordered by id. Null ids come first. Empty tables give an empty table of segments.
A document is never cut: one text's ids have to fit a Parquet binary cell (2 GB).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched, named, partitions, shared_dir, texts_of

BLOCK = 512
SEGMENT_TOKENS = 1 << 18
PERCENTILES = (0.75, 0.9, 0.95, 0.99, 1.0)
HEAD = struct.Struct("<4sHHII")
MAGIC = b"PFR1"
#: Bits that each 16-bit number takes.
LENGTH = np.array([0] + [k for k in range(1, 17) for _ in range(1 << (k - 1))], np.uint8)

SEGMENTS = "shard int, segment int, first_token long, doc_ids array<long>, doc_tokens array<int>, payload binary"


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment: header, block index, packed differences, exceptions."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return HEAD.pack(MAGIC, 1, block, 0, 0)
    values = np.empty(blocks * block, np.uint32)
    values[:n] = ids
    values[n:] = ids[-1]
    values = values.reshape(blocks, block)
    low = values.min(axis=1)
    values -= low[:, None]
    bits = LENGTH[values & 0xFFFF]
    if values.max() > 0xFFFF:
        high = values >> 16
        bits = np.where(high > 0, 16 + LENGTH[high], bits)
    # how many values of a block need at most w bits, for each w
    fits = np.stack([(bits <= w).sum(axis=1) for w in range(int(bits.max()) + 1)], axis=1)
    cost = np.full(blocks, np.iinfo(np.int64).max)
    width = np.zeros(blocks, np.uint8)
    for share in PERCENTILES:
        w = (fits >= int(np.ceil(share * block))).argmax(axis=1)
        c = w * block // 8 + 6 * (block - fits[np.arange(blocks), w])
        better = c < cost
        cost[better], width[better] = c[better], w[better]
    size = width.astype(np.int64) * block // 8
    start = np.concatenate([[0], np.cumsum(size)])
    packed = np.zeros(start[-1], np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            if w == 16:  # whole bytes are copied as they are
                packed[start[rows][:, None] + np.arange(size[rows[0]])] = (values[rows] & 0xFFFF).astype("<u2").view(np.uint8)
                continue
            part = np.unpackbits(values[rows].view(np.uint8).reshape(len(rows), block, 4)[:, :, : -(-int(w) // 8)], axis=2, bitorder="little")[:, :, :w]
            packed[start[rows][:, None] + np.arange(size[rows[0]])] = np.packbits(part.reshape(len(rows), -1), axis=1, bitorder="little")
    row, column = np.nonzero(bits > width[:, None])
    patches = np.bincount(row, minlength=blocks)
    return b"".join(
        (
            HEAD.pack(MAGIC, 1, block, n, len(row)),
            start.astype("<u4").tobytes(),
            np.concatenate([[0], np.cumsum(patches)]).astype("<u4").tobytes(),
            low.astype("<u4").tobytes(),
            width.tobytes(),
            packed.tobytes(),
            column.astype("<u2").tobytes(),
            values[row, column].astype("<u4").tobytes(),
        )
    )


class Segment:
    """A view of packed bytes; block() reads one block through the index."""

    def __init__(self, data: bytes):
        magic, version, self.block_size, self.n, exceptions = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a segment of token blocks")
        self.blocks = -(-self.n // self.block_size)
        at = HEAD.size
        parts = []
        for kind, count in (("<u4", self.blocks + 1), ("<u4", self.blocks + 1), ("<u4", self.blocks), ("u1", self.blocks)):
            count *= bool(self.blocks)
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.start, self.patch, self.low, self.width = parts
        size = int(self.start[-1]) if self.blocks else 0
        self.packed = np.frombuffer(data, np.uint8, size, at)
        self.column = np.frombuffer(data, "<u2", exceptions, at + size)
        self.value = np.frombuffer(data, "<u4", exceptions, at + size + 2 * exceptions)

    def _read(self, rows: np.ndarray) -> np.ndarray:
        size = self.block_size
        out = np.zeros((len(rows), size), np.uint32)
        for w in np.unique(self.width[rows]):
            if w:
                mine = np.flatnonzero(self.width[rows] == w)
                raw = self.packed[self.start[rows[mine]].astype(np.int64)[:, None] + np.arange(int(w) * size // 8)]
                if w == 16:
                    out[mine] = raw.view("<u2")
                    continue
                bits = np.zeros((len(mine), size, 16 if w <= 16 else 32), np.uint8)
                bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(mine), size, w)
                out[mine] = np.packbits(bits, axis=2, bitorder="little").view("<u2" if w <= 16 else "<u4")[:, :, 0]
        for i, k in enumerate(rows) if len(rows) == 1 else ():
            lo, hi = self.patch[k], self.patch[k + 1]
            out[i, self.column[lo:hi]] = self.value[lo:hi]
        if len(rows) > 1:
            out[np.repeat(np.arange(self.blocks), np.diff(self.patch)), self.column] = self.value
        return out + self.low[rows][:, None]

    def block(self, k: int) -> np.ndarray:
        """The ids of block k alone."""
        return self._read(np.array([k]))[0][: self.n - k * self.block_size]

    def ids(self) -> np.ndarray:
        if not self.blocks:
            return np.zeros(0, np.uint32)
        return self._read(np.arange(self.blocks)).reshape(-1)[: self.n]


class ChunkEncoder:
    """The ids of whole texts, encoding each different chunk once.

    The byte-level pre-tokeniser always starts a token at a space before a
    non-space, so the library gives a text's ids as those of the chunks between such
    places, in order. Chunks are kept, without their space, in two generations of bounded size.
    """

    CUT = re.compile(r" (?=\S)")
    # Python's white space but for the space itself.
    SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    ODD = [" " + c for c in " " + SPACE]
    PLAIN = re.compile(r"[^\s<]+")

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(self.library.get_vocab_size())])
        self.keep, self.young, self.old = keep, {}, {}

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks, each behind a space; those of one word together as one text, where tokens with a space begin the chunks."""
        plain = [c for c in chunks if self.PLAIN.fullmatch(c)]
        parts = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        for part, e in zip(parts, self.library.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part):
                raw, cut = ids.tobytes(), (4 * starts).tolist() + [4 * len(ids)]
                self.young.update(zip(part, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
        rest = [c for c in chunks if c not in self.young]
        self.young.update(zip(rest, self._each([" " + c for c in rest]), strict=True))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str) -> list[str]:
        """As CUT.split: at any space if none is at the end or before more white space, as is the rule."""
        odd = self.ODD[:10] if text.isascii() else self.ODD
        if text.endswith(" ") or any(map(text.__contains__, odd)):
            return self.CUT.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.cut(t) for t in texts]
        first = self._each([chunks.pop(0) for chunks in cut])  # the only chunks without a space in front
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        new = set().union(*cut).difference(self.young)
        if self.old:
            self.young.update((c, self.old[c]) for c in new if c in self.old)
            new = new.difference(self.young)
        self._learn(list(new))
        get = self.young.__getitem__
        return [f + b"".join(map(get, chunks)) for f, chunks in zip(first, cut, strict=True)]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's own encoder: a reused Python worker keeps its chunks from task to task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Writes the ids of all documents to folder, one shard a range of doc_ids.

    The ranges come from Spark's sampled range partitioner, so shards are in
    ascending order and even in rows however the ids are spread.
    """
    ordered = named(docs, doc_id=id_col, text=text_col).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        work, segment, first = encoder(tokenizer), 0, 0
        doc_ids, counts, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "first_token": pa.array([first], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "doc_tokens": pa.array([counts], pa.list_(pa.int32())), "payload": pa.array([payload], pa.binary())}
            )

        for batch in batched(it):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), work.encode(texts_of(batch)), strict=True):
                held.append(ids + end)
                doc_ids.append(doc_id)
                counts.append(len(held[-1]) // 4)
                size += counts[-1]
                if size >= segment_tokens:
                    yield flush()
                    segment, first = segment + 1, first + size
                    doc_ids, counts, held, size = [], [], [], 0
        if doc_ids:
            yield flush()

    ordered.mapInArrow(run, SEGMENTS).write.mode("overwrite").option("compression", "none").parquet(folder)


def read_tokens(spark, folder: str) -> DataFrame:
    """The documents of a folder of token files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids binary", lambda ids: {"ids": pa.array([i.tobytes() for i in ids], pa.binary())})


def token_checksums(spark, folder: str) -> DataFrame:
    """As read_tokens, with ids_crc32, the unsigned crc32 of the ids' bytes, in place of the ids."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: {"ids_crc32": pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())})


def _read(spark, folder: str, schema: str, last) -> DataFrame:
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    # one number for each shard; shards are as many as the write's partitions, whatever the corpus holds
    size = segments.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    base, total = {}, 0
    for row in sorted(size.collect()):
        base[row["shard"]], total = total, total + row["n"]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(it, 1):
            counts = np.array(batch.column("doc_tokens")[0].as_py(), np.int64)
            ends = np.cumsum(counts)
            first = base[batch.column("shard")[0].as_py()] + batch.column("first_token")[0].as_py()
            ids = Segment(batch.column("payload")[0].as_py()).ids().astype("<u4", copy=False)
            columns = {"doc_id": batch.column("doc_ids")[0].values, "start": pa.array(first + ends - counts), "n_tokens": pa.array(counts)}
            yield pa.RecordBatch.from_pydict(columns | last([ids[a:b] for a, b in zip(ends - counts, ends, strict=True)]))

    return segments.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or shared_dir(docs.sparkSession)
    write_tokens(docs, folder, tokenizer, **options)
    return token_checksums(docs.sparkSession, folder)
