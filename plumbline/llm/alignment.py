"""Alignment of two tokenizers over the same texts, in Arrow tables.

Each batch of texts is encoded by both; the ids are list arrays, which are flattened, with
each token's document as parent index. Token bytes are taken from the vocabulary, their lengths
summed up within each document, so a token is known by its document and the byte at which
it ends. An Acero hash join on that key gives the links: pairs of tokens that end together. Links cut a
document's tokens into groups. A second grouping counts the pairs of each document, and each task's
counts are grouped once more and handed to Spark, which adds them up over the corpus.

The counts are then looked up for every document's pairs. They are sent to tasks in blocks of
bounded size; there are at most as many pairs as the product of the vocabularies, however
large the corpus is.

Null and empty texts, and those whose tokens of either kind don't give a space and the text
byte by byte, have no tokens: zeros and an empty digest. Repeated rows are rows of their own and count
twice; tables may be empty. A text of any length is one list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import batched, batched_texts, named, shared_dir, texts_of, written
from plumbline.llm.pieces import KEEP, SHORT, SPACE, Pieces
from plumbline.llm.token_blocks import ChunkEncoder

#: Pairs of ids sent to tasks together, and held by a task before it hands on its counts.
BLOCK_PAIRS = 1 << 21
TASK_PAIRS = 1 << 20
#: Batches after which a task groups its counts.
GROUP_BATCHES = 16


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel(ChunkEncoder):
    """Ids of a space and the text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        sign = byte_of_sign()
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.bytes_of = [bytes(sign[c] for c in name) if all(c in sign for c in name) else name.encode() for name in names]

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.encode([" " + t for t in texts])


class PieceLevel(Pieces):
    """Ids of the text by the sentencepiece library, which puts the space in front; each different unit is encoded once."""

    def __init__(self, path: str):
        super().__init__(path, check=False)
        lib = self.library
        self.bytes_of = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.fresh: dict[str, bytes] = {}
        self.stale: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.fresh) > KEEP:
            self.stale, self.fresh = self.fresh, {}
        wanted = set().union(*cut).difference(self.fresh)
        self.fresh.update((u, self.stale[u]) for u in wanted if u in self.stale)
        new = list(wanted.difference(self.fresh))
        # a unit without a space before it is encoded behind a line break, which no merge crosses
        said = self.library.encode([("\n" + u if u[0] != SPACE else u[1:]).replace(SPACE, " ") for u in new], num_threads=1)
        for u, ids in zip(new, said, strict=True):
            own = [self.library.piece_to_id(SPACE)] if u == SPACE else ids[2:] if u[0] != SPACE else ids
            self.fresh[u] = np.array(own, "<u4").tobytes()
        out = [b"".join([self.fresh[u] for u in units]) for units in cut]
        for u in new:
            if len(u) > SHORT:
                del self.fresh[u]
        return out


def ends_of(values: pa.Array, places: pa.Array | None = None) -> np.ndarray:
    """0 and the running sum of the lengths of values, or of those at the given places."""
    length = pc.binary_length(values)
    length = length if places is None else length.take(places)
    return pc.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int64()), length.cast(pa.int64())])).to_numpy()


class Aligner:
    """Both encoders and the tables that batches are joined with."""

    def __init__(self, tokenizer: str, model: str):
        self.a, self.b = ByteLevel(tokenizer), PieceLevel(model)
        self.bytes = [pa.array(x.bytes_of, pa.large_binary()) for x in (self.a, self.b)]
        self.n_b = len(self.b.bytes_of)
        # the digest's text of each id, within and at the end of a group
        signs = [(f"{i},", f"{i}{end}") for vocabulary, end in ((self.a, "|"), (self.b, ";")) for i in range(len(vocabulary.bytes_of))]
        self.signs = pa.array([s.encode() for pair in signs for s in pair], pa.large_binary())
        self.signs_b = 2 * len(self.a.bytes_of)

    @staticmethod
    def lists(encoded: list[bytes]) -> pa.LargeListArray:
        starts = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])])
        return pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))

    def faithful(self, side: int, lists: pa.LargeListArray, texts: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes, joined, are the text, of which there is more than the space."""
        taken = self.bytes[side].take(pc.list_flatten(lists))
        at = ends_of(taken)[lists.offsets.to_numpy()].tolist()
        data = memoryview(taken.buffers()[2] or b"").cast("B")
        return np.array([len(t) > 1 and data[i:j] == t for t, i, j in zip(texts, at, at[1:], strict=False)], bool)

    def ends(self, side: int, lists: pa.LargeListArray, base: np.ndarray) -> pa.Table:
        """A row for each token: its place, document and id, and where it ends: a key that no other document has."""
        ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        total = ends_of(self.bytes[side], ids)
        first = total[lists.offsets.to_numpy()[:-1]] - base
        return pa.table({"end": total[1:] - first[doc.to_numpy()], "doc": doc, "id": ids, "place": np.arange(len(ids))})

    def align(self, texts: list[str]) -> dict[str, pa.Array]:
        """For each text: n_a, n_b, n_groups, n_links, groups_sha256, and its different pairs with their numbers."""
        raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        encoded = [self.a.ids(texts), self.b.ids(texts)]
        good = np.logical_and(*(self.faithful(k, self.lists(e), raw) for k, e in enumerate(encoded)))
        lists = [self.lists([x if g else b"" for x, g in zip(e, good, strict=True)]) for e in encoded]
        base = np.concatenate([[0], np.cumsum([len(r) for r in raw])])[:-1]
        a, b = (self.ends(k, own, base) for k, own in enumerate(lists))
        links = a.join(b.drop_columns("doc"), "end", join_type="inner", right_suffix="_b", use_threads=False).sort_by("end")
        doc = links.column("doc").to_numpy()
        n_links = np.bincount(doc, minlength=len(texts))
        size = [np.diff(own.offsets.to_numpy()) for own in lists]
        pairs = pa.table({"doc": links.column("doc"), "pair": links.column("id").to_numpy().astype(np.int64) * self.n_b + links.column("id_b").to_numpy()})
        pairs = pairs.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
        offsets = pa.array(np.searchsorted(pairs.column("doc").to_numpy(), np.arange(len(texts) + 1)), pa.int32())
        return {
            "n_a": pa.array(size[0]), "n_b": pa.array(size[1]), "n_groups": pa.array(n_links), "n_links": pa.array(n_links),
            "groups_sha256": pa.array(self.digests(a, b, links, size)),
            "pairs": pa.ListArray.from_arrays(offsets, pairs.column("pair").combine_chunks()),
            "times": pa.ListArray.from_arrays(offsets, pairs.column("count_all").combine_chunks()),
        }

    def digests(self, a: pa.Table, b: pa.Table, links: pa.Table, size: list[np.ndarray]) -> list[str]:
        """Sha256 of each document's groups as text. A group ends with the tokens of a link."""
        last = [links.column(c).to_numpy() for c in ("place", "place_b")]
        ends = [np.zeros(len(t), np.int64) for t in (a, b)]
        for e, at in zip(ends, last, strict=True):
            e[at] = 1
        group = [np.cumsum(e) - e for e in ends]
        out = np.zeros(len(a) + len(b), np.int64)
        # a token comes after those of its own kind and the other kind's of the groups before, or of its own group too
        before = np.concatenate([[0], last[1] + 1])
        out[np.arange(len(a)) + before[group[0]]] = 2 * a.column("id").to_numpy() + ends[0]
        out[np.arange(len(b)) + last[0][group[1]] + 1] = self.signs_b + 2 * b.column("id").to_numpy() + ends[1]
        text = self.signs.take(pa.array(out))
        at = np.concatenate([[0], np.cumsum(size[0] + size[1])])
        offsets = ends_of(text)[at].tolist()
        data = memoryview(text.buffers()[2] or b"").cast("B")
        return [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(offsets, offsets[1:], strict=False)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(tokenizer: str, model: str) -> Aligner:
    """The worker's own, kept from task to task."""
    if (tokenizer, model) not in _aligners:
        _aligners[tokenizer, model] = Aligner(tokenizer, model)
    return _aligners[tokenizer, model]


def write_alignment(docs: DataFrame, folder: str, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text", task_pairs: int = TASK_PAIRS) -> int:
    """Writes a row for each document, and rows (row = null) of each task's counts. Returns the number of B's ids.

    pairs are A's id times that number plus B's id, in an int where that can hold them.
    """
    own = aligner(tokenizer, model)
    n_b, kind = own.n_b, "int" if own.n_b * len(own.a.bytes_of) < 1 << 31 else "long"
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<long>"
    arrow = pa.list_(pa.int32() if kind == "int" else pa.int64())
    names = [field.split()[0] for field in schema.split(", ")]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        work, row = aligner(tokenizer, model), TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []

        def grouped() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        def counts() -> pa.RecordBatch:
            table = grouped().combine_chunks()
            whole = pa.array([0, len(table)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, table.column(c).combine_chunks()) for c in ("pair", "n")]
            empty = [pa.nulls(1, pa.int64())] * 6 + [pa.nulls(1, pa.string())]
            return pa.RecordBatch.from_arrays([*empty, lists[0].cast(arrow), lists[1]], names)

        for batch in batched_texts(it):
            out = work.align(texts_of(batch))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            held.append(pa.table({"pair": out["pairs"].flatten(), "n": out["times"].flatten()}))
            out["pairs"] = out["pairs"].cast(arrow)
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id").cast(pa.int64()), *(out[n].cast(pa.int64()) if n[:2] == "n_" else out[n] for n in names[2:])], names)
            if len(held) >= GROUP_BATCHES:
                held = [grouped()]
                if len(held[0]) >= task_pairs:
                    yield counts()
                    held = []
        if held:
            yield counts()

    named(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return n_b


def pair_counts(spark: SparkSession, folder: str, n_b: int) -> DataFrame:
    """pair, n, best: how many links of the corpus hold each pair, and whether no pair of its B id has more."""
    parts = spark.read.parquet(folder).where("row IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = parts.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    # a B id has at most as many pairs as the other vocabulary has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % n_b)))


def align_tokens(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    n_b = write_alignment(docs, folder, tokenizer, model, id_col, text_col)
    rows = spark.read.parquet(folder).where("row IS NOT NULL")
    counts = written(pair_counts(spark, folder, n_b))
    blocks = max(1, -(-counts.count() // block_pairs))
    parts = []
    for block in range(blocks):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).toArrow()  # block_pairs rows, about
        order = pc.sort_indices(own.column("pair"))
        shared = spark.sparkContext.broadcast(tuple(own.column(c).take(order).to_numpy() for c in ("pair", "n", "best")))
        parts.append(_sums(rows, shared, whole=blocks == 1))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if blocks == 1:
        return parts[0].select(columns)
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row").select(columns)


def _sums(rows: DataFrame, shared, whole: bool) -> DataFrame:
    """row, n_best and count_sum over the pairs of one block of counts; whole: with all columns but the pairs."""
    kept = [c for c in rows.columns if c not in ("pairs", "times")] if whole else ["row"]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batched(it):
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            mine = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
            hit = times * (pair[at] == mine) if len(pair) else times * 0
            doc = pc.list_parent_indices(lists).to_numpy()
            sums = np.zeros((2, batch.num_rows), np.int64)
            if len(pair):
                np.add.at(sums[0], doc, hit * best[at])
                np.add.at(sums[1], doc, hit * n[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums[0]), pa.array(sums[1])], [*kept, "n_best", "count_sum"])

    schema = rows.select(kept).schema.add("n_best", "long").add("count_sum", "long")
    return rows.select(*kept, *(c for c in ("pairs", "times"))).mapInArrow(run, schema)
