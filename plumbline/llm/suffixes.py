"""Substring dedup by suffix trees over words, dealt out by variable-length prefixes.

The suffixes of interest begin a window of words. A window's prefix, up to the end of its least
gram (a few words, by their hash; the leftmost of equals), is as long as that gram lies deep in
it, and equal windows have equal prefixes. Suffixes are dealt by the end of this prefix, that gram, so that
consecutive suffixes with the same one travel together as one stretch of words. Grams that lie in one
document only lead to no repeat and are left out before any text moves. A gram with more than
`hot` stretches would not fit a task: its suffixes' prefixes are extended to the whole window, which needs
no tree, only the least document of each, summed up before the shuffle.

A group's tree is built level by level: the nodes at depths 1, 2, 4 and so on are numbered, from the
words, then from pairs of nodes, down to the depth of a window. An internal node so deep is a
repeat: its leaves are all places where the window stands, and each leaf in a document other than the least
of them is marked. Marked windows that follow each other are one span, the maximal repeat.

Words are what stands between ASCII white space. Null and empty texts have none; a text shorter than a
window has no repeats. A null doc_id counts as less than all others. Rows with equal doc_id never
mark each other; repeated rows each get their result. Tables may be empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched_texts, named, partitions, texts_of, written

WINDOW = 50
#: Words in the gram that ends a prefix.
GRAM = 8
#: Stretches that one gram's tree may have.
HOT = 1 << 15
#: Words of whole groups whose trees are built together.
TREE_WORDS = 1 << 20
NO_ID = -(1 << 63)
BATCH = 64
FACTOR = 0x9E3779B97F4A7C15


def words_of(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, one text after another, and how many each has."""
    cut = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(batch)]
    return [w for words in cut for w in words], np.array([len(words) for words in cut], np.int64)


def least_at(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values where its least stands, the leftmost of equals."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


class Stretches:
    """The stretches of texts: gram, first and last window, and document of each, in order of their places."""

    def __init__(self, words: list[bytes], n: np.ndarray, window: int, gram: int):
        gram = min(gram, window)
        self.begin = np.concatenate([[0], np.cumsum(n)])
        total = len(words)
        if total < window:
            self.gram = np.zeros(0, np.int64)
            self.first = self.last = self.doc = np.zeros(0, np.int64)
        else:
            word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, total)
            g = np.zeros(total - gram + 1, np.uint64)
            for k in range(gram):
                g = g * np.uint64(FACTOR) + word[k : total - gram + 1 + k]
            g ^= g >> np.uint64(33)
            g *= np.uint64(FACTOR)
            g ^= g >> np.uint64(29)
            doc = np.repeat(np.arange(len(n)), n)[: total - window + 1]
            starts = np.flatnonzero(np.arange(total - window + 1) + window <= self.begin[doc + 1])
            at = least_at(g, window - gram + 1)[starts]
            run = np.flatnonzero(np.diff(at, prepend=-1))
            self.first, self.last = starts[run], starts[np.append(run[1:], len(starts)) - 1] if len(run) else run
            self.gram, self.doc = g[at[run]].view(np.int64), doc[self.first]
        self.from_ = np.searchsorted(self.doc, np.arange(len(n) + 1))


def nodes(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The node of depth window above the suffix at each start. words: numbers, equal for equal words."""

    def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return pd.factorize(left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right)[0]

    rank, depth = words, 1
    while depth * 2 <= window:
        after = np.zeros(len(rank), np.int64)
        after[:-depth] = rank[depth:] + 1
        rank, depth = pairs(rank, after), depth * 2
    return pairs(rank[starts], rank[starts + window - depth])


def marked_spans(group: pa.Table, window: int) -> pa.RecordBatch:
    """own, print, start, end of the spans that repeats of lesser documents cover in whole groups of stretches."""
    own, at, n = (group.column(c).to_numpy() for c in ("own", "start", "n"))
    lists = pc.split_pattern(group.column("words").combine_chunks(), " ")
    words = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    stretch = np.repeat(np.arange(len(own)), n)
    inside = np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n)
    node = nodes(words, lists.offsets.to_numpy()[:-1][stretch] + inside, window)
    least = np.full(int(node.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, own[stretch])
    marked = np.flatnonzero(own[stretch] > least[node])
    first = np.flatnonzero((np.diff(marked, prepend=-2) != 1) | (np.diff(stretch[marked], prepend=-1) != 0))
    last = marked[np.append(first[1:], len(marked)) - 1] if len(first) else first
    first = marked[first]
    of = pa.array(stretch[first])
    return pa.RecordBatch.from_pydict(
        {"own": group.column("own").take(of).combine_chunks(), "print": group.column("print").take(of).combine_chunks(), "start": pa.array(at[stretch[first]] + inside[first], pa.int32()), "end": pa.array(at[stretch[last]] + inside[last] + window, pa.int32())}
    )


SPANS = "own long, print long, start int, end int"


def trees(stretches: DataFrame, window: int, tree_words: int) -> DataFrame:
    """Spans from stretches: own, print, key, start, n, words."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            held.append(batch)
            size += int(batch.column("n").to_numpy().sum()) + (window - 1) * batch.num_rows
            if size >= tree_words:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield marked_spans(table.slice(0, cut), window)
                    held = table.slice(cut).to_batches()
                    size = int(table.slice(cut).column("n").to_numpy().sum()) + (window - 1) * (len(table) - cut)
        if held:
            yield marked_spans(pa.Table.from_batches(held), window)

    return stretches.repartition(partitions(stretches.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text with a key: own, the id or the least number, and print, a hash of the text, which parts rows of one id."""
    docs = named(docs, doc_id=id_col, text=text_col)
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("own"), F.xxhash64("text").alias("print"))


def scanned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """own, print, doc_id, n_words, words_sha256, grams (of the stretches in order) of each document of keyed()."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched_texts(it, rows=BATCH):
            words, n = words_of(batch)
            own = Stretches(words, n, window, gram)
            cut = own.begin.tolist()
            sha = [hashlib.sha256(b" ".join(words[a:b])).digest() for a, b in zip(cut, cut[1:], strict=False)]
            grams = pa.ListArray.from_arrays(pa.array(own.from_, pa.int32()), pa.array(own.gram))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("own", "print", "doc_id")), pa.array(n), pa.array(sha, pa.binary()), grams], ["own", "print", "doc_id", "n_words", "words_sha256", "grams"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"own long, print long, doc_id {kind}, n_words long, words_sha256 binary, grams array<long>")


def staged(docs: DataFrame, scan: DataFrame, hot: int) -> DataFrame:
    """The documents of keyed() that share a gram with another, with places: twice the number of each such stretch, one more if it's hot."""
    grams = scan.select("own", "print", F.posexplode("grams").alias("k", "gram"))
    shared = grams.groupBy("gram").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.count("*").alias("n"))
    # written, so that the join's sides are shuffles of their own, of which adaptive execution can cut a hot gram's
    shared = written(shared.where("least < most").select("gram", (F.col("n") > hot).cast("int").alias("hot")))
    places = grams.join(shared, "gram").groupBy("own", "print").agg(F.collect_set(F.col("k") * 2 + F.col("hot")).alias("places"))
    return docs.join(places, ["own", "print"])


def cut_stretches(docs: DataFrame, window: int, gram: int, hot: bool) -> DataFrame:
    """The stretches of staged documents, or the whole windows of their hot ones: own, print, start and key with n, words, or a digest as key."""
    names = ["own", "print", "start", "key", *([] if hot else ["n", "words"])]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched_texts(it, rows=BATCH):
            words, n = words_of(batch)
            own = Stretches(words, n, window, gram)
            places = batch.column("places")
            place, doc = pc.list_flatten(places).to_numpy(), pc.list_parent_indices(places).to_numpy()
            mine = place % 2 == hot
            which, doc = own.from_[doc[mine]] + place[mine] // 2, doc[mine]
            first, last = own.first[which], own.last[which]
            if hot:
                doc = np.repeat(doc, last - first + 1)
                first = np.array([i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1)], np.int64)
                columns = [pa.array([hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest() for i in first.tolist()], pa.binary())]
            else:
                texts = [b" ".join(words[a : b + window]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                columns = [pa.array(own.gram[which]), pa.array(last - first + 1, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())]
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("own").take(of), batch.column("print").take(of), pa.array(first - own.begin[doc], pa.int32()), *columns], names)

    schema = "own long, print long, start int, " + ("key binary" if hot else "key long, n int, words string")
    return docs.select("own", "print", "text", "places").mapInArrow(run, schema)


def spans_of(docs: DataFrame, window: int, gram: int, tree_words: int) -> DataFrame:
    """own, print, spans: starts and ends, in turn, of what is repeated from lesser documents in the staged documents."""
    spans = trees(cut_stretches(docs, window, gram, False), window, tree_words)
    whole = cut_stretches(docs.where(F.exists("places", lambda p: p % 2 == 1)), window, gram, True)
    least = whole.groupBy("key").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least < most").select("key", "least")
    hot = whole.join(least, "key").where("own > least").select("own", "print", "start", (F.col("start") + window).alias("end"))
    return spans.unionByName(hot).groupBy("own", "print").agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("spans"))


def removed(n: int, spans: list[int] | None) -> np.ndarray:
    """Whether each of n words is in a span."""
    step = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(step, spans[::2], 1)
        np.add.at(step, spans[1::2], -1)
    return np.cumsum(step)[:n] > 0


def stripped(docs: DataFrame, digest: bool) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, or their sha256, of documents with spans."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched_texts(it, rows=BATCH):
            gone, kept, counts = [], [], []
            for text, spans in zip(texts_of(batch), batch.column("spans").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                out = removed(len(words), spans)
                counts.append(len(words))
                gone.append(int(out.sum()))
                text = b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o] if gone[-1] else words)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text)
            kept = pa.array(kept) if digest else pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), kept], ["doc_id", "n_words", "n_removed", last])

    last = "kept_sha256" if digest else "kept"
    return docs.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, {last} string")


def _parts(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, hot: int, tree_words: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = keyed(docs, id_col, text_col)
    scan = written(scanned(docs, window, gram), codec="zstd")
    shared = written(staged(docs, scan, hot), codec="zstd")
    return docs, scan, shared, spans_of(shared, window, gram, tree_words)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, tree_words: int = TREE_WORDS) -> DataFrame:
    """doc_id, spans (starts and ends of words, in turn; they may overlap) of the documents that have any."""
    _, scan, _, spans = _parts(docs, id_col, text_col, window, gram, hot, tree_words)
    return scan.select("own", "print", "doc_id").join(spans, ["own", "print"]).select("doc_id", "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, tree_words: int = TREE_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) of every document."""
    docs, _, _, spans = _parts(docs, id_col, text_col, window, gram, hot, tree_words)
    return stripped(docs.join(spans, ["own", "print"], "left"), False)


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, tree_words: int = TREE_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; only texts that share a gram are shuffled again."""
    _, scan, shared, spans = _parts(docs, id_col, text_col, window, gram, hot, tree_words)
    alone = scan.join(shared.select("own", "print").distinct(), ["own", "print"], "left_anti")
    alone = alone.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("words_sha256")).alias("kept_sha256"))
    return stripped(shared.join(spans, ["own", "print"], "left"), True).unionByName(alone)
