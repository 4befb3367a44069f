"""Ranked lexical search over an index that is stratified by document length.

A document's length enters its score only through a whole number m, its normaliser. The
index is made of segments, one after another from each reading task, and a segment groups its
documents into strata of equal m. A term's postings in a segment are runs: stratum after
stratum, and within a stratum one run for each term frequency, the highest first. All
documents of a run have the same impact, which is computed once.

A search takes the items in blocks. The runs of a block's terms are dealt by segment.
In a segment the first run of each term in a stratum bounds what the term can add there, so the
sum of these bounds an item's score in the stratum. Strata are visited from the highest bound
down, until a bound is below the lowest of the best scores that the task has found so far,
in any segment. Nothing that could be among the best is left out.

Null texts and texts without terms are in no stratum and don't count. Repeated rows are
documents of their own, with the same id. A null doc_id sorts first among equal scores; the id -2^63 is read as
null. Items that are null or without known terms give no rows; repeated items each give theirs.
Empty tables give an empty result. A text of any length has one posting a different term.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import batched, batched_texts, lower_ascii, named, partitions, shared_dir, texts_of

#: Over UTF-8 bytes, of which all beyond ASCII belong to terms.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
IN_TERM = np.array([bool(TERM.fullmatch(bytes([b]))) for b in range(256)])
#: Terms, with repeats, after which a segment is closed; it bounds what a task holds.
SEGMENT_TERMS = 1 << 21
#: Terms of items, with repeats, in one block of a search.
BLOCK_TERMS = 1 << 17
NO_ID = -(1 << 63)

#: A segment's first row has no term: m and ids of its documents, by (m, id). In the others docs are places in that list.
INDEX = "segment long, term string, df int, m array<long>, tf array<int>, n array<int>, docs array<int>, ids array<long>"
EACH = ["m", "tf", "n", "docs", "ids"]


def count_terms(texts: pa.StringArray) -> np.ndarray:
    """Terms of each text, from the Arrow buffers."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    inside = IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = (ends[:-1] - ends[0])[ends[1:] > ends[:-1]]
    begins[first] = inside[first]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[ends - ends[0]])


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched_texts(it):
            n = count_terms(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"docs": [int((n > 0).sum())], "terms": [int(n.sum())]})

    row = named(docs, text=text_col).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def segment_rows(segment: int, ids: list[int], n_terms: list[int], codes: list[np.ndarray], vocabulary: list[bytes], docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of one segment. ids, n_terms, codes: of each document; docs, terms: the corpus's size."""
    n = np.array(n_terms, np.int64)
    m = 100 - 75 + 75 * n * docs // terms
    ids = np.array(ids, np.int64)
    order = np.lexsort((ids, m))
    place = np.empty(len(m), np.int64)
    place[order] = np.arange(len(m))
    m, ids = m[order], ids[order]
    strata, stratum = np.unique(m, return_inverse=True)

    posting, tf = np.unique(np.concatenate(codes).astype(np.int64) * len(m) + np.repeat(place, n), return_counts=True)
    term, doc = np.divmod(posting, len(m))
    most = int(tf.max()) + 1
    run = (term * len(strata) + stratum[doc]) * most + (most - 1 - tf)
    by_run = np.argsort(run, kind="stable")
    run, term, doc, tf = run[by_run], term[by_run], doc[by_run], tf[by_run]
    first = np.flatnonzero(np.diff(run, prepend=-1))
    runs_from = np.searchsorted(term[first], np.arange(len(vocabulary) + 1)).astype(np.int32)
    docs_from = np.searchsorted(term, np.arange(len(vocabulary) + 1)).astype(np.int32)

    def lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))

    def rows(term: pa.Array, df: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(term), segment)), term, pa.array(df, pa.int32()), *columns], ["segment", "term", "df", *EACH])

    none, whole = np.zeros(0, np.int32), [0, len(m)]
    yield rows(pa.array([None], pa.string()), [0], lists(whole, m, pa.int64()), *(lists([0, 0], none, pa.int32()) for _ in range(3)), lists(whole, ids, pa.int64()))
    yield rows(
        pa.array(vocabulary, pa.binary()).cast(pa.string()), np.diff(docs_from), lists(runs_from, m[doc[first]], pa.int64()), lists(runs_from, tf[first], pa.int32()),
        lists(runs_from, np.diff(first, append=len(run)), pa.int32()), lists(docs_from, doc, pa.int32()), lists(np.zeros(len(vocabulary) + 1), none, pa.int64()),
    )


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", segment_terms: int = SEGMENT_TERMS) -> None:
    """Writes the index of all documents to folder; no row is shuffled."""
    n_docs, n_terms = corpus_size(docs, text_col)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        ids, sizes, codes, held, vocabulary = [], [], [], 0, defaultdict(count().__next__)

        def flush() -> Iterator[pa.RecordBatch]:
            for rows in segment_rows(segment, ids, sizes, codes, list(vocabulary), n_docs, n_terms):
                yield from batched([rows], 20_000)

        for batch in batched_texts(it):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if not (words := TERM.findall(lower_ascii(text))):
                    continue
                ids.append(NO_ID if doc_id is None else doc_id)
                sizes.append(len(words))
                codes.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                held += len(words)
                if held >= segment_terms:
                    yield from flush()
                    segment += 1
                    ids, sizes, codes, held, vocabulary = [], [], [], 0, defaultdict(count().__next__)
        if ids:
            yield from flush()

    named(docs, doc_id=id_col, text=text_col).mapInArrow(run, INDEX).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


class Segment:
    """The runs of some terms in one segment, with a bound for each term in each stratum."""

    def __init__(self, rows: pa.Table, weights: dict[str, int]):
        head = rows.slice(0, 1)
        self.ids, m = (head.column(c).combine_chunks().values.to_numpy() for c in ("ids", "m"))
        self.strata = np.unique(m)
        rows = rows.slice(1)
        terms = rows.column("term").to_pylist()
        self.term = {t: k for k, t in enumerate(terms)}
        column = {c: rows.column(c).combine_chunks() for c in ("m", "tf", "n", "docs")}
        m, tf, n, self.docs = (c.flatten().to_numpy() for c in column.values())
        runs = np.diff(column["m"].offsets.to_numpy())
        term = np.repeat(np.arange(len(terms)), runs)
        stratum = np.searchsorted(self.strata, m)
        value = np.array([weights[t] for t in terms], np.int64)[term] * impact(tf, m)
        self.value = np.repeat(value, n)
        # a group: a term's runs in one stratum, of which the first has the highest impact
        first = np.flatnonzero(np.diff(term * len(self.strata) + stratum, prepend=-1))
        begin = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        self.stratum, self.bound, self.start = stratum[first], value[first], begin[first]
        self.length = np.diff(self.start, append=begin[-1])
        self.groups = np.searchsorted(term[first], np.arange(len(terms) + 1))

    def best(self, item: dict[str, int], k: int, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of this segment's documents and those given, by score, then id."""
        own = [(self.term[t], times) for t, times in item.items() if t in self.term]
        if not own:
            return score, ids
        which, times = np.array([o[0] for o in own]), np.array([o[1] for o in own], np.int64)
        size = self.groups[which + 1] - self.groups[which]
        group, times = _ranges(self.groups[which], size), np.repeat(times, size)
        stratum, bound = self.stratum[group], np.zeros(len(self.strata), np.int64)
        np.add.at(bound, stratum, times * self.bound[group])
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], 0)]  # bounds above zero
        at, step = 0, 4
        while at < len(order):
            least = score[-1] if len(score) == k else 1
            at_most = np.searchsorted(-bound[order], -least, side="right")  # strata that may hold one as good
            visit = order[at : min(at + step, at_most)]
            if not len(visit):
                break
            visited = np.zeros(len(self.strata), bool)
            visited[visit] = True
            mine = visited[stratum]
            length = self.length[group[mine]]
            posting = _ranges(self.start[group[mine]], length)
            total = np.zeros(len(self.ids), np.int64)
            np.add.at(total, self.docs[posting], np.repeat(times[mine], length) * self.value[posting])
            found = np.flatnonzero(total >= max(least, 1))
            score, ids = np.concatenate([score, total[found]]), np.concatenate([ids, self.ids[found]])
            keep = np.lexsort((ids, -score))[:k]
            score, ids = score[keep], ids[keep]
            at, step = at + step, step * 2
        return score, ids


def _block(index: DataFrame, items: list[tuple], docs: int, k: int) -> DataFrame:
    """item (its number), score, id: the k best of each task for a bounded list of items."""
    spark = index.sparkSession
    parsed = []
    for _, text in items:
        times: dict[str, int] = defaultdict(int)
        for word in TERM.findall(lower_ascii(text or "")):
            times[word.decode("utf-8", "surrogatepass")] += 1
        parsed.append(times)
    # at most BLOCK_TERMS and one item's terms, so small enough to send to every task
    terms = F.broadcast(spark.createDataFrame([(t,) for t in sorted(set().union(*parsed))], "term string"))
    df = index.select("term", "df").join(terms, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weights = {r["term"]: weight(docs, r["df"]) for r in df.collect()}
    shared = spark.sparkContext.broadcast((parsed, weights))
    heads = index.where("term IS NULL")
    wanted = index.join(terms, "term", "left_semi").unionByName(heads)
    dealt = wanted.repartition(partitions(spark), "segment").sortWithinPartitions("segment", F.asc_nulls_first("term"))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed, weights = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in parsed]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            segment = Segment(pa.Table.from_batches(held), weights)
            for i, item in enumerate(parsed):
                best[i] = segment.best(item, k, *best[i])

        for batch in it:
            own = batch.column("segment").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cut, cut[1:], strict=False):
                if held and held[-1].column("segment")[0].as_py() != own[a]:
                    search()
                    held.clear()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            search()
        for i, (score, ids) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_pydict({"item": pa.array(np.full(len(score), i), pa.int32()), "score": pa.array(score), "id": pa.array(ids)})

    return dealt.mapInArrow(run, "item int, score long, id long")


def search(spark: SparkSession, folder: str, items: DataFrame, k: int = 10, item_id_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the index in folder with the highest scores above 0 for each item.

    Items are dealt to blocks of about block_terms terms by their hash; the driver holds one
    block at a time, and each block reads its terms' runs once. Tasks hand on k rows an item.
    """
    index = spark.read.schema(INDEX).parquet(folder)
    docs = index.where("term IS NULL").agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    kind = dict(items.dtypes)[item_id_col]
    items = named(items, item_id=item_id_col, text=item_text_col).where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_terms)))
    out = shared_dir(spark)
    spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long").write.mode("overwrite").parquet(out)
    for block in range(blocks) if docs else ():
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        if not rows:
            continue
        ranked = _block(index, rows, docs, k).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        known = F.broadcast(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {kind}"))
        ranked.join(known, "item").select("item_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score").write.mode("append").parquet(out)
    return spark.read.parquet(out)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", folder: str | None = None, **options) -> DataFrame:
    """Builds the index and searches it for every item."""
    folder = folder or shared_dir(docs.sparkSession)
    build_index(docs, folder, id_col, text_col, **options)
    return search(docs.sparkSession, folder, items, k, item_id_col, item_text_col)
