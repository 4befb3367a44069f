"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of benchmark items, as word sequences of one
length. Sliding over a document's words, the last two words under the search
position look up a shift: how far every window is from ending in them. Zero leads to
the bucket of windows that end so, and a direct comparison of all words confirms
one. Items of fewer words than a window are patterns of their own length.

Null and empty texts have no words. Items without words give no windows; rows
with the same item_id count once; a null item_id marks words as hit but is not listed.
Every row of documents gives one row, repeated rows too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, lower_ascii, named, texts_of, unused, written

#: Over UTF-8 bytes: every byte of a character beyond ASCII is a word's.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Benchmark text in one pass over the documents; more text takes more passes.
PASS_CHARS = 2_000_000


class Windows:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key, far = words[end - self.block : end], length - end
                self.shift[key] = min(far, self.shift.get(key, self.most))
            self.bucket.setdefault(words[-self.block :], {})[words] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """The start of each occurrence, with the items it belongs to."""
        shift, most, length, n, i = self.shift.get, self.most, self.length, len(words), self.length
        if self.block == 1:
            for i, w in enumerate(words):
                if (w,) in self.bucket:
                    yield i, self.bucket[(w,)][(w,)]
            return
        while i <= n:
            far = shift((words[i - 2], words[i - 1]), most)
            if far:
                i += far
                continue
            items = self.bucket[(words[i - 2], words[i - 1])].get(tuple(words[i - length : i]))
            if items is not None:
                yield i - length, items
            i += 1


def windows(rows: list[tuple], window: int = WINDOW) -> list[Windows]:
    """Tables for (item id as text or None, item text) rows, one for each pattern length."""
    by_length: dict[int, dict] = {}
    for item, text in rows:
        words = WORD.findall(lower_ascii(text or ""))
        length = min(window, len(words))
        table, own = by_length.setdefault(length, {}) if length else {}, (item,)
        for i in range(len(words) - length + 1) if length else ():
            window_ = tuple(words[i : i + length])
            had = table.get(window_)
            if had is None or had[-1] != item:
                table[window_] = own if had is None else had + own
    return [Windows(length, patterns) for length, patterns in sorted(by_length.items())]


def _passes(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items in lists of about so much text, dealt by their hash; one list is fetched at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    lists = max(1, -(-size // most))
    for k in range(lists):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lists)) == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_chars: int = PASS_CHARS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated.

    Each pass scans the documents for a bounded part of the benchmark; the driver and each task hold
    one at a time. With one pass no row is shuffled. Of several, each writes the hit words and items of the texts that have
    any, under a hash of 128 bits of the text, and these are joined to the documents once.
    """
    rows, (n_words, n_hit, items) = scan(docs.select(id_col, text_col), benchmark, text_col, item_id_col, item_text_col, window, pass_chars)
    return rows.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(n_words).alias("n_words"), F.col(n_hit).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.col(items).alias("items"), (F.col(n_hit) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The documents in which no window occurs, all their columns kept."""
    rows, added = scan(docs, benchmark, text_col, item_id_col, item_text_col, window, pass_chars)
    return rows.where(F.col(added[1]) == 0).drop(*added)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id_col: str, item_text_col: str, window: int, pass_chars: int) -> tuple[DataFrame, list[str]]:
    """docs with its numbers of words and hit words and its items, and those columns' names."""
    parts = _passes(named(benchmark, item_id=item_id_col, text=item_text_col), pass_chars)
    part, more = next(parts), next(parts, None)
    if more is None:
        return _one_pass(docs, part, window, text_col)
    texts, hits = _keyed(named(docs, text=text_col), "text", "k1", "k2"), None
    for part in chain((part, more), parts):
        rows, (_, _, items, spans) = _one_pass(texts, part, window, "text", spans=True)
        new = written(rows.where(F.size(spans) > 0).select("k1", "k2", F.col(spans).alias("spans"), F.col(items).alias("items")))
        hits = new if hits is None else hits.unionByName(new)
    k1, k2, spans, items = unused(docs, "__k1", "__k2", "__spans", "__items")
    hits = hits.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.flatten(F.collect_set("spans")).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(items))
    held = _keyed(docs, text_col, k1, k2).join(hits, [k1, k2], "left")

    def make():
        def work(batch):
            spans_ = batch.column(spans).to_pylist()
            return {"n_words": [len(WORD.findall(lower_ascii(t))) for t in texts_of(batch, text_col)], "n_hit": [covered(s or []) for s in spans_], "items": [i or [] for i in batch.column(items).to_pylist()]}

        return work

    rows, added = add_columns(held, make, {"n_words": "long", "n_hit": "long", "items": "array<string>"})
    return rows.drop(k1, k2, spans, items), added


def _keyed(docs: DataFrame, text_col: str, k1: str, k2: str) -> DataFrame:
    """docs with 128 bits that stand for the text."""
    return docs.withColumns({k1: F.xxhash64(F.col(f"`{text_col}`")), k2: F.xxhash64(F.lit(1), F.col(f"`{text_col}`"))})


def _one_pass(docs: DataFrame, part: list[tuple], window: int, text_col: str, spans: bool = False) -> tuple[DataFrame, list[str]]:
    """docs with numbers of words and hit words, items and, if asked for, spans, and those columns' names."""
    shared = docs.sparkSession.sparkContext.broadcast(part)  # about pass_chars characters and one item

    def make():
        tables = windows(shared.value, window)

        def work(batch):
            out = {"n_words": [], "n_hit": [], "items": [], "spans": []}
            for text in texts_of(batch, text_col):
                words, own, items = WORD.findall(lower_ascii(text)), [], set()
                for table in tables:
                    for start, which in table.search(words):
                        items.update(which)
                        if own and own[-2] <= start <= own[-1]:
                            own[-1] = max(own[-1], start + table.length)
                        else:
                            own += (start, start + table.length)
                out["n_words"].append(len(words))
                out["spans"].append(own)
                out["items"].append(sorted(items - {None}))
                out["n_hit"].append(covered(own))
            return out

        return work

    return add_columns(docs, make, {"n_words": "long", "n_hit": "long", "items": "array<string>"} | ({"spans": "array<int>"} if spans else {}))


def covered(spans: list[int]) -> int:
    """Words in any of the spans, given as starts and ends in turn."""
    total, reach = 0, 0
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total
