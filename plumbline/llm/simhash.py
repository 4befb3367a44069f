"""Near-duplicates by SimHash and a binary trie self-join.

A fingerprint has a bit for each position where over half of a text's shingle
hashes have one. Different fingerprints are dealt by exact pieces: two that differ in at most
k bits agree in one of k + 1 pieces. In each deal a binary trie over the
fingerprints is joined with itself: pairs of nodes go down together, collect the bits in which
they differ, and end where these pass k. Groups of equal fingerprints go as one row,
and a deal hands on a forest, not its pairs.

Null and empty texts, and those without words, have fingerprint zero and are linked like
any other. Repeated rows are in one component. Null ids are kept; a component of
null ids alone has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii, map_texts, named, partitions, texts_of, written
from plumbline.llm.graph import components, local_components

BITS = 64
#: A deal of more fingerprints than this is dealt again by pieces of its other bits.
HOT = 20_000
#: Fingerprints joined at a time, and node pairs held at a time, in a task.
ROWS, PAIRS = 1 << 16, 1 << 17


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    words = lower_ascii(text).split()
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, seed=42)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], seed=42) for a, b in zip((ends - lengths).tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The signed fingerprint of shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text's bits are counted in parts
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (long) of each row."""

    def make():
        def work(batch):
            return {"doc_id": batch.column("doc_id"), "fingerprint": [fingerprint(t, shingle) for t in texts_of(batch)]}

        return work

    return map_texts(named(docs, doc_id=id_col, text=text_col), make, "doc_id long, fingerprint long")


def trie_join(values: np.ndarray, group: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose values, unsigned, sorted and different within a group, differ in at most k bits.

    A node is a run of the sorted values with a common prefix; a pair of nodes
    (of one node with itself, first) is split at the next bit.
    """
    begin = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
    end = np.append(begin[1:], len(values))
    many = end - begin > 1
    root = np.stack([begin[many], end[many], begin[many], end[many], np.zeros(many.sum(), np.int64)])
    todo = [(BITS - 1, root)]
    while todo:
        bit, pairs = todo.pop()
        if pairs.shape[1] > PAIRS:  # depth first in parts: memory stays bounded
            todo += [(bit, p) for p in np.array_split(pairs, -(-pairs.shape[1] // PAIRS), axis=1)]
            continue
        lo_a, hi_a, lo_b, hi_b, differ = pairs
        single = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        if single.any():
            a, b = lo_a[single], lo_b[single]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= k)
            yield a[near], b[near]
            lo_a, hi_a, lo_b, hi_b, differ = pairs[:, ~single]
        if not len(lo_a) or bit < 0:
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]) if len(lo_a) > len(values) // 8 else None
        cut_a, cut_b = _cut(values, ones, bit, lo_a, hi_a), _cut(values, ones, bit, lo_b, hi_b)
        same = lo_a == lo_b
        parts = [
            np.stack([lo_a, cut_a, lo_b, cut_b, differ]),
            np.stack([cut_a, hi_a, cut_b, hi_b, differ]),
            np.stack([lo_a, cut_a, cut_b, hi_b, differ + 1]),
            np.stack([cut_a, hi_a, lo_b, cut_b, differ + 1])[:, ~same],
        ]
        new = np.concatenate(parts, axis=1)
        todo.append((bit - 1, new[:, (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= k)]))


def _cut(values: np.ndarray, ones: np.ndarray | None, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where each node's values with the bit set begin."""
    if ones is not None:
        return hi - (ones[hi] - ones[lo])
    low, high, mask = lo.copy(), hi.copy(), np.uint64(1) << np.uint64(bit)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        set_ = (values[np.minimum(mid, len(values) - 1)] & mask) > 0
        high = np.where(open_ & set_, mid, high)
        low = np.where(open_ & ~set_, mid + 1, low)
    return low


def _masks(bits: list[int], parts: int) -> list[tuple[int, list[int]]]:
    """The bits in so many pieces, each with its mask as a signed long."""
    return [(int(np.array([sum(1 << int(b) for b in p)], np.uint64).view(np.int64)[0]), [int(b) for b in p]) for p in np.array_split(bits, parts)]


def near_links(prints: DataFrame, k: int = 2) -> DataFrame:
    """Links (u, v) that connect all different fingerprints that differ in at most k bits."""
    pieces = _masks(list(range(BITS)), k + 1)

    def deal(which: int, masks: list[int], *more: Column) -> Column:
        return F.array(*(F.struct(F.lit(which).alias("piece"), F.xxhash64(F.lit(which), *more, F.lit(j), F.col("fingerprint").bitwiseAND(F.lit(m))).alias("bucket")) for j, m in enumerate(masks)))

    first = prints.select("fingerprint", F.explode(F.concat(*(deal(s, [m]) for s, (m, _) in enumerate(pieces)))).alias("d")).select("fingerprint", "d.piece", "d.bucket")
    first = first.withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    again = F.lit(None).cast("array<struct<piece:int,bucket:bigint>>")
    for s, (_, own) in enumerate(pieces):
        others = [b for b in range(BITS) if b not in own]
        again = F.when(F.col("piece") == s, deal(s, [m for m, _ in _masks(others, k + 1)], F.col("bucket"))).otherwise(again)
    hot = first.where(F.col("n") > HOT).select("fingerprint", F.explode(again).alias("d")).select("fingerprint", "d.piece", "d.bucket")
    dealt = first.where((F.col("n") > 1) & (F.col("n") <= HOT)).select("fingerprint", "piece", "bucket").unionByName(hot)

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, piece = table.column("bucket").to_numpy(), table.column("piece").to_numpy()
        own = table.column("fingerprint").to_numpy().view(np.uint64)
        # rotated left, so that the piece which a bucket shares goes to the trie's end, where no branch is left
        top = np.array([max(bits) for _, bits in pieces], np.uint64)[piece]
        by = (np.uint64(63) - top + np.array([len(bits) for _, bits in pieces], np.uint64)[piece]) % np.uint64(64)
        turned = np.where(by == 0, own, (own << by) | (own >> ((np.uint64(64) - by) % np.uint64(64))))
        order = np.lexsort((turned, bucket))
        links = list(trie_join(turned[order], bucket[order], k))
        if links:
            u, v = (np.concatenate(x) for x in zip(*links, strict=True))
            root = local_components(len(own), u, v)
            held = np.flatnonzero(root != np.arange(len(own)))
            signed = own[order].view(np.int64)
            yield pa.RecordBatch.from_pydict({"u": signed[held], "v": signed[root[held]]})

    n = partitions(prints.sparkSession)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(join, ROWS), "u long, v long").distinct()


def _by_bucket(join, rows: int):
    """join over tables of whole buckets, of about so many rows, from rows sorted by bucket."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in it:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                bucket = table.column("bucket").to_numpy()
                whole = int(np.flatnonzero(bucket == bucket[-1])[0])  # the last bucket may go on
                if whole:
                    yield from join(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), len(bucket) - whole
        if held:
            yield from join(pa.Table.from_batches(held))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 2) -> DataFrame:
    """doc_id, fingerprint (long), component_id (the least doc_id that links reach) of each row."""
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(prints, k))
    placed = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named_prints = placed.join(least, "root").select("fingerprint", "component_id")
    return rows.join(named_prints, "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = 0.8, k: int = 2, **options) -> DataFrame:
    """One document of each component stays: the one of least id, all its columns kept.

    Links are those of near_duplicates and, unless similarity is None, those of similar_documents
    too. Rows that share an id stay or go together; a null id stays.
    """
    found = near_duplicates(docs, id_col, text_col, k=k, **options) if similarity is None else similar_documents(docs, id_col, text_col, similarity=similarity, k=k, **options)
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id <> c").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")


#: Smallest shingle hashes that a text is dealt by, and that its sketch holds.
KEYS, SKETCH = 6, 256
#: Words of a similarity print. A bit of two texts of a similarity of 0.8 differs with 0.19 at most (four shared
#: shingles and one more; 0.15 for long texts), so that more than NEAR_BITS of 256 differ in 2 of 10^10 pairs.
WORDS, NEAR_BITS = 4, 90
#: How far a sketch that is cut at SKETCH may be off: five deviations of 0.025.
SLACK = 0.125
#: Undecided pairs that a row hands on at first; what is left is met in further rounds, with four times as many each.
UNDECIDED = 32


def similarity_print(different: np.ndarray) -> np.ndarray:
    """WORDS words of majority bits over a text's different shingle hashes."""
    out = np.zeros(WORDS, np.int64)
    for w in range(WORDS):
        x = different + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[w] = majority(x ^ (x >> np.uint64(31)))
    return out


def sketch_similarity(a: np.ndarray, b: np.ndarray, whole: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of rows of sorted 32-bit sketches, filled up at the end with a number above all, and of how many shingles.

    From the SKETCH smallest of both together; from all where both sketches hold their whole text.
    """
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both < np.iinfo(np.int64).max
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    within = real & ((np.cumsum(new, axis=1) <= SKETCH) | np.reshape(whole, (-1, 1)))
    union = np.maximum((within & new).sum(axis=1), 1)
    return (within & ~new).sum(axis=1) / union, union


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, k: int | None = None, print_shingle: int = 3) -> DataFrame:
    """doc_id, component_id of each row, linking texts whose shingle sets have at least the Jaccard similarity.

    With k, texts whose fingerprints (over print_shingle words) differ in at most k bits are linked first, by the trie
    self-join as in near_duplicates; what they join is not compared again.
    Texts that share one of their smallest shingle hashes are dealt together (of pairs at 0.8, fewer than
    7 in 100,000 share none). Set sizes, prints and sketches only rule pairs out; a link is
    made where the whole sets, joined by node, have the similarity. Rows without words are one component.
    A null id is kept as it is.
    """
    texts = named(docs, doc_id=id_col, text=text_col).withColumn("h", F.xxhash64("text"))

    def make():
        def work(batch):
            out = {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "fingerprint": [], "node": [], "n": [], "print": [], "sketch": [], "keys": []}
            for text in texts_of(batch):
                different = np.unique(shingle_hashes(text, shingle))
                out["fingerprint"].append(None if k is None else fingerprint(text, print_shingle))
                out["node"].append(_node(different))
                out["n"].append(len(different))
                out["print"].append(similarity_print(different).tobytes())
                out["keys"].append(different[:KEYS].view(np.int64))
                out["sketch"].append(np.unique(different >> np.uint64(32))[:SKETCH].astype("<u4").tobytes())
            return out

        return work

    rows = written(map_texts(texts, make, "doc_id long, h long, fingerprint long, node long, n long, print binary, sketch binary, keys array<long>"))
    prints = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("h", "n", "print", "sketch", "keys"))))
    links = None if k is None else written(_fingerprint_links(rows, k))
    roots = components(_similar_links(texts, prints, shingle, similarity, links)).withColumnRenamed("root", "to")
    placed = prints.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("to", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(placed.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def _node(different: np.ndarray) -> int:
    """What stands for a set of shingle hashes: texts of the same set go as one."""
    return int(np.array([xxhash.xxh64_intdigest(different.tobytes(), seed=7)], np.uint64).view(np.int64)[0])


def _fingerprint_links(rows: DataFrame, k: int) -> DataFrame:
    """Links (u, v) from each node to the least one whose fingerprint is reached over links of at most k bits."""
    held = rows.select("fingerprint", "node").distinct()
    roots = components(near_links(held.select("fingerprint").distinct(), k))
    placed = held.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("node", F.coalesce("root", "fingerprint").alias("root"))
    return placed.join(placed.groupBy("root").agg(F.min("node").alias("v")), "root").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _similar_links(texts: DataFrame, prints: DataFrame, shingle: int, similarity: float, links: DataFrame | None = None) -> DataFrame:
    """Links (u, v) that connect all nodes which share a key and have the similarity, each held against the whole sets, and those given."""
    dealt, rounds = written(_tiles(prints)), 0
    while True:
        # what hangs together already needs no more links
        known = dealt.withColumn("root", F.col("node")) if links is None else dealt.join(components(links).withColumnRenamed("root", "to"), "node", "left").withColumn("root", F.coalesce("to", "node")).drop("to")
        whole = known.join(prints.select("node", "n", "print", "sketch"), "node")
        n = partitions(prints.sparkSession)
        work = _candidates(similarity, UNDECIDED * 4**rounds)
        found = written(whole.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(work, ROWS // 16), "u long, v long, more long"))
        pairs = found.where("u is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        new = _held(texts, prints, pairs, shingle, similarity)
        links = written(new if links is None else links.unionByName(new).distinct())
        more = found.where("more is not null").select(F.col("more").alias("bucket")).distinct()
        if more.isEmpty():
            return links
        dealt, rounds = written(dealt.join(more, "bucket", "left_semi")), rounds + 1


def _tiles(prints: DataFrame) -> DataFrame:
    """bucket, side, node. A bucket of over HOT nodes is cut into blocks, and each two blocks meet in a bucket of their own.

    side is the block's where two different blocks meet, and only nodes of different sides are compared; else -1.
    """
    keyed = prints.select("node", F.explode("keys").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / HOT).cast("int").alias("m"))
    keyed = keyed.join(shared, "bucket")
    block, other = F.pmod(F.xxhash64("node", "bucket"), F.col("m")).cast("int"), F.col("other")
    hot = keyed.where("m > 1").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    hot = hot.select(F.xxhash64("bucket", F.least("block", other), F.greatest("block", other)).alias("bucket"), F.when(F.col("block") != other, F.col("block")).otherwise(-1).alias("side"), "node")
    return keyed.where("m = 1").select("bucket", F.lit(-1).alias("side"), "node").unionByName(hot)


def _candidates(similarity: float, undecided: int):
    """Pairs (u, v) to hold against the whole sets, and in more the buckets that have others left."""

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        words = np.frombuffer(b"".join(table.column("print").to_pylist()), np.int64).reshape(-1, WORDS).view(np.uint64)
        bucket = table.column("bucket").to_numpy()
        order = np.lexsort((words[:, 0], table.column("n").to_numpy(), bucket))
        bucket, words = bucket[order], words[order]
        node, side, n, before = (table.column(c).to_numpy()[order] for c in ("node", "side", "n", "root"))
        sketches = table.column("sketch").take(pa.array(order)).to_pylist()
        # a row's partners are those behind it in its bucket whose sets are not too large for the similarity
        rank = np.cumsum(np.diff(bucket, prepend=bucket[:1]) != 0) * (int(n.max(initial=0)) + 1)
        largest = np.minimum(np.floor(n / similarity + 1e-9).astype(np.int64), int(n.max(initial=0)))
        end = np.searchsorted(rank + n, rank + largest, side="right")
        # rows of a component that is known are linked from the start
        by = np.lexsort((before, bucket))
        same = (before[by][1:] == before[by][:-1]) & (bucket[by][1:] == bucket[by][:-1])
        root = local_components(len(node), by[1:][same], by[:-1][same])
        handed, cut = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        open_: list[np.ndarray] = []
        sure: list[np.ndarray] = []

        def sketch(which: np.ndarray) -> np.ndarray:
            out = np.full((len(which), SKETCH), np.iinfo(np.int64).max)
            for i, w in enumerate(which.tolist()):
                s = np.frombuffer(sketches[w], "<u4")
                out[i, : len(s)] = s
            return out

        def judge(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal root
            for a in range(0, len(i), 2048):
                u, v = i[a : a + 2048], j[a : a + 2048]
                apart = root[u] != root[v]
                full = handed[u] >= undecided
                cut[u[apart & full]] = True
                u, v = u[apart & ~full], v[apart & ~full]
                if not len(u):
                    continue
                whole = (n[u] <= SKETCH) & (n[v] <= SKETCH)
                like, union = sketch_similarity(sketch(u), sketch(v), whole)
                slack = np.where(whole, 2 / union, SLACK)  # sketches hold half of each hash: two may meet
                certain, maybe = like >= similarity + slack, np.abs(like - similarity) < slack
                if certain.any():
                    sure.append(np.stack([u[certain], v[certain]]))
                    held = np.flatnonzero(root != np.arange(len(root)))
                    root = local_components(len(root), np.concatenate([held, u[certain]]), np.concatenate([root[held], v[certain]]))
                if maybe.any():
                    open_.append(np.stack([u[maybe], v[maybe]]))
                    np.add.at(handed, u[maybe], 1)

        live, held_u, held_v, size = np.flatnonzero(np.arange(len(node)) + 1 < end), [], [], 0
        step = 1
        while len(live):
            near = live + step
            small, large = np.minimum(n[live], n[near]), np.maximum(n[live], n[near])
            fit = (small / large >= similarity) & (root[live] != root[near]) & ((side[live] != side[near]) | (side[live] < 0))
            i, j = live[fit], near[fit]
            close = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= NEAR_BITS
            held_u.append(i[close])
            held_v.append(j[close])
            size += int(close.sum())
            if size >= 2048 or step == 1:
                judge(np.concatenate(held_u), np.concatenate(held_v))
                held_u, held_v, size = [], [], 0
            step += 1
            live = live[live + step < end[live]]
        if size:
            judge(np.concatenate(held_u), np.concatenate(held_v))
        # pairs that certain ones have joined meanwhile are not needed
        u, v = np.concatenate([np.empty((2, 0), np.int64), *open_], axis=1)
        apart = root[u] != root[v]
        u, v = np.concatenate([np.stack([u[apart], v[apart]]), *sure], axis=1)
        more = np.unique(bucket[cut])
        none = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_pydict({"u": pa.array(node[u]), "v": pa.array(node[v]), "more": none})
        if len(more):
            none = pa.nulls(len(more), pa.int64())
            yield pa.RecordBatch.from_pydict({"u": none, "v": none, "more": pa.array(more)})

    return join


def _held(texts: DataFrame, prints: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose whole sets of shingles have the similarity."""

    def make():
        def work(batch):
            found = [np.unique(shingle_hashes(t, shingle)) for t in texts_of(batch)]
            return {"node": [_node(f) for f in found], "shingles": [f.view(np.int64) for f in found]}

        return work

    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = prints.select("node", "h").join(nodes, "node", "left_semi").select("h")
    once = texts.select("h", "text").join(wanted, "h", "left_semi").dropDuplicates(["h"])
    sets = written(map_texts(once, make, "node long, shingles array<long>"))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared / (F.size("a") + F.size("b") - shared) >= similarity).select("u", "v")
