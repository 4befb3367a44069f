"""Language-model scores by a hashed maximum-entropy model.

A token's probability is a product of softmaxes, each over hashed features of the tokens
before it: that of its group of classes, of its class in the group, of its part of the class, and its own in that part. Features
of groups and classes are the three tokens before, a pair, an ending and classes; of the rest two tokens and their pair, each hashed
with the place in the tree. Weights are trained by distributed gradient updates: all training
documents are gone through once, in ROUNDS rounds; in each every task goes through its part in mini-batches from the
common weights, and rows of weights are averaged by how often they were updated. So weights
depend a little on how the input is dealt to tasks; counts and base scores don't.

Texts are read once into spans: the different tokens of some texts as hashes of 64 bits, and the texts as
numbers of them. All else works on spans, a fact for each different token and numpy over the rest.

The commonest tokens are put in classes by the company they keep, and in parts of a class by
frequency; all others belong to the group that their letters speak for. In a group a token seen c times of n, among v
different ones, has (c + 0.1) / (n + 0.1 (v + 1)), and all unseen ones together 0.1 of that.
Counts are of all training documents; beyond a bounded list of the commonest, a
token's count comes by a join, not to all tasks. Classed tokens and rows of weights grow with the
vocabulary, up to what a task can hold. Two tokens of one hash would count as one: of a billion, 1 in 40 corpora has such a pair.

Null and empty texts are the end token alone. Repeated rows each get their
score, and count as often in training. Without training documents all scores are those of
one group and no counts. A null id belongs to the training part if learn says so, else not.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched_texts, named, written
from plumbline.llm.vectors import fit_cells

#: Tokens whose counts all tasks hold (16 bytes each), and neighbours that classes are made by.
KNOWN, NEIGHBOURS = 500_000, 64
#: Tokens in classes: one of SHARE of the vocabulary, between these bounds.
CLASSED, MOST_CLASSED, SHARE = 8_192, 24_576, 128
#: Outputs of a softmax: up to 15 classes in a group and one place for its other tokens, 16 parts of 16 tokens in a class.
WIDE = 16
#: Groups of classes, and classes at least.
GROUPS, CLASSES = 8, 40
#: Bits of the rows of weights: as many as a 64th of the vocabulary takes, between these bounds.
LEAST_BITS, MOST_BITS = 15, 18
ROUNDS, BATCH, RATE = 3, 16_384, 0.2
#: Training tokens of a task: each hands on its weights, so that fewer would make them outweigh the texts.
TASK_TOKENS = 4_000_000
#: Scores are cut off here, so that exponentials stay finite.
HIGHEST, LOWEST = np.float32(80), np.float32(-1e9)
#: Different tokens of spans whose counts a task holds before it sums them.
HELD = 3_200_000
#: Tokens of a row of weights whose errors are summed for all rows together.
RUN = 16
#: What stands before a text, three times (no word holds a space), and its end (no word is empty).
PAD, END = b" ", b""
#: Bytes and texts of a span, but for a longer text, which is a span of its own.
SPAN, SPAN_ROWS = 200_000, 1 << 13
#: The end's group, its class and those of tokens that are in none.
ENDING = GROUPS
CLASS_OF_END, LOOSE = ENDING * WIDE, WIDE - 1
N_CLASSES = CLASS_OF_END + 1
#: Keys that a part, and a token in it, are predicted by.
NEAR_KEYS = [0, 1, 3]
ONES = np.ones((WIDE, 1), np.float32)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

SPANS = "turn int, doc_ids array<long>, learnt array<boolean>, sizes array<int>, hashes binary, shapes binary, flat binary"


def token_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def shape_of(word: bytes) -> int:
    """16 bits for each of a word's first two and last two triples of letters, the very last on top."""
    text, crc = b"^" + word[-40:] + b"$", zlib.crc32
    return (crc(text[:3]) & 0xFFFF) | (crc(text[1:4]) & 0xFFFF) << 16 | (crc(text[-4:-1]) & 0xFFFF) << 32 | (crc(text[-3:]) & 0xFFFF) << 48


def _triples() -> tuple[np.ndarray, ...]:
    """The crc32 of three letters, cut to 16 bits, is the exclusive or of one entry of each table."""
    letters = [bytes([0] * i + [c] + [0] * (2 - i)) for i in range(3) for c in range(256)]
    tables = np.array([zlib.crc32(x) & 0xFFFF for x in letters], np.uint64).reshape(3, 256)
    tables[1:] ^= tables[0, 0]
    return tuple(tables)


TRIPLES = _triples()


def shapes_of(words: pa.Array) -> np.ndarray:
    """shape_of of each of the words, none of them empty."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.intp)
    starts, ends = ends[:-1], ends[1:]
    # words of one letter and very long ones are told apart below
    b = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(2, np.uint8))
    head, tail = ord("^"), ord("$")
    n = ends - starts
    first, second, last, before = b[starts], b[starts + 1], b[ends - 1], b[ends - 2]
    third, ahead = np.where(n > 2, b[starts + 2], tail), np.where(n > 2, b[ends - 3], head)
    out = np.zeros(len(n), np.uint64)
    for i, (x, y, z) in enumerate(((head, first, second), (first, second, third), (ahead, before, last), (before, last, tail))):
        out |= (TRIPLES[0][x] ^ TRIPLES[1][y] ^ TRIPLES[2][z]) << np.uint64(16 * i)
    for i in np.flatnonzero((n < 2) | (n > 40)).tolist():
        out[i] = shape_of(b[starts[i] : ends[i]].tobytes())
    return out


def span_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; (hash, shape) of the different ones by hash; the texts as numbers of them, each with three times PAD before and END after it."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = words.flatten()
    # white space at a text's ends leaves empty words
    real = pc.binary_length(flat).to_numpy() > 0
    sizes = np.diff(np.append(0, np.cumsum(real))[np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    names = coded.dictionary.cast(pa.binary())
    facts = np.empty((len(names) + 2, 2), np.uint64)
    facts[:2] = [(token_hash(w), shape_of(w)) for w in (PAD, END)]
    facts[2:, 0] = np.fromiter(map(xxhash.xxh64_intdigest, names.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(names))
    facts[2:, 1] = shapes_of(names)
    # in order of hashes, so that all that looks them up goes through its tables once
    order = np.argsort(facts[:, 0])
    number = np.empty(len(order), np.intp)
    number[order] = np.arange(len(order))
    starts = np.cumsum(sizes + 4) - (sizes + 4)
    at = np.full(sizes.sum() + 4 * len(sizes), number[0])
    at[starts + 3 + sizes] = number[1]
    at[np.arange(sizes.sum()) + np.repeat(4 * np.arange(len(sizes)) + 3, sizes)] = number[2:][coded.indices.to_numpy()]
    return sizes + 1, facts[order], at


def read_spans(rows: DataFrame) -> DataFrame:
    """The texts of (doc_id, learnt, text) as spans, written to the shared folder."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # tasks begin with different rounds, so that each round has spans where tasks have few
        for turn, batch in enumerate(batched_texts(it, rows=SPAN_ROWS, size=SPAN), TaskContext.get().partitionId()):
            sizes, facts, at = span_of(batch.column("text"))
            at = at.astype("<u2" if len(facts) <= 1 << 16 else "<u4")
            one = {"doc_ids": batch.column("doc_id").cast(pa.int64()), "learnt": batch.column("learnt"), "sizes": pa.array(sizes, pa.int32())}
            lists = {name: pa.ListArray.from_arrays([0, batch.num_rows], x) for name, x in one.items()}
            yield pa.RecordBatch.from_pydict({"turn": pa.array([turn % ROUNDS], pa.int32()), **lists, "hashes": [facts[:, 0].tobytes()], "shapes": [facts[:, 1].tobytes()], "flat": [at.tobytes()]})

    return written(rows.select("doc_id", "learnt", "text").mapInArrow(run, SPANS), codec="zstd")


class Span:
    """A row of read_spans as numpy arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.hashes = np.frombuffer(batch.column("hashes")[i].as_buffer(), np.uint64)
        self.shapes = np.frombuffer(batch.column("shapes")[i].as_buffer(), np.uint64)
        self.flat = np.frombuffer(batch.column("flat")[i].as_buffer(), "<u2" if len(self.hashes) <= 1 << 16 else "<u4")
        self.sizes = batch.column("sizes")[i].values.to_numpy()
        self.learnt = np.array(batch.column("learnt")[i].as_py(), bool)
        #: Where the tokens stand in flat, and where each text begins among them.
        self.at = np.arange(self.sizes.sum()) + np.repeat(3 * np.arange(1, len(self.sizes) + 1), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def taught(self) -> np.ndarray:
        """Where the tokens of training texts stand in flat."""
        return self.at if self.learnt.all() else self.at[np.repeat(self.learnt, self.sizes)]


def spans_of(it: Iterable[pa.RecordBatch]) -> Iterator[tuple[Span, pa.RecordBatch, int]]:
    np.ones(31 << 20, np.uint8)  # once freed, the C library keeps what batches free, and pages are not fetched anew
    for batch in it:
        for i in range(batch.num_rows):
            yield Span(batch, i), batch, i


def count_tokens(spans: DataFrame) -> DataFrame:
    """(hash, shape, c): how often each token occurs in the training texts. Tasks sum before anything is shuffled."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sums() -> pa.RecordBatch:
            hashes, shapes, c = (np.concatenate(x) for x in zip(*held, strict=True))
            hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            c = np.bincount(which, c, len(hashes)).astype(np.int64)
            return pa.RecordBatch.from_pydict({"hash": hashes.view(np.int64), "shape": shapes[first].view(np.int64), "c": c})

        for span, *_ in spans_of(it):
            c = np.bincount(span.flat[span.taught()], minlength=len(span.hashes))
            has = np.flatnonzero(c)
            held.append((span.hashes[has], span.shapes[has], c[has]))
            size += len(has)
            if size > HELD:
                yield sums()
                held, size = [], 0
        if held:
            yield sums()

    return spans.select(*_fields()).mapInArrow(run, "hash long, shape long, c long").groupBy("hash").agg(F.max("shape").alias("shape"), F.sum("c").alias("c"))


def _fields() -> list[str]:
    return [f.split()[0] for f in SPANS.split(", ")[1:]]


def company(spans: DataFrame, words: np.ndarray) -> np.ndarray:
    """For each token (a hash) how often the first NEIGHBOURS of them stand before and after it, in all training texts."""
    order = np.argsort(words)
    ranked, wide = words[order], 2 * NEIGHBOURS

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(words) * wide, np.int64)
        held: list[np.ndarray] = []
        for span, *_ in spans_of(it):
            place, hit = find(ranked, span.hashes)
            rank = np.where(hit, order[place], -1)
            at = np.full(len(span.flat), -1)
            taught = span.taught()
            at[taught] = rank[span.flat[taught]]
            for word, near, side in ((at[1:], at[:-1], 0), (at[:-1], at[1:], NEIGHBOURS)):
                both = (word >= 0) & (near >= 0) & (near < NEIGHBOURS)
                held.append(word[both] * wide + near[both] + side)
            if len(held) > 60:
                sums += np.bincount(np.concatenate(held), minlength=len(sums))
                held = []
        if held:
            sums += np.bincount(np.concatenate(held), minlength=len(sums))
        has = np.flatnonzero(sums)
        for a in range(0, len(has), 1 << 16):
            part = has[a : a + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"cell": part, "c": sums[part]})

    out = np.zeros(len(words) * wide)
    if len(words):
        cells = spans.select(*_fields()).mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()  # MOST_CLASSED x 128 at most
        out[cells.column("cell").to_numpy()] = cells.column("c").to_numpy()
    return out.reshape(len(words), wide)


def find(ranked: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values stand in a sorted array, and whether they do."""
    if not len(ranked):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
    return place, ranked[place] == values


@dataclass
class Facts:
    """What tasks know of tokens: counts of the commonest, places of classed ones, what letters speak for."""

    known: np.ndarray
    counts: np.ndarray
    complete: bool
    words: np.ndarray
    places: np.ndarray
    odds: np.ndarray
    groups: np.ndarray
    bits: int

    def group(self, shapes: np.ndarray) -> np.ndarray:
        """The group that the strongest of a word's four triples of letters speaks for."""
        codes = shapes.view(np.uint16).reshape(-1, 4)
        best = codes[np.arange(len(codes)), self.odds[codes].argmax(axis=1)]
        return self.groups[best]

    def look(self, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's place, ((group * 16 + class) * 16 + part) * 16 + number, and whether it is in a class; others have class LOOSE of their group."""
        place, hit = find(self.words, hashes)
        where = (self.group(shapes) * WIDE + LOOSE) * WIDE * WIDE
        where[hit] = self.places[place[hit]]
        where[hashes == np.uint64(token_hash(END))] = CLASS_OF_END * WIDE * WIDE
        return where, hit

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Counts; of tokens that are not held -1, or 0 where all are."""
        place, hit = find(self.known, hashes)
        c = np.full(len(hashes), 0 if self.complete else -1)
        c[hit] = self.counts[place[hit]]
        return c


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * GOLDEN) >> np.uint64(64 - bits)).astype(np.intp)


def salted(k: int) -> np.uint64:
    return np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64))


class Context:
    """A span's facts and the keys of its tokens, of which rows of weights are made."""

    def __init__(self, span: Span, facts: Facts):
        self.bits, self.flat = facts.bits, span.flat.astype(np.intp)
        self.where, self.classed = facts.look(span.hashes, span.shapes)
        h, k = span.hashes[self.flat], (self.where // (WIDE * WIDE)).astype(np.uint64)[self.flat]
        ending = (span.shapes >> np.uint64(48))[self.flat[2:-1]]
        h1, h2, h3, k1, k2, k3 = h[2:-1], h[1:-2], h[:-3], k[2:-1], k[1:-2], k[:-3]
        classes = k1 * np.uint64(256) + k2
        #: By the tokens one, two and three before, the last two together, an ending, two and three classes; of the token at 3 first.
        keys = np.stack([h1, h2 * np.uint64(5), h3 * np.uint64(11), h1 * np.uint64(31) + h2 * np.uint64(1_000_003), ending * np.uint64(256) + k2 + salted(4), classes + salted(5), classes * np.uint64(256) + k3 + salted(6)])
        self.keys = keys, keys[NEAR_KEYS]

    def rows(self, at: np.ndarray, node: np.ndarray | None = None, near: bool = False) -> np.ndarray:
        """Rows of weights, a feature a line, of tokens that are predicted at a node of the tree (the root if none)."""
        keys = self.keys[near].take(at - 3, axis=1)
        if node is not None:
            keys += (node.astype(np.uint64) + np.uint64(101)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return mixed(keys, self.bits)


class Softmax:
    """Weights of hashed rows for WIDE outputs, with AdaGrad by row."""

    def __init__(self, weights: np.ndarray):
        self.w = weights

    def logs(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Natural logarithms of the outputs' probabilities, a token a row."""
        z = self.scores(rows, bias)
        z -= np.log(np.exp(z) @ ONES)
        return z

    def logs_of(self, rows: np.ndarray, goals: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Those of one output for each token."""
        z = self.scores(rows, bias)
        own = z[np.arange(len(goals)), goals]
        return own - np.log(np.exp(z, out=z) @ ONES)[:, 0]

    def scores(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = self.w.take(rows[0], axis=0)
        z += bias
        for r in rows[1:]:
            z += self.w.take(r, axis=0)
        return np.minimum(z, HIGHEST, out=z)

    def learn(self) -> None:
        self.seen, self.slope = np.zeros(len(self.w), np.int64), np.full((len(self.w), 1), 1e-2, np.float32)

    def step(self, rows: np.ndarray, goals: np.ndarray, bias: np.ndarray) -> None:
        """A mini-batch: all its gradients are of the weights before it."""
        if not len(goals):
            return
        error = np.exp(self.scores(rows, bias))
        error /= error @ ONES
        error[np.arange(len(goals)), goals] -= 1
        error /= np.float32(math.sqrt(len(goals)))
        # only rows that the batch has are worked on, however many there are
        ids, gradient = row_sums(rows, error)
        slope = self.slope.take(ids, axis=0)
        slope += np.einsum("rk,rk->r", gradient, gradient)[:, None] / np.float32(WIDE)
        self.slope[ids] = slope
        gradient *= np.float32(RATE) / np.sqrt(slope)
        put(self.w, ids, self.w.take(ids, axis=0) - gradient)
        self.seen[ids] += 1


def put(into: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """into[ids] = rows, each row moved as a whole."""
    whole = np.dtype((np.void, into.itemsize * into.shape[1]))
    into.view(whole)[ids, 0] = rows.view(whole)[:, 0]


def row_sums(rows: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of weights of a batch, and for each the sum of the errors of the tokens that have it."""
    shift = max(1, (rows.shape[1] - 1).bit_length())
    kind = np.uint32 if int(rows.max()).bit_length() + shift <= 32 else np.uint64
    keys = rows.astype(kind) << kind(shift)
    keys |= np.arange(rows.shape[1], dtype=kind)
    keys = keys.reshape(-1)
    keys.sort()
    token, row = (keys & kind((1 << shift) - 1)).astype(np.intp), keys >> kind(shift)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n = np.append(starts[1:], len(row)) - starts
    # most tokens first, so that the rows that have a j-th token are the first ones
    capped = np.minimum(n, RUN)
    order = np.argsort((RUN - capped).astype(np.uint8), kind="stable")
    has = len(n) - np.cumsum(np.bincount(capped, minlength=RUN + 1))
    starts, n = starts[order], n[order]
    sums = error.take(token[starts], axis=0)
    for j, k in enumerate(has[1:RUN].tolist(), 1):
        sums[:k] += error.take(token[starts[:k] + j], axis=0)
    # what few rows have beyond is summed row by row
    long = np.flatnonzero(n[: has[RUN - 1]] > RUN)
    if len(long):
        beyond = n[long] - RUN
        at = np.cumsum(beyond) - beyond
        sums[long] += np.add.reduceat(error.take(token[np.repeat(starts[long] + RUN - at, beyond) + np.arange(beyond.sum())], axis=0), at, axis=0)
    return row[starts].astype(np.intp), sums


@dataclass
class Model:
    """Logarithms of shares of groups, classes, parts and tokens, and the weights of the four softmaxes."""

    facts: Facts
    bias: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]

    def batches(self, context: Context, at: np.ndarray) -> Iterator[tuple]:
        """For runs of tokens: their places in flat, and (rows, goals, biases, which of the run) of the four softmaxes."""
        for a in range(0, len(at), BATCH):
            here = at[a : a + BATCH]
            token = context.flat[here]
            where = context.where[token]
            group = where // WIDE**3
            words, inner = np.flatnonzero(group != ENDING), np.flatnonzero(context.classed[token])
            k, part = where[inner] // WIDE**2, where[inner] // WIDE
            mine = group[words]
            yield (
                here,
                (context.rows(here), group, self.bias[0], slice(None)),
                (context.rows(here[words], mine), where[words] // WIDE**2 % WIDE, self.bias[1].take(mine, axis=0), words),
                (context.rows(here[inner], k + 64, True), part % WIDE, self.bias[2].take(k, axis=0), inner),
                (context.rows(here[inner], part + 512, True), where[inner] % WIDE, self.bias[3].take(part, axis=0), inner),
            )

    def blank(self) -> Model:
        """The same with all weights at zero."""
        return Model(self.facts, self.bias, tuple(np.zeros((1 << self.facts.bits, WIDE), np.float32) for _ in range(4)))


def fill_up(spans: DataFrame, model: Model, total: int) -> None:
    """Trains the model's weights in ROUNDS rounds, which go through all training texts, of so many tokens, once."""
    spark = spans.sparkSession
    rows, blocks = 1 << model.facts.bits, 32
    each = rows // blocks
    # groups of tasks whose weights are summed first, so that no task sums those of all
    tasks = max(1, -(-total // (ROUNDS * TASK_TOKENS)))
    fan = math.isqrt(tasks) if tasks > 256 else 1
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(Model(model.facts, model.bias, tuple(w.astype(np.float16) for w in model.weights)))  # bounded by KNOWN, MOST_CLASSED and MOST_BITS

        def run(it: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = shared.value
            layers = [Softmax(w.astype(np.float32)) for w in own.weights]
            for layer in layers:
                layer.learn()
            for span, *_ in spans_of(it):
                for _, *parts in own.batches(Context(span, own.facts), span.taught()):
                    for layer, (r, goals, bias, _) in zip(layers, parts, strict=True):
                        layer.step(r, goals, bias)
            group = TaskContext.get().partitionId() % fan
            for number, layer in enumerate(layers):
                for b in range(blocks):
                    ids = np.flatnonzero(layer.seen[b * each : (b + 1) * each]) + b * each
                    if len(ids):
                        yield _block(number * blocks + b, group, ids - b * each, layer.seen[ids].astype(np.float32), layer.w[ids].astype(np.float16))

        def add(key: tuple, table: pa.Table, last: bool) -> pa.Table:
            total, n = np.zeros((each, WIDE)), np.zeros(each)
            for ids, s, w in zip(*(table.column(c).to_pylist() for c in ("ids", "seen", "w")), strict=True):
                ids, s = np.frombuffer(ids, "<i4"), np.frombuffer(s, np.float32).astype(np.float64)
                total[ids] += s[:, None] * np.frombuffer(w, np.float16 if not last or fan == 1 else np.float32).reshape(len(ids), WIDE)
                n[ids] += s
            ids = np.flatnonzero(n)
            mean = total[ids] / n[ids, None]
            return pa.Table.from_batches([_block(key[0].as_py(), 0 if last else key[1].as_py(), ids, n[ids].astype(np.float32), mean.astype(np.float32))])

        kind = "block int, group int, ids binary, seen binary, w binary"
        mixed_ = spans.where(F.col("turn") == turn).select(*_fields()).coalesce(tasks).mapInArrow(run, kind)
        if fan > 1:
            mixed_ = mixed_.groupBy("block", "group").applyInArrow(lambda key, table: add(key, table, False), kind)
        for r in mixed_.groupBy("block").applyInArrow(lambda key, table: add(key, table, True), kind).toLocalIterator():
            ids = np.frombuffer(r["ids"], "<i4") + r["block"] % blocks * each
            w = model.weights[r["block"] // blocks]
            w[ids] = np.frombuffer(r["w"], np.float32).reshape(-1, WIDE)
        shared.unpersist()


def _block(block: int, group: int, ids: np.ndarray, seen: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "group": pa.array([group], pa.int32()), "ids": [ids.astype("<i4").tobytes()], "seen": [seen.tobytes()], "w": [w.tobytes()]})


def _nearest(near: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """Of each row, in order, the nearest centre that fewer than so many rows have yet, and its number there; -1 for rows without any number."""
    room, has = np.zeros(len(centres), np.int64), near.any(axis=1)
    out = np.full((len(near), 2), -1)
    best = np.argsort(-(near @ centres.T), axis=1, kind="stable")
    for i in np.flatnonzero(has):
        k = next((k for k in best[i] if room[k] < most), -1)
        if k >= 0:
            out[i] = k, room[k]
            room[k] += 1
    return out


def _places(near: np.ndarray) -> np.ndarray:
    """Places of tokens, commonest first, by their company: group, class, then parts by frequency; -1 for those without company."""
    has = near.any(axis=1)
    if not has.any():
        return np.full(len(near), -1)
    some = near[has]
    classes = fit_cells(some, min(len(some), max(CLASSES, len(some) * 5 // 4 // WIDE**2), GROUPS * LOOSE))
    groups = fit_cells(classes, min(GROUPS, len(classes)))
    of_class = _nearest(classes, groups, LOOSE)
    k = _nearest(near, classes, WIDE * WIDE)
    return np.where(k[:, 0] < 0, -1, (of_class[k[:, 0]] @ (WIDE, 1)) * WIDE * WIDE + k[:, 1])


def arrange(spans: DataFrame, counts: DataFrame, kinds: int) -> tuple[Facts, np.ndarray]:
    """What tasks know of tokens, and the classed tokens' counts."""
    known = counts.where(F.col("hash") != F.lit(_signed(END))).orderBy(F.desc("c"), "hash").limit(KNOWN).toArrow()
    hashes, shapes, c = (known.column(x).to_numpy() for x in ("hash", "shape", "c"))
    hashes, shapes = hashes.view(np.uint64), shapes.view(np.uint64)
    n = min(len(hashes), MOST_CLASSED, max(CLASSED, kinds // SHARE))
    near = company(spans, hashes[:n])
    near = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    places = _places(near)
    classed = np.flatnonzero(places >= 0)
    # what letters speak for which group, by its classed tokens: by how far it is ahead of the next
    seen = np.zeros((GROUPS, 1 << 16))
    codes = shapes[classed].view(np.uint16).reshape(-1, 4)
    np.add.at(seen, (np.repeat(places[classed] // WIDE**3, 4), codes.reshape(-1)), 1)
    logs = np.log((seen + 0.3) / (seen.sum(axis=1, keepdims=True) + 300))
    first = logs.argmax(axis=0)
    ahead = np.sort(logs, axis=0)
    odds = np.where(seen.any(axis=0), ahead[-1] - ahead[-2], -1)
    groups = np.where(seen.any(axis=0), first, int(seen.sum(axis=1).argmax()))
    order, mine = np.argsort(hashes, kind="stable"), classed[np.argsort(hashes[classed])]
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, kinds / 64)))))
    facts = Facts(hashes[order], c[order], kinds <= len(hashes) + 1, hashes[mine], places[mine], odds.astype(np.float32), groups, bits)
    return facts, c[mine]


def _signed(word: bytes) -> int:
    return int(np.array([token_hash(word)], np.uint64).view(np.int64)[0])


def group_sizes(counts: DataFrame, facts: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and different tokens of each class and group, over the whole vocabulary."""
    shared = counts.sparkSession.sparkContext.broadcast(facts)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(N_CLASSES, np.int64), np.zeros(N_CLASSES, np.int64)
        for batch in it:
            hashes, shapes, c = (batch.column(x).to_numpy() for x in ("hash", "shape", "c"))
            k = shared.value.look(hashes.view(np.uint64), shapes.view(np.uint64))[0] // WIDE**2
            n += np.bincount(k, c, N_CLASSES).astype(np.int64)
            v += np.bincount(k, minlength=N_CLASSES)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(N_CLASSES), pa.int32()), "n": n, "v": v})

    n, v = np.zeros(N_CLASSES), np.zeros(N_CLASSES)
    for r in counts.mapInArrow(run, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


def _shares(n: np.ndarray, facts: Facts, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logarithms of the shares of groups, of classes in a group, of parts in a class, of tokens in a part; what is empty is far below."""
    leaf = np.zeros(GROUPS * WIDE**3)
    leaf[facts.places] = c
    classes = n[:CLASS_OF_END].reshape(GROUPS, WIDE).copy()
    classes[:, LOOSE] += 0.1
    groups = np.append(classes.sum(axis=1), n[CLASS_OF_END] + 0.1)
    out = [np.full((1, WIDE), LOWEST)]
    out[0][0, : len(groups)] = np.log(groups / groups.sum())
    for counts in (classes, leaf.reshape(-1, WIDE, WIDE).sum(axis=2), leaf.reshape(-1, WIDE)):
        whole = counts.sum(axis=1, keepdims=True)
        out.append(np.where(counts > 0, np.log(np.where(counts > 0, counts, 1) / np.maximum(whole, 1e-9)), LOWEST))
    return tuple(x.astype(np.float32) for x in out)


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score of each row; scores are log10 probabilities.

    learn: a condition over doc_id that the documents to learn from fulfil.
    """
    spans = read_spans(named(docs, doc_id=id_col, text=text_col).withColumn("learnt", F.coalesce(learn, F.lit(False))))
    counts = written(count_tokens(spans))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    facts, c = arrange(spans, counts, kinds)
    n, v = group_sizes(counts, facts)
    model = Model(facts, _shares(n, facts, c), ()).blank()
    fill_up(spans, model, total)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by KNOWN, MOST_CLASSED and MOST_BITS
    scored = written(spans.select(*_fields()).mapInArrow(_scorer(shared, n, v), "doc_id long, learnt boolean, n_tokens long, n_known long, base double, score double, rest array<long>").withColumn("row", F.monotonically_increasing_id()))
    # tokens that tasks hold no count of: none of them is common, so no key is hot
    rare = scored.select("row", F.explode("rest").alias("hash")).groupBy("row", "hash").agg(F.count("*").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts.select("hash", "c"), "hash", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("found"))
    logs, whole = F.coalesce("logs", F.lit(0.0)), math.log10(total + 0.1 * (kinds + 1))
    return scored.drop("rest").join(rare, "row", "left").select(
        "doc_id", "learnt", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * whole).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def _scorer(shared, n: np.ndarray, v: np.ndarray):
    """Rows of texts from spans; base and score lack the logarithms of the counts of the tokens in rest."""
    inner = np.log10(n + 0.1 * (v + 1))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        layers = [Softmax(w) for w in model.weights]
        for span, batch, i in spans_of(it):
            context = Context(span, model.facts)
            c = model.facts.count(span.hashes)
            c[span.hashes == np.uint64(token_hash(END))] = n[CLASS_OF_END]
            base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.1), 0)
            k = context.where // WIDE**2
            # in a group a token's share is by counts; classed tokens and ends have none but the softmaxes'
            share = np.where(context.classed | (k == CLASS_OF_END), 0, base - inner[k])
            near = np.zeros(len(span.at))
            done = 0
            for here, *parts in model.batches(context, span.at):
                into = near[done : done + len(here)]
                for layer, (rows, goals, bias, which) in zip(layers, parts, strict=True):
                    into[which] += layer.logs_of(rows, goals, bias)
                done += len(here)
            token = context.flat[span.at]
            lost = np.flatnonzero(c[token] < 0)
            text = np.searchsorted(span.starts, lost, side="right") - 1
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(span.sizes) + 1)), pa.int32()), pa.array(span.hashes[token[lost]].view(np.int64)))
            sums = [np.add.reduceat(x, span.starts) for x in ((c > 0)[token].astype(np.int64), base[token], near / math.log(10) + share[token])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_ids")[i].values, "learnt": batch.column("learnt")[i].values, "n_tokens": span.sizes.astype(np.int64), "n_known": sums[0], "base": sums[1], "score": sums[2], "rest": rest})

    return run
