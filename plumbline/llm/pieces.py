"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece
that they merge to, the leftmost first among equals; it takes the best, merges
it and enters the pairs that arise, until none is left. What is then no piece becomes
its UTF-8 bytes' pieces. A merge never crosses from a character to the space sign,
as no piece does, so the agenda runs over each different unit of text once: all
new short units of an Arrow batch together, in numpy, and long units with a heap.
New units are checked against the sentencepiece library.

Null texts are empty; an empty text is the end id alone and decodes to nothing.
Repeated rows each get their result; tables may be empty.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.common import map_texts, named, texts_of

SPACE = "▁"
#: Units of up to so many characters are merged together; longer ones have a heap each.
SHORT = 48
KEEP = 250_000


class Pieces:
    """A vocabulary as tables, and the agenda over it."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.check, self.end = check, lib.eos_id()
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        self.score = np.array([lib.get_score(i) for i in range(n)])
        kind = np.array([0 if lib.is_byte(i) else 1 if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)) else 2 for i in range(n)])
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in np.flatnonzero(kind == 0)}
        plain = {self.piece[i]: int(i) for i in np.flatnonzero(kind == 1)}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece goes on after a space; units can't be cut there")
        # what each id decodes to
        self.raw = [bytes([int(p[3:5], 16)]) if k == 0 else p.replace(SPACE, " ").encode() if k == 1 else " ⁇ ".encode() if lib.is_unknown(i) else b"" for i, (p, k) in enumerate(zip(self.piece, kind, strict=True))]
        self.text = [str(i) for i in range(n)]
        # pieces of one character, by code point
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        pairs = {(plain[p[:k]] << 32) | plain[p[k:]]: i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        newline = r"|\n" if not any("\n" in p for p in plain) else ""
        self.units = re.compile(f"{SPACE}*[^{SPACE}{newline[1:]}]+|{SPACE}+{newline}")
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}
        self.mended = 0

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def agenda_together(self, units: list[str]) -> list[list[int]]:
        """The symbols of each unit after all merges; a character that is no piece is -1 - its code point."""
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        symbol = self.single[code].astype(np.int64)
        symbol[symbol < 0] = -1 - code[symbol < 0]
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        out: list[list[int]] = [[]] * len(units)

        def agenda(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The merge of the pair that begins at each i, and its place in the order."""
            nxt = np.minimum(i + 1, len(symbol) - 1)
            m = np.where((nxt > i) & (unit[nxt] == unit[i]), self.merge_of(symbol[i], symbol[nxt]), -1)
            return m, np.where(m >= 0, self.score[m], -np.inf)

        def finish(which: np.ndarray) -> None:
            own, sym = unit[which], symbol[which].tolist()
            if len(own):
                cut = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    out[own[a]] = sym[a:b]

        pair, rank = agenda(np.arange(len(symbol)))
        while len(symbol):
            begin = np.flatnonzero(np.diff(unit, prepend=-1))
            best = np.maximum.reduceat(rank, begin)
            length = np.diff(begin, append=len(symbol))
            going = np.repeat(best > -np.inf, length)
            finish(~going)
            if not going.any():
                break
            top = np.flatnonzero(going & (rank == np.repeat(best, length)))
            top = top[np.diff(unit[top], prepend=-1) != 0]  # the leftmost of each unit
            symbol[top] = pair[top]
            keep = going.copy()
            keep[top + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[top]
            symbol, unit, pair, rank = symbol[keep], unit[keep], pair[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                pair[i], rank[i] = agenda(i)
        return out

    def agenda_alone(self, unit: str) -> list[int]:
        """The same for one long unit, in n log n."""
        symbol = [int(self.single[ord(c)]) if self.single[ord(c)] >= 0 else -1 - ord(c) for c in unit]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple] = []

        def enter(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbol[i] >= 0 and symbol[j] >= 0 and (m := self.pairs.get((symbol[i] << 32) | symbol[j])) is not None:
                heapq.heappush(heap, (-self.score[m], i, j, symbol[i], symbol[j], m))

        for i in range(n - 1):
            enter(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, j, left, right, m = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], gone[j], after[i] = m, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            enter(before[i], i)
            enter(i, after[i])
        return [s for s, g in zip(symbol, gone, strict=True) if not g]

    def learn(self, units: list[str]) -> dict[str, tuple[str, int, bytes]]:
        """Encodes units: decimal ids, their number, the bytes that they decode to."""
        short = [u for u in units if len(u) <= SHORT]
        found = list(zip(short, self.agenda_together(short), strict=True)) + [(u, self.agenda_alone(u)) for u in units if len(u) > SHORT]
        ids = [(u, symbols if min(symbols) >= 0 else self._bytes(symbols)) for u, symbols in found]
        if self.check:
            # a unit without a space before it is checked behind a line break, which no merge crosses
            bare = [u[0] != SPACE for u, _ in ids]
            said = self.library.encode([("\n" + u if b else u[1:]).replace(SPACE, " ") for (u, _), b in zip(ids, bare, strict=True)], num_threads=1)
            for k, ((u, own), theirs) in enumerate(zip(ids, said, strict=True)):
                theirs = theirs[2:] if bare[k] else theirs
                if own != theirs and u != SPACE:
                    ids[k] = (u, theirs)
                    self.mended += 1
        return {u: (" ".join([self.text[i] for i in own]), len(own), b"".join([self.raw[i] for i in own])) for u, own in ids}

    def _bytes(self, symbols: list[int]) -> list[int]:
        return [i for s in symbols for i in ((s,) if s >= 0 else [self.byte_id[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")])]

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its ids in decimal with the end id, their number, and the decoded text."""
        cut = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        got, new = {}, []
        for u in {u for units in cut for u in units}:
            if (x := self.young.get(u)) is None and (x := self.old.get(u)) is not None:
                self.young[u] = x
            if x is None:
                new.append(u)
            else:
                got[u] = x
        if new:
            fresh = self.learn(new)
            got |= fresh
            self.young |= {u: x for u, x in fresh.items() if len(u) <= SHORT}
        if len(self.young) > KEEP:
            self.old, self.young = self.young, {}
        out = []
        for units in cut:
            known = [got[u] for u in units]
            # decoding drops the one space that encoding put in front
            decoded = b"".join([x[2] for x in known]).decode("utf-8", "replace")[1:]
            out.append((" ".join([x[0] for x in known] + [self.text[self.end]]), sum([x[1] for x in known]) + 1, decoded))
        return out


_loaded: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, check: bool = True) -> Pieces:
    """The worker's own tables, kept from task to task."""
    if (path, check) not in _loaded:
        _loaded[path, check] = Pieces(path, check)
    return _loaded[path, check]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, end id last), decoded."""

    def make():
        own = pieces(model, check)

        def work(batch):
            done = own.encode(texts_of(batch))
            return {"doc_id": batch.column("doc_id"), "n_tokens": [d[1] for d in done], "ids": [np.array(d[0].split(" "), np.int32) for d in done], "decoded": [d[2] for d in done]}

        return work

    return map_texts(named(docs, doc_id=id_col, text=text_col), make, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the decimal ids and of the decoded text."""

    def make():
        own = pieces(model, check)

        def work(batch):
            done = own.encode(texts_of(batch))
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": [d[1] for d in done],
                "ids_sha256": [hashlib.sha256(d[0].encode()).hexdigest() for d in done],
                "decoded_sha256": [hashlib.sha256(d[2].encode("utf-8")).hexdigest() for d in done],
            }

        return work

    return map_texts(named(docs, doc_id=id_col, text=text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
