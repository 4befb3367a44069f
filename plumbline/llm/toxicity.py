"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

A lexicon of terms and stems is learned from labelled texts: words and
beginnings of words whose presence tells the classes apart beyond chance. One automaton
reads a document's words: its states are the sets of trie nodes within one edit of what was
read, made as they are first needed. So it finds exact terms, words with a
term's stem, and misspelled terms. The window around each occurrence tells
quotation and report from address, and a logistic model turns the weighted counts into a score.

Null and empty texts, and those without any term, get the score of a text without
terms. Very long texts are read whole, word by word; of terms that tie the one that sorts first comes first, and
all count alike. Columns of the same names as the operator's own are kept. Ids that have no label, or a null one, are not learned from; of several labels of an id the
highest counts; of several texts of an id one is learned from. Repeated rows each get their score. With no labels of both classes
the model's prior weights and the seed terms alone score.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, map_texts, named, texts_of
from plumbline.llm.simhash import shingle_hashes

#: Labelled rows to learn from at most, in the order of their ids' hashes.
LABELLED = 40_000
STEM_LENGTHS = (4, 5, 6)
#: Words of a shingle and smallest shingle hashes of a text that tell its near copies; texts, copies counted once, that a term takes.
SHINGLE, COPY_KEYS, LEAST_TEXTS = 3, 16, 1.5
#: Shortest term of which misspellings count.
MISSPELT = 5
#: Characters on either side of an occurrence that are its context.
CONTEXT = 60

# Terms that count before any label is seen.
SEEDS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown imbecile garbage vermin idiota idiotas imbécil basura escoria patético idioten dummkopf abschaum widerlich müll crétin ordure minable dégueulasse".split()
REPORTS = "said says saying called calls quote quoted quotes wrote writes word words term terms reported sagte sagt nannte schrieb zitat wort dijo dice llamó palabra cita escribió dit disait appelle appelait mot écrit cite".split()
ADDRESS = "you your yours youre du dich dir dein deine ihr tu te tus ti usted ustedes eres toi ton ta tes vous votre".split()

WORD = re.compile(r"(?:[^\W_]|[@$!](?=[^\W\d_]))+")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
QUOTES = re.compile("[\"“”„‟«»‹›]")

EXACT, STEM, NEAR = 0, 1, 2
FEATURES = 8
#: Weights before learning: bias, then exact, stem and near terms, their presence, quoted, addressed.
PRIOR = np.array([-4.0, 2.0, 2.0, 1.0, 2.0, 1.5, -0.5, 0.5])


class Automaton:
    """The Levenshtein automata of all terms at once, over their trie.

    A state is a set of (node, edits); reading a character gives the next. States
    and steps are kept as they arise, up to a bound, then begun anew.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], edits: int = 1, keep: int = 200_000):
        self.edits, self.keep = edits, keep
        self.child: list[dict[str, int]] = [{}]
        self.term: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        self.depth = [0]
        for words, mark in ((terms, self.term), (stems, self.stem)):
            for word, weight in words.items():
                node = 0
                for c in word:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.depth.append(self.depth[node] + 1)
                    node = self.child[node][c]
                mark[node] = weight
        self.reset()

    def reset(self) -> None:
        start = self._closed({(0, 0)})
        self.states: dict[frozenset, int] = {start: 0}
        self.sets = [start]
        self.step: list[dict[str, int]] = [{}]
        self.size = 0

    def _closed(self, pairs: set) -> frozenset:
        """With the nodes that a missing character leads to; of a node only its fewest edits."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if best.get(node, self.edits + 1) <= e:
                continue
            best[node] = e
            if e < self.edits and node:  # a term's first character is never missing
                todo += [(n, e + 1) for n in self.child[node].values()]
        return frozenset(best.items())

    def _next(self, state: int, c: str) -> int:
        pairs = set()
        for node, e in self.sets[state]:
            if (n := self.child[node].get(c)) is not None:
                pairs.add((n, e))
            if e < self.edits and node:
                pairs.add((node, e + 1))
                pairs.update((n, e + 1) for n in self.child[node].values())
        if not pairs:
            target = -1
        else:
            found = self._closed(pairs)
            target = self.states.get(found)
            if target is None:
                target = self.states[found] = len(self.sets)
                self.sets.append(found)
                self.step.append({})
        self.step[state][c] = target
        self.size += 1
        return target

    def find(self, word: str) -> tuple[int, float] | None:
        """The kind and weight of the best term in a word, if any."""
        if self.size > self.keep:
            self.reset()
        state, stem, node = 0, 0.0, 0
        for c in word:
            if node >= 0:
                node = self.child[node].get(c, -1)
                if node >= 0 and node in self.stem:
                    stem = max(stem, self.stem[node])
            if state >= 0:
                state = self.step[state].get(c, -2)
                if state == -2:
                    state = self._again(word, c)
            if state < 0 and node < 0:
                break
        if node >= 0 and node in self.term:
            return EXACT, self.term[node]
        if stem:
            return STEM, stem
        if state >= 0 and len(word) >= MISSPELT - 1:
            near = [self.term[n] for n, e in self.sets[state] if n in self.term and self.depth[n] >= MISSPELT]
            if near:
                return NEAR, max(near)
        return None

    def _again(self, word: str, c: str) -> int:
        """A step that is not known yet: the way to it is walked again."""
        state = 0
        for d in word:
            nxt = self.step[state].get(d)
            if nxt is None:
                return self._next(state, d)
            state = nxt
        return state


def words_of(text: str) -> list[str]:
    return [w if w.isalpha() else w.translate(LEET) for w in WORD.findall(text) if not w.isdigit()]


class Scorer:
    """Features of texts; known words are kept with what the automaton says of them."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], keep: int = 150_000):
        self.automaton = Automaton(terms, stems)
        self.known: dict[str, tuple[int, float] | None] = {}
        self.keep = keep

    def features(self, text: str) -> list[float]:
        low = text.lower()
        known, hits = self.known, {}
        for w in set(WORD.findall(low)):
            try:
                found = known[w]
            except KeyError:
                found = known[w] = None if w.isdigit() else self.automaton.find(w if w.isalpha() else w.translate(LEET))
            if found is not None:
                hits[w] = found
        if len(known) > self.keep:
            known.clear()
        sums, quoted, addressed = [0.0, 0.0, 0.0], 0.0, 0.0
        if hits:
            for m in WORD.finditer(low):
                if (found := hits.get(m[0])) is not None:
                    factor = self.context(low, m.start(), m.end())
                    sums[found[0]] += found[1] * factor
                    quoted += factor < 1
                    addressed += factor > 1
        return [1.0, *(float(np.log1p(s)) for s in sums), float(sums[EXACT] > 0), float(sums[STEM] > 0), float(np.log1p(quoted)), float(np.log1p(addressed))]

    @staticmethod
    def context(low: str, start: int, end: int) -> float:
        """How much an occurrence counts: in quotation marks or reported less, addressed to someone more."""
        before, after = low[max(0, start - CONTEXT) : start], low[end : end + CONTEXT]
        around = set(WORD.findall(before)) | set(WORD.findall(after))
        reported = not around.isdisjoint(REPORTS)
        if len(QUOTES.findall(before.rsplit("\n", 1)[-1])) % 2 and QUOTES.search(after.split("\n", 1)[0]):
            return 0.15 if reported else 0.3
        return 0.5 if reported else 1.25 if not around.isdisjoint(ADDRESS) else 1.0


def _sample(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """Labelled documents to learn from: at most LABELLED rows, which are sent to all tasks."""
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = docs.join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems with weights from 0 to 1, by how much their presence tells beyond chance.

    Of texts with the same words in the same order and the same label one counts, and each counts by
    one over the number of its near copies: the median, over its smallest shingle hashes, of how many
    more texts of the one label than of the other share it. So a group of copies speaks once, no text
    and no term is left out, and neither a passage in part of a text nor one that both labels share weighs it down.
    """

    def make():
        def work(batch):
            out = {"toxic": batch.column("toxic"), "row": [], "keys": [], "terms": []}
            for text in texts_of(batch):
                words = words_of(text.lower())
                out["row"].append(xxhash.xxh64_intdigest(" ".join(words)) >> 1)
                out["keys"].append(np.unique(shingle_hashes(" ".join(words), SHINGLE))[:COPY_KEYS].view(np.int64))
                terms = set(words)
                stems = [w[:k] + "*" for w in terms for k in STEM_LENGTHS if len(w) > k]  # once for each different word
                out["terms"].append(sorted([*terms, *stems]))
            return out

        return work

    each = map_texts(sample.select("toxic", "text"), make, "toxic int, row long, keys array<long>, terms array<string>")
    texts = each.groupBy("row", "toxic").agg(F.max("keys").alias("keys"), F.max("terms").alias("terms")).cache()
    keys = texts.select("row", "toxic", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.greatest(F.lit(1), F.abs(F.sum(2 * F.col("toxic") - 1))).alias("copies"))
    weights = keys.join(shared, "key").groupBy("row", "toxic").agg(F.sort_array(F.collect_list("copies")).alias("all"))
    weights = weights.select("row", "toxic", (1 / F.get("all", F.floor(F.size("all") / 2).cast("int"))).alias("weight"))
    weighed = texts.join(weights, ["row", "toxic"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    total = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum(F.col("weight") * F.col("toxic")), F.lit(0.0))).first()
    share = total[1] / total[0] if total[0] else 0
    seeds = dict.fromkeys(SEEDS, 1.0)
    if not 0 < share < 1:
        texts.unpersist()
        return seeds, {}
    counts = weighed.select("toxic", "weight", F.explode("terms").alias("term")).groupBy("term")
    counts = counts.agg(F.sum(F.col("weight") * F.col("toxic")).alias("pos"), F.sum("weight").alias("n")).where(F.col("pos") > LEAST_TEXTS)
    p = F.least(F.col("pos") / F.col("n"), F.lit(1.0))
    gain = F.col("pos") * F.log(p / share) + F.when(p < 1, (F.col("n") - F.col("pos")) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    counts = counts.where(p > share).select("term", p.alias("p"), gain.alias("gain"))
    least = np.log(max(1, counts.count()))
    rows = counts.where((F.col("gain") > float(least)) & (F.col("p") > 0.5)).orderBy(F.desc("gain"), "term").collect()  # bounded by the words of LABELLED texts
    texts.unpersist()
    stems = {r["term"][:-1]: r["p"] for r in rows if r["term"].endswith("*")}
    # a longer stem that begins with another adds nothing
    stems = {s: w for s, w in stems.items() if not any(s[:k] in stems for k in range(1, len(s)))}
    return seeds | {r["term"]: r["p"] for r in rows if not r["term"].endswith("*")}, stems


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights nearest to PRIOR, by Newton's method; a step that would raise the loss is halved."""

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + strength / 2 * ((w - PRIOR) ** 2).sum()

    w = PRIOR.copy()
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - PRIOR))
        now = loss(w)
        while np.abs(step).max() > 1e-6 and loss(w - step) > now:
            step /= 2
        if np.abs(step).max() <= 1e-6:
            break
        w -= step
    return w


def _features(docs: DataFrame, lexicon: tuple) -> DataFrame:
    """toxic and the features of each labelled row."""

    def make():
        scorer = Scorer(*lexicon)
        return lambda batch: {"toxic": batch.column("toxic"), "x": [scorer.features(t) for t in texts_of(batch)]}

    return map_texts(docs.select("toxic", "text"), make, "toxic int, x array<double>")


def _learnt(docs: DataFrame, labels: DataFrame, learn: Column | None, id_col: str, text_col: str):
    """What makes the scores of a batch of texts."""
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    sample = _sample(named(docs, doc_id=id_col, text=text_col), labels.select(F.col(id_col).alias("doc_id"), "toxic"), learn)
    lexicon = learn_lexicon(sample)
    seen = _features(sample, lexicon).toPandas()  # LABELLED rows of few numbers
    weights = fit(np.array(seen["x"].tolist(), float).reshape(-1, FEATURES), seen["toxic"].to_numpy(float))

    def make():
        scorer = Scorer(*lexicon)

        def work(batch):
            x = np.array([scorer.features(t) for t in texts_of(batch, text_col)]).reshape(-1, FEATURES)
            return {"score": 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))}

        return work

    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of each row.

    learn: a condition over doc_id that the labels to learn from fulfil.
    """
    make = _learnt(docs, labels, learn, id_col, text_col)
    scored, (score,) = add_columns(docs.select(id_col, text_col), make, {"score": "double"})
    return scored.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(score).alias("score"), F.when(F.col(score) >= threshold, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, all their columns kept."""
    scored, (score,) = add_columns(docs, _learnt(docs, labels, learn, id_col, text_col), {"score": "double"})
    return scored.where(F.col(score) < threshold).drop(score)
