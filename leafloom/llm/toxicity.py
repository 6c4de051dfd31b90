"""Toxicity: a learned lexicon, Levenshtein automata against its trie, and scores of context windows.

Training reads a bounded sample, TRAIN_ROWS labelled rows of each class at most, chosen by hash of the id and never from the
held-out fifth. The lexicon is chosen greedily by likelihood ratio over the sample's texts: whole words, and stems that many
words of toxic texts begin with. Whole words of FUZZY_LEN letters or more also match within one edit: the automaton of a
text's word is walked along the lexicon's trie, and only nodes at which it still lives are visited. Each hit is scored in
its window of WINDOW words: a hit in quotation marks or after a word of reporting counts QUOTED, one beside a second person
or an exclamation mark counts AIMED, any other 1. A logistic regression on the sums of exact and of misspelled hits,
absolute and in proportion to the text, gives the score; classes are weighted back to their shares among labels.

Scoring is one pass in Arrow batches over whole texts, and nothing but the text enters a score.

Edge cases: null and empty texts have no hits and get the score of a text without hits. Without labels of both classes the
lexicon is empty and every score is the share of toxic labels (0 without labels). Repeated rows get equal scores; labels
that repeat count each time in the shares. A null doc_id is not held out. An empty table gives an empty result. Only the
named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm.common import table, text_of

#: Labelled rows of each class that are used for training at most.
TRAIN_ROWS = 4_000
#: Bytes of texts of a class that training reads, at most. A text of over a 64th of that is no training text.
TRAIN_BYTES = 16 << 20
#: Folds by crc32 of the id as text; fold 0 is held out.
FOLDS = 5
WINDOW, QUOTED, AIMED = 5, 0.3, 1.5
#: Lengths of stems, least length of a word that may be misspelled, least likelihood ratio and number of texts of a term.
STEM_LEN, FUZZY_LEN, LEAST_G2, LEAST_TEXTS = range(4, 10), 5, 25.0, 4
#: Words whose kind a worker remembers.
REMEMBERED = 400_000
WORD = re.compile(r"[^\W_]+")
# Words and marks that tell quotation from abuse.
REPORTING = frozenset("said says saying called calls word words wrote quote quoted quotes term phrase dit mot sagte wort dijo palabra".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi vous du dich dein ihr usted ustedes eres".split())
QUOTES = "\"“”„«»‘`"


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Automaton:
    """The Levenshtein automaton of a word: states are tuples of (place, edits), transitions are remembered."""

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits, self.known = word, edits, {}

    def start(self) -> tuple:
        return self._close({(0, 0)})

    def _close(self, state: Iterable[tuple[int, int]]) -> tuple:
        best: dict[int, int] = {}
        for place, e in state:
            while place <= len(self.word) and e <= self.edits and e < best.get(place, self.edits + 1):
                best[place] = e
                place, e = place + 1, e + 1  # a letter of the word that the term lacks
        return tuple(sorted(best.items()))

    def step(self, state: tuple, letter: str) -> tuple:
        if (got := self.known.get((state, letter))) is None:
            to = set()
            for place, e in state:
                if place < len(self.word) and self.word[place] == letter:
                    to.add((place + 1, e))
                if e < self.edits:
                    to |= {(place, e + 1), (place + 1, e + 1)}  # a letter too many in the term, or another letter
            got = self.known[state, letter] = self._close(to)
        return got

    def accepts(self, state: tuple) -> int | None:
        """The edits with which the whole word is read, None if it is not."""
        return next((e for place, e in state if place == len(self.word)), None)


def trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def intersect(word: str, root: dict, edits: int = 1) -> list[tuple[str, int]]:
    """Terms of the trie within `edits` of `word`, with their edits: automaton and trie are walked together."""
    a = Automaton(word, edits)
    found, todo = [], [(root, a.start())]
    while todo:
        node, state = todo.pop()
        for letter, child in node.items():
            if letter == "":
                if (e := a.accepts(state)) is not None:
                    found.append((child, e))
            elif to := a.step(state, letter):
                todo.append((child, to))
    return sorted(found, key=lambda x: (x[1], x[0]))


def shorter(word: str) -> Iterator[str]:
    """The word without one of its letters."""
    return (word[:i] + word[i + 1 :] for i in range(len(word)))


@dataclass
class Lexicon:
    """Terms with weights; stems match words that begin with them."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        fuzzy = [w for w in self.words if len(w) >= FUZZY_LEN]
        self.trie = trie(fuzzy)
        # words within one edit of each other are equal, or become so by taking a letter from one or from both: no others need be walked
        self.near = {v for w in fuzzy for v in (w, *shorter(w))}
        self.lengths = sorted({len(s) for s in self.stems})

    def kind(self, word: str) -> tuple[float, bool] | None:
        """The weight of the term that `word` matches, and whether it is misspelled."""
        if (w := self.words.get(word)) is not None:
            return w, False
        for n in self.lengths:
            if len(word) >= n and (w := self.stems.get(word[:n])) is not None:
                return w, False
        if word in self.near or any(v in self.near for v in shorter(word)):
            if found := intersect(word, self.trie):
                return self.words[found[0][0]], True
        return None


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: list[float]

    def score(self, features: list[float]) -> float:
        x = sum(c * f for c, f in zip(self.coefficients, [1.0, *features], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


class Scorer:
    """Features of texts; remembers the kinds of words it has met."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.met, self.hits = lexicon, set(), {}

    def features(self, text: str) -> list[float]:
        """Sums of exact and of misspelled hits (logarithms), each in proportion to the words, and different exact terms."""
        low = text.lower()
        words = WORD.findall(low)
        there = set(words)
        if fresh := there - self.met:
            if len(self.met) > REMEMBERED:
                self.met, self.hits = set(), {w: k for w, k in self.hits.items() if w in there}
            for w in fresh:
                if k := self.lexicon.kind(w):
                    self.hits[w] = k
            self.met |= there
        mine = there & self.hits.keys()
        sums = [0.0, 0.0]
        if mine:
            at = [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]
            for i, w in enumerate(words):
                if w in mine:
                    weight, misspelled = self.hits[w]
                    sums[misspelled] += weight * self.context(low, at, i)
        n = len(words) + 10
        return [math.log1p(sums[0]), 30 * sums[0] / n, math.log1p(sums[1]), 30 * sums[1] / n, math.log1p(len({w for w in mine if not self.hits[w][1]}))]

    @staticmethod
    def context(low: str, at: list[tuple[int, int, str]], i: int) -> float:
        near = at[max(0, i - WINDOW) : i + WINDOW + 1]
        before, after = low[near[0][0] : at[i][0]], low[at[i][1] : near[-1][1] + 2]
        inside = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        if inside or any(w in REPORTING for _, _, w in at[max(0, i - 2) : i]):
            return QUOTED
        return AIMED if "!" in after[:2] or any(w in SECOND_PERSON for _, _, w in near) else 1.0


def g2(a: int, b: int, m: int, n: int) -> float:
    """Likelihood ratio of a of m against b of n."""
    p = (a + b) / (m + n)
    part = lambda k, t, q: (k * math.log(k / t / q) if k else 0.0) + ((t - k) * math.log((t - k) / t / (1 - q)) if t > k and q < 1 else 0.0)
    return 2 * (part(a, m, p) + part(b, n, p))


def learn_lexicon(toxic: list[str], other: list[str]) -> Lexicon:
    """Terms that mark toxic texts, the strongest first; what one covers no longer speaks for the next."""
    m, n = len(toxic), len(other)
    sets = [set(WORD.findall(t.lower())) for t in [*toxic, *other]]
    terms = lambda ws: {(w, False) for w in ws} | {(w[:k], True) for w in ws for k in STEM_LEN if len(w) > k}
    counts = (Counter(), Counter())
    for i, ws in enumerate(sets):
        counts[i >= m].update(terms(ws))
    weight = lambda a, b: math.log((a + 0.5) / (m + 1)) - math.log((b + 0.5) / (n + 1))
    open_ = {t for t, a in counts[0].items() if a >= LEAST_TEXTS and weight(a, counts[1][t]) > 1 and g2(a, counts[1][t], m, n) > LEAST_G2}
    where: dict = {t: set() for t in open_}
    for i, ws in enumerate(sets):
        for t in terms(ws) & open_:
            where[t].add(i)
    chosen = Lexicon()
    texts = {t: (sum(i < m for i in s), sum(i >= m for i in s)) for t, s in where.items()}
    strength = lambda a, b: g2(a, b, m, n) if a * n > b * m else 0.0
    rank = {t: strength(*texts[t]) for t in where}
    while rank:
        best = max(rank, key=lambda t: (rank[t], not t[1], t[0]))
        if rank[best] < LEAST_G2:
            break
        (chosen.stems if best[1] else chosen.words)[best[0]] = max(0.1, weight(*texts[best]))
        del rank[best]
        covered = {i for i in where.pop(best) if i < m}
        # texts that this term explains count no more for terms that contain it; others keep them
        for t in [t for t in rank if t[0].startswith(best[0]) or best[0].startswith(t[0])]:
            where[t] -= covered
            texts[t] = sum(i < m for i in where[t]), texts[t][1]
            if texts[t][0] < LEAST_TEXTS:
                del rank[t]
            else:
                rank[t] = strength(*texts[t])
    return Lexicon(chosen.words, chosen.stems)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a weighted logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    c, r = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + r + 1e-9 * np.eye(len(c)), x.T @ (w * (y - p)) - r @ c)
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return c


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """A model from at most `rows` labelled rows and `max_bytes` bytes of texts of each class; docs (doc_id, text), labels (doc_id, toxic)."""
    use = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    share = {r["toxic"]: r["n"] for r in use.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        p = min(1 - 1e-6, max(1e-6, share.get(1, 0) / max(1, sum(share.values()))))
        return Model(Lexicon(), [math.log(p / (1 - p)), 0.0, 0.0, 0.0, 0.0, 0.0])
    order = F.md5(F.col("doc_id").cast("string"))
    sample = use.where("toxic = 1").orderBy(order, "doc_id").limit(rows).union(use.where("toxic = 0").orderBy(order, "doc_id").limit(rows)).distinct()
    # a text for each label, up to the bound of bytes in the order of the sample; 2 * rows rows, so that a window may order them
    fit = docs.select("doc_id", text_of().alias("text")).where(F.octet_length("text") <= max_bytes // 64)
    one = fit.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = one.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).select("doc_id", "toxic", "text").collect()
    got.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    toxic, other = ([r["text"] for r in got if r["toxic"] == k] for k in (1, 0))
    if not toxic or not other:
        return Model(Lexicon(), [math.log((share[1] + 0.5) / (share[0] + 0.5)), 0.0, 0.0, 0.0, 0.0, 0.0])
    lexicon = learn_lexicon(toxic, other)
    scorer = Scorer(lexicon)
    x = np.array([scorer.features(t) for t in [*toxic, *other]])
    y = np.repeat([1.0, 0.0], [len(toxic), len(other)])
    w = np.where(y == 1, share[1] / len(toxic), share[0] / len(other)) / (share[0] + share[1]) * len(y)
    return Model(lexicon, logistic(x, y, w).tolist())


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "held_out"), text: str = "text") -> DataFrame:
    """`keep` and score of every row of `docs`."""
    keep = list(keep)
    chosen = docs.select(*keep, text)
    schema = chosen.drop(text).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for b in batches:
            scores = [model.score(scorer.features(t or "")) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, "score"])

    return chosen.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
