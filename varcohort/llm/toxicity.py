"""Operator 5: toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes homoglyphs and digit substitutions. The lexicon (words, and word beginnings of 3 to 9 letters, with
their log-odds) and the exception phrases (word pairs that clear a match) are counted over labelled documents, and a
logistic model turns the matches, normalised by length, into a score. Everything is learned from at most ``sample``
labelled rows outside the held-out fold, read once; how many documents an entry needs is settled by
cross-validation among those rows. Every document is scored whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Look-alikes of Latin letters, and characters that stand for letters inside words.
HOMOGLYPHS = str.maketrans("аеорсухівкмнтѕјԁɡɩοαερτυνικ", "aeopcyxibkmhtsjdgioaeptuvik")
DIGITS = str.maketrans("0134578@$", "oieastbas")
INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$8]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+|[0134578]+(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that can be entries; whole words of any length can be too.
SHORTEST, LONGEST = 3, 9
#: Shares of the toxic documents that an entry must occur in, of which cross-validation takes one.
SUPPORTS = (0.002, 0.005, 0.012, 0.03)
FOLDS = 3
#: Entries, and phrases, that a task counts before it hands them on.
PART = 100_000


def fold(text: str) -> list[str]:
    """The words of a text, folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    return WORD.findall(INSIDE.sub(lambda m: m[0].translate(DIGITS), text))


def beginnings(word: str) -> Iterator[str]:
    """The entries that would match a word: ' abc' for a beginning, ' abc ' for all of it."""
    for n in range(SHORTEST, min(len(word), LONGEST) + 1):
        yield f" {word[:n]}"
    yield f" {word} "


class Model(NamedTuple):
    lexicon: dict[str, float] = {}
    exceptions: frozenset[tuple[str, str]] = frozenset()
    weights: np.ndarray = np.array([-3.0, 0, 0, 0, 0, 0])

    def matches(self, words: list[str], hits: list[tuple[int, str]]) -> list[tuple[int, float]]:
        """(index of the word, weight of its heaviest entry), exception phrases left out."""
        best: dict[int, float] = {}
        for index, entry in hits:
            weight = self.lexicon.get(entry)
            if weight is not None and weight > best.get(index, -1e9):
                best[index] = weight
        if self.exceptions:
            return [(i, w) for i, w in best.items() if not self.exceptions.intersection(pairs_at(words, i))]
        return list(best.items())

    def features(self, words: list[str], hits: list[tuple[int, str]]) -> tuple[float, ...]:
        """Matched weight: largest, per square root of the length, per word; distinct matched words; their weight."""
        found = self.matches(words, hits)
        n = max(len(words), 1)
        total = sum(w for _, w in found)
        kinds = {words[i]: w for i, w in found}
        return (max((w for _, w in found), default=0.0), total / n**0.5, 20 * total / n, float(np.log1p(len(kinds))), float(np.log1p(sum(kinds.values()))))


def pairs_at(words: list[str], i: int) -> list[tuple[str, str]]:
    return [tuple(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1]


class Matcher:
    """An Aho-Corasick automaton over the entries of one or more lexicons."""

    def __init__(self, *lexicons: dict[str, float]):
        entries = set().union(*lexicons)
        self.find = None
        if entries:
            self.find = ahocorasick.Automaton()
            for entry in entries:
                self.find.add_word(entry, entry)
            self.find.make_automaton()

    def hits(self, words: list[str]) -> list[tuple[int, str]]:
        """(index of the word, entry) of every match."""
        if self.find is None or not words:
            return []
        found = [(end - len(entry) + 1, entry) for end, entry in self.find.iter(f" {' '.join(words)} ")]
        if not found:
            return []
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        return list(zip(np.searchsorted(starts, [at for at, _ in found]).tolist(), (entry for _, entry in found), strict=True))


def in_fold(doc_id: Column) -> Column:
    """Held out: crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def lexicon_of(entries: list[tuple[str, int, int]], p_all: int, n_all: int, support: float, least: float) -> dict[str, float]:
    """Entries (entry, toxic documents, others) frequent and telling enough, unless a shorter one tells nearly as much."""
    floor, out = max(2.0, support * p_all), {}
    for entry, p, n in entries:
        if p < floor:
            continue
        w = math.log((p + 0.5) / (p_all + 1)) - math.log((n + 0.5) / (n_all + 1))
        known = max((out.get(entry[:i], 0.0) for i in range(SHORTEST + 1, min(len(entry), LONGEST + 2))), default=0.0)
        if w >= least and w > known + 0.5:
            out[entry] = w
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, least: float = 2.2, supports: tuple[float, ...] = SUPPORTS) -> Model:
    """A model learned from at most ``sample`` labelled documents outside the held-out fold.

    The rows are dealt into ``FOLDS`` parts. For each support and part, a model that has not seen the part is measured
    on it; the support with the least log loss is taken, ties to the largest. All of these models come from the
    same three passes over the rows. What reaches the driver are entries, phrases and features of these rows.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows are sent
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = cut(rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("part")), "labelled")
    sizes = {(r["toxic"], r["part"]): r["count"] for r in rows.groupBy("toxic", "part").count().collect()}
    whole = FOLDS  # the part of no row: its model has seen them all
    size = lambda toxic, left: sum(n for (t, part), n in sizes.items() if t == toxic and part != left)
    if not size(1, whole) or not size(0, whole):
        return Model()
    parts = [i for i in range(FOLDS) if size(1, i) and size(0, i)] if len(supports) > 1 else []
    grid = [(s, left) for s in supports for left in (*parts, whole)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many toxic (p) and other (n) documents of each part have each entry, in runs of bounded size."""
        seen: Counter = Counter()

        def run() -> pd.DataFrame:
            entries, toxic, part = zip(*seen, strict=True)
            return pd.DataFrame({"entry": entries, "toxic": toxic, "part": part, "n": seen.values()})

        for b in batches:
            for text, toxic, part in zip(b["text"], b["toxic"].tolist(), b["part"].tolist(), strict=True):
                seen.update({(e, toxic, part) for w in set(fold(text)) for e in beginnings(w)})
                if len(seen) > PART:
                    yield run()
                    seen = Counter()
        if seen:
            yield run()

    cells = [F.sum(F.when((F.col("toxic") == t) & (F.col("part") == i), F.col("n")).otherwise(0)).alias(f"n{t}{i}") for t in (0, 1) for i in range(FOLDS)]
    counted = rows.mapInPandas(count, "entry string, toxic int, part int, n long").groupBy("entry").agg(*cells)
    entries = counted.where(sum((F.col(f"n1{i}") for i in range(FOLDS)), F.lit(0)) >= max(2.0, min(supports) * size(1, whole) / 2)).collect()
    entries.sort(key=lambda r: (len(r["entry"]), r["entry"]))
    sums = {left: [(r["entry"], *(sum(r[f"n{t}{i}"] for i in range(FOLDS) if i != left) for t in (1, 0))) for r in entries] for left in {left for _, left in grid}}
    models = [Model(lexicon_of(sums[left], size(1, left), size(0, left), s, least)) for s, left in grid]

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, seen = Matcher(*(m.lexicon for m in models)), Counter()

        def run() -> pd.DataFrame:
            k, toxic, a, b = zip(*seen, strict=True)
            return pd.DataFrame({"model": k, "toxic": toxic, "a": a, "b": b, "n": seen.values()})

        for b in batches:
            for text, toxic, part in zip(b["text"], b["toxic"].tolist(), b["part"].tolist(), strict=True):
                words = fold(text)
                hits = matcher.hits(words)
                for k, m in enumerate(models):
                    if hits and grid[k][1] != part:
                        seen.update({(k, toxic, *pair) for i, _ in m.matches(words, hits) for pair in pairs_at(words, i)})
                if len(seen) > PART:
                    yield run()
                    seen = Counter()
        if seen:
            yield run()

    pairs = rows.mapInPandas(phrases, "model int, toxic int, a string, b string, n long").groupBy("model", "a", "b")
    pairs = pairs.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n")).where("n >= 3").collect()
    clears = [{(r["a"], r["b"]) for r in pairs if r["model"] == k and r["n"] * size(1, left) > 4 * r["p"] * size(0, left)} for k, (_, left) in enumerate(grid)]
    models = [m._replace(exceptions=frozenset(c)) for m, c in zip(models, clears, strict=True)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(*(m.lexicon for m in models))
        for b in batches:
            x = []
            for text in b["text"]:
                words = fold(text)
                hits = matcher.hits(words)
                x.append([f for m in models for f in m.features(words, hits)])
            yield pd.DataFrame({"x": x, "toxic": b["toxic"], "part": b["part"]})

    points = rows.mapInPandas(measure, "x array<double>, toxic int, part int").toPandas()  # at most ``sample`` rows
    x, y, part = np.array(points["x"].tolist()).reshape(len(points), len(models), -1), points["toxic"].to_numpy(), points["part"].to_numpy()
    order = np.lexsort((*x.reshape(len(x), -1).T, y, part))  # sums don't depend on which task was first
    x, y, part = x[order], y[order], part[order]
    models = [m._replace(weights=logistic(x[part != left, k], y[part != left])) for k, (m, (_, left)) in enumerate(zip(models, grid, strict=True))]
    loss = dict.fromkeys(supports, 0.0)
    for k, (s, left) in enumerate(grid):
        if left != whole:
            p = np.clip(probability(x[part == left, k], models[k].weights), 1e-6, 1 - 1e-6)
            loss[s] -= float(np.log(np.where(y[part == left] == 1, p, 1 - p)).sum())
    best = min(supports, key=lambda s: (round(loss[s], 9), -s))
    return models[grid.index((best, whole))]


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1) added; all other columns are kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # entries and phrases of at most ``sample`` rows

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        matcher = Matcher(m.lexicon)
        for texts in batches:
            folded = (fold(t or "") for t in texts)
            x = np.array([m.features(words, matcher.hits(words)) for words in folded]).reshape(len(texts), len(m.weights) - 1)
            yield pd.Series(probability(x, m.weights))

    return docs.withColumn(name, rate(F.coalesce(F.col("text"), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts get the score of a text without matches; a null doc_id is not held out; repeated rows get
    the same score; an empty table gives none; without labels of both kinds every score is low. Labels that are
    null or neither 0 nor 1 aren't used, and of several labels for a document the largest counts; of several texts under
    one id the first in order is learned from, and each is scored.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
