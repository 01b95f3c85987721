"""Toxicity: a logistic model of words that counterfactual pairs keep neutral about identity terms.

Operator 5. Features are the words of a text (lower case, without punctuation), their first four and five letters, and marks
where two or more different words, or over a hundredth of all, begin alike. Those that speak for toxicity and best tell the
labelled sample's classes apart (chi-square over documents) are the vocabulary. In every labelled document
with identity terms, each term is swapped for the next of its kind; the loss is logistic loss plus BALANCE times the mean squared
change of the score by the swap. Identity terms are always in the vocabulary, so that a chance link with a label is unlearned.

Null and empty texts have the score of a text without any known word. Labels without both values give 0.5 everywhere. Repeated
rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import cut, documents
from tidewave.llm.samples import labelled_sample, remainder, sample_texts

VOCABULARY = 1200
#: A word has to be in so many documents of the sample.
LEAST_DOCS = 6
RIDGE, BALANCE = 3e-4, 5.0
#: Identity terms by kind, in four languages. A swap takes the next term of its row.
IDENTITIES = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["immigrant", "refugee", "foreigner", "citizen"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["disabled", "blind", "deaf", "old", "young"],
    ["frauen", "männer"], ["frau", "mann"], ["christen", "muslime", "juden"], ["ausländer", "deutsche", "flüchtlinge"],
    ["femmes", "hommes"], ["femme", "homme"], ["chrétiens", "musulmans", "juifs"], ["étrangers", "français", "réfugiés"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["cristianos", "musulmanes", "judíos"], ["extranjeros", "españoles", "refugiados"],
]
NEXT_TERM = {word: row[(i + 1) % len(row)] for row in IDENTITIES for i, word in enumerate(row)}
EDGES = re.compile(r"[^\w]+")


def words_of(text: str) -> set[str]:
    """The different words of a text."""
    return set(EDGES.split(text.lower())) - {""}


def features_of(words: set[str]) -> set[str]:
    """Words, their beginnings (an asterisk), beginnings of two or more words (2), and of many among all words (d)."""
    starts = Counter([w[:4] + "*" for w in words if len(w) > 4])
    starts.update([w[:5] + "*" for w in words if len(w) > 5])
    many = {f for f, k in starts.items() if k > 1}
    least = len(words) / 100
    return words | starts.keys() | {f + "2" for f in many} | {f + "d" for f in many if starts[f] > least}


def swapped(words: set[str]) -> set[str]:
    """The words of the counterfactual text."""
    return {NEXT_TERM.get(w, w) for w in words}


def vocabulary(texts: DataFrame) -> list[str]:
    """The features that tell the classes of (text, y) apart best, and all identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y].update(features_of(words_of(text)))
            for y in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(seen[y]), pa.string()), pa.array(np.full(len(seen[y]), y, np.int32)), pa.array(list(seen[y].values()), pa.int64())], ["feature", "y", "n"])

    sizes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    n0, n1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    terms = sorted({f for w in NEXT_TERM for f in features_of({w})})
    if not n0 or not n1:
        return terms
    table = texts.select("text", "y").mapInArrow(run, "feature string, y int, n long").groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    chi = (a * d - b * c) * (a * d - b * c) * F.lit(n0 + n1) / ((a + b) * F.greatest(c + d, F.lit(0.5)) * F.lit(n1) * F.lit(n0))
    best = table.where(F.col("a") + F.col("b") >= LEAST_DOCS).select("feature", chi.alias("chi")).where("chi > 10").where(a / n1 > b / n0).orderBy(F.desc("chi"), "feature").limit(VOCABULARY)
    return sorted({r["feature"] for r in best.collect()} | set(terms))


def design(rows: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], np.int64)


def fit(rows: list[list[int]], pairs: list[tuple[int, list[int]]], y: np.ndarray, width: int, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated gradient steps. pairs: (row, features of its counterfactual)."""
    rows = [[*r, width] for r in rows]  # the last column is the intercept
    pairs = [(i, [*r, width]) for i, r in pairs]
    at, col = design(rows, width)
    who = np.array([i for i, _ in pairs], np.int64)
    c_at, c_col = design([f for _, f in pairs], width)
    n = len(y)
    weight = np.where(y == 1, np.sqrt((n - y.sum()) / y.sum()), 1.0)
    weight *= n / weight.sum()
    shrink = np.append(np.full(width, RIDGE), 0)

    def change(w: np.ndarray) -> np.ndarray:
        """X.T * 2 * BALANCE / pairs * X w for the rows' differences from their counterfactuals."""
        if not pairs:
            return np.zeros(width + 1)
        moved = np.bincount(at, w[col], n)[who] - np.bincount(c_at, w[c_col], len(pairs))
        own = np.zeros(n)
        np.add.at(own, who, moved)
        return 2 * BALANCE / len(pairs) * (np.bincount(col, own[at], width + 1) - np.bincount(c_col, moved[c_at], width + 1))

    v = np.ones(width + 1)
    top = 1.0
    for _ in range(30):  # the largest curvature, for the step
        v = np.bincount(col, (weight * np.bincount(at, v[col], n))[at], width + 1) * 0.25 / n + change(v) + shrink * v
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    w = np.zeros(width + 1)
    look, t = w.copy(), 1.0
    for _ in range(rounds):
        residual = weight * (1 / (1 + np.exp(-np.clip(np.bincount(at, look[col], n), -40, 40))) - y) / n
        new = look - (np.bincount(col, residual[at], width + 1) + shrink * look + change(look)) / (1.1 * top)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (new - w) @ (look - new) > 0:  # it overshot: start the momentum again
            t_new = 1.0
        look = new + (t - 1) / t_new * (new - w) if t_new > 1 else new
        w, t = new, t_new
    return w[:width], float(w[width])


def train(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> tuple[dict[str, float], float] | None:
    """Weights of the vocabulary's features and the intercept; None where the labels don't have both values."""
    sample = cut(labelled_sample(labels, label, remainder("doc_id", folds) != held_out), "sample")
    texts = cut(sample_texts(docs, sample).select("doc_id", "text", "y"), "labelled-texts")
    names = vocabulary(texts)
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                own.append(sorted(index[f] for f in features_of(words) if f in index))
                swap = swapped(words)
                other.append(sorted(index[f] for f in features_of(swap) if f in index) if swap != words else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], ["doc_id", "y", "own", "other"])

    rows = texts.mapInArrow(run, "doc_id long, y int, own array<int>, other array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["own"]))
    y = np.array([r["y"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    weights, bias = fit([r["own"] for r in rows], [(i, r["other"]) for i, r in enumerate(rows) if r["other"] is not None], y, len(names))
    return {f: float(weights[i]) for f, i in index.items() if weights[i] != 0}, bias


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(docs)
    model = train(docs, labels, label, folds, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model:
                weights, bias = model
                known = weights.keys()
                z = np.array([sum(weights[f] for f in sorted(features_of(words_of(text)) & known)) for text in batch.column("text").to_pylist()]) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
