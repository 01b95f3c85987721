"""Quality classifier: Bradley-Terry pairwise ranking.

Operator 3. Pairs of a better and a worse labelled document are preferences; the model learns weights w so that the chance of a
preference is the logistic function of w * (features of the better - features of the worse), which is logistic loss on feature
differences, without an intercept. The strength of a document is w * features. The threshold is a quantile of the labelled
documents' strengths, the one that splits the labels best; a score is the logistic function of the strength above the threshold.

Every labelled document outside the held-out fold takes part in all of it: in means and deviations, in preferences and in the
quantiles. Preferences are drawn inside blocks of BLOCK_ROWS documents, so that no group grows with the input; both classes are dealt
evenly over the blocks by a hash, and a class of fewer documents than blocks lends each to several. A Newton step adds up the
blocks' gradients and curvatures. Sums of blocks are decimals, so that their order doesn't matter.

Features are shares and repetition counts of the whole text. Null and empty texts have features too (zeros) and a score.
Labels without both values, or no labels, give a score of 0.5 everywhere. Repeated rows are scored each; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import cut, discard, documents, steps
from tidewave.llm.quality_rules import CLASSES, counts, per_doc, per_doc_of_words
from tidewave.llm.samples import labelled_rows, remainder

#: Preference pairs that each better document takes part in.
PAIRS_EACH = 8
RIDGE = 1e-3
#: Labelled documents of a block of preferences, at most; one more where the classes don't divide.
BLOCK_ROWS = 4096
#: The quantiles of the strengths that the threshold is chosen from.
QUANTILES = np.linspace(0.002, 0.998, 499)
MARKS = [np.frombuffer(b, np.uint8) for b in (b"!", b"|", b"@/\\_=+~^", b"{}[]()", b"\"'")]


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of features per document."""
    c = counts(raw, offs)
    n_words = c.base["n_words"].astype(np.float64)
    words, n_chars = np.maximum(n_words, 1), np.maximum(c.chars.sum(1), 1)
    shares = c.chars / n_chars[:, None]
    marks = [per_doc(np.isin(raw, m), offs) / words for m in MARKS]
    size = c.word_end - c.word_start
    same = np.zeros(len(c.hashes), bool)
    if len(same) > 1:
        same[1:] = (c.hashes[1:] == c.hashes[:-1]) & (c.doc[1:] == c.doc[:-1])
    mixed = c.hashes + c.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, once = np.unique(mixed, return_index=True)
    different = np.bincount(c.doc[once], minlength=len(n_words)) if len(once) else np.zeros(len(n_words))
    columns = [
        np.log1p(n_words),
        *(shares[:, k] for k in range(CLASSES)),
        *(np.minimum(m, 1) for m in marks),
        np.minimum(c.base["n_symbols"] / words, 2),
        c.base["n_repeat_words"] / words,
        np.log1p(c.base["n_dup_lines"]),
        c.base["word_chars"] / words / 10,
        per_doc_of_words(same, c.first) / words,
        per_doc_of_words(size <= 3, c.first) / words,
        per_doc_of_words(size == 1, c.first) / words,
        per_doc_of_words(size > 25, c.first) / words,
        different / words * np.log1p(n_words) / 5,
        (different / words),
        np.minimum(c.base["n_symbols"] / words, 0.05) * 20,
        np.minimum(marks[1], 0.05) * 20,
        np.minimum(marks[0], 0.05) * 20,
        np.minimum(c.base["n_repeat_words"] / words, 0.2) * 5,
    ]
    return np.stack(columns, 1).astype(np.float64)


@dataclass
class Ranking:
    """A fitted model: standardisation, weights, and the strength at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -40, 40)))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in steps(batches):
            x = features(raw, offs)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def in_blocks(labelled: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(block, rows) of labelled documents (doc_id, y, x), sizes by y. rows are (doc_id, x, y, own) in this order; own: here the document
    counts for itself, and isn't lent."""
    n_blocks = -(-sum(sizes.values()) // BLOCK_ROWS)
    several = labelled.groupBy("doc_id", "y", "x").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    hashed = several.withColumn("h", F.xxhash64("doc_id", "x", "copy")).withColumn("bucket", F.pmod("h", F.lit(n_blocks)))
    before = hashed.groupBy("y", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("y").orderBy("bucket")) - F.col("count"))
    ranked = hashed.withColumn("k", F.row_number().over(Window.partitionBy("y", "bucket").orderBy("h", "doc_id", "x", "copy")) - 1).join(before.drop("count"), ["y", "bucket"])
    first = (F.col("k") + F.col("before")) % n_blocks
    among = F.when(F.col("y") == 1, sizes[1]).otherwise(sizes[0]).cast("long")
    dealt = ranked.withColumn("first", first).withColumn("block", F.explode(F.sequence("first", F.lit(n_blocks - 1).cast("long"), among)))
    row = F.struct("doc_id", "x", "y", (F.col("block") == F.col("first")).alias("own"))
    return dealt.groupBy("block").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, features, labels, own) of each block."""
    for batch in batches:
        for k, block in enumerate(batch.column("block").to_pylist()):
            rows = batch.column("rows").slice(k, 1).flatten()
            yield block, matrix(rows.field("x")), rows.field("y").to_numpy(zero_copy_only=False), rows.field("own").to_numpy(zero_copy_only=False)


def summed(blocks: DataFrame, numbers: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums over all blocks of some numbers of each, the same in any order of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches):
            yield pa.RecordBatch.from_arrays([pa.array([numbers(*block)], pa.list_(pa.float64()))], ["v"])

    parts = blocks.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v"))
    found = parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,18)")).cast("double").alias("v")).collect()
    return np.array([r["v"] for r in sorted(found, key=lambda r: r["at"])])


def preferences(z: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
    """Differences of the better and the worse document of each pair of a block."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(17 + block)
    many = max(len(good), len(bad)) * PAIRS_EACH
    better = np.concatenate([rng.permutation(good) for _ in range(-(-many // len(good)))])[:many]
    worse = np.concatenate([rng.permutation(bad) for _ in range(-(-many // len(bad)))])[:many]
    return z[better] - z[worse]


def fit(blocks: DataFrame, sizes: dict[int, int], rounds: int = 25) -> Ranking:
    """Newton steps on the pairwise logistic loss over the preferences of all blocks."""
    n = sum(sizes.values())
    mean = summed(blocks, lambda _, x, y, own: x[own].sum(0)) / n
    scale = np.maximum(np.sqrt(summed(blocks, lambda _, x, y, own: ((x[own] - mean) ** 2).sum(0)) / n), 1e-6)
    w = np.zeros(len(mean))
    width = len(w)
    for _ in range(rounds):

        def slopes(block: int, x: np.ndarray, y: np.ndarray, own: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            difference = preferences(np.clip((x - mean) / scale, -6, 6), y, block)
            p = 1 / (1 + np.exp(-np.clip(difference @ w, -40, 40)))
            curve = (difference * (p * (1 - p))[:, None]).T @ difference
            return np.concatenate([[len(p)], difference.T @ (p - 1), curve.ravel()])

        total = summed(blocks, slopes)
        gradient = total[1 : width + 1] / total[0] + RIDGE * w
        curve = total[width + 1 :].reshape(width, width) / total[0] + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    model = Ranking(mean, scale, w, 0.0)
    model.threshold = threshold(blocks, model, sizes)
    return model


def threshold(blocks: DataFrame, model: Ranking, sizes: dict[int, int]) -> float:
    """The middle between the strengths on both sides of the quantile that splits the labels best; each class counts half. Different
    strengths are sorted over all tasks, and those at the quantiles come to the driver with the documents up to them."""

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y, own in each_block(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(x[own])), pa.array((y[own] == 1).astype(np.int64)), pa.array((y[own] == 0).astype(np.int64))], ["s", "good", "bad"])

    different = blocks.mapInArrow(strengths, "s double, good long, bad long").groupBy("s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ordered = cut(different.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "strengths")
    parts = sorted(ordered.groupBy("part").agg(F.min("s").alias("s"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda r: r["s"])
    ends = np.cumsum([(r["good"], r["bad"]) for r in parts], axis=0)
    start = {r["part"]: (int(end[0]) - r["good"], int(end[1]) - r["bad"]) for r, end in zip(parts, ends, strict=True)}
    n = sum(sizes.values())
    place = QUANTILES * (n - 1)
    low = np.floor(place).astype(np.int64)
    high = np.minimum(low + 1, n - 1)
    wanted = np.unique(np.concatenate([low, high]))

    def at_quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = np.array([start[k] for k in batch.column("part").to_pylist()], np.int64).reshape(-1, 2)
            good, bad = (batch.column(c).to_numpy() + begin[:, k] for k, c in enumerate(("good_to", "bad_to")))
            first = good + bad - batch.column("good").to_numpy() - batch.column("bad").to_numpy()
            hit = np.searchsorted(wanted, good + bad) > np.searchsorted(wanted, first)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("s").to_numpy()[hit]), pa.array(good[hit]), pa.array(bad[hit])], ["s", "good", "bad"])

    upto = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    running = ordered.select("part", "s", "good", "bad", F.sum("good").over(upto).alias("good_to"), F.sum("bad").over(upto).alias("bad_to"))
    found = sorted(running.mapInArrow(at_quantiles, "s double, good long, bad long").collect(), key=lambda r: r["s"])
    s, good, bad = (np.array([r[c] for r in found]) for c in ("s", "good", "bad"))
    a, b = (np.searchsorted(good + bad, k, "right") for k in (low, high))
    share = place - low
    value = np.where(share < 0.5, s[a] + (s[b] - s[a]) * share, s[b] - (s[b] - s[a]) * (1 - share))
    last = np.where(value >= s[b], b, a)  # the largest strength up to the quantile
    right = (sizes[1] - good[last]) / sizes[1] + bad[last] / sizes[0]
    best = max(range(len(QUANTILES)), key=lambda k: (right[k], -abs(QUANTILES[k] - sizes[0] / n)))
    at = float(value[best])
    side = ordered.agg(F.max(F.when(F.col("s") <= at, F.col("s"))).alias("below"), F.min(F.when(F.col("s") > at, F.col("s"))).alias("above")).collect()[0]
    discard(ordered)
    return at if side["below"] is None or side["above"] is None else (side["below"] + side["above"]) / 2


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1) -> Ranking | None:
    """Fit on all labelled documents outside the held-out fold; rows are the featured documents. None where the labels don't have both
    values."""
    labelled = cut(rows.join(labelled_rows(labels, label, remainder("doc_id", folds) != held_out), "doc_id"), "labelled")
    sizes = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    model = None
    if len(sizes) == 2:
        blocks = cut(in_blocks(labelled, sizes), "preference-blocks")
        model = fit(blocks, sizes)
        discard(blocks)
    discard(labelled)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = cut(featured(documents(docs).select("doc_id", "text")), "quality-features")
    model = train(rows, labels, label, folds, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch.column("x"))) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
