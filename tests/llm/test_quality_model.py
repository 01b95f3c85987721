"""The ranking of op3 over all labelled documents, in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SMALL, newton
from tidewave.llm import quality_model, samples


def test_labels_beyond_a_sample_count(spark):
    """Of 21,500 labelled documents, only those with the largest hashes are labelled 0: a fit on the first 20,000 sees one class."""
    rows = spark.range(40_000).withColumnRenamed("id", "doc_id").where(samples.remainder("doc_id", 3) != 1).orderBy(F.xxhash64("doc_id")).limit(21_500)
    last = sorted((r[0] for r in rows.select(F.xxhash64("doc_id")).collect()), reverse=True)[1_000]
    labels = rows.withColumn("quality", (F.xxhash64("doc_id") <= last).cast("int")).localCheckpoint()
    docs = labels.select("doc_id", F.when(F.col("quality") == 1, "a calm and even line of plain words").otherwise("!!! $$ buy || buy buy $$ !!!").alias("text"))
    got = quality_model.quality_scores(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.min("predicted").alias("low"), F.max("predicted").alias("high")).collect()
    assert sorted(map(tuple, got)) == [(0, 1_000, 0, 0), (1, 20_500, 1, 1)]


@pytest.mark.parametrize("block_rows", [5, 20])
def test_blocks_equal_a_plain_fit(spark, monkeypatch, block_rows):
    """Each document counts once in means and quantiles, each block has both classes (of 5 rows: more blocks than documents of one class),
    and the weights have the lowest loss over the preferences of all blocks. Some documents stand there twice."""
    monkeypatch.setattr(quality_model, "BLOCK_ROWS", block_rows)
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.where("doc_id % 2 = 0"))
    rows = quality_model.featured(quality_model.documents(docs)).localCheckpoint()
    labelled = rows.join(samples.labelled_rows(labels, "quality", samples.remainder("doc_id", 3) != 1), "doc_id").localCheckpoint()
    plain = sorted((r.doc_id, r.x, r.y) for r in labelled.collect())
    sizes = {k: sum(y == k for _, _, y in plain) for k in (0, 1)}
    blocks = {r.block: r.rows for r in quality_model.in_blocks(labelled, sizes).collect()}
    assert sorted((r.doc_id, r.x, r.y) for block in blocks.values() for r in block if r.own) == plain
    assert sorted(blocks) == list(range(-(-len(plain) // block_rows)))
    assert all({r.y for r in block} == {0, 1} and len(block) <= block_rows + 1 for block in blocks.values())
    assert any(not r.own for block in blocks.values() for r in block) == (block_rows == 5)

    x, y = np.array([row for _, row, _ in plain]), np.array([label for _, _, label in plain])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    scaled = lambda x: np.clip((x - mean) / scale, -6, 6)
    pairs = np.concatenate([quality_model.preferences(scaled(np.array([r.x for r in block])), np.array([r.y for r in block]), k) for k, block in blocks.items()])

    def loss(w):
        p = 1 / (1 + np.exp(-pairs @ w))
        return pairs.T @ (p - 1) / len(pairs) + quality_model.RIDGE * w, (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + quality_model.RIDGE * np.eye(len(w))

    w = newton(loss, x.shape[1])
    model = quality_model.train(rows, labels)
    assert np.allclose(model.mean, mean, atol=1e-12) and np.allclose(model.scale, scale, atol=1e-9) and np.allclose(model.weights, w, atol=1e-6)
    s = model.strength(x)
    split = lambda q: ((s[y == 1] > np.quantile(s, q)).mean() + (s[y == 0] <= np.quantile(s, q)).mean(), -abs(q - sizes[0] / len(y)))
    at = np.quantile(s, max(quality_model.QUANTILES, key=split))
    assert abs(model.threshold - (s[s > at].min() + s[s <= at].max()) / 2) < 1e-9
