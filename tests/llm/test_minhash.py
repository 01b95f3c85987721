"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewave.llm import common as common_module
from tidewave.llm import minhash

SF = "/root/testdata/sf0.001"


def word_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows, percent=85):
    sets = [(d, word_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in minhash.near_duplicates(df).collect())


def test_equals_brute_force_on_test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_chains_stars_and_copies(spark):
    random.seed(1)
    base = [f"w{random.randrange(10**6)}" for _ in range(300)]
    rows, text = [], list(base)
    for k in range(30):  # each differs from the last in a few words, so that only neighbours link
        text = list(text)
        text[random.randrange(300)] = f"x{k}"
        rows.append((100 - k, " ".join(text)))
    rows += [(200 + k, " ".join(base)) for k in range(20)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, "ONE two"), (305, "one two three")]
    rows += [(400, "long " * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 7, 8)], "doc_id long, text string, key long, n long")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df).collect()) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (850, 75, 75))
    parts = [np.concatenate([both, a]), np.concatenate([both, b]), np.concatenate([both, a, b])]
    x, y, z = (minhash.registers(np.sort(p), np.array([0, len(p)])) for p in parts)
    assert (minhash.merge(x, y) == z).all()
    assert abs(minhash.estimate(x, y, np.array([925.0]), np.array([925.0]))[0] - 0.85) < 0.12


def test_rows_that_share_an_id(spark):
    """(5, W) and (5, V) are two documents of one id; each links with its own near copy, in any order of rows."""
    random.seed(8)
    one, two = ([f"{c}{random.randrange(10**6)}" for _ in range(200)] for c in "wv")
    near = lambda words: " ".join([*words[:-1], "x"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, near(two)), (7, near(one)), (8, " ".join(one[:40]))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted(run(spark, rows))
        assert [(d, c, k) for d, _, c, k in got] == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True)]


def test_without_near_copies_keeps_unique_rows_of_an_id(spark):
    random.seed(9)
    one, two = (" ".join(f"{c}{random.randrange(10**6)}" for _ in range(80)) for c in "wv")
    rows = [(5, one, "en"), (5, two, "en"), (3, two, "de"), (9, one, "b"), (9, one, "a"), (None, one, "x"), (None, None, "y"), (4, "", "z"), (6, None, None), (11, "lone text", "q"), (11, "lone text", "p")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit("clash"), "tie": F.lit(1), "node": F.lit(2), "first": F.lit(3)})
        got = minhash.without_near_copies(df)
        assert got.columns == df.columns
        assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == sorted([(3, two, "de"), (5, one, "en"), (None, one, "x"), (None, None, "y"), (4, "", "z"), (6, None, None), (11, "lone text", "p")], key=str)


def test_words_that_fool_hashes_modulo_powers_of_two(spark):
    letters = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    turned = str.maketrans("ab", "ba")
    rows = [(k, t) for k, t in enumerate(t for n in (1024, 4096, 16384) for t in (letters(n), letters(n).translate(turned)))]
    rows += [(20 + k, " ".join([*(f"w{j}" for j in range(30)), t])) for k, (_, t) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """Sets of equal numbers by hash, but of different words, aren't linked."""
    texts = ["Apple banana cherry date elder fig", "apple BANANA cherry date elder fig", "apple banana cherry date elder gap"]
    common, union = minhash.shared_sizes(pa.array(texts), np.array([0, 0]), np.array([1, 2]))
    assert common.tolist() == [2, 1] and union.tolist() == [2, 3]
    monkeypatch.setattr(common_module.Spans, "__call__", lambda self, a, b: np.zeros(len(a), np.uint64))
    long = [" ".join(f"{c}longer-than-seven-{k}" for k in range(9)) for c in "ab"]
    common, union = minhash.shared_sizes(pa.array([*long, long[0]]), np.array([0, 0]), np.array([1, 2]))
    assert common.tolist() == [0, 5] and union.tolist() == [10, 5]
