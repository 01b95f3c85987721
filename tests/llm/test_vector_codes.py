"""Vector codes against plain integer arithmetic, and rows of all kinds."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidewave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, size string"


def plain(rows, rounds=vc.ROUNDS):
    """(vec_id, code, error, label_error, digest) by the rules, one comparison after another."""
    rows = sorted((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(rows[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in rows] for p in range(4)]
    books = [part[:256] for part in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            mine = [near(x, books[p])[1] for x in parts[p]]
            for n in range(len(books[p])):
                own = [x for x, m in zip(parts[p], mine, strict=True) if m == n]
                if own:
                    books[p][n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    found = [[near(parts[p][k], books[p]) for p in range(4)] for k in range(len(rows))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted((i, "".join(f"{n:02x}" for _, n in f), e, by_label[label], digest) for (i, _, label), f, e in zip(rows, found, errors, strict=True))


def f32(x):
    return float(np.float32(x))


def made(n, size, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [f32(rng.gauss(0, spread)) for _ in range(size)], rng.choice([0, 1, 1, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "size"), [(330, 8), (40, 16), (1, 4)])
def test_codes_equal_plain_arithmetic(spark, n, size):
    rows = made(n, size, n)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * (size - 1) + [None], 0), (n + 3, [float("nan")] * size, None), (n + 4, [float("inf")] + [0.0] * (size - 1), 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, vc.vector_codes(df).collect())) == plain(rows)


def test_copies_ties_and_large_values(spark):
    """Many equal vectors (unused entries stay), and differences that don't fit 32 bits."""
    rows = [(i, [0.5, -0.25, 1.0, 0.0], None) for i in range(300)] + [(300 + i, [f32(100.0 * i), -3000.5, 0.0, f32(i / 7)], i % 2) for i in range(20)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert sorted(map(tuple, vc.vector_codes(df).collect())) == plain(rows)


def test_partial_distances_lose_no_entry():
    rng = np.random.default_rng(3)
    for largest in (3, 500, 1 << 20):
        x, book = rng.integers(-largest, largest, (2500, 13)), rng.integers(-largest, largest, (256, 13))
        whole = np.square(x[:, None, :] - book[None]).sum(2)
        code, error = vc.nearest(x, book)
        assert (code == whole.argmin(1)).all() and (error == whole.min(1)).all()


def test_odd_tables(spark):
    df = spark.createDataFrame([(*r, "", "") for r in made(30, 8, 1)], SCHEMA)
    assert vc.vector_codes(df.where("false")).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vc.vector_codes(spark.createDataFrame([(1, [1.0] * 6, 1, "", "")], SCHEMA))
    mixed = df.unionByName(spark.createDataFrame([(99, [1.0] * 4, 1, "", ""), (None, [0.5] * 8, 1, "", "")], SCHEMA))
    found = [r.vec_id for r in vc.vector_codes(mixed).collect()]
    assert len(found) == 31 and 99 not in found and None in found
    twice = sorted(map(tuple, vc.vector_codes(df.unionByName(df)).select("vec_id", "code").collect()))
    assert len(twice) == 60 and twice[::2] == twice[1::2]
