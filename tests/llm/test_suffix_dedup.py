"""Repeated passages against brute force over all windows, and the transform against sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.llm import suffix_dedup as sd
from tidewave.llm.common import TIDY, cut

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in sd.remove_repeats(df, **kw).collect())


def planted():
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(22), prose(60)
    rows = []
    for d in range(120):
        parts = [prose(random.randint(0, 60)), line if d % 3 else "", prose(random.randint(0, 20)), passage[random.randint(0, 40) :] if d % 4 == 0 else ""]
        random.shuffle(parts)
        rows.append((d * 7 % 121, " ".join(parts)))
    copy = prose(150)
    rows += [(200 + k, copy) for k in range(15)]
    rows += [(300 + k, copy[:400] + word() + copy[420:]) for k in range(15)]
    rows += [(400, None), (401, ""), (402, "x" * 99), (403, "y" * 100), (404, "z" * 101), (405, "ab" * 3000), (406, "é" * 500), (407, (prose(30) + " ") * 6)]
    return rows


def test_planted_passages(spark):
    rows = planted()
    assert run(spark, rows) == brute(rows)


def test_hot_collections_are_split_exactly(spark):
    rows = planted()
    assert run(spark, rows, hot=3) == brute(rows)


def test_test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_missing_id(spark):
    assert run(spark, []) == []
    got = spark.createDataFrame([(None, "q" * 300), (1, "q" * 300), (1, "q" * 300)], "doc_id long, text string")
    rows = [tuple(r)[:3] for r in sd.remove_repeats(got).collect()]
    assert sorted(rows, key=str) == sorted([(None, 300, 0), (1, 300, 201 - 1 + 99), (1, 300, 201 - 1 + 99)], key=str)


def test_rows_that_share_an_id(spark):
    """Different texts of an id are documents of their own: no byte goes that doesn't repeat, in any order of rows."""
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 7)))
    one, two = (" ".join(word() for _ in range(n)) for n in (400, 330))
    rows = [(5, one), (2, two), (5, "hi"), (5, two + " and " + two), (7, one), (7, one)]
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        results.append(sorted(run(spark, rows)))
    assert results[0] == results[1] == results[2]
    got = {(d, n): removed for d, n, removed, _, _ in results[0]}
    size = len(one)
    assert got[2, len(two)] == 0 and got[5, 2] == 0 and got[5, size] == 0 and got[7, size] == size
    assert got[5, 2 * len(two) + 5] == 2 * len(two)


def test_columns_of_any_name_and_very_long_texts(spark):
    random.seed(6)
    body = "".join(random.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, body), (2, "x" * 10 + body[70_000:140_000] + "y"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_ranges", "tie", "from", "to", "start", "anchor", "wanted", "bytes", "windows", "later"):
        df = df.withColumn(c, F.lit("clash"))
    got = sd.without_repeats(df)
    assert got.columns == df.columns
    left = {r.doc_id: r.text for r in got.collect()}
    assert left == {1: body, 2: "x" * 10 + "y", 3: ""}
    assert sorted(tuple(r) for r in sd.remove_repeats(df).collect()) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_transform_equals_sorting(seed):
    random.seed(seed)
    texts = [bytes(random.choice(b"ab c") for _ in range(random.randint(0, 14))) for _ in range(7)]
    before, prefix, string, offset = sd.transform([np.frombuffer(t, np.uint8) for t in texts])
    got = [texts[i][k:] for i, k in zip(string, offset, strict=True)]
    assert got == sorted(t[k:] for t in texts for k in range(len(t) + 1))
    for j, (i, k) in enumerate(zip(string, offset, strict=True)):
        assert before[j] == (texts[i][k - 1] if k else sd.END)
        if j:
            common = next((n for n, (x, y) in enumerate(zip(got[j], got[j - 1])) if x != y), min(len(got[j]), len(got[j - 1])))
            assert prefix[j] == common


def test_strings_that_stay_out_of_a_collection_have_no_equal_windows():
    rng = random.Random(5)
    for length, gram in ((100, 32), (24, 8), (12, 4)):
        frame = bytes(rng.choices(b"abcdef", k=6 * length))
        texts = []
        for _ in range(60):  # copies of a frame with a letter changed here and there
            text = bytearray(frame[rng.randrange(length) : rng.randrange(3 * length, 6 * length)])
            for at in range(rng.randrange(length), len(text), rng.randrange(length // 2, 2 * length)):
                text[at] = rng.choice(b"uvwxyz")
            texts.append(bytes(text))
        raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        doc, start, windows, anchor, text, place = sd.segments(raw, offs, length, gram)
        first = np.unique(np.stack([anchor, text]), axis=1, return_index=True)[1]
        doc, start, windows, anchor, place = (x[first] for x in (doc, start, windows, anchor, place))
        size = windows + length - 1
        cuts = np.append(0, np.cumsum(size))
        data = raw[sd.ragged(offs[doc] + start, size)]
        kept = sd.may_repeat(data, cuts, anchor.view(np.int64), place, length)
        seen: dict[bytes, set[int]] = {}
        for k in range(len(size)):
            for at in range(cuts[k], cuts[k + 1] - length + 1):
                seen.setdefault(data[at : at + length].tobytes(), set()).add(k)
        needed = set().union(*(v for v in seen.values() if len(v) > 1))
        assert needed and needed <= set(np.flatnonzero(kept).tolist())
        assert kept.sum() < len(kept)
    none = np.zeros(0, np.int64)
    assert len(sd.may_repeat(np.zeros(0, np.uint8), np.zeros(1, np.int64), none, none)) == 0


def test_a_table_written_tidily_leaves_the_session_as_it_was(spark):
    rows = spark.range(1000).groupBy(F.pmod("id", F.lit(7)).alias("k")).count()
    for before in (None, "false"):
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
        try:
            assert sorted(map(tuple, cut(rows, "tidy", tidy=True).collect())) == sorted(map(tuple, rows.collect()))
            assert spark.conf.get(TIDY, None) == before
            with pytest.raises(Exception, match="no number"):
                cut(rows.withColumn("bad", F.raise_error(F.lit("no number")).cast("long")), "tidy", tidy=True)
            assert spark.conf.get(TIDY, None) == before
        finally:
            spark.conf.unset(TIDY)
