"""The pipeline on planted documents, stage by stage, against the brute force of each operator's test."""

import hashlib
import pathlib
import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_operators import base_counts, leaks, library
from tests.llm.test_suffix_dedup import brute as repeats
from tidewave.llm import common, decontamination, minhash, quality_rules, suffix_dedup

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], SMALL)
        if k < 4:
            assert out.columns == docs.columns
        tables.append(spark.createDataFrame(out.toPandas(), out.schema))
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[1] <= {d for d, t in text.items() if not base_counts(t)[5]} and len(ids[1]) > 0.8 * len({d for d, t in text.items() if not base_counts(t)[5]})
    assert ids[2] == {d for d, _, _, kept in near_groups([(d, text[d]) for d in ids[1]], 80) if kept}
    after = {r.doc_id: r.text for r in tables[3].collect()}
    want = {d: sha for d, _, _, _, sha in repeats([(d, text[d]) for d in ids[2]])}
    whole = [d for d in want if hashlib.sha256(after[d].encode()).hexdigest() == want[d]]
    assert set(after) == set(want) and len(whole) > 0.95 * len(want)  # others lost halves of cut characters too
    bad = {d for d, _ in leaks([(d, t) for d, t in after.items() if len(t) < 3000], bench)}
    assert not bad & ids[4]
    lib = library()
    last = {r.doc_id: r for r in tables[5].collect()}
    assert set(last) == ids[4]
    for d, r in last.items():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == lib.encode(after[d], add_special_tokens=False).ids


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "n_tokens"} <= set(out.columns) and out.count() > 100


def test_stages_on_odd_rows(spark):
    """Nulls, repeated ids and rows, clashing columns and long texts through every stage; and an empty table."""
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    one, two, long = prose(90), prose(90), prose(30_000)
    rows = [(5, one, "en"), (5, two, "en"), (3, two, "en"), (7, one, None), (7, one, None), (None, one, "en"), (None, None, "en"), (8, None, "en"), (9, "", ""), (10, long, "en"), (11, "few words", "en")]
    clash = ("__x", "n", "tie", "words", "item_words", "seed", "item", "shift", "regs", "key", "first", "node", "kept", "ids", "from", "to", "anchor", "later", "lang_", "reference")
    code = "".join(pathlib.Path(m.__file__).read_text() for m in (common, decontamination, minhash, quality_rules, suffix_dedup))
    clash += (*sorted(set(re.findall(r"__[a-z_]+[a-z]\b", code)) - {"__future__"}), "column 0", "column 5", "a.b", "c`d")
    assert {"__tie", "__lang", "__reference", "__ranges", "__doc", "__of_tie", "__bad", "__several", "__many"} <= set(clash)
    df = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars int").withColumns({c: F.lit("clash") for c in clash})
    key = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    wanted = {
        "quality_rules": [r[:2] for r in rows if r[1] and len(r[1].split()) >= 50],
        "near_dedup": [(3, two), (5, one), (None, one), (None, None), (8, None), (9, ""), (10, long), (11, "few words")],
        "passage_dedup": [(3, two), (5, one), (5, ""), (7, ""), (7, ""), (None, one), (None, ""), (8, ""), (9, ""), (10, long), (11, "few words")],
        "decontamination": [r[:2] for r in rows],
    }
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, SMALL), stage(spark, df.where("false"), SMALL)
        assert none.count() == 0 and none.columns == out.columns
        if name == "tokens":
            assert out.count() == len(rows)
            continue
        assert out.columns == df.columns
        assert all({r[c] for r in out.select(F.col(f"`{c.replace('`', '``')}`").alias(c)).collect()} <= {"clash"} for c in ("__tie", "__lang", "a.b", "c`d", "column 5"))
        assert key(out) == sorted(wanted[name], key=str), name
        if name == "decontamination":
            item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
            marked = df.limit(0).unionByName(df.where("doc_id = 5").withColumn("text", F.when(F.col("text") == one, F.lit(f"{one} {item} {one}")).otherwise(F.col("text"))))
            assert key(stage(spark, marked, SMALL)) == [(5, two)]
