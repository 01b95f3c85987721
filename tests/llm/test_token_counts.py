"""Token counts against the library: odd characters, runs without a place to cut at, chunk borders, rows of all kinds."""

import random

import numpy as np
import pytest
import sentencepiece

from tidewave.llm import token_counts as tc
from tidewave.llm.queries import op13_token_counts, tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def counted(texts, machine):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return tc.count_step(np.frombuffer(b"".join(raw), np.uint8), offs, machine).tolist()


def odd_texts():
    rng = random.Random(5)
    kinds = [lambda: chr(rng.randrange(32, 127)), lambda: chr(rng.randrange(0, 32)), lambda: chr(rng.randrange(160, 0x600)), lambda: chr(rng.randrange(0x3000, 0x9FFF)), lambda: chr(rng.randrange(0x1F600, 0x1F640)), lambda: " " * rng.randrange(20), lambda: rng.choice(["the", "ing", "▁", "</s>", "<0x0A>"])]
    return ["", " ", "  ", "\n", "\x00", *("".join(rng.choice(kinds)() for _ in range(rng.randrange(60))) for _ in range(1500))]


def test_counts_equal_the_library(library):
    texts = odd_texts()
    assert counted(texts, tc.transducer(PATH)) == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_chunks_compose(library, monkeypatch, chunk):
    """Runs and periods have no place that no piece spans, so their chunks' start states come from the chunks before them."""
    monkeypatch.setattr(tc, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = [c * (40 * chunk + 7) for c in ("a", "ab", "abc", "=", " ", "-=", "the")] + ["".join(rng.choice("etaoin") for _ in range(30 * chunk)), "x", ""]
    assert counted(texts, tc.Transducer(PATH)) == [len(x) for x in library.encode(texts)]


def test_states_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(tc, "KEPT_STATES", 50)
    machine, texts = tc.Transducer(PATH), odd_texts()
    for part in (texts[:500], texts[500:]):
        assert counted(part, machine) == [len(x) for x in library.encode(part)]


def test_rows_of_all_kinds(spark, library):
    long = "word " * 5000
    rows = [(1, None, "a"), (1, "", "b"), (1, "two words", "c"), (1, "two words", "c"), (None, "é𠀀\n", None), (2, long, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tc.token_counts(df, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert tc.token_counts(df.where("false"), PATH).collect() == []


def test_whole_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op13_token_counts(spark, SF).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}
