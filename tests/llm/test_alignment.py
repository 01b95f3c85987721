"""Alignments against links made one by one, with both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewave.llm import alignment as al
from tidewave.llm.bpe import vocabulary
from tidewave.llm.queries import op11_alignment, tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(text, libraries):
    """[(A ids, B ids)] of a text, and its number of overlaps."""
    one, model = libraries
    if not text:
        return [], 0
    want, shown = (" " + text).encode(), vocabulary(A).bytes_of
    a = [(i, shown[i]) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return [], 0

    def ends(tokens):
        out, at = {}, 0
        for _, x in tokens:
            at += len(x)
            out[at] = len(out) + 1
        return out

    ends_a, ends_b = ends(a), ends(b)
    cuts = [0, *sorted(set(ends_a) & set(ends_b))]
    number = [{0: 0} | e for e in (ends_a, ends_b)]
    out = [([i for i, _ in a[number[0][p] : number[0][q]]], [i for i, _ in b[number[1][p] : number[1][q]]]) for p, q in zip(cuts, cuts[1:], strict=False)]
    return out, len(set(ends_a) | set(ends_b))


def plain(rows, libraries):
    found = [(i, *groups_of(t, libraries)) for i, t in rows]
    each = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups, _ in found]
    docs = Counter(p for c in each for p in c)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for (i, groups, overlaps), c in zip(found, each, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        best, total = sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items())
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if text else "", overlaps))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(8)
    kinds = [lambda: chr(rng.randrange(32, 127)), lambda: chr(rng.randrange(0, 32)), lambda: chr(rng.randrange(160, 0x600)), lambda: chr(rng.randrange(0x3000, 0x9FFF)), lambda: chr(rng.randrange(0x1F600, 0x1F640)), lambda: rng.choice([" the", " ", "  ", "</s>", "<|endoftext|>", "ing", "a" * 50, "=" * 70])]
    texts = [None, "", " ", "\n", "▁", "a▁b", "<0x41>", "<s> <|endoftext|> </s>", "same text", "same text", " aaaa" + "a" * 3000, "x" + "ab" * 900, *("".join(rng.choice(kinds)() for _ in range(rng.randrange(50))) for _ in range(250))]
    return [(n // 2 if n < 20 else n, t) for n, t in enumerate(texts)]


def test_equals_links_made_one_by_one(spark, libraries):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in al.alignments(df, A, B).collect()), key=str)
    assert got == plain(rows, libraries)
    assert al.alignments(df.where("false"), A, B).collect() == []


@pytest.mark.parametrize(("size", "many"), [(1, 0), (300, 2)])
def test_blocks_and_large_groups_change_nothing(spark, libraries, monkeypatch, size, many):
    """Blocks of one text, and links always counted by different ids."""
    rows = odd_rows()[:120]
    raw = [(i, t or "") for i, t in rows]
    monkeypatch.setattr(al, "MANY_LINKS", many)
    a, b = vocabulary(A), al.sentence_pieces(B)
    import numpy as np

    for k in range(0, len(raw), 1 if size == 1 else 40):
        some = [t for _, t in raw[k : k + (1 if size == 1 else 40)]]
        own = [t.encode() for t in some]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        one, two = al.tokenized(some, np.frombuffer(b"".join(own), np.uint8), offs, a, A, b)
        text, pair, weight = al.links(one, two, al.grouped(one, two))
        for n, t in enumerate(some):
            want = Counter((x, y) for p, q in groups_of(t, libraries)[0] for x in p for y in q)
            assert {(p >> al.SHIFT, p & (1 << al.SHIFT) - 1): w for d, p, w in zip(text.tolist(), pair.tolist(), weight.tolist(), strict=True) if d == n} == want


def test_groups_themselves(spark, libraries):
    rows = odd_rows()[20:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in al.token_groups(df, A, B).orderBy("doc_id", "group").collect():
        got[r.doc_id].append((list(r.a_ids), list(r.b_ids)))
    assert got == {i: g for i, t in rows if (g := groups_of(t, libraries)[0])}


def test_whole_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in op11_alignment(spark, SF).collect()), key=str)
    assert got == plain(rows, libraries)
