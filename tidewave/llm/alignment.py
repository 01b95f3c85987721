"""Alignment of two tokenizers by byte-owner arrays.

Operator 11. Each text, with a space before it, is encoded by a byte-level BPE (A) and, as it is, by a sentencepiece model that adds the space
(B). np.repeat gives every byte the index of the A token that owns it, and that of the B token. Where the pair of owners changes a new overlap
begins; where both change at once, both tokenizations can be cut. Cuts part the tokens into groups, and all A and B tokens of a group are linked.

How many documents hold a pair of ids linked, over all documents, says how well the pair fits: token_links() has that table, and
`alignments` scores each document by it. Long stretches without a cut (a run of one letter that the two tokenize out of step) make one
group of very many links, so links of a group are counted by different ids and how often these occur, never one by one.

Texts of a run of documents, some BLOCK_BYTES together, are a block: one row, with each different pair of the block once. Only these
rows meet the corpus-wide counts: a pair of every document has a row for each block, not for each document. Blocks are written to the
shared folder. A longer document is a block of its own.

Null and empty texts have no tokens, and neither has a text whose tokens don't give its bytes again (U+2581 in it, for instance): zeros, and an
empty digest. Strings of special tokens are plain text. Rows that share an id are documents of their own; other columns are dropped, so
their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm import bpe
from tidewave.llm.bpe import Vocabulary, encode_step, vocabulary
from tidewave.llm.common import cut, documents, ragged, steps

BLOCK_BYTES = 1 << 20
#: Different pieces a worker keeps between steps, and bytes of them.
KEPT_PIECES, KEPT_BYTES = 300_000, 1 << 24
#: Links of a group beyond which they are counted by different ids.
MANY_LINKS = 512
#: A pair of ids as one number: the A id above, the B id below.
SHIFT = 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
BLOCK_SCHEMA = "block long, pairs array<long>, held array<int>, doc_id array<long>, first array<int>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>, place binary, weight binary"
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_best long, count_sum long, groups_sha256 string"


class Pieces:
    """A sentencepiece model with the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        own = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [self.model.id_to_piece(i)]]
        self.lengths = np.array([len(b) for b in own], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(own), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, and where each text's begin (n + 1)."""
        found = self.model.encode(texts, num_threads=1)
        at = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(found), np.int64, at[-1]), at


@functools.cache
def sentence_pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.cache
def kept_pieces(path: str) -> bpe.Pieces:
    """Pieces of the A side with their ids; fewer than op6 keeps, as the links of a block need memory too."""
    return bpe.Pieces(vocabulary(path).merge, KEPT_PIECES, KEPT_BYTES)


@functools.cache
def digits(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below `most` with room for a sign behind them, which of the bytes count, and how many digits there are."""
    text = np.char.mod("%d", np.arange(most)).astype("S")
    wide = text.dtype.itemsize
    size = np.char.str_len(text).astype(np.int64)
    table = np.zeros((most, wide + 1), np.uint8)
    table[:, :wide] = text.view(np.uint8).reshape(most, wide)
    return table, np.arange(wide + 1) <= size[:, None], size


@dataclass
class Tokens:
    """Tokens of the texts of a step: ids, where each text's begin (n + 1), and the bytes of each token."""

    ids: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def only(self, kept: np.ndarray) -> Tokens:
        """The same texts, without the tokens of those that aren't kept."""
        n = np.diff(self.at)
        mine = np.repeat(kept, n)
        return Tokens(self.ids[mine], np.concatenate([[0], np.cumsum(np.where(kept, n, 0))]), self.size[mine])


def spaced(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    size = np.diff(offs)
    after = np.concatenate([[0], np.cumsum(size + (size > 0))])
    out = np.full(after[-1], 0x20, np.uint8)
    own = np.ones(len(out), bool)
    own[after[:-1][size > 0]] = False
    out[own] = raw
    return out, after


def gives(tokens: Tokens, joined: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens (joined: of all) are the text."""
    ends = np.concatenate([[0], np.cumsum(tokens.size)])[tokens.at]
    good = np.diff(ends) == np.diff(offs)
    some = np.flatnonzero(good & (np.diff(offs) > 0))
    size = np.diff(offs)[some]
    if len(some):
        same = raw[ragged(offs[some], size)] == joined[ragged(ends[some], size)]
        good[some] = np.logical_and.reduceat(same, np.cumsum(size) - size)
    return good


def tokenized(texts: list[str], raw: np.ndarray, offs: np.ndarray, a: Vocabulary, a_path: str, b: Pieces) -> tuple[Tokens, Tokens]:
    """Tokens of both sides of a step; none where either doesn't give the text again."""
    raw, offs = spaced(raw, offs)
    ids, at = encode_step(raw, offs, kept_pieces(a_path), {})
    one = Tokens(ids.astype(np.int64), at, a.lengths[ids])
    ids, at = b.encode(texts)
    two = Tokens(ids, at, b.lengths[ids])
    good = gives(one, a.decode(one.ids), raw, offs) & gives(two, b.joined[ragged(b.starts[two.ids], two.size)], raw, offs)
    return (one, two) if good.all() else (one.only(good), two.only(good))


@dataclass
class Groups:
    """Groups of the tokens of both sides: the first token of each group on either side (n + 1), overlaps before each text (n + 1)."""

    a: np.ndarray
    b: np.ndarray
    overlaps: np.ndarray
    #: The first group of each text (n + 1), and the byte where each group begins.
    at: np.ndarray
    byte: np.ndarray


def grouped(one: Tokens, two: Tokens) -> Groups:
    """Cuts and overlaps from the owners of each byte."""
    owner = np.repeat(np.arange(len(one.ids)), one.size)
    a_new = np.ones(len(owner) + 1, bool)
    a_new[1:-1] = owner[1:] != owner[:-1]
    owner = np.repeat(np.arange(len(two.ids)), two.size)
    b_new = np.ones(len(owner) + 1, bool)
    b_new[1:-1] = owner[1:] != owner[:-1]
    if not len(owner):
        a_new[:] = b_new[:] = False
    byte = np.flatnonzero(a_new & b_new)  # the end of all bytes is the last one
    ends = np.concatenate([[0], np.cumsum(one.size)])[one.at]  # where each text ends in bytes
    firsts = [np.searchsorted(np.cumsum(t.size) - t.size, byte) for t in (one, two)]
    overlaps = np.searchsorted(np.flatnonzero((a_new | b_new)[:-1]), ends)
    return Groups(*(f if len(byte) else np.zeros(1, np.int64) for f in firsts), overlaps, np.searchsorted(byte[:-1], ends), byte[:-1])


def digests(one: Tokens, two: Tokens, groups: Groups) -> list[str]:
    """SHA-256 of each text's groups as text; empty for texts without tokens."""
    a, b = groups.a, groups.b
    n_a, n_b = np.diff(a), np.diff(b)
    n = len(one.ids) + len(two.ids)
    ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[np.arange(len(one.ids)) + np.repeat(b[:-1], n_a)] = one.ids
    ids[np.arange(len(two.ids)) + np.repeat(a[1:], n_b)] = two.ids
    sign[a[1:] + b[:-1] - 1] = ord("|")
    sign[a[1:] + b[1:] - 1] = ord(";")
    table, counts, size = digits(int(max(ids.max(initial=0) + 1, 1 << 16)))
    rows = table[ids]
    rows[np.arange(n), size[ids]] = sign
    text = rows[counts[ids]].tobytes()
    ends = np.concatenate([[0], np.cumsum(size[ids] + 1)])[one.at + two.at].tolist()
    return [hashlib.sha256(text[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(ends[:-1], ends[1:], strict=True)]


def links(one: Tokens, two: Tokens, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different pair of linked ids of each text, in order: number of the text, pair, and how many links it stands for."""
    n_a, n_b = np.diff(groups.a), np.diff(groups.b)
    text = np.repeat(np.arange(len(one.at) - 1), np.diff(groups.at))
    n = n_a * n_b
    few = np.flatnonzero(n <= MANY_LINKS)
    size = n[few]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    width = np.repeat(n_b[few], size)
    a = one.ids[np.repeat(groups.a[few], size) + at // width]
    b = two.ids[np.repeat(groups.b[few], size) + at % width]
    parts = [(np.repeat(text[few], size), a << SHIFT | b, np.ones(len(a), np.int64))]
    for g in np.flatnonzero(n > MANY_LINKS).tolist():
        x, many_x = np.unique(one.ids[groups.a[g] : groups.a[g + 1]], return_counts=True)
        y, many_y = np.unique(two.ids[groups.b[g] : groups.b[g + 1]], return_counts=True)
        parts.append((np.full(len(x) * len(y), text[g]), (x[:, None] << SHIFT | y).ravel(), np.multiply.outer(many_x, many_y).ravel()))
    text, pair, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pair, text))
    text, pair, weight = text[order], pair[order], weight[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))[: len(pair)])
    return text[first], pair[first], np.add.reduceat(weight, first) if len(first) else weight


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per block: its different pairs with how many of its documents hold each (held), and for each document what is counted in it,
    the places of its pairs among those of the block (place, from `first` on) and how many links each stands for (weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabulary(a_path), sentence_pieces(b_path)
        number = TaskContext.get().partitionId() << 32
        for rows, raw, offs in steps(batches, size=BLOCK_BYTES):
            one, two = tokenized(rows.column("text").to_pylist(), raw, offs, a, a_path, b)
            groups = grouped(one, two)
            text, pair, weight = links(one, two, groups)
            pairs, place, held = np.unique(pair, return_inverse=True, return_counts=True)
            n = len(offs) - 1
            per_group = np.concatenate([[0], np.cumsum(np.diff(groups.a) * np.diff(groups.b))])
            found = {"n_a": np.diff(one.at), "n_b": np.diff(two.at), "n_groups": np.diff(groups.at), "n_links": np.diff(per_group[groups.at]), "n_overlaps": np.diff(groups.overlaps)}
            columns = {"block": number, "pairs": pairs, "held": held.astype(np.int32), "doc_id": rows.column("doc_id").to_pylist(), "first": np.searchsorted(text, np.arange(n + 1)).astype(np.int32), **found}
            columns |= {"groups_sha256": digests(one, two, groups), "place": place.astype("<i4").tobytes(), "weight": weight.astype("<i8").tobytes()}
            kinds = {"block": pa.int64(), "held": pa.list_(pa.int32()), "first": pa.list_(pa.int32()), "groups_sha256": pa.list_(pa.string()), "place": pa.binary(), "weight": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([x], kinds.get(c, pa.list_(pa.int64()))) for c, x in columns.items()], list(columns))
            number += 1

    return documents(docs).mapInArrow(run, BLOCK_SCHEMA)


def token_links(blocked: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n_docs (documents that hold the pair linked) and is_best: whether no B id is linked with this A id in more
    documents. An A id has no more rows than B has ids, so a window over it is bounded."""
    rows = blocked.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n_docs"))
    rows = rows.withColumns({"a_id": F.shiftright("pair", SHIFT), "b_id": F.col("pair").bitwiseAND((1 << SHIFT) - 1)})
    return rows.withColumn("is_best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a_id")))


def scored(blocked: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per document: what is counted in it, and the sums over its links of the pairs' counts (count_sum) and of best pairs (n_best)."""
    asked = blocked.select("block", F.posexplode("pairs").alias("pos", "pair"))
    told = asked.join(counts.select("pair", "n_docs", "is_best"), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "n_docs", "is_best"))).alias("told"))
    rows = blocked.drop("pairs", "held").join(told, "block", "left").select("*", F.col("told.n_docs").alias("docs"), F.col("told.is_best").alias("best")).drop("told", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                first = row["first"].values.to_numpy()
                place, weight = np.frombuffer(row["place"].as_py(), "<i4"), np.frombuffer(row["weight"].as_py(), "<i8")
                sums = []
                for c in ("best", "docs"):
                    value = row[c].values.to_numpy(zero_copy_only=False).astype(np.int64) if row[c].is_valid else np.zeros(0, np.int64)
                    sums.append(np.diff(np.concatenate([[0], np.cumsum(value[place] * weight)])[first]))
                columns = [row["doc_id"].values, *(row[c].values for c in COUNTS), *map(pa.array, sums), row["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, overlaps, links whose pair is best for its A id (n_best), the sum of the
    counts of all links' pairs (count_sum), and a digest of the groups."""
    blocked = cut(blocks(docs, a_path, b_path), "alignment-blocks")
    return scored(blocked, cut(token_links(blocked), "token-links"))


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The groups themselves, one row each: doc_id, number of the group, byte where it begins in space + text, and the ids of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabulary(a_path), sentence_pieces(b_path)
        for rows, raw, offs in steps(batches):
            one, two = tokenized(rows.column("text").to_pylist(), raw, offs, a, a_path, b)
            g = grouped(one, two)
            size = np.diff(g.at)
            text = np.repeat(np.arange(len(size)), size)
            begin = np.concatenate([[0], np.cumsum(one.size)])[one.at][:-1]
            lists = [pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), pa.array(t.ids)) for f, t in ((g.a, one), (g.b, two))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(text)), pa.array(np.arange(len(text)) - g.at[:-1][text]), pa.array(g.byte - begin[text]), *lists], ["doc_id", "group", "byte", "a_ids", "b_ids"])

    return documents(docs).mapInArrow(run, "doc_id long, group long, byte long, a_ids array<long>, b_ids array<long>")
