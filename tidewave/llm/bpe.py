"""Byte-level BPE: vectorised splitting, merging with a segment tree over adjacent pair ranks, and decoding.

Operator 6. Texts are split as the published pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` does, by character classes on flat
buffers. Every different piece of a step is merged once: a segment tree holds (rank, position) of each adjacent pair, its
root is the leftmost pair of lowest rank, and a merge updates three leaves and their ancestors. Trees of many pieces of
like length are the rows of one matrix, so that a merge step is a few numpy calls for thousands of pieces; where few pieces are as
long, each has a tree of plain numbers. Pieces are kept with their ids between steps and are found by a hash and then by their bytes.

Null texts count as empty (no ids). Strings of added tokens become their one id, as the tokenizers library has it unless
told otherwise. Texts and pieces of any length are taken whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewave.llm.common import Spans, byte_table, documents, large, mix, ragged, same_bytes, short_keys, steps

L, N, S, O = 1, 2, 3, 0  # noqa: E741  letters, numbers, white space, all else
#: What \\s of the published pattern takes beside the ASCII ones.
WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions of the published pattern, after the apostrophe.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Different pieces a worker keeps with their ids between steps, and bytes of them.
KEPT_PIECES, KEPT_BYTES = 1_000_000, 1 << 26
#: Rows of a matrix of trees below which each piece has a tree of its own.
FEW = 48
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_BASE = 0x5851F42D4C957F2D


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"L": L, "N": N}
    for cp in range(sys.maxunicode + 1):
        k = kinds.get(unicodedata.category(chr(cp))[0])
        if k:
            out[cp] = k
    out[[9, 10, 11, 12, 13, 32, *WIDE_SPACE]] = S
    return out


@functools.cache
def latin() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for cp in range(256):
        out[cp] = {"L": L, "N": N}.get(unicodedata.category(chr(cp))[0], O)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = S
    return out


def char_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte is part of."""
    out = latin()[raw & 0x7F]
    high = raw >= 0x80
    if not high.any():
        return out
    lead = np.flatnonzero(raw >= 0xC0)
    width = np.ones(len(lead), np.int64) + (raw[lead] >= 0xC0) + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
    cp = raw[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[width]
    padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    for k in (1, 2, 3):
        more = width > k
        cp[more] = cp[more] << 6 | padded[lead[more] + k] & 0x3F
    kind = latin()[cp] if cp.max(initial=0) < 256 else classes()[cp]
    out[ragged(lead, width)] = np.repeat(kind, width)
    return out


def split(raw: np.ndarray, offs: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all pieces, the index of each piece's id where it is an added token (else -1), and where each document's
    pieces begin (n + 1)."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    special: dict[int, int] = {}
    if added:
        whole = raw.tobytes()
        for word, token in added.items():
            at = whole.find(word)
            while at >= 0:
                if not edge[at + 1 : at + len(word)].any():
                    special[at] = token
                    edge[[at, at + len(word)]] = True
                at = whole.find(word, at + len(word))
    kind = char_classes(raw)
    start = edge.copy()
    start[n] = False
    change = np.zeros(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    start |= change
    space = kind == S
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    # the last white-space character before other text: a piece of its own, or, where it is a space, part of the next piece
    head = last.copy()
    while (cont := (raw[head] & 0xC0) == 0x80).any():
        head[cont] -= 1
    start[head] = True
    blank = raw[last] == 0x20
    start[last[blank] + 1] = False
    _contractions(raw, kind, start, edge)
    if special:
        for at, token in special.items():
            word = next(w for w, t in added.items() if t == token)
            start[at + 1 : at + len(word)] = False
            start[at] = True
    begins = np.flatnonzero(start)
    ids = np.full(len(begins), -1, np.int64)
    for at, token in special.items():
        ids[np.searchsorted(begins, at)] = token
    return begins, ids, np.searchsorted(begins, offs)


def _contractions(raw: np.ndarray, kind: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
    n = len(raw)
    at = np.flatnonzero(raw == 0x27)
    at = at[start[at] & (at + 1 < n)]
    at = at[(kind[np.minimum(at + 1, n - 1)] == L) & ~edge[at + 1]]
    for p in at.tolist():
        tail = raw[p + 1 : p + 3].tobytes()
        for c in CONTRACTIONS:
            if tail.startswith(c) and not edge[p + 2 : p + 1 + len(c)].any():
                start[p + 1] = False
                q = p + 1 + len(c)
                if q < n and kind[q] == L:
                    start[q] = True
                break


class Vocabulary:
    """A tokenizer file: the ids of single bytes, pair ranks in a sorted table, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        value = {c: b for b, c in letters.items()}
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * top
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in word)
        for word, i in self.added.items():
            self.bytes_of[i] = word
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.joined = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 20 | right
        key, first = np.unique(key, return_index=True)
        self.none = len(pairs)
        # open addressing: a pair is found in one or two looks at most places
        bits = max(4, int(2 * len(pairs)).bit_length() + 1)
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.key = np.full(self.slots, -1, np.int64)
        self.rank = np.full(self.slots, self.none, np.int64)
        self.made = np.zeros(self.slots, np.int64)
        todo = np.arange(len(key))
        slot = self._slot(key)
        self.looks = 0
        while len(todo):
            self.looks += 1
            free = self.key[slot] == -1
            _, won = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = won[free[won]]
            self.key[slot[won]] = key[todo[won]]
            self.rank[slot[won]] = first[todo[won]]
            self.made[slot[won]] = made[first[todo[won]]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) % self.slots

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where the pair doesn't merge."""
        key = left << 20 | right
        slot = self._slot(key)
        found = self.key[slot]
        miss = np.flatnonzero((found != key) & (found != -1))
        while len(miss):
            slot[miss] = (slot[miss] + 1) % self.slots
            found[miss] = self.key[slot[miss]]
            miss = miss[(found[miss] != key[miss]) & (found[miss] != -1)]
        slot[found != key] = -1
        return slot

    def merge(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces raw[start : start + length], after one another, and how many each has."""
        count = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 1
        while True:  # pieces of up to 2, 4, 8 ... bytes share a matrix
            size *= 2
            mine = np.flatnonzero((length <= size) & (length > (size // 2 if size > 2 else 0)))
            rows = max(1, 2_000_000 // size)
            for k in range(0, len(mine), rows):
                some = mine[k : k + rows]
                if size > 16 and len(some) < FEW:
                    for i in some.tolist():
                        own = self._tree(raw[start[i] : start[i] + length[i]])
                        count[i] = len(own)
                        parts.append((np.full(len(own), i), own))
                    continue
                ids, alive = self._forest(raw, start[some], length[some], size)
                count[some] = alive.sum(1)
                parts.append((np.repeat(some, count[some]), ids[alive]))
            if size >= length.max(initial=0):
                break
        where = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return ids[np.argsort(where, kind="stable")], count

    @functools.cached_property
    def ranks(self) -> dict[int, tuple[int, int]]:
        """Rank and id of each pair, by left << 20 | right."""
        full = self.key >= 0
        return dict(zip(self.key[full].tolist(), zip(self.rank[full].tolist(), self.made[full].tolist(), strict=True), strict=True))

    def _tree(self, piece: np.ndarray) -> np.ndarray:
        """Ids of one piece, by a segment tree of plain numbers: leaf i holds rank << 32 | i, node 1 is the root."""
        ids: list[int] = self.of_byte[piece].tolist()
        n = len(ids)
        size = 1 << max(1, (n - 1).bit_length())
        never = 1 << 62
        ranks = self.ranks.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [never] * (2 * size)
        for i in range(n - 1):
            got = ranks(ids[i] << 20 | ids[i + 1])
            if got:
                tree[size + i] = got[0] << 32 | i
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:  # the nodes above don't change either
                    return
                tree[node] = low

        def rank(i: int, j: int) -> int:
            got = ranks(ids[i] << 20 | ids[j])
            return got[0] << 32 | i if got else never

        while tree[1] != never:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i] = ranks(ids[i] << 20 | ids[j])[1]
            k = after[i] = after[j]
            ids[j] = -1
            put(j, never)
            if k >= 0:
                before[k] = i
                put(i, rank(i, k))
            else:
                put(i, never)
            h = before[i]
            if h >= 0:
                put(h, rank(h, i))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _forest(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """One segment tree a row. Leaf i holds rank << 32 | i of the pair that begins at i; node 1 is the root."""
        rows = len(start)
        col = np.arange(size)
        alive = col < length[:, None]
        at = np.minimum(start[:, None] + col, len(raw) - 1)
        ids = self.of_byte[raw[at]]
        after = np.where(col + 1 < length[:, None], col + 1, -1)
        before = np.broadcast_to(col - 1, (rows, size)).copy()
        never = np.int64(self.none) << 32 | (1 << 32) - 1
        tree = np.full((rows, 2 * size), never, np.int64)
        has = after >= 0
        slot = np.full((rows, size), -1, np.int64)
        slot[has] = self.pair(ids[has], ids[np.nonzero(has)[0], after[has]])
        leaf = tree[:, size:]
        good = slot >= 0
        leaf[good] = self.rank[slot[good]] << 32 | np.broadcast_to(col, (rows, size))[good]
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        busy = np.flatnonzero(tree[:, 1] != never)
        while len(busy):
            i = tree[busy, 1] & 0xFFFFFFFF
            j = after[busy, i]
            ids[busy, i] = self.made[slot[busy, i]]
            alive[busy, j] = False
            k = after[busy, j]
            after[busy, i] = k
            right = k >= 0
            before[busy[right], k[right]] = i[right]
            self._set(tree, slot, busy, j, np.full(len(busy), -1, np.int64), size, never)
            pair = np.full(len(busy), -1, np.int64)
            pair[right] = self.pair(ids[busy[right], i[right]], ids[busy[right], k[right]])
            self._set(tree, slot, busy, i, pair, size, never)
            h = before[busy, i]
            left = h >= 0
            self._set(tree, slot, busy[left], h[left], self.pair(ids[busy[left], h[left]], ids[busy[left], i[left]]), size, never)
            busy = busy[tree[busy, 1] != never]
        return ids, alive

    def _set(self, tree: np.ndarray, slot: np.ndarray, row: np.ndarray, pos: np.ndarray, pair: np.ndarray, size: int, never: int) -> None:
        """Point update of one leaf in each of these rows: the leaf, then its ancestors up to the root."""
        slot[row, pos] = pair
        tree[row, size + pos] = np.where(pair >= 0, self.rank[pair] << 32 | pos, never)
        node = size + pos
        while node[0] > 1 if len(node) else False:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, joined."""
        return self.joined[ragged(self.starts[ids], self.lengths[ids])]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@large
@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces:
    """Ids of pieces, kept between steps in an open-addressing table; new pieces go to `encode` once a step. Pieces of up to seven
    bytes are their own keys; longer ones have a hash as key, and one whose bytes differ from those kept under it is encoded anew."""

    def __init__(self, encode, most: int = KEPT_PIECES, most_bytes: int = KEPT_BYTES):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        bits = (2 * most).bit_length()
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.row = np.zeros(self.slots, np.int32)
        self.where, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.held, self.held_at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one where its search ends."""
        slot = (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        miss = np.flatnonzero((found != key) & (found != 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) % self.slots
            found = self.keys[slot[miss]]
            miss = miss[(found != key[miss]) & (found != 0)]
        return slot

    @staticmethod
    def _keys_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # the highest bit is never set in the key of a short piece
        key, size, high = short_keys(raw, start, end), end - start, np.uint64(1 << 63)
        middle = np.flatnonzero((size > 7) & (size <= 16))
        if len(middle):  # the first and the last eight bytes are all of it
            eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
            key[middle] = mix(mix(eight[start[middle]]) ^ eight[end[middle] - 8] * np.uint64(0xD1342543DE82EF95) + size[middle].astype(np.uint64)) | high
        long = np.flatnonzero(size > 16)
        if len(long):
            at = np.cumsum(size[long])
            key[long] = Spans(raw[ragged(start[long], size[long])], byte_table(11), _BASE)(at - size[long], at) | high
        return key

    def _add(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Encode these pieces and keep them. Returns their rows."""
        ids, count = self.encode(raw, start, length)
        rows = np.arange(len(self.count), len(self.count) + len(start), dtype=np.int32)
        self.where = np.concatenate([self.where, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.held_at = np.concatenate([self.held_at, len(self.held) + np.cumsum(length) - length])
        self.size = np.concatenate([self.size, length])
        self.held = np.concatenate([self.held, raw[ragged(start, length)]])
        return rows

    def look_up(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """Rows of self.where and self.count for the pieces."""
        key = self._keys_of(raw, start, end) if keys is None else keys
        size = end - start
        slot = self._find(key)
        out = self.row[slot]
        miss = np.flatnonzero(self.keys[slot] == 0)
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            some = miss[first]
            if len(self.count) and (len(self.count) + len(new) > self.most or len(self.held) + size[some].sum() > self.most_bytes):
                self._clear()
                return self.look_up(raw, start, end, key)
            if len(new) > self.most:  # one huge document: a table of its own size
                self.__init__(self.encode, 2 * len(new), self.most_bytes)
                return self.look_up(raw, start, end, key)
            rows = self._add(raw, start[some], size[some])
            todo = np.arange(len(new))
            while len(todo):
                slot = self._find(new[todo])
                _, won = np.unique(slot, return_index=True)
                self.keys[slot[won]] = new[todo[won]]
                self.row[slot[won]] = rows[todo[won]]
                todo = np.delete(todo, won)
            out[miss] = rows[back.reshape(-1)]
        long = np.flatnonzero(size > 7)
        same = self.size[out[long]] == size[long]
        same[same] = same_bytes(raw, start[long[same]], self.held, self.held_at[out[long[same]]], size[long[same]])
        other = long[~same]
        if len(other):  # another piece under the same hash: it is not kept under it
            out[other] = self._add(raw, start[other], size[other])
        return out


@large
@functools.cache
def tree_pieces(path: str) -> Pieces:
    return Pieces(vocabulary(path).merge)


def encode_step(raw: np.ndarray, offs: np.ndarray, pieces: Pieces, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a step, after one another, and where each document's ids begin (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    start, special, first = split(raw, offs, added)
    end = np.append(start[1:], len(raw))
    row = pieces.look_up(raw, start, end)
    count = pieces.count[row]
    where = pieces.where[row]
    count[special >= 0] = 1
    at = np.concatenate([[0], np.cumsum(count)])
    ids = pieces.ids[ragged(where, count)].astype(np.uint32)
    if (special >= 0).any():
        ids[at[:-1][special >= 0]] = special[special >= 0]
    return ids, at[first]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: how many ids it has, and digests of the ids and of the text decoded from them.

    with_ids: also the ids as little-endian unsigned 32-bit integers (column ids, binary). Other columns of docs are
    dropped, so their names can't clash. An empty table gives no rows; repeated rows each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, pieces = vocabulary(path), tree_pieces(path)
        for rows, raw, offs in steps(batches):
            ids, at = encode_step(raw, offs, pieces, voc.added)
            ids = ids.astype("<u4")
            text = voc.decode(ids)
            cuts = np.concatenate([[0], np.cumsum(voc.lengths[ids])])[at]
            flat_ids, flat_text = ids.tobytes(), text.tobytes()
            own = [flat_ids[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            decoded = [flat_text[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            columns = [rows.column("doc_id"), pa.array(np.diff(at)), pa.array([hashlib.sha256(x).hexdigest() for x in own]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(own, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents(docs).mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from rows of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            texts = [voc.decode(np.frombuffer(x or b"", "<u4")).tobytes().decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
