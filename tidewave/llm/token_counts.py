"""Token counts by finite-state transduction, without making the tokens.

Operator 13. A sentencepiece BPE model is compiled into a deterministic transducer over characters. What BPE makes of a text ends, at each
place, in one token that is known from the characters before it: the one that fits there and that BPE leaves apart from the token before it.
A state holds each place where a longer piece may have begun: the trie node reached from there, the token that ends there, and how many
tokens fewer there are up to it. A transition carries the change of the number of tokens, which is below zero where characters close up.
States are compiled when a text first needs them. Where no piece spans a place, the state is the start again.

Texts are cut into chunks of some CHUNK characters, preferably at such places, and all chunks of a step run side by side, one character
of each at a time. A chunk that had to be cut elsewhere has a map from start states to (end state, count), with an entry for each state that
the chunk before it can end in; maps are composed by a scan that doubles its reach each time.

Null and empty texts have no tokens. Strings of control tokens inside texts are plain text, as is the library's default. Texts of any length
are taken whole. Other columns are dropped, so their names can't clash; repeated rows each give a row, an empty table gives none. Only models
without normalisation that put one space before a text are taken, others are an error.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidewave.llm.common import documents, steps

SPACE = "▁"
#: Characters of a chunk; states kept between steps; the number of tokens beyond which a text is over the limit.
CHUNK, KEPT_STATES, LIMIT = 256, 400_000, 4096
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Classes 0 to 3 are characters of 1 to 4 bytes that are in no piece: they become one token a byte.
FOREIGN = 4
START = 0
#: In the middle of a byte, as an earlier place may have more or fewer tokens.
EVEN = 128


def code_points(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts, and where each text's begin (n + 1)."""
    if not (raw >= 0x80).any():
        return raw.astype(np.int64), offs
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[lead].astype(np.int64)
    width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    out = first & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[width]
    padded = np.concatenate([raw, np.zeros(4, np.uint8)])
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        out[more] = out[more] << 6 | padded[lead[more] + k] & 0x3F
    return out, np.searchsorted(lead, offs)


class Transducer:
    """The transducer of a model: tables of the transitions met so far, in open addressing by state << bits | class."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("  Ａ́ b ") != f"{SPACE * 3}Ａ́{SPACE}b{SPACE}":
            raise ValueError(f"{path}: only models without normalisation are compiled")
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in ids]
        #: BPE joins the pair whose piece has the highest score first, the leftmost of equals.
        self.rank = {p: -sp.get_score(i) for p, i in zip(self.pieces, ids, strict=True)}
        letters = sorted({c for p in self.pieces for c in p})
        self.bits = int(FOREIGN + len(letters)).bit_length()
        points = np.arange(sys.maxunicode + 1)
        self.class_of = ((points >= 0x80).astype(np.uint16) + (points >= 0x800) + (points >= 0x10000)).astype(np.uint16)
        number = {c: FOREIGN + k for k, c in enumerate(letters)}
        self.class_of[[ord(c) for c in letters]] = [number[c] for c in letters]
        self.class_of[0x20] = number[SPACE]
        self.space = number[SPACE]
        self.child: dict[int, int] = {}
        self.piece_at, self.grows = [-1], [True]
        self.neighbours = {(a, b) for p in self.pieces for a, b in zip(p, p[1:], strict=False)}
        for n, p in enumerate(self.pieces):
            node = 0
            for c in p:
                key = node << 16 | number[c]
                if key not in self.child:
                    self.child[key] = len(self.piece_at)
                    self.piece_at.append(-1)
                    self.grows.append(False)
                self.grows[node] = True
                node = self.child[key]
            self.piece_at[node] = n
        #: Whether a piece may span two neighbours, by a hash of them: a false yes only loses a place to cut at.
        self.inner = np.zeros(1 << 20, bool)
        a, b = (np.array([number[c] for c in x], np.int64) for x in zip(*self.neighbours, strict=True))
        self.inner[self._pair(a, b)] = True
        self.clear()

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40503 ^ b * 2654435) & ((1 << 20) - 1)

    def clear(self) -> None:
        #: What is pending in each state: node << 28 | (token that ends there + 1) << 8 | EVEN + tokens fewer up to there.
        self.states: list[tuple[int, ...]] = [(EVEN,)]
        self.number = {self.states[0]: START}
        self.apart: dict[int, bool] = {}
        self._room(1 << 16)

    def _room(self, slots: int) -> None:
        self.slots, self.shift, self.used = slots, np.uint64(64 - (slots.bit_length() - 1)), 0
        self.keys, self.next, self.delta = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int8)

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a short text."""
        parts, rank = list(text), self.rank.get
        pairs = [rank(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) != np.inf:
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], np.inf)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], np.inf)
        return parts

    def fits(self, left: int, piece: int) -> bool:
        """Whether BPE makes this piece of its characters, and leaves it apart from the one before it (-1: a place no piece spans)."""
        key = left << 20 | piece
        if key not in self.apart:
            b = self.pieces[piece]
            if left < 0:
                self.apart[key] = len(self.merged(b)) == 1
            else:
                a = self.pieces[left]
                self.apart[key] = self.fits(-1, piece) and ((a[-1], b[0]) not in self.neighbours or self.merged(a + b) == [a, b])
        return self.apart[key]

    def compiled(self, state: int, cls: int) -> tuple[int, int]:
        """The state after a character of this class, and the change of the number of tokens."""
        if cls < FOREIGN:
            return START, cls + 1
        live, found, child, piece_at, apart = [], -1, self.child.get, self.piece_at, self.apart.get
        for pending in self.states[state]:
            node = child(pending >> 28 << 16 | cls, 0)
            if not node:
                continue
            p = piece_at[node]
            if p >= 0:
                left = (pending >> 8 & 0xFFFFF) - 1
                fits = apart(left << 20 | p)
                if self.fits(left, p) if fits is None else fits:
                    if found >= 0:
                        raise AssertionError(f"two tokens can end here: {self.pieces[found]}, {self.pieces[p]}")
                    found, fewer = p, (pending & 0xFF) - EVEN
            if self.grows[node]:
                live.append(node << 28 | pending & 0xFFFFFFF)
        delta = 1 - fewer
        # where nothing is pending no piece can span this place, whatever the last token was
        new = (*[x + delta for x in live], found + 1 << 8 | EVEN) if live else (EVEN,)
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number, delta

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one where its search ends."""
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        miss = np.flatnonzero((found != key) & (found != -1))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (self.slots - 1)
            found = self.keys[slot[miss]]
            miss = miss[(found != key[miss]) & (found != -1)]
        return slot

    def _put(self, key: np.ndarray, state: np.ndarray, delta: np.ndarray) -> None:
        """Keep new transitions; the keys are different ones."""
        if 2 * (self.used + len(key)) > self.slots:
            old = np.flatnonzero(self.keys >= 0)
            key, state, delta = (np.concatenate([t[old], x]) for t, x in ((self.keys, key), (self.next, state), (self.delta, delta)))
            self._room(4 * max(self.slots, 1 << (len(key) - 1).bit_length()))
        self.used += len(key)
        todo = np.arange(len(key))
        while len(todo):
            slot = self._find(key[todo])
            _, won = np.unique(slot, return_index=True)
            self.keys[slot[won]], self.next[slot[won]], self.delta[slot[won]] = key[todo[won]], state[todo[won]], delta[todo[won]]
            todo = np.delete(todo, won)

    def run(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run chunks side by side from these states: the states they end in and the changes of the number of tokens."""
        order = np.argsort(-length, kind="stable")
        at, state, count = start[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        longer = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")  # chunks of more than k characters
        for k, m in enumerate(longer.tolist()):
            key = state[:m] << self.bits | symbols[at[:m] + k]
            slot = self._find(key)
            miss = np.flatnonzero(self.keys[slot] == -1)
            if len(miss):
                new = np.unique(key[miss])
                made = [self.compiled(x >> self.bits, x & ((1 << self.bits) - 1)) for x in new.tolist()]
                self._put(new, np.array([s for s, _ in made], np.int32), np.array([d for _, d in made], np.int8))
                slot = self._find(key)
            state[:m] = self.next[slot]
            count[:m] += self.delta[slot]
        ends, counts = np.empty_like(state), np.empty_like(count)
        ends[order], counts[order] = state, count
        return ends, counts

    def chunks(self, symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all chunks, whether each start is a place that no piece spans, and the first chunk of each text (n + 1)."""
        n = len(symbols)
        free = np.zeros(n + 1, bool)
        free[1:n] = ~self.inner[self._pair(symbols[:-1], symbols[1:])]
        free[offs] = True
        cuts = np.flatnonzero(free)
        size = np.diff(offs)
        wanted = offs[:-1].repeat(-(-size // CHUNK)) + CHUNK * (np.arange((-(-size // CHUNK)).sum()) - np.repeat(np.cumsum(-(-size // CHUNK)) - -(-size // CHUNK), -(-size // CHUNK)))
        near = cuts[np.searchsorted(cuts, wanted)]
        start = np.unique(np.where(near < wanted + CHUNK, near, wanted))
        start = start[start < n]
        return start, free[start], np.searchsorted(start, offs)

    def counts(self, symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text, from the classes of its characters."""
        if len(self.states) > KEPT_STATES:
            self.clear()
        out = np.zeros(len(offs) - 1, np.int64)
        if not len(symbols):
            return out
        start, free, first = self.chunks(symbols, offs)
        length = np.diff(np.append(start, len(symbols)))
        # a text begins behind the space that the model puts before it
        (head,), (one,) = self.run(np.array([self.space]), np.array([0]), np.array([1]), np.array([START]))
        heads = np.unique(first[:-1][np.diff(offs) > 0])
        begin = np.zeros(len(start), np.int64)
        begin[heads] = head
        follows = ~free  # its start state is the end state of the chunk before it
        lane, state = np.arange(len(start)), begin
        found = (lane[:0], state[:0], state[:0], state[:0])  # chunk, start state, end state, count: the maps' entries
        while len(lane):
            ends, counts = self.run(symbols, start[lane], length[lane], state)
            found = tuple(np.concatenate(x) for x in zip(found, (lane, state, ends, counts), strict=True))
            more = np.flatnonzero(np.append(follows[1:], False)[lane])
            key = np.unique(np.stack([lane[more] + 1, ends[more]]), axis=1)
            known = np.isin(key[0] << 32 | key[1], found[0] << 32 | found[1])
            lane, state = key[0][~known], key[1][~known]
        order = np.argsort(found[0] << 32 | found[1])
        lane, state, ends, total = (x[order] for x in found)
        name = lane << 32 | state
        last = np.isin(lane + 1, np.append(heads, len(start)))
        after = np.where(last, len(lane), np.searchsorted(name, lane + 1 << 32 | np.where(np.append(follows, False)[lane + 1], ends, START)))
        total, after = np.append(total, 0), np.append(after, len(lane))
        while (after < len(lane)).any():  # entry by entry, the sum of twice as many chunks
            total = total + total[after]
            after = after[after]
        full = np.flatnonzero(np.diff(offs) > 0)
        out[full] = total[np.searchsorted(name, first[:-1][full] << 32 | head)] + one
        return out


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_step(raw: np.ndarray, offs: np.ndarray, machine: Transducer) -> np.ndarray:
    """Tokens of each text of a step."""
    points, at = code_points(raw, offs)
    return machine.counts(machine.class_of[points].astype(np.int64), at)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: bytes and tokens of its text, and whether it has more than `limit` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for rows, raw, offs in steps(batches):
            found = count_step(raw, offs, machine)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offs)), pa.array(found), pa.array(found > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(run, SCHEMA)
