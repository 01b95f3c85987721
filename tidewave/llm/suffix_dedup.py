"""Repeated passages, by suffix sorting of collections built column by column.

Operator 1. A byte is removed if a string of LENGTH bytes that covers it also starts earlier (in a document of smaller id, or
earlier in the same one). The work is cut into collections that are small and independent:

* Every window of LENGTH bytes has an anchor: its k-gram of lowest hash, the leftmost of equal ones. Windows that follow one
  another and have the same anchor are a segment (at most 2 * LENGTH - GRAM bytes). Equal windows have equal anchors, so
  repeated windows are found within the segments of one anchor. Anchors that occur once are done with.
* Segments of equal text are a class; its earliest segment stands for it and the others are removed whole. Equal segments of
  one Arrow batch are a class before anything is shuffled, so that large groups of copies never meet in one task.
  An anchor's classes are counted in salted parts, then summed, so that an anchor that most documents have isn't one task.
* Equal windows begin at the same distance from their anchor, so they share one of a few spans at fixed distances from it. A class
  that shares none of these with another class of its anchor has no equal window, and stays out of the collection.
* The other classes of an anchor are a collection. Its Burrows-Wheeler transform and its longest common prefixes are built by
  inserting one symbol of every string each round, from the last to the first: a symbol's place follows from the ranks of the
  transform so far, and only the new suffix and its successor get new common prefixes, minima over ranges of the old ones.
  Runs of suffixes with common prefixes of LENGTH or more are equal windows; all but the earliest are removed. The transform and
  the prefixes are read and rewritten from front to back each round, as sequential files; as collections are bounded and no
  folder of a machine may be used, the files are buffers in memory.
* A collection of more than HOT classes (a line that a large part of all documents have) is split further, by the windows
  themselves; each then is one string with its occurrences.

Null texts count as empty. Rows without an id are returned whole and aren't compared. Rows that share an id and a text are one
document, and each is returned; rows that share only an id are documents of their own, in the order of a hash of their texts, so
the result doesn't depend on the order of rows. Texts shorter than LENGTH bytes lose nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import any_columns, byte_table, cut, documents, flat, lean, passed_on, ragged, Spans, steps, with_tie

LENGTH, GRAM = 100, 32
#: Classes of an anchor beyond which it is split by windows.
HOT = 20_000
#: Tasks over which the segments of one anchor are spread, by their texts, while its classes are counted.
SALTS = 1_024
#: Strings that are read at once for a transform; half of them share spans, on the test tables.
COLLECTION = 2_400
#: Documents whose segments' bytes are taken at once.
SOME = 512
END = 255
_ANCHOR, _TEXT, _OTHER = 0x9E3779B97F4A7C15 | 5, 0x2545F4914F6CDD1D, 0xD1342543DE82EF95


def segments(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, anchor hash, text hash, anchor's place in the segment) of all segments."""
    n, wide = len(raw), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    hashes = Spans(raw, byte_table(31), _ANCHOR).sliding(gram)
    # the lowest hash of each window, and the leftmost place that has it
    low, anchor = hashes, np.arange(len(hashes))
    size = 1
    while size < wide:
        step = min(size, wide - size)
        right = low[step:] < low[: len(low) - step]
        low = np.where(right, low[step:], low[: len(low) - step])
        anchor = np.where(right, anchor[step:], anchor[: len(anchor) - step])
        size += step
    valid = np.zeros(n + 1, np.int32)
    doc_len = np.diff(offs)
    fits = np.flatnonzero(doc_len >= length)
    np.add.at(valid, offs[fits], 1)
    np.add.at(valid, offs[fits + 1] - length + 1, -1)
    valid = np.cumsum(valid)[: len(anchor)] > 0
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    tail = valid.copy()
    tail[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    begin, last = np.flatnonzero(head), np.flatnonzero(tail)
    doc = np.searchsorted(offs, begin, "right") - 1
    text = Spans(raw, byte_table(32), _TEXT)(begin, last + length)
    return doc, begin - offs[doc], last - begin + 1, hashes[anchor[begin]], text, anchor[begin] - begin


def in_order(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Numbers in the order of (doc, tie): doc itself where no id stands for several texts."""
    if not tie.any():
        return doc
    by = np.lexsort((tie, doc))
    new = np.ones(len(by), bool)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (tie[by][1:] != tie[by][:-1])
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def repeated_rows(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows have an earlier row with equal keys."""
    order = np.lexsort((start, doc, *keys))
    same = np.ones(len(order), bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    # the first of a run stands for it; rows at the very same place aren't later than it
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = same & ((doc[order] != doc[order][first]) | (start[order] != start[order][first]))
    out = np.zeros(len(order), bool)
    out[order] = later
    return out


def transform(strings: list[np.ndarray] | tuple[np.ndarray, np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction for a collection (bytes, lengths). Returns, for all suffixes in sorted order: the symbol before
    it, its common prefix with the one before it (255 at most), its string, and where in the string it begins."""
    raw, size = strings if isinstance(strings, tuple) else (np.concatenate(strings) if strings else np.zeros(0, np.uint8), np.array([len(s) for s in strings], np.int64))
    m = len(size)
    ends = np.cumsum(size)
    before = np.full(m, END, np.uint8)  # the sorted suffixes of length 0: one for each string
    prefix = np.zeros(m, np.uint8)
    # places of the transform's symbols, ordered by symbol and then place: entry q is what suffix m + q begins with
    ranked = np.zeros(0, np.int64)
    low = np.int64((1 << 32) - 1)
    # buffers that are used again each round
    spare = np.empty((2, int(size.sum())), np.int64)
    files = np.empty((2, int(size.sum())), np.int64)
    at = np.arange(m)
    live = np.arange(m)
    for t in range(1, int(size.max(initial=0)) + 1):
        keep = size[live] >= t
        if not keep.all():
            live, at = live[keep], at[keep]
        symbol = raw[ends[live] - t]
        before[at] = symbol
        new = symbol.astype(np.int64) << 32 | at
        by = np.argsort(new)
        new, live = new[by], live[by]
        row = np.searchsorted(ranked, new) + np.arange(len(new))
        total = len(ranked) + len(new)
        old = np.ones(total, bool)
        old[row] = False
        merged = files[t % 2][:total]
        merged[old], merged[row] = ranked, new
        touched = np.concatenate([row, row[row + 1 < total] + 1])
        own, prior = merged[touched], merged[np.maximum(touched - 1, 0)]
        alike = (touched > 0) & (own >> 32 == prior >> 32)
        value = np.zeros(len(touched), np.uint8)
        a, b = (prior[alike] & low) + 1, (own[alike] & low) + 1
        by = np.argsort(a)
        lows = np.minimum.reduceat(np.append(prefix, 0), np.stack([a[by], b[by]], 1).reshape(-1))[::2] if len(a) else np.zeros(0, np.uint8)
        least = np.empty(len(a), np.uint8)
        least[by] = lows
        value[alike] = np.minimum(least, 254) + 1
        # rewrite both files with the new suffixes in their places
        old = np.ones(m + total, bool)
        old[m + row] = False
        new_before, new_prefix = np.full(m + total, END, np.uint8), np.zeros(m + total, np.uint8)
        new_before[old], new_prefix[old] = before, prefix
        new_prefix[m + touched] = value
        before, prefix, at = new_before, new_prefix, m + row
        # the symbols' places move by the suffixes put in before them
        places, moved = spare[0][:total], spare[1][:total]
        np.bitwise_and(merged, low, out=places)
        np.take(np.flatnonzero(old), places, out=moved, mode="clip")
        np.bitwise_and(merged, ~low, out=merged)
        np.bitwise_or(merged, moved, out=merged)
        ranked = merged
    place = np.zeros(len(before), np.int64)
    place[ranked & low] = np.arange(len(ranked))
    string, offset = np.full(len(before), -1, np.int64), np.zeros(len(before), np.int64)
    live, at = np.arange(m), np.arange(m)
    for t in range(int(size.max(initial=0)) + 1):
        string[at], offset[at] = live, size[live] - t
        keep = size[live] > t
        live, at = live[keep], m + place[at[keep]]
    return before, prefix, string, offset


def later_windows(raw: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows of a collection that an earlier one equals. doc, start: where each string begins."""
    _, prefix, string, offset = transform((raw, size), length)
    tied = prefix >= length
    group = np.cumsum(~tied)
    member = tied.copy()
    member[:-1] |= tied[1:]
    rows = np.flatnonzero(member)
    s, o, g = string[rows], offset[rows], group[rows]
    order = np.lexsort((start[s] + o, doc[s], g))
    s, o, g = s[order], o[order], g[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
    later = (doc[s] != doc[s][first]) | (start[s] + o != start[s][first] + o[first])
    return s[later], o[later]


def may_repeat(raw: np.ndarray, offs: np.ndarray, anchor: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings can have a window of another string of the same anchor. A window that begins n bytes before the anchor holds the
    span that begins a multiple of `stride` before it, n at most, and is stride - 1 bytes shorter; so equal windows have an equal span."""
    stride = max(1, length // 6)
    width = length - stride + 1
    spans = Spans(raw, byte_table(33), _OTHER)
    out = np.zeros(len(anchor), bool)
    for back in range(0, int(place.max(initial=-1)) + 1, stride):
        start = offs[:-1] + place - back
        fits = np.flatnonzero((place >= back) & (start + width <= offs[1:]))
        key = spans(start[fits], start[fits] + width) ^ anchor[fits].view(np.uint64)
        _, same, many = np.unique(key, return_inverse=True, return_counts=True)
        out[fits] |= many[same.reshape(-1)] > 1
    return out


def runs(string: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to) of the bytes that windows cover, as maximal runs."""
    order = np.lexsort((offset, string))
    s, o = string[order], offset[order]
    head = np.ones(len(s), bool)
    head[1:] = (s[1:] != s[:-1]) | (o[1:] > o[:-1] + length)
    tail = np.append(head[1:], True)
    return s[head], o[head], o[tail[: len(s)]] + length


def _segment_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, text, doc_id, tie, at (start << 32 | the anchor's place << 16 | windows; windows
    of up to 65,535 bytes fit), later. later: an earlier segment of the batch has the
    same text; such rows need no meeting, and their anchor is replaced by a number of their own, so that they spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for rows, raw, offs in steps(iter([batch])):
                doc, start, windows, anchor, text, place = segments(raw, offs, length, gram)
                for part, values in zip(parts, (rows.column("doc_id").to_numpy()[doc], rows.column("__tie").to_numpy()[doc], start << 32 | place << 16 | windows, anchor, text), strict=True):
                    part.append(values)
            if not parts[0]:
                continue
            del doc, start, windows, anchor, text, place, part, values
            # a column's pieces go as soon as they are joined
            doc, tie, at, anchor, text = (np.concatenate(parts.pop(0)) for _ in range(5))
            later = repeated_rows([text, anchor], in_order(doc, tie), at)
            anchor = np.where(later, text ^ (doc ^ tie).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at >> 32).astype(np.uint64), anchor)
            yield from passed_on(pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(text.view(np.int64)), pa.array(doc), pa.array(tie), pa.array(at), pa.array(later)], ["anchor", "text", "doc_id", "tie", "at", "later"]))
            del doc, tie, at, anchor, text, later

    # without nulls: a filter for them would keep the two uses of this table from sharing its shuffle
    return docs.mapInArrow(lean(run), "anchor long NOT NULL, text long NOT NULL, doc_id long NOT NULL, tie long NOT NULL, at long NOT NULL, later boolean NOT NULL")


def _with_text(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The segments (anchor, doc_id, tie, start, place, windows, classes) with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SOME):
                some = batch.slice(k, SOME)
                raw, offs = flat(some.column("text"))
                lists = some.column("wanted")
                owner = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy())
                fields = lists.flatten()
                anchor, start, place, windows, classes = (fields.field(k).to_numpy() for k in ("anchor", "start", "place", "windows", "classes"))
                size = windows + length - 1
                cuts = np.append(0, np.cumsum(size)).astype(np.int32)
                data = raw[ragged(offs[owner] + start, size)]
                column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
                ids = (some.column(k).take(pa.array(owner)) for k in ("doc_id", "tie"))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *ids, pa.array(start), pa.array(place), pa.array(classes), column], ["anchor", "doc_id", "tie", "start", "place", "classes", "bytes"])

    by_doc = wanted.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "start", "place", "windows", "classes")).alias("wanted"))
    joined = by_doc.join(docs.withColumnRenamed("__tie", "tie"), ["doc_id", "tie"]).select("doc_id", "tie", "text", "wanted")
    return joined.mapInArrow(lean(run), "anchor long, doc_id long, tie long, start long, place long, classes long, bytes binary")


def _sorted_collections(pieces: DataFrame, length: int) -> DataFrame:
    """Byte ranges (doc_id, tie, from, to) that later windows of the collections cover."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        raw, offs = flat(table.column("bytes"))
        columns = [table.column(k).to_numpy() for k in ("anchor", "place", "doc_id", "tie", "start")]
        kept = np.flatnonzero(may_repeat(raw, offs, columns[0], columns[1], length))
        doc, tie, start = (c[kept] for c in columns[2:])
        size = np.diff(offs)[kept]
        s, a, b = runs(*later_windows(raw[ragged(offs[kept], size)], size, in_order(doc, tie), start, length), length)
        return pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(tie[s]), pa.array(start[s] + a), pa.array(start[s] + b)], ["doc_id", "tie", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            if not len(anchor):
                continue
            # a batch may be cut where the anchor changes
            new = np.flatnonzero(np.append(last is None or anchor[0] != last, anchor[1:] != anchor[:-1]))
            done = 0
            for at in new.tolist():
                if count + at - done >= COLLECTION:
                    if at > done:
                        held.append(batch.slice(done, at - done))
                    if held:
                        yield solve(held)
                    held, count, done = [], 0, at
            held.append(batch.slice(done))
            count += batch.num_rows - done
            last = anchor[-1]
        if held:
            yield solve(held)

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(run), "doc_id long, tie long, from long, to long")


def _split_by_window(pieces: DataFrame, length: int) -> DataFrame:
    """The same for collections of too many classes: each window is a key, met by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                some = batch.slice(k, 4096)
                raw, offs = flat(some.column("bytes"))
                windows = np.diff(offs) - length + 1
                at = ragged(offs[:-1], windows)
                doc, tie, start = (np.repeat(some.column(c).to_numpy(), windows) for c in ("doc_id", "tie", "start"))
                start = start + at - np.repeat(offs[:-1], windows)
                one, two = (Spans(raw, byte_table(seed), base)(at, at + length) for seed, base in ((41, _ANCHOR), (42, _OTHER)))
                later = repeated_rows([one, two], in_order(doc, tie), start)
                one = np.where(later, one ^ ((doc ^ tie).astype(np.uint64) << np.uint64(20)) + start.astype(np.uint64), one)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc), pa.array(tie), pa.array(start), pa.array(later)], ["one", "two", "doc_id", "tie", "start", "later"])

    rows = pieces.mapInArrow(lean(run), "one long, two long, doc_id long, tie long, start long, later boolean")
    earliest = Window.partitionBy("one", "two").orderBy("doc_id", "tie", "start")
    rows = rows.withColumn("place", F.rank().over(earliest)).where("later OR place > 1")
    return rows.select("doc_id", "tie", F.col("start").alias("from"), (F.col("start") + length).alias("to"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Byte ranges (doc_id, tie, from, to) to remove; they may overlap. docs: doc_id, text, __tie, and no row twice."""
    # one shuffle, by anchor and salt, serves the ranks within classes, the counts of classes and the join of both
    rows = _segment_table(docs, length, gram).withColumn("salt", F.pmod("text", F.lit(SALTS))).repartition("anchor", "salt")
    of_class = Window.partitionBy("anchor", "salt", "text").orderBy("doc_id", "tie", "at")
    rows = rows.withColumn("place", F.rank().over(of_class)).withColumn("gone", F.col("later") | (F.col("place") > 1))
    crowd = rows.groupBy("anchor", "salt").agg(F.count_if(~F.col("gone")).alias("n"))
    crowd = crowd.withColumn("classes", F.sum("n").over(Window.partitionBy("anchor"))).where("classes > 1").select("anchor", "salt", "classes")
    rows = rows.join(crowd, ["anchor", "salt"], "left").where("gone OR classes IS NOT NULL")
    start, place, windows = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFF)), F.col("at").bitwiseAND(F.lit(0xFFFF))
    found = cut(rows.select("anchor", "doc_id", "tie", start.alias("start"), place.alias("place"), windows.alias("windows"), "gone", "classes"), "segments", tidy=True)
    whole = found.where("gone").select("doc_id", "tie", F.col("start").alias("from"), (F.col("start") + F.col("windows") + (length - 1)).alias("to"))
    first = found.where("NOT gone").select("anchor", "doc_id", "tie", "start", "place", "windows", "classes")
    texts = cut(_with_text(docs, first, length), "segment-texts", tidy=True)
    few, many = texts.where(F.col("classes") <= hot), texts.where(F.col("classes") > hot)
    return whole.unionByName(_sorted_collections(few, length)).unionByName(_split_by_window(many, length))


def _with_ranges(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """docs with the column __ranges of what to remove."""
    tied, repeated = with_tie(docs)
    texts = documents(tied).where("doc_id IS NOT NULL")
    if repeated:  # a document that stands in many rows is looked at once
        texts = texts.where("__tie = 0").unionByName(texts.where("__tie <> 0").groupBy("doc_id", "__tie").agg(F.min("text").alias("text")))
    ranges = repeated_ranges(texts, length, gram, hot)
    by_doc = ranges.groupBy(F.col("doc_id").alias("__doc"), F.col("tie").alias("__of_tie")).agg(F.collect_set(F.struct("from", "to")).alias("__ranges"))
    return tied.join(by_doc, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.col("__tie") == F.col("__of_tie")), "left")


def kept_bytes(raw: np.ndarray, offs: np.ndarray, lists: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What is left of each document, how many bytes go, and in how many runs."""
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    fields = lists.flatten()
    a, b = (np.minimum(fields.field(k).to_numpy() + offs[owner], offs[owner + 1]) for k in ("from", "to"))
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    gone = np.cumsum(edge)[:-1] > 0
    sums = np.append(0, np.cumsum(gone))
    head = gone.copy()
    if len(gone):
        head[1:] &= ~gone[:-1]
        starts = offs[:-1][offs[:-1] < len(raw)]
        head[starts] = gone[starts]
    heads = np.append(0, np.cumsum(head))
    kept = raw[~gone].tobytes()
    cuts = (offs - sums[offs]).tolist()
    return [kept[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], sums[offs[1:]] - sums[offs[:-1]], heads[offs[1:]] - heads[offs[:-1]]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in steps(batches):
            own, removed, spans = kept_bytes(raw, offs, rows.column("__ranges"))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in own])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_ranges(documents(docs), length, gram, hot).mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@any_columns
def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The documents with what is left of their texts, and n_chars to match. Bytes of characters that were cut apart go too."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in steps(batches):
            own, _, _ = kept_bytes(raw, offs, rows.column("__ranges"))
            texts = [x.decode("utf-8", "ignore") for x in own]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in columns], columns)

    schema = docs.withColumn("text", F.lit("")).schema if "n_chars" not in columns else docs.withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    for f in schema.fields:
        f.nullable = True
    return _with_ranges(docs, length, gram, hot).select(*columns, "__ranges").mapInArrow(lean(run), schema)


#: Each window of each document is compared with all; a missing id has no windows. Of different texts of one id, the lesser is earlier.
ORACLE_SQL = f"""
WITH k AS (SELECT *, row_number() OVER (ORDER BY doc_id, text) AS r, encode(text) AS b, octet_length(encode(text)) AS n FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
w AS (SELECT r, p, b[p:p + {LENGTH - 1}] AS x FROM (SELECT r, b, unnest(range(1, n - {LENGTH - 2})) AS p FROM k WHERE n >= {LENGTH} AND doc_id IS NOT NULL)),
g AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY x ORDER BY r, p) AS place FROM w) WHERE place > 1),
i AS (SELECT r, p, sum(CASE WHEN p > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS island FROM (SELECT r, p, lag(p, 1, p) OVER (PARTITION BY r ORDER BY p) AS before FROM g)),
s AS (SELECT r, min(p) AS a, max(p) + {LENGTH - 1} AS z FROM i GROUP BY r, island),
t AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS last FROM s),
u AS (SELECT t.r, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(CASE WHEN a - 1 > last THEN hex(k.b[last + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS kept FROM t JOIN k USING (r) GROUP BY t.r),
f AS (SELECT k.doc_id, k.text, k.n AS n_bytes, coalesce(u.n_removed, 0) AS n_removed, coalesce(u.n_spans, 0) AS n_spans,
  sha256(CASE WHEN u.r IS NULL THEN k.b ELSE unhex(u.kept || CASE WHEN k.n > u.z THEN hex(k.b[u.z + 1:k.n]) ELSE '' END) END) AS kept_sha256 FROM k LEFT JOIN u USING (r))
SELECT d.doc_id, CAST(f.n_bytes AS BIGINT) AS n_bytes, CAST(f.n_removed AS BIGINT) AS n_removed, CAST(f.n_spans AS BIGINT) AS n_spans, f.kept_sha256
FROM documents d JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND coalesce(d.text, '') = f.text
"""
