"""Quality rules: counts of a text, and the distance of its histograms from language references.

Operator 10. Words are runs of anything but space and U+0009 to U+000D. Besides the base rules (too few words, too much
repetition), a document of at least MIN_WORDS words is rejected where its histogram of character classes, or that of common
words, is further than a limit from its language's reference in Jensen-Shannon distance (base 2). References are counted over
all documents of a language: characters by class, and the COMMON most frequent words, by a 64-bit hash of the whole word, with the
share of all other words. Words as frequent as the first one beyond COMMON aren't common, so no tie is broken. A language has a reference if LEAST_WORDS words of it are counted, however small its share; documents
meet it by a join on the language. None is rejected for distance where its language has no reference (its distances are 0).

Null texts count as empty: no words, so base_failed. Documents without a language (null or empty) are one more reference, and are
judged by the nearest of all references, AT_ONCE of which one pass holds; more references are more passes. Repeated rows give
repeated rows, and an empty table none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import any_columns, byte_table, cut, lean, mix, rows_of, Spans, steps, word_bounds

COMMON, LEAST_WORDS, AT_ONCE = 48, 2000, 256
#: Different words that a task gathers before it hands on their counts.
HELD = 1 << 19
MIN_WORDS = 50
CHAR_LIMIT, WORD_LIMIT, WORD_SLACK = 0.30, 0.25, 2.0
_BASE = 0x3C6EF372FE94F82B
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
#: Character classes: 0 lower case, 1 upper case, 2 digits, 3 white space, 4 sentence marks, 5 symbols, 6 other ASCII, 7 beyond.
CHAR_CLASS = np.full(256, 6, np.int64)
CHAR_CLASS[97:123], CHAR_CLASS[65:91], CHAR_CLASS[48:58], CHAR_CLASS[128:] = 0, 1, 2, 7
CHAR_CLASS[[32, 9, 10, 11, 12, 13]] = 3
CHAR_CLASS[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 4
CHAR_CLASS[SYMBOLS > 0] = 5
CLASSES = 8
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offs[1:]] - sums[offs[:-1]]


@dataclass
class Counts:
    """Counts of each document of a step."""

    base: dict[str, np.ndarray]
    chars: np.ndarray
    word_start: np.ndarray
    word_end: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray


def counts(raw: np.ndarray, offs: np.ndarray) -> Counts:
    n_docs = len(offs) - 1
    start, end, first = word_bounds(raw, offs)
    doc = rows_of(first)
    head = (raw & 0xC0) != 0x80
    heads = np.concatenate([[0], np.cumsum(head)])
    spans = Spans(raw, byte_table(21), _BASE)
    hashes = spans(start, end)
    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inside = per_doc_of_words(heads[end] - heads[start], first)
    kinds = CHAR_CLASS[raw]
    chars = np.stack([per_doc((kinds == k) & head, offs) for k in range(CLASSES)], 1) if len(raw) else np.zeros((n_docs, CLASSES), np.int64)
    base = {"n_words": np.diff(first), "word_chars": inside, "n_symbols": per_doc(SYMBOLS[raw], offs), "n_dup_lines": dup_lines(raw, offs, start, spans, salt), "n_repeat_words": repeats(hashes, first, doc, salt)}
    return Counts(base, chars, start, end, first, doc, hashes)


def per_doc_of_words(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def dup_lines(raw: np.ndarray, offs: np.ndarray, word_start: np.ndarray, spans: Spans, salt: np.ndarray) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of their document."""
    breaks = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    stop = np.minimum(np.append(begin[1:], len(raw)), len(raw))
    begin, stop = begin[begin < len(raw)], stop[begin < len(raw)]
    owner = np.searchsorted(offs, begin, "right") - 1
    ends = stop - ((stop > begin) & (raw[np.maximum(stop - 1, 0)] == 10)) if len(raw) else stop
    with_word = np.searchsorted(word_start, ends) > np.searchsorted(word_start, begin)
    begin, ends, owner = begin[with_word], ends[with_word], owner[with_word]
    key = mix(spans(begin, ends) + salt[owner])
    _, once = np.unique(key, return_index=True)
    n = len(salt)
    return np.bincount(owner, minlength=n) - np.bincount(owner[once], minlength=n)


def repeats(hashes: np.ndarray, first: np.ndarray, doc: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Words in three-word windows that their document has twice or more."""
    n = len(hashes)
    out = np.zeros(n, bool)
    if n >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        q = np.uint64(0xD6E8FEB86659FD93)
        key = mix((hashes[at] * q + hashes[at + 1]) * q + hashes[at + 2] + salt[doc[at]])
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[times[back.reshape(-1)] > 1]
        for k in range(3):
            out[twice + k] = True
    return per_doc_of_words(out, first)


def word_keys(raw: np.ndarray, c: Counts) -> np.ndarray:
    """A 64-bit hash of each word, in lower case (A to Z) and without . , ! ? at its end."""
    size = c.word_end - c.word_start
    last = raw[np.maximum(c.word_end - 1, 0)] if len(size) else raw[:0]
    size = size - ((size > 1) & np.isin(last, np.frombuffer(b".,!?", np.uint8)))
    return Spans(raw, byte_table(22, lower=True), _BASE)(c.word_start, c.word_start + size).view(np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back.reshape(-1), n, len(keys)).astype(np.int64)


def references(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per language and histogram entry: lang, kind (0 word or 1 char), entry, n. Counts cover all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        chars: dict[str, np.ndarray] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for at in range(0, len(keys), 1 << 16):
                    k = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(np.zeros(len(k), np.int32)), pa.array(k), pa.array(n[at : at + (1 << 16)])], ["lang", "kind", "entry", "n"])
            held.clear()

        for rows, raw, offs in steps(batches):
            c = counts_for_reference(raw, offs)
            langs = rows.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words, of = word_keys(raw, c), code[c.doc]
            for k, name in enumerate(langs.dictionary.to_pylist()):
                keys, n = np.unique(words[of == k], return_counts=True)
                held.setdefault(name, []).append((keys, n))
                size += len(keys)
                chars[name] = chars.get(name, 0) + c.chars[code == k].sum(0)
            if size > HELD:
                for name, parts in held.items():
                    held[name] = [summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                size = sum(len(parts[0][0]) for parts in held.values())
                if 2 * size > HELD:
                    yield from out()
                    size = 0
        yield from out()
        for name, n in chars.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * CLASSES, pa.string()), pa.array(np.ones(CLASSES, np.int32)), pa.array(np.arange(CLASSES)), pa.array(n)], ["lang", "kind", "entry", "n"])

    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(lean(run), "lang string, kind int, entry long, n long").where("n > 0").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))


def counts_for_reference(raw: np.ndarray, offs: np.ndarray) -> Counts:
    start, end, first = word_bounds(raw, offs)
    head = (raw & 0xC0) != 0x80
    kinds = CHAR_CLASS[raw]
    chars = np.stack([per_doc((kinds == k) & head, offs) for k in range(CLASSES)], 1) if len(raw) else np.zeros((len(offs) - 1, CLASSES), np.int64)
    return Counts({}, chars, start, end, first, rows_of(first), np.zeros(0, np.uint64))


@dataclass
class Reference:
    """Of a language: shares of character classes, its common words, and their shares; the last share is that of all other words."""

    chars: np.ndarray
    words: np.ndarray
    shares: np.ndarray


def reference(row: dict) -> Reference:
    chars = np.zeros(CLASSES)
    for e in row["chars"]:
        chars[e["entry"]] = e["n"]
    n = np.array([e["n"] for e in row["top"]] + [row["n_words"] - sum(e["n"] for e in row["top"])], np.float64)
    return Reference(chars / max(chars.sum(), 1), np.array([e["entry"] for e in row["top"]], np.int64), n / max(n.sum(), 1))


def gather(totals: DataFrame) -> DataFrame:
    """lang and its reference: n_words, top (common words), chars. One small row for each language of LEAST_WORDS words or more."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "entry")
    entries = F.sort_array(F.collect_list(F.struct("entry", "n")))
    sizes = totals.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n_words")).where(F.col("n_words") >= LEAST_WORDS)
    top = totals.where("kind = 0").withColumn("place", F.row_number().over(best)).where(F.col("place") <= COMMON + 1).groupBy("lang").agg(entries.alias("top"), F.min(F.when(F.col("place") > COMMON, F.col("n"))).alias("beyond"))
    top = top.select("lang", F.filter("top", lambda e: e.n > F.coalesce("beyond", F.lit(0))).alias("top"))
    chars = totals.where("kind = 1").groupBy("lang").agg(entries.alias("chars"))
    return cut(sizes.join(top, "lang").join(chars, "lang"), "language-references").select("lang", F.struct("n_words", "top", "chars").alias("reference"))


def with_reference(docs: DataFrame) -> tuple[DataFrame, list[Reference]]:
    """The documents with the columns __lang and __reference, and __char and __word: the distances of those without a language from the
    nearest reference but the last AT_ONCE, which are returned."""
    model = gather(cut(references(docs), "references"))
    own = model.select(F.col("lang").alias("__lang"), F.col("reference").alias("__reference"))
    joined = docs.withColumn("__lang", F.coalesce(F.col("lang").cast("string"), F.lit(""))).join(own, "__lang", "left").withColumns({"__char": F.lit(1.0), "__word": F.lit(1.0)})
    block: list[Reference] = []
    for r in model.orderBy("lang").toLocalIterator():  # a few thousand bytes for each language
        if len(block) == AT_ONCE:
            joined, block = nearer(joined, block), []
        block.append(reference(r["reference"].asDict()))
    return joined, block


def nearer(joined: DataFrame, block: list[Reference]) -> DataFrame:
    """The same rows, with the distances of documents without a language from these references too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in steps(batches):
            if not pc.any(pc.equal(rows.column("__lang"), "")).as_py():
                yield rows
                continue
            new = dict(zip(("__char", "__word"), map(pa.array, distances(raw, counts(raw, offs), rows, block)), strict=True))
            yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in rows.schema.names], rows.schema.names)

    schema = joined.schema
    for f in schema.fields:
        f.nullable = True
    return joined.mapInArrow(lean(run), schema)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from q."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(-1)

    return np.sqrt(np.clip((part(np.broadcast_to(p, m.shape)) + part(np.broadcast_to(q, m.shape))) / 2, 0, 1))


def distances(raw: np.ndarray, c: Counts, rows: pa.RecordBatch, every: list[Reference]) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distance from its language's reference, by characters and by common words; 0 where there is none. Without a language:
    from the nearest of `every` and of those that have been looked at."""
    langs, refs = rows.column("__lang"), rows.column("__reference")
    n_docs = len(c.first) - 1
    char, word = np.zeros(n_docs), np.zeros(n_docs)
    shares = c.chars / np.maximum(c.chars.sum(1, keepdims=True), 1)
    keys = word_keys(raw, c)
    n_words = np.maximum(np.diff(c.first), 1)
    langs = langs.dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = code[c.doc]
    for k, name in enumerate(langs.dictionary.to_pylist()):
        docs = np.flatnonzero(code == k)
        own = refs[int(docs[0])].as_py()
        near = every if name == "" else [reference(own)] if own else []
        if not near:
            continue
        mine = of == k
        at_doc, mine = np.searchsorted(docs, c.doc[mine]), keys[mine]
        char[docs], word[docs] = (rows.column(k).to_numpy()[docs] if name == "" else 1.0 for k in ("__char", "__word"))
        for ref in near:
            char[docs] = np.minimum(char[docs], js_distance(shares[docs], ref.chars))
            known, wide = ref.words, len(ref.words) + 1
            at = np.searchsorted(known, mine)
            entry = np.where(np.append(known, 0)[at] == mine, at, len(known))
            hist = np.bincount(at_doc * wide + entry, minlength=len(docs) * wide).reshape(len(docs), wide)
            word[docs] = np.minimum(word[docs], js_distance(hist / n_words[docs, None], ref.shares))
    return char, word


def judge(rows: pa.RecordBatch, raw: np.ndarray, offs: np.ndarray, every: list[Reference], min_words: int, char_limit: float, word_limit: float) -> tuple[Counts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, kept and both distances of the documents of a step. The limit of word distance is wider for short
    texts, by WORD_SLACK / sqrt(n_words): a short text's histogram is far from any reference by chance."""
    c = counts(raw, offs)
    n_words = c.base["n_words"]
    failed = (n_words < 50) | (100 * c.base["n_repeat_words"] > 50 * n_words)
    char, word = distances(raw, c, rows, every)
    far = (n_words >= min_words) & ((char > char_limit) | (word > word_limit + WORD_SLACK / np.sqrt(np.maximum(n_words, 1))))
    return c, failed, ~failed & ~far, char, word


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and both distances."""
    joined, every = with_reference(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in steps(batches):
            c, failed, kept, char, word = judge(rows, raw, offs, every, min_words, char_limit, word_limit)
            columns = [rows.column("doc_id"), *(pa.array(c.base[k]) for k in BASE_COLUMNS), pa.array(failed), pa.array(kept), pa.array(char), pa.array(word)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE_COLUMNS, "base_failed", "kept", "char_distance", "word_distance"])

    texts = joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "__lang", "__reference", "__char", "__word")
    return texts.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{k} long" for k in BASE_COLUMNS) + ", base_failed boolean, kept boolean, char_distance double, word_distance double")


@any_columns
def good_documents(docs: DataFrame, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    joined, every = with_reference(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in steps(batches):
            yield rows.select(names).filter(pa.array(judge(rows, raw, offs, every, min_words, char_limit, word_limit)[2]))

    return joined.mapInArrow(lean(run), docs.schema)


_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: The character classes as patterns, in order; what none of them has is beyond ASCII.
_CLASSES = ["a-z", "A-Z", "0-9", "\\x20\\x09-\\x0D", ".,;:?''\"()\\-", "#*$%&|<>"]


def _js(p: str, q: str) -> str:
    """The terms of a Jensen-Shannon divergence."""
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
c AS (SELECT *, {", ".join(f"length(regexp_replace(text, '[^{k}]', '', 'g')) AS c{i}" for i, k in enumerate(_CLASSES))},
  length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS ascii, length(text) AS n_chars, len(w) AS n_words, list_sum([length(x) for x in w]) AS word_chars FROM d),
h AS (SELECT r, lang, unnest([c0, c1, c2, c3, c4, c5, ascii - c0 - c1 - c2 - c3 - c4 - c5, n_chars - ascii]) AS n, unnest(range(8)) AS entry, n_chars FROM c),
words AS (SELECT r, lang, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
plain AS (SELECT r, lang, CASE WHEN length(x) > 1 AND right(x, 1) IN ('.', ',', '!', '?') THEN left(x, length(x) - 1) ELSE x END AS x FROM (SELECT r, lang, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM words)),
totals AS (SELECT lang, x, count(*) AS n FROM plain GROUP BY lang, x),
sizes AS (SELECT lang, sum(n) AS total FROM totals GROUP BY lang HAVING sum(n) >= {LEAST_WORDS}),
top AS (SELECT lang, x, n FROM (SELECT lang, x, n, count(*) OVER (PARTITION BY lang ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM totals) WHERE place <= {COMMON}),
other AS (SELECT s.lang, s.total, s.total - coalesce(sum(t.n), 0) AS n FROM sizes s LEFT JOIN top t USING (lang) GROUP BY s.lang, s.total),
meets AS (SELECT c.r, s.lang AS ref FROM c JOIN sizes s ON s.lang = c.lang OR c.lang = ''),
char_ref AS (SELECT lang AS ref, entry, CAST(sum(n) AS DOUBLE) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS q FROM h GROUP BY lang, entry),
char_js AS (SELECT r, ref, sum({_js("p", "q")}) AS js FROM (SELECT m.r, m.ref, CAST(h.n AS DOUBLE) / greatest(h.n_chars, 1) AS p, k.q FROM meets m JOIN h USING (r) JOIN char_ref k ON k.ref = m.ref AND k.entry = h.entry) GROUP BY r, ref),
own AS (SELECT r, x, count(*) AS n FROM plain GROUP BY r, x),
common AS (SELECT m.r, m.ref, CAST(coalesce(o.n, 0) AS DOUBLE) / greatest(c.n_words, 1) AS p, CAST(t.n AS DOUBLE) / s.total AS q, coalesce(o.n, 0) AS n FROM meets m JOIN c USING (r) JOIN sizes s ON s.lang = m.ref JOIN top t ON t.lang = m.ref LEFT JOIN own o ON o.r = m.r AND o.x = t.x),
word_js AS (SELECT z.r, z.ref, sum(z.js) AS js FROM (
  SELECT r, ref, {_js("p", "q")} AS js FROM common
  UNION ALL SELECT r, ref, {_js("p", "q")} FROM (SELECT m.r, m.ref, CAST(c.n_words - coalesce(sum(k.n), 0) AS DOUBLE) / greatest(c.n_words, 1) AS p, any_value(CAST(o.n AS DOUBLE) / o.total) AS q
    FROM meets m JOIN c USING (r) JOIN other o ON o.lang = m.ref LEFT JOIN common k ON k.r = m.r AND k.ref = m.ref GROUP BY m.r, m.ref, c.n_words)) z GROUP BY z.r, z.ref),
far AS (SELECT m.r, min(sqrt(greatest(0, least(1, a.js)))) AS char_distance, min(sqrt(greatest(0, least(1, b.js)))) AS word_distance FROM meets m JOIN char_js a USING (r, ref) JOIN word_js b USING (r, ref) GROUP BY m.r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
three AS (SELECT r, p, x || chr(10) || lead(x, 1) OVER (PARTITION BY r ORDER BY p) || chr(10) || lead(x, 2) OVER (PARTITION BY r ORDER BY p) AS t FROM words),
twice AS (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, t) AS n FROM three WHERE t IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r),
f AS (SELECT c.doc_id, c.n_words, coalesce(c.word_chars, 0) AS word_chars, c.c5 AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(far.char_distance, 0) AS char_distance, coalesce(far.word_distance, 0) AS word_distance FROM c LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN far USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words >= {MIN_WORDS} AND (char_distance > {CHAR_LIMIT} OR word_distance > {WORD_LIMIT} + {WORD_SLACK} / sqrt(greatest(n_words, 1)))) AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM f
"""
