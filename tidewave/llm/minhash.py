"""Near-duplicate groups from SetSketch registers.

Operator 9. A document's set has its different five-word shingles (A to Z in lower case). A sketch has M registers: register i
is the minimum, over the set, of independent exponentially distributed values of rate A, on an exponential scale of base B and
truncated to 0 .. Q + 1. Sketches of parts merge by taking the larger register. Equal registers are locality-sensitive: R of
them make a band, and documents with an equal band are candidates. Candidates are estimated by the joint likelihood of the
registers that are larger, smaller and equal, given both set sizes, and what can reach the wanted similarity is verified on
full sets: of words, not of hashes. With 28 bands of 5 registers a pair at similarity 0.85 is missed with a chance of (1 - 0.85 ** 5) ** 28 < 1e-7.

Equal sets are one class with one representative before anything is paired. In a bucket, members are linked to a hub, the one
that shares most buckets, and only members of different components are compared further: first with other hubs, then, so that no
link is lost, all that are left. Shingles that a single candidate has can be in no intersection: with c shingles that others
have too, x and y share at most min(c_x, c_y), and pairs that can't reach the similarity so are never formed. Components come
from alternating star contraction over links, on Spark.

Null or empty texts, and texts without words, have an empty set and link with nothing. Texts of fewer words than a shingle have
one shingle, the whole sequence. Classes are numbered, so rows that share a doc_id but not a text link each by its own set; all of
them have the smallest doc_id of their own component, whatever the order of rows. Rows without a doc_id link with
nothing and are their own component (null). Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import any_columns, byte_table, cut, discard, documents, exact_words, flat, lean, mix, rows_of, Spans, steps, with_tie, word_bounds

WIDTH = 5
BANDS, ROWS = 28, 5
M = BANDS * ROWS
RATE, B, Q = 20.0, 1.001, 65534
#: Pairs estimated below this are not verified: at 0.85, M registers estimate so low with a chance under 1e-9.
LEAST_ESTIMATE = 0.62
_BASE = 0x2545F4914F6CDD1D
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: A to Z in lower case, all other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text of the pairs that are compared at once.
PAIR_BYTES = 1 << 22
_SCALES = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, M + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(raw: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of all documents, and where each document's begin (n + 1)."""
    start, end, first = word_bounds(raw, offs)
    n_docs = len(offs) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    word = Spans(raw, byte_table(5, lower=True), _BASE)(start, end)
    count = np.diff(first)
    doc = rows_of(first)
    size = np.minimum(width, count)[doc]
    place = np.arange(len(word)) - first[doc]
    keep = place <= count[doc] - size
    at = np.flatnonzero(keep)
    hashed = np.zeros(len(at), np.uint64)
    for k in range(width):
        more = k < size[at]
        # a place beyond a short sequence counts as no word
        hashed = hashed * _STEP + np.where(more, word[np.minimum(at + k, len(word) - 1)], np.uint64(0))
    hashed = mix(hashed + size[at].astype(np.uint64))
    owner = doc[at]
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    hashed, owner = hashed[new], owner[new]
    return hashed, np.searchsorted(owner, np.arange(n_docs + 1))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers under 2 ** 32: equal pairs have equal ones, others different ones."""
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1].reshape(-1)


def exact_shingles(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As shingles, but numbers that stand for the words themselves: within this call, they are equal where the words are."""
    raw = _LOWER[raw]
    start, end, first = word_bounds(raw, offs)
    n_docs = len(offs) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    count, doc = np.diff(first), rows_of(first)
    size = np.minimum(WIDTH, count)[doc]
    at = np.flatnonzero(np.arange(len(start)) - first[doc] <= count[doc] - size)
    word = np.append(exact_words(raw, start, end), 0)
    # a place beyond a short sequence has the number 0, which no word has
    column = [np.where(k < size[at], word[np.minimum(at + k, len(start))], 0) for k in range(WIDTH)]
    key = paired(paired(paired(column[0], column[1]), paired(column[2], column[3])), column[4])
    both = np.unique(doc[at].astype(np.uint64) << np.uint64(32) | key.astype(np.uint64))
    return both & np.uint64(0xFFFFFFFF), np.searchsorted(both >> np.uint64(32), np.arange(n_docs + 1).astype(np.uint64))


def registers(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers of each document (n x M, uint16); zeros for empty sets."""
    size = np.diff(first)
    out = np.zeros((len(size), M), np.uint16)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    at = first[full]
    lowest = np.empty((len(full), M), np.uint64)
    for i in range(M):
        lowest[:, i] = np.minimum.reduceat(hashed * _SCALES[i] + _SHIFTS[i], at)
    share = (lowest.astype(np.float64) + 0.5) / 2.0**64
    smallest = -np.log1p(-np.minimum(share, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(smallest) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of sketches (rows), given the set sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u, v)[:, None] / np.maximum(u, v)[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    p_up, p_down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    with np.errstate(divide="ignore", invalid="ignore"):

        def part(n: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.where(n[:, None] > 0, n[:, None] * np.log(np.maximum(x, 1e-12)), 0.0)

        fit = part(up, p_up) + part(down, p_down) + part(same, 1 - p_up - p_down)
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tie, n (set size), two fingerprints of the set, registers, and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in steps(batches):
            hashed, first = shingles(raw, offs)
            regs = registers(hashed, first)
            prints = fingerprints(hashed, first)
            key = np.zeros((len(regs), BANDS), np.uint64)
            for k in range(ROWS):
                key = mix(key * _STEP + regs[:, k::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(70001))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(regs) + 1, dtype=np.int32) * BANDS), pa.array(key.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("__tie"), pa.array(np.diff(first)), pa.array(prints[0]), pa.array(prints[1]), pa.array([r.tobytes() for r in regs], pa.binary()), keys], ["doc_id", "tie", "n", "print_1", "print_2", "regs", "keys"])

    return docs.mapInArrow(lean(run), "doc_id long, tie long, n long, print_1 long, print_2 long, regs binary, keys array<long>")


def fingerprints(hashed: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two numbers for each set of shingles."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mix(hashed + np.uint64(1)), mix(hashed ^ _STEP))]
    return [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id, size and fingerprints of its set, its sorted shingle hashes, and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offs in steps(batches):
            hashed, first = shingles(raw, offs)
            cuts, prints = first.tolist(), fingerprints(hashed, first)
            sets = pa.array([hashed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(first)), pa.array(prints[0]), pa.array(prints[1]), sets, rows.column("text")], ["doc_id", "n", "print_1", "print_2", "shingles", "text"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, print_1 long, print_2 long, shingles binary, text string")


def lone_shingles(sets: DataFrame) -> DataFrame:
    """node and how many of its shingles no other node of sets has (nodes with none are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                lists = [np.frombuffer(x.as_py(), np.int64) for x in some.column("shingles")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(some.column("node").to_numpy(), [len(x) for x in lists]))], ["shingle", "node"])

    rows = sets.select("shingles", "node").mapInArrow(lean(run), "shingle long, node long")
    return rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("lone"))


def shared_sizes(texts: pa.Array, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the sets of texts a[i] and b[i], by their words."""
    keys, first = exact_shingles(*flat(texts))
    size = np.diff(first)
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    common = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        mine, other = keys[first[x] : first[x + 1]], keys[first[y] : first[y + 1]]
        at = np.searchsorted(other, mine)
        common[i] = (other[np.minimum(at, len(other) - 1)] == mine).sum()
    return common, size[a] + size[b] - common


def compared(pairs: DataFrame, known: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """a, b, their exact similarity, and linked: whether 100 * intersection >= percent * union. known: node, n, regs, text.
    Pairs whose sketches can't come from sets of the wanted similarity are put aside first, unless the whole is asked for; each
    pair meets its two documents once, for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                some = batch.slice(k, 4096)
                if not whole:
                    regs = [np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("regs_a", "regs_b")]
                    sizes = [some.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
                    some = some.filter(pa.array(estimate(*regs, *sizes) >= LEAST_ESTIMATE))
                if not some.num_rows:
                    continue
                left, right = some.column("a").to_numpy(), some.column("b").to_numpy()
                # a text that is in many pairs of the batch is read once
                nodes, first, back = np.unique(np.concatenate([left, right]), return_index=True, return_inverse=True)
                texts = pa.concat_arrays([some.column("text_a"), some.column("text_b")]).take(pa.array(first))
                a, b = back.reshape(2, -1)
                length = np.diff(flat(texts)[1])
                weight = np.cumsum(length[a] + length[b])
                at = 0
                while at < len(a):
                    to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + PAIR_BYTES, "right")))
                    used, back = np.unique(np.concatenate([a[at:to], b[at:to]]), return_inverse=True)
                    common, union = shared_sizes(texts.take(pa.array(used)), *back.reshape(2, -1))
                    yield pa.RecordBatch.from_arrays([pa.array(left[at:to]), pa.array(right[at:to]), pa.array(common / union), pa.array(100 * common >= percent * union)], ["a", "b", "share", "linked"])
                    at = to

    names = ["text"] if whole else ["n", "regs", "text"]
    joined = pairs
    for side in ("a", "b"):
        joined = joined.join(known.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in names)), side)
    return joined.select("a", "b", *(f"{c}_{side}" for c in names for side in ("a", "b"))).mapInArrow(lean(run), "a long, b long, share double, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, part) of all nodes in links (a, b): the smallest node reachable. Alternating large and small
    stars, each written to the shared folder; a hub's neighbours are never gathered, only their minimum."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        last, edges = edges, cut(small, "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct()).groupBy("u").agg(F.min("v").alias("part")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, percent: int = 85, hub_rounds: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. percent: the least similarity of a link, in hundredths
    (bands and estimates are set for 80 or more)."""
    out = labelled(documents(docs).withColumn("__tie", F.lit(0).cast("long")), percent, hub_rounds)
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@any_columns
def without_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of smallest doc_id, with all its columns. Of rows that share a doc_id each
    text is a document; rows that share both are one (the least of them, so columns must have an order). Documents without words or
    without an id stay, all of them."""
    tied, repeated = with_tie(docs)
    out = labelled(documents(tied), percent)
    gone = out.where("first IS NOT NULL AND NOT (doc_id = first.doc_id AND tie = first.tie)").select("doc_id", F.col("tie").alias("__tie")).distinct()
    gone = cut(gone, "copies")  # its size is known then: a small one is broadcast, and no text is shuffled
    kept = tied.join(gone, ["doc_id", "__tie"], "left_anti")
    if repeated:
        lone = F.col("doc_id").isNull() | (F.col("__tie") == 0)
        rows = kept.where(~lone).groupBy("doc_id", "__tie").agg(F.min(F.struct(*docs.columns)).alias("__row"))
        return kept.where(lone).select(*docs.columns).unionByName(rows.select("__row.*"))
    return kept.select(*docs.columns)


def labelled(docs: DataFrame, percent: int, hub_rounds: int = 3) -> DataFrame:
    """doc_id, tie, n of each row, and first: (doc_id, tie) of the first document of its component, null for rows without words or
    without an id. docs: doc_id, text, __tie."""
    sketch = cut(sketches(docs), "sketches")
    real = sketch.where("n > 0 AND doc_id IS NOT NULL")
    prints = ["n", "print_1", "print_2"]
    # a class has a number of its own: a doc_id may stand for several
    classes = cut(real.groupBy(*prints).agg(F.min(F.struct("doc_id", "tie")).alias("first")).withColumn("node", F.monotonically_increasing_id()), "classes")
    marks = classes.select(*prints, F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie"), "node")
    own = cut(real.join(marks, [*prints, "doc_id", "tie"]).dropDuplicates([*prints, "doc_id"]).select("node", "doc_id", *prints, "regs", "keys"), "representatives")
    bands = own.select("node", "n", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    placed = cut(bands.join(shared, "key"), "places")
    popular = placed.groupBy("node").agg(F.sum("c").alias("popular"))
    wanted = own.join(popular.select("node"), "node", "left_semi").select("node", "doc_id", *prints, "regs")
    full = full_sets(docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi"))
    sets = cut(full.join(wanted, ["doc_id", *prints]).dropDuplicates(["doc_id", *prints]).select("node", "n", "regs", "shingles", "text"), "sets")
    about = popular.join(lone_shingles(sets), "node", "left")
    members = cut(placed.join(about, "node").select("node", "n", "key", "popular", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("core")), "members")
    members = members.join(members.groupBy("node").agg(F.collect_list("key").alias("keys")), "node").withColumns({"pivot": F.lit(None).cast("long"), "share": F.lit(None).cast("double")})
    hundred = 100 + percent
    links = None
    tried = None
    parts = members.withColumn("part", F.col("node"))
    for k in range(hub_rounds + 1):
        apart = parts.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("n").alias("least_n"), F.max(hundred * F.col("core") - percent * F.col("n")).alias("reach")).where("p < q").select("key", "least_n", "reach")
        # who can reach the similarity with nobody in the bucket, judged by the smallest and the most shared of it, leaves it
        able = (hundred * F.col("core") - percent * F.col("n") >= percent * F.col("least_n")) & (F.col("reach") >= percent * F.col("n"))
        open_ = parts.join(apart, "key").where(able).drop("least_n", "reach")
        if k < hub_rounds:  # each bucket's members against one hub, another one each round
            rank = -F.col("popular") if k == 0 else F.xxhash64(F.col("node"), F.col("key"), F.lit(k))
            hubs = open_.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "node", "n", "core", "part")).alias("h")).select("key", F.col("h.r").alias("hub_rank"), F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.core").alias("hub_core"), F.col("h.part").alias("hub_part"))
            pairs = open_.join(hubs, "key")
        else:  # all that are still in different components
            others = open_.select("key", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("core").alias("hub_core"), F.col("part").alias("hub_part"), F.col("keys").alias("hub_keys"), F.col("pivot").alias("hub_pivot"), F.col("share").alias("hub_share"))
            # 1 - similarity is a metric: what differs too much in its distance from a common pivot isn't similar
            far = F.coalesce((F.col("pivot") == F.col("hub_pivot")) & (F.abs(F.col("share") - F.col("hub_share")) > 1 - percent / 100 + 1e-9), F.lit(False))
            pairs = open_.join(others, "key").where("node < hub").where(~far)
            # a pair is formed in the first of the buckets that both are in: who can reach the similarity has left none of them
            pairs = pairs.where(F.array_min(F.array_intersect("keys", "hub_keys")) == F.col("key"))
        pairs = pairs.where("part != hub_part").where(hundred * F.least("core", "hub_core") >= percent * (F.col("n") + F.col("hub_n")))
        if k == 0:  # a document of many buckets first meets the best hub of all of them; the others come later, if it isn't linked then
            pairs = cut(pairs.groupBy("node").agg(F.min(F.struct("hub_rank", "hub")).alias("h")).select("node", "h.hub"), "first-hubs")
            best = pairs.select("node", F.col("hub").alias("pivot"))
        pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        if not pairs.take(1):
            if k == hub_rounds:
                break
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = cut(compared(pairs, sets, percent, whole=k == 0), "links")
        if k == 0:  # the hubs are pivots: the distances from them are known exactly
            apart_by = best.join(found, (F.least("node", "pivot") == F.col("a")) & (F.greatest("node", "pivot") == F.col("b"))).select("node", "pivot", "share")
            pivots = apart_by.unionByName(best.select(F.col("pivot").alias("node"), "pivot", F.lit(1.0).alias("share"))).groupBy("node").agg(F.max(F.struct("share", "pivot")).alias("p"))
            members = cut(members.drop("pivot", "share").join(pivots.select("node", "p.pivot", "p.share"), "node", "left"), "pivoted")
        found = found.where("linked").select("a", "b")
        # the components so far are stars around their smallest nodes
        links = found if links is None else parts_of.select(F.col("node").alias("a"), F.col("part").alias("b")).unionByName(found)
        parts_of = cut(components(links), "components")
        parts = members.join(parts_of, "node", "left").select("node", "n", "key", "popular", "core", "keys", "pivot", "share", F.coalesce("part", "node").alias("part"))
    if links is None:
        named = classes.select(*prints, "first")
    else:
        grouped = classes.join(parts_of, "node")
        firsts = grouped.select("node", "part").join(grouped.groupBy("part").agg(F.min("first").alias("of_part")), "part").select("node", "of_part")
        named = classes.join(firsts, "node", "left").select(*prints, F.coalesce("of_part", "first").alias("first"))
    out = sketch.select("doc_id", "tie", *prints).join(named, prints, "left")
    real = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return out.select("doc_id", "tie", "n", F.when(real, F.col("first")).alias("first"))


#: All shingles of all documents, all pairs that share one, and all that can be reached over links.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, list_aggregate(w[p:p + 4], 'string_agg', ' ') AS sh FROM p),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
q AS (SELECT s.* FROM s JOIN d USING (r) WHERE d.doc_id IS NOT NULL),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM q a JOIN q b ON a.sh = b.sh AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, coalesce(d.doc_id = m.component_id, true) AS kept FROM d LEFT JOIN n USING (r) JOIN m USING (r)
"""
