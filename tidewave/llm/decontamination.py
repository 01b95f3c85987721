"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

Operator 2. A mask of 1s and 0s over following words makes a seed: the hash of the words under the 1s; words under the 0s may
differ. Seeds of all places of the documents join the seeds of all places of the benchmark items; a hit fixes how an item lies
over a document, and there the words are compared one by one. A document is contaminated by an item if at least PERCENT of the
item's words, or of WINDOW of them that follow one another, are equal in place. So substituted words are tolerated.

A word that is repeated gives one seed at many places of a document and of an item. Places of one seed that follow one another are a run, and
two runs meet once: they give a range of shifts, not all pairs of their places. Hits hold no words; the different shifts of a document and
an item are gathered and written before any word is compared, and a place where all words are equal is settled by one comparison.

The MASKS leave no permitted pattern of substitutions of an item of SPAN words or more without a seed at 80 percent (enumerated up to
400 words); at a lower percentage they may. Items of fewer than SPAN words are looked for up to four words as exact copies, five and six
words with each one of them left out (80 percent allow one).
A short item of common words contaminates all documents that have it. ORACLE_SQL has no masks: it lays items over documents wherever
any two or three words that follow one another agree, so it sees a pair that the masks would miss.

Words are in lower case and parted by space and U+0009 to U+000D. Null texts count as empty, and items without words are not looked
for. Rows without an id are compared like others. Repeated rows count once. Other columns are ignored, whatever their names.

The items' seeds and words are broadcast only if their counted size is within BROADCAST_WORDS; beyond it seeds are joined by a shuffle, in
which a seed is salted by document, as one may be common. The hits are broadcast to the texts only if their counted number is within
BROADCAST_HITS; beyond it texts are joined by a shuffle. Within both bounds nothing of the documents is shuffled but places of hits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import any_columns, cut, with_tie

#: Fixed patterns of five words; what they leave out differs, so that permitted substitutions can't avoid all of them.
MASKS = ("1110011", "1101011", "1011011", "11111")
SPAN = 7
PERCENT = 80
WINDOW = 20
#: Words of all items together, up to which the items' side is broadcast (about 100 bytes for each word and mask).
BROADCAST_WORDS = 400_000
#: Hits up to which they are broadcast (about 60 bytes each), and the parts of a seed that is joined by a shuffle.
BROADCAST_HITS, SALTS = 400_000, 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def seeds(words: DataFrame, keep: list[str], masks: Sequence[str] = MASKS, kind: str = "") -> DataFrame:
    """One row per place and mask that lies inside the words: the kept columns, pos (from 0) and seed."""
    # arrays_zip fills with nulls behind the last word
    zipped = F.arrays_zip(*(F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))).alias(f"w{i}") for i in range(max(map(len, masks)))))
    placed = words.select(*keep, F.posexplode(zipped).alias("pos", "w"))
    hashed = [F.when(F.col(f"w.w{len(m) - 1}").isNotNull(), F.xxhash64(*(F.col(f"w.w{i}") for i, c in enumerate(m) if c == "1"), F.lit(kind + m))) for m in masks]
    return placed.select(*keep, "pos", F.explode(F.array(*hashed)).alias("seed")).where("seed IS NOT NULL")


def short_masks(size: int) -> list[tuple[int, str]]:
    """(offset, mask) of an item of fewer than SPAN words: the whole item, or each of its words left out where PERCENT allow that."""
    if 100 * (size - 1) < PERCENT * size:
        return [(0, "1" * size)]
    rows = ("1" * k + "0" + "1" * (size - 1 - k) for k in range(size))
    return [(m.index("1"), m.strip("0")) for m in rows]


def runs(places: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Runs of following places: one row per key and run, with its first and last place."""
    in_order = Window.partitionBy(*keys).orderBy(pos)
    numbered = places.select(*keys, pos, (F.col(pos) - F.dense_rank().over(in_order)).alias("run"))
    return numbered.groupBy(*keys, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("run")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def best_window(same: Column, width: Column) -> Column:
    """Most 1s among `width` that follow one another, in one walk: the sum of the newest `width`, kept by what comes in and goes out."""

    def step(acc: Column, i: Column) -> Column:
        total = acc["total"] + F.get(same, i) - F.when(i >= width, F.get(same, i - width)).otherwise(0)
        return F.struct(total.alias("total"), F.greatest(acc["best"], total).alias("best"))

    places = F.when(F.size(same) > 0, F.sequence(F.lit(0), F.size(same) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.struct(F.lit(0).alias("total"), F.lit(0).alias("best")), step, lambda acc: acc["best"])


def laid(words: Column, item: Column, shift: Column, percent: int, width: Column) -> Column:
    """An item laid over a document: how many words are equal in place, and most of `width` that follow one another (0 where there are too
    few in all). Where all of them are equal, none is looked at alone."""
    first = F.greatest(-shift, F.lit(0))  # the item's first word that lies over the document
    over = F.greatest(F.least(F.size(item), F.size(words) - shift) - first, F.lit(0))
    both = F.struct(F.slice(words, shift + first + 1, over).alias("a"), F.slice(item, first + 1, over).alias("b"))

    def found(n: Column, best: Column) -> Column:
        return F.struct(n.alias("n_match"), (-shift).alias("back"), F.when(F.lit(100) * n >= percent * width, best).otherwise(0).alias("window"))

    def one_by_one(same: Column) -> Column:
        return bound(F.aggregate(same, F.lit(0), lambda acc, x: acc + x), lambda n: found(n, best_window(same, width)))

    equal = lambda x, y: F.when(x == y, 1).otherwise(0)
    return bound(both, lambda p: F.when(p["a"] == p["b"], found(F.size(p["a"]), F.least(F.size(p["a"]), width))).otherwise(bound(F.zip_with(p["a"], p["b"], equal), one_by_one)))


def _verified(met: DataFrame, percent: int, window: int) -> DataFrame:
    """met: doc_id, words, item_id, item_words, shifts. One row per contaminated document and item; the words of a pair are held once,
    whatever the number of its shifts."""
    n = F.size("item_words")
    width = F.least(F.lit(window), n)
    places = F.transform("shifts", lambda shift: laid(F.col("words"), F.col("item_words"), shift, percent, width))
    good = F.filter(places, lambda p: (F.lit(100) * p["n_match"] >= percent * n) | (F.lit(100) * p["window"] >= percent * width))
    rows = met.select("doc_id", "item_id", n.alias("n_words"), good.alias("good")).where(F.size("good") > 0)
    rows = rows.select("doc_id", "item_id", "n_words", F.array_max("good").alias("best"), F.array_max("good.window").alias("window"))
    out = rows.groupBy("doc_id", "item_id", "n_words").agg(F.max("best").alias("best"), F.max("window").alias("window"))
    return out.select("doc_id", "item_id", F.col("n_words").cast("long").alias("n_words"), F.col("best.n_match").cast("long").alias("n_match"), (-F.col("best.back")).cast("long").alias("start_word"), F.col("window").cast("long").alias("best_window"))


def hits_of(texts: DataFrame, marked: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """doc_id, item and all different shifts by which a seed of the item lies on an equal one of the document. texts: doc_id, words; marked: item, item_words;
    sizes: the lengths of items of fewer than SPAN words."""
    whole = marked.withColumnRenamed("item_words", "words")
    item_seeds = seeds(whole.where(F.size("words") >= SPAN), ["item"]).withColumnRenamed("pos", "item_pos")
    used = set()
    for n in sizes:
        masks = short_masks(n)
        used |= {m for _, m in masks}
        mine = whole.where(F.size("words") == n)
        for at, mask in masks:
            item_seeds = item_seeds.unionByName(seeds(mine, ["item"], [mask], "short").where(F.col("pos") == at).withColumnRenamed("pos", "item_pos"))
    item_runs = cut(runs(item_seeds.select("seed", "item", "item_pos").distinct(), ["seed", "item"], "item_pos").select("seed", "item", F.col("first").alias("a"), F.col("last").alias("z")), "item-runs")
    found = seeds(texts, ["doc_id"])
    found = found.unionByName(seeds(texts, ["doc_id"], sorted(used), "short")) if used else found
    known = item_runs.select("seed").distinct()
    if small:
        # their size was counted: at most BROADCAST_WORDS words, and a row of a few numbers for each and each mask
        known, item_runs, keys = F.broadcast(known), F.broadcast(item_runs), ["seed"]
    else:
        salts = F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("salt")
        known, item_runs, keys = known.select("seed", salts), item_runs.select("*", salts), ["seed", "salt"]
        found = found.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    met = runs(found.join(known, keys, "left_semi"), ["doc_id", *keys], "pos").join(item_runs, keys)
    shifts = F.explode(F.sequence(F.col("first") - F.col("z"), F.col("last") - F.col("a"))).alias("shift")
    return met.select("doc_id", "item", shifts).groupBy("doc_id", "item").agg(F.collect_set("shift").alias("shifts"))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_words (of the item), n_match (most words equal in place),
    start_word (where the item lies, may be negative), best_window (most equal words of `window` that follow one another). Hits are
    found and written when this is called."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    id_ = F.col("doc_id") if dict(docs.dtypes)["doc_id"].startswith("struct") else F.col("doc_id").cast("long")
    texts = docs.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = {r["short"]: r["words"] or 0 for r in items.groupBy(F.when(F.size("item_words") < SPAN, F.size("item_words")).alias("short")).agg(F.sum(F.size("item_words")).alias("words")).collect()}
    small = sum(sizes.values()) <= broadcast_words
    marked = items.withColumn("item", F.xxhash64("item_id", "item_words"))
    hits = cut(hits_of(texts.select("doc_id", words_of(F.col("text")).alias("words")), marked, sorted(n for n in sizes if n), small), "item-hits")
    few = (hits.agg(F.sum(F.size("shifts"))).first()[0] or 0) <= broadcast_hits
    # <=>: a document without an id meets its own text again
    met = texts.alias("t").join((F.broadcast(hits) if few else hits).alias("h"), F.expr("h.doc_id <=> t.doc_id")).select("t.doc_id", words_of(F.col("text")).alias("words"), "item", "shifts")
    met = met.join(F.broadcast(marked) if small else marked, "item").select("doc_id", "words", "item_id", "item_words", "shifts")
    return _verified(met, percent, window)


@any_columns
def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, window: int = WINDOW) -> DataFrame:
    """The documents that no item contaminates, with all their columns. Rows that share an id, or have none, are judged each by its
    own text."""
    tied, _ = with_tie(docs)
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("__tie").alias("tie"))
    bad = contaminated(tied.select(key.alias("doc_id"), "text"), benchmark, percent, window).select(F.col("doc_id").alias("__bad")).distinct()
    bad = cut(bad, "contaminated")  # its size is known then: a small one is broadcast, and no text is shuffled
    return tied.join(bad, key == F.col("__bad"), "left_anti").select(*docs.columns)


#: Runs of equal words that a permitted pattern always leaves: all of an item of up to 4 words, 2 of 5, 3 of more.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT *, CASE WHEN len(w) <= 4 THEN len(w) WHEN len(w) = 5 THEN 2 ELSE 3 END AS run FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, run, unnest(range(1, CAST(len(w) - run + 2 AS BIGINT))) AS p FROM k),
bs AS (SELECT item_id, w, p, run, list_aggregate(w[p:p + run - 1], 'string_agg', chr(10)) AS s FROM bp),
dp AS (SELECT doc_id, w, r.run, unnest(range(1, CAST(len(w) - r.run + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT run FROM k) r WHERE len(w) >= r.run),
ds AS (SELECT doc_id, p, run, list_aggregate(w[p:p + run - 1], 'string_agg', chr(10)) AS s FROM dp),
h AS (SELECT DISTINCT ds.doc_id, bs.item_id, bs.w AS bw, ds.p - bs.p AS shift FROM ds JOIN bs USING (s, run)),
e AS (SELECT h.doc_id, h.item_id, h.shift, len(bw) AS n, unnest(range(1, len(bw) + 1)) AS i, bw, d.w AS dw FROM h JOIN d USING (doc_id)),
m AS (SELECT doc_id, item_id, bw, shift, n, i, CASE WHEN i + shift BETWEEN 1 AND len(dw) AND bw[i] = dw[i + shift] THEN 1 ELSE 0 END AS same FROM e),
s AS (SELECT doc_id, item_id, bw, shift, n, sum(same) OVER (PARTITION BY doc_id, item_id, bw, shift) AS n_match,
  sum(same) OVER (PARTITION BY doc_id, item_id, bw, shift ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS win FROM m),
g AS (SELECT doc_id, item_id, bw, shift, n, max(n_match) AS n_match, max(win) AS win FROM s GROUP BY ALL),
k2 AS (SELECT *, CASE WHEN 100 * n_match >= 80 * least(n, 20) THEN win ELSE 0 END AS w2 FROM g)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_words, CAST(max(n_match) AS BIGINT) AS n_match, CAST(arg_max(shift, struct_pack(a := n_match, b := -shift)) AS BIGINT) AS start_word, CAST(max(w2) AS BIGINT) AS best_window
FROM k2 WHERE 100 * n_match >= 80 * n OR 100 * w2 >= 80 * least(n, 20) GROUP BY doc_id, item_id, n
"""
