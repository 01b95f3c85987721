"""Vector codes: four codebooks in integers, and the search for the nearest entry by partial distances.

Operator 12. Components become floor(1024 * x) and vectors are cut into PARTS equal parts, each with a codebook of up to ENTRIES entries.
Each of ROUNDS rounds gives every part its nearest entry and moves each entry to the floored mean of its parts. All sums are whole numbers,
so results don't depend on how rows are dealt.

The search takes dimensions in descending variance of the codebook. The first few are added up for all entries; the nearest entry so far
is completed, and its distance is the bound: an entry whose accumulated distance strictly exceeds it is dropped, so that only few
entries meet the later dimensions. Of equal distances the lowest index counts.

Rows whose vector is null, or holds null or non-finite components, are dropped, and so are those whose length isn't that of the smallest
kept id's vector; that length must be a multiple of PARTS. Components beyond LARGEST in size are an error, as sums might not fit. Repeated
ids are rows of their own, in the order of their components; null ids come last. Fewer than ENTRIES rows give as many entries, an empty table
gives no rows. Other columns are dropped, so their names can't clash.

The integer vectors are written once to the shared folder. A round moves sums of entries only: one row for each task, part and entry. The driver
holds the codebooks: 256 times a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: The largest component: squares of differences of integers below 2 ** 28, in sums of a thousand, are whole 64-bit numbers.
LARGEST = float(1 << 17)
#: Dimensions added up before entries are dropped, then between one drop and the next; vectors that are searched together.
LEAD, STRIDE, TOGETHER = 4, 3, 1024


def components(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and offsets (n + 1) of a list column, and which rows have a value in each place, all of them finite."""
    lists = column.cast(pa.large_list(pa.float64()))
    offs = lists.offsets.to_numpy()
    values = lists.values.slice(offs[0], offs[-1] - offs[0]).to_numpy(zero_copy_only=False)  # a null becomes NaN
    offs = offs - offs[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[offs[1:]] == bad[offs[:-1]]) & (np.diff(offs) > 0) & ~lists.is_null().to_numpy(zero_copy_only=False)
    return values, offs, good


def integer_vectors(table: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """vec_id, label, size and the components as little-endian 32-bit integers (vector) of all rows with a whole vector."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offs, good = components(batch.column("vector"))
            size = np.diff(offs)
            kept = values[np.repeat(good, size)]
            if len(kept) and np.abs(kept).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST:g} in size")
            whole = np.floor(kept * SCALE).astype("<i4").tobytes()
            ends = np.concatenate([[0], np.cumsum(size[good])]) * 4
            where = pa.array(good)
            packed = pa.array([whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(where), batch.column("label").filter(where), pa.array(size[good].astype(np.int32)), packed], ["vec_id", "label", "size", "vector"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("size", T.IntegerType()), T.StructField("vector", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest row of book, the lowest of equals, and the squared distance."""
    width = book.shape[1]
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * largest * largest * width < 1 << 31 else np.int64
    x, book = np.ascontiguousarray(x[:, order], kind), np.ascontiguousarray(book[:, order], kind)
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), TOGETHER):
        some = x[at : at + TOGETHER]
        sums = np.zeros((len(some), len(book)), kind)
        for d in range(min(LEAD, width)):
            gap = some[:, d, None] - book[None, :, d]
            gap *= gap
            sums += gap
        first = sums.argmin(1)
        bound = np.square(some - book[first]).sum(1, dtype=kind)
        row, entry = np.nonzero(sums <= bound[:, None])
        total = sums[row, entry]
        for d in range(LEAD, width, STRIDE):
            for k in range(d, min(d + STRIDE, width)):
                total += np.square(some[row, k] - book[entry, k])
            stays = total <= bound[row]
            row, entry, total = row[stays], entry[stays], total[stays]
        begin = np.searchsorted(row, np.arange(len(some)))
        least = np.minimum.reduceat(total, begin)
        hit = np.flatnonzero(total == least[row])  # rows go up, and entries within a row
        code[at : at + len(some)] = entry[hit[np.searchsorted(row[hit], np.arange(len(some)))]]
        error[at : at + len(some)] = least
    return code, error


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i4").reshape(-1, size)


def entry_sums(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, pos, n (parts that the entry is nearest to) and total (sum of their components at pos)."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x = matrix(batch, width * PARTS)
            for p, book in enumerate(books):
                part = x[:, p * width : (p + 1) * width]
                code, _ = nearest(part, book)
                counts[p] += np.bincount(code, minlength=len(book))
                order = np.argsort(code, kind="stable")
                met, begin = np.unique(code[order], return_index=True)
                if len(met):
                    sums[p][met] += np.add.reduceat(part[order].astype(np.int64), begin, axis=0)
        for p, (s, n) in enumerate(zip(sums, counts, strict=True)):
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), p, np.int32)), pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(s[met].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "totals"])

    rows = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, totals array<long>")
    return rows.select("part", "entry", "n", F.posexplode("totals").alias("pos", "total")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Codebooks with each entry that was used at the floored mean of its parts."""
    out = [b.copy() for b in books]
    for r in sums.collect():  # at most PARTS * ENTRIES entries, whatever the table's size
        out[r.part][r.entry, r.pos] = r.total // r.n
    return out


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each vector."""
    width = books[0].shape[1]
    digits = np.array([f"{e:02x}" for e in range(ENTRIES)], "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, width * PARTS)
            found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
            text = np.stack([digits[code] for code, _ in found], 1).tobytes().decode()
            codes = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, schema)


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The final codebook of each part, from vectors of one size."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    start = np.array([np.frombuffer(r.vector, "<i4") for r in first], np.int64)
    if start.shape[1] % PARTS:
        raise ValueError(f"{start.shape[1]} components can't be cut into {PARTS} equal parts")
    books = np.split(start, PARTS, axis=1)
    for _ in range(rounds):
        books = moved(books, entry_sums(vectors, books))
    return books


def vector_codes(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together) and the codebooks' digest of each kept row."""
    vectors = cut(integer_vectors(table, vector, vec_id, label), "vectors")
    smallest = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("size").first()
    books = [np.zeros((0, 1), np.int64)] * PARTS
    if smallest:
        vectors = vectors.where(F.col("size") == smallest.size)
        books = codebooks(vectors, rounds)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    codes = cut(coded(vectors, books), "vector-codes")
    sums = cut(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "label-errors")
    # its size is known: few labels are broadcast, many are joined by a shuffle
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(n: int, last: bool) -> str:
    """Nearest entries by codebook b{n}, and the codebook after it."""
    near = f"""
d{n} AS (SELECT x.rid, x.part, b.entry, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS dist FROM x JOIN b{n} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL),
a{n} AS (SELECT rid, part, min(struct_pack(d := dist, e := entry)) AS best FROM d{n} GROUP BY ALL)"""
    return near if last else f"""{near},
m{n} AS (SELECT x.part, a.best.e AS entry, x.pos, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{n} a ON a.rid = x.rid AND a.part = x.part GROUP BY ALL),
b{n + 1} AS (SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""


ORACLE_SQL = f"""
WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
x AS MATERIALIZED (SELECT rid, (k - 1) // (n // {PARTS}) AS part, (k - 1) % (n // {PARTS}) AS pos, CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) AS v FROM (SELECT rid, len(e) AS n, unnest(e) AS c, generate_subscripts(e, 1) AS k FROM r)),
b0 AS (SELECT part, rid - 1 AS entry, pos, v FROM x WHERE rid <= {ENTRIES}),
{",".join(_round_sql(n, n == ROUNDS) for n in range(ROUNDS + 1))},
c AS (SELECT r.vec_id, r.label, string_agg(format('{{:02x}}', a.best.e), '' ORDER BY a.part) AS code, CAST(sum(a.best.d) AS BIGINT) AS error FROM r JOIN a{ROUNDS} a USING (rid) GROUP BY r.rid, r.vec_id, r.label),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""
