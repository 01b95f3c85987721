"""Token-id files: static range asymmetric numeral system, shared frequency tables, interleaved blocks.

Operator 4. Documents go in ascending order of doc_id to shards (range partitions). A shard is a row of groups of whole
documents; a group has one frequency table (sum 2 ** 16) that all its blocks share. A block holds up to 16,384 ids and is
independent of all others: id i of a block belongs to lane i mod 64, each lane is a 32-bit state, and lanes share one stream
of 16-bit words. The checkpoint of a block has its first id, its place in the stream, its lanes' states and the CRC-32 of its
ids, so that any block can be decoded alone and is checked as it is. numpy codes the lanes of all blocks of a group at once.

Records are a binary column of Parquet files: Spark commits them, and tasks that are lost are run again with the same result.
A record: b"TWR1", header of 5 unsigned 64-bit integers (documents, ids, blocks, different ids, words), documents' ids (int64),
whether they are null (uint8), their numbers of ids (int64), different ids (uint32), frequencies (uint32), checkpoints (words
before it, words, crc32: uint32 each; 64 uint32 states), words (uint16); all little-endian.

Null texts count as empty: one end id. Rows that share a doc_id are ordered by text. Null ids come first. Nothing is dropped.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm.bpe import Pieces, _byte_letters, encode_step
from tidewave.llm.common import documents, ragged, shared_folder, steps

LANES, BLOCK, GROUP = 64, 16_384, 1 << 20
MAGIC = b"TWR1"
FILE_SCHEMA = "shard int, shard_start long, n_tokens long, record binary"


@functools.cache
def library(path: str) -> tuple[Pieces, dict[bytes, int]]:
    """The tokenizers library behind a cache of pieces: its model encodes each different piece of text once."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model, letters = tok.model, _byte_letters()

    def encode(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's model on each piece, written in the letters that stand for bytes."""
        text = raw[ragged(start, length)].tobytes().decode("latin-1").translate(letters)
        to = np.cumsum(length)
        got = [[t.id for t in model.tokenize(text[a:b])] for a, b in zip((to - length).tolist(), to.tolist(), strict=True)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.int64, int(count.sum())), count

    added = {t.content.encode(): i for i, t in tok.get_added_tokens_decoder().items()}
    return Pieces(encode), added


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole numbers of at least 1 that sum to 2 ** 16, close to the counts' shares."""
    if len(counts) > 1 << 16:
        raise ValueError(f"a group has {len(counts)} different ids; a table holds 65536")
    out = np.maximum(1, counts * (1 << 16) // counts.sum())
    order = np.argsort(-out, kind="stable")
    left = int((1 << 16) - out.sum())
    if left > 0:
        out[order[0]] += left
    k = 0
    while left < 0:  # take back what raising rare ids to 1 has used
        take = min(-left, max(0, int(out[order[k]]) // 2))
        out[order[k]] -= take
        left += take
        k = (k + 1) % len(order)
    return out


def pack(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One record."""
    different, symbol, seen = np.unique(ids, return_inverse=True, return_counts=True)
    freq = frequencies(seen) if len(seen) else seen
    blocks = -(-len(ids) // BLOCK)
    per = BLOCK // LANES
    # a last symbol of frequency 2 ** 16 fills the end of the last block: coding it changes nothing
    full = np.full(blocks * BLOCK, len(different), np.int64)
    full[: len(ids)] = symbol.reshape(-1)
    at = full.reshape(blocks, per, LANES).transpose(1, 0, 2).reshape(per, blocks * LANES)
    f_of = np.append(freq, 1 << 16).astype(np.uint64)
    c_of = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
    state = np.full(blocks * LANES, 1 << 16, np.uint64)
    out = np.zeros((per, blocks * LANES), np.uint16)
    put = np.zeros((per, blocks * LANES), bool)
    bits = np.uint64(16)
    for t in range(per - 1, -1, -1):
        f = f_of[at[t]]
        spill = state >= f << bits
        put[t] = spill
        out[t] = state & np.uint64(0xFFFF)
        state = np.where(spill, state >> bits, state)
        whole = state // f
        state = (whole << bits) + (state - whole * f) + c_of[at[t]]
    shape = (per, blocks, LANES)
    put, out = put.reshape(shape).transpose(1, 0, 2), out.reshape(shape).transpose(1, 0, 2)
    words = put.sum((1, 2)) if blocks else np.zeros(0, np.int64)
    before = np.cumsum(words) - words
    marks = b"".join(
        struct.pack("<III", int(before[b]), int(words[b]), zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes())) + state[b * LANES : (b + 1) * LANES].astype("<u4").tobytes() for b in range(blocks)
    )
    head = MAGIC + struct.pack("<5Q", len(doc_ids), len(ids), blocks, len(different), int(words.sum()))
    return head + doc_ids.astype("<i8").tobytes() + null.astype("u1").tobytes() + counts.astype("<i8").tobytes() + different.astype("<u4").tobytes() + freq.astype("<u4").tobytes() + marks + out[put].astype("<u2").tobytes()


def unpack(record: bytes, only: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, null, counts, ids) of a record; only: decode just these blocks. Raises ValueError where a checksum is wrong."""
    if record[:4] != MAGIC:
        raise ValueError("not a token record")
    docs, total, blocks, kinds, n_words = struct.unpack_from("<5Q", record, 4)
    at = 44

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(record, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, null, counts = take("<i8", docs), take("u1", docs), take("<i8", docs)
    different, freq = take("<u4", kinds), take("<u4", kinds).astype(np.uint64)
    marks = take("<u4", blocks * (3 + LANES)).reshape(blocks, 3 + LANES)
    words = take("<u2", n_words).astype(np.uint64)
    which = np.arange(blocks) if only is None else np.array(only, np.int64)
    size = np.minimum(BLOCK, total - which * BLOCK)
    per = BLOCK // LANES
    if not len(which):
        return doc_ids, null, counts, np.zeros(0, np.uint32)
    slot_of = np.repeat(np.arange(kinds), freq.astype(np.int64))
    cum = np.cumsum(freq) - freq
    state = marks[which, 3:].astype(np.uint64).reshape(-1)
    spot = marks[which, 0].astype(np.int64)
    got = np.zeros((per, len(which) * LANES), np.uint32)
    lane = np.tile(np.arange(LANES), len(which))
    length = np.repeat(size, LANES)
    even = int(size.min()) // LANES
    low, bits = np.uint64(0xFFFF), np.uint64(16)
    words = np.append(words, np.uint64(0))
    for t in range(-(-int(size.max()) // LANES)):
        slot = state & low
        s = slot_of[slot.astype(np.int64)]
        new = freq[s] * (state >> bits) + slot - cum[s]
        need = new < np.uint64(1 << 16)
        if t >= even:
            live = t * LANES + lane < length
            new = np.where(live, new, state)
            need &= live
        by_block = need.reshape(len(which), LANES)
        order = np.cumsum(by_block, 1)
        where = (spot[:, None] + order - 1).reshape(-1)
        state = np.where(need, new << bits | words[np.where(need, where, 0)], new)
        spot = spot + order[:, -1]
        got[t] = different[s]
    if (state != np.uint64(1 << 16)).any():  # coding began in this state
        raise ValueError("a block is damaged: its lanes don't end where coding began")
    ids = got.reshape(per, len(which), LANES).transpose(1, 0, 2).reshape(len(which), BLOCK)
    parts = [ids[k, :n] for k, n in enumerate(size.tolist())]
    for b, part in zip(which.tolist(), parts, strict=True):
        if zlib.crc32(part.astype("<u4").tobytes()) != int(marks[b, 2]):
            raise ValueError(f"block {b} is damaged: its checksum differs")
    return doc_ids, null, counts, np.concatenate(parts)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, group: int = GROUP) -> None:
    """Encode all texts with the tokenizers library, end each with end_id, write them in ascending doc_id order to path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, added = library(tokenizer)
        context = TaskContext.get()
        shard, before = context.partitionId() if context else 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal before
            doc_ids, null, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([before]), pa.array([len(ids)]), pa.array([pack(doc_ids, null, counts, ids)], pa.binary())], ["shard", "shard_start", "n_tokens", "record"])
            before += len(ids)
            return row

        for rows, raw, offs in steps(batches):
            ids, at = encode_step(raw, offs, pieces, added)
            counts = np.diff(at)
            ids = np.insert(ids, at[1:], end_id)
            column = rows.column("doc_id")
            held.append((column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False), counts + 1, ids))
            if sum(len(h[3]) for h in held) >= group:
                yield flush()
        if held:
            yield flush()

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32; with_ids: also ids (binary, little-endian
    unsigned 32-bit). Blocks decode in parallel and are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, begins, record in zip(batch.column("shard").to_pylist(), batch.column("shard_start").to_pylist(), batch.column("record"), strict=True):
                doc_ids, null, counts, ids = unpack(record.as_py())
                raw, to = ids.astype("<u4").tobytes(), np.cumsum(counts)
                own = [raw[4 * (b - n) : 4 * b] for b, n in zip(to.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array(np.full(len(to), shard, np.int32)), pa.array(begins + to - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(own, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # a row for each shard, not for each document: the window over them is as small as the list of partitions
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    rows = files.select("shard", "shard_start", "record").mapInArrow(run, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    joined = rows.join(shards, "shard")
    return joined.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs to token files in the shared folder and return what reading them back gives (see read_token_files)."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tidewave/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
