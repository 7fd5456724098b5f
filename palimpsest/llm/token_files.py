"""Token-id files: Simple-8b words in blocks, with a block's own offsets.

File format. A file is a Parquet table whose rows are blocks of consecutive
documents, in ascending doc_id order over the files. Columns: file (int), block
(int), first (ids in this file before the block), doc_ids and lengths (the block's
documents), n_words (of 64 bits), words (their bytes, little-endian), n_ids.

A 64-bit word has a 4-bit selector in its top bits and 60 bits of payload:

    selector   0   1   2   3   4   5   6   7   8   9  10  11  12  13  14
    ids      240 120  60  30  20  15  12  10   8   7   6   5   4   3   2
    bits       0   0   1   2   3   4   5   6   7   8  10  12  15  20  30

(selectors 0 and 1: runs of zeros); selector 15 is an escape: with payload 0 the
next whole word is one id of up to 64 bits, with payload 1 the word holds none and
ends a block whose ids do not fill a word, its payload from bit 4 on being one id
of at most 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import fresh_path, slices
from palimpsest.llm.tokens import byte_bpe, with_end

# Ids and bits of each selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
# by id, the first selector wide enough
_SELECTOR = np.searchsorted(1 << np.array(BITS[1:]), np.arange(1 << 16), side="right").astype(np.int8) + np.int8(1)
#: Ids after which a block is closed (at a document's end, so one very long document is one block).
BLOCK_IDS = 1 << 16
#: Bytes of text in a file, about.
FILE_BYTES = 64 << 20


def simple8b_encode(ids: np.ndarray) -> np.ndarray:
    """64-bit words of an array of unsigned ids below 2^64; greedy, densest first."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    # the first selector wide enough for each id; 15: escape
    need = _SELECTOR[np.minimum(ids, np.uint64(len(_SELECTOR) - 1)).astype(np.int64)]
    if ids.max() >= len(_SELECTOR):
        for s in range(14, 0, -1):
            need[ids < (np.uint64(1) << np.uint64(BITS[s]))] = s
        need[ids >= np.uint64(1 << 30)] = 15
    # the widest need in each stretch of 1, 2, 4, ... ids; a selector fits where its
    # stretch, as two that overlap, needs no wider one
    widest = [need]
    while 2 << len(widest) <= 2 * n and len(widest) < 8:
        last, half = widest[-1], 1 << (len(widest) - 1)
        widest.append(np.maximum(last[:-half], last[half:]))
    choice = np.full(n, 15, dtype=np.int8)
    for s in range(14, -1, -1):
        c = COUNTS[s]
        if n < c:
            continue
        k = c.bit_length() - 1
        room = n - c + 1
        stretch = np.maximum(widest[k][:room], widest[k][c - (1 << k) :][:room])
        np.copyto(choice[:room], s, where=stretch <= max(s, 1))
    # a byte a step: reading one makes no new number
    steps, taken, at = np.array([*COUNTS, 1], dtype=np.uint8)[choice].tobytes(), bytearray(n), 0
    while at < n:
        taken[at] = 1
        at += steps[at]
    starts = np.flatnonzero(np.frombuffer(taken, dtype=np.uint8))
    sel = choice[starts].astype(np.int64)
    value = ids[starts]
    tail = (sel == 15) & (value < np.uint64(1 << 32))  # short escape: the id in the word itself
    sizes = np.where((sel == 15) & ~tail, 2, 1)
    where = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint64)
    out[where] = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            at, word = starts[mine], np.zeros(len(mine), dtype=np.uint64)
            for j in range(COUNTS[s]):
                word |= ids[at + j] << np.uint64(j * BITS[s])
            out[where[mine]] |= word
    out[where[tail]] |= np.uint64(1) | (value[tail] << np.uint64(4))
    long = (sel == 15) & ~tail
    out[where[long] + 1] = value[long]
    return out


def simple8b_decode(words: np.ndarray) -> np.ndarray:
    """The ids of simple8b_encode's words, all words of a selector at once."""
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    escape = (sel == 15) & ((words & np.uint64(1)) == 0)
    if escape.any():  # the word after an escape is data, whatever its top bits say
        data = np.zeros(len(words), dtype=bool)
        skip = -1
        for k in np.flatnonzero(sel == 15).tolist():
            if k != skip and not int(words[k]) & 1:
                skip = k + 1
                data[skip] = True
        heads = np.flatnonzero(~data)
    else:
        heads = np.arange(len(words))
    s = sel[heads]
    n = np.array([*COUNTS, 1])[s]
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), dtype=np.uint64)
    for k in range(2, 15):
        mine = s == k
        if mine.any():
            w, mask = words[heads[mine]], np.uint64((1 << BITS[k]) - 1)
            for j in range(COUNTS[k]):
                out[at[mine] + j] = (w >> np.uint64(j * BITS[k])) & mask
    one = s == 15
    w = words[heads[one]]
    short = (w & np.uint64(1)) == 1
    follow = words[np.minimum(heads[one] + 1, len(words) - 1)]
    out[at[one]] = np.where(short, (w & np.uint64((1 << 60) - 1)) >> np.uint64(4), follow)
    return out


_BLOCKS = "file int, block int, first long, doc_ids array<long>, lengths array<long>, n_ids long, n_words long, words binary"
_LONGS = pa.list_(pa.int64())
_SCHEMA = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", _LONGS), ("lengths", _LONGS), ("n_ids", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary())])


def _to_blocks(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc = byte_bpe()
    file, block, first = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[list[int], np.ndarray, np.ndarray]] = []  # documents, counts, ids of the open block

    def close() -> pa.RecordBatch:
        nonlocal block, first, held
        docs = [d for h in held for d in h[0]]
        lengths, whole = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        words = simple8b_encode(whole)
        row = {"file": file, "block": block, "first": first, "doc_ids": docs, "lengths": lengths, "n_ids": len(whole), "n_words": len(words), "words": words.astype("<u8").tobytes()}
        block, first, held = block + 1, first + len(whole), []
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    size = 0
    for batch in slices(batches, "text", rows=4096, size=2 << 20):
        ids, counts = with_end(*enc.encode_column(batch.column("text")), end_id)
        docs, ends, at, before = batch.column("doc_id").to_pylist(), np.cumsum(counts), 0, 0
        while at < len(docs):  # to the first document that fills the block
            to = min(int(np.searchsorted(ends, before + BLOCK_IDS - size)) + 1, len(docs))
            held.append((docs[at:to], counts[at:to], ids[before : ends[to - 1]].copy()))
            size += int(ends[to - 1]) - before
            at, before = to, int(ends[to - 1])
            if size >= BLOCK_IDS:
                yield close()
                size = 0
    if held:
        yield close()


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, files: int | None = None) -> None:
    """Encode docs (doc_id, text) and write them, ascending by doc_id, to path.

    A null text is empty (end id only); null ids come first; repeated ids stand side
    by side in no given order, and may lie in several files; other columns are ignored;
    an empty table makes an empty file. A very long text is one block. `files`: range
    partitions, by default one for each FILE_BYTES of text (fewer bytes where cores
    would stay idle)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // (FILE_BYTES >> 4))))
    # the row number splits an id that many rows share
    order = ["doc_id", "_row"]
    ordered = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(lambda it: _to_blocks(it, end_id), _BLOCKS).write.option("compression", "zstd").parquet(path)


def _from_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, lengths, docs = (batch.column(c) for c in ("words", "lengths", "doc_ids"))
        for k, file, first in zip(range(batch.num_rows), batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
            ids = simple8b_decode(np.frombuffer(words[k].as_buffer(), dtype="<u8")).astype("<u4")  # one block at a time, not copied
            sizes = lengths[k].values.to_numpy()
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([file] * len(ends), pa.int32()),
                    "doc_id": docs[k].values,
                    "at": pa.array(ends - sizes + first, pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)], pa.binary()),
                }
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): ids as little-endian unsigned 32-bit bytes; start counts
    the ids of all documents before it over all files. No rows from files of an empty
    table."""
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    # one row a file: at most the writer's number of range partitions
    base = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    rows = blocks.select("file", "first", "doc_ids", "lengths", "words").mapInArrow(_from_blocks, "file int, doc_id long, at long, ids binary")
    return rows.join(F.broadcast(base), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files read back."""
    path = fresh_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    ids = read_token_files(spark, path)
    return ids.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
