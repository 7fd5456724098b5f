"""Packing: minimum bin slack over windows of fixed capacity.

Each task packs the documents of its own partition. A document's ids beyond whole
windows leave a remainder; remainders form a multiset of lengths. A window opens
with the longest remainder, and a bitset subset-sum over the other lengths finds the
largest sum that still fits; backtracking gives how many of each length it takes,
and the same pattern is used while the counts last. Where a window cannot be filled
exactly, the longest remainder left is cut to fill it. What is left at the end of a
partition is cut at powers of two.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.llm.tokens import with_end, word_bpe

#: Tokens of a window.
CAPACITY = 2048
#: Remainders gathered before they are packed: bounds a task's memory at this many
#: remainders of less than CAPACITY ids.
POOL = 8192
#: Windows that are sent on at once.
WINDOWS = 2048


class Piece(NamedTuple):
    doc_id: int
    start: int
    ids: np.ndarray
    doc_tokens: int


def fullest(lengths: list[int], counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length give the largest sum <= target.

    lengths: ascending, those with a count. Reachable sums are bits of one integer;
    each copy of a length shifts them once; the states before each step are kept for
    the way back."""
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in reversed(lengths[: bisect_right(lengths, target)]):
        for _ in range(min(counts[length], target // length)):
            new = reach | (reach << length) & mask
            if new == reach:
                break
            steps.append((length, reach))
            reach = new
            if reach >> target & 1:
                break
        if reach >> target & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + 1
            total -= length
    return taken


def pack(pieces: list[Piece], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces that do not fill one more."""
    by: dict[int, list[Piece]] = {}
    for p in reversed(pieces):
        by.setdefault(len(p.ids), []).append(p)
    counts, lengths, left = {k: len(v) for k, v in by.items()}, sorted(by), sum(len(p.ids) for p in pieces)
    windows: list[list[Piece]] = []

    def take(length: int) -> Piece:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
            lengths.remove(length)
        return by[length].pop()

    def put(p: Piece) -> None:
        n = len(p.ids)
        if n not in counts:
            counts[n] = 0
            insort(lengths, n)
        counts[n] += 1
        by.setdefault(n, []).append(p)

    while left >= capacity:
        longest = lengths[-1]
        first = take(longest)
        pattern = fullest(lengths, counts, capacity - longest)
        slack = capacity - longest - sum(k * n for k, n in pattern.items())
        put(first)
        whole = pattern | {longest: pattern.get(longest, 0) + 1}
        for _ in range(1 if slack else min(counts[k] // n for k, n in whole.items())):
            window = [take(k) for k, n in whole.items() for _ in range(n)]
            if slack:  # enough is left to fill it: cut the longest
                p = take(lengths[-1])
                window.append(p._replace(ids=p.ids[:slack]))
                if len(p.ids) > slack:
                    put(p._replace(start=p.start + slack, ids=p.ids[slack:]))
                elif len(p.ids) < slack:  # cannot be: the subset sum would have taken it
                    raise AssertionError("a piece that fits was left out")
            windows.append(window)
            left -= capacity
    return windows, [p for k in reversed(lengths) for p in by[k]]


def cut_at_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces of less than a window in all, as windows whose lengths are powers of two."""
    left, out, queue = sum(len(p.ids) for p in pieces), [], list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            p = queue.pop()
            window.append(p._replace(ids=p.ids[:room]))
            if len(p.ids) > room:
                queue.append(p._replace(start=p.start + room, ids=p.ids[room:]))
            room -= len(window[-1].ids)
        out.append(window)
    return out


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack_partition(batches: Iterator[pa.RecordBatch], end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, number, pool = word_bpe(), TaskContext.get().partitionId() << 33, []

    def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
        nonlocal number
        cols: list[list] = [[] for _ in range(7)]
        for w in windows:
            at = 0
            for p in w:
                for c, v in zip(cols, (p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, number, at), strict=True):
                    c.append(v)
                at += len(p.ids)
            number += 1
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    for batch in slices(batches, "text", rows=4096):
        ids, counts = with_end(*enc.encode_column(batch.column("text")), end_id)
        ends, whole = np.cumsum(counts).tolist(), []
        for doc, n, end in zip(batch.column("doc_id").to_pylist(), counts.tolist(), ends, strict=True):
            full, first = n // capacity * capacity, end - n
            whole += [[Piece(doc, at, ids[first + at : first + at + capacity], n)] for at in range(0, full, capacity)]
            if full < n:  # a copy: a view would keep all of the batch's ids
                pool.append(Piece(doc, full, ids[first + full : end].copy(), n))
            if len(whole) >= WINDOWS:
                yield rows(whole)
                whole = []
        if whole:
            yield rows(whole)
        if len(pool) >= POOL:
            windows, pool = pack(pool, capacity)
            for at in range(0, len(windows), WINDOWS):
                yield rows(windows[at : at + WINDOWS])
    windows, rest = pack(pool, capacity)
    enc.release()
    yield rows(windows + cut_at_powers(rest))


def pack_documents(docs: DataFrame, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset. No shuffle.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows
    are packed each; other columns are ignored; an empty table gives no rows. A very
    long text is encoded whole: a task holds its ids, four bytes each, and sends its
    full windows on, WINDOWS at a time."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _pack_partition(it, end_id, capacity), _PIECES)


def with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of each document, with the crc32 of its ids."""
    return with_crc(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
