"""Periodic runs of words by block convolution at dyadic scales.

A run repeats its first q words four times or more. At the scale of L words, which serves
the periods from L to 2L - 1, a text is cut into blocks of L words; a run holds one of
them within its first 2L - 1 words, and that block occurs again q words later. The sum
of squared differences between a block and each stretch of the window behind it is one
convolution, computed exactly by number-theoretic transforms; where it is zero, the
distance is a seed, and a seed that carries on far enough is extended to its run.

Blocks are transformed only where a run can be: each word of the block must occur again
within 2L words, and the block must not lie so deep in a run of a shorter period that
any other period would contradict it. Neither rule can lose a run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, words

#: Times that a run repeats its period, and words that it has, at least.
REPEATS, LEAST = 4, 6
#: Primes p with a power of two of at least 2^24 in p - 1, and a generator.
PRIMES = ((469762049, 3), (167772161, 3), (754974721, 11))
#: Words of a block that is transformed at once (larger scales take the head of their
#: block and more windows), and words of all windows that are transformed together.
LARGEST, TOGETHER = 1 << 16, 1 << 19
_STEP = 0x9E3779B97F4A7C15


@lru_cache(maxsize=128)
def _roots(p: int, generator: int, half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 * half."""
    root = pow(generator, (p - 1) // (2 * half), p)
    out = np.ones(1, dtype=np.uint64)
    step = pow(root, -1, p) if inverse else root
    while len(out) < half:  # the powers so far, then those times the next power
        out = np.concatenate((out, out * np.uint64(pow(step, len(out), p)) % np.uint64(p)))
    return out


def _forward(a: np.ndarray, p: int, generator: int) -> np.ndarray:
    """Transform of each row (a power of two long), in bit-reversed order."""
    rows, size = a.shape
    q, half = np.uint64(p), size // 2
    while half:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        turned = (low + (q - high)) % q * _roots(p, generator, half, False) % q
        v[:, :, 0], v[:, :, 1] = (low + high) % q, turned
        half //= 2
    return a


def _backward(a: np.ndarray, p: int, generator: int) -> np.ndarray:
    """The inverse of _forward."""
    rows, size = a.shape
    q, half = np.uint64(p), 1
    while half < size:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0].copy(), v[:, :, 1] * _roots(p, generator, half, True) % q
        v[:, :, 0], v[:, :, 1] = (low + high) % q, (low + (q - high)) % q
        half *= 2
    return a * np.uint64(pow(size, -1, p)) % q


def occurrences(ids: np.ndarray, starts: np.ndarray, block: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance): where a block of `block` ids (a power of two) occurs again
    `distance` ids later, for distances from low to low + block - 1.

    The sum of squared differences is found modulo as many primes as its bound needs: it
    is zero if and only if it is zero modulo each."""
    none = int(ids.max(initial=0)) + 1  # stands behind the end, equal to nothing
    padded = np.concatenate((ids, np.full(low + 2 * block, none, dtype=ids.dtype))).astype(np.uint64)
    bound, product, primes = block * none * none, 1, []
    for prime in PRIMES:
        if product <= bound:
            primes.append(prime)
            product *= prime[0]
    out_s, out_d = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    together = max(1, TOGETHER // (2 * block))
    for k in range(0, len(starts), together):
        at = starts[k : k + together]
        x = padded[at[:, None] + np.arange(block)]
        y = padded[at[:, None] + (low + np.arange(2 * block - 1))]
        zero = np.ones((len(at), block), dtype=bool)
        for p, generator in primes:
            q = np.uint64(p)
            a, b = np.zeros((len(at), 2 * block), dtype=np.uint64), np.zeros((len(at), 2 * block), dtype=np.uint64)
            a[:, :block], b[:, : 2 * block - 1] = x[:, ::-1] % q, y % q
            own = (a * a % q).sum(1, dtype=np.uint64) % q
            before = np.zeros((len(at), 2 * block), dtype=np.uint64)
            np.cumsum(b[:, :-1] * b[:, :-1] % q, axis=1, out=before[:, 1:])
            theirs = (before[:, block:] - before[:, :block]) % q
            # the distance low + j stands at block - 1 + j: what wraps around stays before
            cross = _backward(_forward(a, p, generator) * _forward(b, p, generator) % q, p, generator)[:, block - 1 : 2 * block - 1]
            zero &= (own[:, None] + theirs) % q == 2 * cross % q
        i, j = np.nonzero(zero)
        out_s.append(at[i])
        out_d.append(low + j)
    return np.concatenate(out_s), np.concatenate(out_d)


def _reach(ids: np.ndarray, i: int, d: int, step: int) -> int:
    """How many places from i on, in the direction of step, equal the id d later."""
    n, total, size = len(ids), 0, 64
    while True:
        if step > 0:
            size = min(size, n - d - i - total)
            a, b = ids[i + total : i + total + size], ids[i + total + d : i + total + size + d]
        else:
            size = min(size, i + 1 - total)
            a, b = ids[i + 1 - total - size : i + 1 - total][::-1], ids[i + 1 - total - size + d : i + 1 - total + d][::-1]
        if size <= 0:
            return total
        differ = np.flatnonzero(a != b)
        if len(differ):
            return total + int(differ[0])
        total, size = total + size, 2 * size


def find_runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ids (dense numbers from 0), by start, then
    period. longest: no run is longer (of several texts joined, the longest one, with a
    number of its own between two texts)."""
    n = len(ids)
    longest = n if longest is None else longest
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    gap = np.full(n, n + 1, dtype=np.int64)  # to the same word's next place
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    power = np.empty(n + 1, dtype=np.uint64)
    power[0] = 1
    power[1:] = np.uint64(_STEP)
    np.multiply.accumulate(power, out=power)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((mixed ^ (mixed >> np.uint64(32))) * power[:-1], out=prefix[1:])
    found: set[tuple[int, int, int]] = set()
    size = 1
    while (REPEATS - 1) * size + 1 <= longest:
        m = max(0, -(-(n - (REPEATS - 1) * size) // size))
        blocks = gap[: m * size].reshape(m, size).max(1) < 2 * size
        if found:
            a, length, period = np.array(sorted(found)).T
            first, last = -(-a // size), (a + length - period - 2 * size) // size
            deep = (last >= first) & (first < m)
            edge = np.zeros(m + 1, dtype=np.int64)
            np.add.at(edge, first[deep], 1)
            np.add.at(edge, np.minimum(last[deep] + 1, m), -1)
            blocks &= np.cumsum(edge)[:m] == 0
        starts = np.flatnonzero(blocks) * size
        if len(starts):
            block = min(size, LARGEST)
            seeds = [occurrences(ids, starts, block, low) for low in range(size, 2 * size, block)]
            s, d = np.concatenate([x[0] for x in seeds]), np.concatenate([x[1] for x in seeds])
            # a run goes on for so many places at least
            need = (REPEATS - 1) * d - size + 1
            fits = s + d + need <= n
            s, d, need = s[fits], d[fits], need[fits]
            alike = (prefix[s + need] - prefix[s]) * power[d] == prefix[s + d + need] - prefix[s + d]
            s, d = s[alike], d[alike]
            # of the blocks of a run the first stands for it
            key = d * (n + 1) + s
            first = ~np.isin(key - size, key)
            for i, q in zip(s[first].tolist(), d[first].tolist(), strict=True):
                start = i - _reach(ids, i - 1, q, -1)
                length = i + _reach(ids, i, q, 1) + q - start
                if length >= max(LEAST, REPEATS * q):
                    found.add((start, length, q))
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        number: defaultdict[object, int] = defaultdict(count().__next__)
        ids, bounds = [], [0]
        for k, t in enumerate(texts):
            ids.extend(map(number.__getitem__, t))
            ids.append(number[k])  # between two texts
            bounds.append(len(ids))
        all_runs = find_runs(np.array(ids, dtype=np.int64), max(map(len, texts)))
        text = np.searchsorted(np.array(bounds), [r[0] for r in all_runs], side="right") - 1
        runs: list[list[dict]] = [[] for _ in texts]
        for k, (start, length, period) in zip(text.tolist(), all_runs, strict=True):
            runs[k].append({"start": start - bounds[k], "length": length, "period": period})
        for k in {*text.tolist()}:
            keep = np.ones(len(texts[k]), dtype=bool)
            for r in runs[k]:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            texts[k] = [w for w, stays in zip(texts[k], keep.tolist(), strict=True) if stays]
        kept = pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, _RUNS), kept], names=["doc_id", "runs", "collapsed"])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of docs (doc_id, text). runs: every maximal
    stretch of words with smallest period q, of at least LEAST words and REPEATS * q, as
    (start, length, period), by start, then period. collapsed: the words that no run holds
    behind its first q words, joined by single spaces.

    A null, empty or blank text has no run and collapses to the empty text; repeated rows
    each give a row, null ids too; other columns are ignored; an empty table gives no
    rows. No row meets another: a text takes some 150 bytes of a task for each of its
    words, and n log(n)^2 steps at most."""
    return docs.select("doc_id", "text").mapInArrow(_run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_runs, the run of greatest exponent, and digests of runs and collapsed text of each
    document; a tenth of the documents is made periodic first, as the contract says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("h", hashed).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    docs = docs.withColumn("n", F.size("w").cast("bigint")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    docs = docs.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    again = F.flatten(F.array_repeat(F.expr("slice(w, int(a + 1), int(p))"), F.expr("int((n - a - 1) div p + 1)")))
    made = F.concat(F.expr("slice(w, 1, int(a))"), F.slice(again, F.lit(1), F.expr("int(n - a)")))
    docs = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
    out = periodic_runs(docs)
    # of equal exponents the first stays
    higher = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    out = out.withColumn("best", F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), higher)))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
