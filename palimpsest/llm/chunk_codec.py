"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes chooses chunk ends among its single spaces and
line ends, so a passage that documents share falls into the same chunks. A worker
encodes each distinct chunk once. At each join the last word before and the first
word after it are encoded together; where that disagrees with the two apart, the
window widens until both sides agree, at last to both chunks whole.

Chunks are shared within a worker, whose memory of them is bounded: sending every
chunk through a shuffle to share it over all documents would move more bytes than
the whole input, at less gain than the encoding costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.llm.tokens import word_bpe

#: Bytes under the rolling hash; one space in MASK + 1 ends a chunk on average.
WINDOW, MASK = 16, 31
#: Characters of chunks, and joins, that a worker remembers.
CHUNK_CHARS, JOINS = 48_000_000, 300_000

# a fixed pseudo-random value for each byte
_GEAR = np.random.default_rng(20_240_101).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def chunks(text: str, window: int = WINDOW, mask: int = MASK) -> list[str]:
    """The text cut after chosen single spaces or line ends; joined they are the text.
    A chunk's end depends on the `window` bytes up to it alone."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(raw) < 2 * window:
        return [text]
    values, rolled = _GEAR[raw], np.zeros(len(raw), dtype=np.uint32)
    for j in range(window):
        rolled[j:] += values[: len(raw) - j] << np.uint32(j)
    space = (raw == 32) | (raw == 10)
    alone = space.copy()
    alone[1:] &= ~space[:-1]
    alone[:-1] &= ~space[1:]
    ends = np.flatnonzero(alone & ((rolled >> np.uint32(16) & np.uint32(mask)) == 0)) + 1
    data, cut = raw.tobytes(), [0, *ends.tolist(), len(raw)]
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(cut, cut[1:]) if a < b]


class ChunkEncoder:
    """encode(texts): ids equal to the tokenizer's on each whole text."""

    def __init__(self):
        self.pieces, self.tok = word_bpe(), word_bpe().tok
        self.known, self.size, self.joins = {}, 0, {}

    def _window(self, a: str, b: str, words: int) -> tuple[str, str]:
        """The last words of a and the first of b, or all where there are fewer."""
        left = a.rstrip().rsplit(" ", words)
        tail = a[len(left[0]) :] if len(left) > words else a
        right = b.split(" ", words)
        head = b[: len(b) - len(right[-1])] if len(right) > words else b
        return tail, head

    def settle(self, pairs: set[tuple[str, str]]) -> dict[tuple[str, str], bool]:
        """Whether the ids of a and b apart are those of a and b together, for each pair.

        The windows of all pairs are encoded in one call; pairs that disagree go on with
        wider windows, at last with both chunks whole."""
        out, open_pairs, words = {}, list(pairs), 1
        if len(self.joins) >= JOINS:
            self.joins.clear()
        while open_pairs:
            windows = [self._window(a, b, words) for a, b in open_pairs]
            new = [w for w in dict.fromkeys(windows) if w not in self.joins]
            coded = self.pieces.encode([t for a, b in new for t in (a, b, a + b)])
            for k, w in enumerate(new):
                self.joins[w] = np.array_equal(np.concatenate((coded[3 * k], coded[3 * k + 1])), coded[3 * k + 2])
            wider = []
            for pair, window in zip(open_pairs, windows, strict=True):
                if self.joins[window] or window == pair:
                    out[pair] = self.joins[window]
                else:
                    wider.append(pair)
            open_pairs, words = wider, words * 4
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [chunks(t) for t in texts]
        if self.size > CHUNK_CHARS:
            self.known, self.size = {}, 0
        new = [c for c in {c for x in cut for c in x} if c not in self.known]
        self.known.update(zip(new, self.pieces.encode(new), strict=True))
        self.size += sum(map(len, new))
        agree = self.settle({pair for x in cut for pair in zip(x, x[1:])})
        out = []
        for x in cut:
            joined, ids = [x[0]], [self.known[x[0]]]
            for before, c in zip(x, x[1:]):
                # a repaired chunk ends as its last chunk does, but its join is held anew
                if agree[before, c] if joined[-1] is before else self.settle({(joined[-1], c)})[joined[-1], c]:
                    joined.append(c)
                    ids.append(self.known[c])
                else:  # repair: the two chunks as one, which the chunks before must agree with
                    joined[-1] += c
                    ids[-1] = self.whole(joined[-1])
                    while len(joined) > 1 and not self.settle({(joined[-2], joined[-1])})[joined[-2], joined[-1]]:
                        joined[-2:] = [joined[-2] + joined[-1]]
                        ids[-2:] = [self.whole(joined[-1])]
            out.append(np.concatenate(ids))
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=1)
def _encoder() -> ChunkEncoder:
    return ChunkEncoder()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = _encoder()
    for batch in slices(batches, "text", rows=256):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = enc.encode(texts)
        decoded = enc.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), "decoded": pa.array(decoded, pa.string())}
        )


def encode_decode(docs: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row of docs (doc_id, text).

    A null or empty text has no ids and decodes to the empty text; repeated rows each
    give a row; other columns are ignored."""
    return docs.select("doc_id", "text").mapInArrow(_run, "doc_id long, ids array<int>, decoded string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of ids, and digests of ids and decoded text, of each document, by
    encode_decode()."""
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
