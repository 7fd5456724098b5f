"""The most similar vectors of a query set, as matrix products of blocks.

The query set meets all rows, in blocks: as many query vectors as QUERY_BYTES allow are sent
to the tasks at once, and each task keeps the best candidates of a query over its whole
partition, so that a query sends `top` rows a task to be ranked, not one for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that go to every task at once.
QUERY_BYTES = 64 << 20
#: How much a product of blocks may differ from the same score by itself.
SLACK = 1e-9


def _unit(vectors: list, dim: int) -> np.ndarray:
    x = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]


def top_k(rows: DataFrame, queries: DataFrame, top: int, row_id: str = "id", vector: str = "vector") -> DataFrame:
    """(query, row, score, pos) of the `top` rows nearest to each query by cosine in double
    precision, without the row of the query's own id; ties by the SHA-256 of the id as text.

    rows and queries: row_id (long), vector (array). Rows and queries with a null id or vector
    take no part, nor do vectors with a null or non-finite component; a zero vector has
    score 0. Shorter vectors count as padded with zeros."""
    spark = rows.sparkSession
    good = F.col(row_id).isNotNull() & F.coalesce(F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    plain = lambda df: df.filter(good).select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q, r = plain(queries), plain(rows)
    dim, count = q.agg(F.max(F.size("v")), F.count("*")).first()
    dim = max(dim or 0, r.agg(F.max(F.size("v"))).first()[0] or 0)
    schema = "query long, row long, score double"
    if not count:
        return spark.createDataFrame([], schema + ", pos long")
    blocks = -(-count * max(dim, 1) * 8 // QUERY_BYTES)
    found = None
    for block in range(blocks):
        mine = q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect() if blocks > 1 else q.collect()
        if mine:
            held = spark.sparkContext.broadcast((np.array([x.id for x in mine]), _unit([x.v for x in mine], dim)))
            one = r.mapInArrow(lambda it, held=held: _best(it, *held.value, top), schema)
            found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.sha2(F.col("row").cast("string"), 256))
    return found.withColumn("pos", F.row_number().over(best).cast("bigint")).filter(F.col("pos") <= top)


def _best(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """The best rows of this partition by query."""
    n = len(ids)
    who, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for b in batches:
        other, x = b.column("id").to_numpy(), _unit(b.column("v").to_pylist(), q.shape[1])
        for at in range(0, n, 1024):
            near = q[at : at + 1024] @ x.T
            if near.shape[1] > 2 * top:  # what cannot be among the best goes before scores are exact
                least = -np.partition(-near, top, axis=1)[:, top][:, None]
                i, j = np.nonzero(near >= least - SLACK)
            else:
                i, j = np.nonzero(np.ones_like(near, dtype=bool))
            own = ids[at + i] != other[j]
            i, j = at + i[own], j[own]
            who, row = np.concatenate((who, i)), np.concatenate((row, other[j]))
            score = np.concatenate((score, np.add.reduce(q[i] * x[j], axis=1)))
        who, row, score = _kept(who, row, score, top)
    yield pa.RecordBatch.from_pydict({"query": pa.array(ids[who], pa.int64()), "row": pa.array(row, pa.int64()), "score": pa.array(score)})


def _kept(who: np.ndarray, row: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `top` best of each query, ties by the digest of the row's id."""
    order = np.lexsort((-score, who))
    who, row, score = who[order], row[order], score[order]
    start = np.searchsorted(who, who)
    place = np.arange(len(who)) - start
    # the score at the last place that counts; of equal ones the digest decides
    last = np.minimum(start + top - 1, np.searchsorted(who, who, side="right") - 1)
    sure, tied = score > score[last], score == score[last]
    keep = sure.copy()
    for w in np.unique(who[tied & (place >= top)]).tolist() if (tied & (place >= top)).any() else []:
        mine = np.flatnonzero(tied & (who == w))
        left = top - int(sure[who == w].sum())
        digests = sorted(mine.tolist(), key=lambda k: hashlib.sha256(str(row[k]).encode()).hexdigest())
        keep[digests[:left]] = True
        tied[mine] = False
    keep |= tied & (place < top)
    return who[keep], row[keep], score[keep]
