"""Helpers that the training-data operators share: the cluster's shared folder,
skew-proof group minima, connected components, and batch slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"
#: Bits of a filter of ids (2 MB), and values of an array that meet in one row before the
#: rows meet.
FILTER_BITS, SLICE = 1 << 24, 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the one that setCheckpointDir has
    set. Where there is none, a temporary folder in local mode alone (tests on one
    machine); on a cluster executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        named = str(spark.sparkContext.getCheckpointDir())
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts the
    lineage, and a lost executor costs no recomputation."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def dense(rows: DataFrame, size: int, *values: str) -> DataFrame:
    """One row of one array a value, by slot 0 to size - 1; 0 where rows has no such slot."""
    zero = rows.sparkSession.range(size).select(F.col("id").alias("slot"), *[F.lit(0).cast(rows.schema[v].dataType).alias(v) for v in values])
    every = rows.unionByName(zero).groupBy("slot").agg(*[F.sum(v).alias(v) for v in values])
    field = lambda v: lambda x: x[v]
    part = F.array_sort(F.collect_list(F.struct("slot", *values)))
    parts = every.groupBy((F.col("slot") / SLICE).cast("bigint").alias("part")).agg(*[F.transform(part, field(v)).alias(v) for v in values])
    whole = F.array_sort(F.collect_list(F.struct("part", *values)))
    return parts.agg(*[F.flatten(F.transform(whole, field(v))).alias(v) for v in values])


def perhaps_in(ids: DataFrame, column: str) -> Column:
    """Whether a column of that name may be among ids: true for all that are, and for few
    others, by FILTER_BITS bits. A fuller filter lets more pass, so it may only spare work."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    marks = ids.select((bit / 64).cast("bigint").alias("slot"), (bit % 64).cast("int").alias("at")).distinct()
    # each bit once: their sum is their union
    filled = stage(dense(marks.select("slot", F.expr("shiftleft(1L, at)").alias("bits")), FILTER_BITS // 64, "bits"), "filter")
    held = F.get(filled.select("bits").scalar(), (bit / 64).cast("int"))
    return F.coalesce(F.getbit(held, (bit % 64).cast("int")) == 1, F.lit(False))


def group_back(df: DataFrame, key: str, part: Column, whole: Callable[[Column], Column], name: str, salts: int = 64) -> DataFrame:
    """df with an aggregate over all rows of the same key, as column name: part over
    the rows of a (key, salt), whole over a key's parts.

    No task gets a whole group: rows meet on (key, salt), at most `salts` parts of a
    key are combined, and the value goes back to each salt in use."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    parts = salted.groupBy(key, "_salt").agg(part.alias("_m"))
    total = parts.groupBy(key).agg(whole(F.col("_m")).alias(name), F.collect_set("_salt").alias("_salts"))
    back = total.select(key, name, F.explode("_salts").alias("_salt"))
    return salted.join(back.hint("merge"), [key, "_salt"]).drop("_salt")


def group_min_back(df: DataFrame, key: str, value: Column, name: str, salts: int = 64) -> DataFrame:
    """group_back for the minimum of value."""
    return group_back(df, key, F.min(value), F.min, name, salts)


def sliced(df: DataFrame, name: str, *order: Column, rows: int = 1 << 16) -> DataFrame:
    """df as a staged table with `_slice`: stretches of the order of about `rows` rows,
    numbered in that order."""
    count = max(1, -(-df.count() // rows))
    cut = df.repartitionByRange(count, *order) if count > 1 else df.coalesce(1)
    return stage(cut.withColumn("_slice", F.spark_partition_id()), name)


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], slice: str = "_slice") -> DataFrame:
    """df with sums over the rows before each row of its key, in order, by name.

    `slice` cuts a key's rows into stretches that follow each other: no task gets more of
    a key than one slice, and of each slice one row is summed up over all slices. Keys
    and slices are not null."""
    local = Window.partitionBy(*by, slice).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy(slice).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*by, slice).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    base = parts.select(*by, slice, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    within = df.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(n) for n, v in sums.items()])
    whole = [(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums]
    return within.join(base, [*by, slice]).select(*df.columns, *whole)


def _is_forest(cur: DataFrame) -> bool:
    """Whether each node of edges (u, v) that points at another has one edge, to a node that
    points at none: then every v is its component's smallest node."""
    ends = cur.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        cur.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return each.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), by
    alternating large-star and small-star steps until all components are stars.

    Nodes without an edge do not appear, nor does what only links with itself; a null end is
    no link; repeated edges count once; no edges give no rows. Each half step is a salted group minimum,
    so a hub with a third of all edges is spread over tasks; every round is written
    to the shared folder; rounds halve depth, so few are needed at any size, and none where
    the edges are stars already."""
    cur = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges"
    )
    while not _is_forest(cur):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # an edge that comes twice here is left out behind the small star
        large = group_min_back(both, "u", F.least("u", "v"), "m").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v")
        small = group_min_back(large, "u", F.least("u", "v"), "m")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        cur = stage(nxt.filter("u != v").distinct(), "edges")
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows and about `size` bytes of a text
    column (one row at least), so a task's Python memory stays bounded."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        while at < n:
            end, total = at, 0
            while end < n and end - at < rows and (end == at or total + sizes[end] <= size):
                total += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file: the installed package, or the folder in
    the environment variable TOKENIZER_DIR."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
