"""Upsert with no-op as a stream: the same result as the batch aggregate.

A file stream of events is folded micro-batch by micro-batch: each batch's per-key
partial (first time, last change, last value) is merged with what the state holds of those
keys. A batch writes the keys that it has touched and no others; the state is the last row
of each key. Events of a key must not arrive before older ones of an earlier batch
are in; a late event counts in the batch in which it arrives.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import memory
from palimpsest.sources.shared import fresh_folder


def stream_upsert_noop(spark: SparkSession, path: str, run: str = "user_id", value: str = "event_type", ts: str = "ts", tie: str = "event_id", base: str | None = None) -> DataFrame:
    """Read every file of path (one file, or a folder of them) that has not been read yet,
    and return the final memory.

    base: the folder of offsets and state. A later run with the same base goes on where
    the last one ended: the keys of each batch are a partition of their own, by batch number,
    so a batch that is run again writes the same partition from the same rows. Without any
    event the memory is empty."""
    base = base or fresh_folder(spark, "stream")
    given = spark.read.parquet(path)

    def state(before: int | None = None) -> DataFrame | None:
        """The last row of each key, or the last one that was written before a batch."""
        try:
            every = spark.read.option("basePath", f"{base}/state").parquet(f"{base}/state")
        except AnalysisException:  # no batch so far
            return None
        every = every if before is None else every.filter(F.col("batch") < F.lit(before))
        return every.groupBy(run).agg(F.max_by(F.struct("created", "updated", "text"), "batch").alias("s")).select(run, "s.*")

    def fold(batch: DataFrame, number: int) -> None:
        """The batch's keys with what is held of them, older first, through the batch
        definition."""
        new = batch.select(run, value, ts, tie, F.lit(None).cast(given.schema[ts].dataType).alias("created"))
        if number and (held := state(number)) is not None:
            keys = batch.select(F.col(run).alias("_run")).distinct()
            held = held.join(keys, F.col(run).eqNullSafe(F.col("_run")), "left_semi")
            old = held.select(run, F.col("text").alias(value), F.col("updated").alias(ts), F.lit(None).cast(given.schema[tie].dataType).alias(tie), "created")
            new = old.unionByName(new)
        out = memory.upsert_noop(memory.indexed(new, run, value, ts, tie), run, value, ts)
        created = new.groupBy(run).agg(F.min(F.coalesce("created", ts)).alias("created"))
        out.drop("created").join(created, run).write.mode("overwrite").parquet(f"{base}/state/batch={number}")

    source = spark.readStream.schema(given.schema)
    files = [f.rstrip("/").rpartition("/")[2] for f in given.inputFiles()]
    folder, _, name = path.rstrip("/").rpartition("/")
    # the stream reads a folder: a table that is one file is matched by its name there
    source = source.option("pathGlobFilter", name).parquet(folder) if files == [name] else source.parquet(path)
    stream = source.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    stream.awaitTermination()
    done = state()
    if done is None:
        done = memory.upsert_noop(memory.indexed(given.limit(0), run, value, ts, tie), run, value, ts)
    return done.select(run, "created", "updated", "text")
