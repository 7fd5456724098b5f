"""Versioned state: an event stream as keyed memory under three policies.

append (every candidate is an entry), upsert (a key's entry takes each candidate),
upsert with no-op (a reaffirmed value leaves text and update time alone). Entries are
never deleted and an update is valid once its target is born, so no state is carried
from row to row: every policy is a window and an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_id(index: Column) -> Column:
    return F.format_string("mem_%04d", index)


def indexed(events: DataFrame, run: str, value: str, ts: str, tie: str) -> DataFrame:
    """events with idx (1.. in each run), prev and changed (null-safe; the first is a change)."""
    order = Window.partitionBy(run).orderBy(ts, tie)
    df = events.withColumn("idx", F.row_number().over(order).cast("bigint")).withColumn("prev", F.lag(value).over(order))
    return df.withColumn("changed", (F.col("idx") == 1) | ~F.col(value).eqNullSafe(F.col("prev")))


def append(idx: DataFrame, run: str, value: str, ts: str) -> DataFrame:
    return idx.select(run, entry_id(F.col("idx")).alias("entry_id"), F.col(ts).alias("created"), F.col(ts).alias("updated"), F.col(value).alias("text"))


def upsert(idx: DataFrame, run: str, value: str, ts: str) -> DataFrame:
    return idx.groupBy(run).agg(F.min(ts).alias("created"), F.max(ts).alias("updated"), F.max_by(value, "idx").alias("text"))


def upsert_noop(idx: DataFrame, run: str, value: str, ts: str) -> DataFrame:
    """The same over change points: what repeats the current value does nothing."""
    return idx.groupBy(run).agg(F.min(ts).alias("created"), F.max(F.when(F.col("changed"), F.col(ts))).alias("updated"), F.max_by(value, "idx").alias("text"))


def execute(initial: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memory, executed, errors) of recorded decisions.

    initial: run, entry_id, idx, text. decisions: run, idx, entry_id (reserved), op
    (Add, Update, Noop or invalid), target, text. An update runs if its target was
    born before it, else it is a target error; an add never fails."""
    adds = decisions.filter("op = 'Add'").select("run", "entry_id", "idx", "text")
    births = initial.select("run", "entry_id", "idx", "text").unionByName(adds)
    updates = decisions.filter("op = 'Update'")
    born = births.select("run", F.col("entry_id").alias("target"), F.col("idx").alias("born"))
    joined = updates.join(born, ["run", "target"], "left")
    valid = F.coalesce(F.col("born") < F.col("idx"), F.lit(False))
    executed, errors = joined.filter(valid).drop("born"), joined.filter(~valid).drop("born")
    last = executed.groupBy("run", F.col("target").alias("entry_id")).agg(F.max("idx").alias("updated_idx"), F.max_by("text", "idx").alias("new_text"))
    memory = births.join(last, ["run", "entry_id"], "left").select(
        "run", "entry_id", F.col("idx").alias("created_idx"), F.coalesce("updated_idx", "idx").alias("updated_idx"), F.coalesce("new_text", "text").alias("text")
    )
    return memory, executed, errors


def versions(events: DataFrame, run: str, key: str, value: str, order: str) -> DataFrame:
    """(run, key, value, created, since, until) of a keyed state along a run: a row for each
    change of a key's value, which holds from the event `since` up to the one before
    `until` (null: to the end). created is the key's first event.

    The state after any event is the rows with since <= event < until: states are joined,
    not stored, so their size is that of the changes, however long a run is. order is unique
    in a run."""
    by = Window.partitionBy(run, key).orderBy(order)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1), F.lit(True))
    df = events.select(run, key, value, order, changed.alias("_c"), F.min(order).over(Window.partitionBy(run, key)).alias("created")).filter("_c")
    return df.select(run, key, value, "created", F.col(order).alias("since"), F.lead(order).over(by).alias("until"))


def state_at(states: DataFrame, probes: DataFrame, run: str, at: str, key: str = "key") -> DataFrame:
    """probes' columns with (key, value, created, since) of each entry of the state after the
    event `at` of its run; the ranges of a key do not overlap.

    A probe meets the keys of its run that are born, not their changes: it is sorted in among
    the changes of each and takes the last one before it, if that still holds. So the work is
    that of sorting the changes and the result's rows."""
    held, asked = [c for c in states.columns if c not in (run, key)], probes.columns
    changes = states.filter(F.col("since").isNotNull())
    born = changes.groupBy(run, key).agg(F.min("since").alias("_born"))
    probe = F.struct(*asked).alias("_p")
    wanted = probes.join(born, run).filter(F.col("_born") <= F.col(at)).select(run, key, F.col(at).alias("_at"), probe)
    both = changes.select(run, key, F.col("since").alias("_at"), F.struct(*held).alias("_s")).unionByName(wanted, allowMissingColumns=True)
    by = Window.partitionBy(run, key).orderBy("_at", F.col("_p").isNotNull(), F.col("_s.until").asc_nulls_last())
    last = both.withColumn("_s", F.last("_s", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("_p is not null")
    inside = last.filter(F.col("_s.until").isNull() | (F.col("_at") < F.col("_s.until")))
    return inside.select(*[F.col("_p")[c].alias(c) for c in asked], key, *[F.col("_s")[c].alias(c) for c in held if c != "until"])


def state_sizes(states: DataFrame, run: str, size: Column, at: str = "at") -> DataFrame:
    """(run, at, entries, size) after each event that changes a run's state: running sums of
    what its rows add when they come and take away when they end."""
    sized = states.withColumn("_s", size)
    born = sized.select(run, F.col("since").alias(at), F.when(F.col("since") == F.col("created"), 1).otherwise(0).alias("e"), F.col("_s").alias("s"))
    ended = sized.filter("until is not null").select(run, F.col("until").alias(at), F.lit(0).alias("e"), (-F.col("_s")).alias("s"))
    steps = born.unionByName(ended).groupBy(run, at).agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    run_order = Window.partitionBy(run).orderBy(at)
    return steps.select(run, at, F.sum("e").over(run_order).alias("entries"), F.sum("s").over(run_order).alias("size"))
