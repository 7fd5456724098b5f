"""Context selection under a token budget, for counters that do not add up.

Every proposed context is counted whole, so selection is no running sum: rows of a key
stream through a task in order, and the growing context is measured at each row until one
exceeds the budget. What stays in memory is the admitted context, which the budget
bounds, not the key's rows; those behind the first overflow are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Counts a context, given as the list of its units in order.
Measure = Callable[[list], int]


def growing(units: DataFrame, key: str, order: str, content: str, measure: Measure, newest_first: bool, budget: int | None = None, whole: bool = False) -> DataFrame:
    """(key, order, units, used) of the contexts that grow unit by unit: units counts from 1,
    used is the measure of the first of them, in the order of `order` if newest_first (the last
    units of a key), else in the order in which they come. whole: of all units alone.

    With a budget a key ends at the first context that exceeds it, which is still given.
    order is unique in a key and not null. content is a text or an array of (role, content)
    messages; a null counts as empty."""
    nested = isinstance(units.schema[content].dataType, ArrayType)
    plain = units.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(content).alias("content"))
    by = F.col("order").desc() if newest_first else F.col("order").asc()
    schema = StructType().add("key", units.schema[key].dataType).add("order", units.schema[order].dataType).add("units", "long").add("used", "long")

    def used(context: list) -> int:
        if not nested:
            return measure([x or "" for x in context])
        return measure([(m["role"] or "", m["content"] or "") for x in context for m in x or []])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[dict]:
            for b in batches:
                types[:] = [b.schema.field("key").type, b.schema.field("order").type, pa.int64(), pa.int64()]
                yield from b.to_pylist()

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=schema.names)
            out.clear()
            return made

        out: list[tuple] = []
        for k, group in groupby(rows(), key=lambda r: r["key"]):
            context, ended, pos = [], False, 0
            for pos, r in enumerate(group, 1):
                if ended:
                    continue
                context = [r["content"], *context] if newest_first else [*context, r["content"]]
                if not whole:
                    out.append((k, r["order"], pos, used(context)))
                    ended = budget is not None and out[-1][3] > budget
            if whole:
                out.append((k, r["order"], pos, used(context)))
            if len(out) > 10_000:
                yield table()
        if out:
            yield table()

    sent = plain.repartition("key").sortWithinPartitions("key", by)
    return sent.mapInArrow(run, schema).toDF(key, order, "units", "used")


def _summary(grown: DataFrame, budget: int, first: Callable[[Column], Column]) -> DataFrame:
    key, fits = grown.columns[0], F.col("used") <= budget
    return grown.toDF(key, "order", "units", "used").groupBy(key).agg(
        F.count_if(fits).alias("admitted"), F.coalesce(F.max_by(F.when(fits, F.col("used")), F.when(fits, F.col("units"))), F.lit(0)).cast("bigint").alias("used"),
        first(F.when(fits, F.col("order"))).alias("last_admitted"), (F.count_if(fits) == 0).alias("overflow"),
    )


def select_window(units: DataFrame, key: str, order: str, content: str, measure: Measure, budget: int) -> DataFrame:
    """(key, admitted, used, last_admitted, overflow): the newest units of each key, as many as
    fit. Each longer suffix is counted whole; the first that exceeds the budget ends the
    window, without skipping a unit. overflow: not even the newest fits."""
    return _summary(growing(units, key, order, content, measure, True, budget), budget, F.min)


def required_budget(units: DataFrame, key: str, order: str, content: str, measure: Measure, required: Column, least: int = 1) -> DataFrame:
    """(key, required): the smallest budget at which select_window keeps every required unit:
    the largest count among the suffixes up to the one that begins with the oldest of them,
    since each shorter one must fit as well. Null for a key with fewer than `least` of them."""
    marks = units.select(key, F.col(order).alias("_at"), required.alias("_r")).groupBy(key).agg(F.min(F.when(F.col("_r"), F.col("_at"))).alias("_from"), F.count_if("_r").alias("_n"))
    needed = marks.filter(F.col("_n") >= least)
    wanted = units.join(needed, key).filter(F.col(order) >= F.col("_from")).select(key, order, content)
    largest = growing(wanted, key, order, content, measure, True).groupBy(key).agg(F.max("used").alias("required"))
    return marks.select(key).join(largest, key, "left")


def admit_prefix(ranked: DataFrame, key: str, pos: str, content: str, measure: Measure, budget: int, top: int) -> DataFrame:
    """(key, admitted, used, last_admitted, overflow): of the `top` best entries of each key the
    longest prefix in rank order whose contexts all fit."""
    grown = growing(ranked.filter(F.col(pos) <= top), key, pos, content, measure, False, budget)
    return _summary(grown, budget, F.max)


def measured(entries: DataFrame, key: str, order: str, content: str, measure: Measure) -> DataFrame:
    """(key, n, used) of whole contexts: all entries of a key in the order of `order`. After an
    admission it tells whether the same entries still fit in another order."""
    return growing(entries, key, order, content, measure, False, whole=True).select(key, F.col("units").alias("n"), "used")
