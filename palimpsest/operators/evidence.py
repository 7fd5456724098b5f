"""What a run leaves as evidence: summaries, rows, denominators, and texts that are released
only where an audit stands for them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_summaries(runs: DataFrame, run: str, calls: DataFrame, answers: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a run: its answer and class, what its calls were and took, and how its memory
    ended. Nothing is averaged or compared over runs; a run without calls, answer or
    memory has nulls there.

    calls: run, accepted (boolean), seconds. answers: run, answer, label. sizes: run, at, entries,
    size (a row for each change, as memory.state_sizes gives them)."""
    called = calls.groupBy(run).agg(F.count("*").alias("logical_calls"), F.count_if("accepted").alias("accepted_calls"), F.sum("seconds").alias("seconds"))
    ended = sizes.groupBy(run).agg(F.max_by("entries", "at").alias("entries"), F.max_by("size", "at").alias("size"), F.max("size").alias("largest"), F.count("*").alias("changes"))
    out = runs.select(run).distinct().join(answers.select(run, "answer", "label"), run, "left")
    return out.join(called, run, "left").join(ended, run, "left")


def evidence_rows(records: DataFrame, keep: Mapping[str, Column]) -> DataFrame:
    """The named columns of each record with a digest of their canonical JSON, so that a row can
    be told from any other, and from itself changed. Columns come in the order of names."""
    made = records.select(*[c.alias(n) for n, c in sorted(keep.items())])
    return made.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*made.columns), {"ignoreNullFields": "false"}), 256))


def denominators(cases: DataFrame, group: str, kind: str, source: str, counted: Mapping[str, tuple[str, ...]], sources: tuple[str, ...]) -> DataFrame:
    """(group, measure, n, left_out) of each measure: cases of the kinds that it counts, decided
    by one of the sources; all others are left out of it, and that is said. A null kind or
    source is left out."""
    by = cases.filter(F.col(group).isNotNull())
    inside = lambda kinds: F.coalesce(F.col(kind).isin(*kinds) & F.col(source).isin(*sources), F.lit(False))
    each = F.array(*[F.struct(F.lit(m).alias("measure"), inside(kinds).alias("yes")) for m, kinds in counted.items()])
    rows = by.select(group, F.explode(each).alias("m"))
    return rows.groupBy(group, F.col("m.measure").alias("measure")).agg(F.count_if("m.yes").alias("n"), F.count_if(~F.col("m.yes")).alias("left_out"))


def release(texts: DataFrame, audits: DataFrame, key: str, verdict: Column, eligible: str = "ELIGIBLE") -> DataFrame:
    """(key, text, status) with the texts of eligible audits alone. An audit binds the text that
    it judged by its digest and states its verdict; verdict derives it anew from the
    audit's own columns. status: released; no_audit, unbound (the text is not the one that
    was judged), restated (the verdict does not follow), repeated (two audits of a key), or
    the verdict. A text that is not released is null."""
    stated = audits.withColumn("_derived", verdict).groupBy(key).agg(
        F.count("*").alias("_n"), F.first("text_sha256").alias("_sha"), F.first("verdict").alias("_stated"), F.first("_derived").alias("_derived")
    )
    both = texts.select(key, "text").join(stated, key, "left")
    status = (
        F.when(F.col("_n").isNull(), "no_audit").when(F.col("_n") > 1, "repeated").when(~F.sha2("text", 256).eqNullSafe(F.col("_sha")), "unbound")
        .when(~F.col("_stated").eqNullSafe(F.col("_derived")), "restated").when(F.col("_stated") == eligible, "released").otherwise(F.coalesce("_stated", F.lit("no_audit")))
    )
    return both.withColumn("status", status).select(key, F.when(F.col("status") == "released", F.col("text")).alias("text"), "status")


def under_protocol(records: DataFrame, version: str, protocols: Mapping[str, Column], value: str) -> DataFrame:
    """records with `value` computed as the protocol of each record's own version says. A version
    that no protocol is known for fails the plan: old evidence is read by the rules that it
    was made under, or not at all."""
    out = None
    for name, column in protocols.items():
        out = F.when(F.col(version) == name, column) if out is None else out.when(F.col(version) == name, column)
    message = F.concat(F.lit("no protocol of version "), F.coalesce(F.col(version).cast("string"), F.lit("null")))
    kind = records.select(next(iter(protocols.values())).alias("v")).schema["v"].dataType
    return records.withColumn(value, out.otherwise(F.raise_error(message).cast(kind)))
