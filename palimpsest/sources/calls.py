"""Archived calls against their plan: files are listed and held against the plan before any
is read, and a plan that is not met exactly is not read at all.

A call's file lies at <root>/<slot columns as name=value folders>/<file>; a slot of the plan has
exactly one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.checks import CheckFailed
from palimpsest.sources.evidence import relative_path


def listing(spark: SparkSession, root: str, *slot: str) -> DataFrame:
    """(slot columns as text, path, bytes) of the files below root. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(relative_path(spark, root, F.col("path")).alias("path"), F.col("length").alias("bytes"))
    # folder names have special characters encoded by Spark's writer
    named = lambda c: F.nullif(F.url_decode(F.replace(F.regexp_extract("path", f"(?:^|/){c}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))), F.lit(""))
    return files.select(*[named(c).alias(c) for c in slot], "path", "bytes")


def plan_findings(listed: DataFrame, plan: DataFrame, *slot: str) -> DataFrame:
    """(slot columns, files, finding) of slots that are not met: missing (planned, without a
    file), double (with more than one), unplanned (files without a slot), repeated (a slot
    that the plan has twice)."""
    text = [F.col(c).cast("string").alias(c) for c in slot]
    planned = plan.select(*text).groupBy(*slot).agg(F.count("*").alias("_planned"))
    there = listed.groupBy(*slot).agg(F.count("*").alias("files"))
    same = [planned[c].eqNullSafe(there[c]) for c in slot]
    both = planned.join(there, same, "full").select(*[F.coalesce(planned[c], there[c]).alias(c) for c in slot], "_planned", F.coalesce("files", F.lit(0)).alias("files"))
    finding = F.when(F.col("_planned").isNull(), "unplanned").when(F.col("_planned") > 1, "repeated").when(F.col("files") == 0, "missing").when(F.col("files") > 1, "double")
    return both.select(*slot, "files", finding.alias("finding")).filter("finding is not null")


def planned_calls(spark: SparkSession, root: str, plan: DataFrame, order: str, schema: str, *slot: str) -> DataFrame:
    """The calls of a plan in its order: plan's columns with the members of each file's JSON
    record (schema). CheckFailed, with the number of slots by finding, unless every slot
    has exactly one file and every file a slot."""
    listed = listing(spark, root, *slot)
    counts = {r.finding: r["n"] for r in plan_findings(listed, plan, *slot).groupBy("finding").agg(F.count("*").alias("n")).collect()}
    if counts:
        raise CheckFailed(counts)
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    texts = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("value"), relative_path(spark, root, address).alias("path"))
    keyed = plan.withColumns({f"_{c}": F.col(c).cast("string") for c in slot})
    met = keyed.join(listed.withColumnsRenamed({c: f"_{c}" for c in slot}), [f"_{c}" for c in slot]).drop(*[f"_{c}" for c in slot], "bytes")
    return met.join(texts, "path").select(*plan.columns, F.from_json("value", schema).alias("_r")).select(*plan.columns, "_r.*").orderBy(order)


def per_variant(calls: DataFrame, variants: str, variant: str = "variant", body: str = "body") -> DataFrame:
    """A row for each member of a map column: one history a variant of a call."""
    rest = [c for c in calls.columns if c != variants]
    return calls.select(*rest, F.explode(variants).alias(variant, body))
