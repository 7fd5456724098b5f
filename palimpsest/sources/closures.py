"""Chains of evidence: each attempt's closure is bound to its evidence, to the plan and to
the closure before it, by hashes.

A closure is the canonical JSON of attempt, evidence, plan, predecessor and status. A chain
holds what its links say only as long as every hash can be derived again from the files,
so verification derives them all, names the links that differ, and refuses every link
behind the first of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("attempt", "evidence", "plan", "predecessor", "status")
#: Predecessor of the first attempt.
START = "0" * 64
#: Groups of attempts whose rows are counted, and rows of a group whose attempts are large.
GROUPS, LARGE = 1 << 16, 1 << 20


def dealt(rows: DataFrame, path: str | Column = "path") -> DataFrame:
    """rows (chain, attempt, and whatever paths and digests are made of) in the partitions that
    evidence_digests needs, with `_deal`: an attempt's rows are in one, large ones' in one for
    each of their 256 parts. What is made of the rows behind this is not shuffled.

    Which are large is told by the count of a group of attempts, so it may take in small ones."""
    group = F.pmod(F.xxhash64("chain", "attempt"), F.lit(GROUPS)).alias("_group")
    large = rows.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > LARGE).select("_group")
    held = F.coalesce(F.array_contains(large.agg(F.collect_list("_group").alias("a")).scalar(), group), F.lit(False))
    path = F.col(path) if isinstance(path, str) else path
    return rows.withColumn("_deal", F.when(held, _part(path)).otherwise("")).repartition("chain", "attempt", "_deal")


def _part(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 2)


def evidence_digests(files: DataFrame) -> DataFrame:
    """(chain, attempt, evidence) of files (chain, attempt, path, sha256): the digest of the
    digests of 256 parts of each attempt's lines, so that no task holds a large attempt
    whole. Files that are `dealt` already are not shuffled again."""
    files = files if "_deal" in files.columns else dealt(files)
    lines = lambda c: F.sha2(F.array_join(F.array_sort(c), "\n"), 256)
    keys = ["chain", "attempt", "_deal"]
    parts = files.groupBy(*keys, _part(F.col("path")).alias("part")).agg(lines(F.collect_list(F.concat_ws("  ", "sha256", "path"))).alias("sha"))
    # an attempt of one deal is digested where it lies, of others their parts meet
    own = parts.groupBy(*keys).agg(F.collect_list(F.concat("part", "sha")).alias("_parts"))
    own = own.select("chain", "attempt", F.when(F.col("_deal") == "", lines("_parts")).alias("_whole"), F.when(F.col("_deal") != "", F.col("_parts")).alias("_parts"))
    met = own.groupBy("chain", "attempt").agg(F.max("_whole").alias("_whole"), F.flatten(F.collect_list("_parts")).alias("_parts"))
    return met.select("chain", "attempt", F.coalesce("_whole", lines("_parts")).alias("evidence"))


def _text(attempt: Column, evidence: Column, plan: Column, predecessor: Column, status: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for c, n in zip((attempt, evidence, plan, predecessor, status), FIELDS, strict=True)]))


def close(attempts: DataFrame, files: DataFrame) -> DataFrame:
    """(chain, attempt, closure, sha256) of attempts (chain, attempt, plan, status): attempts of
    a chain are few, and are folded in order. An attempt without files has the digest of
    none."""
    joined = attempts.join(evidence_digests(files), ["chain", "attempt"], "left")
    joined = joined.withColumn("evidence", F.coalesce("evidence", F.sha2(F.lit("").cast("binary"), 256)))
    links = joined.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("attempt", "evidence", "plan", "status"))).alias("links"))
    empty = F.array().cast("array<struct<attempt:bigint,closure:string,sha256:string>>")

    def add(done: Column, link: Column) -> Column:
        before = F.when(F.size(done) > 0, F.element_at(done, -1)["sha256"]).otherwise(START)
        text = _text(link["attempt"].cast("bigint"), link["evidence"], link["plan"], before, link["status"])
        return F.concat(done, F.array(F.struct(link["attempt"].cast("bigint").alias("attempt"), text.alias("closure"), F.sha2(text, 256).alias("sha256"))))

    return links.select("chain", F.explode(F.aggregate("links", empty, add)).alias("l")).select("chain", "l.*")


def verify_chain(closures: DataFrame, files: DataFrame, plan: DataFrame, closed: str = "CLOSED_INCOMPLETE") -> DataFrame:
    """(chain, attempt, finding) of closures (chain, attempt, closure). finding: malformed (no
    closure, or of another attempt), not_closed, predecessor_changed (the closure before it,
    as it is now, is not what this one names, or is missing), plan_changed (plan: chain,
    plan), evidence_drifted; refused for what stands behind a link with a finding, and
    verified for the rest. The first that applies is given."""
    stated = F.from_json("closure", "attempt bigint, evidence string, plan string, predecessor string, status string")
    c = closures.select("chain", "attempt", "closure", stated.alias("s"))
    c = c.join(evidence_digests(files).withColumnRenamed("evidence", "_evidence"), ["chain", "attempt"], "left").join(plan.select("chain", F.col("plan").alias("_plan")), "chain", "left")
    order = Window.partitionBy("chain").orderBy("attempt")
    before = F.when(F.row_number().over(order) == 1, START).otherwise(F.sha2(F.lag("closure").over(order), 256))
    derived = F.coalesce("_evidence", F.sha2(F.lit("").cast("binary"), 256))
    differs = lambda name, value: ~F.coalesce(F.col(f"s.{name}") == value, F.lit(False))
    finding = (
        F.when(differs("attempt", F.col("attempt")) | F.col("s.evidence").isNull(), "malformed").when(differs("status", F.lit(closed)), "not_closed")
        .when(differs("predecessor", before), "predecessor_changed").when(differs("plan", F.col("_plan")), "plan_changed").when(differs("evidence", derived), "evidence_drifted")
    )
    c = c.withColumn("finding", finding)
    broken = F.count("finding").over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0
    return c.select("chain", "attempt", F.coalesce("finding", F.when(broken, "refused").otherwise("verified")).alias("finding"))
