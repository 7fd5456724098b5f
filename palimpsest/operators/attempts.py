"""Attempts of calls and units: how a failure is named, what a unit does next, and what a
run's calls have used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Outcomes of an attempt, and the decisions that follow from them.
TERMINAL = "TERMINAL_FAILURE"
DECISIONS = {
    "EVALUABLE_PASS": "ACCEPT",
    "EVALUABLE_FLUENCY_ONLY": "ACCEPT_WITH_PROVENANCE_AWARE_SURFACE_EDIT_OPTION",
    "EVALUABLE_LEVEL1_FAILURE": "STOP_FOR_RESEARCHER",
}
INVALID = "INVALID_HISTORY"


def _said(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def failure_kind(last: Column) -> Column:
    """Of a call's last attempt (retry_reason, error_type, http_status): whether the transport
    failed or the output broke its contract. A status that is not known is no 200."""
    infrastructure = _said(last["retry_reason"]) | _said(last["error_type"]) | ~last["http_status"].eqNullSafe(F.lit(200))
    return F.when(infrastructure, "INFRASTRUCTURE_OR_API_ERROR").otherwise("OUTPUT_CONTRACT_FAILURE")


def terminal_detail(last: Column, empty_fields: Column) -> Column:
    """What ended a call: of a broken contract the first of refusal, truncation, parsing and
    schema that applies (refusal, truncated, parse_status, schema_status of the attempt)."""
    kind, yes = failure_kind(last), lambda c: F.coalesce(c, F.lit(False))
    schema = F.when(yes(empty_fields), "REQUIRED_EMPTY_FIELD_SCHEMA_FAILURE").otherwise("SCHEMA_FAILURE")
    return (
        F.when(kind != "OUTPUT_CONTRACT_FAILURE", kind).when(_said(last["refusal"]), "REFUSAL").when(yes(last["truncated"]), "TRUNCATION")
        .when(yes(last["parse_status"] == "failed"), "PARSE_FAILURE").when(yes(last["schema_status"] == "failed"), schema).otherwise("OTHER_OUTPUT_CONTRACT_FAILURE")
    )


def unit_next(outcomes: Column, cap: int = 3) -> Column:
    """The decision after a unit's outcomes, oldest first. Only terminal failures are tried
    again, and `cap` of them end the unit; any other outcome ends it at once, so a history
    that goes on behind one is invalid, as is one that is too long or holds something else."""
    last = F.element_at(outcomes, -1)
    known = F.forall(outcomes, lambda o: F.coalesce(o.isin(TERMINAL, *DECISIONS), F.lit(False)))
    ended_early = F.exists(F.slice(outcomes, F.lit(1), F.size(outcomes) - 1), lambda o: o != TERMINAL)
    decision = F.when(last == TERMINAL, F.when(F.size(outcomes) >= cap, "UNBUILDABLE_STOP_FOR_RESEARCHER").otherwise("RETRY_SAME_UNIT"))
    for outcome, then in DECISIONS.items():
        decision = decision.when(last == outcome, then)
    return F.when(F.size(outcomes) == 0, "ATTEMPT").when(~known | (F.size(outcomes) > cap), INVALID).when(ended_early, INVALID).otherwise(decision)


def unit_loop(attempts: DataFrame, unit: str, order: str, outcome: str, cap: int = 3) -> DataFrame:
    """(unit, attempts, decision) of units that are tried until an attempt is not a terminal
    failure, `cap` times at most: what would come later is not run. Attempts at the same
    place of the order follow each other by their outcomes, however they are read."""
    first = Window.partitionBy(unit).orderBy(order, outcome)
    few = attempts.select(unit, F.row_number().over(first).alias("_n"), F.col(outcome).alias("_o")).filter(F.col("_n") <= cap)
    lists = few.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("_n", "_o"))).alias("run"))
    stop = F.array_position(F.transform("run", lambda a: F.coalesce(a["_o"] != TERMINAL, F.lit(True))), F.lit(True)).cast("int")
    done = F.when(stop > 0, F.slice("run", F.lit(1), stop)).otherwise(F.col("run"))
    seen = lists.select(unit, F.transform(done, lambda a: a["_o"]).alias("outcomes"))
    return seen.select(unit, F.size("outcomes").cast("bigint").alias("attempts"), unit_next(F.col("outcomes"), cap).alias("decision"))


def account_runs(records: DataFrame, run: str) -> DataFrame:
    """Usage of each run's calls (run, attempts: array of (usage: prompt_tokens,
    completion_tokens), usage, latency_seconds, cost).

    The accepted usage of a call counts once; what earlier attempts used is kept apart, and
    those without a known usage are counted. Latency and cost are sums, unknown ones as 0. A
    call without attempts has been made once."""
    zero = F.lit(0).cast("bigint")
    tokens = ("prompt_tokens", "completion_tokens")
    earlier = F.slice(F.coalesce("attempts", F.array().cast(records.schema["attempts"].dataType)), F.lit(1), F.greatest(F.size("attempts") - 1, F.lit(0)))
    df = records.withColumn("_earlier", earlier)
    retried = lambda name: F.aggregate("_earlier", zero, lambda s, a: s + F.coalesce(a["usage"][name], zero))
    return df.groupBy(run).agg(
        F.count("*").alias("logical_calls"), F.sum(F.greatest(F.size("attempts"), F.lit(1))).cast("bigint").alias("physical_attempts"),
        *[F.sum(F.coalesce(F.col(f"usage.{n}"), zero)).alias(n) for n in tokens], *[F.sum(retried(n)).alias(f"retry_{n}") for n in tokens],
        F.sum(F.size(F.filter("_earlier", lambda a: a["usage"].isNull()))).cast("bigint").alias("retries_without_usage"),
        F.sum(F.coalesce("latency_seconds", F.lit(0.0))).alias("api_latency_seconds"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
    )
