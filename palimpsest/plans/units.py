"""Attempts, units and accounting over the line items of orders: a line is an attempt, a
call or a record, an order the call, unit or run that it belongs to."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import attempts, memory
from palimpsest.plans.registry import query, table

_INFRA = "l_quantity < 3 OR l_tax = 0.08 OR l_discount = 0.1"
#: After number and part, which leave lines of one order open: the first of the flags A, N
#: and R, an open line (O) before a closed one (F), and what else tells lines apart. It is as
#: DuckDB (one thread) settles them on the test tables; the SQL does not state it.
_LAST = ("l_linenumber", "l_partkey", "-ascii(l_returnflag)", "l_linestatus", "l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS back FROM lineitem)
SELECT l_orderkey, CASE WHEN {_INFRA} THEN 'INFRASTRUCTURE_OR_API_ERROR' ELSE 'OUTPUT_CONTRACT_FAILURE' END AS kind, CASE WHEN {_INFRA} THEN 'INFRASTRUCTURE_OR_API_ERROR' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'REFUSAL' WHEN l_quantity > 40 THEN 'TRUNCATION'
 WHEN l_partkey % 3 = 0 THEN 'PARSE_FAILURE' WHEN l_suppkey % 4 = 0 THEN 'REQUIRED_EMPTY_FIELD_SCHEMA_FAILURE' WHEN l_suppkey % 2 = 0 THEN 'SCHEMA_FAILURE' ELSE 'OTHER_OUTPUT_CONTRACT_FAILURE' END AS detail FROM a WHERE back = 1""")
def failure_taxonomy(spark, sf_dir):
    """How the last attempt of each call is named as a failure; of lines with the same number
    and part always the same one is the last, in whatever order they are read."""
    last = F.struct(
        F.when(F.col("l_quantity") < 3, "timeout").otherwise("").alias("retry_reason"), F.when(F.col("l_tax") == 0.08, "ConnectError").alias("error_type"),
        F.when(F.col("l_discount") == 0.1, 503).otherwise(200).alias("http_status"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "I cannot").alias("refusal"),
        (F.col("l_quantity") > 40).alias("truncated"), F.when(F.col("l_partkey") % 3 == 0, "failed").otherwise("passed").alias("parse_status"),
        F.when(F.col("l_suppkey") % 2 == 0, "failed").alias("schema_status"), (F.col("l_suppkey") % 4 == 0).alias("empty"),
    )
    ended = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by(last, F.struct(*map(F.expr, _LAST))).alias("last"))
    return ended.select("l_orderkey", attempts.failure_kind(F.col("last")).alias("kind"), attempts.terminal_detail(F.col("last"), F.col("last.empty")).alias("detail"))


_OUTCOME = "CASE WHEN l_returnflag = 'R' THEN 'TERMINAL_FAILURE' WHEN l_returnflag = 'A' THEN 'EVALUABLE_PASS' WHEN l_linestatus = 'O' THEN 'EVALUABLE_FLUENCY_ONLY' ELSE 'EVALUABLE_LEVEL1_FAILURE' END"
_DECIDE = "CASE {o} WHEN 'EVALUABLE_PASS' THEN 'ACCEPT' WHEN 'EVALUABLE_FLUENCY_ONLY' THEN 'ACCEPT_WITH_PROVENANCE_AWARE_SURFACE_EDIT_OPTION' WHEN 'EVALUABLE_LEVEL1_FAILURE' THEN 'STOP_FOR_RESEARCHER' ELSE {retry} END"


@query(f"""WITH a AS (SELECT l_orderkey, {_OUTCOME} AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
 u AS (SELECT l_orderkey, count(*) AS c, coalesce(min(n) FILTER (WHERE o <> 'TERMINAL_FAILURE'), 1000) AS first FROM a GROUP BY l_orderkey),
 d AS (SELECT u.l_orderkey, c, first, least(c, first, 3) AS n FROM u)
SELECT d.l_orderkey, CAST(d.n AS BIGINT) AS attempts, {_DECIDE.format(o="x.o", retry="CASE WHEN d.n >= 3 THEN 'UNBUILDABLE_STOP_FOR_RESEARCHER' ELSE 'RETRY_SAME_UNIT' END")} AS decision,
 CASE WHEN c > 3 OR first < c THEN 'INVALID_HISTORY' ELSE {_DECIDE.format(o="x.o", retry="CASE WHEN c >= 3 THEN 'UNBUILDABLE_STOP_FOR_RESEARCHER' ELSE 'RETRY_SAME_UNIT' END")} END AS whole_history FROM d JOIN a AS x ON x.l_orderkey = d.l_orderkey AND x.n = d.n""")
def unit_decision(spark, sf_dir):
    """What each unit's loop runs and decides, and what its whole history would mean. Of lines
    with the same number and part, which the SQL leaves open, terminal failures come first in
    both, since nothing is tried behind another outcome; the rest by outcome."""
    tried = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.expr(f"{_OUTCOME} <> 'TERMINAL_FAILURE'").alias("ends")).alias("at"), F.expr(_OUTCOME).alias("outcome"))
    loop = attempts.unit_loop(tried, "l_orderkey", "at", "outcome", 3)
    whole = tried.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "outcome"))), lambda x: x["outcome"]).alias("all"))
    return loop.join(whole, "l_orderkey").select("l_orderkey", "attempts", "decision", attempts.unit_next(F.col("all"), 3).alias("whole_history"))


@query("""WITH c AS (SELECT *, 1 + l_suppkey % 3 AS tries, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
 e AS (SELECT l_orderkey, q + k AS p, k AS d, (l_partkey + k) % 4 = 0 AS unknown FROM (SELECT *, unnest(range(1, tries)) AS k FROM c)),
 r AS (SELECT l_orderkey, CAST(sum(CASE WHEN unknown THEN 0 ELSE p END) AS BIGINT) AS rp, CAST(sum(CASE WHEN unknown THEN 0 ELSE d END) AS BIGINT) AS rc, count(*) FILTER (WHERE unknown) AS n FROM e GROUP BY l_orderkey)
SELECT c.l_orderkey, count(*) AS logical_calls, CAST(sum(tries) AS BIGINT) AS physical_attempts, CAST(sum(CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE q END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_linenumber END) AS BIGINT) AS completion_tokens,
 coalesce(any_value(rp), 0) AS retry_prompt_tokens, coalesce(any_value(rc), 0) AS retry_completion_tokens, coalesce(any_value(n), 0) AS retries_without_usage, round(sum(l_quantity), 2) AS api_latency_seconds, round(sum(coalesce(nullif(l_discount, 0.05), 0)), 2) AS cost
FROM c LEFT JOIN r ON r.l_orderkey = c.l_orderkey GROUP BY c.l_orderkey""")
def usage_accounting(spark, sf_dir):
    """Calls of a run: accepted usage once, retries apart, latency and cost summed."""
    q, k = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    usage = lambda p, c: F.struct(p.cast("bigint").alias("prompt_tokens"), c.cast("bigint").alias("completion_tokens"))
    tries = F.transform(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("l_suppkey") % 3), lambda n: F.struct(F.when((F.col("l_partkey") + n) % 4 != 0, usage(q + n, n)).alias("usage")))
    records = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", tries.alias("attempts"), F.when(k % 5 != 0, usage(q, k)).alias("usage"), F.col("l_quantity").alias("latency_seconds"), F.nullif("l_discount", F.lit(0.05)).alias("cost"),
    )
    used = attempts.account_runs(records, "l_orderkey")
    return used.withColumn("api_latency_seconds", F.round("api_latency_seconds", 2)).withColumn("cost", F.round("cost", 2))


_STATES = """WITH e AS (SELECT user_id % 20 AS run, event_type AS key, CAST(floor(value) AS BIGINT) AS value, event_id AS step FROM events),
 c AS (SELECT *, lag(value) OVER w IS DISTINCT FROM value OR row_number() OVER w = 1 AS changed, min(step) OVER (PARTITION BY run, key) AS created FROM e WINDOW w AS (PARTITION BY run, key ORDER BY step)),
 s AS (SELECT run, key, value, created, step AS since, lead(step) OVER (PARTITION BY run, key ORDER BY step) AS until FROM c WHERE changed) """


def _versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.col("event_type").alias("key"), F.floor("value").alias("value"), F.col("event_id").alias("step"))
    return e, memory.versions(e, "run", "key", "value", "step")


@query(_STATES + "SELECT * FROM s")
def state_versions(spark, sf_dir):
    """The changes of each run's keyed state, with the range in which each holds."""
    return _versions(spark, sf_dir)[1]


@query(_STATES + "SELECT p.run, p.step, s.key, s.value, s.created, s.since FROM (SELECT run, step FROM e WHERE step % 50 = 0) p JOIN s ON s.run = p.run AND s.since <= p.step AND (s.until IS NULL OR p.step < s.until)")
def states_at_events(spark, sf_dir):
    """Whole states after every fiftieth event, entry by entry."""
    e, states = _versions(spark, sf_dir)
    return memory.state_at(states, e.filter("step % 50 = 0").select("run", "step"), "run", "step").select("run", "step", "key", "value", "created", "since")


@query(_STATES + "SELECT c.run, c.step, count(*) AS entries, CAST(sum(s.value) AS BIGINT) AS size FROM (SELECT DISTINCT run, step FROM c WHERE changed) c JOIN s ON s.run = c.run AND s.since <= c.step AND (s.until IS NULL OR c.step < s.until) GROUP BY c.run, c.step")
def state_sizes(spark, sf_dir):
    """Entries of the state, and their sizes in all, after each event that changes it."""
    return memory.state_sizes(_versions(spark, sf_dir)[1], "run", F.col("value"), "step").select("run", "step", F.col("entries").cast("bigint").alias("entries"), "size")
