"""Attempts, retries, gates and checklists. A line of an order is an attempt of its unit,
in the order of line numbers; its flags stand for the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.registry import query, table

#: Attempts of a unit, at most; seconds waited before the next one, doubled each time.
MOST, WAIT = 3, 1
#: HTTP statuses that may be tried again.
RETRYABLE = (408, 429, 500, 502, 503, 504)

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
_RN = f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS n,
 CASE WHEN l_returnflag = 'A' THEN 200 WHEN l_returnflag = 'N' THEN 503 WHEN l_linestatus = 'O' THEN 429 ELSE 400 END AS http FROM lineitem) """


def _units(spark, sf_dir) -> DataFrame:
    """Units with their attempts in order."""
    flag = F.col("l_returnflag")
    http = F.when(flag == "A", 200).when(flag == "N", 503).when(F.col("l_linestatus") == "O", 429).otherwise(400)
    line = F.struct(*_ORDER, http.alias("http"), flag.alias("flag"), F.col("l_linestatus").alias("status"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("tries"))


@query(_RN + f""", t AS (SELECT l_orderkey, min(n) FILTER (WHERE http NOT IN {RETRYABLE}) AS stop, count(*) AS c FROM a GROUP BY l_orderkey),
 e AS (SELECT l_orderkey, least(coalesce(stop, 99), c, {MOST}) AS n FROM t)
SELECT e.l_orderkey, CAST(e.n AS BIGINT) AS attempts, CAST(CASE e.n WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS BIGINT) AS waited,
 CASE WHEN http = 200 THEN 'OK' WHEN http = 400 THEN 'TERMINAL' ELSE 'EXHAUSTED' END AS outcome FROM e JOIN a ON a.l_orderkey = e.l_orderkey AND a.n = e.n""")
def retry_machine(spark, sf_dir):
    """The attempts that a unit needed: up to the first that cannot be tried again."""
    u = _units(spark, sf_dir).withColumn("tries", F.slice("tries", 1, MOST))
    stops = F.array_position(F.transform("tries", lambda t: ~t["http"].isin(*RETRYABLE)), F.lit(True))
    n = F.when(stops > 0, stops).otherwise(F.size("tries"))
    u = u.withColumn("attempts", n.cast("bigint")).withColumn("http", F.element_at("tries", F.col("attempts").cast("int"))["http"])
    outcome = F.when(F.col("http") == 200, "OK").when(F.col("http").isin(*RETRYABLE), "EXHAUSTED").otherwise("TERMINAL")
    return u.select("l_orderkey", "attempts", (WAIT * (F.pow(F.lit(2), F.col("attempts") - 1) - 1)).cast("bigint").alias("waited"), outcome.alias("outcome"))


@query(_RN + """SELECT l_orderkey, bool_and(http <> 400) AS open, CAST(min(n) FILTER (WHERE http = 400) AS BIGINT) AS closed_at,
 CASE WHEN bool_or(http = 400) THEN 'CLOSED_TERMINAL' WHEN bool_and(http IN (429, 503)) THEN 'INVALIDATED_INFRASTRUCTURE' WHEN count(*) < 3 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS closure FROM a GROUP BY l_orderkey""")
def attempt_closure(spark, sf_dir):
    """A terminal failure closes the whole attempt; if none but infrastructure failures
    were seen it is invalidated."""
    at = F.array_position(F.transform("tries", lambda t: t["http"]), F.lit(400))
    infra = F.forall("tries", lambda t: t["http"].isin(*RETRYABLE))
    closure = F.when(at > 0, "CLOSED_TERMINAL").when(infra, "INVALIDATED_INFRASTRUCTURE").when(F.size("tries") < 3, "INCOMPLETE").otherwise("COMPLETE")
    return _units(spark, sf_dir).select("l_orderkey", (at == 0).alias("open"), F.nullif(at, F.lit(0)).cast("bigint").alias("closed_at"), closure.alias("closure"))


@query(_RN + """, p AS (SELECT *, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS bad FROM a)
SELECT l_orderkey, n AS step, CASE WHEN bad = 0 THEN 'passed' WHEN bad = 1 AND l_returnflag = 'R' THEN 'failed' ELSE 'blocked' END AS status FROM p""")
def step_chain(spark, sf_dir):
    """Steps that depend on each other: behind the first that fails all are blocked."""
    u = _units(spark, sf_dir)
    first = F.array_position(F.transform("tries", lambda t: t["flag"]), F.lit("R"))
    u = u.select("l_orderkey", first.alias("first"), F.posexplode("tries").alias("at", "t")).withColumn("step", (F.col("at") + 1).cast("bigint"))
    status = F.when((F.col("first") == 0) | (F.col("step") < F.col("first")), "passed").when(F.col("step") == F.col("first"), "failed").otherwise("blocked")
    return u.select("l_orderkey", "step", status.alias("status"))


@query(_RN + """, m AS (SELECT l_orderkey, max(n) AS last FROM a GROUP BY l_orderkey)
SELECT m.l_orderkey, CAST(last AS BIGINT) AS official, (SELECT count(*) FROM a WHERE a.l_orderkey = m.l_orderkey AND a.n < last AND http = 200) = 0 AS accepted FROM m""")
def official_attempt(spark, sf_dir):
    """The last attempt counts, if all before it were closed without a result."""
    early = F.slice("tries", F.lit(1), F.size("tries") - 1)
    return _units(spark, sf_dir).select("l_orderkey", F.size("tries").cast("bigint").alias("official"), F.forall(early, lambda t: t["http"] != 200).alias("accepted"))


@query("SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN 'primary' WHEN toxic IS NOT NULL OR d.doc_id % 2 = 0 THEN 'fallback' END AS resolved FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def primary_precedence(spark, sf_dir):
    """The primary where it is qualified, else the fallback where that is, else none."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    primary = F.when(F.col("quality").isNotNull(), "primary")
    fallback = F.when(F.col("toxic").isNotNull() | (F.col("doc_id") % 2 == 0), "fallback")
    return d.select("doc_id", F.coalesce(primary, fallback).alias("resolved"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority LIKE '%URGENT') THEN 'SUPPORTED' ELSE 'OPEN' END AS capability FROM customer""")
def capability_gate(spark, sf_dir):
    """Evidence holds for the slot and model that it was made with alone; without any: open."""
    slots = table(spark, sf_dir, "customer").select("c_custkey", F.lit("O").alias("model"))
    found = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").endswith("URGENT"))
    found = found.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("model"), F.lit("SUPPORTED").alias("found")).distinct()
    return slots.join(found, ["c_custkey", "model"], "left").select("c_custkey", F.coalesce("found", F.lit("OPEN")).alias("capability"))


@query("""SELECT p_brand, bool_and(p_partkey % 50 <> 7) AS frozen, count(*) FILTER (WHERE p_partkey % 50 = 7) AS differing FROM part GROUP BY p_brand""")
def pinned_identity(spark, sf_dir):
    """Frozen only where each pinned hash is the actual one (one that is not there differs)."""
    actual = F.sha2("p_name", 256)
    pinned = F.when(F.col("p_partkey") % 100 == 7, F.lit(None)).when(F.col("p_partkey") % 100 == 57, F.sha2("p_type", 256)).otherwise(actual)
    same = pinned.eqNullSafe(actual)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.bool_and(same).alias("frozen"), F.count_if(~same).alias("differing"))


#: Checks as a table of names, states before which they wait, and predicates over orders.
CHECKS = {
    "has_status": ("offline", "o_orderstatus in ('F', 'O', 'P')"),
    "price_positive": ("offline", "o_totalprice > 0"),
    "not_urgent": ("post_run", "not o_orderpriority like '1%'"),
    "closed": ("post_run", "o_orderstatus = 'F'"),
}


@query("""WITH c AS (SELECT 'has_status' AS chk, 'offline' AS stage, count(*) AS n, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) AS bad FROM orders
 UNION ALL SELECT 'price_positive', 'offline', count(*), count(*) FILTER (WHERE o_totalprice <= 0) FROM orders
 UNION ALL SELECT 'not_urgent', 'post_run', count(*), count(*) FILTER (WHERE substr(o_orderpriority, 1, 1) = '1') FROM orders
 UNION ALL SELECT 'closed', 'post_run', count(*), count(*) FILTER (WHERE o_orderstatus <> 'F') FROM orders)
SELECT chk, stage, bad AS violations, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS state FROM c""")
def acceptance_checklist(spark, sf_dir):
    """A registry of named checks, all in one pass, one row each."""
    found = table(spark, sf_dir, "orders").agg(*[F.count_if(~F.expr(rule)).alias(name) for name, (_, rule) in CHECKS.items()])
    rows = found.unpivot([], list(CHECKS), "chk", "violations")
    stage = F.create_map(*[F.lit(x) for name, (when, _) in CHECKS.items() for x in (name, when)])
    return rows.select("chk", stage[F.col("chk")].alias("stage"), "violations", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("state"))


@query("SELECT conv_id, turn, position('the' IN lower(text)) > 0 AND regexp_matches(text, '[Tt]he [a-z]+ion') AS leaks FROM conversations")
def prompt_leaks(spark, sf_dir):
    """Prompts in which a pattern of reference-only words is found."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").rlike("[Tt]he [a-z]+ion").alias("leaks"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events WHERE event_type LIKE 'p%') SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM u) AND NOT (event_type LIKE '%rch' OR event_type = 'error')""")
def frozen_subset(spark, sf_dir):
    """A subset by kind, without a suffix, and by a list of usable ids."""
    e = table(spark, sf_dir, "events")
    usable = e.filter(F.col("event_type").startswith("p")).select("user_id").distinct()
    return e.filter((F.col("event_type") != "error") & ~F.col("event_type").endswith("rch")).join(usable, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT o_custkey, count(*) AS calls, sha256(string_agg(sha256(o_orderkey || '|' || o_orderpriority), ',' ORDER BY o_orderdate, o_orderkey)) AS plan_identity FROM orders GROUP BY o_custkey")
def plan_identity(spark, sf_dir):
    """Digest of a plan's requests in their order: equal digests are the same plan."""
    one = F.struct("o_orderdate", "o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"), 256).alias("h"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["h"])
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("calls"), F.sha2(F.array_join(listed, ","), 256).alias("plan_identity"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS logical_index FROM orders")
def planned_order(spark, sf_dir):
    """Position of each call in its plan."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(order).cast("bigint").alias("logical_index"))
