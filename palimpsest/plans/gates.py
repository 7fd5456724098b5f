"""Rules as data, gated sinks, and chains of evidence over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators.checks import CheckFailed, Rule, findings, replace_checked, require, require_none
from palimpsest.plans.registry import query, table
from palimpsest.sources import closures, snapshots
from palimpsest.sources.shared import fresh_folder

#: Rules of three materials.
RULES = [
    Rule("price_positive", "orders", "o_totalprice > 0"), Rule("price_in_range", "orders", "o_totalprice < 300000", "review"), Rule("status_known", "orders", "o_orderstatus IN ('O', 'F')"),
    Rule("size_small", "part", "p_size <= 40", "review"), Rule("brand_named", "part", "p_brand LIKE 'Brand#1%'"),
    Rule("role_known", "conversations", "role IN ('user', 'assistant')"), Rule("text_one_line", "conversations", "NOT contains(text, '\n')"), Rule("turn_early", "conversations", "turn < 6", "review"),
]
KEYS = {"orders": "o_orderkey", "part": "p_partkey", "conversations": "conv_id"}


@query(" UNION ALL ".join(f"SELECT '{r.table}' AS \"table\", CAST({KEYS[r.table]} AS VARCHAR) AS key, '{r.rule}' AS rule, '{r.severity}' AS severity FROM {r.table} WHERE NOT coalesce({r.predicate}, false)" for r in RULES))
def rule_findings(spark, sf_dir):
    """Rows of three tables that break a rule, from one list of rules: one pass a table."""
    return findings({t: table(spark, sf_dir, t) for t in KEYS}, RULES, KEYS)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def checked_snapshot(spark, sf_dir):
    """A table replaced twice: by rows that meet every check, then by a writer whose check
    fails, which leaves no trace; and what is read after both."""
    base, orders = fresh_folder(spark, "snapshots"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    good = require(orders.filter("o_orderstatus <> 'P'"), key="o_orderkey >= 0")
    require_none(nulls=orders.filter("o_orderkey is null"))
    snapshots.replace(orders.limit(0), base)
    first = replace_checked(good, base, {"status": "o_orderstatus IN ('O', 'F')"}, {"rows": (F.count("*"), lambda n: n > 0)})
    try:
        replace_checked(orders, base, {"status": "o_orderstatus IN ('O', 'F')"})
    except CheckFailed:
        assert snapshots.last(spark, base) == first
    return snapshots.read(spark, base)


def _closed(spark, sf_dir):
    """Files, tries and closures; lines are shuffled as their numbers, texts are made behind."""
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("bigint").alias("chain"), F.col("l_linenumber").cast("bigint").alias("attempt"), "l_orderkey", "l_partkey")
    path = F.concat("l_orderkey", F.lit("-"), "l_partkey")
    lines = closures.dealt(ids, path).distinct()
    files = lines.select("chain", "attempt", "_deal", path.alias("path"), F.sha2(F.concat("l_orderkey", F.lit(":"), "l_partkey"), 256).alias("sha256"))
    tries = lines.select("chain", "attempt").distinct().withColumn("plan", F.sha2(F.col("chain").cast("string"), 256)).withColumn("status", F.lit("CLOSED_INCOMPLETE"))
    return files, tries, closures.close(tries, files)


_DERIVED = """WITH RECURSIVE l AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS chain, CAST(l_linenumber AS BIGINT) AS attempt, l_orderkey || '-' || l_partkey AS path, sha256(l_orderkey || ':' || l_partkey) AS sha FROM lineitem),
 p AS (SELECT chain, attempt, substr(sha256(path), 1, 2) AS part, sha256(string_agg(sha || '  ' || path, chr(10) ORDER BY sha || '  ' || path)) AS sha FROM l GROUP BY ALL),
 e AS (SELECT chain, attempt, sha256(string_agg(part || sha, chr(10) ORDER BY part || sha)) AS evidence, row_number() OVER (PARTITION BY chain ORDER BY attempt) AS n FROM p GROUP BY chain, attempt),
 r AS (SELECT chain, attempt, n, '{"attempt":' || attempt || ',"evidence":"' || evidence || '","plan":"' || sha256(CAST(chain AS VARCHAR)) || '","predecessor":"' || repeat('0', 64) || '","status":"CLOSED_INCOMPLETE"}' AS closure FROM e WHERE n = 1
  UNION ALL SELECT e.chain, e.attempt, e.n, '{"attempt":' || e.attempt || ',"evidence":"' || evidence || '","plan":"' || sha256(CAST(e.chain AS VARCHAR)) || '","predecessor":"' || sha256(r.closure) || '","status":"CLOSED_INCOMPLETE"}' FROM r JOIN e ON e.chain = r.chain AND e.n = r.n + 1) """


@query(_DERIVED + "SELECT chain, attempt, sha256(closure) AS sha256 FROM r")
def closure_digests(spark, sf_dir):
    """Closures of each supplier's attempts, each bound to the one before it."""
    return _closed(spark, sf_dir)[2].select("chain", "attempt", "sha256")


@query("""WITH l AS (SELECT CAST(l_suppkey AS BIGINT) AS chain, CAST(l_linenumber AS BIGINT) AS attempt, bool_or(l_orderkey % 997 = 0) AS drifted FROM lineitem GROUP BY 1, 2),
 f AS (SELECT *, chain % 5 = 1 AND attempt = 3 AS edited, coalesce(chain % 5 = 1 AND lag(attempt) OVER (PARTITION BY chain ORDER BY attempt) = 3, false) AS follows, chain % 7 = 2 AS replanned FROM l),
 x AS (SELECT *, CASE WHEN edited THEN 'not_closed' WHEN follows THEN 'predecessor_changed' WHEN replanned THEN 'plan_changed' WHEN drifted THEN 'evidence_drifted' END AS finding FROM f)
SELECT chain, attempt, coalesce(finding, CASE WHEN count(finding) OVER (PARTITION BY chain ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'refused' ELSE 'verified' END) AS finding FROM x""")
def closure_findings(spark, sf_dir):
    """Chains after evidence has drifted, closures were edited and plans have changed."""
    files, tries, closed = _closed(spark, sf_dir)
    changed = files.withColumn("sha256", F.when(F.substring_index("path", "-", 1).cast("bigint") % 997 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")))
    edited = F.when((F.col("chain") % 5 == 1) & (F.col("attempt") == 3), F.replace("closure", F.lit("CLOSED_INCOMPLETE"), F.lit("OPEN"))).otherwise(F.col("closure"))
    plan = tries.select("chain", F.when(F.col("chain") % 7 == 2, "another").otherwise(F.col("plan")).alias("plan")).distinct()
    return closures.verify_chain(closed.withColumn("closure", edited), changed, plan)
