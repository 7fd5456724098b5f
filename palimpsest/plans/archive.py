"""Evidence files, manifests, complete attempts and redaction, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.nested import canonical_json
from palimpsest.plans.registry import query, table
from palimpsest.sources import evidence
from palimpsest.sources.shared import fresh_folder


@query("SELECT o_orderstatus, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS unverified FROM orders GROUP BY o_orderstatus")
def evidence_archive(spark, sf_dir):
    """Orders published by status, listed in a manifest, verified and read again."""
    at = fresh_folder(spark, "evidence")
    evidence.publish(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority"), f"{at}/records", "o_orderstatus")
    evidence.write_manifest(spark, f"{at}/records", f"{at}/manifest")
    rows = evidence.verified_rows(spark, f"{at}/records", f"{at}/manifest", "o_orderkey bigint, o_orderpriority string")
    bad = evidence.verify(spark, f"{at}/records", f"{at}/manifest").agg(F.count_if(F.col("status") != "verified")).scalar()
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys")).withColumn("unverified", bad)


@query("SELECT CASE p_partkey % 6 WHEN 1 THEN 'unsafe' WHEN 2 THEN 'unsafe' WHEN 3 THEN 'repeated' WHEN 4 THEN 'malformed' ELSE 'fine' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def manifest_findings(spark, sf_dir):
    """Lines that a manifest must refuse: absolute, going up, repeated (two of a kind here), malformed."""
    k = F.col("p_partkey").cast("string")
    path = F.element_at(
        F.array(F.concat(F.lit("a/"), k), F.concat(F.lit("/etc/"), k), F.concat(F.lit("a/../"), k), F.lit("a/same"), F.lit(""), F.concat(F.lit("b/..c/"), k)), (F.col("p_partkey") % 6 + 1).cast("int")
    )
    lines = table(spark, sf_dir, "part").select(F.concat_ws("  ", F.sha2("p_name", 256), path).alias("value"))
    return evidence.manifest(lines).groupBy(F.coalesce("problem", F.lit("fine")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'changed' WHEN 1 THEN 'missing' WHEN 2 THEN 'unlisted' ELSE 'verified' END AS status FROM customer")
def checksum_gate(spark, sf_dir):
    """Hashes that are expected against those that are there."""
    c = table(spark, sf_dir, "customer").withColumn("kind", F.col("c_custkey") % 7)
    want = c.filter("kind != 2").select("c_custkey", F.sha2("c_name", 256).alias("sha256"))
    have = c.filter("kind != 1").select("c_custkey", F.sha2(F.when(F.col("kind") == 0, F.concat("c_name", F.lit(" "))).otherwise(F.col("c_name")), 256).alias("sha256"))
    return evidence.compare(want, have, "c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey) IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 3 + l_orderkey % 3)")
def complete_attempts(spark, sf_dir):
    """Calls of the attempts that hold as many as were planned."""
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.lit(3) + F.col("o_orderkey") % 3).alias("planned"))
    return evidence.complete_only(calls, planned, "l_orderkey")


@query("""SELECT event_id, '{"a":[{"note":"id [REDACTED]!"}],"user":' || user_id || '}' AS record FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0""")
def redacted_records(spark, sf_dir):
    """Records without the members that hold secrets, at any depth; cut-off ones become null."""
    raw = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "Authorization": {"k": 1}, "a": [{"note": "id sk-42!", "api_key": "sk-42"}]'), F.when(F.col("event_id") % 5 == 0, "").otherwise("}"))
    return table(spark, sf_dir, "events").select("event_id", evidence.redact(raw, ("authorization", "api_key"), ("sk-42",)).alias("record"))


@query("""SELECT o_orderkey, sha256('{"max_tokens":64,"messages":[{"content":"Answer.","role":"system"},{"content":"' || o_orderpriority || '","role":"user"}],"model":"' || o_orderstatus || '","seed":null}') AS request_sha256 FROM orders""")
def canonical_requests(spark, sf_dir):
    """Request bodies with fixed members, as canonical JSON at every depth, by their digest."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(64).alias("max_tokens"), F.array(message("system", F.lit("Answer.")), message("user", F.col("o_orderpriority"))).alias("messages"),
        F.col("o_orderstatus").alias("model"), F.lit(None).cast("int").alias("seed"),
    )
    body = body.select("o_orderkey", F.struct("max_tokens", "messages", "model", "seed").alias("body"))
    return body.select("o_orderkey", F.sha2(canonical_json(F.col("body"), body.schema["body"].dataType), 256).alias("request_sha256"))
