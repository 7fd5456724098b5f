"""Summaries, evidence rows, denominators and releases over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.text import overlap
from palimpsest.operators import evidence, memory
from palimpsest.plans.registry import query, table


@query("""WITH c AS (SELECT o_custkey AS run, count(*) AS logical_calls, count(*) FILTER (WHERE o_orderstatus = 'F') AS accepted_calls, round(sum(o_totalprice), 2) AS seconds, max_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS answer FROM orders GROUP BY o_custkey),
 e AS (SELECT user_id AS run, event_type AS key, CAST(floor(value) AS BIGINT) AS value, event_id AS step FROM events),
 v AS (SELECT *, lag(value) OVER w IS DISTINCT FROM value OR row_number() OVER w = 1 AS changed FROM e WINDOW w AS (PARTITION BY run, key ORDER BY step)),
 r AS (SELECT run, key, value, step, lead(step) OVER (PARTITION BY run, key ORDER BY step) AS until FROM v WHERE changed),
 s AS (SELECT a.run, a.step, count(*) AS entries, CAST(sum(b.value) AS BIGINT) AS size FROM r a JOIN r b ON a.run = b.run AND b.step <= a.step AND (b.until IS NULL OR a.step < b.until) GROUP BY a.run, a.step),
 m AS (SELECT run, max_by(entries, step) AS entries, max_by(size, step) AS size, max(size) AS largest, count(*) AS changes FROM s GROUP BY run)
SELECT c_custkey AS run, answer, CASE WHEN answer IS NULL THEN NULL WHEN answer LIKE '1%' THEN 'CURRENT' ELSE 'OTHER' END AS label, logical_calls, accepted_calls, seconds, entries, size, largest, changes
FROM customer LEFT JOIN c ON c.run = c_custkey LEFT JOIN m ON m.run = c_custkey""")
def run_summaries(spark, sf_dir):
    """Customers as runs, their orders as calls, the events of the user of that number as memory."""
    o = table(spark, sf_dir, "orders").withColumn("run", F.col("o_custkey"))
    calls = o.select("run", (F.col("o_orderstatus") == "F").alias("accepted"), F.col("o_totalprice").alias("seconds"))
    answers = o.filter("o_orderstatus = 'F'").groupBy("run").agg(F.max_by("o_orderpriority", "o_orderkey").alias("answer"))
    answers = answers.withColumn("label", F.when(F.col("answer").startswith("1"), "CURRENT").otherwise("OTHER"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), F.floor("value").alias("value"), F.col("event_id").alias("at"))
    sizes = memory.state_sizes(memory.versions(e, "run", "key", "value", "at"), "run", F.col("value"))
    out = evidence.run_summaries(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run")), "run", calls, answers, sizes)
    return out.withColumn("seconds", F.round("seconds", 2)).withColumn("entries", F.col("entries").cast("bigint"))


@query("""SELECT p_name AS name, p_partkey AS part, nullif(p_size, 7) AS size, sha256('{"name":"' || p_name || '","part":' || p_partkey || ',"size":' || coalesce(CAST(nullif(p_size, 7) AS VARCHAR), 'null') || '}') AS row_sha256 FROM part""")
def evidence_rows(spark, sf_dir):
    return evidence.evidence_rows(table(spark, sf_dir, "part"), {"part": F.col("p_partkey"), "name": F.col("p_name"), "size": F.nullif("p_size", F.lit(7))})


@query("""WITH m AS (SELECT * FROM (VALUES ('accuracy', ['A', 'R']), ('target', ['R'])) AS t(measure, kinds))
SELECT l_suppkey AS supplier, measure, count(*) FILTER (WHERE list_contains(kinds, l_returnflag) AND l_linestatus = 'F') AS n, count(*) FILTER (WHERE NOT (list_contains(kinds, l_returnflag) AND l_linestatus = 'F')) AS left_out FROM lineitem, m GROUP BY 1, 2""")
def denominators(spark, sf_dir):
    """Lines by supplier: new ones (N) are in no measure, nor are those that are still open."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "supplier")
    return evidence.denominators(lines, "supplier", "l_returnflag", "l_linestatus", {"accuracy": ("A", "R"), "target": ("R",)}, ("F",))


@query("""WITH s AS (SELECT d.doc_id, d.text, l.quality, l.toxic, l.doc_id % 4 AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN status = 'released' THEN sha256(text) END AS text_sha256, status FROM (SELECT *, CASE WHEN k IS NULL THEN 'no_audit' WHEN k = 1 THEN 'unbound' WHEN k = 2 AND (quality = 0 OR toxic = 1) THEN 'restated' WHEN quality = 1 AND toxic = 0 THEN 'released' ELSE 'NOT_ELIGIBLE' END AS status FROM s)""")
def released_texts(spark, sf_dir):
    """Texts of documents whose audit (their labels) is bound to them and makes them eligible.
    Every fourth audit is of another text, every fourth states what does not follow."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    fair = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ELIGIBLE").otherwise("NOT_ELIGIBLE")
    audits = table(spark, sf_dir, "labels").join(docs, "doc_id")
    audits = audits.withColumn("text_sha256", F.sha2(F.when(k == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256)).withColumn("verdict", F.when(k == 2, "ELIGIBLE").otherwise(fair)).drop("text")
    return evidence.release(docs, audits, "doc_id", fair).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "status")


@query("""WITH w AS (SELECT item_id, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS a, lower(regexp_extract(text, '^([A-Za-z]+ [a-z]+)', 1)) AS b FROM benchmark)
SELECT x.item_id, y.item_id AS other FROM w x JOIN w y ON x.item_id < y.item_id WHERE x.a <> '' AND y.b <> '' AND (regexp_matches(' ' || x.a || ' ', '[^a-z]' || y.b || '[^a-z]') OR regexp_matches(' ' || y.b || ' ', '[^a-z]' || x.a || '[^a-z]'))""")
def overlapping_expressions(spark, sf_dir):
    """Items whose first word overlaps, as a whole expression, with the first two of another:
    words key the pairs, so only items that share one are compared."""
    word = lambda n: F.regexp_extract("text", "^([A-Za-z]+)" if n == 1 else "^([A-Za-z]+ [a-z]+)", 1)
    b = table(spark, sf_dir, "benchmark")
    x = b.select("item_id", word(1).alias("a")).filter("a <> ''")
    y = b.select(F.col("item_id").alias("other"), word(2).alias("b")).filter("b <> ''")
    keyed = x.withColumn("key", F.lower("a")).join(y.withColumn("key", F.explode(F.array_distinct(F.split(F.lower("b"), " ")))), "key")
    return keyed.filter((F.col("item_id") < F.col("other")) & overlap(F.col("a"), F.col("b"))).select("item_id", "other").distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderstatus || o_orderpriority) WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_orderstatus END AS label FROM orders")
def archive_protocols(spark, sf_dir):
    """Labels of orders by the protocol of each one's own version."""
    o = table(spark, sf_dir, "orders").withColumn("version", F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")))
    rules = {"v0": F.upper(F.concat("o_orderstatus", "o_orderpriority")), "v1": F.col("o_orderpriority"), "v2": F.col("o_orderstatus")}
    return evidence.under_protocol(o, "version", rules, "label").select("o_orderkey", "label")
