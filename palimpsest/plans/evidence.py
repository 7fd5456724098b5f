"""Text checks, plans against archives, accounting, roll-ups and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators.text import contained
from palimpsest.plans.registry import query, sql, table

# Words that tell a value's status or time rather than the value.
STATUS_WORDS = (
    "current", "now", "latest", "previous", "new", "newest", "old", "former", "prior",
    "updated", "changed", "revised", "original", "final", "recent", "today", "next",
)
_STATUS = ", ".join(f"'{w}'" for w in STATUS_WORDS)

_WORDS = """WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' '@G)) AS norm FROM {documents}) """.replace("\\\\", "\\")
sql("normalized_text", _WORDS.replace("\\t\\n\\r", "\t\n\r") + "SELECT doc_id, @SHAnorm@HEX AS norm_sha256, CAST(length(norm) AS BIGINT) AS chars FROM n")


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def word_tokens(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


@query(f"SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ({_STATUS}))) AS BIGINT) AS hits FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def status_word_hits(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")).alias("w"))
    return w.select("doc_id", F.size(F.filter("w", lambda x: x.isin(*STATUS_WORDS))).cast("bigint").alias("hits"))


@query("SELECT doc_id, CAST(len(list_filter(range(1, greatest(len(w), 1)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS repeats FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def adjacent_repeat(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")).alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    same = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: a == b)
    return w.select("doc_id", F.size(F.filter(same, lambda x: x)).cast("bigint").alias("repeats"))


_FOLD = """WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS f FROM documents),
 b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS f FROM benchmark) """


@query(_FOLD + "SELECT DISTINCT item_id, doc_id FROM d, b WHERE b.f <> '  ' AND contains(d.f, b.f)")
def bounded_containment(spark, sf_dir):
    return contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(_FOLD + "SELECT DISTINCT item_id, doc_id FROM d, b WHERE (b.f <> '  ' AND contains(d.f, b.f)) OR (d.f <> '  ' AND contains(b.f, d.f))")
def overlap_pairs(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return contained(b, d, "item_id", "doc_id").unionByName(contained(d, b, "doc_id", "item_id").select("item_id", "doc_id")).distinct()


@query(_FOLD + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d, b WHERE b.f <> '  ' AND contains(d.f, b.f))")
def separation_clean_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id").join(contained(table(spark, sf_dir, "benchmark"), d, "item_id", "doc_id"), "doc_id", "left_anti")


sql("redacted_pages", "SELECT page_id, @SHAregexp_replace(url, '[?#].*$', ''@G)@HEX AS url_sha256, CAST(length(regexp_replace(html, '<[^>]*>', ''@G)) AS BIGINT) AS text_chars FROM {pages}")
@query("""WITH v AS (SELECT unnest(['low', 'medium', 'high']) AS variant) SELECT c_custkey, variant, 'maintenance' AS kind FROM customer CROSS JOIN v
UNION ALL SELECT c_custkey, variant, 'answer' AS kind FROM customer CROSS JOIN v""")
def call_plan(spark, sf_dir):
    """A call of each kind for each scenario and variant."""
    every = lambda *names: F.explode(F.array(*[F.lit(n) for n in names]))
    plan = table(spark, sf_dir, "customer").select("c_custkey", every("low", "medium", "high").alias("variant"))
    return plan.select("*", every("maintenance", "answer").alias("kind"))


sql("plan_vs_archive", """SELECT coalesce(c_custkey, o_custkey) AS custkey, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unplanned' ELSE 'present' END AS status
FROM {customer} FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM {orders}) o ON c_custkey = o_custkey""")
sql("set_equality", """WITH a AS (SELECT c_custkey AS k FROM {customer}), b AS (SELECT DISTINCT o_custkey AS k FROM {orders})
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) x) AS only_plan, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) y) AS only_archive""")
sql("run_accounting", """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS from_last FROM {lineitem})
SELECT o_orderkey, count(l_orderkey) AS physical, CAST(coalesce(sum(CASE WHEN from_last = 1 THEN l_quantity END), 0) AS BIGINT) AS accepted_tokens,
 CAST(coalesce(sum(CASE WHEN from_last > 1 THEN l_quantity END), 0) AS BIGINT) AS retry_tokens, count(l_orderkey) > 1 AS retried, greatest(count(l_orderkey), 1) AS attempts
FROM {orders} LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
_LINES = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS rn,
 coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed_before FROM {lineitem}) """
sql("prefix_until_failure", _LINES + "SELECT l_orderkey, count(*) AS executed, count(*) FILTER (WHERE l_returnflag = 'R') AS failures FROM a WHERE failed_before = 0 GROUP BY l_orderkey")
sql("contiguous_index", _LINES + "SELECT l_orderkey, bool_and(rn = l_linenumber) AS contiguous, CAST(max(l_linenumber) AS BIGINT) AS last_index FROM a GROUP BY l_orderkey")
sql("cell_balance", "SELECT coalesce(l_returnflag, '*') AS returnflag, coalesce(l_linestatus, '*') AS linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
sql("routing_all_selected", "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS selected, count(*) FILTER (WHERE l_linestatus = 'O') > 0 AND bool_and(l_linestatus <> 'O' OR l_returnflag = 'N') AS routing_ok FROM {lineitem} GROUP BY l_orderkey")
sql("replay_compare", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM {orders})
SELECT o.o_orderkey, CASE WHEN o_orderstatus IS NOT DISTINCT FROM status AND o_orderpriority IS NOT DISTINCT FROM priority THEN 'MATCH' ELSE 'MISMATCH' END AS outcome FROM {orders} o JOIN r ON o.o_orderkey = r.o_orderkey""")


@query("""WITH d AS (SELECT l_returnflag, l_orderkey // 256 AS part, sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS h FROM lineitem)
SELECT l_returnflag, part, count(*) AS members, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM d GROUP BY l_returnflag, part""")
def row_digest_manifest(spark, sf_dir):
    """A digest of the rows of each part of a table; parts hold 256 keys, so none grows."""
    fields = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.floor(F.col("l_orderkey") / 256).alias("part"), F.sha2(F.concat_ws("|", *fields), 256).alias("h"))
    return rows.groupBy("l_returnflag", "part").agg(F.count("*").alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("digest"))


@query("SELECT p_brand, count(DISTINCT p_type) AS types, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS inventory FROM part GROUP BY p_brand")
def distinct_sorted_inventory(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("inventory"))


_CELLS = """WITH c AS (SELECT d.lang, d.source, CASE WHEN l.quality IS NULL THEN 'PENDING' WHEN l.quality = 0 THEN 'FAIL' ELSE 'PASS' END AS level1, coalesce(l.toxic, 0) AS level2 FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) """
sql("disposition_rollup", _CELLS + """SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS cells, count(*) FILTER (WHERE level1 = 'PENDING') AS pending,
 CASE WHEN bool_or(level1 = 'FAIL') THEN 'FAIL' WHEN bool_or(level1 = 'PENDING') THEN 'PENDING' ELSE 'QUALIFIED' END AS verdict FROM c GROUP BY ROLLUP (lang, source)""")


@query("""SELECT d.source, count(*) FILTER (WHERE l.quality = 0) AS level1_failures, CAST(sum(coalesce(l.toxic, 0)) AS BIGINT) AS level2_findings,
 CASE WHEN min(l.quality) = 0 THEN 'FAIL' WHEN count(*) > count(l.quality) THEN 'PENDING' ELSE 'QUALIFIED' END AS verdict
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def two_level_gate(spark, sf_dir):
    """FAIL if a cell fails, else PENDING if one is open, else QUALIFIED."""
    cells = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    failed, open_ = F.count_if(F.col("quality") == 0), F.count_if(F.col("quality").isNull())
    verdict = F.when(failed > 0, "FAIL").when(open_ > 0, "PENDING").otherwise("QUALIFIED")
    return cells.groupBy("source").agg(failed.alias("level1_failures"), F.sum(F.coalesce("toxic", F.lit(0))).cast("bigint").alias("level2_findings"), verdict.alias("verdict"))


sql("audit_template", """WITH k AS (SELECT 'identity' AS chk, 1 AS need UNION ALL SELECT 'value', 1 UNION ALL SELECT 'fluency', 0)
SELECT doc_id, chk, CASE WHEN need = 0 AND toxic = 1 THEN 'NA' ELSE 'OPEN' END AS cell FROM {labels} CROSS JOIN k""")
sql("distractor_roles", """WITH b AS (SELECT n_nationkey, n_regionkey, min(s_suppkey) AS s FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT a.n_regionkey, min(a.s) AS target, count(*) AS triples FROM b a JOIN b x ON a.n_regionkey = x.n_regionkey AND a.s <> x.s JOIN b y ON a.n_regionkey = y.n_regionkey AND y.s <> a.s AND y.s <> x.s GROUP BY 1""")
sql("rotation_allocation", "SELECT o_orderkey, (o_orderkey + o_custkey) % 5 AS slot, o_orderpriority FROM {orders}")
