"""Closed records, nested rewriting, canonical bytes and planned calls over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions.nested import canonical_json, rewrite
from palimpsest.functions.records import nullable, optional, record_findings
from palimpsest.plans.registry import query, table
from palimpsest.sources import calls
from palimpsest.sources.shared import fresh_folder

FORM = {"conv": "integer", "turns": [{"role": {"user", "assistant"}, "turn": "integer", "text": "text", "length": optional(nullable("integer"))}], "first": {"role": {"user"}}}


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
 n AS (SELECT conv_id, min_by(role, turn) AS first FROM conversations GROUP BY conv_id)
SELECT conv_id, '$.turns[' || i || '].role' AS path, 'not one of the values' AS problem FROM t WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT conv_id, '$.turns[' || i || '].length', 'no integer' FROM t WHERE turn = 3 UNION ALL SELECT conv_id, '$.turns[' || i || '].text', 'missing' FROM t WHERE conv_id % 6 = 0
UNION ALL SELECT conv_id, '$.turns[' || i || '].said', 'unexpected' FROM t WHERE conv_id % 6 = 0 UNION ALL SELECT conv_id, '$.first.role', 'not one of the values' FROM n WHERE first <> 'user'""")
def record_problems(spark, sf_dir):
    """Conversations as JSON records against their form: roles as the table has them, a length
    that is a text at turn 3, and another name for texts in every sixth."""
    t = table(spark, sf_dir, "conversations")
    n = F.char_length("text")
    item = lambda name: F.struct("turn", "role", F.col("text").alias(name), F.when(F.col("turn") == 3, F.lit(None)).otherwise(n).alias("length"), F.when(F.col("turn") == 3, n.cast("string")).alias("_"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(item("text"))).alias("a"), F.array_sort(F.collect_list(item("said"))).alias("b"))
    record = F.to_json(F.struct(F.col("conv_id").alias("conv"), F.when(F.col("conv_id") % 6 != 0, F.col("a")).alias("turns"), F.when(F.col("conv_id") % 6 == 0, F.col("b")).alias("other"), F.struct(F.col("a")[0]["role"].alias("role")).alias("first")))
    record = F.replace(F.replace(record, F.lit('"other":'), F.lit('"turns":')), F.lit('"_":'), F.lit('"length":'))
    return rows.select("conv_id", F.explode(record_findings(record, FORM)).alias("f")).select("conv_id", "f.*")


def _order(more: str, name: str, status: str) -> str:
    return (
        """SELECT o_orderkey, '{"key":' || o_orderkey || ',"lines":[' || (SELECT string_agg('{"n":' || l_linenumber || """ + more + """ || ',"Δ":' || CASE WHEN l_returnflag = 'N' THEN 'null' ELSE '"' || l_returnflag || '\\"é"' END || '}', ',' ORDER BY l_linenumber, l_partkey, nullif(l_returnflag, 'N') NULLS FIRST, l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey)
 || '],"price":' || CAST(o_totalprice AS VARCHAR) || ',"@":"' || """.replace("@", name) + status + """ || '"}' AS text FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
    )


def _orders(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", F.lit('"é'))).alias("Δ"), F.col("l_extendedprice").alias("paid"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["n"].alias("n"), x["Δ"].alias("Δ"), x["paid"].alias("paid"))).alias("lines"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "lines", F.col("o_orderkey").alias("key")).alias("record"))


@query("SELECT o_orderkey, sha256(text) AS sha256 FROM (" + _order("""',"paid":' || CAST(l_extendedprice AS VARCHAR)""", "status", "o_orderstatus") + ")")
def canonical_records(spark, sf_dir):
    """Nested records as canonical JSON: sorted members at every depth, floats, other scripts."""
    rows = _orders(spark, sf_dir)
    return rows.select("o_orderkey", F.sha2(canonical_json(F.col("record"), rows.schema["record"].dataType), 256).alias("sha256"))


@query(_order("''", "z", "CASE o_orderstatus WHEN 'O' THEN 'F' WHEN 'F' THEN 'O' ELSE o_orderstatus END"))
def rewritten_views(spark, sf_dir):
    """The same records seen another way: two states swapped, a member renamed, and the
    prices of the lines left out."""
    rows = _orders(spark, sf_dir)
    swap = lambda c: F.when(c == "O", "F").when(c == "F", "O").otherwise(c)
    other = rewrite(F.col("record"), rows.schema["record"].dataType, drop=("lines[].paid",), replace={"status": swap})
    other = rewrite(other, rows.select(other.alias("r")).schema["r"].dataType, rename={"status": "z"})
    made = rows.select("o_orderkey", other.alias("r"))
    return made.select("o_orderkey", canonical_json(F.col("r"), made.schema["r"].dataType).alias("text"))


@query("""WITH p AS (SELECT n_regionkey AS region, n_nationkey AS nation FROM nation)
SELECT CAST(row_number() OVER (ORDER BY region DESC, nation) AS BIGINT) AS slot, region, nation, unnest(['low', 'high']) AS variant, unnest([nation - 1, nation + 1]) AS body FROM p""")
def planned_histories(spark, sf_dir):
    """A file for each nation's call, read in the order of the plan, a row for each variant."""
    root, nations = fresh_folder(spark, "calls"), table(spark, sf_dir, "nation")
    made = nations.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.to_json(F.struct(F.create_map(F.lit("low"), F.col("n_nationkey") - 1, F.lit("high"), F.col("n_nationkey") + 1).alias("output"))).alias("value"))
    made.repartition("region", "nation").write.partitionBy("region", "nation").text(f"{root}/calls")
    plan = nations.select(F.row_number().over(Window.orderBy(F.col("n_regionkey").desc(), "n_nationkey")).cast("bigint").alias("slot"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    read = calls.planned_calls(spark, f"{root}/calls", plan, "slot", "output map<string,int>", "region", "nation")
    return calls.per_variant(read, "output")
