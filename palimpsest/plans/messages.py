"""Message assembly, projections and renderings over the given tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palimpsest.operators import memory
from palimpsest.plans.events import _DUCK, indexed
from palimpsest.functions.strict import whole_text
from palimpsest.plans.registry import query, table

# What the assistant says to each stored text, and the origin of the clock.
NOTED, ORIGIN = "Noted.", "2020-01-01 00:00:00"


def _message(role: str, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


@query(_DUCK + f"""SELECT user_id, CAST(2 * count(*) + 2 AS BIGINT) AS n_messages, sha256('system:S|' || string_agg('user:' || event_type || '|assistant:{NOTED}|', '' ORDER BY idx) || 'user:Q' || user_id) AS prompt_sha256, count(*) = 16 AS whole FROM e GROUP BY user_id""")
def window_messages(spark, sf_dir):
    """System, the exchanges of a run in order, and the question; whole with 16 texts."""
    pair = F.struct("idx", F.array(_message("user", F.col("event_type")), _message("assistant", F.lit(NOTED))).alias("m"))
    runs = indexed(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    question = _message("user", F.concat(F.lit("Q"), F.col("user_id").cast("string")))
    all_of = F.concat(F.array(_message("system", F.lit("S"))), F.flatten(F.transform("pairs", lambda p: p["m"])), F.array(question))
    runs = runs.select("user_id", F.size("pairs").alias("n"), all_of.alias("m"))
    said = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")
    return runs.select("user_id", F.size("m").cast("bigint").alias("n_messages"), F.sha2(said, 256).alias("prompt_sha256"), (F.col("n") == 16).alias("whole"))


@query("""SELECT conv_id, role, n, 'S|' || role || '|' || n AS prompt FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) WHERE role <> 'system'""")
def request_prompts(spark, sf_dir):
    """System and user templates of two kinds of request."""
    n = table(spark, sf_dir, "conversations").filter("role != 'system'").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    body = F.array(_message("system", F.lit("S")), _message("user", F.format_string("%s|%d", "role", "n")))
    return n.withColumn("m", body).select("conv_id", "role", "n", F.array_join(F.transform("m", lambda x: x["content"]), "|").alias("prompt"))


def _leaves(raw: str | None) -> list[str] | None:
    try:
        out, left = [], [json.loads(raw)] if raw else []
    except (ValueError, RecursionError):
        return None
    while left:
        value = left.pop()
        if isinstance(value, str):
            out.append(whole_text(value))
        elif isinstance(value, (dict, list)):
            left += value.values() if isinstance(value, dict) else value
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def string_leaves(raw: pd.Series) -> pd.Series:
    """All strings of a JSON value, at any depth, sorted; null for what is no JSON."""
    return raw.map(_leaves)


@query("SELECT event_id, unnest(['deep', event_type, 'u' || user_id]) AS leaf FROM events")
def recursive_leaves(spark, sf_dir):
    """String leaves of nested objects and arrays; numbers, nulls and names are none."""
    raw = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.lit("deep"), F.col("event_type")).alias("c"))).alias("b")).alias("a"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("d"), "value"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(string_leaves(raw)).alias("leaf"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END AS prompt_tokens, CASE WHEN l_linenumber % 4 = 0 THEN l_suppkey END AS cached_tokens FROM lineitem""")
def usage_envelope(spark, sf_dir):
    """Usage out of a reply's envelope: what is absent, or no number, is null."""
    line = F.col("l_linenumber")
    details = F.when(line % 4 == 0, F.format_string(', "details": {"cached_tokens": %d}', "l_suppkey")).otherwise(F.lit(', "details": null'))
    usage = F.when(line % 2 == 0, F.concat(F.format_string('{"prompt_tokens": %d', F.col("l_quantity").cast("bigint")), details, F.lit("}"))).otherwise(F.lit('{"prompt_tokens": "many"}'))
    v = F.try_parse_json(F.concat(F.lit('{"usage": '), usage, F.lit("}")))
    got = table(spark, sf_dir, "lineitem").withColumn("v", v)
    pick = lambda path: F.try_variant_get("v", path, "bigint")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", pick("$.usage.prompt_tokens").alias("prompt_tokens"), pick("$.usage.details.cached_tokens").alias("cached_tokens"))


@query("SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added, (SELECT count(*) FROM lineitem WHERE l_orderkey % 10 = 0) AS doubled")
def projection_proof(spark, sf_dir):
    """A projection is lossless if both differences, with multiplicities, are empty; a copy
    in which some rows are doubled is told apart."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    nested = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_returnflag").alias("fact")).select("l_orderkey", "fact.*")
    doubled = rows.unionByName(rows.filter("l_orderkey % 10 = 0"))
    sizes = [rows.exceptAll(nested), nested.exceptAll(rows), doubled.exceptAll(rows)]
    lost, added, more = [d.agg(F.count("*").alias("n")) for d in sizes]
    return lost.select(F.col("n").alias("lost"), added.scalar().alias("added"), more.scalar().alias("doubled"))


@query("""SELECT n_name, n_nationkey, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY n_name, n_nationkey""")
def narrow_projection(spark, sf_dir):
    """Facts of the wanted kind, and of the dimension those rows alone that they use."""
    facts = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return table(spark, sf_dir, "nation").join(facts, "n_nationkey").select("n_name", "n_nationkey", "customers")


@query("SELECT page_id, length(html) AS chars, url FROM pages")
def allowed_fields(spark, sf_dir):
    """Of nested records the allowed fields alone, through an array of structs."""
    full = table(spark, sf_dir, "pages").select("page_id", F.array(F.struct("url", F.col("html").alias("secret"), F.char_length("html").cast("bigint").alias("chars"))).alias("events"))
    kept = full.select("page_id", F.transform("events", lambda e: F.struct(e["url"].alias("url"), e["chars"].alias("chars"))).alias("events"))
    return kept.select("page_id", F.inline("events"))


@query("""SELECT p_partkey, form, text, text IN ('The type of ' || p_name || ' is ' || p_type || '.', p_name || ': type = ' || p_type) AS valid FROM (
 SELECT p_partkey, p_name, p_type, 0 AS form, 'The type of ' || p_name || ' is ' || p_type || '.' AS text FROM part UNION ALL SELECT p_partkey, p_name, p_type, 1, p_name || ': type = ' || p_type FROM part
 UNION ALL SELECT p_partkey, p_name, p_type, 2, p_name || ' has type ' || p_type FROM part)""")
def fact_forms(spark, sf_dir):
    """Facts in the forms of a family of templates, and one in none of them."""
    forms = ("The type of {entity} is {value}.", "{entity}: type = {value}", "{entity} has type {value}")
    fill = lambda t: F.replace(F.replace(t, F.lit("{entity}"), F.col("p_name")), F.lit("{value}"), F.col("p_type"))
    p = table(spark, sf_dir, "part").select("*", F.posexplode(F.array(*[F.lit(f) for f in forms])).alias("form", "template"))
    return p.select("p_partkey", "form", fill(F.col("template")).alias("text"), F.array_contains(F.array(*[fill(F.lit(f)) for f in forms[:2]]), fill(F.col("template"))).alias("valid"))


@query("SELECT event_id, strftime(TIMESTAMP '2020-01-01 00:00:00' + to_minutes(CAST(event_id AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS clock, event_id AS minutes FROM events")
def minute_clock(spark, sf_dir):
    """The clock's time after some minutes, and the minutes read back from it."""
    at = F.timestamp_add("MINUTE", F.col("event_id").cast("int"), F.lit(ORIGIN).cast("timestamp_ntz"))
    e = table(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("clock"))
    back = F.to_timestamp_ntz("clock", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("*", F.timestamp_diff("MINUTE", F.lit(ORIGIN).cast("timestamp_ntz"), back).alias("minutes"))


@query("""WITH s AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_transform(range(0, len(l)), lambda i: l[(i + o_custkey) % len(l) + 1]), ',') AS rotated FROM s""")
def rotated_lists(spark, sf_dir):
    """Each list shifted round by its index."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    by = (F.col("o_custkey") % F.size("l")).cast("int")
    turned = F.concat(F.slice("l", by + 1, F.size("l")), F.slice("l", F.lit(1), by))
    return s.select("o_custkey", F.array_join(turned.cast("array<string>"), ",").alias("rotated"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, unnest(['flag', 'status']) AS label, unnest([l_returnflag, l_linestatus]) AS text FROM lineitem")
def texts_by_label(spark, sf_dir):
    """Texts of a record by label, as rows."""
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber", "l_partkey"], [F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")], "label", "text")


# by policy: 0 append, 1 upsert, 2 upsert with no-op
@query(_DUCK + """SELECT event_id, p.policy, CASE WHEN p.policy = 0 THEN NULL WHEN idx = 1 THEN 'Add' WHEN p.policy = 2 AND NOT changed THEN 'Noop' ELSE 'Update' END AS operation,
 CASE WHEN p.policy > 0 AND idx > 1 AND NOT (p.policy = 2 AND NOT changed) THEN 'mem_0001' END AS target FROM e, (SELECT unnest([0, 1, 2]) AS policy) p""")
def reference_operations(spark, sf_dir):
    """The operation that each policy asks for at an event, and its canonical target."""
    e = indexed(spark, sf_dir).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("policy"))
    kind = F.when(F.col("idx") == 1, "Add").when((F.col("policy") == 2) & ~F.col("changed"), "Noop").otherwise("Update")
    e = e.withColumn("operation", F.when(F.col("policy") > 0, kind))
    return e.select("event_id", "policy", "operation", F.when(F.col("operation") == "Update", memory.entry_id(F.lit(1))).alias("target"))
