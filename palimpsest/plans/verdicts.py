"""Validators, text checks and adjudication: findings as rows, verdicts as folds of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.plans.events import _DUCK, indexed
from palimpsest.plans.registry import query, table


@query(_DUCK + """, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY idx) AS seen FROM e WHERE changed)
SELECT user_id, 'returns' AS rule, count(*) AS n FROM s WHERE seen > 1 GROUP BY user_id
UNION ALL SELECT user_id, 'short', 1 FROM e GROUP BY user_id HAVING count(*) < 8
UNION ALL SELECT user_id, 'never_reaffirmed', 1 FROM e GROUP BY user_id HAVING bool_and(changed)
UNION ALL SELECT user_id, 'coverage', 1 FROM e GROUP BY user_id HAVING count(DISTINCT event_type) < 5""")
def trajectory_findings(spark, sf_dir):
    """Rules over each run in one pass: values that return, too few events, no event that
    reaffirms, values that are not covered. No row: no finding."""
    per = indexed(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count_if("changed").alias("changes"), F.count("*").alias("n"))
    runs = per.groupBy("user_id").agg(F.sum(F.greatest(F.col("changes") - 1, F.lit(0))).alias("returns"), F.sum("n").alias("n"), F.sum("changes").alias("changes"), F.count("*").alias("kinds"))
    mark = lambda c: c.cast("bigint")
    rules = runs.select(
        "user_id", mark(F.col("returns")).alias("returns"), mark(F.col("n") < 8).alias("short"), mark(F.col("changes") == F.col("n")).alias("never_reaffirmed"), mark(F.col("kinds") < 5).alias("coverage")
    )
    return rules.unpivot("user_id", ["returns", "short", "never_reaffirmed", "coverage"], "rule", "n").filter("n > 0")


@query(_DUCK + """SELECT event_id, CASE WHEN event_id % 6 = 0 AND prev IS NOT NULL THEN 'previous' WHEN event_id % 6 = 1 THEN 'semantics' ELSE 'ok' END AS finding FROM e""")
def reference_truth(spark, sf_dir):
    """Previous value and kind of change as stated (some wrongly) against the recomputed ones."""
    e = indexed(spark, sf_dir)
    stated_prev = F.when(F.col("event_id") % 6 == 0, F.lit(None)).otherwise(F.col("prev"))
    stated_change = F.when(F.col("event_id") % 6 == 1, ~F.col("changed")).otherwise(F.col("changed"))
    finding = F.when(~stated_prev.eqNullSafe(F.col("prev")), "previous").when(~stated_change.eqNullSafe(F.col("changed")), "semantics").otherwise("ok")
    return e.select("event_id", finding.alias("finding"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'wrong_value' WHEN o_orderkey % 5 = 1 THEN 'missing_value' WHEN o_orderkey % 5 = 2 THEN 'review_overlap' ELSE 'pass' END AS finding FROM orders""")
def text_semantics(spark, sf_dir):
    """A rendered text must hold its value and no other value of the inventory; one that
    overlaps with its own value is left to a review."""
    o = table(spark, sf_dir, "orders").withColumn("value", F.lower("o_orderpriority"))
    inventory = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*")).agg(F.collect_list(F.lower("o_orderpriority")).alias("v")).scalar()
    o = o.withColumn("inventory", inventory)
    values = F.concat("inventory", F.array(F.concat("value", F.lit(" again"))))
    o = o.withColumn("other", F.element_at(F.filter("inventory", lambda v: v != F.col("value")), 1))
    kind = F.col("o_orderkey") % 5
    said = F.when(kind == 0, F.concat_ws(" and ", "value", "other")).when(kind == 1, F.lit("none of it")).when(kind == 2, F.concat("value", F.lit(" AGAIN"))).otherwise(F.concat(F.lit("It is "), F.col("value"), F.lit(".")))
    o = o.withColumn("said", F.concat(F.lit(" "), F.lower(said), F.lit(" "))).withColumn("others", F.filter(values, lambda v: (v != F.col("value")) & F.col("said").contains(v)))
    clash = F.exists("others", lambda v: ~v.contains(F.col("value")))
    finding = F.when(~F.col("said").contains(F.col("value")), "missing_value").when(clash, "wrong_value").when(F.size("others") > 0, "review_overlap").otherwise("pass")
    return o.select("o_orderkey", finding.alias("finding"))


@query("""SELECT p_partkey, named, valued, named AND valued AS passed FROM (
 SELECT p_partkey, p_partkey % 4 <> 1 AS named, p_partkey % 4 <> 2 OR list_contains(string_split(lower(p_name), ' '), lower(p_type)) AS valued FROM part)""")
def fact_checks(spark, sf_dir):
    """Whether a text holds its entity and its value, as whole expressions (a cut-off value
    counts where the entity's own name holds the whole of it)."""
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 1, F.concat("p_name", F.lit("s"))).otherwise(F.upper("p_name"))
    value = F.when(kind == 2, F.expr("substr(p_type, 1, 3)")).otherwise(F.lower("p_type"))
    said = F.concat(name, F.lit(" – "), value, F.lit("."))
    named, valued = text.contains_expression(said, F.col("p_name")), text.contains_expression(said, F.col("p_type"))
    p = table(spark, sf_dir, "part").select("p_partkey", named.alias("named"), valued.alias("valued"))
    return p.withColumn("passed", F.col("named") & F.col("valued"))


@query(_DUCK + """, n AS (SELECT user_id, count(DISTINCT lower(event_type)) AS d, count(DISTINCT event_type) AS c FROM e GROUP BY user_id)
SELECT user_id, d = c AND user_id % 9 <> 0 AS distinct_values FROM n""")
def distinct_values(spark, sf_dir):
    """Current and superseded values stay apart after normalisation (every ninth run gets
    its first value a second time, in other case)."""
    v = indexed(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("v"))
    v = v.withColumn("v", F.when(F.col("user_id") % 9 == 0, F.concat("v", F.array(F.concat(F.lit("  "), F.upper(F.element_at("v", 1)))))).otherwise(F.col("v")))
    each = v.select("user_id", F.explode("v").alias("value")).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(text.normalize_answer(F.col("value"))).alias("d"))
    return each.select("user_id", (F.col("n") == F.col("d")).alias("distinct_values"))


@query(_DUCK + """SELECT a.event_id, a.idx AS position, a.event_type = b.event_type AS same FROM e a JOIN e b ON b.user_id = a.user_id + 1 AND b.idx = a.idx WHERE a.user_id % 2 = 0""")
def variants_at_position(spark, sf_dir):
    """Whether two variants of a run (an even and the next odd one) agree, position by position."""
    e = indexed(spark, sf_dir).withColumn("run", F.floor(F.col("user_id") / 2)).withColumn("odd", F.col("user_id") % 2 == 1)
    one, two = e.filter("not odd"), e.filter("odd").select("run", "idx", F.col("event_type").alias("other"))
    return one.join(two, ["run", "idx"]).select("event_id", F.col("idx").alias("position"), (F.col("event_type") == F.col("other")).alias("same"))


@query("""WITH a AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, coalesce(n, 0) AS archived, coalesce(n, 0) = 4 AS complete, least(coalesce(n, 0), 4) AS zipped FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def positional_zip(spark, sf_dir):
    """Plan and archive by position: as much as there is of both, and whether it is all."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("calls"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("calls", F.coalesce("calls", F.slice("calls", 1, 0), F.expr("array()")))
    both = F.arrays_zip(F.sequence(F.lit(1), F.lit(4)).alias("plan"), F.col("calls"))
    whole = F.filter(both, lambda x: x["plan"].isNotNull() & x["calls"].isNotNull())
    return o.select("o_orderkey", F.size("calls").cast("bigint").alias("archived"), (F.size("calls") == 4).alias("complete"), F.size(whole).cast("bigint").alias("zipped"))


_V1 = "(SELECT doc_id, CASE WHEN quality = 1 THEN 'PASS' WHEN quality = 0 THEN 'FAIL' END AS summary FROM labels)"


@query(f"""SELECT doc_id, cell, CASE WHEN summary = 'PASS' THEN 'PASS' END AS value, summary = 'FAIL' AS listed FROM {_V1}, (SELECT unnest(['identity', 'meaning']) AS cell) WHERE summary IS NOT NULL""")
def summary_to_cells(spark, sf_dir):
    """A passed summary passes both cells that it stands for; a failed one leaves them open
    and is listed for a decision."""
    v1 = table(spark, sf_dir, "labels").filter("quality is not null").withColumn("summary", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL"))
    cells = v1.select("doc_id", "summary", F.explode(F.array(F.lit("identity"), F.lit("meaning"))).alias("cell"))
    return cells.select("doc_id", "cell", F.when(F.col("summary") == "PASS", "PASS").alias("value"), (F.col("summary") == "FAIL").alias("listed"))


@query("""SELECT d.source, string_agg(CASE WHEN l.quality = 0 THEN CAST(d.doc_id AS VARCHAR) END, ',' ORDER BY d.doc_id) AS failures, coalesce(bool_or(l.quality = 0), false) = false AS eligible, count(*) FILTER (WHERE l.toxic = 1) AS fluency_notes FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def suffix_adjudication(spark, sf_dir):
    """Failures listed; eligible without any; findings of the second level are counted only."""
    cells = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    out = cells.groupBy("source").agg(F.array_sort(F.collect_list(F.when(F.col("quality") == 0, F.col("doc_id")))).alias("f"), F.count_if(F.col("toxic") == 1).alias("fluency_notes"))
    return out.select("source", F.when(F.size("f") > 0, F.array_join(F.col("f").cast("array<string>"), ",")).alias("failures"), (F.size("f") == 0).alias("eligible"), "fluency_notes")


@query("""WITH s AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS bad, count(DISTINCT l_linenumber) AS covered, bool_and(l_linestatus = 'F') AS reviewed FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN bad THEN 'INELIGIBLE' WHEN covered < 3 THEN 'INCOMPLETE' WHEN NOT reviewed THEN 'PENDING_REVIEW' ELSE 'ELIGIBLE' END AS status FROM s""")
def eligibility(spark, sf_dir):
    """Semantics, then coverage, then review."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("bad"), F.size(F.collect_set("l_linenumber")).alias("covered"), F.min(F.col("l_linestatus") == "F").alias("reviewed"))
    return s.select("l_orderkey", F.when(F.col("bad") > 0, "INELIGIBLE").when(F.col("covered") < 3, "INCOMPLETE").when(~F.col("reviewed"), "PENDING_REVIEW").otherwise("ELIGIBLE").alias("status"))


@query("""WITH b AS (SELECT c_nationkey, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) SELECT c_nationkey, most AS budget, c_nationkey % 3 <> 0 AS bound FROM b""")
def budget_binding(spark, sf_dir):
    """A frozen budget is bound if it equals the largest of the rows that it came from."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    b = rows.groupBy("c_nationkey").agg(F.max("o_totalprice").alias("budget"), F.max(F.when(F.col("c_nationkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).alias("frozen"))
    return b.select("c_nationkey", "budget", (F.col("budget") == F.col("frozen")).alias("bound"))


@query("""SELECT event_id, event_id % 10 NOT IN (3, 4) AS passed FROM events""")
def expected_outputs(spark, sf_dir):
    """Outputs against exactly what each fixture expects; one that is absent fails."""
    e = table(spark, sf_dir, "events")
    out = e.filter("event_id % 10 != 3").select("event_id", F.when(F.col("event_id") % 10 == 4, F.concat("event_type", F.lit(" "))).otherwise(F.col("event_type")).alias("output"))
    return e.select("event_id", "event_type").join(out, "event_id", "left").select("event_id", F.col("event_type").eqNullSafe(F.col("output")).alias("passed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 4 = 0 THEN 'unplanned' ELSE 'covered' END AS review FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) UNION ALL
SELECT o_orderkey, 0, 0, 'missing' FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 4 = 1""")
def review_coverage(spark, sf_dir):
    """A review must cover exactly the replayed rows: rows of it beside those, and rows it lacks."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    reviewed = table(spark, sf_dir, "lineitem").select(*key).distinct().withColumn("r", F.lit(1))
    extra = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(0).cast("bigint").alias("l_partkey"))
    replayed = reviewed.drop("r").filter("l_orderkey % 4 != 0").unionByName(extra).withColumn("p", F.lit(1))
    return reviewed.join(replayed, key, "full").select(*key, F.when(F.col("p").isNull(), "unplanned").when(F.col("r").isNull(), "missing").otherwise("covered").alias("review"))


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS held, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 10 AS coverage_failure FROM events""")
def window_coverage(spark, sf_dir):
    """A window of the ten newest events; a run's first event outside it is a coverage failure."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(order).cast("bigint").alias("idx"))
    return e.select("user_id", "event_id", F.least("idx", F.lit(10)).cast("bigint").alias("held"), (F.col("idx") > 10).alias("coverage_failure"))
