"""Validators, set algebra, journals and replay over the given tables.

Each query is DataFrame code; its oracle is SQL written another way.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions.times import rfc3339_valid
from palimpsest.operators import memory
from palimpsest.plans.events import _DUCK, indexed
from palimpsest.plans.registry import query, table


@query("SELECT doc_id, text IS NOT NULL AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') AS non_blank, text IS NOT NULL AND position(chr(10) IN text) = 0 AND text = regexp_replace(text, '[ \\t\\n\\r\\f\\v]+$', '') AS single_line FROM documents")
def text_guards(spark, sf_dir):
    """Non-blank texts, and those of one line without trailing white space (null: neither)."""
    d = table(spark, sf_dir, "documents")
    no = F.lit(False)
    line = ~F.col("text").contains("\n") & ~F.col("text").rlike("[ \\t\\n\\r\\f\\x0B]$")
    return d.select("doc_id", F.coalesce(F.col("text").rlike("[^ \\t\\n\\r\\f\\x0B]"), no).alias("non_blank"), F.coalesce(line, no).alias("single_line"))


@query("SELECT 'mem_' || c_custkey AS id, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders) GROUP BY 1 HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    """Ids that occur more than once over two sources."""
    ids = table(spark, sf_dir, "customer").select("c_custkey").unionByName(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))
    return ids.groupBy("c_custkey").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("mem_"), F.col("c_custkey").cast("string")).alias("id"), "n")


_VALUES = "WITH v AS (SELECT DISTINCT user_id, event_type FROM events), c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS cur FROM events GROUP BY user_id) "


@query(_VALUES + "SELECT v.user_id, string_agg(v.event_type, ',' ORDER BY v.event_type) AS superseded FROM v JOIN c ON v.user_id = c.user_id WHERE v.event_type <> c.cur GROUP BY v.user_id")
def known_minus_current(spark, sf_dir):
    """Set difference: a run's known values without the current one."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("known"), F.max_by("event_type", F.struct("ts", "event_id")).alias("cur"))
    rest = F.array_sort(F.array_except("known", F.array("cur")))
    return e.filter(F.size(rest) > 0).select("user_id", F.array_join(rest, ",").alias("superseded"))


@query("""SELECT a.lang AS lang1, b.lang AS lang2, count(*) AS common FROM (SELECT DISTINCT lang, source FROM documents) a JOIN (SELECT DISTINCT lang, source FROM documents) b ON a.source = b.source AND a.lang < b.lang GROUP BY 1, 2""")
def set_intersections(spark, sf_dir):
    """Sizes of the intersections of the languages' source sets; none where disjoint."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    one = s.select("langs", F.explode("langs").alias("lang1"))
    return one.select("lang1", F.explode("langs").alias("lang2")).filter("lang1 < lang2").groupBy("lang1", "lang2").agg(F.count("*").alias("common"))


@query("SELECT user_id, (SELECT count(*) FROM (SELECT DISTINCT event_type FROM events e WHERE e.user_id = u.user_id AND event_type NOT IN (SELECT event_type FROM events WHERE user_id % 2 = 0))) = 0 AS subset FROM (SELECT DISTINCT user_id FROM events) u")
def subset_test(spark, sf_dir):
    """Whether each run's values are a subset of those of the even runs."""
    e = table(spark, sf_dir, "events")
    ref = e.filter("user_id % 2 = 0").select("event_type").distinct().withColumn("there", F.lit(1))
    own = e.select("user_id", "event_type").distinct().join(ref, "event_type", "left")
    return own.groupBy("user_id").agg(F.bool_and(F.col("there").isNotNull()).alias("subset"))


@query(_DUCK + """SELECT a.user_id, a.event_id, (SELECT string_agg(x.event_type, ',' ORDER BY x.event_type) FROM (SELECT DISTINCT b.event_type FROM e b WHERE b.user_id = a.user_id AND b.idx <= a.idx) x) AS state FROM e a""")
def state_after_each_event(spark, sf_dir):
    """The keyed memory's keys after each event."""
    order = Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return indexed(spark, sf_dir).select("user_id", "event_id", F.array_join(F.array_sort(F.collect_set("event_type").over(order)), ",").alias("state"))


@query(_DUCK + """, s AS (SELECT *, (SELECT count(DISTINCT b.event_type) FROM e b WHERE b.user_id = e.user_id AND b.idx < e.idx) AS pre, (SELECT count(DISTINCT b.event_type) FROM e b WHERE b.user_id = e.user_id AND b.idx <= e.idx) AS post FROM e)
SELECT user_id, event_id, pre AS pre_size, post AS post_size, CASE WHEN post > pre THEN 'add' WHEN changed THEN 'update' ELSE 'noop' END AS transition,
 printf('mem_%04d', (SELECT min(b.idx) FROM e b WHERE b.user_id = s.user_id AND b.event_type = s.event_type)) AS canonical_target FROM s""")
def journal(spark, sf_dir):
    """A row per event: size of the state before and after, transition, canonical target
    (the entry that the event's key was born as)."""
    born = F.min("idx").over(Window.partitionBy("user_id", "event_type"))
    run = Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    j = indexed(spark, sf_dir).withColumn("born", born).withColumn("new", (F.col("born") == F.col("idx")).cast("bigint"))
    j = j.withColumn("post_size", F.sum("new").over(run))
    kind = F.when(F.col("new") == 1, "add").when(F.col("changed"), "update").otherwise("noop")
    return j.select("user_id", "event_id", (F.col("post_size") - F.col("new")).alias("pre_size"), "post_size", kind.alias("transition"), memory.entry_id(F.col("born")).alias("canonical_target"))


@query(_DUCK + """, h AS (SELECT a.user_id, a.event_id, (SELECT string_agg(b.prev, ',' ORDER BY b.idx) FROM e b WHERE b.user_id = a.user_id AND b.changed AND b.idx > 1 AND b.idx <= a.idx) AS history FROM e a)
SELECT user_id, event_id, coalesce(history, '') AS history FROM h""")
def superseded_at_event(spark, sf_dir):
    """The superseded values of a run, in order, as they stand at each event."""
    run = Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    old = F.collect_list(F.when(F.col("changed") & (F.col("idx") > 1), F.col("prev"))).over(run)
    return indexed(spark, sf_dir).select("user_id", "event_id", F.array_join(old, ",").alias("history"))


_REPLAY = """, m AS (SELECT user_id, min(ts) AS created, max(CASE WHEN changed THEN ts END) AS updated, max_by(event_type, idx) AS text FROM e GROUP BY user_id)
SELECT user_id, 'MATCH' AS outcome FROM m"""


@query(_DUCK + _REPLAY)
def replay_state(spark, sf_dir):
    """Replay of recorded decisions through execute() against the policy's own state."""
    e = indexed(spark, sf_dir)
    first = e.filter("idx = 1").select(F.col("user_id").alias("run"), F.lit("mem_0001").alias("entry_id"), "idx", F.col("event_type").alias("text"))
    steps = e.filter("idx > 1").select(F.col("user_id").alias("run"), "idx", memory.entry_id(F.col("idx")).alias("entry_id"), F.when(F.col("changed"), "Update").otherwise("Noop").alias("op"), F.lit("mem_0001").alias("target"), F.col("event_type").alias("text"))
    replayed = memory.execute(first, steps)[0]
    at = e.select(F.col("user_id").alias("run"), F.col("idx").alias("updated_idx"), F.col("ts").alias("updated_ts"))
    own = memory.upsert_noop(e, "user_id", "event_type", "ts")
    both = own.join(replayed.join(at, ["run", "updated_idx"]).withColumnRenamed("text", "replayed"), F.col("user_id") == F.col("run"), "full")
    same = F.col("text").eqNullSafe(F.col("replayed")) & F.col("updated").eqNullSafe(F.col("updated_ts"))
    return both.select("user_id", F.when(same, "MATCH").otherwise("MISMATCH").alias("outcome"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS semantic_time, event_id % 3 <> 0 AS valid FROM events")
def rfc3339_validity(spark, sf_dir):
    """Timestamps with an offset parse; those without (every third here) do not count."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(F.col("event_id") % 3 == 0, iso).otherwise(F.concat(iso, F.lit("Z")))
    ok = rfc3339_valid(given)
    return table(spark, sf_dir, "events").select("event_id", F.concat(iso, F.lit("Z")).alias("semantic_time"), ok.alias("valid"))


@query("SELECT l_orderkey, bool_and(l_returnflag <> 'R') AND count(*) >= 3 AS passed, CASE WHEN count(*) < 3 THEN 'INCOMPLETE' WHEN bool_or(l_returnflag = 'R') THEN 'FAILED' ELSE 'PASSED' END AS status FROM lineitem GROUP BY l_orderkey")
def final_status(spark, sf_dir):
    """Complete (three units at least) and all passed."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    status = F.when(F.col("n") < 3, "INCOMPLETE").when(F.col("bad") > 0, "FAILED").otherwise("PASSED")
    return s.select("l_orderkey", ((F.col("n") >= 3) & (F.col("bad") == 0)).alias("passed"), status.alias("status"))


@query("SELECT l_orderkey, l_partkey, l_returnflag AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_returnflag DESC) AS r FROM lineitem) WHERE r = 1")
def last_wins_lookup(spark, sf_dir):
    """Of several records of a key the last one counts."""
    last = F.max(F.struct("l_linenumber", "l_suppkey", "l_returnflag"))["l_returnflag"]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(last.alias("accepted"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY role) AS roles, count(*) FILTER (WHERE role = 'user') = count(*) FILTER (WHERE role = 'assistant') AS balanced FROM conversations GROUP BY conv_id""")
def role_multiset(spark, sf_dir):
    """The multiset of roles of each history, and whether its exchanges are whole."""
    roles = F.array_sort(F.collect_list("role"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(roles, ",").alias("roles"), (F.count_if(F.col("role") == "user") == F.count_if(F.col("role") == "assistant")).alias("balanced"))


@query("SELECT label, count(DISTINCT d) = 1 AS converged, count(*) AS members FROM (SELECT label, len(embedding) AS d FROM embeddings) GROUP BY label")
def group_convergence(spark, sf_dir):
    """Whether all members of a group agree."""
    v = table(spark, sf_dir, "embeddings").select("label", F.size("embedding").alias("d"))
    return v.groupBy("label").agg((F.min("d") == F.max("d")).alias("converged"), F.count("*").alias("members"))


@query("SELECT label, round(sum(x) / greatest(sum(m), 1), 6) AS pooled FROM (SELECT label, embedding[1] * (vec_id % 2) AS x, vec_id % 2 AS m FROM (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS e1, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)) GROUP BY label")
def masked_mean_pooling(spark, sf_dir):
    """Mean over the members that a mask (odd ids) keeps; 0 where it keeps none."""
    v = table(spark, sf_dir, "embeddings").select("label", (F.col("embedding")[0].cast("double") * (F.col("vec_id") % 2)).alias("x"), (F.col("vec_id") % 2).alias("m"))
    return v.groupBy("label").agg(F.round(F.sum("x") / F.greatest(F.sum("m"), F.lit(1)), 6).alias("pooled"))
