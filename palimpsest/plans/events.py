"""Versioned-state queries over events: run = user_id, value = event_type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import memory
from palimpsest.plans.registry import query, sql, table

_IDX = """WITH i AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS idx,
 lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}),
 e AS (SELECT *, idx = 1 OR event_type IS DISTINCT FROM prev AS changed FROM i) """
_DUCK = _IDX.replace("{events}", "events")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.indexed(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query(_DUCK + "SELECT user_id, event_id, idx FROM e")
def event_index(spark, sf_dir):
    return indexed(spark, sf_dir).select("user_id", "event_id", "idx")


@query(_DUCK + "SELECT user_id, event_id, prev FROM e")
def prev_value(spark, sf_dir):
    return indexed(spark, sf_dir).select("user_id", "event_id", "prev")


@query(_DUCK + "SELECT user_id, created, updated, text FROM (SELECT user_id, min(ts) AS created, max(ts) AS updated, max_by(event_type, idx) AS text FROM e GROUP BY user_id)")
def state_m2(spark, sf_dir):
    return memory.upsert(indexed(spark, sf_dir), "user_id", "event_type", "ts")


_M3 = _DUCK + "SELECT user_id, min(ts) AS created, max(CASE WHEN changed THEN ts END) AS updated, max_by(event_type, idx) AS text FROM e GROUP BY user_id"


@query(_M3)
def state_m3(spark, sf_dir):
    return memory.upsert_noop(indexed(spark, sf_dir), "user_id", "event_type", "ts")


@query(_DUCK + "SELECT user_id, printf('mem_%04d', idx) AS entry_id, ts AS created, ts AS updated, event_type AS text FROM e")
def state_m1(spark, sf_dir):
    return memory.append(indexed(spark, sf_dir), "user_id", "event_type", "ts")


sql("semantics_label", _IDX + "SELECT event_id, CASE WHEN idx = 1 THEN 'initial' WHEN changed THEN 'changed' ELSE 'same' END AS label FROM e")
sql("no_return_violations", _IDX + """, c AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY idx) AS seen FROM e WHERE changed)
SELECT user_id, event_id, event_type, CAST(seen AS BIGINT) AS seen FROM c WHERE seen > 1""")


@query(_DUCK + "SELECT user_id, count(*) AS n_superseded, string_agg(prev, ',' ORDER BY idx) AS history FROM e WHERE changed AND idx > 1 GROUP BY user_id")
def superseded_history(spark, sf_dir):
    rows = indexed(spark, sf_dir).filter("changed and idx > 1")
    listed = F.array_sort(F.collect_list(F.struct("idx", "prev")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_superseded"), F.array_join(F.transform(listed, lambda x: x["prev"]), ",").alias("history"))


@query(_DUCK + """, d AS (SELECT user_id, CAST(ts AS DATE) AS day, max_by(event_type, idx) AS v FROM e GROUP BY 1, 2),
 b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
 s AS (SELECT user_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT s.user_id, CAST(s.day AS VARCHAR) AS day, last_value(v IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.day) AS state FROM s LEFT JOIN d ON s.user_id = d.user_id AND s.day = d.day""")
def state_asof(spark, sf_dir):
    days = indexed(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max_by("event_type", "idx").alias("v"))
    spine = days.groupBy("user_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return spine.join(days, ["user_id", "day"], "left").select("user_id", F.col("day").cast("string").alias("day"), F.expr("last(v, true) OVER (PARTITION BY user_id ORDER BY day)").alias("state"))


sql("memory_trajectory", _IDX + """, b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY idx) AS nth FROM e)
SELECT user_id, idx, idx AS m1_size, CAST(sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS keyed_size FROM b""")
sql("memory_size", "SELECT user_id, count(*) AS entries, count(DISTINCT event_type) AS keyed_entries, CAST(sum(length(event_type)) AS BIGINT) AS text_chars FROM {events} GROUP BY user_id")


@query(_DUCK + """, k AS (SELECT user_id, event_type, min(idx) AS born, min(ts) AS created, max(ts) AS updated FROM e GROUP BY 1, 2)
SELECT user_id, string_agg('[memory_id=' || printf('mem_%04d', born) || '; created=' || strftime(created, '%Y-%m-%dT%H:%M:%SZ') || '; updated=' || strftime(updated, '%Y-%m-%dT%H:%M:%SZ') || '] ' || event_type, chr(10) ORDER BY updated, created, born) AS block FROM k GROUP BY user_id""")
def serialized_memory(spark, sf_dir):
    keyed = indexed(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("idx").alias("born"), F.min("ts").alias("created"), F.max("ts").alias("updated"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.format_string("[memory_id=%s; created=%s; updated=%s] %s", memory.entry_id(F.col("born")), iso("created"), iso("updated"), "event_type")
    rows = F.array_sort(F.collect_list(F.struct("updated", "created", "born", line.alias("line"))))
    return keyed.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("block"))


sql("revision_intensity_buckets", _IDX + """, n AS (SELECT user_id, count(*) FILTER (WHERE changed AND idx > 1) AS changes FROM e GROUP BY user_id)
SELECT CASE WHEN changes <= 1 THEN 'low' WHEN changes <= 4 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS users, CAST(sum(changes) AS BIGINT) AS changes FROM n GROUP BY 1""")

_DECIDED = _IDX + """, d AS (SELECT user_id AS run, idx, @ENTRYidx) AS entry_id, event_type AS text,
 CASE WHEN idx <= 2 THEN 'Initial' WHEN event_id % 4 = 0 THEN 'Add' WHEN event_id % 4 = 3 THEN 'Noop' ELSE 'Update' END AS op,
 @ENTRYevent_id % 7 + 1) AS target FROM e) """
_BORN = """, born AS (SELECT run, entry_id, idx, text FROM d WHERE op IN ('Initial', 'Add')),
 u AS (SELECT d.*, b.idx AS born FROM d LEFT JOIN born b ON d.run = b.run AND d.target = b.entry_id WHERE op = 'Update') """


def _decided(spark, sf_dir):
    decided = spark.sql(_DECIDED.replace("@ENTRY", "format_string('mem_%04d', ") + "SELECT * FROM d", events=table(spark, sf_dir, "events"))
    return memory.execute(decided.filter("op = 'Initial'"), decided.filter("op != 'Initial'"))


_DUCK_DECIDED = _DECIDED.replace("@ENTRY", "printf('mem_%04d', ").replace("{events}", "events") + _BORN


@query(_DUCK_DECIDED + """, x AS (SELECT run, target, max(idx) AS at, max_by(text, idx) AS t FROM u WHERE born < idx GROUP BY 1, 2)
SELECT b.run, b.entry_id, b.idx AS created_idx, coalesce(x.at, b.idx) AS updated_idx, coalesce(x.t, b.text) AS text FROM born b LEFT JOIN x ON b.run = x.run AND b.entry_id = x.target""")
def decisions_executed(spark, sf_dir):
    return _decided(spark, sf_dir)[0]


@query(_DUCK_DECIDED + "SELECT run, target, idx, entry_id FROM u WHERE born IS NULL OR born >= idx")
def target_errors(spark, sf_dir):
    return _decided(spark, sf_dir)[2].select("run", "target", "idx", "entry_id")


_OPS = _IDX + """, o AS (SELECT *, CASE WHEN idx = 1 THEN 'Add' WHEN changed THEN 'Update' ELSE 'Noop' END AS ref_op,
 CASE WHEN event_id % 5 = 0 THEN 'Add' WHEN event_id % 5 = 1 THEN 'Noop' ELSE 'Update' END AS op, event_id % 3 <> 0 AS right_target FROM e) """
sql("moa_diagnostics", _OPS + "SELECT user_id, count(*) AS decisions, count(*) FILTER (WHERE ref_op = op) AS matches, round(count(*) FILTER (WHERE ref_op = op) / CAST(count(*) AS DOUBLE), 6) AS moa FROM o GROUP BY user_id")
sql("update_target_accuracy", _OPS + """SELECT user_id, count(*) FILTER (WHERE ref_op = 'Update' AND op = 'Update') AS eligible,
 round(count(*) FILTER (WHERE ref_op = 'Update' AND op = 'Update' AND right_target) / CAST(nullif(count(*) FILTER (WHERE ref_op = 'Update' AND op = 'Update'), 0) AS DOUBLE), 6) AS accuracy FROM o GROUP BY user_id""")

# answers: by run the current value (in other case and spacing), a near miss, an older
# value, or none
_ANSWERS = _DUCK + """, l AS (SELECT user_id, max_by(event_type, idx) AS cur, max(idx) AS n FROM e GROUP BY user_id),
 a AS (SELECT l.user_id, l.cur, CASE l.user_id % 4 WHEN 0 THEN '  ' || upper(l.cur) || ' ' WHEN 1 THEN l.cur || '.' WHEN 2 THEN e.event_type END AS answer FROM l LEFT JOIN e ON e.user_id = l.user_id AND e.idx = l.n - 2),
 s AS (SELECT a.user_id, a.answer, CASE WHEN lower(trim(a.answer)) = lower(a.cur) THEN 'CURRENT_CORRECT'
  WHEN EXISTS (SELECT 1 FROM e WHERE e.user_id = a.user_id AND lower(e.event_type) = lower(trim(a.answer))) THEN 'STALE_ERROR' ELSE 'OTHER_ERROR' END AS class FROM a) """


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current, stale (a superseded value, after folding case and white space), or other."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    e = indexed(spark, sf_dir)
    runs = e.groupBy("user_id").agg(F.max_by("event_type", "idx").alias("cur"), F.max("idx").alias("n"), F.collect_set(fold("event_type")).alias("known"))
    old = e.select("user_id", F.col("idx").alias("n2"), F.col("event_type").alias("old"))
    runs = runs.withColumn("n2", F.col("n") - 2).join(old, ["user_id", "n2"], "left")
    kind = F.col("user_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("  "), F.upper("cur"), F.lit(" "))).when(kind == 1, F.concat("cur", F.lit("."))).when(kind == 2, F.col("old"))
    runs = runs.withColumn("answer", answer)
    stale = F.array_contains(F.array_except("known", F.array(fold("cur"))), fold("answer"))
    name = F.when(fold("answer") == fold("cur"), "CURRENT_CORRECT").when(stale, "STALE_ERROR").otherwise("OTHER_ERROR")
    return runs.select("user_id", "answer", name.alias("class"))


@query(_ANSWERS + "SELECT user_id, answer, class FROM s")
def answer_classification(spark, sf_dir):
    return _classified(spark, sf_dir)


@query(_ANSWERS + "SELECT count(*) AS answers, round(avg(CAST(class = 'CURRENT_CORRECT' AS INT)), 6) AS csa, round(avg(CAST(class = 'STALE_ERROR' AS INT)), 6) AS srr FROM s")
def csa_srr(spark, sf_dir):
    share = lambda name: F.round(F.avg((F.col("class") == name).cast("double")), 6)
    return _classified(spark, sf_dir).agg(F.count("*").alias("answers"), share("CURRENT_CORRECT").alias("csa"), share("STALE_ERROR").alias("srr"))


sql("candidate_render_roundtrip", """WITH c AS (SELECT event_id, 'For user ' || CAST(user_id AS VARCHAR(20)) || ', the event type is ' || event_type || '.' AS text, event_type FROM {events})
SELECT event_id, text, regexp_extract(text, '^For (.+?), the (.+?) is (.+)[.]$', 3) AS value, regexp_extract(text, '^For (.+?), the (.+?) is (.+)[.]$', 3) = event_type AS round_trip FROM c""")


@query("SELECT event_id, coalesce(len(json_keys(props)) = 1 AND json_keys(props)[1] = 'k', false) AS closed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def strict_props_json(spark, sf_dir):
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select(
        "event_id", F.coalesce((F.size(keys) == 1) & (keys[0] == "k"), F.lit(False)).alias("closed"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k")
    )


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def leaf_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


sql("stale_pairs", _IDX + """, v AS (SELECT user_id, event_type, max(idx) AS last_idx FROM e GROUP BY 1, 2)
SELECT o.user_id, o.event_type AS stale, n.event_type AS current_value FROM v o JOIN v n ON o.user_id = n.user_id AND o.event_type <> n.event_type AND o.last_idx < n.last_idx""")
