"""Context selection: recent windows over conversations, top-k over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import similarity
from palimpsest.plans.registry import query, sql, table

#: Tokens of a context, neighbours kept, and the share that must be retained.
BUDGET, TOP, GATE = 150, 10, "0.95"


def tokens(text):
    return F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("bigint")


def suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns newest first: pos, and used: the tokens of the suffix that starts there."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens("text").alias("tokens"))
    return df.withColumn("pos", F.row_number().over(newest)).withColumn("used", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0)))


_SUFFIX = """WITH t AS (SELECT conv_id, turn, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS BIGINT) AS tokens FROM conversations),
 s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM t) """

sql("history_exchanges", """WITH n AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM {conversations})
SELECT conv_id, turn, text AS question, reply FROM n WHERE role = 'user' AND next_role = 'assistant'""")


@query(_SUFFIX + f"SELECT conv_id, count(*) FILTER (WHERE used <= {BUDGET}) AS admitted, max(CASE WHEN used <= {BUDGET} THEN used END) AS used, count(*) FILTER (WHERE used <= {BUDGET}) = 0 AS overflow FROM s GROUP BY conv_id")
def recent_window(spark, sf_dir):
    """Sizes only add, so the first overflow and every longer suffix fail together."""
    fits = F.col("used") <= BUDGET
    return suffix(spark, sf_dir).groupBy("conv_id").agg(F.count_if(fits).alias("admitted"), F.max(F.when(fits, F.col("used"))).alias("used"), (F.count_if(fits) == 0).alias("overflow"))


_REQUIRED = _SUFFIX + ", r AS (SELECT conv_id, max(used) AS required FROM s WHERE pos <= 2 GROUP BY conv_id) "


def required(spark, sf_dir):
    return suffix(spark, sf_dir).filter("pos <= 2").groupBy("conv_id").agg(F.max("used").alias("required"))


@query(_REQUIRED + "SELECT conv_id, required FROM r")
def required_budget(spark, sf_dir):
    return required(spark, sf_dir)


@query(_REQUIRED + "SELECT max(required) AS budget, count(*) AS histories FROM r")
def exact_max_budget(spark, sf_dir):
    return required(spark, sf_dir).agg(F.max("required").alias("budget"), F.count("*").alias("histories"))


@query(_REQUIRED + "SELECT conv_id, required FROM r WHERE required = (SELECT max(required) FROM r)")
def budget_argmax_ties(spark, sf_dir):
    r = required(spark, sf_dir)
    return r.join(r.agg(F.max("required").alias("required")), "required", "left_semi").select("conv_id", "required")


@query(_REQUIRED + ", b AS (SELECT unnest([25, 50, 100, 150, 200, 400]) AS budget) SELECT CAST(budget AS BIGINT) AS budget, count(*) FILTER (WHERE required <= budget) AS retained, round(count(*) FILTER (WHERE required <= budget) / CAST(count(*) AS DOUBLE), 6) AS fraction FROM r, b GROUP BY 1")
def retained_fraction_by_budget(spark, sf_dir):
    grid = F.explode(F.array(*[F.lit(b).cast("bigint") for b in (25, 50, 100, 150, 200, 400)])).alias("budget")
    return required(spark, sf_dir).select("required", grid).groupBy("budget").agg(
        F.count_if(F.col("required") <= F.col("budget")).alias("retained"), F.round(F.avg((F.col("required") <= F.col("budget")).cast("double")), 6).alias("fraction")
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TOP nearest vectors of each query vector (ids divisible by 100), by cosine,
    ties by the hash of the id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    near = similarity.top_k(v, v.filter("id % 100 = 0"), TOP)
    label = lambda name, to: v.select(F.col("id").alias(name), F.col("label").alias(to))
    both = near.withColumnsRenamed({"query": "q", "row": "vec_id"}).join(label("q", "q_label"), "q").join(label("vec_id", "label"), "vec_id")
    return both.select("q", "q_label", "vec_id", "label", "score", "pos")


_RANKED = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 n AS (SELECT *, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS norm FROM v),
 p AS (SELECT a.vec_id AS q, a.label AS q_label, b.vec_id, b.label, list_dot_product(b.e, a.e) / (b.norm * a.norm) AS score FROM n a, n b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, sha256(CAST(vec_id AS VARCHAR))) AS pos FROM p),
 r AS (SELECT * FROM k WHERE pos <= {TOP}) """


@query(_RANKED + "SELECT q, CAST(pos AS BIGINT) AS pos, vec_id, round(score, 6) AS score FROM r")
def cosine_topk(spark, sf_dir):
    return ranked(spark, sf_dir).select("q", F.col("pos").cast("bigint").alias("pos"), "vec_id", F.round("score", 6).alias("score"))


_COST = "CAST(10 + label * 7 AS BIGINT)"
_ADMIT = f", a AS (SELECT *, CAST(sum({_COST}) OVER (PARTITION BY q ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM r) "


def admitted(spark, sf_dir):
    """Running size in rank order: admission stops at the first entry that overflows."""
    run = Window.partitionBy("q").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return ranked(spark, sf_dir).withColumn("used", F.sum(F.expr(_COST)).over(run))


@query(_RANKED + _ADMIT + "SELECT q, count(*) FILTER (WHERE used <= 120) AS admitted, string_agg(CASE WHEN used <= 120 THEN CAST(vec_id AS VARCHAR) END, ',' ORDER BY pos) AS ids FROM a GROUP BY q")
def prefix_admission(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.when(F.col("used") <= 120, F.struct("pos", F.col("vec_id").cast("string").alias("id")))))
    ids = F.array_join(F.transform(rows, lambda x: x["id"]), ",")
    return admitted(spark, sf_dir).groupBy("q").agg(F.count_if(F.col("used") <= 120).alias("admitted"), F.when(ids != "", ids).alias("ids"))


_GRID = ", g AS (SELECT unnest([1, 3, 5, 10]) AS k), o AS (SELECT g.k, q, bool_or(label = q_label AND pos <= g.k) AS hit FROM a, g GROUP BY 1, 2), f AS (SELECT CAST(k AS BIGINT) AS k, count(*) FILTER (WHERE hit) AS successes, count(*) AS queries FROM o GROUP BY 1) "


def by_k(spark, sf_dir):
    grid = F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 3, 5, 10)])).alias("k")
    hits = admitted(spark, sf_dir).select("q", "label", "q_label", "pos", grid).groupBy("k", "q").agg(F.bool_or((F.col("label") == F.col("q_label")) & (F.col("pos") <= F.col("k"))).alias("hit"))
    return hits.groupBy("k").agg(F.count_if("hit").alias("successes"), F.count("*").alias("queries"))


@query(_RANKED + _ADMIT + _GRID + "SELECT k, successes, queries, successes * 100 >= 95 * queries AS passes FROM f")
def retention_by_k(spark, sf_dir):
    return by_k(spark, sf_dir).withColumn("passes", F.col("successes") * 100 >= F.lit(95) * F.col("queries"))


@query(_RANKED + _ADMIT + _GRID + "SELECT min(k) FILTER (WHERE successes * 100 >= 20 * queries) AS min_k FROM f")
def min_k(spark, sf_dir):
    return by_k(spark, sf_dir).agg(F.min(F.when(F.col("successes") * 100 >= F.lit(20) * F.col("queries"), F.col("k"))).alias("min_k"))


_BUDGETS = ", b AS (SELECT unnest([40, 80, 160, 320]) AS budget), ob AS (SELECT budget, q, bool_or(label = q_label AND used <= budget) AS hit FROM a, b GROUP BY 1, 2), fb AS (SELECT CAST(budget AS BIGINT) AS budget, count(*) FILTER (WHERE hit) AS successes, count(*) AS queries FROM ob GROUP BY 1) "


def by_budget(spark, sf_dir):
    grid = F.explode(F.array(*[F.lit(k).cast("bigint") for k in (40, 80, 160, 320)])).alias("budget")
    hits = admitted(spark, sf_dir).select("q", "label", "q_label", "used", grid).groupBy("budget", "q").agg(F.bool_or((F.col("label") == F.col("q_label")) & (F.col("used") <= F.col("budget"))).alias("hit"))
    return hits.groupBy("budget").agg(F.count_if("hit").alias("successes"), F.count("*").alias("queries"))


@query(_RANKED + _ADMIT + _BUDGETS + "SELECT budget, successes, queries FROM fb")
def budget_grid(spark, sf_dir):
    return by_budget(spark, sf_dir)


@query(_RANKED + _ADMIT + _BUDGETS + "SELECT min(budget) FILTER (WHERE successes * 100 >= 20 * queries) AS min_budget FROM fb")
def min_budget(spark, sf_dir):
    return by_budget(spark, sf_dir).agg(F.min(F.when(F.col("successes") * 100 >= F.lit(20) * F.col("queries"), F.col("budget"))).alias("min_budget"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite, len(list_filter(embedding, lambda x: x <> 0)) > 0 AS non_zero FROM embeddings")
def vector_validity(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size("embedding").cast("bigint").alias("dim"), F.forall("embedding", lambda x: F.abs(x) < float("inf")).alias("finite"), F.exists("embedding", lambda x: x != 0).alias("non_zero")
    )
