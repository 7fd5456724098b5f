"""Context selection with counters that do not add up, over conversations.

The template opens a history that does not begin with the user by a turn of its own, so a
longer suffix may count less; and its marks join the words at the ends of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.tokens import ChatTemplate, History, Lines, Pattern
from palimpsest.operators import windows
from palimpsest.plans.registry import query, table

SYSTEM, OPENING = "Answer from what was said.", "(earlier turns are left out of this window on purpose)"
#: Tokens of a window, and of an answer's context; best entries of a ranking.
BUDGET, CONTEXT, TOP = 120, 150, 4
CHAT = History(Pattern(), ChatTemplate(opening=OPENING), SYSTEM)

_COUNT = "len(regexp_extract_all(x, '[^ \\t\\n\\x0B\\f\\r]+'))"
_HISTORY = f"""WITH m AS (SELECT conv_id, turn, role, '<|' || coalesce(role, '') || '|>' || coalesce(text, '') || '<|end|>' AS said FROM conversations),
 g AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos, string_agg(said, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS body FROM m),
 c AS (SELECT *, '<|system|>{SYSTEM}<|end|>' AS base, CASE WHEN role IS DISTINCT FROM 'user' THEN '<|user|>{OPENING}<|end|>' ELSE '' END || body AS rest FROM g),
 s AS (SELECT conv_id, turn, role, pos, CAST({_COUNT.replace("x,", "base || rest,")} - {_COUNT.replace("x,", "base,")} AS BIGINT) AS used FROM c),
 o AS (SELECT *, coalesce(min(CASE WHEN used > {BUDGET} THEN pos END) OVER (PARTITION BY conv_id), 1000000) AS ended FROM s) """


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))


@query(_HISTORY + f"SELECT conv_id, count(*) FILTER (WHERE pos < ended) AS admitted, coalesce(max(CASE WHEN pos = ended - 1 OR (ended = 1000000 AND turn = first) THEN used END), 0) AS used, min(turn) FILTER (WHERE pos < ended) AS last_admitted, min(ended) = 1 AS overflow FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM o) GROUP BY conv_id")
def chat_window(spark, sf_dir):
    return windows.select_window(turns(spark, sf_dir), "conv_id", "turn", "messages", CHAT, BUDGET)


@query(_HISTORY + "SELECT conv_id, CASE WHEN n >= 2 THEN required END AS required FROM (SELECT conv_id, max(used) FILTER (WHERE turn >= oldest) AS required, min(n) AS n FROM (SELECT *, count(*) FILTER (WHERE role = 'user' AND turn < 4) OVER w AS n, min(CASE WHEN role = 'user' AND turn < 4 THEN turn END) OVER w AS oldest FROM s WINDOW w AS (PARTITION BY conv_id)) GROUP BY conv_id)")
def chat_required_budget(spark, sf_dir):
    """Two user turns among the first four must stay in the window."""
    wanted = F.coalesce((F.col("role") == "user") & (F.col("turn") < 4), F.lit(False))
    return windows.required_budget(turns(spark, sf_dir), "conv_id", "turn", "messages", CHAT, wanted, least=2)


@query(_HISTORY + "SELECT conv_id, turn, used, used - next AS cheaper FROM (SELECT *, lag(used) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM s) WHERE used < next")
def cheaper_suffixes(spark, sf_dir):
    """Suffixes that count less than the one which is a turn shorter."""
    grown = windows.growing(turns(spark, sf_dir), "conv_id", "turn", "messages", CHAT, True)
    shorter = F.lag("used").over(Window.partitionBy("conv_id").orderBy("units"))
    return grown.withColumn("next", shorter).filter("used < next").select("conv_id", "turn", "used", (F.col("used") - F.col("next")).alias("cheaper"))


_ENTRIES = """WITH e AS (SELECT conv_id, turn, '[memory_id=' || conv_id || '-' || turn || '; role=' || role || '] ' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS pos FROM conversations),
 p AS (SELECT *, string_agg(line, chr(10) ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS x FROM e WHERE pos <= {top}),
 u AS (SELECT conv_id, turn, line, pos, CAST({count} AS BIGINT) AS used FROM p),
 a AS (SELECT *, coalesce(min(CASE WHEN used > {budget} THEN pos END) OVER (PARTITION BY conv_id), 1000000) AS ended FROM u),
 k AS (SELECT conv_id, count(*) FILTER (WHERE pos < ended) AS admitted, coalesce(max(used) FILTER (WHERE pos < ended), 0) AS used, max(pos) FILTER (WHERE pos < ended) AS last_admitted, min(ended) = 1 AS overflow FROM a GROUP BY conv_id),
 f AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS x FROM a WHERE pos < ended GROUP BY conv_id) """.format(top=TOP, budget=CONTEXT, count=_COUNT)


@query(_ENTRIES + f"SELECT k.*, CAST({_COUNT} AS BIGINT) AS final_used FROM k LEFT JOIN f USING (conv_id)")
def context_admission(spark, sf_dir):
    """The longest turns of a conversation as memory entries: a rank prefix is admitted, then
    counted again in the order of time."""
    best = Window.partitionBy("conv_id").orderBy(F.char_length("text").desc(), "turn")
    line = F.concat(F.lit("[memory_id="), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("; role="), F.col("role"), F.lit("] "), F.col("text"))
    ranked = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"), F.row_number().over(best).cast("bigint").alias("pos"))
    kept = windows.admit_prefix(ranked, "conv_id", "pos", "line", Lines(Pattern()), CONTEXT, TOP)
    final = ranked.join(kept.select("conv_id", "last_admitted"), "conv_id").filter(F.col("pos") <= F.col("last_admitted"))
    final = windows.measured(final, "conv_id", "turn", "line", Lines(Pattern())).select("conv_id", F.col("used").alias("final_used"))
    return kept.join(final, "conv_id", "left")
