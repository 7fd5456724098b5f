"""Normalisation, strict parsing and scoring of replies.

Replies are made from the tables in every form that is to be told apart; the oracles
name the expected outcome of each form, they do not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import strict, text
from palimpsest.plans.events import _DUCK, indexed
from palimpsest.plans.registry import query, table

_FOLD = "replace(lower({}), 'ß', 'ss')"


def _digest(docs: DataFrame, c: Column) -> DataFrame:
    return docs.select("doc_id", F.sha2(c, 256).alias("norm_sha256"), F.char_length(c).cast("bigint").alias("chars"))


def _marked(spark, sf_dir) -> DataFrame:
    """Documents between decomposed and compatibility characters."""
    d = table(spark, sf_dir, "documents")
    return d.withColumn("text", F.concat(F.lit(" Café ﬁ\t"), F.coalesce("text", F.lit("")), F.lit("\n\nSTRASSE  ")))


_MARKED = "(SELECT doc_id, {} || coalesce(text, '') || chr(10) || chr(10) || 'STRASSE  ' AS text FROM documents)"
_ENDS = "regexp_replace(regexp_replace(text, '^[\\t-\\r\\x1c- ]+', ''), '[\\t-\\r\\x1c- ]+$', '')"
_ONE = "regexp_replace(" + _ENDS + ", '[\\t-\\r\\x1c- ]+', ' ', 'g')"


def _normalized(first: str, form: str) -> str:
    return f"SELECT doc_id, sha256(n) AS norm_sha256, CAST(length(n) AS BIGINT) AS chars FROM (SELECT doc_id, {_FOLD.format(f'nfc_normalize({form})')} AS n FROM {_MARKED.format(first)})"


@query(_normalized("' Café fi' || chr(9)", _ONE))
def normalized_answer(spark, sf_dir):
    return _digest(_marked(spark, sf_dir), text.normalize_answer(F.col("text")))


@query(_normalized("' Café fi' || chr(9)", _ONE))
def normalized_check(spark, sf_dir):
    return _digest(_marked(spark, sf_dir), text.normalize_check(F.col("text")))


@query(_normalized("' Café fi' || chr(9)", _ENDS))
def normalized_strip(spark, sf_dir):
    return _digest(_marked(spark, sf_dir), text.normalize_strip(F.col("text")))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all({_FOLD.format('nfc_normalize(text)')}, '[\\p{{L}}\\p{{N}}\\p{{Mn}}_]+') AS w FROM documents WHERE text IS NOT NULL)")
def unicode_words(spark, sf_dir):
    w = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.unicode_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


@query("SELECT event_id, event_id % 4 < 2 AS held, event_id % 4 = 1 AS overlapping FROM events")
def expression_bounds(spark, sf_dir):
    """Whole expressions (in other case; equal), a part of a word, and one word too many."""
    said = F.concat(F.lit("The (État) of "), "event_type", F.lit(", now."))
    form = F.col("event_id") % 4
    wanted = F.when(form == 0, F.concat(F.lit("éTAT)  of "), F.upper("event_type"))).when(form == 1, said)
    wanted = wanted.when(form == 2, F.expr("substr(event_type, 1, 2)")).otherwise(F.concat("event_type", F.lit(" later")))
    back = text.contains_expression(wanted, said)
    held = text.contains_expression(said, wanted)
    return table(spark, sf_dir, "events").select("event_id", held.alias("held"), (back & held).alias("overlapping"))


def _replied(spark, sf_dir) -> DataFrame:
    """Events with a reply in one of twelve forms."""
    v = F.col("event_type")
    quoted = F.concat(F.lit('{"answer": "'), v, F.lit('"}'))
    forms = [
        quoted, F.concat(F.lit('{"answer": " '), F.upper(v), F.lit('\\t"}')), F.lit(None).cast("string"), F.concat(F.lit("```json\n"), quoted, F.lit("\n```")), F.concat(quoted, F.lit(" thanks")),
        F.lit('{"answer": "x", "answer": "y"}'), F.lit('{"answer": NaN}'), F.concat(F.lit('{"Answer": "'), v, F.lit('"}')),
        F.concat(F.lit('{"answer": "'), v, F.lit('", "why": {}}')), F.concat(F.lit('["'), v, F.lit('"]')), F.lit('{"answer": " \\n"}'), F.lit('{"answer": 7}'),
    ]
    raw = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        raw = F.when(F.col("event_id") % len(forms) == k, form).otherwise(raw)
    return table(spark, sf_dir, "events").withColumn("parsed", strict.parse_strict(raw))


_ERRORS = "CASE WHEN event_id % 12 < 2 THEN NULL WHEN event_id % 12 = 2 THEN 'no_content' WHEN event_id % 12 < 7 THEN 'not_json' WHEN event_id % 12 < 10 THEN 'wrong_fields' ELSE 'blank_or_non_string_answer' END"


@query(f"SELECT event_id, {_ERRORS} AS error, CASE event_id % 12 WHEN 0 THEN event_type WHEN 1 THEN ' ' || upper(event_type) || chr(9) END AS answer FROM events")
def answer_parse(spark, sf_dir):
    error = strict.answer_error(F.col("parsed"))
    return _replied(spark, sf_dir).select("event_id", error.alias("error"), F.when(error.isNull(), F.col("parsed")["texts"]["answer"]).alias("answer"))


@query("SELECT event_id, event_id % 12 NOT BETWEEN 2 AND 6 AS strict, CAST(CASE event_id % 12 WHEN 8 THEN 2 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 9 THEN NULL ELSE 1 END AS BIGINT) AS n_keys FROM events")
def strict_json(spark, sf_dir):
    p = F.col("parsed")
    return _replied(spark, sf_dir).select("event_id", F.coalesce(p["valid"], F.lit(False)).alias("strict"), F.when(p["keys"].isNotNull(), F.size(p["keys"])).cast("bigint").alias("n_keys"))


@query("""WITH d AS (SELECT event_id, event_id % 3 AS policy, event_id % 11 AS form FROM events)
SELECT event_id, CASE form WHEN 0 THEN 'no_content' WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_json' WHEN 3 THEN 'wrong_fields' WHEN 4 THEN 'operation_not_available'
 WHEN 5 THEN CASE WHEN policy = 0 THEN 'operation_not_available' ELSE 'update_requires_nonempty_target_id' END WHEN 6 THEN CASE WHEN policy = 0 THEN 'operation_not_available' ELSE 'update_requires_nonempty_target_id' END
 WHEN 7 THEN 'target_id_must_be_null' WHEN 8 THEN CASE WHEN policy < 2 THEN 'operation_not_available' END WHEN 9 THEN CASE WHEN policy = 0 THEN 'operation_not_available' END END AS reason FROM d""")
def decision_validate(spark, sf_dir):
    """Decisions of three policies (add; add and update; add, update and no-op)."""
    open_ = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("Add"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("Add"), F.lit("Update"))).otherwise(F.array(F.lit("Add"), F.lit("Update"), F.lit("Noop")))
    forms = (
        None, "Add", '{"operation": "Add", "operation": "Add", "target_id": null}', '{"operation": "Add"}', '{"operation": ["Add"], "target_id": null}',
        '{"operation": "Update", "target_id": " "}', '{"operation": "Update", "target_id": null}', '{"operation": "Add", "target_id": "mem_0001"}',
        '{"operation": "Noop", "target_id": null}', '{"operation": "Update", "target_id": "mem_0001"}', '{"target_id": null, "operation": "Add"}',
    )
    raw = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % len(forms) + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", open_.alias("open"), strict.parse_strict(raw).alias("parsed"))
    return e.select("event_id", strict.decision_error(F.col("parsed"), F.col("open")).alias("reason"))


@query(_DUCK + """, l AS (SELECT user_id, max_by(event_type, idx) AS cur, count(DISTINCT event_type) AS n FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 5 < 2 THEN 'CURRENT_CORRECT' WHEN user_id % 5 = 2 AND n > 1 THEN 'STALE_ERROR' ELSE 'OTHER_ERROR' END AS class,
 CASE WHEN user_id % 5 < 2 THEN 'equals_current_target' WHEN user_id % 5 = 2 AND n > 1 THEN 'equals_superseded_target' WHEN user_id % 5 = 4 THEN 'wrong_fields' ELSE 'not_a_target_value' END AS reason,
 user_id % 5 = 0 AS raw_exact_match FROM l""")
def reply_classification(spark, sf_dir):
    """Whole-value equality after normalisation: current, else superseded, else other."""
    e = indexed(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "idx").alias("cur"), F.collect_set("event_type").alias("known"))
    old = F.array_sort(F.array_except("known", F.array("cur")))
    form = F.col("user_id") % 5
    said = F.when(form == 0, F.col("cur")).when(form == 1, F.concat(F.lit(" "), F.upper("cur"))).when((form == 2) & (F.size(old) > 0), F.upper(F.get(old, F.lit(0)))).otherwise(F.concat("cur", F.lit(".")))
    raw = F.to_json(F.when(form == 4, F.create_map(F.lit("reply"), said)).otherwise(F.create_map(F.lit("answer"), said)))
    e = e.select("user_id", "cur", old.alias("old"), strict.parse_strict(raw).alias("parsed"))
    e = e.withColumn("answer", F.col("parsed")["texts"]["answer"]).withColumn("error", strict.answer_error(F.col("parsed")))
    e = e.withColumn("n", text.normalize_answer(F.col("answer")))
    current = F.col("n") == text.normalize_answer(F.col("cur"))
    stale = F.array_contains(F.transform("old", lambda v: F.lower(v)), F.col("n"))  # event types are ASCII words
    label = F.when(F.col("error").isNull() & current, "CURRENT_CORRECT").when(F.col("error").isNull() & stale, "STALE_ERROR").otherwise("OTHER_ERROR")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(current, "equals_current_target").when(stale, "equals_superseded_target").otherwise("not_a_target_value")
    return e.select("user_id", label.alias("class"), reason.alias("reason"), F.coalesce(F.col("error").isNull() & (F.col("answer") == F.col("cur")), F.lit(False)).alias("raw_exact_match"))
