"""Mixing sources to target weights by a low-discrepancy schedule, built-in functions only.

A source's documents, in a shuffled order, are one stream of words, repeated up to
EPOCHS times and cut into blocks of equal size. Points of the golden ratio's
sequence, mapped through the cumulative targets, give each slot of the mix its source;
a source's slots, ranked, take its blocks in turn. So every stretch of the mix holds
the sources close to their shares. What a source's slots leave over follows at the end,
so that it gives its target to the word.

Orders over all sources, all slots or the documents of one source are cut into slices, so
that a source with a third of all rows is many tasks' work.
"""

from __future__ import annotations

from math import floor, log, sqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, running, sliced, stage

#: How often a document may be taken; weights of the sources, repeating in their order.
EPOCHS, WEIGHTS = 3, (1, 2, 3)
#: The fraction of the golden ratio.
GOLDEN = 0.6180339887498949
#: Blocks of a mix of as many words squared: their number grows with the root of the mix.
BLOCKS = 16
#: Rows of a slice.
ROWS = 1 << 14


def _total(df: DataFrame, *columns: str) -> list[int]:
    return [x or 0 for x in df.agg(*[F.sum(c) for c in columns]).first()]


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, weight, source_size, target, need) of each source of sizes (source,
    size): all words shared by weight, no source above EPOCHS times its size, what that
    leaves over shared by weight again until none is above. need: target in whole words.

    In the order of size by weight the sources that stop at their size are a prefix, and a
    running sum tells where it ends: a source stops if it is below its share of what
    the sources before it leave. A null source is a source like others, the last."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running(sliced(own, "sources", *order, rows=ROWS), [], order, {"rank": F.lit(1)})
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int")).cast("bigint")
    ranked = ranked.drop("_slice").withColumn("weight", weight).withColumn("most", EPOCHS * F.col("source_size"))
    common = 1
    for w in WEIGHTS:
        common *= w
    ratio = [(F.col("most") * F.expr(f"{common} div weight")), F.col("rank")]
    ranked = stage(ranked, "ranked")
    words, weights = _total(ranked, "source_size", "weight")
    filled = running(sliced(ranked, "ratios", *ratio, rows=ROWS), [], ratio, {"given": F.col("most"), "counted": F.col("weight")}).drop("_slice")
    exact = lambda c: c.cast("decimal(38,0)")
    stops = exact(F.col("most")) * exact(F.lit(weights) - F.col("counted")) < exact(F.lit(words) - F.col("given")) * exact(F.col("weight"))
    filled = stage(filled.withColumn("stops", stops), "stops")
    given, counted = _total(filled.filter("stops"), "most", "weight")
    share = F.lit(float(words - given)) / F.lit(float(max(1, weights - counted)))
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(share * F.col("weight"))
    filled = filled.withColumn("target", target)
    need = F.least(F.floor(F.col("target") + 0.5), F.col("most"))
    return filled.select("source", F.col("rank").cast("bigint").alias("rank"), "weight", "source_size", "target", need.alias("need"))


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """(slot, rank, turn): the source of each slot, and which of that source's slots it is.
    plan has rank and need of each source."""
    spark = plan.sparkSession
    (words,) = _total(plan, "need")
    slots = -(-words // block)
    ends = running(sliced(plan.select("rank", "need"), "ends", F.col("rank"), rows=ROWS), [], [F.col("rank")], {"low": F.col("need")})
    # a source begins at its lowest word: of those at the same word the last has words
    marks = ends.filter("need > 0").select((F.col("low") / F.lit(float(max(1, words)))).alias("x"), F.col("rank"), F.lit(None).cast("bigint").alias("slot"))
    turned = F.col("id") * F.lit(GOLDEN)
    points = spark.range(slots).select((turned - F.floor(turned)).alias("x"), F.lit(None).cast("bigint").alias("rank"), F.col("id").alias("slot"))
    bins = max(1, slots // ROWS)
    every = marks.unionByName(points).withColumn("_slice", F.floor(F.col("x") * bins))
    # the last source that begins at or before a point: ranks rise with x
    at = Window.partitionBy("_slice").orderBy("x", F.col("rank").isNull(), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = every.groupBy("_slice").agg(F.max("rank").alias("most")).select("_slice", F.max("most").over(before).alias("least"))
    placed = every.withColumn("here", F.max("rank").over(at)).join(first, "_slice").filter("slot is not null")
    placed = placed.select("slot", F.coalesce("here", "least").alias("rank"), (F.col("slot") / ROWS).cast("bigint").alias("_slice"))
    return running(placed, ["rank"], [F.col("slot")], {"turn": F.lit(1)}).drop("_slice")


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of docs (doc_id, text, source).

    documents: doc_id, size (words of the text; null text: 0), source_size and target of
    its source, rank of the source, at (where the document stands in its source's stream).
    pieces: rank, at, slot of the mix, start and length in words, one row for each block
    and each time that a document is taken; a document that is not taken has none.

    Documents without words are kept and take no part; repeated rows are documents of their
    own; rows with a null id are shuffled by their text; other columns are ignored; an
    empty table gives no rows."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACE[1:-1]}]+"), F.lit(0))).cast("bigint")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    sizes = stage(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "sizes")
    plan = stage(source_targets(sizes), "plan")
    (words,) = _total(plan, "source_size")
    block = max(1, floor(sqrt(words) / BLOCKS))
    digits = max(0, -int(-log(max(1, sizes.count()) / ROWS, 16) // 1))
    own = plan.withColumnRenamed("source", "_source")
    keyed = sizes.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_slice", F.substring("key", 1, digits))
    documents = running(keyed, ["rank"], [F.col("key"), F.col("doc_id"), F.col("size")], {"at": F.col("size")}).select("doc_id", "size", "source_size", "target", "rank", "need", "at")
    documents = stage(documents, "streams")
    taken = documents.filter("size > 0 and at < need")
    epochs = F.sequence(F.lit(0).cast("bigint"), F.expr("(need - 1 - at) div source_size"))
    copies = taken.select("*", F.explode(epochs).alias("epoch")).withColumn("low", F.col("epoch") * F.col("source_size") + F.col("at"))
    copies = copies.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("need")))
    turns = F.sequence(F.expr(f"low div {block}"), F.expr(f"(high - 1) div {block}"))
    parts = copies.select("*", F.explode(turns).alias("turn"))
    start = F.greatest(F.col("low"), F.col("turn") * block)
    length = F.least(F.col("high"), (F.col("turn") + 1) * block) - start
    parts = parts.select("rank", "at", "turn", (start - F.col("low")).alias("start"), length.alias("length"))
    # blocks that no slot takes follow all slots
    slot = F.coalesce("slot", F.lit(-(-_total(plan, "need")[0] // block)) + F.col("turn"))
    return documents, parts.join(schedule(plan, block), ["rank", "turn"], "left").select("rank", "at", slot.alias("slot"), "start", "length")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot (of the mix; null where
    nothing is taken) of each document, by mix()."""
    documents, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sums = pieces.groupBy("rank", "at").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    # documents without words share their place with the next one that has some
    place = [(F.col("size") > 0).alias("_has")]
    joined = documents.select("*", *place).join(sums.withColumn("_has", F.lit(True)), ["rank", "at", "_has"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot")
