"""Word-bounded containment between two text columns: by an automaton over the needles, or,
where these are too many to send to every worker, as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import expressions

#: Words of a join key.
KEY_WORDS = 4


def fold(text: Column) -> Column:
    """Lower case; all but a-z and 0-9 become single spaces; spaces at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def contained(needles: DataFrame, hay: DataFrame, needle_id: str, hay_id: str, text: str = "text") -> DataFrame:
    """Distinct (needle_id, hay_id) where the folded hay holds the folded needle, word-bounded.
    Needles without a word match nothing."""
    n = needles.select(needle_id, fold(F.col(text)).alias("needle")).filter("needle != '  '")
    if expressions.text_bytes(n, "needle") > expressions.INVENTORY_BYTES:
        return contained_by_join(needles, hay, needle_id, hay_id, text)
    listed = sorted(r.needle for r in n.select("needle").distinct().collect())
    place = n.sparkSession.createDataFrame(list(enumerate(listed)), "_k long, needle string")
    # spaces at both ends are the bounds
    folded = expressions.spread(hay.select(hay_id, text)).select(hay_id, fold(F.col(text)).alias("hay"))
    found = expressions.scan(folded, "hay", listed, bounded=False)
    return found.join(n.join(place, "needle").select("_k", needle_id), "_k").select(needle_id, hay_id).distinct()


def contained_by_join(needles: DataFrame, hay: DataFrame, needle_id: str, hay_id: str, text: str = "text") -> DataFrame:
    """contained() for any number of needles. A needle's first words are its key; the hay's
    runs of as many words meet it by an equi-join, so no text meets every other."""
    n = needles.select(needle_id, fold(F.col(text)).alias("needle")).withColumn("words", F.split(F.trim("needle"), " ")).filter("needle != '  '")
    h = hay.select(hay_id, fold(F.col(text)).alias("hay")).withColumn("words", F.split(F.trim("hay"), " "))
    pairs = None
    for size, mine in ((KEY_WORDS, F.size("words") >= KEY_WORDS), (1, F.size("words") < KEY_WORDS)):
        keyed = n.filter(mine).select(needle_id, F.xxhash64(F.array_join(F.slice("words", 1, size), " ")).alias("key"))
        runs = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), _run(size))
        # keys alone travel; texts are fetched once for the pairs that meet
        grams = h.filter(F.size("words") >= size).select(hay_id, F.explode(F.array_distinct(runs)).alias("key"))
        met = grams.join(keyed, "key").select(needle_id, hay_id)
        pairs = met if pairs is None else pairs.unionByName(met)
    both = pairs.distinct().join(n.select(needle_id, "needle"), needle_id).join(h.select(hay_id, "hay"), hay_id)
    return both.filter(F.col("hay").contains(F.col("needle"))).select(needle_id, hay_id).distinct()


def _run(size: int):
    return lambda i: F.xxhash64(F.array_join(F.slice("words", i, size), " "))
