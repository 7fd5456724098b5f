"""Quality rules: hashed n-gram log-likelihood ratio (built-in functions only).

Words and word pairs of all documents are hashed into buckets and counted twice: in the
raw corpus, and in the trusted target (documents whose label says quality 1). A
document's score is the mean over its n-grams of log (target count + 1) / (expected
target count + 1), where the expected count is the bucket's raw count at the target's
share; each n-gram is taken out of the counts that it is held against. A document is
kept when its score reaches the cut and the base rules hold; the cut is the score that
all but a fixed share of the trusted documents reach, so it means the same at every
size. Everything is deterministic.

The number of buckets grows with the corpus, as GROWTH times the cube root of the number
of its n-grams: 2^18 for 0.1 GB, 2^24 (128 MB of counts) for 100 TB. The counts go to the
tasks as two arrays, so no document's n-grams are shuffled: only each task's own sums are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import dense, perhaps_in, stage, words

#: Buckets for each cube root of the number of n-grams; rounded up to a power of two.
GROWTH = 256
#: Added to an n-gram's target count and to its expected one.
SMOOTHING = 1.0
#: Share of the trusted documents (of 20 words on) below the cut.
LOST = 0.02
#: Steps of 1 in which scores are ranked for the cut, and compared with it.
STEPS = 1_000_000
#: Result columns.
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _pairs(h: Column, step: int) -> Column:
    """Hashes of h[i] with h[i + step], for each i that has both."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def with_ngrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _w (words), _h1 (word hashes) and _h2 (word pair hashes)."""
    df = docs.withColumn("_w", words(F.col(text)))
    df = df.withColumn("_h1", F.transform("_w", lambda w: F.xxhash64(w)))
    return df.withColumn("_h2", _pairs(F.col("_h1"), 1))


def _covered(df: DataFrame) -> DataFrame:
    """df with n_repeat_words: the words in 8-word windows that occur twice or more.

    A window's hash is built by doubling (1, 2, 4, 8 words); only texts in which a
    window repeats are sorted."""
    df = df.withColumn("_h4", _pairs(F.col("_h2"), 2))
    df = df.withColumn("_h8", _pairs(F.col("_h4"), 4))
    df = df.withColumn("_rep", F.size("_h8") != F.size(F.array_distinct("_h8")))
    by_hash = F.when(F.col("_rep"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", by_hash)
    equal = lambda j, k: F.coalesce(F.get(F.col("_s"), j)["h"] == F.get(F.col("_s"), k)["h"], F.lit(False))
    df = df.withColumn("_p", F.filter("_s", lambda x, j: equal(j, j - 1) | equal(j, j + 1)))
    df = df.withColumn("_p", F.sort_array(F.transform("_p", lambda x: x["i"])))
    gaps = F.zip_with(F.col("_p"), F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8))))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, g: acc + g)
    return df.withColumn("n_repeat_words", F.when(F.col("_rep"), total).otherwise(F.lit(0).cast("bigint")))


def _base(df: DataFrame) -> DataFrame:
    """df (with text, and no other column of these names) with the base columns."""
    full = F.coalesce(F.col("text"), F.lit(""))
    df = with_ngrams(df)
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("_lines", lines)
    df = df.withColumn("n_words", F.size("_w").cast("bigint"))
    df = df.withColumn("word_chars", F.char_length(F.translate(full, " \t\n\x0b\x0c\r", "")).cast("bigint"))
    df = df.withColumn("n_symbols", (F.char_length(full) - F.char_length(F.translate(full, "#*$%&|<>", ""))).cast("bigint"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
    df = _covered(df)
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def base_rules(docs: DataFrame) -> DataFrame:
    """docs' columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long) and base_failed.

    A null or empty text has zeros and fails; repeated rows each keep their row; columns
    of docs with a result's name are replaced, all others, whatever their names, stay; an
    empty table gives no rows; a very long text is one row, counted whole."""
    kept = [c for c in docs.columns if c not in OWN[:6]]
    df = _base(docs.select(F.struct(*kept).alias("row"), "text"))
    return df.select("row.*", *OWN[:6])


def buckets_for(n: int) -> int:
    """Number of buckets for a corpus of n n-grams."""
    return 1 << max(10, (int(GROWTH * max(n, 1) ** (1 / 3)) - 1).bit_length())


def ngram_model(docs: DataFrame, good: DataFrame, perhaps: Column, buckets: int, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: log ratios by bucket, held against an n-gram of a trusted document (inside)
    and of any other (outside). docs: doc_id, text; good: distinct doc_ids of the trusted
    target; perhaps: true for these at least."""
    trusted = docs.filter(perhaps).join(good.hint("merge"), "doc_id", "left_semi")

    def counted(df: DataFrame, name: str) -> DataFrame:
        # outer, since the other would be given a filter that writes all expressions out again
        grams = with_ngrams(df.select("text")).select(F.explode_outer(F.concat("_h1", "_h2")).alias("h"))
        slots = grams.select(F.pmod("h", F.lit(buckets)).alias("slot")).filter("slot is not null")
        return slots.groupBy("slot").agg(F.count("*").alias(name))

    zero = F.lit(0).cast("bigint")
    both = counted(docs, "raw").withColumn("target", zero).unionByName(counted(trusted, "target").withColumn("raw", zero))
    total = lambda c: F.aggregate(c, zero, lambda a, x: a + x)
    counts = dense(both, buckets, "raw", "target").withColumn("n_raw", total("raw")).withColumn("n_target", total("target"))
    other = lambda n: F.greatest(n - 1, zero)

    def ratios(own: bool) -> Column:
        share = F.when(F.col("n_raw") > 1, (other(F.col("n_target")) if own else F.col("n_target")) / other(F.col("n_raw"))).otherwise(F.lit(0.0))
        return F.zip_with("raw", "target", lambda r, t: F.log(((other(t) if own else t) + smoothing) / (other(r) * share + smoothing)).cast("float"))

    return stage(counts.select(ratios(True).alias("inside"), ratios(False).alias("outside")), "model")


def _scored(df: DataFrame, model: DataFrame, perhaps: Column, buckets: int) -> DataFrame:
    """df (with _h1 and _h2) with its scores, _in as a trusted document (null where it
    cannot be one) and _out as any other.

    Each array is named once, so that it is looked up where it lies and no row carries it."""
    n = F.size("_h1") + F.size("_h2")

    def mean(array: str) -> Column:
        total = F.aggregate(F.concat("_h1", "_h2"), F.lit(0.0), lambda acc, h: acc + F.get(F.col(array), F.pmod(h, F.lit(buckets)).cast("int")).cast("double"))
        return F.when(n > 0, total / n).otherwise(F.lit(0.0))

    df = df.withColumn("_outside", model.select("outside").scalar()).withColumn("_out", mean("_outside")).drop("_outside")
    df = df.withColumn("_perhaps", perhaps)
    return df.withColumn("_inside", model.select("inside").scalar()).withColumn("_in", F.when(F.col("_perhaps"), mean("_inside"))).drop("_inside")


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int | None = None, smoothing: float = SMOOTHING, lost: float = LOST, text: bool = True) -> DataFrame:
    """docs' columns (without text if so asked) with the base columns, llr (mean log
    ratio per n-gram, 0 where there is none) and kept.

    Nulls: a null text counts as empty (failed, not kept), a null id is not trusted and
    nor is one whose label is null. A label that repeats counts once. Repeated rows each
    get their own row, and are each other's evidence. Without a trusted document the cut is
    0 and every score is 0 or above it. A score that equals the cut is kept. Columns of docs
    with a result's name are replaced, all others, whatever their names, stay. An empty
    table gives no rows. A very long text is one row, scored whole."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    plain = docs.select("doc_id", "text")
    if buckets is None:
        # words and pairs are about two for each run of white space
        words_about = F.char_length(F.col("text")) - F.char_length(F.translate("text", " \n\t", "")) + 1
        buckets = buckets_for(2 * (plain.agg(F.sum(words_about.cast("bigint"))).first()[0] or 0))
    perhaps = perhaps_in(good, "doc_id")
    model = ngram_model(plain, good, perhaps, buckets, smoothing)
    carried = [c for c in docs.columns if c not in OWN and (text or c != "text")]
    df = _scored(_base(docs.select(F.struct(*carried).alias("row"), "doc_id", "text")), model, perhaps, buckets)
    df = df.select("row", "doc_id", *OWN[:6], "_out", "_in")
    df = df.join(good.withColumn("_good", F.lit(1)).hint("merge"), "doc_id", "left")
    evidence = F.when(F.col("_good") == 1, F.col("_in")).otherwise(F.col("_out"))
    scored = stage(df.select("row", *OWN[:6], "_good", evidence.alias("llr")), "scores")
    trusted = scored.filter((F.col("_good") == 1) & (F.col("n_words") >= 20))
    # a document without evidence has 0 and is kept
    cut = min(0, rank_cut(trusted.select(_step(F.col("llr")).alias("at")), lost))
    return scored.withColumn("kept", ~F.col("base_failed") & (_step(F.col("llr")) >= cut)).select("row.*", *OWN)


def _step(score: Column) -> Column:
    return F.floor(score * STEPS)


def rank_cut(steps: DataFrame, share: float) -> int:
    """The smallest step (of steps: at, a whole number) that at least `share` of the rows do
    not exceed, and one row at least; 0 without rows. Exact, by counts: first of thousands of
    steps, of which scores have a bounded number, then of the steps in the one that is met."""
    wide = F.floor(F.col("at") / 1000)
    counts = steps.groupBy(wide.alias("w")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("w"))
    need = F.greatest(F.lit(1), F.ceil(F.sum("n").over(Window.partitionBy()) * share))
    met = counts.select("w", (upto - F.col("n")).alias("before"), upto.alias("upto"), need.alias("need")).filter("upto >= need").orderBy("w").first()
    if met is None:
        return 0
    fine = steps.filter(wide == met["w"]).groupBy("at").agg(F.count("*").alias("n"))
    ranked = fine.select("at", (F.sum("n").over(Window.orderBy("at")) + met["before"]).alias("upto"))
    return ranked.filter(F.col("upto") >= met["need"]).agg(F.min("at")).first()[0]


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, and docs' columns, that quality_rules keeps (see there; columns
    that have a result's name keep docs' values)."""
    renamed = docs.select("doc_id", "text", F.struct("*").alias("whole"))
    return quality_rules(renamed, labels, text=False, **options).filter("kept").select("whole.*")
