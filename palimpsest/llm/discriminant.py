"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of each whole text come from built-in functions, are transformed (logs,
smoothed ratios) and written once. Class sizes, means and second moments are plain
aggregates over all labelled training rows. Each class covariance is shrunk towards
its diagonal and the pooled covariance, and factored once; a score is the logistic of
the difference of the two Mahalanobis log-densities and log priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import stage, words

#: Shares of the pooled covariance and of the diagonal in each class covariance.
POOLED, DIAGONAL = 0.05, 0.1
#: Added to every variance.
RIDGE = 1e-3
#: Log-odds are divided by this before the logistic: densities of correlated statistics overstate.
TEMPERATURE = 2.0
#: Score from which label 1 is predicted.
CUT = 0.3

# The statistics, in the order of the vector.
STATISTICS = ("words", "word_length", "distinct", "upper", "symbols", "marks", "digits", "lines", "dup_lines", "non_ascii", "stops", "top_letters", "repeats")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one column s_<name> (double) for each of STATISTICS; a null text
    counts as empty."""
    full = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", words(full)).withColumn("_n", F.size("_w").cast("double")).withColumn("_c", F.char_length(full).cast("double"))
    without = lambda chars: F.col("_c") - F.char_length(F.translate(full, chars, ""))
    ratio = lambda x, n: F.log((x + 0.5) / (n + 1.0))
    lines = F.filter(F.split(full, "\n"), lambda x: F.trim(x) != "")
    pairs = F.zip_with(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_l", lines).withColumn("_p", pairs)
    letters = F.char_length(F.translate(full, " \t\n\x0b\x0c\r", "")).cast("double")
    upper = F.char_length(full) - F.char_length(F.translate(full, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    values = {
        "words": F.log1p("_n"), "word_length": F.log1p(letters / F.greatest(F.col("_n"), F.lit(1.0))),
        "distinct": ratio(F.size(F.array_distinct("_w")), F.col("_n")), "upper": ratio(upper.cast("double"), F.col("_c")),
        "symbols": ratio(without("#*$%&|<>~^_=+{}[]\\"), F.col("_c")), "marks": ratio(without("!?"), F.col("_c")),
        "digits": ratio(without("0123456789"), F.col("_c")), "lines": F.log1p(F.size("_l").cast("double")),
        "dup_lines": ratio((F.size("_l") - F.size(F.array_distinct("_l"))).cast("double"), F.size("_l").cast("double")),
        "non_ascii": ratio(F.octet_length(full).cast("double") - F.col("_c"), F.col("_c")), "stops": ratio(without("."), F.col("_n")),
        "top_letters": ratio(without("etaoin"), F.col("_c")), "repeats": ratio((F.size("_p") - F.size(F.array_distinct("_p"))).cast("double"), F.col("_n")),
    }
    df = df.withColumns({f"s_{k}": values[k] for k in STATISTICS})
    return df.drop("_w", "_n", "_c", "_l", "_p")


class Discriminant:
    """Means, inverse Cholesky factors and constants of the classes 0 and 1."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, diagonal: float = DIAGONAL):
        d = len(STATISTICS)
        covs = {}
        for k, (n, total, square) in moments.items():
            mean = total / n
            covs[k] = (n, mean, square / n - np.outer(mean, mean))
        n_all = sum(n for n, _, _ in covs.values())
        within = sum((n * c for n, _, c in covs.values()), np.zeros((d, d))) / max(n_all, 1)
        self.classes = {}
        for k, (n, mean, cov) in covs.items():
            own = (1 - pooled - diagonal) * cov + pooled * within + diagonal * np.diag(np.diag(cov)) + RIDGE * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.classes[k] = (mean, np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n / n_all))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; 0.5 without any labelled row, and the only class's
        value (0 or 1) where the training rows have one class."""
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        log = {k: const - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for k, (mean, inverse, const) in self.classes.items()}
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / TEMPERATURE, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From every row of labels that is not held out and has a document. Repeated
    (doc_id, quality) rows count once; null labels or ids do not count."""
    train = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    cols = [f"s_{k}" for k in STATISTICS]
    both = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    rows = stats.join(train, "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.array(*[F.sum(c) for c in cols]).alias("one"), F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in both]).alias("two")
    ).collect()  # two rows at most
    moments = {}
    for r in rows:
        square = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(both, r["two"], strict=True):
            square[i, j] = square[j, i] = v
        moments[r["quality"]] = (r["n"], np.asarray(r["one"]), square)
    return Discriminant(moments)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text).

    A null or empty text has a score as every text has; without labels of both classes every
    score is 0.5. Null and repeated ids each keep their row (a null id is not learned from);
    other columns are ignored; an empty table gives no rows. A very long text is one row."""
    stats = stage(statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f"s_{k}").to_numpy(zero_copy_only=False) for k in STATISTICS]) if b.num_rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(model.score(x), pa.float64())})

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, score and predicted of each document, by score_documents()."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
