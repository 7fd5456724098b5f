"""Toxicity: a chain of linear classifiers over categories.

The labels give one mark, toxic. Finer categories are learned from it, in every language:
the toxic texts of the sample are put into GROUPS groups by the words that set toxic texts
apart, so that texts which are toxic by the same words share a group. A category is
membership of a group; the last category is toxic itself. The chain predicts the
categories in order; each later logistic model has the earlier categories' probabilities
among its inputs, and in training those are out-of-fold predictions, so it learns from
honest probabilities.

The models are fitted on a bounded sample of labelled rows and then applied to every
whole text. The sample may hold more toxic documents than the labels do; each row is
weighed back to its class's share of all labelled documents, so that probabilities, and
the cut, mean the same at every size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.llm.common import slices, stage

#: Groups of toxic texts, and the categories in chain order.
GROUPS = 3
CATEGORIES = (*[f"group_{k + 1}" for k in range(GROUPS)], "toxic")
#: Labelled texts that the models are fitted on, at most (those of the smallest hashes).
SAMPLE = 6000
#: Folds of the out-of-fold predictions.
FOLDS = 3
#: Words and word beginnings that a model may weigh, at most, by their z score.
FEATURES, LEAST_Z = 384, 5.0
#: A document is rejected from this probability of toxic on.
CUT = 0.3

_WORD = re.compile(r"\w+")

def features(text: str) -> set[str]:
    """Lower-case words of a text, and the first four letters of longer ones (with a star)."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:4] + "*" for w in found if len(w) > 4}

def choose(docs: list[set[str]], y: np.ndarray) -> list[str]:
    """Features whose share of documents differs most between the classes, by z score."""
    pos, neg = Counter(), Counter()
    for f, label in zip(docs, y, strict=True):
        (pos if label else neg).update(f)
    n1, n0 = max(int(y.sum()), 1), max(int((~y).sum()), 1)
    scored = []
    for f in pos.keys() | neg.keys():
        a, b = pos[f], neg[f]
        p = (a + b) / (n1 + n0)
        if a + b >= 3 and p < 1 and abs(z := (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))) >= LEAST_Z:
            scored.append((-abs(z), f))
    return [f for _, f in sorted(scored)[:FEATURES]]

def groups(docs: list[set[str]], toxic: np.ndarray, steps: int = 20) -> np.ndarray:
    """Group of each document, -1 for those that are not toxic: spherical k-means over the
    chosen features, from centres that lie farthest from each other. Larger groups come
    first; toxic documents without such a feature are in the last one."""
    out = np.full(len(docs), -1)
    names = choose(docs, toxic) if 0 < toxic.sum() < len(toxic) else []
    place = {f: k for k, f in enumerate(names)}
    rows = np.flatnonzero(toxic)
    x = np.zeros((len(rows), len(names)))
    for k, row in enumerate(rows):
        x[k, [place[f] for f in docs[row] & place.keys()]] = 1
    size = np.sqrt((x * x).sum(1, keepdims=True))
    some = np.flatnonzero(size[:, 0] > 0)
    out[rows] = GROUPS - 1
    if not len(some):
        return out
    u = x[some] / size[some]
    centres = [u.mean(0)]
    for _ in range(GROUPS - 1):
        centres.append(u[np.argmin(np.max([u @ c for c in centres], axis=0))])
    centres = np.array(centres)
    for _ in range(steps):
        near = np.argmax(u @ centres.T, axis=1)
        for k in range(GROUPS):
            if (near == k).any():
                c = u[near == k].sum(0)
                centres[k] = c / np.sqrt(c @ c)
    order = np.argsort(-np.bincount(near, minlength=GROUPS), kind="stable")
    out[rows[some]] = np.argsort(order)[near]
    return out


class Linear:
    """Logistic regression on chosen features and earlier probabilities; ridge penalty,
    fitted by damped Newton steps. One class alone gives that class's rate."""

    def __init__(self, docs: list[set[str]], earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25, ridge: float = 1e-4):
        self.names = choose(docs, y) if 0 < y.sum() < len(y) else []
        self.index = {f: k for k, f in enumerate(self.names)}
        n, extra = len(y), earlier.shape[1]
        x = np.zeros((n, len(self.names) + extra + 1))
        for row, f in enumerate(docs):
            x[row, [self.index[k] for k in f & self.index.keys()]] = 1
        x[:, len(self.names) : -1] = earlier
        x[:, -1] = 1
        w = np.zeros(x.shape[1])
        w[-1] = np.log((weight @ y + 0.5) / (weight @ ~y + 0.5)) if y.any() else -20.0  # no positive label: never
        if self.names:
            penalty = np.full(len(w), ridge * n)
            penalty[-1] = 0
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                bend = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + np.diag(penalty + 1e-9)
                move = np.linalg.solve(bend, x.T @ (weight * (y - p)) - penalty * w)
                w = w + move * min(1.0, 4 / max(np.abs(move).max(), 1e-12))
                if np.abs(move).max() < 1e-4:
                    break
        self.weights = w

    def probabilities(self, docs: list[set[str]], earlier: np.ndarray) -> np.ndarray:
        w, k = self.weights, len(self.names)
        words = np.array([sum(w[self.index[f]] for f in d & self.index.keys()) for d in docs])
        return 1 / (1 + np.exp(-np.clip(words + earlier @ w[k:-1] + w[-1], -500, 500)))

class Chain:
    """One Linear per category, in order."""

    def __init__(self, docs: list[set[str]], marks: np.ndarray, fold: np.ndarray, weight: np.ndarray):
        """marks: a column per category; fold: of each document; weight: how many labelled
        documents each one stands for, 1 on average."""
        self.models: list[Linear] = []
        earlier = np.zeros((len(docs), 0))
        for c, name in enumerate(CATEGORIES):
            y = marks[:, c]
            self.models.append(Linear(docs, earlier, y, weight))
            if name == CATEGORIES[-1]:
                break
            out = np.zeros(len(docs))
            for k in range(FOLDS):
                inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                if len(outside):
                    part = Linear([docs[i] for i in inside], earlier[inside], y[inside], weight[inside])
                    out[outside] = part.probabilities([docs[i] for i in outside], earlier[outside])
            earlier = np.column_stack((earlier, out))

    def predict(self, docs: list[set[str]]) -> np.ndarray:
        done = np.zeros((len(docs), 0))
        for m in self.models:
            done = np.column_stack((done, m.probabilities(docs, done)))
        return done

def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the sample's texts, with their marks."""
    for b in slices(batches, "text"):
        found = [sorted(features(t or "")) for t in b.column("text").to_pylist()]
        toxic = b.column("toxic").cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), toxic, pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "features"])

def _vocabulary(sample: DataFrame) -> set[str]:
    """Features that the models of the chain choose from: those whose z score is high enough
    for toxic over all of the sample or without a fold."""
    parts = [F.lit(True), *[F.col("fold") != k for k in range(FOLDS)]]
    sums = [F.sum(p.cast("bigint")).alias(f"n{k}") for k, p in enumerate(parts)]
    sums += [F.sum(F.when(p, F.col("toxic")).otherwise(0)).alias(f"t{k}") for k, p in enumerate(parts)]
    all_of = sample.agg(*sums).first()
    each = sample.select("fold", "toxic", F.explode("features").alias("feature")).groupBy("feature").agg(*sums)
    high = F.lit(False)
    for k in range(len(parts)):
        n, n1 = all_of[f"n{k}"] or 0, all_of[f"t{k}"] or 0
        if 0 < n1 < n:
            a, m = F.col(f"t{k}"), F.col(f"n{k}")
            p = m / n
            z = F.abs(a / n1 - (m - a) / (n - n1)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
            high = high | ((m >= 3) & (m < n) & (z >= LEAST_Z - 1e-6))
    return {r["feature"] for r in each.filter(high).select("feature").toLocalIterator()}

def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """From at most `sample` labelled texts: half of them toxic where there are as many.
    Each half holds distinct texts, dealt by language (where docs has it) in proportion,
    those of the smallest hashes; the classes are weighed back to their numbers among all
    labelled documents. Needs no label at all: without any, nothing is toxic."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    # texts stay behind: their hashes and languages meet the labels
    keys = docs.select("doc_id", F.xxhash64("text").alias("_text"), lang.alias("_lang")).join(known.hint("merge"), "doc_id")
    # (a repeated id counts once; a text is toxic if one of its documents is)
    texts = keys.groupBy("doc_id").agg(F.min(F.struct("_text", "_lang")).alias("k"), F.max("toxic").alias("toxic"))
    texts = texts.groupBy("k._text").agg(F.max("toxic").alias("toxic"), F.min("k._lang").alias("_lang"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    # a few numbers for each labelled text, read by the counts and by each language's choice
    texts = stage(texts, "labelled")
    found = {(r["toxic"], r["_lang"]): (r["texts"], r["n"]) for r in texts.groupBy("toxic", "_lang").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).collect()}
    number_of = {t: sum(n for (c, _), (_, n) in found.items() if c == t) for t in (0, 1)}
    parts = []
    for t in (0, 1):
        size = sum(k for (c, _), (k, _) in found.items() if c == t)
        for (c, name), (k, _) in sorted(found.items(), key=str):
            if c == t:
                most = k if size <= sample // 2 else max(1, k * (sample // 2) // size)
                parts.append(texts.filter((F.col("toxic") == t) & F.col("_lang").eqNullSafe(F.lit(name))).orderBy(F.xxhash64("_text"), "_text").limit(most).select("doc_id", "_text", "toxic"))
    if not parts:
        return Chain([], np.zeros((0, len(CATEGORIES)), dtype=bool), np.zeros(0), np.zeros(0))
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # at most `sample` rows, and one a language: broadcast to the texts
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).join(F.broadcast(chosen), ["doc_id", "_text"]).dropDuplicates(["doc_id"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = rows.select("doc_id", "text", "toxic").mapInArrow(_marked, f"doc_id {kind}, toxic long, features array<string>")
    marked = stage(marked.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))), "sample")
    # texts stay in the tasks: the driver gets the features that count, as numbers
    names = sorted(_vocabulary(marked))
    place = {n: k for k, n in enumerate(names)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [[place[f] for f in row if f in place] for row in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(held, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "held"])

    order = ["doc_id", "fold", "toxic"]
    numbered = marked.select(*order, "features").mapInArrow(number, f"doc_id {kind}, fold long, toxic long, held array<int>")
    got = numbered.orderBy("doc_id").toArrow()
    sets = [{names[k] for k in row.as_py()} for row in got.column("held")]
    toxic = got.column("toxic").to_numpy().astype(bool)
    group = groups(sets, toxic)
    marks = np.column_stack([*[group == k for k in range(GROUPS)], toxic])
    each = {t: number_of[t] / max(int((toxic == bool(t)).sum()), 1) for t in (0, 1)}
    weight = np.where(toxic, each[1], each[0])
    return Chain(sets, marks, got.column("fold").to_numpy(), weight / weight.mean())

def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs' columns with p_<category> for each category, and rejected.

    A null text counts as empty. Repeated rows each keep their row; columns of docs
    with a result's name are replaced; an empty table gives no rows."""
    chain = fit(docs, labels, sample)
    own = [f"p_{c}" for c in CATEGORIES]
    keep = [c for c in docs.columns if c not in (*own, "rejected")]
    docs = docs.select(*keep)

    schema = StructType(list(docs.schema.fields))
    for c in own:
        schema = schema.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = chain.predict([features(t or "") for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(p[:, k]) for k in range(len(own))]], names=[*keep, *own])

    return docs.mapInArrow(run, schema).withColumn("rejected", F.col("p_toxic") >= CUT)

def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of each category and the verdict of each document, by score()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text", "lang")
