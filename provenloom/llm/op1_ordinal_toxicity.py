"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x) for ordered thresholds theta_1 < theta_2 < ..., with one weight vector w shared by
all thresholds and sparse features x_j = log(1 + count of word or word beginning j). A document's expected severity is the sum over k of
P(grade > k); it is rejected where P(grade > 0) reaches one half.

Fitting takes labelled documents up to FIT_ROWS (those with the least hash of doc_id), one row of each. Words count as features
if at least MIN_DOCS of these documents hold them and the likelihood ratio of their counts in toxic and clean documents
reaches GAIN; with 1 and 0 in their place every word does. Only these words' counts in the labelled rows reach the driver.
Labels that say toxic or not are graded by how often a toxic document uses words that lean to toxic: grade 1 up to
the median of the toxic documents, grade 2 beyond. Scoring reads every whole text with the fixed-size model.

Defined cases: null or empty text scores as a document without features; labels that are null, or for unknown documents,
are left out; contradicting labels of a document count as the highest; with no labels or one class the model rejects
nothing (severity 0); of a doc_id on several rows the greatest text is learned from; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

FIT_ROWS = 16_000
MIN_DOCS = 4
GAIN = 14.0
L2 = 0.1
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> list[str]:
    """Words in lower case and, marked by a caret, their beginnings: inflected forms share these."""
    words = WORD.findall((text or "").lower())
    return words + ["^" + w[:4] for w in words if len(w) > 4] + ["^" + w[:5] for w in words if len(w) > 5]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and threshold (columns)."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])

    def score(self, text: str | None) -> float:
        hits = Counter(w for w in features(text) if w in self.vocabulary)
        return float(sum(self.weights[self.vocabulary[w]] * np.log1p(n) for w, n in sorted(hits.items())))


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, l2: float = L2, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated gradient steps on the penalised likelihood of sparse rows.

    Thresholds are theta_1 and positive steps beyond it (through exp), so their order can't break.
    """
    n, top = len(grades), int(grades.max())
    w = np.zeros(n_features)
    shares = np.array([(grades > k).mean() for k in range(top)]).clip(1e-6, 1 - 1e-6)
    start = np.log((1 - shares) / shares)
    t = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-2))])

    def thresholds(t: np.ndarray) -> np.ndarray:
        return t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])

    m, v = np.zeros(n_features + top), np.zeros(n_features + top)
    for step in range(1, steps + 1):
        th = np.concatenate([[-np.inf], thresholds(t), [np.inf]])
        s = np.bincount(rows, values * w[cols], n)
        upper, lower = sigmoid(th[grades + 1] - s), sigmoid(th[grades] - s)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        ds = (du - dl) / p  # of -log p by s
        gw = np.bincount(cols, values * ds[rows], n_features) + l2 * w
        gth = np.array([-(du / p)[grades == k].sum() + (dl / p)[grades == k + 1].sum() for k in range(top)])
        gt = np.concatenate([[gth.sum()], [gth[k:].sum() * np.exp(t[k]) for k in range(1, top)]])
        g = np.concatenate([gw, gt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (steps + 1))
        w, t = w - move[:n_features], t - move[n_features:]
    return w, thresholds(t)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, least_docs: int = MIN_DOCS, least_gain: float = GAIN) -> OrdinalModel:
    """The model from labels (doc_id, toxic) on docs (doc_id, text)."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    held = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    held = materialise(held, "labelled")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Document counts of words by label, added up within a batch."""
        for b in batches:
            count: Counter[tuple[str, int]] = Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count.update((w, int(y > 0)) for w in set(features(t)))
            keys = list(count)
            arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([count[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else count[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "bad", "good"])

    totals = {bool(r["y"]): r["n"] for r in held.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    if not bad or not good:
        return OrdinalModel({}, np.zeros(0), np.array([40.0]))
    df = held.select("text", "toxic").mapInArrow(distinct, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n, share = F.col("bad") + F.col("good"), bad / (bad + good)
    gain = 2 * (F.col("bad") * F.log(F.greatest("bad", F.lit(0.5)) / (n * share)) + F.col("good") * F.log(F.greatest("good", F.lit(0.5)) / (n * (1 - share))))
    chosen = df.where(n >= least_docs).withColumn("gain", gain).where(F.col("gain") >= least_gain).withColumn("up", F.col("bad") > n * share)
    found = chosen.orderBy(F.col("gain").desc(), "word").select("word", "up").collect()
    vocabulary = {r["word"]: i for i, r in enumerate(found)}
    positive = np.array([r["up"] for r in found], bool)
    if not vocabulary:
        return OrdinalModel({}, np.zeros(0), np.array([40.0]))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [Counter(vocabulary[w] for w in features(t) if w in vocabulary) for t in b.column(0).to_pylist()]
            arrays = [b.column(1), pa.array([sorted(h) for h in hits], pa.list_(pa.int32())), pa.array([[h[k] for k in sorted(h)] for h in hits], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "at", "n"])

    kind = held.schema["toxic"].dataType.simpleString()
    rows = held.select("text", "toxic").mapInArrow(counts, f"toxic {kind}, at array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["at"], r["n"]))
    lengths = [len(r["at"]) for r in rows]
    i = np.repeat(np.arange(len(rows)), lengths)
    j = np.concatenate([np.array(r["at"], np.int64) for r in rows])
    n = np.concatenate([np.array(r["n"], np.float64) for r in rows])
    toxic = np.array([r["toxic"] > 0 for r in rows])
    used = np.bincount(i, n * positive[j], len(rows))
    grades = np.where(toxic, 1 + (used > np.median(used[toxic])), 0).astype(np.int64)
    weights, thresholds = fit_cumulative_link(i, j, np.log1p(n), grades, len(vocabulary))
    return OrdinalModel(vocabulary, weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, p_toxic, toxic) of every row of docs."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exceed = model.exceed(np.array([model.score(t) for t in b.column(1).to_pylist()], np.float64))
            first = exceed[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exceed.sum(axis=1)), pa.array(first), pa.array(first >= 0.5)], ["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(judge, "doc_id long, severity double, p_toxic double, toxic boolean")


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
