"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a short vector of shape and repetition statistics, computed with numpy. The class means and
covariances come from moments that every task adds up for itself (a constant number of values crosses the network).
Covariances shrink towards the pooled one and its diagonal; their Cholesky factors are computed once and travel with
the scoring tasks. The score is the logistic of the difference of the Mahalanobis log densities plus the log odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.shared import documents, in_fold, stored, unused
from threadloom.llm.wordgrid import slices, words

HELD_OUT = 0
THRESHOLD = 0.3
POOLED, DIAGONAL = 0.1, 0.05
UPPER, LOWER, DIGIT, BANG, PIPE, STOP, SYMBOL, HIGH, LINE = range(1, 10)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = UPPER, LOWER, DIGIT
_KIND[[ord(c) for c in "!?"]], _KIND[[ord(c) for c in "|\\<>[]{}"]] = BANG, PIPE
_KIND[[ord(c) for c in ".,;:"]], _KIND[[ord(c) for c in "#$%&*@~^_+=/"]] = STOP, SYMBOL
_KIND[128:], _KIND[10] = HIGH, LINE
N_FEATURES = 13


def features(column: pa.Array) -> np.ndarray:
    """One row of N_FEATURES statistics a text; an empty or null text has zeros."""
    w = words(column)
    n, out = len(column), np.zeros((len(column), N_FEATURES))
    size, count = np.diff(w.begin), w.counts
    full = np.flatnonzero(size > 0)
    kinds = np.zeros((n, 10))
    if len(full):
        codes = _KIND[w.data]
        for k in range(1, 10):
            kinds[full, k] = np.add.reduceat((codes == k).view(np.uint8), w.begin[:-1][full], dtype=np.int64)
    some = np.flatnonzero(count > 0)
    if not len(some):
        return out
    hashes, per = w.hashes(lower=False), np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], weights=fresh, minlength=n)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, weights=again, minlength=n)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(owner, weights=length, minlength=n) / per
    spread = np.sqrt(np.maximum(np.bincount(owner, weights=length**2, minlength=n) / per - mean**2, 0))
    letters = np.maximum(kinds[:, UPPER] + kinds[:, LOWER], 1)
    columns = (
        np.log1p(count), np.sqrt(kinds[:, UPPER] / letters), np.sqrt(kinds[:, DIGIT] / np.maximum(size, 1)), np.sqrt(kinds[:, BANG] / per), np.sqrt(kinds[:, PIPE] / per),
        np.sqrt(kinds[:, STOP] / per), np.sqrt(kinds[:, SYMBOL] / per), np.sqrt(kinds[:, HIGH] / np.maximum(size, 1)), np.sqrt(kinds[:, LINE] / per),
        np.log(np.maximum(distinct, 1) / per) / np.log1p(per), np.sqrt(repeats / per), np.log1p(mean), np.log1p(spread),
    )
    for j, c in enumerate(columns):
        out[some, j] = c[some]
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        f = features(b.column("text"))
        yield pa.record_batch([b.column("doc_id"), pa.array(list(f), pa.list_(pa.float64()))], ["doc_id", "features"])


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row: zeros for null and empty texts; ids may be null or repeat, an empty table gives none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_feature_batches, "doc_id long, features array<double>")


def _moment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products of the rows of each label that a task reads."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        f = np.array(b.column("features").to_pylist(), dtype=float).reshape(-1, N_FEATURES)
        label = b.column("label").to_numpy(zero_copy_only=False)
        f = np.hstack([np.ones((len(f), 1)), f])
        for k in np.unique(label).tolist():
            x = f[label == k]
            sums[k] = sums.get(k, 0) + (x.T @ x)
    for k, m in sums.items():
        yield pa.record_batch([pa.array([k] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], ["label", "at", "value"])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log odds of class 1."""

    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_odds: float

    def score(self, f: np.ndarray) -> np.ndarray:
        density = [-0.5 * ((((f - self.means[k]) @ self.inverse[k].T) ** 2).sum(axis=1) + self.log_det[k]) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1] - self.log_odds, -500, 500)))


def fit(features_: DataFrame, labels: DataFrame) -> Discriminant:
    """From rows with a label 0 or 1 outside the held-out fold; of repeated labels of an id the least counts.
    With a class missing the densities are equal and only the odds count."""
    known = labels.where(F.col("quality").isin(0, 1) & ~in_fold(F.col("doc_id"), HELD_OUT) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    rows = features_.join(known, "doc_id").select("label", "features").mapInArrow(_moment_batches, "label int, at int, value double")
    d = N_FEATURES + 1
    m = np.zeros((2, d, d))
    for r in rows.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():  # 2 * d * d values
        m[r["label"]].flat[r["at"]] = r["value"]
    n = m[:, 0, 0]
    if min(n) < 2:
        return Discriminant(np.zeros((2, N_FEATURES)), np.array([np.eye(N_FEATURES)] * 2), np.zeros(2), float(np.log((n[1] + 1) / (n[0] + 1))))
    means = m[:, 0, 1:] / n[:, None]
    scatter = np.array([m[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = scatter.sum(axis=0) / n.sum()
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    inverse, log_det = [], []
    for k in (0, 1):
        own = (1 - POOLED) * scatter[k] / n[k] + POOLED * pooled
        chol = np.linalg.cholesky((1 - DIAGONAL) * own + DIAGONAL * floor)
        inverse.append(np.linalg.inv(chol))
        log_det.append(2 * np.log(np.diag(chol)).sum())
    return Discriminant(means, np.array(inverse), np.array(log_det), float(np.log(n[1] / n[0])))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant, DataFrame]:
    """The model and the stored features (doc_id, features) of all rows of docs."""
    table = stored(text_features(docs), "quality-features")
    return fit(table, labels), table


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: null, empty and repeated texts too, ids may be null or repeat.
    Only the text is an input of the score. Without labels all scores are 0.5."""
    model, table = train(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array(b.column("features").to_pylist(), dtype=float).reshape(-1, N_FEATURES)
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(f))], ["doc_id", "score"])

    out = table.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", in_fold(F.col("doc_id"), HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text scores at least the threshold.

    Null and empty texts are scored as such, ids may be null or repeat, repeated rows go or stay together, an empty table
    stays empty; without labels all rows score 0.5."""
    model, _ = train(docs, labels)
    name = unused("quality_score", docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([*b.columns, pa.array(model.score(features(b.column("text"))))], [*b.schema.names, name])

    return docs.mapInArrow(scored, schema).where(F.col(name) >= threshold).drop(name)


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; see score_documents for null, empty and repeated texts and ids."""
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
