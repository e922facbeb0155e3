"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of lower-cased letters. For each, r is the log of the ratio of its smoothed
document shares among toxic and other rows. Features whose difference is significant (chi-squared) stay; a logistic
regression on presence * r gives the weights.

Fitting takes at most about `max_rows` labelled rows of the training fold, chosen by a hash of doc_id. The counts have
`BUCKETS` rows and the kept features at most `MAX_FEATURES`, so the driver's share is bounded.

Defined cases: null and empty texts get the score of a text without any feature; with labels of one kind only, every
score is that kind's share, smoothed; of repeated labels of an id the highest counts, of its texts the least; null ids never
teach; ids of any size stay as they are, further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import STEP, code_points, held_out, in_training_fold, letter_fold, materialize, mix64, text_chunks, text_slices, trimmed

SIZES = (4, 5, 6)
BUCKETS = 1 << 20
MAX_FEATURES = 4096
#: Labelled rows that a fit takes.
MAX_ROWS = 12_000
#: Least documents and chi-squared of a kept feature.
LEAST_DOCS, LEAST_CHI2 = 3, 20.0
#: Ridge penalty and steps of the regression.
RIDGE, STEPS = 1e-3, 400


@dataclass(frozen=True)
class ToxicityModel:
    place: np.ndarray  # per bucket: index of the feature, or -1
    weight: np.ndarray  # per feature, with r multiplied in
    bias: float


def _buckets(texts: list[str]):
    """Buckets of all n-grams of the texts and the index of the text of each, one n at a time."""
    points, owner = code_points(texts)
    folded = letter_fold()[points]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (owner[1:] != owner[:-1])
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    h = folded
    for n in range(2, max(SIZES) + 1):
        h = (h[:-1] * STEP) ^ folded[n - 1 :]
        if n in SIZES:
            inside = owner[: len(h)] == owner[n - 1 :]
            yield (mix64(h[inside] * np.uint64(8) + np.uint64(n)) >> np.uint64(44)).astype(np.int64), owner[n - 1 :][inside]


def _present(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct, of the features that place keeps."""
    found = []
    for bucket, owner in _buckets(texts):
        f = place[bucket]
        hit = f >= 0
        found.append(owner[hit].astype(np.int64) * MAX_FEATURES + f[hit])
    pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pair // MAX_FEATURES, pair % MAX_FEATURES


def _texts(pdf: pd.DataFrame) -> list[str]:
    return ["" if t is None else t for t in pdf["text"]]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """A model of labels.toxic from the texts of the training fold."""
    known = labels.where(F.col("toxic").isNotNull() & in_training_fold(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    n = known.count()
    near = F.abs(F.xxhash64("doc_id") % 1_000_000) < int(1_000_000 * min(1.0, max_rows / max(n, 1)))
    known = known.where(near).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    sample = materialize(sample.select("text", "y"), "labelled")  # read three times

    def count(batches):
        for pdf in batches:
            texts, y = _texts(pdf), pdf["y"].to_numpy()
            for a, b in text_chunks(texts, 1_000_000):
                out = np.zeros((2, BUCKETS), dtype=np.int32)
                for bucket, owner in _buckets(texts[a:b]):
                    pair = np.unique(owner.astype(np.int64) * BUCKETS + bucket)
                    label = y[a:b][pair // BUCKETS]
                    for k in (0, 1):
                        out[k] += np.bincount((pair % BUCKETS)[label == k], minlength=BUCKETS).astype(np.int32)
                some = np.flatnonzero(out.any(axis=0))
                yield pd.DataFrame({"bucket": some, "n0": out[0][some].astype(np.int64), "n1": out[1][some].astype(np.int64)})

    rows = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    m0, m1 = rows.get(0, 0), rows.get(1, 0)
    place = np.full(BUCKETS, -1, dtype=np.int64)
    prior = float(np.log((m1 + 1) / (m0 + 1)))
    if not m0 or not m1:
        return ToxicityModel(place, np.zeros(0), prior)
    counts = sample.mapInPandas(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1"), F.col("n0")
    cross = a * (m0 - b) - b * (m1 - a)
    chi2 = cross * cross / ((a + b) * (m0 + m1 - a - b) * m0 * m1 / F.lit(float(m0 + m1)))
    kept = (
        counts.where(a + b >= LEAST_DOCS)
        .withColumn("chi2", F.coalesce(chi2, F.lit(0.0)))
        .where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "bucket")
        .limit(MAX_FEATURES)
        .toPandas()
    )
    bucket = kept["bucket"].to_numpy()
    place[bucket] = np.arange(len(kept))
    r = np.log((kept["n1"].to_numpy() + 1.0) / (m1 + 2.0)) - np.log((kept["n0"].to_numpy() + 1.0) / (m0 + 2.0))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def features(batches):
        for pdf in batches:
            texts = _texts(pdf)
            for a, b in text_chunks(texts):
                row, f = _present(texts[a:b], shared.value)
                lists = np.split(f, np.searchsorted(row, np.arange(1, b - a)))
                yield pd.DataFrame({"y": pdf["y"].iloc[a:b].array, "f": [x.tolist() for x in lists]})

    data = sample.mapInPandas(features, "y int, f array<int>").toPandas()  # max_rows rows of kept features
    y = data["y"].to_numpy().astype(float)
    size = data["f"].map(len).to_numpy()
    row = np.repeat(np.arange(len(y)), size)
    col = np.concatenate([np.asarray(x, dtype=np.int64) for x in data["f"]]) if size.sum() else np.zeros(0, np.int64)
    w, bias = _regress(row, col, r, y, len(kept), prior)
    return ToxicityModel(place, w * r, bias)


def _regress(row, col, r, y, n_features, bias):
    """Ridge-penalised logistic regression on presence * r, by accelerated gradient steps with a fixed step size."""
    n = len(y)
    w, v = np.full(n_features, 0.1), np.full(n_features, 0.1)
    c, d = bias, bias
    value = r[col]
    # the largest eigenvalue of X'X / n bounds the curvature
    u = np.ones(n_features)
    top = 1.0
    for _ in range(20):
        z = np.bincount(col, weights=value * np.bincount(row, weights=value * u[col], minlength=n)[row], minlength=n_features) / n
        top = float(np.linalg.norm(z)) or 1.0
        u = z / top
    rate = 1.0 / (0.25 * (top + 1.0) + RIDGE)
    for k in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * v[col], minlength=n) + d, -40, 40)))
        gap = (p - y) / n
        new_w = v - rate * (np.bincount(col, weights=value * gap[row], minlength=n_features) + RIDGE * v)
        new_c = d - rate * gap.sum()
        step = k / (k + 3)
        v, d = new_w + step * (new_w - w), new_c + step * (new_c - c)
        w, c = new_w, new_c
    return w, c


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + MAX_FEATURES numbers

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, texts in text_slices(batch.column("text")):
                row, f = _present(texts, model.place)
                z = np.bincount(row, weights=model.weight[f], minlength=len(texts)) + model.bias
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = score(docs, fit(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
