"""Quality by supervised subword embeddings: hashed vectors of words and character n-grams, averaged
over a document, softmax on top, trained by stochastic gradient descent in numpy.

Training reads labelled rows of folds 1 to 4 (crc32 of the id as text, mod 5), documents of equal text
once, at most SAMPLE of each class: those of least hash. This bound is of the fit alone; scoring reads
every whole text. Words are white-space separated, with case and marks, since these tell junk from
prose. As the model is linear in the mean vector, each feature's two logits are folded into one number
after training; a word's sum over its features is kept in a bounded memo.

A null or empty text has no features and gets the score of the bias alone. Without labels of both
classes every score is the share of class 1 (0.5 if there are none). Repeated rows get equal scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import crc_fold, only_ids, stage_table

BUCKETS, DIM = 1 << 17, 10
SHORTEST, LONGEST = 3, 4
SAMPLE = 2_000
EPOCHS, RATE, SEED = 4, 0.5, 7
MEMO_ENTRIES = 300_000


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams (with word bounds)."""
    w = f"<{word}>"
    out = [zlib.crc32(w.encode()) % BUCKETS]
    for n in range(SHORTEST, LONGEST + 1):
        out += [zlib.crc32(b"%d" % n + w[i : i + n].encode()) % BUCKETS for i in range(len(w) - n + 1)]
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    every: list[int] = []
    memo: dict[str, list[int]] = {}
    for w in text.split():
        if w not in memo:
            memo[w] = features(w)
        every += memo[w]
    return np.unique(np.asarray(every, np.int32), return_counts=True)


class Model:
    """weights: what a bucket adds to the logit of class 1 against class 0; bias alike."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self._memo = weights.astype(np.float32), bias, {}

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def score(self, text: str | None) -> float:
        total, n, memo = 0.0, 0, self._memo
        for w in (text or "").split():
            got = memo.get(w)
            if got is None:
                f = features(w)
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                got = memo[w] = (float(self.weights[f].sum(dtype=np.float64)), len(f))
            total += got[0]
            n += got[1]
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """Gradient descent, one document a step, over embedding, output matrix and bias; classes weigh alike."""
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
    steps, total = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - steps / total) * weight[y[i]]
            steps += 1
            at, n = bags[i]
            if not len(at):
                continue
            share = (n / n.sum()).astype(np.float32)
            mean = share @ emb[at]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * p
            emb[at] -= np.float32(rate) * len(at) ** 0.5 * share[:, None] * back
    side = out[1] - out[0]
    return Model(emb @ side, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & (crc_fold() != 0)).groupBy("doc_id").agg(F.min("y").alias("y"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"))
    single = texts.join(known, "doc_id").groupBy("h", "y").agg(F.min("doc_id").alias("doc_id"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = [single.where(F.col("y") == k).orderBy(*order).limit(SAMPLE).select("doc_id", "y") for k in (0, 1)]
    ids = stage_table(chosen[0].union(chosen[1]), "quality-train")  # 2 * SAMPLE rows at most

    def collect(batches):
        for b in batches:
            bags = [bag(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([u for u, _ in bags], pa.list_(pa.int32())), pa.array([n for _, n in bags], pa.list_(pa.int64()))],
                ["doc_id", "y", "at", "n"],
            )

    rows = only_ids(docs, ids).join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")
    got = rows.mapInArrow(collect, "doc_id long, y int, at array<int>, n array<long>").toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    bags = [(np.asarray(a.values), np.asarray(n.values)) for a, n in zip(got.column("at"), got.column("n"), strict=True)]
    return train(bags, y)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every column of docs and quality_score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(t: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(x) for x in t], dtype="float64")

    return docs.withColumn("quality_score", F.pandas_udf(scores, "double")(F.col(text_col)))
