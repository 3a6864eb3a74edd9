"""Toxicity by two class-conditional Kneser-Ney models over characters.

Texts are folded to 32 symbols (letters without case and accents, space, digit, marks; code points from
U+0300 up are dealt over the letters), and two interpolated Kneser-Ney models of order 5, one of toxic and
one of ordinary training documents, give log-likelihoods. Both back off to the same lower orders:
continuation counts (distinct left neighbours) of all training documents together, so what is rare in
a class is smoothed by what all documents share, and an n-gram that neither class has counts through
the two backoff weights of its context. The log-likelihood ratio is taken against its mean in ordinary
text after the same context: a class of fewer documents gives all its unseen n-grams less, which would
otherwise count against every text, more so in languages with few toxic documents. The sum over a text
divided by its length, put through a fitted logistic curve, is the score.

Counts are of documents (an n-gram counts once in each), and documents of equal text count once, so
copies teach nothing twice. Learning reads only labelled rows of folds 1 to 4 (crc32 of the id as text,
mod 5): folds 2 to 4 give counts, fold 1 the curve, with the classes' own shares. The counts are summed
by Spark and grow with the corpus up to 32^5 n-grams; the driver gets at most 32^4 continuation counts and
the finished table, 64 bytes for each context of four symbols that occurs, 68 MB at the very most; the
curve is fitted on a histogram.

A null or empty text has ratio 0. Where fold 1 lacks a class, every score is the share of toxic training
documents; without labels of both classes it is 1 if there are only toxic ones, else 0. Null ids are never
labelled. Repeated rows get equal scores. Columns named toxic_ratio or toxic_score are replaced by score();
score_column() adds none.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import crc_fold, discard, only_ids, stage_table

ORDER, SYMBOLS = 5, 32
DISCOUNT = 0.75
SPACE = 26
BLOCK = SYMBOLS**3  # n-grams of one block, which share their first two symbols
HELD = 4_000_000  # codes of training documents that a task holds before it sums them
STEPS = 2_048  # of a log ratio, as the table holds it in two bytes


def _symbols() -> np.ndarray:
    """Code points below U+0300 to symbols."""
    t = np.zeros(0x300, np.uint8)
    for cp in range(0x300):
        base = unicodedata.normalize("NFD", chr(cp))[0].lower()
        if "a" <= base <= "z":
            t[cp] = ord(base) - 97
        elif chr(cp).isspace():
            t[cp] = SPACE
        elif chr(cp).isdigit():
            t[cp] = 27
        elif chr(cp) in "'’":
            t[cp] = 28
        elif chr(cp) in ".,;:!?":
            t[cp] = 29
        elif cp < 128:
            t[cp] = 30
        else:
            t[cp] = 31
    return t


_TABLE = _symbols()


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of order ORDER, the text between spaces."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    s = np.empty(len(a) + ORDER, np.int32)
    s[: ORDER - 1] = SPACE
    s[-1] = SPACE
    inner = s[ORDER - 1 : -1]
    inner[:] = _TABLE[np.minimum(a, 0x2FF)]
    other = a >= 0x300
    if other.any():
        inner[other] = a[other] * np.uint32(2_654_435_761) % np.uint32(26)
    n = len(a) + 1
    k = s[:n].copy()
    for j in range(1, ORDER):
        k *= SYMBOLS
        k += s[j : n + j]
    return k


def lower_orders(suffix: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Shared probabilities of order ORDER - 1, a dense table, from its n-grams (ascending) and how many
    distinct symbols stand before each in all training documents. Shorter orders are counted alike."""
    levels = [(suffix, kinds)]
    for order in range(ORDER - 2, 0, -1):
        levels.append(np.unique(levels[-1][0] % SYMBOLS**order, return_counts=True))
    p = np.full(1, 1 / SYMBOLS)  # order 0: any symbol alike
    for order, (u, n) in enumerate(reversed(levels), 1):
        _, inv = np.unique(u // SYMBOLS, return_inverse=True)
        back = DISCOUNT * np.bincount(inv)[inv] * p[u % SYMBOLS ** (order - 1)]
        p = np.zeros(SYMBOLS**order)
        p[u] = (n - DISCOUNT + back) / np.bincount(inv, n)[inv]
    return p


def ratios(block: int, codes: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(contexts, SYMBOLS): log ratios toxic : ordinary of all n-grams of a block, against their mean in ordinary text after
    the same context. codes: those seen; counts: their document counts (row 0 ordinary, row 1 toxic);
    low: as lower_orders gives it."""
    at = codes - block * BLOCK
    dense = np.zeros((2, BLOCK))
    dense[:, at] = counts
    c = dense.reshape(2, -1, SYMBOLS)
    share = low[np.arange(block * BLOCK, (block + 1) * BLOCK) % SYMBOLS ** (ORDER - 1)].reshape(-1, SYMBOLS)
    total = c.sum(2, keepdims=True)
    seen = total > 0
    total = np.where(seen, total, 1.0)
    back = np.where(seen, DISCOUNT * (c > 0).sum(2, keepdims=True) / total, 1.0)
    kept = np.maximum(c - DISCOUNT, 0) / total
    either = c.sum(0) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.log(np.where(either, kept + back * share, back))  # of an unseen one the shared part is in both
    ratio = log[1] - log[0]
    first = np.where(either, kept[0] + back[0] * share, 0.0)
    mean = (first * ratio).sum(1, keepdims=True) + (1 - first.sum(1, keepdims=True)) * np.log(back[1] / back[0])
    ratio -= np.where(either.any(1, keepdims=True), mean, 0.0)
    return np.clip(np.rint(ratio * STEPS), -32_767, 32_767).astype(np.int16)


class Table:
    """Log ratios by n-gram: a row of SYMBOLS for each context that occurs; row 0, of zeros, is for others."""

    def __init__(self, contexts: np.ndarray, rows: np.ndarray):
        self.row_of = np.zeros(SYMBOLS ** (ORDER - 1), np.int32)
        self.row_of[contexts] = np.arange(1, len(contexts) + 1)
        self.rows = np.concatenate([np.zeros((1, SYMBOLS), np.int16), rows])

    def mean(self, text: str | None) -> float:
        if not text:
            return 0.0
        g = grams(text)
        return float(self.rows[self.row_of[g // SYMBOLS], g % SYMBOLS].mean(dtype=np.float64)) / STEPS


class Model:
    """A table of log ratios and the curve of the score: a logistic function
    of the ratio's distance from middle, in units, on a logarithmic scale."""

    def __init__(self, table: Table, share: float):
        self.table, self._shared = table, None
        self.middle, self.unit, self.slope = 0.0, 1.0, 0.0
        self.offset = float(np.log(share / (1 - share)))

    def ratio(self, text: str | None) -> float:
        """Centred log-likelihood ratio a character."""
        return self.table.mean(text)

    def shared(self, spark):
        """The table as a broadcast variable, sent once; of bounded size."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self.table)
        return self._shared

    def far(self, ratio: np.ndarray) -> np.ndarray:
        x = (ratio - self.middle) / self.unit
        return np.sign(x) * np.log1p(np.abs(x))

    def score(self, ratio: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.far(ratio) + self.offset, -30, 30)))

    def set_curve(self, bins: np.ndarray, n: np.ndarray) -> None:
        """bins of the ratio, ascending, with counts (row 0 ordinary, row 1 toxic)."""
        below = np.cumsum(n[0]) / n[0].sum()
        self.middle = float(bins[np.searchsorted(below, 0.5)])
        off = np.abs(bins - self.middle)
        order = np.argsort(off, kind="stable")
        self.unit = max(float(off[order][np.searchsorted(np.cumsum(n[0][order]) / n[0].sum(), 0.5)]), 1e-4)
        x, y, w = np.tile(self.far(bins), 2), np.repeat([0.0, 1.0], len(bins)), n.ravel() / n.sum()
        slope, offset = 1.0, self.offset
        for _ in range(100):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
            v = w * p * (1 - p)
            g = np.array([((p - y) * w * x).sum() + 1e-6 * slope, ((p - y) * w).sum()])
            h = np.array([[(v * x * x).sum() + 1e-6, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
            step = np.clip(np.linalg.solve(h, g), -3, 3)
            slope, offset = slope - step[0], offset - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = max(float(slope), 1e-3), float(offset)


def _count(batches):
    """code, n_ord, n_tox of a partition's training documents."""
    held: list[list[np.ndarray]] = [[], []]
    sums: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * 2

    def merge(x):
        u = np.concatenate([sums[x][0], *held[x]])
        n = np.concatenate([sums[x][1], np.ones(sum(map(len, held[x])), np.int64)])
        u, inv = np.unique(u, return_inverse=True)
        sums[x] = (u, np.bincount(inv, n, len(u)).astype(np.int64))
        held[x] = []

    for b in batches:
        for t, x in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            held[x].append(np.unique(grams(t.as_py() or "")))
            if sum(map(len, held[x])) >= HELD:
                merge(x)
    merge(0)
    merge(1)
    for x in (0, 1):
        u, n = sums[x]
        for i in range(0, len(u), 100_000):
            c, k = u[i : i + 100_000], n[i : i + 100_000]
            zero = np.zeros(len(c), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(zero if x else k), pa.array(k if x else zero)], ["code", "n_ord", "n_tox"])


def _blocks(counts: DataFrame, low: np.ndarray) -> DataFrame:
    """context and ratios of every context that training documents hold; a group has BLOCK rows at most."""
    shared = counts.sparkSession.sparkContext.broadcast(low.astype(np.float32))
    grouped = counts.groupBy((F.col("code") / BLOCK).cast("int").alias("block")).agg(F.collect_list(F.struct("code", "n_ord", "n_tox")).alias("rows"))

    def run(batches):
        for b in batches:
            for block, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                code, ordinary, toxic = (f.to_numpy().astype(np.int64) for f in rows.values.flatten())
                seen = np.unique(code // SYMBOLS)
                got = ratios(block, code, np.stack([ordinary, toxic]), shared.value)[seen - block * (BLOCK // SYMBOLS)]
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array([r.tobytes() for r in got], pa.binary())], ["context", "ratios"])

    return grouped.mapInArrow(run, "context int, ratios binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | float:
    """The models of all labelled rows that are not held out; where a class has none, the share of toxic ones."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & (crc_fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"))
    single = texts.join(known.hint("merge"), "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"))
    single = stage_table(single, "toxic-train")
    train = only_ids(docs, single).withColumn("h", F.xxhash64("text"))
    train = train.join(single.hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    train = stage_table(train.select("text", "toxic", (crc_fold() == 1).alias("tune")), "toxic-texts")
    learnt = train.where(~F.col("tune"))
    counts = learnt.select("text", "toxic").mapInArrow(_count, "code int, n_ord long, n_tox long")
    counts = stage_table(counts.groupBy("code").agg(F.sum("n_ord").alias("n_ord"), F.sum("n_tox").alias("n_tox")), "toxic-counts")
    sizes = np.zeros(2)
    for r in learnt.groupBy("toxic").count().collect():
        sizes[r.toxic] = r["count"]
    if not sizes.all():
        discard(single, train, counts)
        return 1.0 if sizes[1] else 0.0
    spread = counts.groupBy((F.col("code") % SYMBOLS ** (ORDER - 1)).alias("suffix")).count().orderBy("suffix").toArrow()
    low = lower_orders(spread.column("suffix").to_numpy().astype(np.int64), spread.column("count").to_numpy())
    got = _blocks(counts, low).toArrow()  # 32^4 rows of 68 bytes at most
    rows = np.frombuffer(b"".join(got.column("ratios").to_pylist()), np.int16).reshape(-1, SYMBOLS)
    table = Table(got.column("context").to_numpy(), rows)
    del got, rows
    model = Model(table, sizes[1] / sizes.sum())
    tuned = train.where("tune").groupBy(F.round(_ratio_column(model, docs.sparkSession)("text"), 4).alias("bin"), "toxic").count().collect()  # at most 320,000 bins
    bins = np.array(sorted({r.bin for r in tuned}))
    n = np.zeros((2, len(bins)))
    for r in tuned:
        n[r.toxic, np.searchsorted(bins, r.bin)] += r["count"]
    if n.sum(1).all():
        model.set_curve(bins, n)
    discard(single, train, counts)
    return model


def _ratio_column(model: Model, spark):
    shared = model.shared(spark)
    return F.pandas_udf(lambda t: pd.Series([shared.value.mean(x) for x in t], dtype="float64"), "double")


def _curve(model: Model, ratio):
    x = (ratio - F.lit(model.middle)) / F.lit(model.unit)
    z = F.lit(model.slope) * F.signum(x) * F.log1p(F.abs(x)) + F.lit(model.offset)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def score_column(model: Model | float, spark, text_col: str = "text"):
    """The score (0 to 1) as an expression over a text column."""
    return F.lit(model) if isinstance(model, float) else _curve(model, _ratio_column(model, spark)(F.col(text_col)))


def score(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """Every column of docs and toxic_ratio (log ratio a character) and toxic_score (0 to 1)."""
    if isinstance(model, float):
        return docs.withColumns({"toxic_ratio": F.lit(0.0), "toxic_score": F.lit(model)})
    out = docs.withColumn("toxic_ratio", _ratio_column(model, docs.sparkSession)(F.col(text_col)))
    return out.withColumn("toxic_score", _curve(model, F.col("toxic_ratio")))
