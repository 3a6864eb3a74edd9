"""The training-data pipeline: five stages over documents, each on all that the one before kept.

Null and empty texts are never toxic by themselves (they get the score of no evidence), hold no lines and
no benchmark words, link with nothing and encode to no ids; their rows stay. A text that line dedup or
decontamination empties stays as a row with an empty text. Rows with a null id take part in every
stage but near-dedup, which keeps them. Rows that repeat an id are one document: near-dedup keeps or
drops them together. Of equally good candidates the smallest id stays. Further columns of documents go
through unchanged, whatever their names; n_chars, where there is one, follows the text. Empty tables give
empty results; without labels of both classes the toxicity stage keeps all or, if every label is toxic,
nothing; an empty benchmark removes nothing. Stages that use Python workers bound the session's Arrow
batches by bytes, where the session has no bound of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from gridlake.llm.common import bounded_batches, shared_path, table
from gridlake.llm.queries import TOKENIZER


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models call toxic go."""
    bounded_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, spark) < 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; every document keeps its row."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return _counted(out)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the document of least id stays."""
    bounded_batches(spark)
    kept = minhash.near_duplicates(docs, size=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_anti").select(*docs.columns)


def decontaminate_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go. A hit is a whole window or else a whole item of fewer words, so every
    span is removed, whatever its length."""
    bounded_batches(spark)
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), longest=1))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids."""
    bounded_batches(spark)
    return bpe.encode_documents(docs, TOKENIZER, keep_ids=True)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", one_of_near_copies),
    ("decontamination", decontaminate_spans),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: The stages train models, follow links and merge tokens: SQL can't express them.
ORACLE_SQL = None
