"""The operators of this subpackage as queries with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import ann, bpe, decontaminate, licenses, line_dedup, minhash, quality, secrets, token_files, toxicity
from gridlake.llm.common import held_out, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    score = F.col("toxic_score")
    return out.select("doc_id", held_out(), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return quality.score(docs, model).select(
        "doc_id", held_out(), score.alias("score"), (score >= 0.3).cast("int").alias("predicted")
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents"), across_lines=True))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicates, op2_toxicity, op3_secrets, op4_line_dedup, op5_quality, op6_licenses, op7_bpe, op8_nearest, op9_decontaminate, op10_token_files)
}
ORACLE_SQL: dict[str, str] = {
    "op3_secrets": secrets.ORACLE,
    "op6_licenses": licenses.ORACLE,
    "op8_nearest": ann.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}
