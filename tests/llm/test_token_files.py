"""Token files: what is read back is what was written, in order, and single documents can be fetched."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlake.llm import token_files
from gridlake.llm.common import shared_path
from gridlake.llm.queries import END_ID, QUERIES, TOKENIZER


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, END_ID]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_whole_table(spark, sf_dir, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    out = {r.doc_id: r for r in QUERIES["op10_token_files"](spark, sf_dir).collect()}
    at = 0
    for d, t in docs:
        ids = ids_of(library, t)
        r = out[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(out) == len(docs)


def test_shards_blocks_and_single_documents(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "DOCS_A_SHARD", 40)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 2_000)
    rows = [(i * 7 % 500, f"document {i} " + "of some words " * (i % 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("x"), "frame": F.lit(1)}).repartition(7)
    path = shared_path(spark, "test-tokens")
    token_files.write_token_files(df, path, TOKENIZER, END_ID)
    out = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(d for d, _ in rows)
    text, at = dict(rows), 0
    for r in out:
        assert r.start == at and list(r.ids) == ids_of(library, text[r.doc_id])
        at += r.n_tokens
    assert spark.read.parquet(f"{path}/blocks").select("shard").distinct().count() > 5
    for d in (0, 77, 499):
        assert token_files.fetch_document(spark, path, d) == [ids_of(library, text[d])]
    assert token_files.fetch_document(spark, path, 12_345) == []


def test_nulls_repeats_and_empty_tables(spark, library):
    rows = [(5, "b"), (5, "b"), (5, "a longer text"), (None, "null id"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = token_files.round_trip(df, TOKENIZER, END_ID, keep_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 2, 3, 5, 5, 5]
    assert [list(r.ids) for r in out[1:3]] == [[END_ID], [END_ID]]
    assert sorted(map(tuple, (r.ids for r in out[3:]))) == sorted(tuple(ids_of(library, t)) for d, t in rows if d == 5)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    assert token_files.round_trip(df.limit(0), TOKENIZER, END_ID).collect() == []


def test_one_id_with_most_rows_has_several_shards(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "DOCS_A_SHARD", 20)
    rows = [(i, "before") for i in range(40)] + [(50, "the same text")] * 150 + [(None, "none")] * 60 + [(60 + i, f"after {i}") for i in range(40)]
    path = shared_path(spark, "test-hot")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, TOKENIZER, END_ID)
    out = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    sizes = [len(r.doc_ids) for r in spark.read.parquet(f"{path}/blocks").collect()]
    assert max(sizes) <= 60 and sum(sizes) == len(rows)


def test_ids_of_four_bytes(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "_kind", lambda size: "<u4")  # as a vocabulary of more than 65,536 ids would be
    path = shared_path(spark, "test-wide")
    token_files.write_token_files(spark.createDataFrame([(1, "a few words"), (2, "")], "doc_id long, text string"), path, TOKENIZER, END_ID)
    monkeypatch.undo()
    assert spark.read.parquet(f"{path}/dictionary").first().id_bytes == 4
    out = {r.doc_id: list(r.ids) for r in token_files.read_token_files(spark, path).collect()}
    assert out == {1: ids_of(library, "a few words"), 2: [END_ID]}
    assert token_files.fetch_document(spark, path, 1) == [ids_of(library, "a few words")]


def test_a_changed_dictionary_is_found(spark):
    path = shared_path(spark, "test-dictionary")
    token_files.write_token_files(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path, TOKENIZER)
    spark.createDataFrame([("00", bytearray(b"x"), 2)], token_files.DICTIONARY).write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        token_files.read_token_files(spark, path)
