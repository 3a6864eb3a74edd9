"""Token ids as files: one zstandard frame for each document, a dictionary shared by all.

Format. A folder with two Parquet tables. `dictionary` has one row: its sha256 and bytes (zstandard,
trained on serialized id arrays; empty if there are too few documents to train one), and id_bytes. `blocks` has a
row for each block of a shard: shard, block, start (ids of the shard before the block), dict_sha256,
doc_ids, n_tokens, offsets (where each document's frame begins in payload, and its length at last) and
payload. Ids are little-endian, of id_bytes each: 2, or 4 if the vocabulary needs it. Shards follow ascending
ids, and an id with more rows than a shard takes has several, dealt in turn; every shard is one task's work, written under Spark's commit protocol, so a lost executor's
shard is written again. To read one document, the row groups' bounds of first_id and last_id and
its two offsets lead to its frame alone.

Documents with a null id come first; a null text is empty and holds the end id only. Repeated ids
keep all their rows, in some order. An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.llm.bpe import Encoder, Vocabulary, worker_encoder
from gridlake.llm.common import only_ids, shared_path, stage_table

BLOCK_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on the documents of least id hash, so many at most, and so many ids of each.
SAMPLE_DOCUMENTS, SAMPLE_IDS = 1_000, 4_096
DOCS_A_SHARD, MOST_SHARDS = 8_192, 20_000
NO_ID = -(1 << 63)  # where rows with a null id stand
DICTIONARY = "dict_sha256 string, dictionary binary, id_bytes int"


def _kind(size: int) -> str:
    """How ids of a vocabulary of this size are written."""
    return "<u2" if size <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, vocabulary_path: str) -> bytes:
    ids = docs.where(F.length("text") > 0).select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    ids = stage_table(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS), "token-sample")
    texts = only_ids(docs, ids).join(F.broadcast(ids), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("t")).orderBy("doc_id").collect()  # SAMPLE_DOCUMENTS at most
    v = Vocabulary(vocabulary_path)
    e, kind = Encoder(v), _kind(v.size)
    parts = [np.asarray(e.encode_whole(r.t)[:SAMPLE_IDS], kind).tobytes() for r in rows]
    if len(parts) < 100 or sum(map(len, parts)) < 10 * DICTIONARY_BYTES // 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too short: frames go without a dictionary
        return b""


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 2) -> None:
    """Encodes documents (doc_id, text) and writes them in ascending doc_id order."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    shared = train_dictionary(docs, vocabulary_path)
    sha = hashlib.sha256(shared).hexdigest()
    id_bytes = np.dtype(_kind(Vocabulary(vocabulary_path).size)).itemsize
    spark.createDataFrame([(sha, bytearray(shared), id_bytes)], DICTIONARY).coalesce(1).write.parquet(f"{path}/dictionary")
    total = docs.count()
    shards = min(MOST_SHARDS, max(1, -(-total // DOCS_A_SHARD)))
    cuts = []
    if shards > 1:
        known = F.coalesce("doc_id", F.lit(NO_ID))
        cuts = docs.agg(F.percentile_approx(known, [i / shards for i in range(1, shards)], 100 * shards)).first()[0] or []
    edges = np.asarray(sorted(cuts), np.int64)

    def encode(batches):
        e = worker_encoder(vocabulary_path)
        kind = _kind(e.v.size)
        z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        seen = 0
        for b in batches:
            n, frames = [], []
            for t in b.column(1):
                ids = np.asarray(e.encode_whole(t.as_py() or "") + [end_id], kind)
                n.append(len(ids))
                frames.append(z.compress(ids.tobytes()))
            given = b.column(0)
            known = np.asarray(given.fill_null(NO_ID), np.int64)
            low, high = np.searchsorted(edges, known, side="left"), np.searchsorted(edges, known, side="right")
            # an id at several edges has as many shards; rows are counted, so that equal ones part too
            dealt = (np.fromiter(map(zlib.crc32, frames), np.int64, len(frames)) + seen + np.arange(len(frames))) % np.maximum(high - low, 1)
            seen += len(frames)
            shard = (high - dealt).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), given, pa.array(n, pa.int64()), pa.array(frames, pa.binary())],
                ["shard", "doc_id", "n_tokens", "frame"],
            )

    def pack(batches):
        cols = ("doc_ids", "n_tokens", "frames")
        held: dict[str, list] = {c: [] for c in cols}
        state = {"shard": None, "block": 0, "start": 0, "bytes": 0}
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())

        def block():
            offsets = np.cumsum([0, *map(len, held["frames"])]).tolist()
            known = [i for i in held["doc_ids"] if i is not None]
            row = (state["shard"], state["block"], state["start"], sha, min(known, default=None), max(known, default=None), held["doc_ids"], held["n_tokens"], offsets, b"".join(held["frames"]))
            out = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], BLOCK_NAMES)
            state["start"] += sum(held["n_tokens"])
            state["block"] += 1
            state["bytes"] = 0
            for c in cols:
                held[c] = []
            return out

        for b in batches:
            for shard, doc_id, n, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held["frames"] and (shard != state["shard"] or state["bytes"] >= BLOCK_BYTES):
                    yield block()
                if shard != state["shard"]:
                    state.update(shard=shard, block=0, start=0)
                held["doc_ids"].append(doc_id)
                held["n_tokens"].append(n)
                held["frames"].append(frame)
                state["bytes"] += len(frame) + 24
        if held["frames"]:
            yield block()

    (
        docs.mapInArrow(encode, "shard int, doc_id long, n_tokens long, frame binary")
        .repartitionById(len(edges) + 1, F.col("shard"))
        .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "n_tokens", "frame")
        .mapInArrow(pack, BLOCKS)
        .write.parquet(f"{path}/blocks")
    )


BLOCKS = "shard int, block int, start long, dict_sha256 string, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    """The dictionary and how ids are written."""
    row = spark.read.schema(DICTIONARY).parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dict_sha256:
        raise ValueError("the dictionary does not match its hash")
    return data, f"<u{row.id_bytes}"


def _frames(b: pa.RecordBatch, row: int, sha: str):
    """doc_id, n_tokens and frame of each document of a block."""
    got = {c: b.column(c)[row] for c in ("doc_ids", "n_tokens", "offsets", "payload", "dict_sha256")}
    if got["dict_sha256"].as_py() != sha:
        raise ValueError("a block names another dictionary")
    payload, at = got["payload"].as_buffer(), got["offsets"].as_py()
    for i, (doc_id, n) in enumerate(zip(got["doc_ids"].as_py(), got["n_tokens"].as_py(), strict=True)):
        yield doc_id, n, payload[at[i] : at[i + 1]]


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with keep_ids, ids."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shared, kind = _dictionary(spark, path)
    sha = hashlib.sha256(shared).hexdigest()
    # one row for each shard, MOST_SHARDS at most
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches):
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        for b in batches:
            for row in range(b.num_rows):
                at = b.column("at")[row].as_py()
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, n, frame in _frames(b, row, sha):
                    ids = np.frombuffer(z.decompress(frame), kind)
                    if len(ids) != n:
                        raise ValueError(f"document {doc_id} has {len(ids)} ids, not {n}")
                    for c, x in zip(out, (doc_id, at, n, zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if keep_ids else None), strict=True):
                        c.append(x)
                    at += n
                cols = [pa.array(c, pa.int64()) for c in out[:4]]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(out[4], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return (
        blocks.join(F.broadcast(starts), "shard")
        .select((F.col("before") + F.col("start")).alias("at"), "dict_sha256", "doc_ids", "n_tokens", "offsets", "payload")
        .mapInArrow(run, schema)
    )


def fetch_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of one document, a list for each row that has this id; reads only blocks whose bounds allow it."""
    shared, kind = _dictionary(spark, path)
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    hit = blocks.select(F.arrays_zip(F.col("doc_ids").alias("i"), F.slice("offsets", 1, F.size("doc_ids")).alias("a"), F.slice("offsets", 2, F.size("doc_ids")).alias("b")).alias("z"), "payload")
    hit = hit.select(F.explode(F.filter("z", lambda x: x["i"] == doc_id)).alias("x"), "payload")
    frames = hit.select(F.expr("substring(payload, cast(x.a as int) + 1, cast(x.b - x.a as int))").alias("f")).collect()
    return [np.frombuffer(z.decompress(bytes(r.f)), kind).tolist() for r in frames]


def round_trip(docs: DataFrame, vocabulary_path: str, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary_path, end_id)
    return read_token_files(docs.sparkSession, path, keep_ids)
