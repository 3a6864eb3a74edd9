"""What the training-data operators share: shared storage, byte tables, id filters, table reading."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case; every other byte stays.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: As LOWER, and ASCII bytes that are neither letters nor digits become spaces. Bytes from 0x80 up
#: belong to non-ASCII characters, all of which count as word characters.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches between Spark and Python workers end at BATCH_BYTES from now on, unless the session names
    a bound of its own. A batch is held several times over on both sides, and at Spark's bounds (10,000 rows,
    64 MB) one can be a whole partition of documents. No result depends on batches."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, as in
    tests on one machine, a new temporary folder is set for the session; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridlake.shared.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = tempfile.mkdtemp(prefix="gridlake-")
        spark.conf.set("gridlake.shared.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridlake/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and any
    executor can read it after another is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for t in tables:
        jvm, jsc = t.sparkSession._jvm, t.sparkSession._jsc
        at = jvm.org.apache.hadoop.fs.Path(t.staged_at)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def free_name(name: str, taken) -> str:
    """name, with underscores behind it until no column of taken has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def crc_fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5; fold 0 is held out from all training."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)).cast("int")


def held_out(doc_id: str = "doc_id"):
    """True for fold 0; a null id is in no fold and teaches nothing, so it isn't held out."""
    return F.coalesce(crc_fold(doc_id) == 0, F.lit(False)).alias("held_out")


FILTER_BITS = 1 << 23


def id_bucket(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FILTER_BITS))


def id_bits(ids: DataFrame, id_col: str = "doc_id"):
    """A bitmap of fixed size (1 MB) of the ids, as a broadcast variable for bits_hold()."""
    parts = (
        ids.select((id_bucket(id_col) + 1).alias("b"))  # bitmap functions count from 1
        .groupBy(F.bitmap_bucket_number("b").alias("n"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
        .collect()  # at most FILTER_BITS / 32768 rows of 4 KB
    )
    flags = np.zeros(FILTER_BITS, np.bool_)
    for n, bits in parts:
        lo = (n - 1) * 32768
        got = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        at = lo + np.flatnonzero(got)
        flags[at] = True
    return ids.sparkSession.sparkContext.broadcast(np.packbits(flags).tobytes())


def bits_hold(bits: bytes, bucket: np.ndarray) -> np.ndarray:
    """Which buckets (of id_bucket) the bitmap holds."""
    return (np.frombuffer(bits, np.uint8)[bucket >> 3] >> (7 - (bucket & 7))) & 1 == 1


def only_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of df whose id may be in ids: the bitmap drops most others at the scan, before an exact join
    moves them. Never drops a row whose id is in ids."""
    shared = id_bits(ids)
    may_hold = F.pandas_udf(lambda v: pd.Series(bits_hold(shared.value, v.to_numpy(np.int64))), "boolean")
    return df.where(F.col(id_col).isNotNull()).where(may_hold(id_bucket(id_col)))
