"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one shard aims at. A shard is what one Python call holds; a longer text is a shard by itself.
SHARD_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Sizes Arrow batches by bytes, and sees to a checkpoint folder.

    The folder is the one that the cluster names in spark.checkpoint.dir. Where that is unset, a session on one machine
    (local tests) gets a temporary one; on a cluster, whose executors couldn't read it, this is an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    # Rows dealt by a part of the keys of a join stay where they are.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_id() -> str:
    return uuid.uuid4().hex[:12]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that prepare() has seen to."""
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written as a compressed table in the shared folder and read again, and its path: smaller than a checkpoint of
    long texts. Whoever has it written removes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{run_id()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: the given one, with underscores in front where it is taken."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def shards(df: DataFrame, text: str) -> int:
    """How many shards a table needs: its text bytes over SHARD_BYTES."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0]
    return max(1, -(-int(total or 0) // SHARD_BYTES))


def pack(values: np.ndarray) -> bytes:
    """Variable-length bytes of unsigned integers, seven bits a byte, low bits first."""
    v = values.astype(np.uint64)
    if not len(v):
        return b""
    length = np.ones(len(v), np.int64)
    top = int(v.max())
    for k in range(1, 10):
        if top >> (7 * k) == 0:
            break
        length += v >= np.uint64(1 << (7 * k))
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]), np.uint8)
    at = ends - length
    for k in range(int(length.max())):
        more = length > k + 1
        out[at] = (v & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        if not more.any():
            break
        v, at, length = v[more] >> np.uint64(7), at[more] + 1, length[more]
    return out.tobytes()


def unpack(data: bytes | np.ndarray) -> np.ndarray:
    """What pack() was given, as unsigned 64-bit integers."""
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    if not len(raw):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    length = ends - starts
    out = (raw[starts] & 127).astype(np.uint64)
    for k in range(1, int(length.max()) + 1):
        has = np.flatnonzero(length >= k)
        out[has] |= (raw[starts[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hash of each run of `width` hashes, modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= np.uint64(factor)
        out += hashes[k : k + n]
    return out
