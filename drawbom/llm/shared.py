"""What the operators share: tables settled in the cluster's shared folder, byte
views of Arrow columns and rolling hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`. Only a single-JVM session, as
    in tests, may do without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends here
    and later stages do not depend on executors that may be lost."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later stage reads, and let the driver forget their
    plans, so that shuffle files of finished stages go too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def bytes_of(column: str = "text"):
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column end to end, and the row offsets into them."""
    array = array.fill_null(b"") if array.null_count else array
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges of at most `limit` bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a sequence, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) + 1
        if len(self.up) < n:
            up, down = np.full(n * 2, self.base, np.uint64), np.full(n * 2, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        sums = np.zeros(n, np.uint64)
        np.cumsum(codes * self.up[:n - 1], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each run of `width` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column with so many of the values in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
