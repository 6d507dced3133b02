"""Shared plumbing: scratch tables, row keys, session settings, word streams."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoquarry.shipping import ship

def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors: the cluster's ``spark.checkpoint.dir``.

    Only a local session (driver and executors on one machine) may fall back to a
    temporary folder; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="memoquarry-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


class Scratch:
    """Parquet tables that cut lineage; they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark, self.base = spark, f"{scratch_root(spark).rstrip('/')}/memoquarry/{operator}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tune(spark: SparkSession) -> None:
    """Send the package to the executors; small Arrow batches: one of very long texts must fit a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def give_back() -> None:
    """Return this process's freed memory to the system; both allocators else keep what a task's largest step took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def lean(run):
    """An Arrow step whose Python worker, which outlives its task and stands by, gives back the task's memory."""

    def step(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return step


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Steps that give the same rows in the same places each time they run.
ROW_WISE = ("Scan", "BatchScan", "FileScan", "Filter", "Project", "ColumnarToRow", "MapInArrow", "MapInPandas", "LocalTableScan", "Union")


def narrow(df: DataFrame) -> bool:
    """Whether a plan is a scan with row-wise steps, whose partitions are the same each time it runs."""

    def stable(node) -> bool:
        kids = node.children()
        return node.nodeName().split(" ")[0] in ROW_WISE and all(stable(kids.apply(i)) for i in range(kids.size()))

    return stable(df._jdf.queryExecution().sparkPlan())


def keyed(df: DataFrame, scratch: Scratch, name: str = "keyed") -> DataFrame:
    """Add ``rid``, unique for each row (repeated rows and null or repeated ids included).

    The key is the row's place in the scan.  A plan with a shuffle may order its rows
    anew when a lost task runs again, so it is written out first.
    """
    df = df if narrow(df) else scratch.write(df, name)
    return df.withColumn("rid", F.monotonically_increasing_id())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hashes(dict):
    """word -> 64-bit hash, remembered up to ``most`` words and then begun anew."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.most, self.of = most, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.of(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length) one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def binaries(column) -> list:
    """The values of an Arrow string column as UTF-8 bytes (None for null)."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
