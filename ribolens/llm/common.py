"""Shared helpers of the training-data operators: the shared folder, tables written there, row batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A key with more than 1 / HOT of a table's rows is dealt over COPIES tasks in a join.
HOT, COPIES = 256, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing and driver and tasks are one process (local tests), a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ribolens-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application has written with materialize(); results that still read it must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the number's column.

    Where each row has a doc_id of its own, that is its number; else rows are numbered and written, so that every reading
    gives a row the same number.
    """
    ids = F.col("doc_id")
    if dict(docs.dtypes)["doc_id"] == "bigint" and docs.groupBy(ids).agg(F.count(F.lit(1)).alias("n")).filter(ids.isNull() | (F.col("n") > 1)).isEmpty():
        return docs, "doc_id"
    column = "row"
    while column.lower() in map(str.lower, docs.columns):
        column += "_"
    return materialize(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold more than 1 / HOT of the rows, fewer than HOT of them; none where each has under HOT rows."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT, rows.count() // HOT)
    return [r[0] for r in counts.filter(F.col("n") > least).select(key).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list, spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` by ``key``; the rows of each key in ``hot`` are dealt over COPIES tasks by the hash of the
    left column ``spread``, and the key's rows of ``right`` are copied to each of them."""
    if not hot:
        return left.join(right, key, how)
    some = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salt = F.when(some, F.pmod(F.xxhash64(spread), F.lit(COPIES)).cast("int")).otherwise(0)
    salts = F.when(some, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    joined = left.withColumn("salt", salt).join(right.withColumn("salt", F.explode(salts)), [key, "salt"], how)
    return joined.drop("salt")


def parallel(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves the remainder 0 of 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def freeing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on batches, after which the Python worker, which waits for other tasks, gives unused memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut large Arrow batches, so that what a step derives from one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
