"""Where operators put what executors must share: the session's checkpoint folder; and how rows meet a table that hot keys would skew."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "8m"  # bytes of a batch between Spark and a worker
READ_ROWS = 512  # rows that a scan decodes at once: the default of 4,096 long texts fills a JVM with arrays of many MB
ROW_GROUP = 16 << 20  # bytes that a writer of intermediate tables holds
PART = 128 << 20  # bytes of text a task of a shuffle is meant to get


_made: list[str] = []  # by this driver, and not yet removed


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset (tests), under the warehouse folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there. forget() removes it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    swept(spark)
    return out


def swept(spark: SparkSession) -> None:
    """The driver collects what finished writes left (plans, metrics, broadcasts, records of shuffles). Else it does so when its
    heap is full, and with many rounds the heap grows to several times what is in use."""
    gc.collect()  # what Python refers to, the JVM keeps
    spark.sparkContext._jvm.System.gc()


def forget(*frames: DataFrame) -> None:
    """Remove what written() wrote: for frames that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._written_to)


def release(spark: SparkSession, known: set[str]) -> None:
    """Remove all that was put into the shared folder since made() gave `known`."""
    for path in made() - known:
        remove(spark, path)


def made() -> set[str]:
    return set(_made)


def remove(spark: SparkSession, path: str) -> None:
    if path in _made:
        _made.remove(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of a few MB at a path of any store that Spark writes."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()


def batched(df: DataFrame) -> DataFrame:
    """df, with batches to workers, and of scans, bounded in its session: texts of any length make the defaults of 10,000 and
    4,096 rows unbounded."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    return df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(docs: DataFrame, column: str, size: int = PART) -> int:
    """How many shuffle partitions the texts of docs need, by their bytes; the session's own number at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(shuffle_parts(docs.sparkSession), -(-total // size))


def matched(rows: DataFrame, table: DataFrame, on: str, total: int) -> DataFrame:
    """rows joined with table, which has one row a value of `on` and says in n how many of rows (`total` at most) have it.

    Values that hold more than one in 2 * (shuffle partitions) of all rows are joined by broadcast, and there are at most
    that many of them; the others by a shuffle, in which none fills a task. Column n is left out.
    """
    bound = max(total // (2 * shuffle_parts(rows.sparkSession)), 1)
    hot = F.broadcast(table.where(F.col("n") > bound).drop("n"))
    by_broadcast = rows.join(hot, on)
    others = rows.join(hot.select(on), on, "left_anti")
    return by_broadcast.unionByName(others.join(table.where(F.col("n") <= bound).drop("n"), on))
