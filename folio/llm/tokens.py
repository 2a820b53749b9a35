"""Token ids as Parquet: list columns with delta or dictionary pages, set row groups, page indexes.

Rows stand in ascending key order over all files and within each. Every row carries its place
(`part`, `local_start`), so the number of ids before a document follows from one sum per file part,
and readers can fetch metadata without touching the ids, or the ids of a key range through page indexes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import _store, _text, bpe

ROW_GROUP = 32 << 20  # bytes
PAGE = 256 << 10
PAGE_ROWS = 2000


def write_tokens(docs: DataFrame, path: str, vocab_path: str, end_id: int, lexicon: str | None = None, key: str = "doc_id", column: str = "text", encoding: str = "delta") -> None:
    """Encode every whole text of docs, append end_id to each, and write part, key, local_start, n_tokens, ids.

    Null and empty texts give the end id alone. Rows of equal keys stand in the order of a hash of their texts, then of the
    texts, so that one key's rows may fill several files; null keys come first. An empty table gives files without rows. Columns beside key and column are not written.
    encoding: "delta" (DELTA_BINARY_PACKED) or "dictionary" pages for the ids.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe._encoder(vocab_path, lexicon)
        part, before = TaskContext.get().partitionId(), 0
        for b in _text.chunks(batches, "text"):
            ids, rows = enc(b.column(1).to_pylist())
            n = np.diff(rows) + 1
            ends = np.cumsum(n)
            out = np.full(ends[-1], end_id, np.int32)
            out[_text.ranges(ends - n, n - 1)] = ids
            o = np.concatenate([[0], ends])
            yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(before + o[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(out))], ["part", "key", "local_start", "n_tokens", "ids"])
            before += int(ends[-1])

    parts = _store.parts_for(docs, column)
    hashed = docs.select(F.col(key).alias("key"), F.col(column).alias("text"), F.xxhash64(F.col(column)).alias("hash"))
    ordered = hashed.repartitionByRange(parts, "key", "hash").sortWithinPartitions("key", "hash", "text").select("key", "text")
    rows = _store.batched(ordered).mapInArrow(run, f"part int, key {kind}, local_start long, n_tokens long, ids array<int>").withColumnRenamed("key", key)
    (
        rows.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Metadata alone: part, key, start (ids of all documents before it), n_tokens."""
    rows = spark.read.parquet(path).select("part", key, "local_start", "n_tokens")
    return rows.join(F.broadcast(_bases(spark, path)), "part").select("part", key, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each file part: as many rows as there are parts."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids of every document, from the files."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(_bases(spark, path)), "part").select(key, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of rows of read_tokens."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            o = ids.offsets.to_numpy()
            raw = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.diff(o).astype(np.int64)), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    out = tokens.select(F.col(key).alias("key"), "start", "n_tokens", "ids").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)
