"""A bounded sample of labelled rows for fitting, the same for every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import _store

ROWS = 4000  # labelled rows that a model is fitted on, at most


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n (null keys: that of the empty text)."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, key: str = "doc_id", column: str = "text", rows: int = ROWS) -> DataFrame:
    """place, text and label (0 or 1) of up to `rows` rows whose key is labelled and allowed, those of least hash of the key;
    whole texts, of a repeated key the text of least hash. Written to the shared folder (_store.forget removes it), so
    that workers, not the driver, read the texts; place orders the rows."""
    marks = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col(key).isNotNull())
    marks = marks.groupBy(key).agg(F.max("label").alias("label")).where(allowed)
    order = Window.orderBy(F.xxhash64(key), key)
    chosen = marks.orderBy(F.xxhash64(key), key).limit(rows)  # a bounded number of keys: broadcast below
    chosen = chosen.withColumn("place", F.row_number().over(order) - 1)
    both = docs.select(key, F.col(column).alias("text")).where(F.col(column).isNotNull()).join(F.broadcast(chosen), key)
    least = both.groupBy("place", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("s"))
    return _store.written(least.select("place", "s.text", "label"), "labelled")
