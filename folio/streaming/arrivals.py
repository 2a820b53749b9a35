"""Document files as they arrive: the batch readers over a stream of files (an extension; nothing here knows event time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.sources import files

_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, want: str = "lines", files_a_batch: int = 100) -> DataFrame:
    """A streaming frame of the rows of every file that comes into a folder."""
    stream = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_a_batch).load(path)
    return files.read(stream, want)
