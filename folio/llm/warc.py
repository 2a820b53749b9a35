"""WARC archives: written as one gzip stream a file, normalised to one gzip member a record with an offset index, read back by it.

Files are written and read by Spark's own writers and readers alone, so any store that Spark reaches will do.
The text writer ends each row with a separator; records end in two line breaks, and a gzip member of a record below
16 MiB ends in a zero byte (a larger one is followed by an empty member, which does), so that what the writer adds is
part of the format.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import _store

ARCHIVE = 64 << 20  # bytes of payload a file, about
END = b"\r\n\r\n"
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()


def base32(hexadecimal: Column) -> Column:
    """Base32 of a 160-bit digest in hex: twenty bits, four signs, at a time."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def groups(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """payload_digest, payload_bytes, best (the largest key), n of payloads that stand in several rows."""
    payload = F.coalesce(F.col(column), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32(F.sha1(payload)).alias("payload_digest"))
    return rows.groupBy("payload_digest", "payload_bytes").agg(F.max("key").alias("best"), F.count("*").alias("n")).where("n > 1")


def described(pages: DataFrame, parts: int, total: int, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """key, url, payload, payload_bytes, payload_digest, record_type, refers_to of all `total` rows; payload is empty for revisits.

    Of rows with equal payloads that with the largest key is the response (rows that repeat that key too), the others
    revisit it. Null payloads are empty; null keys are below all others, and alone they are responses.

    Payloads that stand in very many rows are told by a broadcast of at most 2 * parts of them, and these rows are dealt
    evenly; the others meet their group in one shuffle.
    """
    payload = F.coalesce(F.col(column), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32(F.sha1(F.col("payload").cast("binary")))})
    met = _store.written(groups(pages, column, key), "payloads")
    by = ["payload_digest", "payload_bytes"]
    bound = max(total // (2 * parts), 1)
    hot = F.broadcast(met.where(F.col("n") > bound).select(*by, F.col("best").alias("top"), F.lit(True).alias("hot")))
    rows = rows.join(hot, by, "left")
    # a hot row needs no group any more: it gets a place by its key, and no payload unless it is the response
    first = F.col("key").eqNullSafe(F.col("top"))
    place = F.when(F.col("hot"), F.concat(F.lit("#"), F.xxhash64("key", "url").cast("string"))).otherwise(F.col("payload_digest"))
    rows = rows.withColumns({"place": place, "payload": F.when(F.col("hot") & ~first, "").otherwise(F.col("payload"))})
    cold = met.where(F.col("n") <= bound).select(F.col("payload_digest").alias("place"), "payload_bytes", "best")
    both = rows.repartition(parts, "place", "payload_bytes").join(cold, ["place", "payload_bytes"], "left")
    both = both.withColumn("best", F.when(F.col("hot"), F.col("top")).otherwise(F.col("best")))
    revisit = F.col("best").isNotNull() & ~F.col("key").eqNullSafe(F.col("best"))
    return both.select(
        "key", "url", F.when(revisit, "").otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"),
    )


def write_monolithic(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", column: str = "html") -> None:
    """A WARC record for every row, many records in one gzip stream a file. Other columns are not written."""
    size, total = pages.agg(F.sum(F.octet_length(F.col(column))), F.count("*")).first()
    parts = max(_store.shuffle_parts(pages.sparkSession), -(-(size or 0) // ARCHIVE))
    both = described(pages, parts, total, key, url, column)
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    response = F.col("record_type") == "response"
    block = F.concat(http, F.when(response, F.col("payload")).otherwise(""))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", address),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(response, "").otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    both.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


def _head(raw: bytes | bytearray, at: int = 0) -> tuple[int, int]:
    """Where the block of the record at `at` starts, counted from there, and how long it is; -1 if the header does not end in raw."""
    end = raw.find(END, at)
    if end < 0:
        return -1, 0
    size = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", raw[at : end + 2], re.I)
    if not size:
        raise ValueError("a record without a Content-Length")
    return end + 4 - at, int(size[1])


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one member or many, a piece at a time."""
    stream, view, at = zlib.decompressobj(31), memoryview(content), 0
    while at < len(content):
        piece = view[at : at + step]
        yield stream.decompress(piece)
        at += len(piece)
        if stream.eof:
            at -= len(stream.unused_data)
            stream = zlib.decompressobj(31)


def split_records(content: bytes) -> Iterator[bytes]:
    """The records of a gzip file, which is inflated once."""
    held, need = bytearray(), 0
    for piece in inflated(content):
        held += piece
        done = 0  # bytes of held already given out
        while len(held) - done >= need:
            start, size = _head(held, done)
            if start < 0:  # twice as much before the next look, lest a long header be searched again and again
                need = max(2 * (len(held) - done), 1 << 16)
                break
            need = start + size + len(END)
            if len(held) - done < need:
                break
            yield bytes(held[done : done + start + size])
            done, need = done + need, 0
        del held[:done]
    at = 0
    while at < len(held):  # the stream is over: what is left is whole records or a broken one
        if not bytes(held[at:]).strip(b"\r\n\0"):
            return
        start, size = _head(held, at)
        if start < 0 or at + start + size + len(END) > len(held):
            raise ValueError("the archive ends within a record")
        yield bytes(held[at : at + start + size])
        at += start + size + len(END)


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite every archive of `source` with one gzip member a record, in target/kind=warc, and beside it an index, in
    target/kind=index: lines of offset, length, record id, by files that share the archive's part number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, offset = 0, 0
        for b in batches:
            for content in b.column(0):
                for record in split_records(content.as_py()):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = z.compress(record + END) + z.flush()
                    if member[-1]:
                        member += _EMPTY
                    name = re.search(rb"\r\nWARC-Record-ID:[ \t]*([^\r]*)", record, re.I)
                    entry = b"%d %d %s" % (offset, len(member), name[1] if name else b"-")
                    yield pa.record_batch([pa.array(["warc", "index"]), pa.array([seq, seq], pa.int64()), pa.array([member[:-1], entry], pa.binary())], ["kind", "seq", "value"])
                    seq, offset = seq + 1, offset + len(member)

    files = spark.read.format("binaryFile").load(source).select("content")
    rows = files.mapInArrow(run, "kind string, seq long, value binary").sortWithinPartitions("kind", "seq")
    rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", "\0").text(target)


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"\r\n" + name + rb":[ \t]*([^\r]*)", head, re.I)
    return m[1] if m else None


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """Every record of the normalised archives, each inflated from its own place: key, payload_bytes, payload_digest,
    record_type, refers_to, url, payload (null for revisits). A response's payload is checked against its digest."""
    part = F.regexp_extract("path", r"part-(\d+)", 1)
    files = lambda kind: spark.read.format("binaryFile").load(f"{target}/kind={kind}")
    parts = max(files("index").select("path").count(), 1)  # a task an archive, about, however many there are
    archives = files("warc").select(part.alias("part"), F.col("content").alias("archive")).repartition(parts, "part")
    indexes = files("index").select(part.alias("part"), F.col("content").alias("index")).repartition(parts, "part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, index in zip(b.column(0), b.column(1), strict=True):
                raw, rows, size = memoryview(archive.as_py()), [], 0
                for entry in index.as_py().split(b"\0")[:-1]:
                    at, n, _ = entry.split(b" ", 2)
                    record = zlib.decompressobj(31).decompress(raw[int(at) : int(at) + int(n)])
                    start, length = _head(record)
                    head = record[:start]
                    name = _field(head, b"WARC-Record-ID")[len(b"<urn:page:") : -1]
                    other = _field(head, b"WARC-Refers-To")
                    kind, digest = _field(head, b"WARC-Type").decode(), _field(head, b"WARC-Payload-Digest")[5:].decode()
                    payload = None
                    if kind == "response":
                        block = record[start : start + length]
                        payload = block[block.index(END) + 4 :]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"record {name.decode()} does not match its digest")
                    rows.append((None if name == b"null" else int(name), int(_field(head, b"X-Payload-Length")), digest, kind, int(other[10:-1]) if other and other != b"<urn:page:>" else None, _field(head, b"WARC-Target-URI").decode(), payload))
                    size += len(payload or b"")
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return _store.batched(archives.join(indexes, "part").select("archive", "index")).mapInArrow(run, _RECORD)


_RECORD = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """Write archives of every row, normalise them, and read them back: key, payload_bytes, payload_digest, record_type, refers_to.

    An empty table gives an empty result; repeated rows give repeated records.
    """
    spark = pages.sparkSession
    if pages.isEmpty():
        return spark.createDataFrame([], _RECORD).drop("url", "payload").withColumnRenamed("key", key)
    source, target = _store.shared_dir(spark, "warc-source"), _store.shared_dir(spark, "warc")
    write_monolithic(pages, source, key, url, column)
    normalise(spark, source, target)
    _store.remove(spark, source)
    return read_records(spark, target).drop("url", "payload").withColumnRenamed("key", key)
