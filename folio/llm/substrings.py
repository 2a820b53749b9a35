"""Removal of repeated word sequences by super-k-mer partitioning.

Every window of `size` words belongs to the bucket of its minimiser, the least hash of its runs of
MER words. Consecutive windows with one minimiser travel as one packed string, and in its bucket
sorting brings equal windows together; equality is checked byte for byte. Windows that repeat within
a chunk of a map task are settled there, so that a passage with a million copies reaches its bucket
once a chunk. Partitions follow the bytes of all texts. Minimisers that a sample of documents shows to
fill a good part of a partition are refined by a second minimiser, over longer runs of words; what is
in a bucket beyond LARGE bytes is counted in several passes, each over some of the window hashes, where
equality is that of two independent 64-bit hashes. No document text is gathered by group, and no window
stands alone on the wire.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _store, _text

MER = 2
CHUNK = 4 << 20  # bytes of text in which a map task settles repeats itself
FINE = 16  # buckets for each shuffle partition; one bucket at a time is in memory
LONG_MER = 8  # words of the runs that part the windows of a frequent minimiser
SAMPLED = 64  # one in so many documents is looked at for frequent minimisers
MOST_FREQUENT = 4096  # minimisers that are refined; what more there are is left to the passes over large buckets
LARGE = 24 << 20  # plain bytes of a bucket that are counted at once
_ZSTD = pa.Codec("zstd", 5)
NULL_ID = -(1 << 63)
_SHIPPED = "bucket int, blob binary, k long, h long, starts array<int>, ends array<int>"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i at which that many stand."""
    n, span, out = len(x) - width + 1, 1, x
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def _spans(at: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at words `at` (ascending) of rows `row`: the row, first word and end of each stretch of words they cover."""
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + size)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(at)) - 1
    return row[heads], at[heads], at[last] + size


def _lists(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Stretches (ascending by row) as one list a row."""
    which, first = np.unique(rows, return_index=True)
    o = pa.array(np.append(first, len(rows)), pa.int32())
    return which, pa.ListArray.from_arrays(o, pa.array(starts, pa.int32())), pa.ListArray.from_arrays(o, pa.array(ends, pa.int32()))


def _ranges_batch(k: np.ndarray, h: np.ndarray, bucket: np.ndarray, starts: pa.Array, ends: pa.Array) -> pa.RecordBatch:
    n = len(k)
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.nulls(n, pa.binary()), pa.array(k), pa.array(h), starts, ends], ["bucket", "blob", "k", "h", "starts", "ends"])


def _minimisers(hashes: np.ndarray, at: np.ndarray, size: int, mer: int = MER) -> np.ndarray:
    """The minimiser of each window at words `at`."""
    ends = np.arange(mer, len(hashes) + 1)
    mers = _text.mix(_text.spans_hash(hashes, ends - mer, ends) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return _sliding_min(mers, size - mer + 1)[at]


def frequent_minimisers(keyed: DataFrame, size: int, parts: int) -> np.ndarray:
    """The minimisers (sorted) of more than one in 2 * parts of the windows of a sample of documents; MOST_FREQUENT at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text", CHUNK):
            words = _text.Words(b.column(0))
            hashes = words.hashes()
            at, _ = _text.windows(words, hashes, size)
            if len(at):
                m, n = np.unique(_minimisers(hashes, at, size), return_counts=True)
                every = pa.array([None], pa.int64())  # all windows
                yield pa.record_batch([pa.concat_arrays([pa.array(m.view(np.int64)), every]), pa.array(np.append(n, len(at)))], ["m", "n"])

    some = keyed.where(F.pmod(F.xxhash64("k", "h"), F.lit(SAMPLED)) == 0).select("text")
    counts = _store.batched(some).mapInArrow(count, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "m").limit(min(2 * parts, MOST_FREQUENT) + 1).collect()
    total = next((r.n for r in top if r.m is None), 0)
    return np.sort(np.array([r.m for r in top if r.m is not None and r.n * 2 * parts > total], np.int64).view(np.uint64))


def _pack(batch: pa.RecordBatch, size: int, buckets: int, frequent: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A chunk (k, h, text): stretches it can settle alone, and its other windows as packed super-k-mers by bucket."""
    k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    order = np.lexsort((h, k))
    keep = np.ones(len(order), bool)
    keep[1:] = (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])
    order = order[keep]
    k, h = k[order], h[order]
    words = _text.Words(batch.column(2).take(pa.array(order)))
    hashes = words.hashes()
    at, wh = _text.windows(words, hashes, size)
    if not len(at):
        return
    import pandas as pd

    row = np.repeat(np.arange(words.n), words.counts)
    code, _ = pd.factorize(wh)
    first = np.empty(code.max() + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    again = np.flatnonzero(first[code] != np.arange(len(code)))
    again = again[words.same_windows(at[again], at[first[code[again]]], size)]
    if len(again):
        r, s, e = _spans(at[again], row[at[again]], size)
        which, ls, le = _lists(r, s - words.rows[r], e - words.rows[r])
        yield _ranges_batch(k[which], h[which], (_text.mix((h ^ k)[which].view(np.uint64)) % np.uint64(buckets)).astype(np.int32), ls, le)
    left = np.ones(len(at), bool)
    left[again] = False
    at = at[left]
    if not len(at):
        return
    least = _minimisers(hashes, at, size)
    if frequent is not None and len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, least), len(frequent) - 1)] == least
        if hot.any():
            least[hot] = _text.mix(least[hot] ^ _text.mix(_minimisers(hashes, at[hot], size, min(LONG_MER, size))))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(at)))
    a = at[heads]
    bucket = (_text.mix(least[heads]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    a, count, bucket = a[by], count[by], bucket[by]
    r = row[a]
    s, e = words.starts[a], words.ends[a + count + size - 2]
    raw = memoryview(np.ascontiguousarray(words.data))
    head = np.stack([k[r], h[r], a - words.rows[r], count, e - s], 1)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    blobs = []
    for x, y in zip(cuts, np.append(cuts[1:], len(a)), strict=True):
        plain = np.int64(y - x).tobytes() + np.ascontiguousarray(head[x:y].T).tobytes() + b"".join([raw[p:q] for p, q in zip(s[x:y].tolist(), e[x:y].tolist(), strict=True)])
        blobs.append(len(plain).to_bytes(8, "little") + _ZSTD.compress(plain, asbytes=True))
    n = len(blobs)
    none = pa.nulls(n, pa.list_(pa.int32()))
    yield pa.record_batch([pa.array(bucket[cuts], pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), none, none], ["bucket", "blob", "k", "h", "starts", "ends"])


def _plain(blobs: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The heads (k, h, place, windows, bytes; a column a super-k-mer) and texts of packed blobs."""
    heads, texts = [], []
    for blob in blobs:
        plain = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
        n = int(np.frombuffer(plain, np.int64, 1)[0])
        heads.append(np.frombuffer(plain, np.int64, 5 * n, 8).reshape(5, n))
        texts.append(plain[8 + 40 * n :])
    return np.concatenate(heads, 1), texts


def _count_large(blobs: list[bytes], size: int, bucket: int, large: int) -> Iterator[pa.RecordBatch]:
    """_count of a bucket too large to unpack at once: pass by pass over a part of the window hashes."""
    sizes = np.array([int.from_bytes(blob[:8], "little") for blob in blobs])
    ways, groups = int(-(-sizes.sum() // large)), np.cumsum(sizes) // max(large // 8, 1)
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(blobs)]
    for way in range(ways):
        parts = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            head, texts = _plain(blobs[x:y])
            words = _text.Words(_text.string_array(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(head[4])])))
            hashes = words.hashes()
            at, wh = _text.windows(words, hashes, size)
            mine = (wh >> np.uint64(33)) % np.uint64(ways) == way
            at, wh = at[mine], wh[mine]
            unit = np.repeat(np.arange(words.n), words.counts)[at]
            _, other = _text.windows(words, _text.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), size)
            parts.append((wh, other[mine], head[0][unit], head[1][unit], head[2][unit] + at - words.rows[unit]))
        wh, other, k, h, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.lexsort((place, h, k, other, wh))
        wh, other, k, h, place = (c[by] for c in (wh, other, k, h, place))
        run = np.ones(len(by), bool)
        run[1:] = (wh[1:] != wh[:-1]) | (other[1:] != other[:-1])
        first = np.maximum.accumulate(np.where(run, np.arange(len(by)), 0))
        again = np.flatnonzero((k != k[first]) | (h != h[first]) | (place != place[first]))
        again = again[np.lexsort((place[again], h[again], k[again]))]
        if not len(again):
            continue
        k, h, place = k[again], h[again], place[again]
        new = np.ones(len(again), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        doc = np.cumsum(new) - 1
        r, s, e = _spans(place, doc, size)
        which, ls, le = _lists(r, s, e)
        of = np.flatnonzero(new)[which]
        yield _ranges_batch(k[of], h[of], np.full(len(which), bucket), ls, le)


def _count(blobs: list[bytes], size: int, bucket: int, large: int = LARGE) -> Iterator[pa.RecordBatch]:
    """All super-k-mers of a bucket: the stretches covered by windows that also start earlier."""
    if sum(int.from_bytes(blob[:8], "little") for blob in blobs) > large:
        yield from _count_large(blobs, size, bucket, large)
        return
    head, texts = _plain(blobs)
    order = np.lexsort((head[2], head[1], head[0]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum(head[4])
    moved, o = _text.gather(data, (end - head[4])[order], end[order])
    k, h, start = head[0][order], head[1][order], head[2][order]
    words = _text.Words(_text.string_array(moved, o))
    at, wh = _text.windows(words, words.hashes(), size)
    by = np.argsort(wh, kind="stable")
    run = np.ones(len(by), bool)
    run[1:] = wh[by][1:] != wh[by][:-1]
    first = np.empty(len(by), np.int64)
    first[by] = by[np.maximum.accumulate(np.where(run, np.arange(len(by)), 0))]
    unit = np.repeat(np.arange(words.n), words.counts)[at]
    place = start[unit] + at - words.rows[unit]
    elsewhere = (k[unit] != k[unit[first]]) | (h[unit] != h[unit[first]]) | (place != place[first])
    again = np.flatnonzero((first != np.arange(len(by))) & elsewhere)
    equal = words.same_windows(at[again], at[first[again]], size)
    if not equal.all():  # different windows with one hash: told apart by their words
        mixed = set(wh[again[~equal]].tolist())
        again = again[~np.isin(wh[again], list(mixed))]
        seen: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(np.isin(wh, list(mixed))):
            text = b" ".join(words.data[words.starts[x] : words.ends[x]].tobytes() for x in range(at[i], at[i] + size))
            j = seen.setdefault(text, i)
            if j != i and (k[unit[i]], h[unit[i]], place[i]) != (k[unit[j]], h[unit[j]], place[j]):
                more.append(i)
        again = np.sort(np.concatenate([again, np.array(more, np.int64)]))
    if not len(again):
        return
    new = np.ones(words.n, bool)  # super-k-mers of one document stand together
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    doc = np.cumsum(new) - 1
    r, s, e = _spans(place[again], doc[unit[again]], size)
    which, ls, le = _lists(r, s, e)
    of = np.flatnonzero(new)[which]
    yield _ranges_batch(k[of], h[of], np.full(len(which), bucket), ls, le)


def _settle(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for b in batches:
            done = b.filter(b.column(1).is_null())
            if done.num_rows:
                yield done
            b = b.filter(b.column(1).is_valid())
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from _count(held, size, now)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from _count(held, size, now)

    return run


def repeated_spans(docs: DataFrame, size: int = 20, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The stretches of words to remove: k (key, null as the least long), h (hash of the text), starts and ends (lists; they may overlap)."""
    keyed = _keyed(docs, key, column)
    parts = _store.parts_for(docs, column)
    buckets = parts * FINE
    frequent = frequent_minimisers(keyed, size, parts)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text", CHUNK):
            yield from _pack(b, size, buckets, frequent)

    shipped = _store.batched(keyed).mapInArrow(pack, _SHIPPED)
    dealt = shipped.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_settle(size), _SHIPPED)
    return found.groupBy("k", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def _keyed(docs: DataFrame, key: str, column: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(F.col(column)).alias("h"), F.col(column).alias("text"))


def _kept(words: _text.Words, starts: pa.Array, ends: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words left of each text, joined by one space, as bytes and offsets, and how many words went."""
    n = len(words)
    gone = np.zeros(n + 1, np.int64)
    for column, step in ((starts, 1), (ends, -1)):
        sizes = np.diff(column.offsets.to_numpy())
        np.add.at(gone, np.repeat(words.rows[:-1], sizes) + column.flatten().to_numpy(), step)
    left = np.cumsum(gone)[:-1] == 0
    total = np.concatenate([[0], np.cumsum(left)])
    kept_in_row = total[words.rows[1:]] - total[words.rows[:-1]]
    which = np.flatnonzero(left)
    s, e = words.starts[which], words.ends[which].copy()
    last = np.cumsum(kept_in_row)[kept_in_row > 0] - 1
    joined = np.ones(len(which), bool)
    joined[last] = False
    size = len(words.data)
    buf = np.append(words.data, np.uint8(0x20))
    buf[e[joined]] = 0x20
    mask = np.zeros(size + 2, np.int8)
    np.add.at(mask, s, 1)
    np.add.at(mask, e + joined, -1)
    out = buf[: size + 1][np.cumsum(mask)[: size + 1] > 0]
    lengths = np.concatenate([[0], np.cumsum(e - s + joined)])
    o = lengths[np.concatenate([[0], np.cumsum(kept_in_row)])]
    return out, o, words.counts - kept_in_row


def remove_repeats(docs: DataFrame, size: int = 20, key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept (the words left, joined by one space) for each row.

    A word goes if a window of `size` words of its document that covers it also starts earlier: in a document with a
    smaller key, or earlier in the same one. Documents are ordered by (key, hash of the text), null keys first; rows that
    repeat both are one document and get one result. Null and empty texts have no words. Other columns pass
    through; input columns of the new names are replaced. An empty table gives an empty result.
    """
    from pyspark.sql import types as T

    docs = docs.drop("n_words", "n_removed", "kept")
    spans = repeated_spans(docs, size, key, column).withColumnsRenamed({"k": "__k", "h": "__h", "starts": "__starts", "ends": "__ends"})
    keyed = docs.withColumns({"__k": F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)), "__h": F.xxhash64(F.col(column))})
    both = keyed.join(spans, ["__k", "__h"], "left").select(*docs.columns, F.coalesce("__starts", F.array().cast("array<int>")).alias("__starts"), F.coalesce("__ends", F.array().cast("array<int>")).alias("__ends"))
    names, at = docs.columns, docs.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, column, CHUNK):
            words = _text.Words(b.column(at))
            out, o, gone = _kept(words, b.column(len(names)), b.column(len(names) + 1))
            kept = pa.Array.from_buffers(pa.string(), len(o) - 1, [None, pa.py_buffer(o.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
            yield pa.record_batch([*b.columns[: len(names)], pa.array(words.counts.astype(np.int64)), pa.array(gone.astype(np.int64)), kept], [*names, "n_words", "n_removed", "kept"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return _store.batched(both).mapInArrow(run, schema)


def digests(docs: DataFrame, size: int = 20, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256."""
    out = remove_repeats(docs.select(key, column), size, key, column)
    return out.select(key, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
