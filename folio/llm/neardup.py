"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's features are its five-word shingles (a text of one to four words is one shingle), weighted by
count times a damped inverse document frequency. Document frequencies are counted over all documents
in SLOTS hashed slots, so that what workers receive has one size for any corpus. Each of BANDS bands
joins ROWS samples; texts that share a band value meet at the band's lead, and the weighted Jaccard
similarity of each text with its leads is computed from the whole texts. Where a text is unlike its
lead, the lead's members meet once more by their rarest shingles (prefix filtering): all that share one
which few of them have, and those with a more frequent one by leads again. What these cannot tell is compared
in full: all pairs of a lead's members, in blocks of a bounded size, so that of the texts that share a bucket no
similar pair is lost. Links are merged to classes by alternating stars.

The damping keeps weights within 1 to 1 + DAMP: in a family of thousands of near copies the shared
shingles are frequent and the few changed ones rare, and a larger span tears it apart (with 0.25, texts
alike at 0.815 by plain shingles fell below 0.8).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _store, _text

SHINGLE = 5
SLOTS = 1 << 18
DAMP = 0.05
BANDS, ROWS = 12, 4
RINGS = (1, 5)  # pairs of bands at these distances are buckets, too
ORDERS = 4  # a bucket's lead is the least by one of so many orders
FEW, LEADS = 32, 32  # members that all meet each other by a shingle; leads of a shingle that more of them have
SIDE, ROOM = 1024, 1 << 21  # texts, and bytes of them, of a block when all pairs of a lead's members are compared
SIMILAR = 0.8
NULL_ID = -(1 << 63)

_draw = np.random.default_rng(5150)
_R = (-np.log(1 - _draw.random(1 << 16)) - np.log(1 - _draw.random(1 << 16))).astype(np.float32)  # Gamma(2, 1)
_LOG_C = np.log(-np.log(1 - _draw.random(1 << 16)) - np.log(1 - _draw.random(1 << 16))).astype(np.float32)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: row (ascending), hash, count."""
    import pandas as pd

    words = _text.Words(column)
    hashes = words.hashes()
    at, h = _text.windows(words, hashes, SHINGLE)
    row = np.repeat(np.arange(words.n), words.counts)[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        h = np.concatenate([h, _text.spans_hash(hashes, words.rows[short], words.rows[short + 1])])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    if not len(h):
        return row, h, row
    key = _text.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    code, _ = pd.factorize(key)
    first = np.empty(code.max() + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return row[first], h[first], np.bincount(code)


def document_frequencies(texts: DataFrame, packed: bool = False) -> np.ndarray:
    """In how many texts (column `text`) a shingle of each slot stands; the last entry is the number of texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int32), 0
        for b in _text.chunks(batches, "text", _text.CHUNK // 4 if packed else _text.CHUNK):
            _, h, _ = shingles(_unpacked(b.column(0)) if packed else b.column(0))
            total += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.int32)
            n += b.num_rows
        if n:
            part = total.reshape(64, -1)
            yield pa.record_batch([pa.array(np.arange(65), pa.int32()), pa.array([*(x.tobytes() for x in part), np.int32(n).tobytes()], pa.binary())], ["slice", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    slices = {r[0]: np.frombuffer(r[1], np.int64) for r in _store.batched(texts.select("text")).mapInArrow(count, schema).repartition(8, "slice").mapInArrow(add, schema).collect()}
    return np.concatenate([slices[k] for k in range(65)]) if slices else np.zeros(SLOTS + 1, np.int64)


def slot_weights(frequencies: np.ndarray) -> np.ndarray:
    n = frequencies[-1]
    return (1 + DAMP * np.log((n + 1) / (frequencies[:-1] + 1).clip(max=n + 1)) / np.log(n + 2)).astype(np.float32)


def _weights(h: np.ndarray, count: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return count.astype(np.float32) * slots[(h % np.uint64(SLOTS)).astype(np.int64)]


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and BANDS band values of each (uint64)."""
    rows, first = np.unique(row, return_index=True)
    out = np.empty((len(rows), BANDS), np.uint64)
    seeds = _text.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
    log_w = np.log(weight)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(first, first[a] + block, "right")) - 1)
        lo, hi = first[a], first[b] if b < len(rows) else len(h)
        hh, lw, cut = h[lo:hi], log_w[lo:hi], first[a:b] - lo
        for band in range(BANDS):
            value = np.full(b - a, np.uint64(band), np.uint64)
            for k in range(band * ROWS, band * ROWS + ROWS):
                x = (hh ^ seeds[k]) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(29)
                r = _R[(x & np.uint64(0xFFFF)).astype(np.uint16)]
                beta = ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
                t = np.floor(lw / r + beta)
                log_a = _LOG_C[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)] - r * (t + 1 - beta)
                bits = log_a.view(np.int32)
                order = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.uint32) ^ np.uint32(0x80000000)
                name = ((x >> np.uint64(32)) ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1))) & np.uint64(0xFFFFFFFF)
                least = np.minimum.reduceat(order.astype(np.uint64) << np.uint64(32) | name, cut)
                value = _text.mix(value * np.uint64(0x9E3779B97F4A7C15) ^ least)
            out[a:b, band] = value
        a = b
    return rows, out


def _bands(texts: DataFrame, slots) -> DataFrame:
    """texts (node, id, text) without text, with bands array<long>."""
    kept = [c for c in texts.columns if c != "text"]
    at = texts.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text"):
            column = b.column(at)
            if column.null_count:
                column = column.fill_null("")
            packed = column.dictionary_encode()  # copies in a chunk are sampled once
            row, h, count = shingles(packed.dictionary)
            rows, values = samples(row, h, _weights(h, count, slots.value))
            place = np.full(len(packed.dictionary), -1)
            place[rows] = np.arange(len(rows))
            mine = place[packed.indices.to_numpy()]
            has = mine >= 0
            o = np.concatenate([[0], np.cumsum(has * BANDS)])
            lists = pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(values[mine[has]].reshape(-1).view(np.int64)))
            yield pa.record_batch([*(c for k, c in enumerate(b.columns) if k != at), lists], [*kept, "bands"])

    from pyspark.sql import types as T

    return _store.batched(texts).mapInArrow(run, T.StructType([*(texts.schema[c] for c in kept), T.StructField("bands", T.ArrayType(T.LongType()))]))


def _similar(pairs: DataFrame, slots, least: float) -> DataFrame:
    """a, b and whether the texts text_a and text_b are similar by weighted Jaccard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text_b", _text.CHUNK // 4):
            n = b.num_rows
            packed = b.column(2).dictionary_encode()  # a lead's text stands in many rows
            ra, ha, ca = shingles(_unpacked(packed.dictionary))
            wa = _weights(ha, ca, slots.value)
            cut = np.searchsorted(ra, np.arange(len(packed.dictionary) + 1))
            lead = packed.indices.to_numpy()
            size = np.diff(cut)[lead]
            take = _text.ranges(cut[lead], size)
            row_a = np.repeat(np.arange(n), size)
            rb, hb, cb = shingles(_unpacked(b.column(3)))
            wb = _weights(hb, cb, slots.value)
            odd = np.uint64(0x9E3779B97F4A7C15)
            key_a = _text.mix(ha[take] + row_a.astype(np.uint64) * odd)
            key_b = _text.mix(hb + rb.astype(np.uint64) * odd)
            order = np.argsort(key_a)
            sorted_a = key_a[order]
            at = np.minimum(np.searchsorted(sorted_a, key_b), max(0, len(sorted_a) - 1))
            both = sorted_a[at] == key_b if len(sorted_a) else np.zeros(len(key_b), bool)
            common = np.bincount(rb[both], np.minimum(wb[both], wa[take][order][at[both]]), n)
            total = np.bincount(row_a, wa[take], n) + np.bincount(rb, wb, n) - common
            yield pa.record_batch([b.column(0), b.column(1), pa.array(common >= least * np.maximum(total, 1e-9))], ["a", "b", "similar"])

    return _store.batched(pairs.select("a", "b", "text_a", "text_b")).mapInArrow(run, "a binary, b binary, similar boolean")


def _packed(docs: DataFrame) -> DataFrame:
    """docs (node, id, text) with the text compressed, for shuffles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", 3)
        for b in _text.chunks(batches, "text"):
            raw = [(t or "").encode() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(t).to_bytes(8, "little") + zstd.compress(t, asbytes=True) for t in raw], pa.binary())], ["node", "id", "text"])

    return _store.batched(docs.select("node", "id", "text")).mapInArrow(run, "node binary, id long, text binary")


def _unpacked(column: pa.Array) -> pa.Array:
    return pa.array([pa.decompress(z[8:], int.from_bytes(z[:8], "little"), "zstd", asbytes=True).decode() for z in column.to_pylist()], pa.string())


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes to compare: every member of a bucket with the bucket's lead.

    Buckets are single band values, and pairs of band values on rings of distance 1 and 5, which part texts that meet by a
    common passage alone. Each bucket has one lead, the least by one of ORDERS orders, so that there are never more pairs
    than rows, whatever a bucket's size. Buckets that hold a large share of all rows are met by broadcast.
    """
    total = BANDS * nodes.count()
    rows = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = _store.matched(rows, shared, "bucket", total)
    own = met.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("m"))
    value = [F.try_element_at("m", F.lit(k)) for k in range(BANDS)]
    double = [F.when(value[i].isNotNull() & value[j].isNotNull(), F.xxhash64(F.lit(1), value[i], value[j])) for step in RINGS for i in range(BANDS) for j in ((i + step) % BANDS,)]
    subs = _store.written(own.select("node", F.explode(F.array_compact(F.array(*value, *double))).alias("bucket")), "buckets")
    order = F.struct(F.xxhash64("node", F.pmod("bucket", F.lit(ORDERS))), "node")
    leads = subs.groupBy("bucket").agg(F.min(order).getField("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    pairs = _store.matched(subs, leads, "bucket", (1 + len(RINGS)) * total).where("node != lead")
    out = _store.written(pairs.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    _store.forget(subs)
    return out


def _compared(pairs: DataFrame, texts: DataFrame, slots, least: float) -> DataFrame:
    """pairs (a, b) with whether their texts are similar. texts: node, text (packed)."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return _similar(both, slots, least)


def _prefixes(texts: DataFrame, slots, frequencies, least: float) -> DataFrame:
    """The rarest shingles of each text (node, root, text): node, root, shingle, the text's weight, and whether the shingle is in
    the short prefix, too.

    Two similar texts share a shingle of the short prefix of the lighter and the long prefix of the heavier: without these the
    rest of one of them weighs less than what similar texts have in common (least of the heavier, 2 * least / (1 + least) of the
    lighter). Shingles that are in one text alone are left out.
    """
    share = 2 * least / (1 + least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text", _text.CHUNK // 4):
            row, h, count = shingles(_unpacked(b.column(2)))
            if not len(h):
                continue
            often = frequencies.value[(h % np.uint64(SLOTS)).astype(np.int64)]
            w = _weights(h, count, slots.value).astype(np.float64)
            order = np.lexsort((_text.mix(h), often, row))
            row, h, often, w = row[order], h[order], often[order], w[order]
            total = np.bincount(row, w, b.num_rows)
            before = np.cumsum(w) - w
            first = np.searchsorted(row, np.arange(b.num_rows)).clip(max=len(row) - 1)
            left = total[row] - (before - before[first][row])  # the weight from this shingle on
            long = (left >= (least - 1e-6) * total[row]) & (often > 1)
            short = left[long] >= (share - 1e-6) * total[row][long]
            at = pa.array(row[long])
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(h[long].view(np.int64)), pa.array(total[row][long]), pa.array(short)], ["node", "root", "shingle", "weight", "short"])

    return _store.batched(texts.select("node", "root", "text")).mapInArrow(run, "node binary, root binary, shingle long, weight double, short boolean")


def _second(judged: DataFrame, texts: DataFrame, slots, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members whose leads cannot tell and that no links join yet, by the shingles of their prefixes; and the
    members (node, root) whose pairs these need not all be.

    Members that share a shingle with at most FEW of them meet each other: FEW pairs a row at most. Of the more frequent
    shingles each member takes two, the least by two orders, and meets the shingle's leads, the least members of LEADS
    slices: 2 * LEADS pairs a member at most. So pairs grow with the rows, not with the square of a group. A similar pair
    that is none of them shares a more frequent shingle; _rest compares the members that have one.
    """
    stars = judged.groupBy("a").agg(F.count("*").alias("n"), F.count_if(~F.col("similar")).alias("failed")).where("n > 1 and failed > 0")
    members = _store.matched(judged.select("a", "b"), stars.select("a", "n"), "a", judged.count()).select(F.col("b").alias("node")).distinct()
    tree = components(judged.where("similar"))
    members = _store.written(members.join(tree, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "members")
    _store.forget(tree)
    mine = texts.join(members, "node")
    frequencies = mine.sparkSession.sparkContext.broadcast(document_frequencies(mine, packed=True)[:-1])
    rows = _store.written(_prefixes(mine, slots, frequencies, least), "prefixes")
    groups = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    total = rows.count()
    frequent = _store.matched(rows, groups.where(F.col("n") > FEW), "shingle", total)
    least_of = lambda *salt: F.min(F.struct(F.xxhash64(*map(F.lit, salt), "shingle"), "shingle"))["shingle"]
    taken = frequent.groupBy("node", "root", "weight").agg(F.array_distinct(F.array(least_of(), least_of(1))).alias("s"))
    taken = _store.written(taken.select("node", "root", "weight", F.explode("s").alias("shingle")), "taken")
    lead = F.min(F.struct(F.xxhash64("node", "shingle"), "node", "root", "weight")).alias("lead")
    slices = taken.groupBy("shingle", F.pmod(F.xxhash64("node"), F.lit(LEADS)).alias("slice")).agg(lead, F.count("*").alias("n"))
    leads = slices.groupBy("shingle").agg(F.collect_list("lead").alias("leads"), F.sum("n").alias("n"))
    led = _store.matched(taken, leads, "shingle", taken.count()).select("node", "root", "weight", F.explode("leads").alias("lead")).where("root != lead.root")
    led = led.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.weight").alias("x"), F.col("weight").alias("y"))
    few = rows.join(groups.where(F.col("n") <= FEW).select("shingle"), "shingle", "left_semi")
    one = few.where("short").select("shingle", F.col("root").alias("root_a"), F.col("node").alias("a"), F.col("weight").alias("x"))
    other = few.select("shingle", F.col("root").alias("root_b"), F.col("node").alias("b"), F.col("weight").alias("y"))
    met = one.join(other, "shingle").where("root_a != root_b").where(F.col("x") <= F.col("y") * (1 + 1e-6)).select("a", "b", "x", "y")
    both = led.union(met).where(F.least("x", "y") >= F.greatest("x", "y") * (least - 1e-6))
    out = _store.written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
    left = _store.written(taken.select("node", "root").distinct(), "left")
    _store.forget(members, rows, taken)
    return out, left


def _alike(row: np.ndarray, h: np.ndarray, count: np.ndarray, slots: np.ndarray, side: np.ndarray, both: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (rows) of similar texts by weighted Jaccard, from the shingles of each: of texts on side 0 with those on side 1
    if both, else of texts on side 0."""
    n = len(side)
    weight = slots[(h % np.uint64(SLOTS)).astype(np.int64)].astype(np.float64)
    total = np.bincount(row, weight * count, n)
    # a shingle's k-th use in a text is a feature of its own: what two texts have in common is the weight of features of both
    use = np.repeat(np.arange(len(h)), count)
    nth = _text.ranges(np.zeros(len(count), np.int64), count).astype(np.uint64)
    row, weight = row[use], weight[use]
    _, feature = np.unique(_text.mix(h[use] + nth * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    while True:  # what only one text has is in no pair, nor is a text of which too little is left
        met = np.bincount(feature[side[row] == 0], minlength=feature.max(initial=-1) + 1)
        other = np.bincount(feature[side[row] == 1], minlength=len(met)) if both else met - 1
        shared = (met[feature] > 0) & (other[feature] > 0)
        able = np.bincount(row[shared], weight[shared], n) >= least * total * (1 - 1e-9)
        shared &= able[row]
        if shared.all():
            break
        row, weight, feature = row[shared], weight[shared], feature[shared]
    able &= total > 0
    x = np.flatnonzero(able & (side == 0))
    y = np.flatnonzero(able & (side == 1)) if both else x
    if not len(x) or not len(y):
        return x[:0], y[:0]
    _, feature = np.unique(feature, return_inverse=True)
    order = np.argsort(feature, kind="stable")
    row, weight, feature = row[order], weight[order], feature[order]
    place = np.zeros(n, np.int64)
    place[x] = np.arange(len(x))
    place[y] = np.arange(len(y))  # the same if x is y
    left, right = (side[row] == 0, side[row] == 1) if both else (np.ones(len(row), bool),) * 2
    fx, px, wx, fy, py = feature[left], place[row[left]], weight[left], feature[right], place[row[right]]
    size = feature[-1] + 1
    nx, ny = np.bincount(fx, minlength=size), np.bincount(fy, minlength=size)
    common = np.zeros((len(x), len(y)))
    dense = nx * ny * 8 > len(x) * len(y)  # features of many texts by products of matrices, the others pair by pair
    many = np.flatnonzero(dense)
    for k in range(0, len(many), 512):
        to = np.full(size, -1)
        to[many[k : k + 512]] = np.arange(len(many[k : k + 512]))
        a, b = np.zeros((len(x), 512)), np.zeros((len(y), 512))
        i, j = to[fx] >= 0, to[fy] >= 0
        a[px[i], to[fx[i]]] = wx[i]
        b[py[j], to[fy[j]]] = 1
        common += a @ b.T
    start = np.cumsum(ny) - ny
    few = np.flatnonzero(~dense[fx])
    pairs = np.cumsum(ny[fx[few]])
    at = 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + (1 << 21), "right")))
        some = few[at:to]
        reps = ny[fx[some]]
        cell = np.repeat(px[some], reps) * len(y) + py[_text.ranges(start[fx[some]], reps)]
        common += np.bincount(cell, np.repeat(wx[some], reps), common.size).reshape(common.shape)
        at = to
    good = common >= least * (total[x][:, None] + total[y][None, :] - common)
    i, j = np.nonzero(good if both else np.triu(good, 1))
    return x[i], y[j]


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links a[k], b[k] join what those before them do not."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = v = up.get(w, w)
        return v

    out = []
    for k, (v, w) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        v, w = find(v), find(w)
        if v != w:
            up[v] = w
            out.append(k)
    return out


def _rest(judged: DataFrame, left: DataFrame, texts: DataFrame, slots, least: float) -> DataFrame:
    """Links (a, b) that join all that similar pairs among each lead's members join, of the members `left` (node, root).

    Texts that share a bucket are members of its lead: this is the exact way for what leads cannot tell. A lead's members are
    dealt to blocks of about SIDE texts and ROOM bytes at most, and every two blocks meet in one group, whose pairs are
    compared at once: comparisons grow with the square of the members, rows with their number of blocks, and links not
    beyond the rows. A lead whose members are all joined already has no work.
    """
    length = sum(F.conv(F.hex(F.substring("text", k + 1, 1)), 16, 10).cast("long") * 256**k for k in range(6))
    sized = left.join(texts.select("node", length.alias("size")), "node")
    rows = judged.select("a", F.col("b").alias("node")).join(sized, "node")
    rows = _store.written(rows, "rest")
    stars = rows.groupBy("a").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    stars = stars.select("a", "n", F.greatest(F.ceil(F.col("n") / SIDE), F.ceil(F.col("bytes") / ROOM)).cast("int").alias("blocks"))
    met = _store.matched(rows, stars, "a", rows.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "root", "a", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.join(texts, "node").repartition(_store.shuffle_parts(judged.sparkSession), "a", "i", "j")

    def run(group: pa.Table) -> pa.Table:
        root = group["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        if (root == root[0]).all():
            return pa.table([pa.array([], pa.binary())] * 2, ["a", "b"])
        both = group["i"][0] != group["j"][0]
        side = (group["block"].to_numpy() != group["i"][0].as_py()).astype(np.int64)
        x, y = _alike(*shingles(_unpacked(group["text"].combine_chunks())), slots.value, side, both, least)
        new = np.flatnonzero(root[x] != root[y])
        _, first = np.unique(np.minimum(root[x], root[y])[new] * np.int64(len(root)) + np.maximum(root[x], root[y])[new], return_index=True)
        new = new[first]
        new = new[_forest(root[x[new]], root[y[new]])]
        node = group["node"].combine_chunks()
        return pa.table([node.take(pa.array(x[new])), node.take(pa.array(y[new]))], ["a", "b"])

    found = _store.batched(dealt).groupBy("a", "i", "j").applyInArrow(run, "a binary, b binary")
    out = _store.written(found, "found")
    _store.forget(rows)
    return out


def links(nodes: DataFrame, docs: DataFrame, slots, least: float = SIMILAR) -> DataFrame:
    """Verified links (a, b) between texts. nodes: node, id, bands; docs: node, id, text."""
    pairs = candidates(nodes)
    # one row gives a node's text: that of the node's id (null keys as the least long), the first of those that repeat it
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", F.coalesce("id", F.lit(NULL_ID)).alias("id")), "node")
    texts = _packed(docs.withColumn("id", F.coalesce("id", F.lit(NULL_ID)))).join(wanted, ["node", "id"]).dropDuplicates(["node", "id"]).select("node", "text")
    texts = _store.written(texts, "texts")
    judged = _store.written(_compared(pairs, texts, slots, least), "judged")
    more, left = _second(judged, texts, slots, least)
    again = _compared(more, texts, slots, least)
    rest = _rest(judged, left, texts, slots, least)
    out = _store.written(judged.union(again).where("similar").select("a", "b").union(rest).distinct(), "links")
    _store.forget(pairs, texts, judged, more, left, rest)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component), by alternating large and small stars; ends when the stars stand still.
    A node with a large share of all edges meets them by broadcast."""
    stars = _store.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "stars")
    total, mark = stars.count(), None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _store.matched(both, least, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = _store.written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "stars")
        _store.forget(stars)
        stars = new
        total, *now = stars.agg(F.count("*"), F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._written_to = stars._written_to
    return out


def classes(docs: DataFrame, key: str = "doc_id", column: str = "text", least: float = SIMILAR, named: bool = False) -> DataFrame:
    """key, class_id for every row: the least key of the texts that its text is linked with, itself included.

    Equal texts are one class; a text without words is in a class only with texts equal to it, null texts counting as
    empty ones. Rows with null keys are classed by their texts; a class of such rows alone has a null class_id. An empty
    table gives an empty result. Other columns are not read. named: with node and root, the texts of row and class.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    keyed = plain.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "id", "text")
    slots = spark.sparkContext.broadcast(slot_weights(document_frequencies(plain)))
    sampled = _bands(keyed, slots)
    first = F.min(F.struct("id", "bands"))
    known = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "bands")))
    nodes = sampled.groupBy("node").agg(F.coalesce(known, first).alias("s")).select("node", "s.id", "s.bands")
    nodes = _store.written(nodes, "nodes")
    edges = links(nodes.where(F.size("bands") > 0), keyed, slots, least)
    tree = components(edges)
    _store.forget(edges)
    member = nodes.select("node", "id").join(tree, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    ids = member.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    label = _store.matched(member, ids, "root", nodes.count()).select("node", "root", "class_id")
    out = keyed.select("node", "id").join(label, "node")
    return out.select(F.col("id").alias(key), "class_id", *(["node", "root"] if named else []))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", column: str = "text", least: float = SIMILAR) -> DataFrame:
    """docs with one row of each class: that of the least key. Of several rows with that key one stays; a class whose keys
    are all null keeps one of its rows."""
    label = _store.written(classes(docs, key, column, least, named=True), "classes")
    several = not label.groupBy(key, "node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    first = label.groupBy("root").agg(F.min(F.struct(F.col(key).isNull(), key, "node")).alias("s"))
    keep = first.select(F.col(f"s.{key}").alias("__id"), F.col("s.node").alias("__node"))
    node = F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))
    marked = docs.withColumns({"__id": F.col(key).cast("long"), "__node": node})
    met = marked.alias("d").join(keep.alias("k"), F.col("d.__id").eqNullSafe(F.col("k.__id")) & (F.col("d.__node") == F.col("k.__node")), "left_semi")
    return (met.dropDuplicates(["__id", "__node"]) if several else met).select(*docs.columns)
