"""Near duplicates that share frequent shingles alone, in groups larger than those whose members all meet at once."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import neardup


def family(seed, n, places=12, variants=4):
    """Texts of 200 words, alike but in `places` of them, where each has one of a few words: every shingle is in many texts."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    spots = range(8, 200, 200 // places)
    out = set()
    while len(out) < n:
        w = list(base)
        for p in list(spots)[:places]:
            w[p] = f"v{p}x{r.randrange(variants)}"
        out.add(" ".join(w))
    return list(enumerate(sorted(out)))


def alike_pairs(rows, slots):
    found = [dict(zip(h.tolist(), neardup._weights(h, n, slots).tolist(), strict=True)) for _, t in rows for _, h, n in [neardup.shingles(pa.array([t]))]]
    for x, y in itertools.combinations(range(len(rows)), 2):
        common = sum(min(w, found[y][s]) for s, w in found[x].items() if s in found[y])
        if common and common >= 0.8 * (sum(found[x].values()) + sum(found[y].values()) - common):
            yield x, y


def joined(rows, pairs):
    root = {i: i for i, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for x, y in pairs:
        a, b = sorted((find(x), find(y)))
        root[b] = a
    return {i: find(i) for i in root}


def test_no_similar_pair_of_a_bucket_is_lost(spark, monkeypatch):
    """The pairs that links() may not lose are those that share a bucket, told here from the nodes' bands."""
    rows = family(11, 500)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    slots = neardup.slot_weights(neardup.document_frequencies(frame))
    bands = [neardup.samples(row, h, neardup._weights(h, n, slots))[1][0] for _, t in rows for row, h, n in [neardup.shingles(pa.array([t]))]]
    alike = list(alike_pairs(rows, slots))
    want = joined(rows, [(x, y) for x, y in alike if (bands[x] == bands[y]).any()])
    monkeypatch.setattr(neardup, "SIDE", 100, raising=False)  # several blocks
    got = dict(neardup.classes(frame).collect())
    assert len(alike) > 100 and len(set(want.values())) > 50
    assert all(got[x] == got[y] for x, y in alike if (bands[x] == bands[y]).any())
    every = joined(rows, alike)
    assert all(every[i] == every[c] for i, c in got.items())  # and nothing else is joined


def test_pairs_of_blocks_against_all_pairs():
    r, slots = random.Random(4), (1 + 0.05 * np.random.default_rng(1).random(neardup.SLOTS)).astype(np.float32)
    for case in range(12):
        base, texts = [f"w{r.randrange(30 if case % 2 else 3000)}" for _ in range(60)], ["", "a"]
        for _ in range(r.randint(1, 40)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(60)] = f"n{r.randrange(6)}"
            texts.append(" ".join(w[: r.choice((60, 60, 60, r.randrange(60)))]))
        both = case % 3 > 0
        side = np.array([r.randrange(2) if both else 0 for _ in texts])
        x, y = neardup._alike(*neardup.shingles(pa.array(texts)), slots, side, both, 0.8)
        want = {p for p in alike_pairs(list(enumerate(texts)), slots) if not both or side[p[0]] != side[p[1]]}
        assert sorted(tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)) == sorted(want)
    assert neardup._forest(np.array([1, 2, 1, 5]), np.array([2, 3, 3, 1])) == [0, 1, 3]


def test_blocks_of_long_texts_stay_small(spark, monkeypatch):
    """Blocks follow the bytes of their texts, too."""
    monkeypatch.setattr(neardup, "ROOM", 20_000, raising=False)
    rows = family(12, 120)
    got = dict(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("class_id", F.col("class_id")).collect())
    slots = neardup.slot_weights(neardup.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string")))
    every = joined(rows, alike_pairs(rows, slots))
    assert all(every[i] == every[c] for i, c in got.items()) and sum(got[i] == every[i] for i in got) >= 0.99 * len(got)
