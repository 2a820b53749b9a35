"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage becomes a vector of surface statistics
(signs, case, repetition, word shapes), is encoded by one hidden layer, and gets a gated attention
weight; the weighted sum is scored. Attention and scorer are learned together from document labels,
so that one bad passage can carry its document. No passage is left out, however long the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _labels, _store, _text

PASSAGE = 64  # words
HIDDEN, GATE = 16, 8
FIT_ROWS = 2000  # labelled rows that the model is fitted on, at most
BLOCK = 1 << 15  # passages in memory as wide numbers while fitting
NAMES = (
    "upper", "digits", "exclaim", "bars", "hashes", "other_signs", "commas", "stops", "lines", "non_ascii",
    "word_length", "long_words", "short_words", "same_as_last", "distinct", "seen_before", "bigrams_seen", "odd_endings", "one_sign_words", "words",
)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_UPPER, _LOWER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789")
_EXCLAIM, _BAR, _HASH = _table("!?"), _table("|"), _table("#$%&*")
_OTHER, _COMMA, _STOP, _LINE = _table("<>{}[]()=+_/\\^~@`"), _table(",;:"), _table("."), _table("\n")
_HIGH = np.arange(256) >= 0x80
_ALNUM = _UPPER | _LOWER | _DIGIT | _HIGH
_SIGN = ~_ALNUM & ~_text._SPACE


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of statistics for each passage, and the text it belongs to; a text without words is one empty passage."""
    import pandas as pd

    w = _text.Words(column)
    n = len(w)
    row = np.repeat(np.arange(w.n), w.counts)
    place = np.arange(n) - w.rows[:-1][row]
    per = np.maximum(1, -(-w.counts // PASSAGE))
    base = np.concatenate([[0], np.cumsum(per)])
    of = base[row] + place // PASSAGE
    total = int(base[-1])
    x = np.zeros((total, len(NAMES)))
    owner = np.repeat(np.arange(w.n), per)
    if not n:
        return x, owner
    size = w.ends - w.starts
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    first_byte = w.starts[heads]
    last_byte = np.append(first_byte[1:], len(w.data))
    row_end = w.offsets[1:][row[heads]]
    last_byte = np.minimum(last_byte, row_end)
    letters = np.zeros(total)

    def bytes_of(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag[w.data])])
        out = np.zeros(total)
        out[of[heads]] = c[last_byte] - c[first_byte]
        return out

    words = np.bincount(of, minlength=total).astype(float)
    chars = np.maximum(np.bincount(of, size, total), 1)
    letters = np.maximum(bytes_of(_UPPER) + bytes_of(_LOWER), 1)
    some = np.maximum(words, 1)
    x[:, 0] = bytes_of(_UPPER) / letters
    for k, flag in enumerate((_DIGIT, _EXCLAIM, _BAR, _HASH, _OTHER, _COMMA, _STOP, _LINE), 1):
        x[:, k] = bytes_of(flag) / some
    x[:, 9] = bytes_of(_HIGH) / chars
    mean = lambda flag: np.bincount(of, flag, total) / some
    x[:, 10] = chars / some / 8
    x[:, 11] = mean(size > 14)
    x[:, 12] = mean(size < 3)
    h = w.hashes()
    again = np.zeros(n)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    x[:, 13] = mean(again)
    odd = np.uint64(0x9E3779B97F4A7C15)
    firsts = lambda key: np.concatenate([[False], _repeated(key)[1:]])

    def _repeated(key: np.ndarray) -> np.ndarray:
        code, _ = pd.factorize(key)
        first = np.empty(code.max() + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        return first[code] != np.arange(len(code))

    x[:, 14] = 1 - mean(firsts(_text.mix(h + of.astype(np.uint64) * odd)))
    by_row = _text.mix(h + row.astype(np.uint64) * odd)
    x[:, 15] = mean(firsts(by_row))
    pair = by_row.copy()
    pair[1:] += _text.mix(h[:-1])
    x[:, 16] = mean(firsts(_text.mix(pair)))
    tail = w.data[w.ends - 1]
    before = w.data[np.maximum(w.ends - 2, w.starts)]
    x[:, 17] = mean(_SIGN[tail] & _SIGN[before])
    x[:, 18] = mean((size == 1) & _SIGN[tail])
    x[:, 19] = np.log1p(words) / 4
    x[:, 1:9] = np.log1p(x[:, 1:9])
    return x, owner


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Encoder h = tanh(xW + b); attention softmax over (tanh(hV) * sigmoid(hU))g within a document; score of the weighted h."""

    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = p, mean, scale

    @staticmethod
    def start(seed: int = 7) -> dict[str, np.ndarray]:
        r = np.random.default_rng(seed)
        d = len(NAMES)
        return {
            "W": r.normal(0, 0.3, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)),
            "g": r.normal(0, 0.3, GATE), "o": r.normal(0, 0.3, HIDDEN), "c": np.zeros(1),
        }

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = np.clip((t * s) @ p["g"], -30, 30)
        heads = np.searchsorted(owner, np.arange(n))  # every text has a passage, and they stand in order
        weight = np.exp(e - np.maximum.reduceat(e, heads)[owner]) if n else e
        a = weight / np.add.reduceat(weight, heads)[owner] if n else e
        z = np.add.reduceat(a[:, None] * h, heads) if n else np.zeros((0, HIDDEN))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["o"] + p["c"][0])}

    def score(self, column: pa.Array) -> np.ndarray:
        x, owner = passages(column)
        return self.forward((x - self.mean) / self.scale, owner, len(column))["y"]

    @classmethod
    def fit(cls, column: pa.Array, labels: np.ndarray, **options) -> Model:
        return cls.learn(*passages(column), labels, **options)

    @classmethod
    def learn(cls, x: np.ndarray, owner: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.03, decay: float = 1e-4) -> Model:
        """Adam over all documents at once, a block of whole documents at a time; deterministic. owner: the document of each passage."""
        n = len(labels)
        model = cls(cls.start(), x.mean(0, dtype=float) if len(x) else np.zeros(len(NAMES)), x.std(0, dtype=float) + 1e-3 if len(x) else np.ones(len(NAMES)))
        share = labels.mean() if n else 1.0
        if not n or share in (0.0, 1.0):
            model.p = {k: v * 0 for k, v in model.p.items()} | {"c": np.array([2.0 if share else -2.0])}
            return model
        rows = np.searchsorted(owner, np.arange(n + 1))
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(rows, rows[cuts[-1]] + BLOCK, "right")) - 1))
        m = {k: np.zeros_like(v) for k, v in model.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
        for step in range(1, rounds + 1):
            p = model.p
            grad = {k: decay * w * (k != "c") for k, w in p.items()}
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = slice(rows[a], rows[b])
                for k, g in model._gradient((x[part] - model.mean) / model.scale, owner[part] - a, labels[a:b], n).items():
                    grad[k] = grad[k] + g
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def _gradient(self, x: np.ndarray, owner: np.ndarray, labels: np.ndarray, total: int) -> dict[str, np.ndarray]:
        """Of the log loss over these documents, as their part of the mean over `total`."""
        n, p = len(labels), self.p
        f = self.forward(x, owner, n)
        dy = (f["y"] - labels) / total
        dz = dy[:, None] * p["o"]
        da = (f["h"] * dz[owner]).sum(1)
        de = f["a"] * (da - np.bincount(owner, f["a"] * da, n)[owner])
        dt = de[:, None] * p["g"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * p["g"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "g": (f["t"] * f["s"]).T @ de, "o": f["z"].T @ dy, "c": np.array([dy.sum()])}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "quality") -> Model:
    """The model from up to FIT_ROWS labelled rows, none of them held out (crc32 of the key mod 5 is 0).

    Whole texts, however long: workers turn them into passages, and the driver gets a passage as 20 short numbers.
    """
    rows = _labels.sample(docs, labels, label, _labels.remainder(F.col(key), 5) != 0, key, column, FIT_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text"):
            x, owner = passages(b.column(1))
            cuts = np.searchsorted(owner, np.arange(b.num_rows + 1)).tolist()
            raw = [x[s:e].astype("<f4").tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(raw, pa.binary())], ["place", "label", "passages"])

    found = _store.batched(rows.select("place", "text", "label")).mapInArrow(run, "place int, label int, passages binary").toArrow().sort_by("place")
    _store.forget(rows)
    parts = [np.frombuffer(r.as_py(), "<f4").reshape(-1, len(NAMES)) for r in found.column("passages")]
    x = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.float32)
    return Model.learn(x, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), found.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", column: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with `quality_score` double (0 to 1, higher is better) and `good` int (1 at the threshold or above).

    Null and empty texts are one empty passage. Rows pass through one by one; an empty table gives an empty result;
    input columns of the new names are replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("quality_score", "good")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about a thousand numbers
    at, names = docs.columns.index(column), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, column):
            s = shared.value.score(b.column(at))
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "quality_score", "good"])

    return _store.batched(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("good", T.IntegerType())]))
