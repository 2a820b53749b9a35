"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps words to classes (insult, threat, target, naming, negation, reported speech) with
weights; its insults are words and stems learned from labels. Over the classes of a clause runs the
composition of six small transducers, each reading some classes. Their outputs tell of every insult and
threat whether it is negated or reported; their states at the clause's end tell whether the clause is a
pattern: an insult with a target, an insult that names somebody or something ("the", "is"), insults piled
up, a threat with a target. The weights of a clause that is no pattern are lost, so that a word by itself
scores nothing. Sums over a document's matched clauses go through a fitted logistic scale.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _labels, _store, _text

INSULT, THREAT, TARGET, NEGATION, REPORT, NAMING = 1, 2, 4, 8, 16, 32
CLASSES = 64  # sets of classes
#: Function words of the grammar.
WORDS = {
    TARGET: "you your yours yourself he she him his her they them their everyone du dich dir ihr euch dein deine er sie ihn ihm tu te toi vous votre il elle ils elles lui tú te ti usted ustedes él ella ellos ellas",
    NEGATION: "not no never none without nicht kein keine keinen nie niemals pas jamais aucun aucune sans no nunca ningún ninguna sin",
    REPORT: "said says say called calls wrote claimed reported quoted according sagte sagt nannte schrieb laut dit disait écrit selon dijo dice llamó escribió según",
    THREAT: "kill killing hurt murder strangle stab shoot töten umbringen schlagen tuer frapper matar golpear",
    NAMING: "the this that these those a an such it who is are was were be been der die das den dem des ein eine einen dieser diese ist sind war le la les l un une des du ce cet cette ces est sont était el la los las un una unos esto este esta es son era",
}
FIT_ROWS = 3000  # labelled rows that the model is fitted on, at most
REACH = 3  # words over which a negation holds
LEAST_PREFIX, MOST_PREFIX = 3, 8
LEAST_TEXTS, LEAST_SHARE = 3, 0.015  # toxic texts with a word or stem (copies of one text make rare words look telling)
RATIO = 8  # times as frequent in toxic texts as in others, at least


class Machine:
    """A deterministic transducer over class sets: step[state, symbol] and output[state, symbol] (a bit)."""

    def __init__(self, states: int, step, output):
        symbols = range(CLASSES)
        self.step = np.array([[step(s, x) for x in symbols] for s in range(states)], np.int32)
        self.output = np.array([[output(s, x) for x in symbols] for s in range(states)], np.int32)


class Composed:
    """Machines reading the same symbols; outputs side by side, the first lowest. parts[state]: the state of each machine."""

    def __init__(self, machines: list[Machine]):
        states = list(product(*(range(len(m.step)) for m in machines)))
        place = {s: k for k, s in enumerate(states)}
        self.step = np.array([[place[tuple(int(m.step[q, x]) for m, q in zip(machines, s, strict=True))] for x in range(CLASSES)] for s in states], np.int32)
        self.output = np.array([[sum(int(m.output[q, x]) << k for k, (m, q) in enumerate(zip(machines, s, strict=True))) for x in range(CLASSES)] for s in states], np.int32)
        self.parts = np.array(states)


@lru_cache(1)
def grammar() -> tuple[Composed, np.ndarray, np.ndarray]:
    """The composition, and the states in which a clause's insults and threats count. Outputs: 1 insult, 2 threat, 4 negated, 8 reported."""
    silent = lambda s, x: 0
    whole = Composed(
        [
            Machine(1, lambda s, x: 0, lambda s, x: int(bool(x & INSULT))),
            Machine(1, lambda s, x: 0, lambda s, x: int(bool(x & THREAT))),
            Machine(REACH + 1, lambda s, x: REACH if x & NEGATION else max(0, s - 1), lambda s, x: int(s > 0)),
            Machine(2, lambda s, x: int(s or bool(x & REPORT)), lambda s, x: int(s)),
            Machine(3, lambda s, x: 2 if x & TARGET else max(s, int(bool(x & NAMING))), silent),
            Machine(3, lambda s, x: min(2, s + bool(x & INSULT)), silent),
        ]
    )
    aimed, piled = whole.parts[:, 4], whole.parts[:, 5]
    return whole, (aimed > 0) | (piled > 1), aimed > 1


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: a letter; the end of a clause."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    stop = np.zeros(0x110000, bool)
    stop[[ord(c) for c in ".!?;:\n…。！？"]] = True
    return letter, stop


_SALT = np.random.default_rng(31).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


class Tokens:
    """Lower-cased words of letters of a chunk of texts: spans of cps, the text and clause of each."""

    def __init__(self, texts: list[str | None]):
        letter, stop = _classes()
        low = [(t or "").lower() for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        self.cps = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = np.zeros(len(self.cps) + 2, bool)
        solid[1:-1] = letter[self.cps]
        body = solid[1:-1]
        first, last = body & ~solid[:-2], body & ~solid[2:]
        inner = cuts[1:-1]
        inner = inner[(inner > 0) & (inner < len(self.cps))]
        first[inner] |= body[inner]
        last[inner - 1] |= body[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(cuts, self.starts, "right") - 1
        ended = np.zeros(len(self.cps) + 1, np.int64)
        np.cumsum(stop[self.cps], out=ended[1:])
        self.clause = ended[self.starts] + self.row  # grows at each clause end and each text
        self.n = len(texts)

    def words(self) -> list[list[str]]:
        """The distinct words of each text, in order."""
        chars = self.cps.tobytes().decode("utf-32-le", "surrogatepass")
        found: list[set[str]] = [set() for _ in range(self.n)]
        for r, s, e in zip(self.row.tolist(), self.starts.tolist(), self.ends.tolist(), strict=True):
            found[r].add(chars[s:e])
        return [sorted(f) for f in found]

    def hashes(self, ends: np.ndarray | None = None) -> np.ndarray:
        values = _SALT[(self.cps & 0xFFFF).astype(np.int64)] + (self.cps >> 16).astype(np.uint64)
        return _text.spans_hash(values, self.starts, self.ends if ends is None else ends)


class Lexicon:
    """A trie over code points. A word state accepts where a token ends, a stem state accepts any continuation."""

    def __init__(self, entries: dict[str, tuple[int, float]]):
        """entries: "=word" or "stem" -> (class, weight)."""
        table: dict[tuple[int, int], int] = {}
        word: dict[int, tuple[int, float]] = {}
        stem: dict[int, tuple[int, float]] = {}
        count = 1
        for text, (kind, weight) in entries.items():
            state = 0
            for c in text.lstrip("="):
                key = (state, ord(c))
                if key not in table:
                    table[key] = count
                    count += 1
                state = table[key]
            into = word if text[0] == "=" else stem
            old = into.get(state, (0, 0.0))
            into[state] = (old[0] | kind, max(old[1], weight))
        keys = sorted((s << 21 | c, t) for (s, c), t in table.items())
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.targets = np.array([t for _, t in keys], np.int64)
        self.kind, self.weight = np.zeros((2, count), np.int32), np.zeros((2, count), np.float32)
        for k, found in enumerate((word, stem)):
            for s, (a, b) in found.items():
                self.kind[k, s], self.weight[k, s] = a, b

    def find(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes and the weight of each token; all advance together."""
        n = len(starts)
        kind, weight = np.zeros(n, np.int32), np.zeros(n, np.float32)
        if not len(self.keys):
            return kind, weight
        live, state, step = np.arange(n), np.zeros(n, np.int64), 0
        while len(live):
            key = state << 21 | cps[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, state = live[ok], self.targets[arc[ok]]
            step += 1
            over = starts[live] + step == ends[live]
            for mode, which in ((1, slice(None)), (0, over)):
                kind[live[which]] |= self.kind[mode, state[which]]
                weight[live[which]] = np.maximum(weight[live[which]], self.weight[mode, state[which]])
            live, state = live[~over], state[~over]
        return kind, weight


FEATURES = ("insult", "threat", "clauses", "negated", "reported")


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """Per text: what its matched clauses output, insults by weight; all clauses run through the grammar in step."""
    import pandas as pd

    t = Tokens(texts)
    out = np.zeros((t.n, len(FEATURES)))
    if not len(t.starts):
        return out
    code, _ = pd.factorize(t.hashes())
    first = np.empty(code.max() + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    kind, weight = lexicon.find(t.cps, t.starts[first], t.ends[first])
    kind, weight = kind[code], weight[code]
    hot = (kind & (INSULT | THREAT)) > 0
    if not hot.any():
        return out
    at = np.flatnonzero((kind > 0) & np.isin(t.clause, t.clause[hot]))
    clause = t.clause[at]
    heads = np.flatnonzero(np.append(True, clause[1:] != clause[:-1]))
    length = np.diff(np.append(heads, len(at)))
    gap = np.zeros(len(at), np.int64)  # words without a class since the last that has one
    gap[1:] = np.minimum(np.diff(at) - 1, REACH)
    m, insults, threats = grammar()
    state, live, step = np.zeros(len(heads), np.int64), np.arange(len(heads)), 0
    held = np.zeros((len(heads), len(FEATURES)))  # what each clause has put out so far: plain insults and threats, calmed ones
    calmed_threat = np.zeros((len(heads), 2))
    while len(live):
        e = heads[live] + step
        s = state[live]
        if step:
            for k in range(REACH):
                s = np.where(gap[e] > k, m.step[s, 0], s)
        symbol = kind[at[e]]
        output = m.output[s, symbol]
        state[live] = m.step[s, symbol]
        w, plain = weight[at[e]], (output & 12) == 0
        insult, threat, negated, reported = ((output & bit) > 0 for bit in (1, 2, 4, 8))
        held[live, 0] += np.where(insult & plain, w, 0)
        held[live, 1] += threat & plain
        held[live, 3] += np.where(insult & negated, w, 0)
        held[live, 4] += np.where(insult & reported, w, 0)
        calmed_threat[live, 0] += threat & negated
        calmed_threat[live, 1] += threat & reported
        step += 1
        live = live[length[live] > step]
    held[:, [0, 3, 4]] *= insults[state][:, None]
    held[:, 1] *= threats[state]
    held[:, 3:] += calmed_threat * threats[state][:, None]
    held[:, 2] = (held[:, 0] > 0) | (held[:, 1] > 0)
    np.add.at(out, t.row[at[heads]], held)
    return out


def _g(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """The log-likelihood ratio of a of pos and b of neg against one common rate."""
    def part(x, n, p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return x * np.log(p) + (n - x) * np.log(1 - p)

    common = (a + b) / (pos + neg)
    return 2 * (part(a, pos, a / max(pos, 1)) + part(b, neg, b / max(neg, 1)) - part(a, pos, common) - part(b, neg, common))


def learn_insults(words: pa.Array, labels: np.ndarray, least: float = 20.0, most: int = 512) -> dict[str, tuple[int, float]]:
    """Words and stems that mark toxic texts: all whose likelihood ratio is beyond chance, then the best for the toxic texts
    that these leave, and so on. words: the distinct words of each text."""
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    if not pos or not neg:
        return {}

    def names_of(which: np.ndarray) -> Iterator[set[str]]:
        """The words and stems of each text, a few texts at a time."""
        for k in range(0, len(which), 64):
            for listed in words.take(pa.array(which[k : k + 64])).to_pylist():
                yield {x for w in listed for x in ("=" + w, *(w[:k] for k in range(LEAST_PREFIX, min(MOST_PREFIX, len(w) - 1) + 1)))}

    few = max(LEAST_TEXTS, int(np.ceil(LEAST_SHARE * pos)))
    toxic = np.flatnonzero(labels == 1)
    seen: Counter[str] = Counter()
    for s in names_of(toxic):
        seen.update(s)
    maybe = {x for x, n in seen.items() if n >= LEAST_TEXTS}
    seen = Counter({x: seen[x] for x in maybe})
    bad = [s & maybe for s in names_of(toxic)]
    clean: Counter[str] = Counter()
    for s in names_of(np.flatnonzero(labels == 0)):
        clean.update(s & maybe)
    out: dict[str, tuple[int, float]] = {}

    def weight(a: float, b: float, n: int) -> tuple[int, float]:
        return INSULT, float(min(6.0, np.log((a + 0.5) / (n + 1)) - np.log((b + 0.5) / (neg + 1))))

    def ranked(seen: Counter, n: int) -> list[tuple[float, str]]:
        cand = [x for x, k in seen.items() if k >= few and k * neg > RATIO * clean[x] * n]
        a, b = np.array([seen[x] for x in cand], float), np.array([clean[x] for x in cand], float)
        g = _g(a, b, n, neg) if cand else a
        # the longest of equals
        return sorted(((round(float(g[i]), 6), len(x.lstrip("=")), x) for i, x in enumerate(cand) if g[i] >= least), reverse=True)

    sure = 3 * np.log(100 * max(1, sum(n >= few for n in seen.values())))  # chance alone is not to reach it among so many
    for value, _, x in ranked(seen, pos):
        if value < max(least, sure):
            break
        plain = x.lstrip("=")
        if len(out) >= most or any(plain.startswith(o) for o in out if o[0] != "="):
            continue
        longer = {o for o in out if o.lstrip("=").startswith(plain)}  # what is known already does not speak for a shorter stem
        new = sum(x in s and not s & longer for s in bad) if longer else seen[x]
        if new >= few and new * neg > RATIO * clean[x] * pos and _g(np.array([float(new)]), np.array([float(clean[x])]), pos, neg)[0] >= max(least, sure):
            out[x] = weight(new, clean[x], pos)
    left = [s for s in bad if not s & out.keys()]
    seen = Counter(x for s in left for x in s)
    while left and len(out) < most:
        best = ranked(seen, len(left))
        if not best:
            break
        x = best[0][2]
        out[x] = weight(seen[x], clean[x], len(left))
        left = [s for s in left if x not in s]
        seen = Counter(x for s in left for x in s)
    return out


def fit_scale(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.02) -> np.ndarray:
    """Logistic weights (last: bias) by Newton's steps, halved until they help; the weights of outputs cannot fall below zero."""
    z = np.column_stack([np.log1p(x), np.ones(len(x))])
    penalty = np.append(np.full(z.shape[1] - 1, ridge), 1e-3)

    def loss(w: np.ndarray) -> float:
        v = z @ w
        return float((np.logaddexp(0, v) - y * v).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        free = (w > 0) | (slope < 0)  # a weight at its bound stays there while the slope holds it
        free[-1] = True
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], slope[free])
        for _ in range(30):
            to = w - step
            to[:-1] = np.clip(to[:-1], 0, None)
            if loss(to) < now:
                break
            step /= 2
        else:
            break
        w, now = to, loss(to)
    return w


class Model:
    def __init__(self, entries: dict[str, tuple[int, float]], scale: np.ndarray):
        self.entries, self.scale = entries, scale

    @staticmethod
    def entries_of(words: pa.Array, labels: np.ndarray) -> dict[str, tuple[int, float]]:
        """The grammar's own words, and the insults that labels teach."""
        entries = {f"={w}": (0, 0.0) for kind in WORDS for w in WORDS[kind].split()}
        for kind, listed in WORDS.items():
            for w in listed.split():
                entries[f"={w}"] = (entries[f"={w}"][0] | kind, 1.0 if kind == THREAT else 0.0)
        for x, (kind, weight) in learn_insults(words, labels).items():
            old = entries.get(x, (0, 0.0))
            entries[x] = (old[0] | kind, max(old[1], weight))
        return entries

    @classmethod
    def scaled(cls, entries: dict[str, tuple[int, float]], x: np.ndarray, labels: np.ndarray) -> Model:
        if labels.any() and not labels.all():
            return cls(entries, fit_scale(x, labels))
        return cls(entries, np.array([3.0, 4.0, 1.0, 0.0, 0.0, -2.0]))  # no labels to learn from: one matched clause is toxic

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not hasattr(self, "lexicon"):
            self.lexicon = Lexicon(self.entries)
        x = np.log1p(features(texts, self.lexicon))
        return 1 / (1 + np.exp(-np.clip(x @ self.scale[:-1] + self.scale[-1], -30, 30)))

    def __getstate__(self):
        return {"entries": self.entries, "scale": self.scale}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "toxic") -> Model:
    """The model from up to FIT_ROWS labelled rows, none of them held out (crc32 of the key mod 3 is 1).

    Whole texts, however long: workers turn each into its distinct words, then into the outputs of its clauses.
    """
    rows = _labels.sample(docs, labels, label, _labels.remainder(F.col(key), 3) != 1, key, column, FIT_ROWS)
    plain = _store.batched(rows.select("place", "text", "label"))

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text"):
            yield pa.record_batch([b.column(0), b.column(2), pa.array(Tokens(b.column(1).to_pylist()).words(), pa.list_(pa.string()))], ["place", "label", "words"])

    found = plain.mapInArrow(named, "place int, label int, words array<string>").toArrow().sort_by("place").combine_chunks()
    words = found.column("words").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.string()))
    y = found.column("label").to_numpy().astype(float)
    lexicon = Lexicon(entries := Model.entries_of(words, y))

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text"):
            x = features(b.column(1).to_pylist(), lexicon)
            yield pa.record_batch([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["place", "x"])

    x = plain.mapInArrow(told, "place int, x array<double>").toArrow().sort_by("place").column("x").to_pylist()
    _store.forget(rows)
    return Model.scaled(entries, np.array(x).reshape(len(y), len(FEATURES)), y)


def score(docs: DataFrame, model: Model, key: str = "doc_id", column: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with `toxicity` double (0 to 1) and `toxic` int (1 at the threshold or above), from whole texts alone.

    Null and empty texts match no clause and get the score of no match. Rows pass through one by one; an empty table
    gives an empty result; input columns of the new names are replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("toxicity", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of words and stems
    at, names = docs.columns.index(column), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, column):
            s = shared.value.score(b.column(at).to_pylist())
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "toxicity", "toxic"])

    return _store.batched(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
