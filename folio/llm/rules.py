"""Quality rules as a short-circuit cascade.

Each rule is a column of conditions over word and line statistics. On a random sample of bounded size every
statistic and every rule is timed and each rule's rejections are noted; the cascade then takes, step by step,
the rule with the most rejections per cost: rejections among the rows that the rules before it let pass, and
the cost of what it alone has to work out, as statistics that are known already cost nothing more. Each rule
looks at the rows that all earlier ones let pass. The order changes the cost alone, never a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _store, _text

SAMPLE = 1000  # rows on which cost and selectivity are estimated, about; twice as many at most
FEW = 0.5  # share of a chunk below which a new statistic is worked out for the rows left alone
#: Fixed values of the base rule.
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


class Texts:
    """A chunk of texts whose statistics are worked out when a rule first asks for them."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.words = _text.Words(column)
        self._kept: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return self.words.n

    def take(self, rows: np.ndarray) -> Texts:
        return Texts(self.column.take(pa.array(rows)))

    def _sum(self, flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return np.diff(c[self.words.offsets])

    def known(self, name: str) -> bool:
        return name in self._kept

    def get(self, name: str) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = getattr(self, f"_{name}")()
        return self._kept[name]

    def _n_words(self):
        return self.words.counts.astype(np.int64)

    def _word_chars(self):
        d = self.words.data
        return self._sum(_HEAD[d] & ~_text._SPACE[d])

    def _n_symbols(self):
        return self._sum(_IS_SYMBOL[self.words.data])

    def _uppercase(self):
        return self._sum(_UPPER[self.words.data])

    def _lowercase(self):
        return self._sum(_LOWER[self.words.data])

    def _lines(self):
        """Row, start and end of each line with a word."""
        w = self.words
        d, o = w.data, w.offsets
        breaks = np.flatnonzero(d == 10)
        starts = np.concatenate([o[:-1], breaks + 1])
        starts = np.unique(starts[starts < len(d)]) if len(d) else starts[:0]
        row = np.searchsorted(o, starts, "right") - 1
        after = np.searchsorted(breaks, starts)
        ends = np.minimum(np.append(breaks, len(d))[after], o[row + 1])
        first = np.searchsorted(w.starts, starts)
        worded = (first < len(w.starts)) & (np.append(w.starts, len(d))[first] < ends)
        return row[worded], starts[worded], ends[worded]

    def _n_lines(self):
        return np.bincount(self.get("lines")[0], minlength=len(self)).astype(np.int64)

    def _n_dup_lines(self):
        """Lines with a word that equal an earlier line of the text."""
        import pandas as pd

        row, s, e = self.get("lines")
        if not len(row):
            return np.zeros(len(self), np.int64)
        h = _hash_spans(self.words.data, s, e)
        code, _ = pd.factorize(_text.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        first = np.empty(code.max() + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        again = first[code] != np.arange(len(code))
        return np.bincount(row[again], minlength=len(self)).astype(np.int64)

    def _n_repeat_words(self):
        """Words in windows of REPEAT_WINDOW words found twice or more in the text."""
        import pandas as pd

        w = self.words
        at, h = _text.windows(w, w.hashes(), REPEAT_WINDOW)
        if not len(at):
            return np.zeros(len(self), np.int64)
        row = np.repeat(np.arange(w.n), w.counts)
        code, _ = pd.factorize(_text.mix(h + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        often = at[np.bincount(code)[code] > 1]
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, often, 1)
        np.add.at(cover, often + REPEAT_WINDOW, -1)
        return np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=len(self)).astype(np.int64)


def _hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Hashes of ascending byte spans, block by block."""
    out, at = np.empty(len(s), np.uint64), 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + block, "right")))
        base = s[at]
        out[at:to] = _text.spans_hash(_text._BYTE[data[base : e[to - 1]]], s[at:to] - base, e[at:to] - base)
        at = to
    return out


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


RULES = (
    Rule("few_words", lambda t: t.get("n_words") < LEAST_WORDS),
    Rule("repeats", lambda t: 100 * t.get("n_repeat_words") > REPEAT_PERCENT * t.get("n_words")),
    Rule("symbols", lambda t: 10 * t.get("n_symbols") > t.get("n_words")),
    Rule("dup_lines", lambda t: 10 * t.get("n_dup_lines") > 3 * t.get("n_lines")),
    Rule("word_length", lambda t: (t.get("word_chars") < 2 * t.get("n_words")) | (t.get("word_chars") > 20 * t.get("n_words"))),
    Rule("shouting", lambda t: t.get("uppercase") > t.get("lowercase")),
)
BASE = ("few_words", "repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float  # seconds a row, for what the rules before it do not work out
    rejected: float  # share of the rows that the rules before it let pass

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-12)


@dataclass
class _Timed:
    """What a rule took on a sample: seconds of its own, the statistics it asked for, and its verdicts."""

    seconds: float = 0.0
    asked: set[str] = field(default_factory=set)
    verdicts: list[np.ndarray] = field(default_factory=list)


class _Clocked(Texts):
    """Texts that note the seconds of each statistic, without those of the statistics it asks for itself."""

    def __init__(self, column: pa.Array, seconds: dict[str, float]):
        super().__init__(column)
        self.seconds, self.asked, self._inner = seconds, set(), 0.0

    def get(self, name: str) -> np.ndarray:
        self.asked.add(name)
        if name in self._kept:
            return self._kept[name]
        before, self._inner = self._inner, 0.0
        began = time.perf_counter()
        out = super().get(name)
        took = time.perf_counter() - began
        self.seconds[name] = self.seconds.get(name, 0.0) + took - self._inner
        self._inner = before + took
        return out


def measure(column: pa.Array, rules: tuple[Rule, ...]) -> tuple[dict[str, float], dict[str, _Timed]]:
    """Seconds of each statistic, and of each rule beyond them, on a column of texts, a chunk at a time."""
    seconds: dict[str, float] = {}
    found = {r.name: _Timed() for r in rules}
    batch = pa.record_batch([column], ["text"])
    for b in _text.chunks([batch], "text"):
        t = _Clocked(b.column(0), seconds)
        for rule in rules:
            t.asked, t._inner = set(), 0.0
            began = time.perf_counter()
            bad = rule.rejects(t)
            told = found[rule.name]
            told.seconds += time.perf_counter() - began - t._inner
            told.asked |= t.asked
            told.verdicts.append(bad)
    return seconds, found


def ranked(seconds: dict[str, float], found: dict[str, _Timed], known: Iterable[str] = ()) -> list[Estimate]:
    """The rules in the order of the cascade, best first (ties by name). known: statistics that are worked out in any case."""
    verdicts = {n: np.concatenate(f.verdicts) if f.verdicts else np.zeros(0, bool) for n, f in found.items()}
    rows = max((len(v) for v in verdicts.values()), default=0)
    passed, have, out = np.ones(rows, bool), set(known), []
    left = set(found)
    while left:
        now = []
        for n in left:
            cost = found[n].seconds + sum(seconds[s] for s in found[n].asked - have)
            now.append(Estimate(n, cost / max(rows, 1), float(verdicts[n][passed].mean()) if passed.any() else 0.0))
        best = min(now, key=lambda e: (-e.worth, e.cost, e.name))
        out.append(best)
        left.remove(best.name)
        have |= found[best.name].asked
        passed &= ~verdicts[best.name]
    return out


def drawn(docs: DataFrame, column: str = "text", sample: int = SAMPLE) -> pa.Array:
    """The texts of about `sample` rows drawn at random from the whole table."""
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.select(F.col(column).cast("string").alias("text")).sample(share, seed=sample).limit(2 * sample).toArrow()
    return rows.column(0).combine_chunks()


def estimate(docs: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES, known: Iterable[str] = (), sample: int = SAMPLE) -> list[Estimate]:
    """The rules in the order of the cascade, by a random sample."""
    return ranked(*measure(drawn(docs, column, sample), rules), known)


def cascade(texts: Texts, rules: list[Rule], done: np.ndarray | None = None) -> np.ndarray:
    """The first rule (its place in `rules`) that rejects each text, -1 for none; rows where done holds are not looked at."""
    verdict = np.full(len(texts), -1, np.int32)
    left = np.arange(len(texts)) if done is None else np.flatnonzero(~done)
    for k, rule in enumerate(rules):
        if not len(left):
            break
        bad = rule.rejects(texts if len(left) == len(texts) else _Rest(texts, left))
        verdict[left[bad]] = k
        left = left[~bad]
    return verdict


class _Rest(Texts):
    """Some rows of a chunk: statistics known for the chunk are taken from it, others are worked out for these rows alone if they are few."""

    def __init__(self, whole: Texts, rows: np.ndarray):
        self.whole, self.chosen, self._alone = whole, rows, None

    def __len__(self) -> int:
        return len(self.chosen)

    def get(self, name: str) -> np.ndarray:
        if self.whole.known(name) or len(self.chosen) > FEW * len(self.whole):
            return self.whole.get(name)[self.chosen]
        if self._alone is None:
            self._alone = self.whole.take(self.chosen)
        return self._alone.get(name)


def judge(docs: DataFrame, key: str = "doc_id", column: str = "text", rules: tuple[Rule, ...] = RULES, counts: tuple[str, ...] = COUNTS, base: tuple[str, ...] = BASE) -> DataFrame:
    """key, the counts asked for, base_failed, and kept: false if any rule rejects the text.

    counts are of every whole text, and base_failed (one of the rules named in `base` rejects) is told of every row: what
    these take is spent in any case, so the cascade prices the other rules without it. Without counts and base the cascade
    alone decides what is worked out. Null and empty texts have no words and fail the base rules. Rows with null or repeated
    keys are judged row by row; an empty table gives an empty result; other columns are not read.
    """
    first = [r for r in rules if r.name in base]
    rest = tuple(r for r in rules if r.name not in base)
    seconds, found = measure(drawn(docs, column), rules)
    spent = set(counts).union(*(found[r.name].asked for r in first))
    names = [e.name for e in ranked(seconds, {r.name: found[r.name] for r in rest}, spent)]
    order = [next(r for r in rest if r.name == name) for name in names]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text"):
            t = Texts(b.column(1))
            told = [pa.array(t.get(c).astype(np.int64)) for c in counts]
            failed = np.zeros(len(t), bool)
            for rule in first:
                failed |= rule.rejects(t)
            kept = ~failed & (cascade(t, order, failed) < 0)
            yield pa.record_batch([b.column(0), *told, pa.array(failed), pa.array(kept)], ["key", *counts, "base_failed", "kept"])

    counted = "".join(f"{c} long, " for c in counts)
    out = _store.batched(docs.select(F.col(key).alias("key"), F.col(column).alias("text"))).mapInArrow(run, f"key {kind}, {counted}base_failed boolean, kept boolean")
    return out.withColumnRenamed("key", key)


def reasons(docs: DataFrame, key: str = "doc_id", column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, rules: all rules that reject each text, in the order they are listed; every rule runs on every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, "text"):
            t = Texts(b.column(1))
            bad = np.array([rule.rejects(t) for rule in rules])
            names = [[rules[k].name for k in np.flatnonzero(column)] for column in bad.T]
            yield pa.record_batch([b.column(0), pa.array(names, pa.list_(pa.string()))], ["key", "rules"])

    out = _store.batched(docs.select(F.col(key).alias("key"), F.col(column).alias("text"))).mapInArrow(run, f"key {kind}, rules array<string>")
    return out.withColumnRenamed("key", key)
