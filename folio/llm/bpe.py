"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

A text becomes tokens-to-be ("pieces": a contraction tail, a run of letters, one digit, a run of
other signs) by class runs over its code points. Frequent pieces are compiled into a minimal acyclic
transducer: a shared-suffix automaton whose arc outputs add up to the piece's number, which leads to
its ids. The automaton is one file of flat arrays that every worker maps into memory. Pieces it does
not hold are merged exactly, many at a time. Results equal those of the public library for the given
vocabulary file. A word (between white space) with a code point whose folding is not one to one, beyond the
basic plane or newer than Unicode 3.2, or with a special token's beginning, is encoded by that library,
each distinct word once; the rest of its text is not.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _store, _text

LIMIT = 0x10000  # code points from here on are left to the library
SPACE, LETTER, DIGIT, OTHER, HARD = range(5)
NONE = np.int32(2**31 - 1)
#: The public pattern's contraction tails.
TAILS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
FREQUENT = 1 << 16  # pieces in the lexicon


#: White space of the public pattern, and control signs of which it is not told.
BLANKS = (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
UNCLEAR = (0x85, *range(0x1C, 0x20), *range(0x1100, 0x1200))  # the last: parts of syllables, which compose


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below LIMIT, one more entry for all others."""
    kind, low = np.full(LIMIT + 1, OTHER, np.uint8), np.arange(LIMIT + 1, dtype=np.uint32)
    for c in range(LIMIT):
        one = chr(c)
        group, small = unicodedata.category(one), one.lower()
        kind[c] = LETTER if group[0] == "L" else DIGIT if group[0] == "N" else OTHER
        old = unicodedata.ucd_3_2_0.category(one)  # what all versions since agree on
        if group[0] == "M" or group in ("Cn", "Cs", "Co") or old != group or len(small) > 1 or ord(small) >= LIMIT or unicodedata.normalize("NFC", one) != one or unicodedata.normalize("NFC", small) != small:
            kind[c] = HARD
        else:
            low[c] = ord(small)
    kind[list(UNCLEAR)] = HARD
    kind[list(BLANKS)] = SPACE
    kind[LIMIT] = HARD
    return kind, low


_LOW = np.random.default_rng(77).integers(1, 1 << 63, LIMIT + 1, dtype=np.uint64)


class Pieces:
    """The pieces of a chunk of texts: spans starts, ends of `cps` (lower-cased code points). hard_at, hard: place and text of
    each word left to the library; cuts: where each text starts."""

    def __init__(self, texts: list[str | None]):
        kind_of, low = _tables()
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        joined = "".join([t for t in texts if t])
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cps = np.minimum(raw, LIMIT)
        kind = kind_of[cps]
        cps = low[cps]
        n = len(cps)
        bad = kind == HARD
        if n > 1:
            bad[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)  # "<|", as special tokens begin
        self.hard_at, self.hard = np.zeros(0, np.int64), []
        if bad.any():
            edge = np.ones(n + 1, bool)  # where a word or a blank begins
            edge[1:n] = (kind[1:] == SPACE) | (kind[:-1] == SPACE)
            edge[cuts] = True
            edges = np.flatnonzero(edge)
            words = np.unique(np.searchsorted(edges, np.flatnonzero(bad), "right") - 1)
            s, e = edges[words], edges[words + 1]
            self.hard_at, self.hard = s, [joined[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
            kind[_text.ranges(s, e - s)] = SPACE  # no piece of their own here
        start = np.empty(n, bool)
        if n:
            start[0] = True
            start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        heads = cuts[:-1][sizes > 0]
        start[heads] = True
        marks = np.flatnonzero((cps == 0x27) & start & (kind == OTHER))
        if len(marks):
            row_end = cuts[np.searchsorted(cuts, marks, "right")]
            padded, held = np.concatenate([cps, np.zeros(3, cps.dtype)]), np.concatenate([kind, np.full(3, SPACE, kind.dtype)])
            a = np.where((marks + 1 < row_end) & (held[marks + 1] != SPACE), padded[marks + 1], 0)
            b = np.where((marks + 2 < row_end) & (held[marks + 2] != SPACE), padded[marks + 2], 0)
            for tail in TAILS:
                fits = a == ord(tail[1])
                if len(tail) > 2:
                    fits &= b == ord(tail[2])
                m = marks[fits]
                start[m + 1] = False
                if len(tail) > 2:
                    start[m + 2] = False
                after = m + len(tail)
                after = after[after < n]
                start[after] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], n)
        solid = kind[at] != SPACE
        self.starts, self.ends = at[solid], end[solid]
        self.cps, self.cuts = cps, cuts

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each piece, the same for equal pieces, and where the first of each number stands."""
        import pandas as pd

        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = _text.spans_hash(_LOW[self.cps], self.starts, self.ends)
        code, _ = pd.factorize(h)
        first = np.empty(code.max() + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        # equal hashes are not yet equal pieces
        same = self.ends - self.starts == (self.ends - self.starts)[first][code]
        size = (self.ends - self.starts)[same]
        mine, that = _text.ranges(self.starts[same], size), _text.ranges(self.starts[first][code][same], size)
        if not same.all() or not np.array_equal(self.cps[mine], self.cps[that]):
            pieces = [self.cps[s:e].tobytes() for s, e in zip(self.starts, self.ends, strict=True)]
            code, _ = pd.factorize(np.array(pieces, object))
            first = np.empty(code.max() + 1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
        return code, first

    def utf8(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of the pieces `which`, and their offsets."""
        size = (self.ends - self.starts)[which]
        cps = self.cps[_text.ranges(self.starts[which], size)]
        width = 1 + (cps >= 0x80) + (cps >= 0x800)
        ends = np.cumsum(width)
        at = ends - width
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        two, three = width == 2, width == 3
        out[at] = np.where(three, 0xE0 | (cps >> 12), np.where(two, 0xC0 | (cps >> 6), cps))
        out[at[two] + 1] = 0x80 | (cps[two] & 0x3F)
        out[at[three] + 1] = 0x80 | ((cps[three] >> 6) & 0x3F)
        out[at[three] + 2] = 0x80 | (cps[three] & 0x3F)
        o = np.concatenate([[0], np.cumsum(size)])
        return out, np.append(at, len(out))[o]


class Transducer:
    """A minimal acyclic automaton over sorted byte strings; outputs on arcs add up to the string's number."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray):
        self.keys, self.targets, self.outputs, self.final = keys, targets, outputs, final

    @classmethod
    def compile(cls, words: list[bytes]) -> Transducer:
        """words: sorted, distinct. States with equal continuations are one state."""
        register: dict[tuple, int] = {}
        arcs: list[tuple] = []  # of each finished state: (final, ((label, target), ...))
        path: list[list] = [[False, []]]  # the states of the last word, still open

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, out = path.pop()
                state = (final, tuple(out))
                if state not in register:
                    register[state] = len(arcs)
                    arcs.append(state)
                label, _ = path[-1][1][-1]
                path[-1][1][-1] = (label, register[state])

        last = b""
        for w in words:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            close(common)
            for b in w[common:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        arcs.append((path[0][0], tuple(path[0][1])))
        below = [0] * len(arcs)  # words that each state accepts; targets come before their sources
        keys, targets, outputs = [], [], []
        for s, (final, out) in enumerate(arcs):
            n = int(final)
            for label, t in out:
                keys.append(s << 8 | label)
                targets.append(t)
                outputs.append(n)
                n += below[t]
            below[s] = n
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), np.array([a[0] for a in arcs], np.uint8))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of each byte string, -1 where the automaton does not accept it. All strings advance together."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        number = np.full(n, -1, np.int64)
        if not len(self.keys):
            return number
        live = np.flatnonzero(size > 0)
        state = np.full(len(live), len(self.final) - 1, np.int64)
        total = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[offsets[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state, total = self.targets[arc].astype(np.int64), total[ok] + self.outputs[arc]
            step += 1
            over = size[live] == step
            accepted = over & (self.final[state] == 1)
            number[live[accepted]] = total[accepted]
            live, state, total = live[~over], state[~over], total[~over]
        return number


class Vocabulary:
    """The public vocabulary file: merges as sorted arrays, token strings, and the library for hard texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t["content"] for t in self.spec["added_tokens"]]
        names = {**{i: t for t, i in vocab.items()}, **{t["id"]: t["content"] for t in self.spec["added_tokens"]}}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        #: the printable stand-ins of bytes in the vocabulary
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown}
        for b in range(256):
            char.setdefault(b, chr(256 + len(char) - len(shown)))
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.ending = np.array([vocab[char[b] + suffix] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.pair, self.rank = key, np.arange(len(pairs), dtype=np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._slots = max(10, (4 * len(pairs)).bit_length())  # a hash table a quarter full, at most; full slots lead on to the next
        self._keys, self._ranks = np.full((1 << self._slots) + len(pairs), -1, np.int64), np.full((1 << self._slots) + len(pairs), NONE, np.int32)
        left, slot = np.arange(len(pairs)), self._slot(key)
        while len(left):
            free = self._keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            self._keys[slot[put]], self._ranks[slot[put]] = key[left[put]], self.rank[left[put]]
            left, slot = left[~put], slot[~put]
            slot = slot + (self._keys[slot] != -1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._slots)).view(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        found = self._keys[slot]
        out = np.where(found == key, self._ranks[slot], NONE)
        more = (found != key) & (found != -1)
        while more.any():
            k = np.nonzero(more)
            slot[k] += 1
            found = self._keys[slot[k]]
            hit = found == key[k]
            out[k] = np.where(hit, self._ranks[slot[k]], out[k])
            more[k] = ~hit & (found != -1)
        return np.where((b >= 0) & (a >= 0), out, NONE)

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exact ids of many pieces: in each, the lowest-ranked pair merges, leftmost first, until none is left."""
        size = np.diff(offsets)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece numbers, ids, counts
        low = 0
        for width in (4, 8, 12, 20, 32, 64, 128, 256):
            which = np.flatnonzero((size > low) & (size <= width))
            low = width
            for k in range(0, len(which), 8192):
                w = which[k : k + 8192]
                parts.append((w, *self._merge_block(data, offsets[w], size[w], width)))
        for w in np.flatnonzero(size > low):
            ids = self._merge_long(data[offsets[w] : offsets[w + 1]])
            parts.append((np.array([w]), ids, np.array([len(ids)])))
        counts = np.zeros(len(size), np.int64)
        for w, _, n in parts:
            counts[w] = n
        o = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(o[-1], np.int32)
        for w, ids, n in parts:
            out[_text.ranges(o[w], n)] = ids
        return out, o

    def _merge_block(self, data, at, size, width):
        n, col = len(at), np.arange(width)
        held = col < size[:, None]
        byte = data[np.minimum(at[:, None] + col, len(data) - 1)]
        s = np.where(held, self.inner[byte], -1)
        rows = np.arange(n)
        s[rows, size - 1] = self.ending[data[at + size - 1]]
        r = np.full((n, width), NONE, np.int32)
        r[:, :-1] = self.ranks(s[:, :-1], s[:, 1:])
        live = rows
        a, b = s, r  # of the live rows
        while len(live):
            j = b.argmin(1)
            k = np.arange(len(live))
            best = b[k, j]
            go = best < NONE
            if not go.all():
                s[live[~go]] = a[~go]
                live, a, b, j, best = live[go], a[go], b[go], j[go], best[go]
                k = np.arange(len(live))
                if not len(live):
                    break
            shift = np.minimum(col + (col > j[:, None]), width - 1)
            a = np.take_along_axis(a, shift, 1)
            a[:, -1] = -1
            a[k, j] = self.merged[best]
            b = np.take_along_axis(b, np.minimum(col + (col >= j[:, None]), width - 1), 1)
            b[:, -1] = NONE
            right = np.minimum(j + 1, width - 1)
            b[k, j] = np.where(j + 1 < width, self.ranks(a[k, j], a[k, right]), NONE)
            left = np.maximum(j - 1, 0)
            b[k, left] = np.where(j > 0, self.ranks(a[k, left], a[k, j]), b[k, left])
        return s[s >= 0], (s >= 0).sum(1)

    def _merge_long(self, raw: np.ndarray) -> np.ndarray:
        """One very long piece: a heap of pairs over a linked list."""
        import heapq

        s = [*self.inner[raw[:-1]].tolist(), int(self.ending[raw[-1]])]
        n = len(s)
        table = self._lookup
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, s[i], s[i + 1]) for i in range(n - 1) if (r := table.get((s[i], s[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if not alive[i] or j < 0 or s[i] != x or s[j] != y:
                continue
            s[i] = table[x, y][1]
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (r := table.get((s[p], s[q]))):
                    heapq.heappush(heap, (r[0], p, s[p], s[q]))
        return np.array([s[i] for i in range(n) if alive[i]], np.int32)

    @property
    def _lookup(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_table"):
            self._table = {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(self.merged[r])) for k, r in zip(self.pair, self.rank, strict=True)}
        return self._table


class Lexicon:
    """The transducer and the ids of its pieces, as one memory-mapped file of flat arrays."""

    FIELDS = ("keys", "targets", "outputs", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.transducer = Transducer(*(arrays[k] for k in self.FIELDS[:4]))
        self.offsets, self.ids = arrays["offsets"], arrays["ids"]

    @staticmethod
    def dump(words: list[bytes], vocabulary: Vocabulary) -> bytes:
        """The file's bytes."""
        words = sorted(set(words))
        t = Transducer.compile(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids, o = vocabulary.merge(data, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64))
        parts = [t.keys, t.targets.astype(np.int32), t.outputs.astype(np.int32), t.final, o.astype(np.int64), ids]
        head, at = [], 0
        for name, a in zip(Lexicon.FIELDS, parts, strict=True):
            head.append((name, a.dtype.str, len(a), at))
            at += -(-a.nbytes // 8) * 8
        top = json.dumps(head).encode()
        return b"".join([len(top).to_bytes(8, "little"), top.ljust(-(-len(top) // 8) * 8), *(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in parts)])

    @classmethod
    def load(cls, path: str) -> Lexicon:
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        base = 8 + -(-n // 8) * 8
        head = json.loads(raw[8 : 8 + n].tobytes())
        return cls({k: raw[base + at : base + at + size * np.dtype(kind).itemsize].view(kind) for k, kind, size, at in head})


class Encoder:
    MOST_KNOWN = 1 << 16  # words of the library that are remembered
    MOST_MERGED = 1 << 18  # merged pieces that are remembered

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.v, self.lexicon = vocabulary, lexicon
        self.known: dict[str, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.merged: dict[bytes, int] = {}  # the place of each remembered piece in `spans`
        self.pool, self.spans = np.zeros(0, np.int32), np.zeros((0, 2), np.int64)  # their ids; start and number of each one's

    def _merge(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece's ids stand in the pool, and how many they are; pieces of earlier texts are not merged again."""
        if len(self.merged) + len(pieces) > self.MOST_MERGED:
            self._forget()
        at = np.fromiter((self.merged.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [pieces[k] for k in new.tolist()]
            ids, o = self.v.merge(np.frombuffer(b"".join(fresh), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in fresh])]).astype(np.int64))
            at[new] = np.arange(len(self.spans), len(self.spans) + len(fresh))
            self.merged.update(zip(fresh, at[new].tolist(), strict=True))
            self.spans = np.concatenate([self.spans, np.stack([o[:-1] + len(self.pool), np.diff(o)], 1)])
            self.pool = np.concatenate([self.pool, ids])
        return self.spans[at]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts behind one another, and each text's offset."""
        p = Pieces(texts)
        code, first = p.distinct()
        data, o = p.utf8(first)
        number = self.lexicon.transducer.find(data, o) if self.lexicon else np.full(len(first), -1)
        unseen = np.flatnonzero(number < 0)
        raw, cut = data.tobytes(), o.tolist()
        found = self._merge([raw[cut[k] : cut[k + 1]] for k in unseen.tolist()])
        ids = self.pool
        starts, counts = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        starts[unseen], counts[unseen] = found[:, 0], found[:, 1]
        if self.lexicon:
            seen = number >= 0
            at = self.lexicon.offsets
            starts[seen] = at[number[seen]] + len(ids)
            counts[seen] = at[number[seen] + 1] - at[number[seen]]
            ids = np.concatenate([ids, self.lexicon.ids])
        place, starts, counts = p.starts, starts[code], counts[code]
        if len(p.hard):
            found = [self._by_library(w) for w in p.hard]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ends = np.cumsum(sizes) + len(ids)
            ids = np.concatenate([ids, *found])
            place = np.concatenate([place, p.hard_at])
            order = np.argsort(place, kind="stable")
            place = place[order]
            starts, counts = np.concatenate([starts, ends - sizes])[order], np.concatenate([counts, sizes])[order]
        out = ids[_text.ranges(starts, counts)] if len(counts) else np.zeros(0, np.int32)
        return out, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(place, p.cuts)]

    def _by_library(self, word: str) -> np.ndarray:
        if word not in self.known:
            if len(self.known) >= self.MOST_KNOWN:
                self.known.clear()
            self.known[word] = np.array(self.v.library.encode(word, add_special_tokens=False).ids, np.int32)
        return self.known[word]

    def decode(self, ids: np.ndarray) -> bytes:
        """The library's decode for a file without a decoder: token strings joined by one space."""
        return b" ".join(map(self.v.names.__getitem__, ids.tolist()))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _encoder(path: str, file: str | None) -> Encoder:
    return Encoder(vocabulary(path), Lexicon.load(SparkFiles.get(file)) if file else None)


def piece_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """How often each piece stands in all texts: piece binary, n long; one row a piece."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.chunks(batches, column):
            p = Pieces(b.column(0).to_pylist())
            code, first = p.distinct()
            if len(first):
                data, o = p.utf8(first)
                yield pa.record_batch([_text.string_array(data, o).cast(pa.binary()), pa.array(np.bincount(code, minlength=len(first)))], ["piece", "n"])

    return _store.batched(docs.select(F.col(column))).mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int, steps: int = 1024) -> DataFrame:
    """The `most` rows (piece, n) of greatest n, of equals those of least hash; no task and no driver holds more than `steps` counts."""
    value, low, high = F.col("n"), 0, counts.agg(F.max("n")).first()[0]
    taken, left = F.lit(False), most
    for name in ("n", "hash"):
        while high is not None and high > low:  # the step in which the cut falls is halved again and again
            width = -(-(high - low + 1) // steps)
            step = F.floor((value - low) / width).cast("long")
            rows = counts.where(~taken & value.between(low, high)).groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()
            total, cut = 0, None
            for r in sorted(rows, key=lambda r: -r["step"]):
                if total + r["k"] > left:
                    cut = r["step"]
                    break
                total += r["k"]
            if cut is None:  # all of them fit
                return counts.where(taken | (value >= low)) if name == "n" else counts.where(taken | value.between(low, high))
            bound = low + (cut + 1) * width
            taken, left = taken | value.between(bound, high), left - total
            low, high = low + cut * width, min(high, bound - 1)
        if name == "n" and high is not None:  # of the pieces of one count, by hash
            counts = counts.withColumn("hash", F.when(F.col("n") == low, F.pmod(F.xxhash64("piece"), F.lit(1 << 40))).otherwise(-1))
            value, low, high = F.col("hash"), 0, (1 << 40) - 1
    return counts.where(taken)


def build_lexicon(docs: DataFrame, vocab_path: str, column: str = "text", frequent: int = FREQUENT) -> str:
    """Compile the corpus's most frequent pieces, `frequent` at most, and hand the file to every executor; its name."""
    spark = docs.sparkSession
    counts = _store.written(piece_counts(docs, column), "pieces")
    words = [bytes(r[0]) for r in _most_frequent(counts, frequent).select("piece").collect()]
    _store.forget(counts)
    path = _store.shared_dir(spark, "lexicon")
    _store.put(spark, path, Lexicon.dump(words, vocabulary(vocab_path)))  # a few MB
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, vocab_path: str, lexicon: str | None = None, column: str = "text") -> DataFrame:
    """docs with `ids` array<int>: the tokens of each whole text (null and empty texts: none); an input column `ids` is replaced."""
    docs = docs.drop("ids")
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocab_path, lexicon)
        for b in _text.chunks(batches, column):
            ids, rows = enc(b.column(names.index(column)).to_pylist())
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids))], [*names, "ids"])

    from pyspark.sql import types as T

    return _store.batched(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, vocab_path: str, column: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of the tokens in `column` (null and empty lists: the empty text); an input column `decoded` is replaced."""
    rows = rows.drop("decoded")
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocab_path, None)
        for b in batches:
            texts = [enc.decode(np.asarray(ids or [], np.int32)).decode() for ids in b.column(names.index(column)).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    from pyspark.sql import types as T

    return _store.batched(rows).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, vocab_path: str, lexicon: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both: key, n_tokens, ids_sha256, decoded_sha256.

    Nulls and empty texts have no ids and the digest of nothing. Repeated rows and null keys pass through row by row; an
    empty table gives an empty result; other columns of docs are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocab_path, lexicon)
        for b in _text.chunks(batches, column):
            ids, rows = enc(b.column(1).to_pylist())
            raw, r = ids.astype("<u4"), rows.tolist()
            a = [hashlib.sha256(raw[x:y].tobytes()).hexdigest() for x, y in zip(r[:-1], r[1:], strict=True)]
            d = [hashlib.sha256(enc.decode(ids[x:y])).hexdigest() for x, y in zip(r[:-1], r[1:], strict=True)]
            yield pa.record_batch([b.column(0), pa.array(np.diff(rows)), pa.array(a, pa.string()), pa.array(d, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = _store.batched(docs.select(F.col(key).alias("key"), F.col(column))).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
