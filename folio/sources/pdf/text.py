"""Page text: fonts to characters, content streams to glyphs, glyphs to lines."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

from folio.functions.text import WIDE_LAYOUT
from folio.sources.pdf.objects import Bad, Document, Op, Reader, Ref, Stream

MOST_OPERATORS, MOST_GLYPHS, MOST_FORMS = 5_000_000, 1_000_000, 32
BOLD, ITALIC = 1, 2
_WIDE = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), WIDE_LAYOUT) + "]")

#: Names of signs in the standard glyph list that encodings' differences use most.
NAMES = dict(
    pair.rsplit("=", 1)
    for pair in "space= |exclam=!|quotedbl=\"|numbersign=#|dollar=$|percent=%|ampersand=&|quotesingle='|parenleft=(|parenright=)|asterisk=*|plus=+|comma=,|hyphen=-|period=.|slash=/|colon=:|semicolon=;|less=<|greater=>|question=?|at=@|bracketleft=[|backslash=\\|bracketright=]|asciicircum=^|underscore=_|grave=`|braceleft={|braceright=}|asciitilde=~|zero=0|one=1|two=2|three=3|four=4|five=5|six=6|seven=7|eight=8|nine=9|bullet=•|endash=–|emdash=—|quoteleft=‘|quoteright=’|quotedblleft=“|quotedblright=”|ellipsis=…|fi=fi|fl=fl|germandbls=ß|Euro=€|degree=°|section=§|copyright=©|registered=®|eacute=é|egrave=è|agrave=à|ccedilla=ç|udieresis=ü|odieresis=ö|adieresis=ä|Udieresis=Ü|Odieresis=Ö|Adieresis=Ä|ntilde=ñ|aacute=á|iacute=í|oacute=ó|uacute=ú|ecircumflex=ê|acircumflex=â|ocircumflex=ô|icircumflex=î|ucircumflex=û".split("|")
)


def name_to_text(name: str) -> str | None:
    """The characters of a glyph name: listed, a letter, uniXXXX..., uXXXX to uXXXXXX; what follows a dot is left out."""
    plain = name.split(".", 1)[0]
    if plain in NAMES:
        return NAMES[plain]
    if len(plain) == 1:
        return plain
    m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", plain)
    if m:
        codes = [int(m[1][k : k + 4], 16) for k in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        if all(c < 0x110000 and not 0xD800 <= c < 0xE000 for c in codes):
            return "".join(map(chr, codes))
    return None


@dataclass
class Glyph:
    text: str
    x: float
    y: float
    dx: float
    dy: float
    advance: float
    size: float
    style: int = 0
    vertical: bool = False


class Span:
    """What one string shows: signs that run from (x, y) along (dx, dy). at: where each starts, counted along; advance: how
    far each reaches; spaced: what lies between neighbours beyond their widths, None where it is not one and the same."""

    __slots__ = ("texts", "x", "y", "dx", "dy", "at", "advance", "size", "style", "vertical", "spaced")

    def __init__(self, texts, x, y, dx, dy, at, advance, size, style=0, vertical=False, spaced=None):
        self.texts, self.x, self.y, self.dx, self.dy, self.at, self.advance = texts, x, y, dx, dy, at, advance
        self.size, self.style, self.vertical, self.spaced = size, style, vertical, spaced

    @classmethod
    def of(cls, g: Glyph) -> Span:
        return cls([g.text], g.x, g.y, g.dx, g.dy, [0.0], [g.advance], g.size, g.style, g.vertical, 0.0)

    def glyphs(self) -> list[Glyph]:
        return [Glyph(t, self.x + self.dx * a, self.y + self.dy * a, self.dx, self.dy, w, self.size, self.style, self.vertical) for t, a, w in zip(self.texts, self.at, self.advance, strict=True)]

    def singles(self) -> list[Span]:
        return [self] if len(self.texts) == 1 else [Span.of(g) for g in self.glyphs()]

    @property
    def end(self) -> float:
        return self.at[-1] + self.advance[-1]


def _codec(encoding: str | None):
    codec = {"MacRomanEncoding": "mac_roman", "WinAnsiEncoding": "cp1252"}.get(encoding or "", "cp1252")

    def char(code: int) -> str:
        return bytes([code]).decode(codec, "replace").replace("�", "")

    return char


class Font:
    """Codes of shown strings to characters and widths."""

    def __init__(self, doc: Document, info: dict):
        get = doc.get
        self.composite = info.get("Subtype") == "Type0"
        self.table: tuple[list[str], list[float]] | None = None
        base = str(get(info.get("BaseFont")) or "")
        self.name = re.sub(r"^[A-Z]{6}\+", "", base)
        low = self.name.lower()
        self.style = BOLD * bool(re.search(r"bold|black|heavy|demi", low)) | ITALIC * bool(re.search(r"italic|oblique", low))
        self.unicode: dict[int, str] = {}
        self.code_sizes: set[int] = set()
        if info.get("ToUnicode") is not None:
            self.unicode, self.code_sizes = parse_cmap(doc.stream(info["ToUnicode"]))
        self.widths: dict[int, float] = {}
        self.default, self.unit = 0.5, 0.001
        self.vertical = False
        if self.composite:
            kids = get(info.get("DescendantFonts")) or [{}]
            kid = get(kids[0]) or {}
            self.default = _number(get(kid.get("DW")), 1000) / 1000
            w = [get(x) for x in get(kid.get("W")) or []]
            k = 0
            while k + 1 < len(w):
                if isinstance(w[k + 1], list):
                    for j, v in enumerate(w[k + 1]):
                        self.widths[int(_number(w[k], 0)) + j] = _number(get(v), 0) / 1000
                    k += 2
                elif k + 2 < len(w):
                    for c in range(int(_number(w[k], 0)), min(int(_number(w[k + 1], 0)), int(_number(w[k], 0)) + 65535) + 1):
                        self.widths[c] = _number(w[k + 2], 0) / 1000
                    k += 3
                else:
                    break
            encoding = get(info.get("Encoding"))
            self.vertical = isinstance(encoding, str) and encoding.endswith("-V")
            return
        encoding = get(info.get("Encoding"))
        differences: list = []
        if isinstance(encoding, dict):
            differences = [get(x) for x in get(encoding.get("Differences")) or []]
            encoding = get(encoding.get("BaseEncoding"))
        self.char = _codec(encoding if isinstance(encoding, str) else None)
        self.named: dict[int, str] = {}
        code = 0
        for x in differences:
            if isinstance(x, (int, float)):
                code = int(x)
            else:
                text = name_to_text(str(x))
                if text is not None:
                    self.named[code] = text
                code += 1
        if info.get("Subtype") == "Type3":
            matrix = [_number(get(v), 0) for v in get(info.get("FontMatrix")) or [0.001, 0, 0, 0.001, 0, 0]]
            self.unit = abs(matrix[0]) or 0.001
        first = int(_number(get(info.get("FirstChar")), 0))
        for k, v in enumerate(get(info.get("Widths")) or []):
            self.widths[first + k] = _number(get(v), 0) * self.unit
        descriptor = get(info.get("FontDescriptor"))
        if isinstance(descriptor, dict):
            self.default = _number(get(descriptor.get("MissingWidth")), 0) * self.unit or self.default

    def codes(self, raw: bytes) -> tuple[list[str], list[float]]:
        """The characters and the width of each code."""
        if not self.composite:
            if self.table is None:
                known = {**self.named, **self.unicode}
                self.table = [known.get(c, None) if c in known else self.char(c) for c in range(256)], [self.widths.get(c, self.default) for c in range(256)]
            texts, widths = self.table
            return [texts[c] for c in raw], [widths[c] for c in raw]
        step = 1 if self.code_sizes == {1} else 2
        codes = [int.from_bytes(raw[k : k + step], "big") for k in range(0, len(raw) - step + 1, step)]
        return [self.unicode.get(c, "") for c in codes], [self.widths.get(c, self.default) for c in codes]


def _number(v, otherwise: float) -> float:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else otherwise


def parse_cmap(data: bytes) -> tuple[dict[int, str], set[int]]:
    """Codes to characters of a ToUnicode map, and the sizes of its codes in bytes."""
    out: dict[int, str] = {}
    sizes: set[int] = set()
    r, stack = Reader(data), []
    utf16 = lambda b: b.decode("utf-16-be", "ignore")
    while True:
        try:
            v = r.value()
        except Bad:
            return out, sizes
        if not isinstance(v, Op):
            stack.append(v)
            continue
        if v == "endcodespacerange":
            sizes |= {len(x) for x in stack if isinstance(x, bytes)}
        elif v == "endbfchar":
            for a, b in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[int.from_bytes(a, "big")] = utf16(b)
        elif v == "endbfrange":
            for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(min(hi - lo + 1, 65536)):
                    if isinstance(c, list):
                        if k < len(c) and isinstance(c[k], bytes):
                            out[lo + k] = utf16(c[k])
                    elif isinstance(c, bytes) and c:
                        last = int.from_bytes(c[-2:], "big") + k
                        out[lo + k] = utf16(c[:-2] + (last & 0xFFFF).to_bytes(min(2, len(c)), "big"))
        stack = []


def _times(a, b):
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2],
        a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_INLINE = re.compile(rb"[\0\t\n\x0c\r ]EI(?=[\0\t\n\x0c\r ]|$)")


class Interpreter:
    """Runs a page's content and collects glyphs, drawn rules and places of images."""

    def __init__(self, doc: Document):
        self.doc, self.spans, self.rules, self.images, self.left, self.room = doc, [], [], [], MOST_OPERATORS, MOST_GLYPHS
        self.fonts: dict[int, Font] = {}

    @property
    def glyphs(self) -> list[Glyph]:
        return [g for s in self.spans for g in s.glyphs()]

    def page(self, page: dict) -> list[Span]:
        contents = self.doc.get(page.get("Contents"))
        parts = contents if isinstance(contents, list) else [page.get("Contents")]
        data = b"\n".join(self.doc.stream(c) for c in parts if c is not None)
        self.run(data, self.doc.get(page.get("Resources")) or {}, _ONE, 0)
        return self.spans

    def run(self, data: bytes, resources: dict, ctm, depth: int) -> None:
        get, r = self.doc.get, Reader(data)
        state = {"ctm": ctm, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
        saved: list[dict] = []
        tm = line = _ONE
        args: list = []
        path: list[tuple[float, float, float, float, bool]] = []
        point = start = (0.0, 0.0)
        named = lambda kind, name: get((get(resources.get(kind)) or {}).get(name))
        while self.left > 0 and self.room > 0:
            try:
                v = r.value()
            except Bad:
                return
            if not isinstance(v, Op):
                args.append(v)
                if len(args) > 512:
                    del args[:256]
                continue
            self.left -= 1
            n = [_number(a, 0.0) for a in args]
            if v == "BT":
                tm = line = _ONE
            elif v == "q":
                saved.append(dict(state))
            elif v == "Q" and saved:
                state = saved.pop()
            elif v == "cm" and len(n) >= 6:
                state["ctm"] = _times(n[-6:], state["ctm"])
            elif v == "Tf" and len(args) >= 2:
                ref = (get(resources.get("Font")) or {}).get(args[-2])
                info = get(ref)
                key = ref.num if isinstance(ref, Ref) else id(info)
                if isinstance(info, dict):
                    if key not in self.fonts:
                        self.fonts[key] = Font(self.doc, info)
                    state["font"] = self.fonts[key]
                state["size"] = n[-1]
            elif v in ("Tc", "Tw", "TL", "Ts") and n:
                state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[v]] = n[-1]
            elif v == "Tz" and n:
                state["scale"] = n[-1] / 100
            elif v in ("Td", "TD") and len(n) >= 2:
                if v == "TD":
                    state["lead"] = -n[-1]
                tm = line = _times((1, 0, 0, 1, n[-2], n[-1]), line)
            elif v == "Tm" and len(n) >= 6:
                tm = line = tuple(n[-6:])
            elif v == "T*":
                tm = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
            elif v in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                if v == '"' and len(n) >= 3:
                    state["word"], state["char"] = n[-3], n[-2]
                if v != "Tj":
                    tm = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
                tm = self.show(args[-1], state, tm)
            elif v == "TJ" and args and isinstance(args[-1], list):
                for x in args[-1]:
                    if isinstance(x, bytes):
                        tm = self.show(x, state, tm)
                    else:
                        shift = -_number(x, 0.0) / 1000 * state["size"]
                        font = state["font"]
                        tm = _times((1, 0, 0, 1, 0, shift) if font and font.vertical else (1, 0, 0, 1, shift * state["scale"], 0), tm)
            elif v == "Do" and args:
                form = named("XObject", args[-1])
                if isinstance(form, Stream) and form.info.get("Subtype") == "Form" and depth < MOST_FORMS:
                    matrix = [_number(get(x), 0.0) for x in get(form.info.get("Matrix")) or _ONE]
                    inner = get(form.info.get("Resources")) or resources
                    self.run(self.doc.stream(form), inner, _times(matrix, state["ctm"]) if len(matrix) == 6 else state["ctm"], depth + 1)
                elif isinstance(form, Stream):
                    self.images.append(state["ctm"])
            elif v == "BI":
                end = _INLINE.search(data, r.at)
                r.at = end.end() if end else len(data)
            elif v == "m" and len(n) >= 2:
                point = start = (n[-2], n[-1])
            elif v == "l" and len(n) >= 2:
                path.append((*point, n[-2], n[-1], False))
                point = (n[-2], n[-1])
            elif v == "h":
                path.append((*point, *start, False))
            elif v == "re" and len(n) >= 4:
                x, y, w, h = n[-4:]
                path.append((x, y, x + w, y + h, True))
            elif v in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if v != "n":
                    self.rules += [(*_at(state["ctm"], a, b), *_at(state["ctm"], c, d), box) for a, b, c, d, box in path]
                path = []
            args = []

    def show(self, raw: bytes, state: dict, tm):
        """Add the span of a string; the text matrix behind it."""
        font, size, scale = state["font"], state["size"], state["scale"]
        if font is None:
            return tm
        texts, widths = font.codes(raw)
        if not texts:
            return tm
        m = _times((size * scale, 0, 0, size, 0, state["rise"]), _times(tm, state["ctm"]))
        spaced: float | None = state["char"]
        if font.vertical:
            step = -size - state["char"]
            steps, reach, along = [step] * len(texts), [abs(step) / abs(size or 1)] * len(texts), (-m[2], -m[3])
            move = (0.0, step * len(texts))
            unit = 1 / (abs(size) or 1)
        else:
            steps = [(w * size + state["char"]) * scale for w in widths]
            if state["word"] and not font.composite and 32 in raw:
                steps = [s + state["word"] * scale * (c == 32) for s, c in zip(steps, raw, strict=True)]
                spaced = None
            reach, along = widths, (m[0], m[1])
            move = (sum(steps), 0.0)
            unit = 1 / (size * scale or 1)
        norm = float(np.hypot(*along)) or 1.0
        k = abs(unit) * norm if font.vertical else unit * norm  # from text space to the length along the line
        if font.vertical:
            steps = [abs(s) for s in steps]
        places = [0.0, *accumulate(s * k for s in steps)][:-1]
        advance = [w * norm for w in reach]
        if "" in texts or None in texts:  # codes without characters move on but show nothing
            shown = [i for i, t in enumerate(texts) if t]
            texts, places, advance, spaced = [texts[i] for i in shown], [places[i] for i in shown], [advance[i] for i in shown], None
        if texts:
            self.room -= len(texts)
            gap = None if spaced is None else spaced * scale * abs(k) if not font.vertical else 0.0
            self.spans.append(Span(texts, m[4] + places[0] * along[0] / norm, m[5] + places[0] * along[1] / norm, along[0] / norm, along[1] / norm, [p - places[0] for p in places], advance, float(np.hypot(m[2], m[3])), font.style, font.vertical, gap))
        return _times((1, 0, 0, 1, *move), tm)


def _at(m, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


# --- spans to lines -------------------------------------------------------------------------------

#: Fixed values, in font sizes unless said otherwise: the gap that is a space, and that between wide signs; how far off its
#: line a sign may stand, signs of how many times its own size counting no larger, and points that always do; how near a
#: repeat stands; how far back a new run starts; cosines of one direction and of one across it; the room of an upright sign
#: in a column before and behind the end of the one above; how many signs ahead repeats are looked for.
SPACE_GAP, WIDE_GAP = 0.15, 0.8
OFF_BASE, LARGER, OFF_POINTS, REPEAT, BACK = 0.5, 1.6, 0.05, 0.12, 0.5
SAME_WAY, ACROSS_WAY, UPRIGHT = 0.98, 0.3, 0.9
ABOVE, BELOW, LOOK_AHEAD = 0.6, 2.5, 16


class Line:
    """Spans on one line, in the order they were drawn. The first one gives the line its direction, base and size."""

    def __init__(self, span: Span):
        self.dx, self.dy, self.size = span.dx, span.dy, span.size
        self.base = span.y * span.dx - span.x * span.dy
        self.spans = [span]

    def _place(self, s: Span) -> tuple[float, float, float]:
        """Where a span starts along the line, how far off its base, and the cosine between both."""
        return s.x * self.dx + s.y * self.dy, s.y * self.dx - s.x * self.dy - self.base, s.dx * self.dx + s.dy * self.dy

    def takes(self, s: Span) -> bool:
        """Whether a span goes on with the line: on its base, or an upright sign set into a column."""
        along, off, turn = self._place(s)
        if turn > SAME_WAY:
            return abs(off) <= max(OFF_BASE * min(self.size, LARGER * s.size), OFF_POINTS)
        if len(s.texts) > 1 or abs(turn) >= ACROSS_WAY or abs(self.dy) <= UPRIGHT:
            return False
        last = self.spans[-1]
        start, _, cosine = self._place(last)
        room = along - start - last.end * cosine
        return abs(off) <= max(self.size, s.size) and -ABOVE * self.size <= room <= BELOW * self.size

    def signs(self) -> dict[str, np.ndarray]:
        """All signs in order of reading: runs that start well before what was drawn ahead of them are put in their place, and
        signs drawn twice for a bold look stand once. along, off: their place; cos, sin of their direction; span: whose they are."""
        many = [len(s.texts) for s in self.spans]
        own = np.repeat(np.arange(len(many)), many)
        of = {k: np.array([getattr(s, k) for s in self.spans])[own] for k in ("x", "y", "dx", "dy", "size", "style")}
        at = np.concatenate([s.at for s in self.spans])
        v = {
            "text": np.array([t for s in self.spans for t in s.texts], object), "advance": np.concatenate([s.advance for s in self.spans]), "span": own,
            "x": of["x"] + of["dx"] * at, "y": of["y"] + of["dy"] * at, "dx": of["dx"], "dy": of["dy"], "size": of["size"], "style": of["style"],
        }
        v["along"], v["off"] = v["x"] * self.dx + v["y"] * self.dy, v["y"] * self.dx - v["x"] * self.dy
        v["drawn"] = np.arange(len(own))
        parallel, gap, big = _between(v)
        run = np.concatenate([[0], np.cumsum(~parallel | (gap < -BACK * np.maximum(big, 0.01)))])
        heads = v["along"][np.searchsorted(run, np.arange(run[-1] + 1))]
        if (np.diff(heads) < -BACK * self.size).any():
            order = np.lexsort((v["drawn"], np.argsort(np.argsort(heads, kind="stable"))[run]))
            v = {k: c[order] for k, c in v.items()}
            _, gap, big = _between(v)
        if (gap < -REPEAT * big).any():
            v = self._once(v)
        return v

    @staticmethod
    def _once(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.argsort(v["along"], kind="stable")
        order = order[[not t[0].isspace() for t in v["text"][order]]]
        gone = np.zeros(len(v["text"]), bool)
        for ahead in range(1, LOOK_AHEAD + 1):
            a, b = order[:-ahead], order[ahead:]
            near = REPEAT * np.maximum(np.maximum(v["size"][a], v["size"][b]), 0.1)
            twice = (v["along"][b] - v["along"][a] <= near) & (np.abs(v["off"][b] - v["off"][a]) <= near) & (v["text"][a] == v["text"][b])
            later = np.where(v["drawn"][a] > v["drawn"][b], a, b)
            gone[later[twice]] = True
        return {k: c[~gone] for k, c in v.items()}

    def text(self) -> str:
        if len(self.spans) == 1:
            s = self.spans[0]
            if s.spaced is not None and -REPEAT * s.size <= s.spaced <= SPACE_GAP * s.size:  # nothing stands between its signs or over them
                return "".join(s.texts).strip(" ")
        v = self.signs()
        parallel, gap, _ = _between(v)
        blank = np.array([t[0].isspace() for t in v["text"]])
        behind = np.array([t.endswith(" ") for t in v["text"]])
        wide = np.array([bool(_WIDE.match(t)) for t in v["text"]])
        least = np.where(wide[1:] & wide[:-1], WIDE_GAP, SPACE_GAP) * 0.5 * (v["size"][1:] + v["size"][:-1])
        space = parallel & (gap > least) & ~blank[1:] & ~blank[:-1] & ~behind[:-1]
        return "".join([(" " if new else "") + t for new, t in zip(np.append(False, space).tolist(), v["text"].tolist(), strict=True)]).strip(" ")

    def pieces(self) -> list[dict]:
        """Stretches between spaces and changes of style, with their boxes (y grows upwards)."""
        v = self.signs()
        _, gap, _ = _between(v)
        solid = np.array([not t.isspace() for t in v["text"]])
        cut = np.ones(len(solid), bool)
        cut[1:] = (gap > SPACE_GAP * 0.5 * (v["size"][1:] + v["size"][:-1])) | (v["style"][1:] != v["style"][:-1]) | ~solid[:-1]
        heads = np.flatnonzero(cut & solid)
        other = v["x"] + v["dx"] * v["advance"]
        low, high = np.minimum(v["x"], other), np.maximum(v["x"], other)
        out = []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(solid)], strict=True):
            part = np.arange(a, b)[solid[a:b]]
            out.append({"text": "".join(v["text"][part]), "l": float(low[part].min()), "r": float(high[part].max()), "y": float(v["y"][a]), "size": float(v["size"][part].max()), "style": int(v["style"][a])})
        return out


def _between(v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sign and the next: whether they run the same way, the gap along the first, and the larger size."""
    a = {k: v[k][:-1] for k in ("x", "y", "dx", "dy", "advance", "size")}
    b = {k: v[k][1:] for k in ("x", "y", "dx", "dy", "size")}
    gap = (b["x"] - a["x"]) * a["dx"] + (b["y"] - a["y"]) * a["dy"] - a["advance"]
    return a["dx"] * b["dx"] + a["dy"] * b["dy"] > SAME_WAY, gap, np.maximum(a["size"], b["size"])


def build_lines(spans: list[Span | Glyph]) -> list[Line]:
    """Lines in drawing order."""
    lines: list[Line] = []
    for s in (Span.of(s) if isinstance(s, Glyph) else s for s in spans):
        if lines and lines[-1].takes(s):
            lines[-1].spans.append(s)
        elif lines and len(s.texts) > 1 and lines[-1].takes(s.singles()[0]):  # signs set into a column, one by one
            for one in s.singles():
                if lines[-1].takes(one):
                    lines[-1].spans.append(one)
                else:
                    lines.append(Line(one))
        else:
            lines.append(Line(s))
    return lines


def page_lines(spans: list[Span | Glyph]) -> list[str]:
    return [t for t in (line.text() for line in build_lines(spans)) if t]
