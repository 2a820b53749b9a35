"""Page geometry and small values as Columns: points and boxes of the page as shown, permissions, sizes, safe texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import WIDE_LAYOUT

#: Slack of rectangles that meet and that hold another (points); points round a page in which lines still count;
#: the least picture; characters of a page without text; the share of a page that pictures cover on a scan.
EPS, TOLERANCE, MARGIN, LEAST_IMAGE, SCAN_CHARS, SCAN_COVER = 1e-3, 0.25, 20.0, 2.0, 10, 0.5
#: Fixed values of recognition: usual and least resolution, and most pixels of a picture.
TARGET_DPI, LEAST_DPI, MOST_PIXELS, ROUNDING = 300.0, 36.0, 40_000_000, 0.995
#: The single-byte text encoding of the file format where it is not Latin-1: codes 0x18 to 0x1F, 0x80 to 0x9E, 0xA0.
DOC_LOW, DOC_HIGH, DOC_EURO = "˘ˇˆ˙˝˛˚˜", "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", "€"
UNDEFINED = "\x7f\x9f\xad"
TURNING = r"\x{2028}\x{2029}\x{202A}-\x{202E}\x{2066}-\x{2069}"
COPY_BIT, ALL_BITS = 16, 0b111100111100  # of the permission flags


def shown_point(x: Column, y: Column, box: Column, rotate: Column) -> Column:
    """struct(x, y): a point of user space on the page as it is shown (box: its visible part), from the top left."""
    x0, y0, x1, y1 = (box[k] for k in range(4))
    turn = F.pmod(rotate, F.lit(360))
    a = F.when(turn == 90, y - y0).when(turn == 180, x1 - x).when(turn == 270, y1 - y).otherwise(x - x0)
    b = F.when(turn == 90, x - x0).when(turn == 180, y - y0).when(turn == 270, x1 - x).otherwise(y1 - y)
    return F.struct(a.alias("x"), b.alias("y"))


def user_point(x: Column, y: Column, box: Column, rotate: Column) -> Column:
    """struct(x, y): the way back from shown_point."""
    x0, y0, x1, y1 = (box[k] for k in range(4))
    turn = F.pmod(rotate, F.lit(360))
    a = F.when(turn == 90, y + x0).when(turn == 180, x1 - x).when(turn == 270, x1 - y).otherwise(x + x0)
    b = F.when(turn == 90, x + y0).when(turn == 180, y + y0).when(turn == 270, y1 - x).otherwise(y1 - y)
    return F.struct(a.alias("x"), b.alias("y"))


def _cell(g: Column, box: Column, rotate: Column, along: tuple[Column, Column], across: tuple[Column, Column]) -> Column:
    """The bounds, as shown, of a stretch of a glyph's cell (struct x, y, dx, dy, adv, size, vertical)."""
    corners = [shown_point(g["x"] + a * g["dx"] - c * g["dy"], g["y"] + a * g["dy"] + c * g["dx"], box, rotate) for a in along for c in across]
    edges = [fn(*(p[k] for p in corners)) for fn, k in ((F.least, "x"), (F.least, "y"), (F.greatest, "x"), (F.greatest, "y"))]
    return F.array(*(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), e)) for e in edges))


def glyph_box(g: Column, box: Column, rotate: Column, part: Column | float = 0.0, to: Column | float = 1.0) -> Column:
    """array(l, t, r, b) of a glyph's cell, from the share `part` of its advance `to` another (of the signs of a ligature)."""
    upright = lambda low, high: F.when(g["vertical"], F.lit(low)).otherwise(F.lit(high)) * g["size"]
    at = lambda v: g["adv"] * (v if isinstance(v, Column) else F.lit(v))
    return _cell(g, box, rotate, (at(part), at(to)), (upright(-0.5, -0.2), upright(0.5, 0.8)))


def ink_box(g: Column, box: Column, rotate: Column) -> Column:
    """The box that redaction takes a glyph to cover: a little in from the cell's ends, from the base to 0.7 of the size."""
    upright = lambda low, high: F.when(g["vertical"], F.lit(low)).otherwise(F.lit(high)) * g["size"]
    return _cell(g, box, rotate, (g["adv"] * 0.1, g["adv"] * 0.9), (upright(-0.4, 0.0), upright(0.4, 0.7)))


def gap(a: Column, b: Column) -> Column:
    """From the end of glyph a to the start of b, along a's direction."""
    return (b["x"] - a["x"]) * a["dx"] + (b["y"] - a["y"]) * a["dy"] - a["adv"]


def near_page(x: Column, y: Column, size: Column, box: Column) -> Column:
    """Whether a glyph stands on the visible box, or within half its size of it."""
    room = F.greatest(size, F.lit(1.0)) * 0.5
    return x.between(box[0] - room, box[2] + room) & y.between(box[1] - room, box[3] + room)


def line_on_page(rect: Column, width: Column, height: Column) -> Column:
    return (rect[2] >= -MARGIN) & (rect[0] <= width + MARGIN) & (rect[3] >= -MARGIN) & (rect[1] <= height + MARGIN)


def is_picture(rect: Column) -> Column:
    return (rect[2] - rect[0] >= LEAST_IMAGE) & (rect[3] - rect[1] >= LEAST_IMAGE)


def meets(a: Column, b: Column) -> Column:
    """Whether two rectangles overlap by more than a hair."""
    return (a[0] < b[2] - EPS) & (b[0] < a[2] - EPS) & (a[1] < b[3] - EPS) & (b[1] < a[3] - EPS)


def within(a: Column, b: Column) -> Column:
    return (a[0] >= b[0] - TOLERANCE) & (a[1] >= b[1] - TOLERANCE) & (a[2] <= b[2] + TOLERANCE) & (a[3] <= b[3] + TOLERANCE)


def is_blank(box: Column) -> Column:
    """A box without area: the place between two pieces of text."""
    return ~((box[2] > box[0]) & (box[3] > box[1]))


def clamped(rect: Column, width: Column, height: Column) -> Column:
    """A rectangle moved onto the page, its size kept; one larger than the page starts at its edge."""
    dx = F.greatest(-rect[0], F.least(F.lit(0.0), width - rect[2]))
    dy = F.greatest(-rect[1], F.least(F.lit(0.0), height - rect[3]))
    return F.array(rect[0] + dx, rect[1] + dy, rect[2] + dx, rect[3] + dy)


def refusal(locked: Column, encrypted: Column, flags: Column, owner: Column) -> Column:
    """Why text may not be taken out of a file, null if it may: locked, or its author did not allow copying (flags: the
    permission bits) and it was not opened with the owner's password."""
    return F.when(locked, "a password is needed").when(encrypted & (flags.bitwiseAND(COPY_BIT) == 0) & ~owner, "copying text is not allowed")


def restricts(encrypted: Column, flags: Column, owner: Column) -> Column:
    """Whether a file restricts whoever opened it: encrypted, not all allowed, and not opened by its owner."""
    return encrypted & (flags.bitwiseAND(ALL_BITS) != ALL_BITS) & ~owner


def wants_recognition(text_chars: Column, cover: Column, needs_picture: bool = True) -> Column:
    scan = text_chars < SCAN_CHARS
    return scan & (cover >= SCAN_COVER) if needs_picture else scan


def recognition_dpi(width: Column, height: Column, most_side: int) -> Column:
    """The resolution to draw a page at for recognition, null if it would be too coarse."""
    by_side = F.lit(max(most_side, 1) * 72.0) / F.greatest(width, height) * ROUNDING
    by_area = F.sqrt(F.lit(float(MOST_PIXELS)) / (width * height)) * 72.0 * ROUNDING
    dpi = F.least(F.lit(TARGET_DPI), by_side, by_area)
    return F.when((width > 0) & (height > 0) & (dpi >= LEAST_DPI), dpi)


def half_point(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def millimetres(points: Column) -> Column:
    return points * 25.4 / 72


def content_rect(pixels: Column, columns: Column, rows: Column, width: Column, height: Column, pad: float) -> Column:
    """array(l, t, r, b) in points of the pixels l, t, r, b of a page's picture, with `pad` round it, kept on the page."""
    sx, sy = width / F.greatest(columns, F.lit(1)), height / F.greatest(rows, F.lit(1))
    low, high = lambda v: F.greatest(v - pad, F.lit(0.0)), lambda v, most: F.least(v + pad, most)
    return F.array(low(pixels[0] * sx), low(pixels[1] * sy), high(pixels[2] * sx, width), high(pixels[3] * sy, height))


def total_order(v: Column) -> Column:
    """struct to order floating numbers by: -0 before 0, and what is no number last."""
    return F.struct(F.isnan(v).alias("nan"), v.alias("v"), F.when((v == 0) & (F.try_divide(F.lit(1.0), v).isNull()) & F.format_string("%s", v).startswith("-"), 0).otherwise(1).alias("zero"))


# --- texts ----------------------------------------------------------------------------------------


def grouped_digits(n: Column) -> Column:
    return F.format_number(n, 0)


def escape_controls(text: Column) -> Column:
    """For a terminal: control characters but line feeds as \\xNN."""
    one = lambda c: F.when(c.rlike(r"^[\x00-\x09\x0B-\x1F\x7F-\x9F]"), F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(c)
    return F.when(~text.rlike(r"[\x00-\x09\x0B-\x1F\x7F-\x9F]"), text).otherwise(F.array_join(F.transform(F.split(text, "(?s)(?=.)"), one), ""))


def one_line(text: Column, most: int) -> Column:
    """For one line of a box: control signs and those that turn the text are spaces, cut to `most` characters."""
    return F.regexp_replace(F.substring(text, 1, most), rf"[\x00-\x1F\x7F-\x9F{TURNING}]", " ")


def document_text(raw: Column) -> Column:
    """Bytes in the file format's own single-byte encoding as text; undefined codes are the replacement sign."""
    codes = "".join(map(chr, [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0])) + UNDEFINED
    return F.translate(F.decode(raw, "ISO-8859-1"), codes, DOC_LOW + DOC_HIGH + DOC_EURO + "�" * len(UNDEFINED))


def day_text(date: Column) -> Column:
    """A date of the file as its day, year first; anything else as it is, cut to 24 characters."""
    digits = F.regexp_extract(date, r"^D:([0-9]{8})", 1)
    return F.when(digits != "", F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))).otherwise(F.substring(date, 1, 24))


def moment_text(seconds: Column) -> Column:
    """Seconds since 1970 as date and time (UTC)."""
    days, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat_ws(" ", F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd"), clock)


def shown_secret(text: Column, secret: Column) -> Column:
    """What a field shows: a password's characters as marks."""
    return F.when(secret, F.repeat(F.lit("*"), F.char_length(text))).otherwise(text)


def word_at(text: Column, place: Column) -> Column:
    """The word under a double click at character `place` (from 0): a run of letters and digits, one wide sign, or what stands there."""
    before, rest = F.substring(text, F.lit(1), place), F.substring(text, place + 1, F.char_length(text))
    plain = rf"[\p{{L}}\p{{N}}_&&[^{WIDE_LAYOUT}]]"
    whole = F.concat(F.regexp_extract(before, rf"({plain}*)$", 1), F.regexp_extract(rest, rf"^({plain}*)", 1))
    return F.when(rest.rlike(f"^{plain}"), whole).otherwise(F.substring(rest, 1, 1))
