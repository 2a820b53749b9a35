"""From lines to blocks of running text: looks of lines, paragraphs, their way over pages, lists, sections; cells of sheets;
pictures and scans; selection; page and outline edits.

Every step is a plan of windows and aggregates keyed by file and page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import page as P
from folio.functions import text as T
from folio.operators import geometry, structure

#: Fixed values of paragraphs, in font sizes unless said otherwise.
PITCH, SIZE_OFF, HEAVY, CENTRED, LONG_LINE, SHORT_BY, NEAR_INDENT, NEAR_SIZE = 1.45, 0.12, 0.8, 0.6, 0.6, 2.0, 4.0, 0.1
SENTENCE_ENDS = ".!?。！？"


def line_looks(pieces: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """by, line, l, t, r, b, size, heavy, chars, text of lines of pieces (seq, l, t, r, b, size, heavy boolean, text): bounds,
    size and weight by characters."""
    n = F.greatest(F.char_length("text"), F.lit(1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), " ")
    return pieces.groupBy(*by, line).agg(
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"),
        (F.sum(F.col("size") * n) / F.sum(n)).alias("size"), (F.sum(F.when(F.col("heavy"), n).otherwise(0)) / F.sum(n)).alias("heavy"), F.sum(n).alias("chars"), text.alias("text"),
    )


def raised_joined(lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """lines with `joined`, the number of the line they make with those drawn before them: a raised sign or mark in a box that
    overlaps that of the line ahead and starts where it ends."""
    w = Window.partitionBy(*by).orderBy(line)
    p = F.lag(F.struct("l", "t", "r", "b", "size")).over(w)
    big = F.greatest(p["size"], F.col("size"))
    overlap = F.least(p["b"], F.col("b")) - F.greatest(p["t"], F.col("t"))
    same = (overlap >= 0.5 * F.least(p["b"] - p["t"], F.col("b") - F.col("t"))) & F.col("l").between(p["r"] - 0.3 * big, p["r"] + 0.8 * big)
    return lines.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("joined", F.sum("__new").over(w)).drop("__new")


def text_columns(lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """by, left, right, pitch of the text column that lines stand in, by ranks."""
    left = structure.value_at_rank(lines, by, "l", 10).withColumnRenamed("value", "left")
    long = structure.value_at_rank(lines.where("chars >= 20"), by, "r", 5, descending=True).withColumnRenamed("value", "__long")
    any_ = structure.value_at_rank(lines, by, "r", 5, descending=True).withColumnRenamed("value", "__any")
    w = Window.partitionBy(*by).orderBy(line)
    step = (F.col("t") + F.col("b")) / 2 - F.lag((F.col("t") + F.col("b")) / 2).over(w)
    size = F.lag("size").over(w)
    steps = lines.select(*by, step.alias("step"), size.alias("__s"), "size").where((F.abs(F.col("size") - F.col("__s")) < 0.1 * F.col("__s")) & F.col("step").between(0.7 * F.col("__s"), 2.6 * F.col("__s")))
    pitch = structure.upper_median(steps, by, "step").withColumnRenamed("median", "__pitch")
    usual = structure.upper_median(lines, by, "size").withColumnRenamed("median", "__usual")
    out = left.join(any_, by).join(usual, by).join(long, by, "left").join(pitch, by, "left")
    return out.select(*by, "left", F.coalesce("__long", "__any").alias("right"), F.coalesce("__pitch", 1.25 * F.col("__usual")).alias("pitch"))


def paragraph_breaks(lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """lines (l, t, r, b, size, heavy, chars, text) with `para` (from 1): a line starts a paragraph after a wide step, with
    another size or weight, with a list mark, with a new indent, and after a line that ends short of its neighbours;
    lines centred on one line stay together."""
    w = Window.partitionBy(*by).orderBy(line)
    rows = lines.join(text_columns(lines, by, line), by).withColumn("__mark", T.list_mark(F.col("text")).isNotNull())
    kept = ["l", "t", "r", "b", "size", "heavy", "__mark"]
    rows = rows.withColumn("__p", F.lag(F.struct(*kept)).over(w)).withColumn("__near", F.collect_list(F.struct("l", "r", "size")).over(w.rowsBetween(-5, 3)))
    p, c = F.col("__p"), F.col
    size = F.greatest(F.least(p["size"], c("size")), F.lit(1.0))
    step = (c("t") + c("b") - p["t"] - p["b"]) / 2
    alike = F.filter("__near", lambda x: (F.abs(x["size"] - p["size"]) < NEAR_SIZE * size) & (F.abs(x["l"] - p["l"]) < NEAR_INDENT * size))
    edge = F.greatest(p["r"], F.array_max(F.transform(alike, lambda x: x["r"])))
    other = (step > PITCH * F.greatest(c("pitch"), size)) | (F.abs(c("size") - p["size"]) > SIZE_OFF * size) | ((c("heavy") > HEAVY) != (p["heavy"] > HEAVY)) | c("__mark")
    centred = (F.abs(c("l") + c("r") - p["l"] - p["r"]) / 2 < CENTRED * size) & (F.abs(c("l") - p["l"]) > size) & (p["r"] - p["l"] > LONG_LINE * (c("right") - c("left")))
    ends = (p["r"] < edge - SHORT_BY * size) | ((c("l") > p["l"] + size) & ~p["__mark"])
    new = p.isNull() | other | (~centred & ends)
    return rows.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("para", F.sum("__new").over(w)).select(*lines.columns, "left", "right", "pitch", "para")


def paragraphs(lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """by, para, text, size, heavy, lines, chars, first, rest (left edges of the first and of the others), align, reaches (the
    last line fills the column) of lines from paragraph_breaks."""
    ordered = F.array_sort(F.collect_list(F.struct(line, "l", "r", "text")))
    g = lines.groupBy(*by, "para").agg(
        ordered.alias("__l"), (F.sum(F.col("size") * F.col("chars")) / F.sum("chars")).alias("__size"), (F.sum(F.col("heavy") * F.col("chars")) / F.sum("chars") > HEAVY).alias("heavy"),
        F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.first("left").alias("left"), F.first("right").alias("right"),
    )
    g = g.withColumn("size", P.half_point(F.col("__size"))).withColumn("__first", F.col("__l")[0])
    f, n, width = F.col("__first"), F.col("lines"), F.greatest(F.col("right") - F.col("left"), F.lit(1.0))
    rest = F.slice("__l", 2, F.greatest(n.cast("int") - 1, F.lit(0)))
    left_of_rest = F.when(n > 1, F.element_at(F.array_sort(F.transform(rest, lambda x: x["l"])), (F.floor((n - 1) / 2) + 1).cast("int"))).otherwise(f["l"])
    middle = (f["l"] + f["r"]) / 2
    one = F.when((F.abs(middle - (F.col("left") + F.col("right")) / 2) <= F.greatest(0.04 * width, F.lit(2.0))) & (f["l"] - F.col("left") > 1.5 * F.col("size")) & (F.col("right") - f["r"] > 1.5 * F.col("size")), "center").when(
        (F.col("right") - f["r"] < F.col("size")) & (f["l"] - F.col("left") > 0.3 * width), "right"
    ).otherwise("left")
    body = F.slice("__l", 1, F.greatest(n.cast("int") - 1, F.lit(1)))
    edge = F.array_max(F.transform(body, lambda x: x["r"]))
    many = F.when((n <= 4) & F.forall("__l", lambda x: F.abs((x["l"] + x["r"]) / 2 - middle) <= 0.6 * F.col("size")) & F.exists("__l", lambda x: F.abs(x["l"] - f["l"]) > F.col("size")), "center").when(
        F.forall(body, lambda x: edge - x["r"] <= 0.6 * F.col("size")), "both"
    ).otherwise("left")
    reaches = F.element_at("__l", -1)["r"] >= F.col("right") - 2.0 * F.col("size")
    text = T.join_lines(F.transform("__l", lambda x: x["text"]))
    return g.select(*by, "para", text.alias("text"), "size", "heavy", "lines", "chars", f["l"].alias("first"), left_of_rest.alias("rest"), F.when(n == 1, one).otherwise(many).alias("align"), reaches.alias("reaches"))


def joined_over_pages(paras: DataFrame, file: str, page: str) -> DataFrame:
    """paras with `whole`, the number of the paragraph of the file that they are a part of: where a page ends in a filled line that
    ends no sentence and the next page begins in the same size and weight, without an indent or a mark, both are one."""
    w = Window.partitionBy(file).orderBy(page, "para")
    marked = T.list_mark(F.col("text")).isNotNull()
    rows = paras.withColumn("__mark", marked)
    before = F.lag(F.struct(F.col(page).alias("page"), "text", "size", "heavy", "reaches", "__mark")).over(w)
    goes_on = (
        (before["page"] < F.col(page)) & before["reaches"] & ~before["__mark"] & ~F.col("__mark") & (F.abs(before["size"] - F.col("size")) < 0.5) & (before["heavy"] == F.col("heavy"))
        & (F.abs(F.col("first") - F.col("rest")) < 0.5 * F.col("size")) & ~F.rtrim(before["text"]).rlike(f"[{SENTENCE_ENDS}]$")
    )
    return rows.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("whole", F.sum("__new").over(w)).drop("__new", "__mark")


def list_numbers(items: DataFrame, file: str, order: str) -> DataFrame:
    """items (kind, mark, number) with `list_no`: bullets of one sign are one list; a number goes on with the list of its form
    whose last number is one less, else it begins a new one. Lists are numbered by kind and form in order of their beginning."""
    form = Window.partitionBy(file, "kind", "mark").orderBy(order)
    new = F.when(F.col("kind") == "number", F.when(F.lag("number").over(form) == F.col("number") - 1, 0).otherwise(1)).otherwise(F.when(F.row_number().over(form) == 1, 1).otherwise(0))
    rows = items.withColumn("__new", new).withColumn("__k", F.sum("__new").over(form))
    begin = F.min(order).over(Window.partitionBy(file, "kind", "mark", "__k"))
    return rows.withColumn("__begin", begin).withColumn("list_no", F.dense_rank().over(Window.partitionBy(file).orderBy("__begin"))).drop("__new", "__k", "__begin")


def sections(pages: DataFrame, file: str, page: str) -> DataFrame:
    """file, section, first, last, width, height, vertical, margins (top, right, bottom, left) of runs of pages (width, height,
    vertical, and the bounds l, t, r, b of their text) of one size and direction, two points more or less."""
    w = Window.partitionBy(file).orderBy(page)
    near = lambda c: F.abs(F.col(c) - F.lag(c).over(w)) < 2.0
    same = near("width") & near("height") & (F.col("vertical") == F.lag("vertical").over(w))
    rows = pages.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("section", F.sum("__new").over(w))
    size = F.min(F.struct(page, "width", "height", "vertical"))
    g = rows.groupBy(file, "section").agg(
        F.min(page).alias("first"), F.max(page).alias("last"), size.alias("__s"),
        F.min("t").alias("__t"), F.min(F.col("width") - F.col("r")).alias("__r"), F.min(F.col("height") - F.col("b")).alias("__b"), F.min("l").alias("__l"),
    )
    fit = lambda c, side: F.least(F.greatest(F.col(c), F.lit(18.0)), F.greatest(0.4 * F.col(f"__s.{side}"), F.lit(0.0)))
    margins = F.when(F.col("__t").isNull(), F.array(*[F.lit(72.0)] * 4)).otherwise(F.array(fit("__t", "height"), fit("__r", "width"), fit("__b", "height"), fit("__l", "width")))
    return g.select(file, "section", "first", "last", "__s.width", "__s.height", "__s.vertical", margins.alias("margins"))


# --- sheets ---------------------------------------------------------------------------------------

MOST_FORMATS = 200  # of a workbook


def decided_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells (c, value: functions.values.TYPE) with kind number or text: a weak number is one in a column whose other numbers are,
    more than half of them, written as amounts."""
    column = Window.partitionBy(*by, "c")
    number = F.col("value.kind").isin("number", "weak") & ~F.col("value.is_date")
    numbers, amounts = F.count_if(number).over(column), F.count_if(number & F.col("value.rich")).over(column)
    weak = F.when(amounts * 2 > F.greatest(numbers - 1, F.lit(0)), "number").otherwise("text")
    return cells.withColumn("kind", F.when(F.col("value.kind") == "weak", weak).otherwise(F.col("value.kind")))


def format_styles(cells: DataFrame, file: str, order: list[str], fmt: str) -> DataFrame:
    """file, fmt, style: a workbook's number formats by first appearance, from 1; the general format, and what comes after
    MOST_FORMATS, are 0."""
    first = cells.where(F.col(fmt).isNotNull()).groupBy(file, fmt).agg(F.min(F.struct(*order)).alias("__first"))
    plain = F.col(fmt) == "0"
    rank = F.row_number().over(Window.partitionBy(file, plain).orderBy("__first", fmt))
    return first.select(file, fmt, F.when(plain | (rank > MOST_FORMATS), 0).otherwise(rank).alias("style"))


def text_rows(lines: DataFrame, file: str, page: str) -> DataFrame:
    """file, row, text: the rows of a sheet of running text, where a file has no table: a line a row, an empty row between pages."""
    w = Window.partitionBy(file).orderBy(page, "line_no")
    turn = F.when(F.lag(page).over(w) != F.col(page), 1).otherwise(0)
    rows = lines.withColumn("__turn", turn).withColumn("row", F.row_number().over(w) + F.sum("__turn").over(w))
    return rows.select(file, F.col("row").cast("long").alias("row"), F.trim(F.substring("line", 1, 32_767)).alias("text")).where("text != ''")


def ends_page(grids: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """grids (bottom edge b, height) with `ends`: low on the page, with no line below but those of its lowest tenth. lines: t, b."""
    middle = (F.col("t") + F.col("b")) / 2
    low = lines.select(*by, middle.alias("__y")).join(grids.select(*by, "grid_no", F.col("b").alias("__b"), "height"), by)
    below = low.where((F.col("__y") > F.col("__b") + 1.5) & (F.col("__y") < 0.9 * F.col("height"))).select(*by, "grid_no").distinct().withColumn("__below", F.lit(True))
    return grids.join(below, [*by, "grid_no"], "left").withColumn("ends", (F.col("b") >= 0.5 * F.col("height")) & F.col("__below").isNull()).drop("__below")


def free_lines(lines: DataFrame, grids: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """lines (l, t, r, b) whose middle is in no grid (l, t, r, b, grid_no)."""
    points = lines.select(*by, line, ((F.col("l") + F.col("r")) / 2).alias("x"), ((F.col("t") + F.col("b")) / 2).alias("y"))
    return lines.join(geometry.first_container(points, grids, by, "grid_no").select(*by, line).distinct(), [*by, line], "left_anti")


# --- pictures -------------------------------------------------------------------------------------


def picture_cover(images: DataFrame, by: list[str]) -> DataFrame:
    """by, cover: the share of a page (width, height) that pictures (l, t, r, b) cover; overlaps count twice, 1 at most."""
    side = lambda low, high, most: F.greatest(F.least(F.col(high), F.col(most)) - F.greatest(F.col(low), F.lit(0.0)), F.lit(0.0))
    area = F.sum(side("l", "r", "width") * side("t", "b", "height"))
    whole = F.max(F.col("width") * F.col("height"))
    return images.groupBy(*by).agg(F.when(whole > 0, F.least(area / whole, F.lit(1.0))).otherwise(0.0).alias("cover"))


def scanned_pages(pages: DataFrame, covers: DataFrame, by: list[str]) -> DataFrame:
    """pages (text) that hold next to no text and are mostly pictures."""
    ink = F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{T.WHITE}]", ""))
    return pages.join(covers, by, "left").where(P.wants_recognition(ink, F.coalesce("cover", F.lit(0.0)))).select(*pages.columns)


def largest_use(uses: DataFrame, image: str) -> DataFrame:
    """image, width, height: the largest size at which a picture is drawn anywhere."""
    return uses.groupBy(image).agg(F.max("width").alias("width"), F.max("height").alias("height"))


def paper_colours(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, red, green, blue: the mean of the commonest of 4,096 colour steps (the first of equals) of pixels (red, green, blue)."""
    step = F.shiftleft(F.shiftright("red", 4), 8) + F.shiftleft(F.shiftright("green", 4), 4) + F.shiftright("blue", 4)
    told = pixels.groupBy(*by, step.alias("step")).agg(F.count("*").alias("n"), *(F.floor(F.avg(c)).alias(c) for c in ("red", "green", "blue")))
    best = F.max_by(F.struct("red", "green", "blue"), F.struct("n", -F.col("step")))
    return told.groupBy(*by).agg(best.alias("c")).select(*by, "c.*")


def content_bounds(pixels: DataFrame, paper: DataFrame, by: list[str], tolerance: int = 24) -> DataFrame:
    """by, l, t, r, b (r, b not included) of the pixels (x, y) that differ from the paper in a channel; blank pages are left out."""
    p = pixels.join(paper.withColumnsRenamed({c: f"__{c}" for c in ("red", "green", "blue")}), by)
    off = F.greatest(*(F.abs(F.col(c) - F.col(f"__{c}")) for c in ("red", "green", "blue")))
    return p.where(off > tolerance).groupBy(*by).agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("b"))


# --- selection ------------------------------------------------------------------------------------


def selection_rects(chars: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, rect_no, l, t, r, b: one rectangle for each line (or column) of a run of characters' boxes; blank boxes are skipped."""
    w = Window.partitionBy(*by).orderBy(order)
    solid = chars.where((F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))
    p = F.lag(F.struct("l", "t", "r", "b")).over(w)
    span = lambda v, a, b: v[b] - v[a]
    here = F.struct("l", "t", "r", "b")
    shared = lambda a, b: F.least(p[b], F.col(b)) - F.greatest(p[a], F.col(a))
    high, wide = (F.greatest(span(p, a, b), span(here, a, b)) for a, b in (("t", "b"), ("l", "r")))
    row = shared("t", "b") > 0.5 * F.least(span(p, "t", "b"), span(here, "t", "b"))
    column = shared("l", "r") > 0.5 * F.least(span(p, "l", "r"), span(here, "l", "r"))
    goes_on = F.when(row, -shared("l", "r") < 3.0 * high).otherwise(column & (-shared("t", "b") < 3.0 * wide))
    rows = solid.withColumn("__new", F.when(p.isNotNull() & goes_on, 0).otherwise(1)).withColumn("rect_no", F.sum("__new").over(w))
    return rows.groupBy(*by, "rect_no").agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))


def nearest_char(chars: DataFrame, points: DataFrame, by: list[str], order: str) -> DataFrame:
    """points (x, y and a key of their own) with `order` of the nearest character's box; the first of equals."""
    solid = chars.where((F.col("r") > F.col("l")) & (F.col("b") > F.col("t"))).select(*by, order, "l", "t", "r", "b")
    away = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.lit(0.0), F.col(v) - F.col(b))
    met = points.join(solid, by).withColumn("__d", F.pow(away("x", "l", "r"), 2) + F.pow(away("y", "t", "b"), 2))
    return met.groupBy(*points.columns).agg(F.min_by(F.col(order), F.struct("__d", order)).alias(order))


def copied(pages: DataFrame, file: str, page: str, text: str, most_pages: int = 100, most_chars: int = 1_000_000) -> DataFrame:
    """The pages of a copy: the first most_pages, cut where all their characters are most_chars: the limits of a clipboard."""
    w = Window.partitionBy(file).orderBy(page)
    n = F.char_length(F.col(text))
    rows = pages.withColumn("__k", F.row_number().over(w)).withColumn("__before", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where((F.col("__k") <= most_pages) & (F.col("__before") < most_chars))
    return rows.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(most_chars) - F.col("__before")).cast("int"))).drop("__k", "__before")


# --- page and outline edits -----------------------------------------------------------------------


def moved_pages(pages: DataFrame, file: str, page: str, chosen: list[int], to: int) -> DataFrame:
    """pages with out_no after the chosen pages (numbers from 1), kept in their order, are put in front of page `to`."""
    moves = F.col(page).isin(sorted(set(chosen)))
    rank = F.when(moves, 1).when(F.col(page) < to, 0).otherwise(2)
    return pages.withColumn("out_no", F.row_number().over(Window.partitionBy(file).orderBy(rank, page)))


def lost_items(catalogs: DataFrame, file: str) -> DataFrame:
    """file, lost: what a file loses when it is merged into another. catalogs: keys, name_trees (arrays of names), bookmarks and
    fields (booleans: there are some)."""
    #: Entries of a file's catalog that are not carried over, and what they are called.
    named = {
        "Dests": "named destinations", "StructTreeRoot": "structure tree", "OCProperties": "layer (optional content) settings", "PageLabels": "page labels", "Threads": "article threads",
        "OpenAction": "open action", "AA": "document actions", "Collection": "portfolio settings", "Perms": "permissions",
    }
    trees = {"EmbeddedFiles": "embedded files", "Dests": "named destinations", "JavaScript": "JavaScript"}
    has = lambda keys, listed: F.array_compact(F.array(*(F.when(F.array_contains(keys, k), F.lit(v)) for k, v in listed.items())))
    others = F.transform(F.filter("name_trees", lambda k: ~k.isin(*trees)), lambda k: F.concat(F.lit("name tree /"), k))
    flags = F.array_compact(F.array(F.when(F.col("bookmarks"), F.lit("bookmarks")), F.when(F.col("fields"), F.lit("form fields"))))
    return catalogs.select(file, F.array_distinct(F.concat(flags, has(F.col("name_trees"), trees), others, has(F.col("keys"), named))).alias("lost"))


def pruned_outline(outline: DataFrame, kept: DataFrame, file: str) -> DataFrame:
    """outline (seq, depth, page) without bookmarks of pages that are gone; one whose branch still has a kept page stays, without its own."""
    pages = kept.select(file, "page").distinct().withColumn("__kept", F.lit(True))
    rows = outline.join(pages, [file, "page"], "left").withColumn("__kept", F.coalesce("__kept", F.lit(False)))
    from folio.operators import graph

    told = graph.subtree_counts(rows, file, "seq", "depth")
    w = Window.partitionBy(file).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.withColumn("__upto", F.count_if("__kept").over(w)).withColumn("__place", F.row_number().over(Window.partitionBy(file).orderBy("seq")))
    ends = told.select(F.col(file), F.col("__place").alias("branch_end"), F.col("__upto").alias("__at_end"))
    below = told.join(ends, [file, "branch_end"], "left").withColumn("__below", F.coalesce("__at_end", F.lit(0)) - F.col("__upto"))
    stays = below.where(F.col("__kept") | (F.col("__below") > 0))
    return stays.select(*[c for c in outline.columns if c != "page"], F.when(F.col("__kept"), F.col("page")).alias("page"))


def moved_branch(outline: DataFrame, file: str, branch: int, to: int, place: str) -> DataFrame:
    """outline (seq, depth) with the bookmark `branch` and all below it before, after or inside the bookmark `to`. A move into
    its own branch, or past the file's end, leaves the outline as it is."""
    from folio.operators import graph

    rows = graph.subtree_counts(outline, file, "seq", "depth").withColumn("__at", F.row_number().over(Window.partitionBy(file).orderBy("seq")))
    pick = lambda which: F.max(F.when(F.col("seq") == which, F.struct("__at", "depth", "branch_end"))).over(Window.partitionBy(file))
    rows = rows.withColumn("__f", pick(branch)).withColumn("__t", pick(to))
    inside = F.col("__at").between(F.col("__f.__at"), F.col("__f.branch_end"))
    ok = F.col("__f").isNotNull() & F.col("__t").isNotNull() & ~F.col("__t.__at").between(F.col("__f.__at"), F.col("__f.branch_end"))
    ahead = F.col("__t.__at") if place == "before" else F.col("__t.branch_end") + 1
    rank = F.when(~ok, F.col("__at")).when(inside, ahead - 0.5).otherwise(F.col("__at").cast("double"))
    depth = F.when(ok & inside, F.col("depth") - F.col("__f.depth") + F.col("__t.depth") + (1 if place == "inside" else 0)).otherwise(F.col("depth"))
    moved = rows.withColumn("depth", depth).withColumn("__rank", rank)
    return moved.withColumn("seq", F.row_number().over(Window.partitionBy(file).orderBy("__rank", "__at"))).select(*outline.columns)


def name_tree(names: DataFrame, file: str, name: str, leaf: int = 64) -> DataFrame:
    """file, level, node, first, last, size: the nodes of a tree of sorted names: leaves of up to `leaf` names, and levels above
    them of up to `leaf` nodes, to one root."""
    w = Window.partitionBy(file).orderBy(name)
    rows = names.select(file, name).distinct().withColumn("node", F.floor((F.row_number().over(w) - 1) / leaf))
    level = rows.groupBy(file, "node").agg(F.min(name).alias("first"), F.max(name).alias("last"), F.count("*").alias("size"))
    out = level.select(file, F.lit(0).alias("level"), "node", "first", "last", "size")
    most = rows.groupBy(file).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth, nodes = 0, -(-most // leaf)
    while nodes > 1:
        depth, nodes = depth + 1, -(-nodes // leaf)
        several = level.withColumn("__n", F.count("*").over(Window.partitionBy(file))).where("__n > 1")
        level = several.groupBy(file, F.floor(F.col("node") / leaf).alias("node")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("size"))
        out = out.union(level.select(file, F.lit(depth), "node", "first", "last", "size"))
    return out


def warnings_of(rows: DataFrame, file: str, order: str, warning: str, most: int = 50) -> DataFrame:
    """file, warnings: each warning once, in order of its first appearance, `most` at most (the limit of a report)."""
    first = rows.where(F.col(warning).isNotNull()).groupBy(file, warning).agg(F.min(order).alias("__first"))
    ranked = first.withColumn("__k", F.row_number().over(Window.partitionBy(file).orderBy("__first", warning))).where(F.col("__k") <= most)
    return ranked.groupBy(file).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", warning))), lambda x: x[warning]).alias("warnings"))


def vertical_pages(pieces: DataFrame, by: list[str]) -> DataFrame:
    """by, vertical: whether more than half of a page's text, in bytes, is set in columns."""
    n = F.octet_length("text")
    return pieces.groupBy(*by).agg((F.sum(F.when(F.col("vertical"), n).otherwise(0)) * 2 > F.sum(n)).alias("vertical"))


