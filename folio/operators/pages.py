"""Page sets as plans over page tables: selection, merging, extraction, deletion, rotation, splitting.

A page table has a file column, `page_no` from 1, and any columns beside. Outputs carry `out_no`, the page's place in the
new document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_ranges(spec: str) -> list[tuple[int, int | None]]:
    """The entries of a page list such as `1-3,5,8-`, in order; an open end is None. Raises ValueError where it is malformed."""
    out = []
    for part in spec.split(","):
        first, dash, last = (x.strip() for x in part.partition("-"))
        if not first.isascii() or not first.isdigit() or (last and not (last.isascii() and last.isdigit())):
            raise ValueError(f'"{part.strip()}" in the page list "{spec}" is not a page number')
        out.append((int(first), int(first) if not dash else int(last) if last else None))
        if 0 in out[-1]:
            raise ValueError(f'page numbers start at 1 (in "{part.strip()}")')
        if out[-1][1] is not None and out[-1][1] < out[-1][0]:
            raise ValueError(f'the range "{part.strip()}" runs backwards')
    return out


def page_ranges(spec: str, pages: Column) -> Column:
    """The pages that a list names in a document of so many pages, as array<int> in the order written, a page named twice
    twice. A page past the end raises an error when the row is read."""
    parts = []
    for first, last in parse_ranges(spec):
        end = pages if last is None else F.lit(last)
        good = (F.lit(first) <= pages) & (end <= pages)
        message = F.concat(F.lit(f"page {max(first, last or 0)} is out of range: the document has "), pages.cast("string"), F.lit(" pages"))
        parts.append(F.when(good, F.sequence(F.lit(first), end.cast("int"))).otherwise(F.raise_error(message).cast("array<int>")))
    return F.concat(*parts)


def _places(spec: str, page: Column, pages: Column) -> Column:
    """The places (from 0) that a page has in the list that page_ranges makes, as array<int>: one for each entry that names it.
    A page past the end raises an error when the row is read."""
    places, before = [], F.lit(0)
    for first, last in parse_ranges(spec):
        end = pages if last is None else F.lit(last)
        good = (F.lit(first) <= pages) & (end <= pages)
        message = F.concat(F.lit(f"page {max(first, last or 0)} is out of range: the document has "), pages.cast("string"), F.lit(" pages"))
        place = F.when(page.between(F.lit(first), end), (before + page - first).cast("int"))
        places.append(F.when(good, place).otherwise(F.raise_error(message).cast("int")))
        before = before + end - first + 1
    return F.array_compact(F.array(*places))


def extract(pages: DataFrame, spec: str, file: str = "path") -> DataFrame:
    """The pages that the list names, of every file, with out_no: bag semantics. Each page tells its places from its file's number
    of pages: the list itself, as long as the files, is never laid out to be joined."""
    counts = pages.groupBy(file).agg(F.max("page_no").cast("int").alias("__n"))
    placed = pages.join(counts, file).withColumn("__at", F.explode(_places(spec, F.col("page_no"), F.col("__n"))))
    return placed.withColumn("out_no", F.col("__at") + 1).drop("__at", "__n")


def delete(pages: DataFrame, spec: str, file: str = "path") -> DataFrame:
    """The pages that the list does not name, numbered anew. A file that loses all its pages raises an error."""
    counts = pages.groupBy(file).agg(F.max("page_no").cast("int").alias("__n"))
    gone = counts.select(file, "__n", F.explode(F.array_distinct(page_ranges(spec, F.col("__n")))).alias("page_no"))
    all_gone = gone.groupBy(file, "__n").agg(F.count("*").alias("__d")).where("__d >= __n")
    checked = gone.join(all_gone.select(file, F.lit(True).alias("__all")), file, "left")
    checked = checked.where(F.when(F.col("__all"), F.raise_error(F.lit("no page would be left")).cast("boolean")).otherwise(True)).select(file, "page_no")
    return numbered(pages.join(checked, [file, "page_no"], "left_anti"), file)


def numbered(pages: DataFrame, file: str = "path", order: str = "page_no") -> DataFrame:
    return pages.withColumn("out_no", F.row_number().over(Window.partitionBy(file).orderBy(order)))


def merge(files: list[DataFrame], target: str = "merged") -> DataFrame:
    """The pages of all page tables behind one another, with file_ord and out_no; one output document."""
    parts = [f.withColumn("file_ord", F.lit(k)) for k, f in enumerate(files)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    # pages before each file come from one count a file, so that no single task sees every page
    counts = whole.groupBy("file_ord").agg(F.count("*").alias("__n"))
    before = counts.select("file_ord", F.coalesce(F.sum("__n").over(Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("file_ord").orderBy("page_no"))
    return whole.withColumn("__r", rank).join(F.broadcast(before), "file_ord").withColumn("out_no", F.col("__before") + F.col("__r")).withColumn("target", F.lit(target)).drop("__before", "__r")


def insert(pages: DataFrame, others: DataFrame, at: int) -> DataFrame:
    """others' pages put in before page `at` + 1 of one document's pages."""
    base = pages.withColumn("__k", F.when(F.col("page_no") <= at, 0).otherwise(2))
    whole = base.unionByName(others.withColumn("__k", F.lit(1)), allowMissingColumns=True)
    return whole.withColumn("out_no", F.row_number().over(Window.orderBy("__k", "page_no"))).drop("__k")


def rotate(pages: DataFrame, angle: int) -> DataFrame:
    """Turned by a multiple of 90 degrees on top of the turn they have."""
    if angle % 90:
        raise ValueError("the angle must be a multiple of 90")
    return pages.withColumn("rotate", F.pmod(F.col("rotate") + F.lit(angle), F.lit(360)).cast("int"))


def split_every(pages: DataFrame, n: int, file: str = "path") -> DataFrame:
    """Documents of n pages: chunk from 1, out_no within it."""
    at = F.col("page_no") - 1
    return pages.withColumn("chunk", (F.floor(at / n) + 1).cast("int")).withColumn("out_no", (at % n + 1).cast("int"))


def visible_box(media: Column, crop: Column) -> Column:
    """The part of the crop box on the page, the crop box where they do not meet; boxes are arrays of four."""
    g = lambda a, k: F.get(a, F.lit(k))
    both = F.array(F.greatest(g(media, 0), g(crop, 0)), F.greatest(g(media, 1), g(crop, 1)), F.least(g(media, 2), g(crop, 2)), F.least(g(media, 3), g(crop, 3)))
    return F.when((g(both, 0) < g(both, 2)) & (g(both, 1) < g(both, 3)), both).otherwise(crop)


def shown_size(box: Column, rotate: Column) -> Column:
    """struct(width, height) as shown."""
    w, h = F.get(box, F.lit(2)) - F.get(box, F.lit(0)), F.get(box, F.lit(3)) - F.get(box, F.lit(1))
    turned = F.pmod(rotate, F.lit(180)) == 90
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def page_number_run(page: Column, first: Column, start: int) -> Column:
    """The number printed on a page of a numbered stretch."""
    return page - first + F.lit(start)
