"""Document structure from lines and paragraphs: running headers, body look, headings, lists, bookmarks, search order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T


def lines(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, line_no (from 1), line: the lines of each text."""
    return docs.select(key, F.posexplode(F.split(F.col(column), "\n")).alias("__at", "line")).select(key, (F.col("__at") + 1).alias("line_no"), "line")


def running_bands(rows: DataFrame, file: str, page: str, band: str, line: str) -> DataFrame:
    """file, band, key, pages of lines that repeat: on two pages at least, and on half of the file's pages. Page numbers
    are told by the text alone (functions.text.is_page_number) and not listed here."""
    total = rows.groupBy(file).agg(F.count_distinct(page).alias("__total"))
    keyed = rows.where(~T.is_page_number(F.col(line))).select(file, page, band, T.band_key(F.col(line)).alias("key"))
    seen = keyed.groupBy(file, band, "key").agg(F.count_distinct(page).alias("pages"))
    return seen.join(total, file).where((F.col("pages") >= 2) & (F.col("pages") * 2 >= F.col("__total"))).drop("__total")


def without_bands(rows: DataFrame, bands: DataFrame, file: str, band: str, line: str) -> DataFrame:
    """rows without page numbers and running lines."""
    left = rows.where(~T.is_page_number(F.col(line))).withColumn("key", T.band_key(F.col(line)))
    return left.join(bands, [file, band, "key"], "left_anti").drop("key")


def weighted_mode(rows: DataFrame, by: list[str], key: str, weight: Column) -> DataFrame:
    """by, mode, total: the key of most weight, the largest of equals."""
    sums = rows.groupBy(*by, key).agg(F.sum(weight).alias("__w"))
    return sums.groupBy(*by).agg(F.max(F.struct("__w", key)).alias("__m")).select(*by, F.col(f"__m.{key}").alias("mode"), F.col("__m.__w").alias("total"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: the value at place n // 2 (from 0) of each group in order; counted by rank, so that no group is gathered."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by).orderBy(value)
    placed = counted.withColumn("__upto", F.sum("__c").over(w)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    at = F.floor(F.col("__n") / 2)
    return placed.where((F.col("__upto") > at) & (F.col("__upto") - F.col("__c") <= at)).select(*by, F.col(value).alias("median"))


def value_at_rank(rows: DataFrame, by: list[str], value: str, share: int, descending: bool = False) -> DataFrame:
    """by, value: the value at place n // share (from 0) in order, or from the top."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by).orderBy(F.desc(value) if descending else F.asc(value))
    placed = counted.withColumn("__upto", F.sum("__c").over(w)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    at = F.floor(F.col("__n") / share)
    return placed.where((F.col("__upto") > at) & (F.col("__upto") - F.col("__c") <= at)).select(*by, F.col(value).alias("value"))


MIN_PARAS_STRICT, MAX_LEVEL = 40, 4


def headings(paras: DataFrame, file: str, body: DataFrame) -> DataFrame:
    """paras with `level` (0: none, 1 to 4). Columns used: size, heavy, lines, chars, text, band, marked.

    A class is a size (in half points) and weight. Classes of many long paragraphs are text; candidates are bigger than the
    body, or bold lines that end no sentence; where a sixth of a long document would be headings only much bigger ones are.
    body: file, body (the usual size).
    """
    half = F.floor(F.col("size") * 2).cast("int")
    p = paras.withColumn("__size", half).join(body.select(file, F.col("body").alias("__body")), file)
    free = (F.col("band") == 0) & ~F.col("marked")
    classes = p.where(free).groupBy(file, "__size", "heavy").agg(F.count("*").alias("__all"), F.count_if(F.col("lines") > 1).alias("__multi"), F.sum("chars").alias("__chars"))
    totals = classes.groupBy(file).agg(F.sum("__all").alias("__paras"), F.max("__chars").alias("__most"))
    p = p.join(classes, [file, "__size", "heavy"], "left").join(totals, file, "left")
    text_like = ((F.col("__multi") >= 3) & (F.col("__multi") * 4 >= F.col("__all"))) | ((F.col("__paras") >= 20) & (F.col("__chars") * 4 >= F.col("__most")))
    ink = F.char_length(F.regexp_replace("text", f"[{T.WHITE}]", ""))
    enough = (ink >= 3) | ((ink == 2) & F.col("text").rlike(f"[{T.WIDE_LAYOUT}]"))
    sentence = F.col("text").rlike(f"[.。;；,，:：][{T.WHITE}]*$")
    size, base = F.col("size"), F.col("__body")
    short = (F.col("lines") <= 3) & (F.col("chars") <= 120)
    big = (size >= base * 1.08) & (size >= base + 1) & short & ((F.col("lines") == 1) | (size >= base * 1.15))
    bold = F.col("heavy") & (size >= base * 0.95) & (F.col("lines") == 1) & (F.col("chars") <= 80) & ~sentence
    fit = free & ~text_like & enough & ~T.is_page_number(F.col("text"))
    p = p.withColumn("__lax", F.coalesce(fit & (big | bold), F.lit(False))).withColumn("__strict", F.coalesce(fit & (size >= base * 1.15) & short, F.lit(False)))
    many = p.groupBy(file).agg(F.count_if("__lax").alias("__c"), F.max("__paras").alias("__n")).select(file, ((F.col("__n") >= MIN_PARAS_STRICT) & (F.col("__c") * 6 > F.col("__n"))).alias("__tight"))
    p = p.join(many, file).withColumn("__is", F.when(F.col("__tight"), F.col("__strict")).otherwise(F.col("__lax")))
    levels = p.where("__is").select(file, "__size", "heavy").distinct()
    levels = levels.withColumn("__level", F.least(F.dense_rank().over(Window.partitionBy(file).orderBy(F.desc("__size"), F.desc("heavy"))), F.lit(MAX_LEVEL)))
    out = p.join(levels, [file, "__size", "heavy"], "left")
    return out.select(*paras.columns, F.when(F.col("__is"), F.col("__level")).otherwise(0).cast("int").alias("level"))


def confirmed_lists(paras: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """paras with `mark`: a number starts a list item only after the number before it or ahead of the number after it."""
    w = Window.partitionBy(file).orderBy(order)
    m = paras.withColumn("__m", T.list_mark(F.col(text)))
    number = F.col("__m.number")
    ok = (F.col("__m.kind") == "bullet") | (F.lag(number).over(w) == number - 1) | (F.lead(number).over(w) == number + 1)
    return m.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("mark", F.when(F.col("__ok"), F.col("__m"))).drop("__m", "__ok")


def bookmarks(heads: DataFrame, file: str, order: str) -> DataFrame:
    """Headings of levels 1 to 3 as bookmarks: file, seq, depth, title; no depth jumps by more than one from its predecessor."""
    w = Window.partitionBy(file).orderBy(order)
    kept = heads.where(F.col("level").between(1, 3))
    rows = kept.withColumn("seq", F.row_number().over(w)).withColumn("__l", F.collect_list("level").over(w))
    depth = F.aggregate("__l", F.lit(-1), lambda d, level: F.least(level - 1, d + 1))
    return rows.select(file, "seq", depth.alias("depth"), T.one_line(F.col("text")).alias("title"))


def bookmark_export(outline: DataFrame, file: str) -> DataFrame:
    """file, export: a line for each bookmark, a tab for each depth, title, tab, page."""
    line = F.concat(F.repeat(F.lit("\t"), F.col("depth")), "title", F.lit("\t"), F.col("page").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return outline.groupBy(file).agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("export"))


def bookmark_import(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, seq, depth, title, page from such lines; a line without a page raises an error."""
    rows = files.select(file, F.posexplode(F.split(text, "\r?\n")).alias("__at", "line")).where(F.trim("line") != "")
    page = F.regexp_extract("line", r"\t\s*([0-9]+)\s*$", 1)
    checked = F.when(page != "", page.cast("int")).otherwise(F.raise_error(F.concat(F.lit("a bookmark line without a page: "), F.col("line"))).cast("int"))
    title = F.regexp_extract("line", r"^\t*(.*?)\t\s*[0-9]+\s*$", 1)
    return rows.select(file, F.row_number().over(Window.partitionBy(file).orderBy("__at")).alias("seq"), F.char_length(F.regexp_extract("line", r"^\t*", 0)).alias("depth"), title.alias("title"), checked.alias("page"))


def search(pages: DataFrame, file: str, page: str, text: str, query: str, start: int = 1, most: int = 10_000, most_page: int = 2_000) -> DataFrame:
    """file, page, hit (from 1), start_char: hits in folded text, pages in order from `start` and round again; at most
    most_page of a page and most of a file, the limits of an interactive search."""
    folded = T.fold(F.col(text))
    wanted = T.fold_query(F.lit(query))
    rows = pages.select(file, page, T.hit_starts(folded, wanted).alias("__s"), F.max(page).over(Window.partitionBy(file)).alias("__n"))
    rows = rows.withColumn("__turn", F.pmod(F.col(page) - F.lit(start), F.col("__n")))
    hits = rows.select(file, page, "__turn", F.posexplode(F.slice("__s", 1, most_page)).alias("__at", "start_char"))
    rank = F.row_number().over(Window.partitionBy(file).orderBy("__turn", "__at"))
    return hits.withColumn("__r", rank).where(F.col("__r") <= most).select(file, page, (F.col("__at") + 1).alias("hit"), "start_char", F.col("__r").alias("rank"))


def shared_strings(rows: DataFrame, order: str, value: str) -> DataFrame:
    """value, index (by first appearance, from 0), uses: the dictionary of a workbook's strings."""
    first = rows.groupBy(value).agg(F.min(order).alias("__first"), F.count("*").alias("uses"))
    return first.withColumn("index", F.row_number().over(Window.orderBy("__first", value)) - 1).drop("__first")


def sheet_names(titles: DataFrame, order: str, title: str) -> DataFrame:
    """titles with `sheet`: signs that sheets may not have become _, at most 31 characters, names alike but for case get (n)."""
    plain = F.regexp_replace(F.regexp_replace(title, r"[\[\]:*?/\\\p{Cntrl}]", "_"), "^'|'$", "_")
    base = F.when(F.trim(plain) == "", "Sheet").otherwise(F.substring(plain, 1, 31))
    w = Window.partitionBy(F.lower("__base")).orderBy(order)
    rows = titles.withColumn("__base", base).withColumn("__k", F.row_number().over(w))
    tail = F.concat(F.lit("("), F.col("__k").cast("string"), F.lit(")"))
    name = F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat(F.expr("substring(__base, 1, 31 - char_length(concat('(', __k, ')')))"), tail))
    return rows.withColumn("sheet", name).drop("__base", "__k")
