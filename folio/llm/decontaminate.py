"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

A seed is the hash of the tokens that a mask keeps out of consecutive ones; the positions a mask
ignores may hold anything. Test and training seeds are joined; each hit puts a document and an item
on one diagonal, and the tokens along it are compared. A document counts as contaminated where some
WINDOW consecutive tokens of an item (all of a shorter one) agree in at least AGREE of each WINDOW.
The masks leave no gap: however the tokens that may differ lie, some mask keeps none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks, as kept positions: for items of SPAN tokens and more, and for each smaller number of tokens.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 3, 8, 9), (0, 1, 2, 6, 7))
SHORT = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: ((0, 1, 2), (0, 1, 3)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 4, 5, 6)),
    8: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 1, 3, 5, 6, 7)),
    9: ((0, 1, 2, 4, 5), (0, 3, 4, 5, 6), (0, 1, 2, 3, 8), (0, 1, 6, 7, 8)),
}
SPAN = 10
WINDOW, AGREE = 13, 10
BROADCAST_SEEDS = 1_000_000  # about 60 MB in memory; more seeds are joined by a shuffle


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.xxhash64(t))


def _seeds(frame: DataFrame, hashes: str, place: str, masks: list[tuple[tuple, Column]]) -> DataFrame:
    """A row for each mask and place instead of the tokens: `place` and `seed`. masks: the kept positions, and which rows they are for."""
    n = F.size(hashes)

    def seeds(m: int) -> Column:  # every mask keeps its first place; null where it does not fit
        kept, rows = masks[m]
        made = F.transform(hashes, lambda t, i: F.when(i < n - kept[-1], F.xxhash64(F.lit(m), t, *(F.get(F.col(hashes), i + o) for o in kept[1:]))))
        return F.when(rows, made).otherwise(F.transform(hashes, lambda t: F.lit(None).cast("long")))

    others = [c for c in frame.columns if c != hashes]
    rows = frame.select(*others, n.alias("__n"), F.flatten(F.array(*map(seeds, range(len(masks))))).alias("__seeds"))
    # the outer form: for the other, the optimiser infers a filter and works out the whole array once more within it
    rows = rows.select(*others, "__n", F.posexplode_outer("__seeds").alias("__j", "seed")).where("seed is not null")
    return rows.select(*others, (F.col("__j") % F.col("__n")).alias(place), "seed")


def _agreement() -> tuple[Column, Column]:
    """On a diagonal: how many item tokens agree, and the most that agree in a window."""
    agree = F.transform(F.col("__item"), lambda t, i: F.when(F.get(F.col("__doc"), F.col("__at") + i) == t, 1).otherwise(0))
    width = F.least(F.lit(WINDOW), F.size("__item"))
    first = F.sequence(F.lit(1), F.size("__item") - width + 1)
    total = F.aggregate("__agree", F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(first, lambda s: F.aggregate(F.slice("__agree", s, width), F.lit(0), lambda a, x: a + x)))
    return agree, F.struct(total.alias("total"), best.alias("best"), width.alias("width"))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", column: str = "text", item: str = "item_id", item_column: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """A row for each document and benchmark item that overlap: key, item, n_agree (item tokens that agree on the best
    diagonal), n_item_tokens, start (the document's token at which the item begins there, negative if it begins before).

    Null texts have no tokens. Items without tokens match nothing. Rows with equal keys, and items with equal ids, give one
    result, the best of them, each text compared by itself; null keys are grouped as one key, null ids as one id. Empty
    tables give an empty result. Other columns are not read, whatever their names.
    """
    from folio.llm import _store

    test = benchmark.select(F.col(item).alias("__id"), F.xxhash64(F.col(item_column)).alias("__i"), F.col(item_column).alias("__t"))
    test = test.dropDuplicates(["__id", "__i"]).select("__id", "__i", tokens(F.col("__t")).alias("__item"))
    size = F.size("__item")
    short = sorted(r[0] for r in test.where((size > 0) & (size < SPAN)).select(size).distinct().collect())
    masks = [(m, size >= SPAN) for m in MASKS] + [(m, size == k) for k in short for m in SHORT[k]]
    seeds = _seeds(test, "__item", "__q", masks)
    if seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        seeds = F.broadcast(seeds)
    train = docs.select(F.col(key).alias("__key"), F.xxhash64(F.col(column)).alias("__h"), F.col(column).alias("__text"))
    places = _seeds(train.select("__key", "__h", tokens(F.col("__text")).alias("__doc")), "__doc", "__p", [(m, F.lit(True)) for m, _ in masks])
    found = places.join(seeds, "seed").select("__key", "__h", "__id", "__i", (F.col("__p") - F.col("__q")).alias("__at")).distinct()
    # hits are written, so that the next join knows their size: few are broadcast, many are shuffled
    found = _store.written(found, "hits")
    met = train.alias("d").join(found.alias("f"), F.col("d.__key").eqNullSafe(F.col("f.__key")) & (F.col("d.__h") == F.col("f.__h")))
    hits = met.select("f.__key", "f.__id", "f.__i", "f.__at", "d.__text").alias("m")
    hits = hits.join(test.alias("t"), F.col("m.__id").eqNullSafe(F.col("t.__id")) & (F.col("m.__i") == F.col("t.__i")))
    hits = hits.select("m.__key", "m.__id", "m.__at", "m.__text", "t.__item")
    agree, measure = _agreement()
    # each array is made once: a plain column would be put into the filter below, and worked out anew for every element there
    hits = hits.select("__key", "__id", "__at", "__item", F.explode_outer(F.array(tokens(F.col("__text")))).alias("__doc"))
    judged = hits.select("__key", "__id", "__at", "__item", F.explode_outer(F.array(agree)).alias("__agree"))
    judged = judged.select("__key", "__id", "__at", "__item", F.explode_outer(F.array(measure)).alias("__m"))
    judged = judged.where(F.col("__m.best") * WINDOW >= F.col("__m.width") * AGREE)
    best = F.max(F.struct(F.col("__m.total").alias("n_agree"), F.size("__item").alias("n_item_tokens"), (-F.col("__at")).alias("back")))
    rows = judged.groupBy("__key", "__id").agg(best.alias("b"))
    return rows.select(F.col("__key").alias(key), F.col("__id").alias(item), F.col("b.n_agree").cast("long").alias("n_agree"), F.col("b.n_item_tokens").cast("long").alias("n_item_tokens"), (-F.col("b.back")).cast("long").alias("start"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", column: str = "text", item: str = "item_id", item_column: str = "text") -> DataFrame:
    """docs without the rows that overlap an item (rows that share a key with such a row go with it; null keys as one key)."""
    bad = overlaps(docs, benchmark, key, column, item, item_column).select(F.col(key).alias("__bad")).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col("__bad")), "left_anti")


def oracle() -> str:
    """DuckDB SQL for overlaps() of documents and benchmark by the rule itself: all diagonals on which tokens agree, no seeds."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda t: t <> '')"
    return f"""
with d as (select doc_id, {words} w from documents), b as (select item_id, {words} w from benchmark),
dt as (select doc_id, unnest(w) t, generate_subscripts(w, 1) p from d), bt as (select item_id, len(w) n, unnest(w) t, generate_subscripts(w, 1) q from b),
diag as (select doc_id, item_id, p - q as shift, any_value(n) n, least(any_value(n), {WINDOW}) width, count(*) total, list(q) qs from dt join bt using (t) group by all having count(*) * {WINDOW} >= least(any_value(n), {WINDOW}) * {AGREE}),
judged as (select *, list_max(list_transform(qs, lambda s: len(list_filter(qs, lambda q: q >= least(s, n - width + 1) and q < least(s, n - width + 1) + width)))) best from diag)
select doc_id, item_id, cast(max(total) as bigint) n_agree, cast(max(n) as bigint) n_item_tokens, cast(arg_min(shift, (-total, shift)) as bigint) as start
from judged where best * {WINDOW} >= width * {AGREE} group by doc_id, item_id"""
