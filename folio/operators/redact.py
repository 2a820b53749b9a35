"""Finding and taking out words and personal numbers in page text, by place in the text itself."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import PRESETS, QUERY_CHARS, fold_with_origin

MOST_WORDS = 64


def spans(text: str | None, words: list[str], presets: list[str]) -> list[tuple[int, int]]:
    """Places (start, end) of folded words and kinds of number, those that overlap made one; places that touch stay apart."""
    if not text:
        return []
    hay, origin = fold_with_origin(text)
    patterns = [re.escape(w) for w in (fold_with_origin(w)[0][:QUERY_CHARS].rstrip(" ") for w in words) if w] + [PRESETS[p] for p in presets]
    found = sorted((origin[m.start()], origin[m.end() - 1] + 1) for p in patterns for m in re.finditer(p, hay))
    out: list[list[int]] = []
    for a, b in found:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find(pages: DataFrame, text: str, words: list[str], presets: list[str] = ()) -> DataFrame:
    """pages with `spans` array<struct<start, stop>> in characters of the text (null texts: none)."""
    from pyspark.sql import types as T

    if len(words) > MOST_WORDS or any(p not in PRESETS for p in presets):
        raise ValueError("too many words or an unknown kind of number")
    pages = pages.drop("spans")
    at, names = pages.columns.index(text), pages.columns
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"start": x, "stop": y} for x, y in spans(t, words, list(presets))] for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(rows, kind)], [*names, "spans"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, *T._parse_datatype_string("spans array<struct<start:int,stop:int>>").fields]))


def redact(pages: DataFrame, text: str, words: list[str], presets: list[str] = (), mark: str = "█") -> DataFrame:
    """pages with every place filled with marks, as many as it had characters, and `redacted`: how many places."""
    found = find(pages, text, words, presets)
    last = F.aggregate("spans", F.lit(0), lambda a, s: s["stop"])
    parts = F.transform("spans", lambda s, i: F.concat(F.substring(F.col(text), F.coalesce(F.get(F.col("spans"), i - 1)["stop"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(F.col("spans"), i - 1)["stop"], F.lit(0))), F.repeat(F.lit(mark), s["stop"] - s["start"])))
    whole = F.concat(F.array_join(parts, ""), F.substring(F.col(text), last + 1, F.char_length(text)))
    return found.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(F.col(text))).withColumn("redacted", F.size("spans")).drop("spans")


def residue(pages: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Rows in whose text a removed word of two folded characters or more is left."""
    needles = [w for w in words if len(fold_with_origin(w)[0]) >= 2]
    return find(pages, text, needles).where(F.size("spans") > 0).drop("spans")
