"""Five stages over documents: toxic texts go, one text of each near-duplicate class stays, repeated passages go,
texts that overlap the benchmark go, and what is left is encoded and decoded.

Each stage works on all that its predecessor kept, takes (spark, docs, sf_dir), and all but the last return the columns
of documents. Empty tables pass through every stage; null and empty texts are kept (as equal texts, one of them), and so
are texts of which no word is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import _store, bpe, decontaminate, neardup, substrings, toxicity


def _shielded(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with neutral names for all columns but doc_id and text, and the way back: no stage's own names can clash."""
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the grammar scores below its threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, back = _shielded(docs)
    return toxicity.score(plain, model).where("toxic = 0").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that an earlier text holds in a window of 20; untouched ones keep their bytes. Every row stays,
    also one of which no word is left: its text is empty."""
    plain, back = _shielded(docs)
    done = substrings.remove_repeats(plain)
    cut = F.col("n_removed") > 0
    new = [F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text")]
    left = done.select(*(c for c in plain.columns if c != "text"), *new, cut.alias("__cut")).select(*back, "__cut")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an overlap with a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(docs, path, bpe.build_lexicon(docs, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substrings", drop_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None  # a learned grammar, sampling and BPE are beyond SQL; the tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage put into the shared folder goes once its result is written; that of the last one stays, as it is read late."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        known = _store.made()
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        before, docs = docs, _store.written(done, name)
        _store.release(spark, known | {docs._written_to})
        if k:
            _store.forget(before)
