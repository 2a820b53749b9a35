import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pairs import alike_pairs, family, joined

import corpus_pipeline
from folio.llm import _store, neardup, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    item, passage, base = say(30), say(60), say(200)
    near = base.split()
    near[10] = "changed"
    rows = [(0, base), (1, " ".join(near)), (2, base), (3, say(100) + " " + passage), (4, say(100) + " " + passage), (5, say(50) + " " + item), (6, say(40) + " you idiot " + say(40)), (7, None), (8, ""), (9, say(80)), (10, passage), (11, "short")]
    rows += [(20 + k, say(50) + (" you idiot " if k % 2 else " idiom ") + say(20)) for k in range(40)]
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "n_words": F.lit(1), "toxic": F.lit("x")})
    docs.write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame([(20 + k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"file://{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    return f"file://{d}"


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clean = {20 + k for k in range(0, 40, 2)}
    gone = [{6, *(20 + k for k in range(1, 40, 2))}, {1, 2, 8}, set(), {5}]
    left = {r.doc_id for r in docs.collect()}
    for (_, stage), out in zip(corpus_pipeline.STAGES[:4], gone, strict=True):
        after = stage(spark, docs, tables)
        assert after.columns == docs.columns and after.schema["text"].dataType == docs.schema["text"].dataType
        left -= out
        rows = after.collect()
        assert {r.doc_id for r in rows} == left and len(rows) == len(left)
        assert all(r.toxic == "x" and r.n_words == 1 and (r.text is None or r.n_chars == len(r.text)) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts[3].split()) == 160 and len(texts[4].split()) == 100 and texts[10] == "" and clean <= set(texts)
    known = _store.made()
    assert {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()} == left
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in _store.made() - known} == {"decontamination", "lexicon"}  # what the last stage reads


def test_empty_table_passes(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.isEmpty()


def test_near_copies_that_share_frequent_shingles_alone_are_one(spark):
    """The stage joins what all pairs of a bucket's members join: one row of each such class stays, that of the least key."""
    rows = family(11, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    slots = neardup.slot_weights(neardup.document_frequencies(docs))
    bands = [neardup.samples(row, h, neardup._weights(h, n, slots))[1][0] for _, t in rows for row, h, n in [neardup.shingles(pa.array([t]))]]
    met = joined(rows, [(x, y) for x, y in alike_pairs(rows, slots) if (bands[x] == bands[y]).any()])
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept <= set(met.values()) and 50 < len(kept) < 450


def test_driver_is_swept_after_each_write(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(x.getCollectionCount() for x in beans if "Old" in x.getName() or "MarkSweep" in x.getName())
    before = full()
    _store.forget(_store.written(spark.range(3), "done"))
    assert full() > before


def test_every_operator_has_a_query():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and set(queries.oracle_sql()) <= set(names)
