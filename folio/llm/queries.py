"""One thin query per operator over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import bpe

    docs = _table(spark, sf_dir, "documents")
    lexicon = bpe.build_lexicon(docs, _vocabulary())
    return bpe.round_trip(docs, _vocabulary(), lexicon)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import neardup

    return neardup.classes(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import substrings

    return substrings.digests(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import _labels, quality

    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    held_out = _labels.remainder(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), F.col("good").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import _labels, toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = _labels.remainder(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import rules

    return rules.judge(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import decontaminate

    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import html

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import warc

    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import _store, tokens

    path = _store.shared_dir(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, _vocabulary(), end_id=2)
    return tokens.digests(tokens.read_tokens(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_quality_rules": op6_quality_rules,
        "op7_decontamination": op7_decontamination,
        "op8_html_extraction": op8_html_extraction,
        "op9_warc": op9_warc,
        "op10_token_files": op10_token_files,
    }


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda t: t <> '')"

OP3 = f"""with d as (select doc_id, {_WORDS} w from documents),
x as (select doc_id, w, unnest(range(1, len(w) - 18)) p from d where len(w) >= 20),
y as (select doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) q from x),
z as (select doc_id, p from y qualify row_number() over (partition by q order by doc_id, p) > 1),
gone as (select distinct doc_id, unnest(range(p, p + 20)) p from z),
g as (select doc_id, list(p) g from gone group by doc_id),
k as (select doc_id, w, coalesce(g, []) g, list_filter(range(1, len(w) + 1), lambda i: not list_contains(coalesce(g, []), i)) k from d left join g using (doc_id))
select doc_id, cast(len(w) as bigint) n_words, cast(len(g) as bigint) n_removed, sha256(coalesce(array_to_string(list_transform(k, lambda i: w[i]), ' '), '')) kept_sha256 from k"""

OP6 = rf"""with d as (select doc_id, coalesce(text, '') text, {_WORDS} w from documents),
x as (select doc_id, unnest(range(1, len(w) - 3)) p, w from d where len(w) >= 5),
y as (select doc_id, p, count(*) over (partition by doc_id, array_to_string(w[p : p + 4], ' ')) n from x),
r as (select doc_id, count(distinct q) n_repeat_words from (select doc_id, unnest(range(p, p + 5)) q from y where n > 1) group by doc_id),
c as (select doc_id, cast(len(w) as bigint) n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) up, length(regexp_replace(text, '[^a-z]', '', 'g')) low from d),
t as (select *, cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) repeats from c left join r using (doc_id)),
b as (select *, n_words < 10 or 100 * repeats > 20 * n_words base_failed from t)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, repeats as n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * len(l) or word_chars < 2 * n_words or word_chars > 20 * n_words or up > low) as kept from b"""

#: For the one layout of the synthetic pages: what stands between the article's tags.
OP8 = r"""with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1) a from pages),
b as (select page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(a, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h1)>') b from a),
t as (select page_id, url, list_transform(b, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) t from b),
j as (select page_id, url, coalesce(array_to_string(list_filter(t, lambda x: x <> ''), chr(10)), '') as text from t)
select page_id, url, text, cast(length(text) as bigint) n_chars from j"""

OP9 = """with p as (select page_id, coalesce(html, '') h from pages), s as (select page_id, cast(strlen(h) as bigint) payload_bytes, sha1(h) x, max(page_id) over (partition by h) best from p)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(x, 1 + 5 * cast(k // 4 as int), 5) as bigint) >> cast(15 - 5 * (k % 4) as int)) & 31 as int) + 1, 1)), '') payload_digest,
case when page_id = best then 'response' else 'revisit' end record_type, case when page_id <> best then best end refers_to from s"""


def oracle_sql() -> dict[str, str]:
    from folio.llm import decontaminate

    return {
        "op3_substring_dedup": OP3,
        "op6_quality_rules": OP6,
        "op7_decontamination": decontaminate.oracle(),
        "op8_html_extraction": OP8,
        "op9_warc": OP9,
    }
