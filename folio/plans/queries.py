"""Registered queries of the document operators: each takes (spark, sf_dir); SQL beside it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import values as V
from folio.operators import geometry, graph, pages, structure
from folio.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- text -----------------------------------------------------------------------------------------


@query("""with r as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[0-9](?:[ -]?[0-9])*')) m from documents),
g as (select *, regexp_split_to_array(m, '[ -]') a from r),
c as (select *, list_filter(range(1, len(a) + 1), lambda i: length(array_to_string(a[i:], '')) between 16 and 19) ok from g)
select lang, count(*) n, count(distinct doc_id) docs from c where len(ok) > 0 group by lang""")
def pii_bankcard_by_lang(spark, d):
    found = _t(spark, d, "documents").select("doc_id", "lang", F.explode(T.personal_numbers(T.fold(F.col("text")), "bank-card")).alias("number"))
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""with r as (select doc_id, text, regexp_extract_all(text, '[0-9](?:[ -]?[0-9])*') m, regexp_split_to_array(text, '[0-9](?:[ -]?[0-9])*') s from documents),
g as (select *, list_transform(m, lambda x: regexp_split_to_array(x, '[ -]')) gs from r),
k as (select *, list_transform(gs, lambda a: list_filter(range(1, len(a) + 1), lambda i: length(array_to_string(a[i:], '')) between 16 and 19)[1]) ks from g),
n as (select doc_id, text, s, list_transform(range(1, len(m) + 1), lambda i: case when ks[i] is null then m[i] else substr(m[i], 1, cast(length(array_to_string(gs[i][1 : ks[i] - 1], '')) + ks[i] - 1 as int)) || '█' end) x from k)
select doc_id, array_to_string(list_transform(range(1, len(s) + 1), lambda i: s[i] || coalesce(x[i], '')), '') as text from n where len(list_filter(x, lambda v: ends_with(v, '█'))) > 0""")
def pii_redacted_text(spark, d):
    masked = T.mask_numbers(F.col("text"), "bank-card")
    return _t(spark, d, "documents").where(F.col("text") != masked).select("doc_id", masked.alias("text"))


_NUMBERS = """select c_custkey, '1' || (3 + c_custkey % 7) || lpad(cast(c_custkey * 7919 % 1000000000 as {s}), 9, '0') phone,
  (1 + c_custkey % 9) || lpad(cast(c_custkey * 104729 % 10000000000000000 as {s}), 16, '0') || case when c_custkey % 11 = 10 and c_custkey % 5 = 0 then 'X' else cast(c_custkey % 10 as {s}) end id from {t}"""


@query(f"""with n as ({_NUMBERS.format(s='varchar', t='customer')})
select c_custkey, case when c_custkey % 4 in (1, 2) then '' else phone end phones, case when c_custkey % 5 in (1, 2) then '' else lower(id) end ids from n""")
def pii_presets(spark, d):
    _t(spark, d, "customer").createOrReplaceTempView("__customers")
    n = spark.sql(_NUMBERS.format(s="string", t="__customers"))
    glued = lambda digit, mod, k: F.when(F.col("c_custkey") % mod == k, digit).otherwise("")
    text = F.concat(F.lit("Tel "), glued("7", 4, 1), "phone", glued("7", 4, 2), F.lit("; Id "), glued("5", 5, 1), "id", glued("5", 5, 2), F.lit("."))
    found = lambda preset: F.array_join(T.personal_numbers(T.fold(text), preset), "|")
    return n.select("c_custkey", found("phone").alias("phones"), found("id-card").alias("ids"))


@query(r"""with f as (select doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) t from documents)
select doc_id, cast((length(t) - length(replace(t, 'of the', ''))) / 6 as bigint) hits from f where contains(t, 'of the')""")
def fold_search_hits(spark, d):
    hits = T.count_hits(T.fold(F.col("text")), T.fold_query(F.lit("  Of\nTHE ")))
    return _t(spark, d, "documents").select("doc_id", hits.alias("hits")).where("hits > 0")


@query(r"""with f as (select conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) t, turn + 1 pg, max(turn) over (partition by conv_id) + 1 n from conversations where turn is not null),
p as (select *, string_split(t, 'the') a from f),
h as (select conv_id, pg, n, unnest(range(1, len(a))) k, a from p),
s as (select conv_id, pg, k hit, cast(length(array_to_string(a[1:k], 'the')) as bigint) start_char, (((pg - 2) % n) + n) % n shift from h)
select conv_id, pg, cast(hit as int) hit, start_char, cast(row_number() over (partition by conv_id order by shift, hit) as int) as rank from s""")
def search_wraparound_topn(spark, d):
    c = _t(spark, d, "conversations").where(F.col("turn").isNotNull()).withColumn("pg", F.col("turn") + 1)
    return structure.search(c, "conv_id", "pg", "text", "THE", start=2)


@query("select doc_id, md5(replace(text, 'the', 'THE')) digest, length(replace(text, 'the', '####')) width from documents")
def exact_replace(spark, d):
    swap = lambda to: F.replace(F.col("text"), F.lit("the"), F.lit(to))
    return _t(spark, d, "documents").select("doc_id", F.md5(swap("THE")).alias("digest"), F.char_length(swap("####")).cast("long").alias("width"))


@query("""with l as (select doc_id, string_split(text, chr(10)) a from documents), e as (select doc_id, unnest(range(1, len(a) + 1)) k, a from l)
select doc_id, cast(k as int) line_no, md5(a[k]) digest from e""")
def line_explode(spark, d):
    return structure.lines(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "line_no", F.md5("line").alias("digest"))


_LINES = """select p_partkey, p_partkey % 12 v, cast(p_partkey % 1000 as {s}) n, cast(p_partkey % 1000 as int) k, repeat(' ', cast(1 + p_partkey % 3 as int)) sp, p_name name from {t}"""


@query(f"""with l as ({_LINES.format(s='varchar', t='part')})
select p_partkey, case when v in (0, 1, 2) then 'bullet' when v in (3, 10, 11) then null else 'number' end kind,
case v when 0 then '▪' when 1 then '✓' when 2 then '•' when 4 then 'dot' when 5 then 'paren' when 6 then 'round' when 7 then 'dot-wide' when 8 then 'paren-wide' when 9 then 'round-wide' end mark,
case when v between 4 and 9 then k end as number, cast(case when v in (0, 2) then 1 + length(sp) when v = 1 then 1 when v in (4, 5, 7, 8) then length(n) + 1 + length(sp) when v in (6, 9) then length(n) + 2 + length(sp) end as int) as length from l""")
def list_marks(spark, d):
    _t(spark, d, "part").createOrReplaceTempView("__parts")
    line = spark.sql(_LINES.format(s="string", t="__parts"))
    form = ["concat('▪', sp, name)", "concat('✓', name)", "concat('–', sp, name)", "concat('–', name)", "concat(n, '.', sp, name)", "concat(n, ')', sp, name)", "concat('(', n, ')', sp, name)", "concat(n, '．', sp, name)"]
    form += ["concat(n, '）', sp, name)", "concat('（', n, '）', sp, name)", "concat(n, '.', name)", "concat(cast(k + 1000 as string), '.', sp, name)"]
    text = F.expr("case v " + " ".join(f"when {k} then {f}" for k, f in enumerate(form)) + " end")
    return line.select("p_partkey", T.list_mark(text).alias("m")).select("p_partkey", "m.kind", "m.mark", "m.number", "m.length")


@query("""with o as (select o_orderkey, o_orderkey % 8 v, length(cast(o_orderkey as varchar)) n, length(cast(o_orderkey + 9 as varchar)) m, 1 + o_orderkey // 8 % 8 x from orders)
select o_orderkey, case v when 1 then n + m <= 6 when 3 then false when 5 then x <= 6 when 6 then false when 7 then false else n <= 6 end is_number from o""")
def page_number_test(spark, d):
    forms = ["concat('Page ', k)", "concat(k, ' of ', cast(o_orderkey + 9 as string))", "concat('- ', k, ' -')", "concat('Order ', k)", "concat('第', k, '页')", "repeat('x', cast(1 + floor(o_orderkey / 8) % 8 as int))", "concat(k, '/iv')", "concat(o_orderstatus, ' ', k)"]
    text = F.expr("case o_orderkey % 8 " + " ".join(f"when {k} then {f}" for k, f in enumerate(forms)) + " end")
    return _t(spark, d, "orders").withColumn("k", F.col("o_orderkey").cast("string")).select("o_orderkey", T.is_page_number(text).alias("is_number"))


@query("""with w as (select p_partkey, string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[2] b from part)
select p_partkey, case p_partkey % 5 when 0 then a || b when 1 then a || ' ' || b when 2 then upper(a) || '- ' || b when 3 then a || '- ' || upper(b) else a || ' ' || b || '。' || a end joined from w""")
def dehyphenate(spark, d):
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    hyphen = lambda v: F.concat(v, F.lit("-"))
    forms = [F.array(hyphen(a), b), F.array(a, b), F.array(hyphen(F.upper(a)), b), F.array(hyphen(a), F.upper(b)), F.array(F.lit(""), a, F.lit(""), F.concat(b, F.lit("。")), a)]
    lines = forms[4]
    for k in range(4):
        lines = F.when(F.col("p_partkey") % 5 == k, forms[k]).otherwise(lines)
    return _t(spark, d, "part").select("p_partkey", T.join_lines(lines).alias("joined"))


@query("""select page_id, url as safe from pages where regexp_matches(url, '^(?i:https?)://[^/?#@]') and not regexp_matches(url, '[^!-~]|["<>\\\\^`{|}]') and not regexp_matches(url, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)')""")
def safe_links(spark, d):
    return _t(spark, d, "pages").select("page_id", T.safe_uri(F.col("url")).alias("safe")).where("safe is not null")


@query("select doc_id, md5(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) digest from documents")
def xml_escaped(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.xml_escape(F.col("text"))).alias("digest"))


@query("""select p_partkey, case when p_partkey < 26 then chr(cast(65 + p_partkey as int))
when p_partkey < 702 then chr(cast(65 + (p_partkey - 26) // 26 as int)) || chr(cast(65 + (p_partkey - 26) % 26 as int))
when p_partkey < 18278 then chr(cast(65 + (p_partkey - 702) // 676 as int)) || chr(cast(65 + (p_partkey - 702) // 26 % 26 as int)) || chr(cast(65 + (p_partkey - 702) % 26 as int))
else chr(cast(65 + (p_partkey - 18278) // 17576 as int)) || chr(cast(65 + (p_partkey - 18278) // 676 % 26 as int)) || chr(cast(65 + (p_partkey - 18278) // 26 % 26 as int)) || chr(cast(65 + (p_partkey - 18278) % 26 as int)) end as name from part""")
def column_names(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.column_name(F.col("p_partkey")).alias("name"))


@query("select doc_id, cast(length(text) as bigint) width from documents")
def display_widths(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.display_width(F.col("text")).alias("width"))


@query("""select p_partkey, case p_partkey % 3 when 0 then p_name || '.v' || p_partkey when 1 then '.' || p_type else p_name end stem, p_type family,
p_partkey % 50 || '/50 2024-05-01 {page}-' || p_name as header from part""")
def name_functions(spark, d):
    key = F.col("p_partkey")
    file = F.when(key % 3 == 0, F.concat(F.lit("C:\\dir.d\\"), "p_name", F.lit(".v"), key, F.lit(".pdf"))).when(key % 3 == 1, F.concat(F.lit("x.y/."), "p_type")).otherwise(F.concat("p_name", F.lit(".tar")))
    header = T.expand_template(F.lit("{page}/{pages} {date} {file}"), key % 50, F.lit(50), F.lit("2024-05-01"), F.concat(F.lit("{page}-"), "p_name"))
    return _t(spark, d, "part").select("p_partkey", T.file_stem(file).alias("stem"), T.font_family(F.concat(F.lit("QWERTY+"), "p_type")).alias("family"), header.alias("header"))


# --- typed values ---------------------------------------------------------------------------------

@query("""with o as (select o_orderkey, o_orderkey % 12 v, round(o_totalprice, 2) p, cast(o_orderdate as date) d, o_orderkey % 1000 + 1 n, case when o_totalprice < 999.995 then '0.00' else '#,##0.00' end f,
  cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as double) s, case when month(o_orderdate) >= 10 or day(o_orderdate) >= 10 then 'mm' else 'm' end mm from orders)
select o_orderkey, case when v in (6, 10, 11) then 'text' when v = 4 then 'weak' else 'number' end kind,
case v when 0 then -p when 1 then p when 2 then (o_orderkey % 100) / 100.0 when 3 then -p when 4 then -n when 5 then -n when 7 then s when 8 then s when 9 then s + (o_orderkey % 24 * 3600 + o_orderkey % 60 * 60) / 86400.0 end num,
case v when 0 then '0.00_);(0.00)' when 1 then '"¥"' || f when 2 then '0%' when 3 then '0.00' when 4 then '0_);(0)' when 5 then '"$"0' when 7 then 'yyyy/mm/dd' when 8 then 'yyyy"年"' || mm || '"月"' || replace(mm, 'm', 'd') || '"日"' when 9 then 'yyyy-mm-dd hh:mm' end fmt from o""")
def typed_cells(spark, d):
    day = F.col("o_orderdate")
    n, two = (F.col("o_orderkey") % 1000 + 1).cast("string"), lambda m: F.lpad((F.col("o_orderkey") % m).cast("string"), 2, "0")
    price, commas = F.format_string("%.2f", "o_totalprice"), F.format_string("%,.2f", "o_totalprice")
    forms = [
        F.concat(F.lit("("), price, F.lit(")")), F.concat(F.lit("¥ "), commas), F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%")), F.concat(price, F.lit("-")), F.concat(F.lit("("), n, F.lit(")")), F.concat(F.lit(" -$"), n),
        F.concat(F.lit("0"), n), F.date_format(day, "yyyy/MM/dd"), F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("日 ")), F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.concat_ws(":", two(24), two(60))),
        F.concat_ws("/", n, n), F.format_string("%d", F.col("o_orderkey") + 10_000_000_000),
    ]
    text = forms[-1]
    for k in range(11):
        text = F.when(F.col("o_orderkey") % 12 == k, forms[k]).otherwise(text)
    return _t(spark, d, "orders").select("o_orderkey", V.detect(text).alias("v")).select("o_orderkey", "v.kind", "v.num", "v.fmt")


@query("select o_orderkey, 'number' kind, round(o_totalprice, 2) num, case when o_totalprice < 999.995 then '0.00' else '#,##0.00' end fmt from orders")
def typed_prices(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", V.detect(F.format_string("%,.2f", "o_totalprice")).alias("v")).select("o_orderkey", "v.kind", "v.num", "v.fmt")


@query("select o_orderkey, cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as double) serial, cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as double) typed from orders")
def date_serials(spark, d):
    o = _t(spark, d, "orders")
    typed = V.detect(F.date_format("o_orderdate", "yyyy-MM-dd"))["num"]
    return o.select("o_orderkey", V.date_serial(F.col("o_orderdate")).alias("serial"), typed.alias("typed"))


@query("""with o as (select o_orderkey, case when o_orderkey % 5 = 4 then epoch(date_trunc('year', o_orderdate)) else epoch(o_orderdate) + o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 end s,
  case when o_orderkey % 5 = 4 then null when o_orderkey % 3 = 0 then 0 else (o_orderkey % 13 * 60 + o_orderkey % 4 * 15) * case when o_orderkey % 3 = 2 then -1 else 1 end end z from orders)
select o_orderkey, cast(s - coalesce(z, 0) * 60 as bigint) at_second, cast(z as int) as minutes from o""")
def file_dates(spark, d):
    key, two = F.col("o_orderkey"), lambda v: F.lpad(v.cast("string"), 2, "0")
    zone = F.when(key % 3 == 0, "Z").otherwise(F.concat(F.when(key % 3 == 1, "+").otherwise("-"), two(key % 13), F.lit("'"), two(key % 4 * 15), F.lit("'")))
    whole = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), two(key % 24), two(key % 60), F.lit("00"), zone)
    text = F.when(key % 5 == 4, F.concat(F.lit("D:"), F.year("o_orderdate"))).otherwise(whole)
    return _t(spark, d, "orders").select("o_orderkey", V.pdf_date(text).alias("v")).select("o_orderkey", F.unix_timestamp("v.at").alias("at_second"), F.col("v.offset").alias("minutes"))


# --- document structure ---------------------------------------------------------------------------


@query("""with l as (select c_nationkey, c_custkey, 1 band, 'Statement of account #' k from customer union all select c_nationkey, c_custkey, 2, c_mktsegment from customer),
t as (select c_nationkey, count(distinct c_custkey) total from customer group by 1)
select l.c_nationkey, band, k as key, count(distinct c_custkey) pages from l join t on l.c_nationkey = t.c_nationkey group by 1, 2, 3, total having count(distinct c_custkey) >= 2 and count(distinct c_custkey) * 2 >= total""")
def boilerplate_bands(spark, d):
    c = _t(spark, d, "customer")
    line = F.concat(F.lit("Statement  of account "), F.col("c_custkey") % 10)
    both = F.explode(F.array(F.struct(F.lit(1).alias("band"), line.alias("line")), F.struct(F.lit(2).alias("band"), F.col("c_mktsegment").alias("line"))))
    return structure.running_bands(c.select("c_nationkey", "c_custkey", both.alias("x")).select("c_nationkey", "c_custkey", "x.*"), "c_nationkey", "c_custkey", "band", "line")


@query("""with s as (select l_returnflag, l_quantity, sum(l_linenumber) w from lineitem group by 1, 2)
select l_returnflag, arg_max(l_quantity, (w, l_quantity)) as mode, cast(max(w) as bigint) total from s group by 1""")
def body_mode_weighted(spark, d):
    return structure.weighted_mode(_t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_linenumber"))


@query("select l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[count(*) // 2 + 1] as median from lineitem group by 1, 2")
def upper_median(spark, d):
    return structure.upper_median(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("select o_orderpriority, list_sort(list(o_totalprice))[count(*) // 10 + 1] as value from orders group by 1")
def rank_quantiles(spark, d):
    return structure.value_at_rank(_t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 10)


_PARAS = "select p_brand, p_partkey, 8 + p_size % 8 / 2.0 size, p_size % 3 = 0 heavy, 1 + cast(p_partkey % 9 = 0 as int) lines, length(p_name) + p_size chars, p_name as text from part"


@query(f"""with p as ({_PARAS}), m as (select p_brand, size, sum(chars) w from p group by 1, 2), b as (select p_brand, arg_max(size, (w, size)) body from m group by 1),
c as (select p_brand, size, heavy, count(*) n, count(*) filter (lines > 1) multi, sum(chars) chs from p group by 1, 2, 3),
t as (select p_brand, sum(n) paras, max(chs) most from c group by 1),
x as (select p.*, body, paras, (multi >= 3 and multi * 4 >= n) or (paras >= 20 and chs * 4 >= most) textlike, regexp_matches(text, '[.;,:]\\s*$') sentence from p join b using (p_brand) join c using (p_brand, size, heavy) join t using (p_brand)),
y as (select *, not textlike and length(replace(text, ' ', '')) >= 3 and ((size >= body * 1.08 and size >= body + 1 and lines <= 3 and chars <= 120 and (lines = 1 or size >= body * 1.15)) or (heavy and size >= body * 0.95 and lines = 1 and chars <= 80 and not sentence)) lax,
  not textlike and length(replace(text, ' ', '')) >= 3 and size >= body * 1.15 and lines <= 3 and chars <= 120 strict from x),
z as (select *, count(*) filter (lax) over (partition by p_brand) cands from y),
w as (select *, case when paras >= 40 and cands * 6 > paras then strict else lax end is_head from z),
l as (select p_brand, size, heavy, least(dense_rank() over (partition by p_brand order by size desc, heavy desc), 4) lv from (select distinct p_brand, size, heavy from w where is_head))
select p_partkey, cast(case when is_head then lv else 0 end as int) as level from w left join l using (p_brand, size, heavy)""")
def heading_levels(spark, d):
    p = _t(spark, d, "part")
    p = p.select(
        "p_brand", "p_partkey", (F.lit(8.0) + (F.col("p_size") % 8) / 2.0).alias("size"), (F.col("p_size") % 3 == 0).alias("heavy"), (F.lit(1) + (F.col("p_partkey") % 9 == 0).cast("int")).alias("lines"),
        (F.char_length("p_name") + F.col("p_size")).alias("chars"), F.col("p_name").alias("text"), F.lit(0).alias("band"), F.lit(False).alias("marked"),
    )
    body = structure.weighted_mode(p, ["p_brand"], "size", F.col("chars")).withColumnRenamed("mode", "body")
    return structure.headings(p, "p_brand", body).select("p_partkey", "level")


_ITEMS = "select p_brand, p_partkey, (row_number() over (partition by p_brand order by p_partkey) + case when p_partkey % 5 = 0 then 50 else 0 end) % 900 n, p_name from {t}"


@query(f"""with i as ({_ITEMS.format(t='part')}), m as (select *, case when p_partkey % 7 > 1 then n end k from i),
w as (select *, lag(k) over (partition by p_brand order by p_partkey) a, lead(k) over (partition by p_brand order by p_partkey) b from m)
select p_partkey, case when p_partkey % 7 = 0 then 'bullet' when a = k - 1 or b = k + 1 then 'number' end kind, cast(case when a = k - 1 or b = k + 1 then k end as int) as number from w""")
def confirmed_lists(spark, d):
    _t(spark, d, "part").createOrReplaceTempView("__parts")
    text = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("• "), "p_name")).when(F.col("p_partkey") % 7 == 1, F.col("p_name")).otherwise(F.concat(F.col("n").cast("string"), F.lit(". "), "p_name"))
    rows = structure.confirmed_lists(spark.sql(_ITEMS.format(t="__parts")).withColumn("t", text), "p_brand", "p_partkey", "t")
    return rows.select("p_partkey", "mark.kind", "mark.number")


@query("""with x as (select r_regionkey, 0 depth, r_name title, -1 k from region union all select n_regionkey, 1, n_name, n_nationkey from nation),
o as (select row_number() over (order by r_regionkey, depth, k) seq, * from x)
select 0 as file, string_agg(repeat(chr(9), depth) || title || chr(9) || seq, chr(10) order by seq) || chr(10) as export from o""")
def bookmark_export(spark, d):
    return structure.bookmark_export(_outline(spark, d).withColumn("page", F.col("seq")), "file")


def _outline(spark, d) -> DataFrame:
    r = _t(spark, d, "region").select("r_regionkey", F.lit(0).alias("depth"), F.col("r_name").alias("title"), F.lit(-1).alias("k"))
    n = _t(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.lit(1).alias("depth"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("k"))
    w = Window.orderBy("r_regionkey", "depth", "k")
    return r.union(n).withColumn("seq", F.row_number().over(w)).withColumn("file", F.lit(0))


@query("""with x as (select r_regionkey, 0 depth, -1 k from region union all select n_regionkey, 1, n_nationkey from nation),
o as (select row_number() over (order by r_regionkey, depth, k) seq, * from x), n as (select count(*) c from o)
select a.seq, cast(coalesce(min(b.seq) - 1, any_value(c)) as bigint) branch_end, cast(coalesce(min(b.seq) - 1, any_value(c)) - a.seq as bigint) descendants
from o a cross join n left join o b on b.seq > a.seq and b.depth <= a.depth group by a.seq""")
def outline_counts(spark, d):
    return graph.subtree_counts(_outline(spark, d), "file", "seq", "depth").select("seq", "branch_end", "descendants")


@query("""with f as (select c_mktsegment, min(c_custkey) first, count(*) uses from customer group by 1)
select c_mktsegment, uses, cast(row_number() over (order by first, c_mktsegment) - 1 as int) as index from f""")
def shared_strings(spark, d):
    return structure.shared_strings(_t(spark, d, "customer"), "c_custkey", "c_mktsegment")


@query("""with b as (select p_partkey, p_type || ' / ' || p_brand || ' ' || p_name t from part), n as (select p_partkey, substring(replace(t, '/', '_'), 1, 31) base from b),
k as (select *, row_number() over (partition by lower(base) order by p_partkey) k from n)
select p_partkey, case when k = 1 then base else substring(base, 1, cast(31 - length('(' || k || ')') as int)) || '(' || k || ')' end as sheet from k""")
def sheet_names(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" / "), "p_brand", F.lit(" "), "p_name").alias("t"))
    return structure.sheet_names(p, "p_partkey", "t").select("p_partkey", "sheet")


# --- page sets ------------------------------------------------------------------------------------

_PAGES = "select o_custkey % 64 as path, o_orderkey, row_number() over (partition by o_custkey % 64 order by o_orderkey) page_no, cast(o_orderkey % 4 * 90 as int) as rotate from orders"


def _pages(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select((F.col("o_custkey") % 64).alias("path"), "o_orderkey", F.row_number().over(Window.partitionBy(F.col("o_custkey") % 64).orderBy("o_orderkey")).alias("page_no"), (F.col("o_orderkey") % 4 * 90).cast("int").alias("rotate"))


@query(f"""with p as ({_PAGES}), c as (select path, max(page_no) n from p group by 1),
w as (select path, unnest([2, 3, 1, 1] || range(2, n + 1)) page_no, unnest(range(1, n + 4)) out_no from c)
select path, page_no, o_orderkey, cast(out_no as int) out_no from w join p using (path, page_no)""")
def page_ranges(spark, d):
    return pages.extract(_pages(spark, d), "2-3,1,1,2-").select("path", "page_no", "o_orderkey", "out_no")


@query(f"""with p as ({_PAGES})
select path, o_orderkey, cast(row_number() over (partition by path order by page_no) as int) out_no from p where page_no not in (1, 3)""")
def delete_pages(spark, d):
    return pages.delete(_pages(spark, d), "1,3").select("path", "o_orderkey", "out_no")


@query("""with x as (select 0 file_ord, n_nationkey page_no, n_name as name from nation union all select 1, r_regionkey, r_name from region)
select file_ord, page_no, name, row_number() over (order by file_ord, page_no) out_no from x""")
def merge_pages(spark, d):
    a = _t(spark, d, "nation").select(F.col("n_nationkey").alias("page_no"), F.col("n_name").alias("name"))
    b = _t(spark, d, "region").select(F.col("r_regionkey").alias("page_no"), F.col("r_name").alias("name"))
    return pages.merge([a, b]).select("file_ord", "page_no", "name", F.col("out_no").cast("long").alias("out_no"))


@query(f"select o_orderkey, cast((rotate - 90 + 360) % 360 as int) as rotate from ({_PAGES})")
def rotate_pages(spark, d):
    return pages.rotate(_pages(spark, d), -90).select("o_orderkey", "rotate")


@query(f"select path, o_orderkey, cast((page_no - 1) // 4 + 1 as int) chunk, cast((page_no - 1) % 4 + 1 as int) out_no from ({_PAGES})")
def split_chunks(spark, d):
    return pages.split_every(_pages(spark, d), 4).select("path", "o_orderkey", "chunk", "out_no")


@query("""select p_partkey, cast(case when p_size % 2 = 1 then 100 else least(200, 20 + p_size * 8) - p_size end as double) width, cast(case when p_size % 2 = 1 then least(200, 20 + p_size * 8) - p_size else 100 end as double) height from part""")
def shown_sizes(spark, d):
    p = _t(spark, d, "part")
    media, crop = F.array(F.lit(0.0), F.lit(0.0), F.lit(200.0), F.lit(100.0)), F.array(F.col("p_size").cast("double"), F.lit(-5.0), F.lit(20.0) + F.col("p_size") * 8, F.lit(300.0))
    return p.select("p_partkey", pages.shown_size(pages.visible_box(media, crop), F.col("p_size") % 2 * 90).alias("s")).select("p_partkey", "s.width", "s.height")


# --- graphs ---------------------------------------------------------------------------------------


@query("""with recursive e as (select 'r' || n_regionkey src, 'n' || n_nationkey dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders),
k(node) as (select 'r1' union select dst from e join k on src = node) select node from k""")
def reachable_objects(spark, d):
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    e = _t(spark, d, "nation").select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst"))
    e = e.union(_t(spark, d, "customer").select(tag("n", "c_nationkey"), tag("c", "c_custkey"))).union(_t(spark, d, "orders").select(tag("c", "o_custkey"), tag("o", "o_orderkey")))
    return graph.reachable(e, spark.createDataFrame([("r1",)], "node string"))


@query("""with recursive e as (select s_suppkey a, s_suppkey + s_nationkey b from supplier), s as (select a, b from e union select b, a from e),
k(node, root) as (select a, a from s union select s.b, k.root from k join s on s.a = k.node where k.root < s.b)
select node, min(root) as root from (select * from k union select b, b from s) group by node""")
def connected_components(spark, d):
    s = _t(spark, d, "supplier")
    return graph.components(s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + F.col("s_nationkey")).alias("b")))


@query("""select 'r' || r_regionkey node, r_regionkey * 10 box, cast(null as int) turn, 0 as level from region
union all select 'n' || n_nationkey, case when n_nationkey % 3 = 0 then n_nationkey else n_regionkey * 10 end, n_nationkey % 4, 1 from nation
union all select 's' || s_suppkey, case when n_nationkey % 3 = 0 then n_nationkey else n_regionkey * 10 end, n_nationkey % 4, 2 from supplier join nation on s_nationkey = n_nationkey""")
def inherit_attributes(spark, d):
    none = F.lit(None).cast("int")
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), (F.col("r_regionkey") * 10).alias("box"), none.alias("turn"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("long"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey")), F.col("n_nationkey") % 4)
    s = _t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_suppkey").cast("long"), none, none)
    return graph.inherit(r.union(n).union(s), ["box", "turn"]).select("node", "box", "turn", "level")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def newest_definition(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return graph.newest(e, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("select doc_id, min(doc_id) over (partition by text) as keeper from documents")
def duplicate_objects(spark, d):
    return graph.duplicate_objects(_t(spark, d, "documents"), "doc_id", "text")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as status from orders union all select -1, 'new'")
def overlay_objects(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changes = o.where("o_orderkey % 5 = 0").withColumn("status", F.lit("X")).union(spark.createDataFrame([(-1, "new")], "o_orderkey long, status string"))
    return graph.overlay(o, changes, ["o_orderkey"])


# --- geometry -------------------------------------------------------------------------------------


@query("""with p as (select l_orderkey, l_linenumber, l_quantity * 4 x, l_extendedprice / 100 y from lineitem), b as (select p_partkey, p_size * 4.0 l, p_size * 4.0 + 12 r, p_retailprice - 900.0 t, p_retailprice - 860.0 b from part)
select l_orderkey, l_linenumber, min(p_partkey) p_partkey from p join b on x >= l - 1.5 and x <= r + 1.5 and y >= t - 1.5 and y <= b + 1.5 group by l_orderkey, l_linenumber, x, y""")
def spatial_first_container(spark, d):
    p = _t(spark, d, "lineitem").select(F.lit(0).alias("page"), "l_orderkey", "l_linenumber", (F.col("l_quantity") * 4).alias("x"), (F.col("l_extendedprice") / 100).alias("y"))
    left, top = F.col("p_size") * 4.0, F.col("p_retailprice") - 900.0
    b = _t(spark, d, "part").select(F.lit(0).alias("page"), "p_partkey", left.alias("l"), (left + 12).alias("r"), top.alias("t"), (F.col("p_retailprice") - 860.0).alias("b"))
    return geometry.first_container(p, b, ["page"], "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey")


@query("""with recursive v as (select cast(l_suppkey % 7 as bigint) g, l_quantity * 3 + l_discount * 20 x from lineitem),
k(g, x) as (select g, min(x) from v group by g union all select g, x from (select k.g, min(v.x) x from k join v on v.g = k.g and v.x - k.x > 2.0 group by k.g, k.x))
select g, cast(count(*) as int) n, round(sum(x), 4) total from (select distinct g, x from k) group by g""")
def edge_cluster(spark, d):
    v = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("g"), (F.col("l_quantity") * 3 + F.col("l_discount") * 20).alias("x"))
    kept = geometry.cluster_edges(F.array_distinct(F.collect_list("x")))
    rows = v.groupBy("g").agg(kept.alias("e"))
    return rows.select("g", F.size("e").alias("n"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""with recursive o as (select l_suppkey, l_quantity a, l_extendedprice / 1000 s, l_extendedprice / 1000 + l_linenumber e, row_number() over (partition by l_suppkey order by l_quantity, l_extendedprice / 1000, l_extendedprice / 1000 + l_linenumber) rn from lineitem),
r(l_suppkey, rn, a, s, e, run) as (select l_suppkey, rn, a, s, e, 1 from o where rn = 1 union all
  select o.l_suppkey, o.rn, case when j then r.a else o.a end, case when j then r.s else o.s end, case when j then greatest(r.e, o.e) else o.e end, case when j then run else run + 1 end
  from r join o on o.l_suppkey = r.l_suppkey and o.rn = r.rn + 1, lateral (select abs(o.a - r.a) <= 2.0 and o.s <= r.e + 2.0 j))
select l_suppkey, min(a) as at, min(s) as start, max(e) as stop from r group by l_suppkey, run""")
def segment_merge(spark, d):
    s = F.struct((F.col("l_quantity")).alias("at"), (F.col("l_extendedprice") / 1000).alias("start"), (F.col("l_extendedprice") / 1000 + F.col("l_linenumber")).alias("stop"))
    rows = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(geometry.merge_segments(F.collect_list(s)).alias("m"))
    return rows.select("l_suppkey", F.explode("m").alias("s")).select("l_suppkey", "s.*")


@query("""with e as (select l_returnflag, cast(l_shipdate as date) pos, 1 s from lineitem union all select l_returnflag, cast(l_shipdate as date) + cast(l_quantity as int), -1 from lineitem),
g as (select l_returnflag, pos, sum(s) s from e group by 1, 2) select l_returnflag, pos, cast(sum(s) over (partition by l_returnflag order by pos) as bigint) covered from g""")
def coverage_sweep(spark, d):
    day = F.to_date("l_shipdate")
    rows = _t(spark, d, "lineitem").select("l_returnflag", day.alias("a"), F.date_add(day, F.col("l_quantity").cast("int")).alias("b"))
    return geometry.coverage(rows, ["l_returnflag"], "a", "b")


@query("""with x as (select l_suppkey, cast(floor(l_extendedprice) as int) a, cast(floor(l_extendedprice) + floor(l_quantity * 20) as int) b from lineitem),
m as (select *, max(b) over (partition by l_suppkey order by a, b rows between unbounded preceding and 1 preceding) reach from x),
g as (select *, sum(case when reach is null or a >= reach then 1 else 0 end) over (partition by l_suppkey order by a, b rows unbounded preceding) k from m)
select l_suppkey, min(a) a, max(b) b from g group by l_suppkey, k""")
def merged_ranges(spark, d):
    a = F.floor("l_extendedprice").cast("int")
    rows = _t(spark, d, "lineitem").select("l_suppkey", a.alias("a"), (a + F.floor(F.col("l_quantity") * 20).cast("int")).alias("b"))
    return geometry.merged_spans(rows, ["l_suppkey"], "a", "b")


_SUPPLIED = "select s_nationkey page, cast(row_number() over (partition by s_nationkey order by s_suppkey) as int) item from {t}"


@query(f"""with s as ({_SUPPLIED.format(t='supplier')}), c as (select page, count(*) n from s group by page)
select page, item, cast(case when item % 2 = 1 then 1 + item // 2 else (n + 1) // 2 + item // 2 end as int) place, cast(case when n < 2 then 0 when item % 2 = 1 then 1 else 2 end as int) as "group", n >= 2 columnar from s join c using (page)
union all select n_nationkey, 0, 0, 0, false from nation""")
def reading_order_two_columns(spark, d):
    """A page for each nation: a line across the top, and its suppliers in two columns below, drawn row by row."""
    _t(spark, d, "supplier").createOrReplaceTempView("__suppliers")
    right, row = F.col("item") % 2 == 0, F.floor((F.col("item") - 1) / 2)
    left, top = F.when(right, 110.0).otherwise(0.0), row * 15.0 + 30.0
    s = spark.sql(_SUPPLIED.format(t="__suppliers")).select("page", "item", left.alias("l"), top.alias("t"), (left + 90.0).alias("r"), (top + 10.0).alias("b"))
    head = _t(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.lit(0).alias("item"), F.lit(0.0).alias("l"), F.lit(0.0).alias("t"), F.lit(200.0).alias("r"), F.lit(10.0).alias("b"))
    return geometry.reading_order(s.union(head), ["page"], "item")


_STATEMENT = "with p as (select o_orderkey // 160 as page_no, *, row_number() over (partition by o_orderkey // 160 order by o_orderkey) - 1 rn, count(*) over (partition by o_orderkey // 160) n from orders)"


def _statement(spark, d) -> DataFrame:
    """Orders as pages of a statement: a row each, four columns of text at fixed places."""
    o = _t(spark, d, "orders").withColumn("page_no", F.floor(F.col("o_orderkey") / 160))
    o = o.withColumn("rn", F.row_number().over(Window.partitionBy("page_no").orderBy("o_orderkey")) - 1)
    text = F.array(F.col("o_orderkey").cast("string"), F.format_string("%,.2f", "o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus")
    rows = o.select("page_no", F.col("rn").alias("line"), F.posexplode(text).alias("seq", "text"))
    left, top = F.col("seq") * 120.0 + 50, F.col("line") * 14.0 + 100
    return rows.select("page_no", "line", "seq", left.alias("l"), top.alias("t"), (left + F.char_length("text") * 6.0).alias("r"), (top + 10).alias("b"), F.lit(10.0).alias("size"), "text")


@query(f"""{_STATEMENT} select page_no, cast(rn as int) r, unnest([0, 1, 2, 3]) c, unnest([cast(o_orderkey as double), round(o_totalprice, 2), cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as double), null]) num,
unnest(['number', 'number', 'number', 'text']) kind from p where n >= 3""")
def statement_roundtrip(spark, d):
    frags = geometry.fragments(_statement(spark, d), ["page_no"])
    found = geometry.cells(frags, geometry.loose_tables(frags, ["page_no"]), ["page_no"])
    return found.select("page_no", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), V.detect(F.col("text")).alias("v")).select("page_no", "r", "c", "v.num", "v.kind")


@query("""with t as (select o_orderkey // 160 page_no, cast(count(*) as int) n, max(length(cast(o_orderkey as varchar))) a, max(length(format('{:,.2f}', o_totalprice))) b from orders group by 1 having count(*) >= 3),
c as (select *, lag(page_no) over w = page_no - 1 and abs(a - lag(a) over w) <= 2 and abs(b - lag(b) over w) <= 2 goes_on from t window w as (order by page_no))
select page_no, 0 grid_no, n as rows, 4 cols, cast(sum(case when goes_on then 0 else 1 end) over (order by page_no) as bigint) table_no from c""")
def multi_page_table(spark, d):
    frags = geometry.fragments(_statement(spark, d).withColumn("file", F.lit(0)), ["file", "page_no"])
    return geometry.chained_tables(geometry.loose_tables(frags, ["file", "page_no"]), "file", "page_no").select("page_no", "grid_no", "rows", "cols", "table_no")


# --- files ----------------------------------------------------------------------------------------


def _documents_as_files(spark, d) -> DataFrame:
    lines = structure.lines(_t(spark, d, "documents"), "doc_id", "text")
    kept = lines.where(F.trim("line") != "").withColumn("path", F.col("doc_id").cast("string"))
    return files.text_documents(kept, "path")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k from documents),
s as (select doc_id, k, trim(line, ' ') line from l where trim(line, ' ') <> '')
select doc_id, cast(row_number() over (partition by doc_id order by k) as int) line_no, md5(line) digest from s""")
def pdf_text_roundtrip(spark, d):
    rows = files.read(_documents_as_files(spark, d), "lines")
    no = F.row_number().over(Window.partitionBy("path").orderBy("page_no", "line_no"))
    return rows.select(F.col("path").cast("long").alias("doc_id"), no.alias("line_no"), F.md5("line").alias("digest"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents)
select doc_id, cast(ceil(count(*) / 50.0) as int) pages, false encrypted, false repaired, 595.0::double width, 842.0::double height from l where trim(line, ' ') <> '' group by doc_id""")
def pdf_info(spark, d):
    rows = files.read(_documents_as_files(spark, d), "info")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "pages", "encrypted", "repaired", "width", "height")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents)
select doc_id, cast(count(*) as int) lines, true repaired from l where trim(line, ' ') <> '' group by doc_id""")
def pdf_repair(spark, d):
    cut = _documents_as_files(spark, d).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 60)"))
    rows = files.read(cut, "lines").groupBy("path").agg(F.count("*").cast("int").alias("lines"))
    info = files.read(cut, "info").select("path", "repaired")
    return rows.join(info, "path").select(F.col("path").cast("long").alias("doc_id"), "lines", "repaired")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k from documents),
s as (select doc_id, trim(line, ' ') line, row_number() over (partition by doc_id order by k) - 1 k from l where trim(line, ' ') <> ''),
p as (select doc_id, k // 50 pg, string_agg(line || chr(10), '' order by k) t from s group by 1, 2)
select doc_id, md5(string_agg(t, chr(12) order by pg)) digest from p group by doc_id""")
def text_export(spark, d):
    out = files.text_export(files.read(_documents_as_files(spark, d), "pages"))
    return out.select(F.col("path").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


def _drawn_grid(spark, d) -> DataFrame:
    """A grid for each nation: as many rows as its key mod 4 plus 2, three columns, the first two cells of the top row one."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("page"), (F.col("n_nationkey") % 4 + 2).alias("n"))
    flat = n.select("page", F.explode(F.sequence(F.lit(0), "n")).alias("k")).select("page", F.lit(50.0).alias("l"), (F.col("k") * 20 + 100.0).alias("t"), F.lit(350.0).alias("r"), (F.col("k") * 20 + 100.0).alias("b"))
    tall = n.select("page", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    top = F.when(F.col("k") == 1, 120.0).otherwise(100.0)
    return flat.union(tall.select("page", F.col("k") * 100 + 50.0, top, F.col("k") * 100 + 50.0, F.col("n") * 20 + 100.0))


@query("""select n_nationkey page, 0 grid_no, cast(n_nationkey % 4 + 2 as int) as rows, 3 cols, unnest(range(0, (n_nationkey % 4 + 2) * 3)) cell,
cast(case when unnest(range(0, (n_nationkey % 4 + 2) * 3)) = 1 then 0 else unnest(range(0, (n_nationkey % 4 + 2) * 3)) end as int) as owner from nation""")
def ruled_tables(spark, d):
    from folio.operators import ruled

    found = ruled.ruled_tables(_drawn_grid(spark, d), ["page"], 595.0, 842.0)
    return found.select("page", "grid_no", "rows", "cols", F.posexplode("owner").alias("cell", "owner")).withColumn("cell", F.col("cell").cast("long"))


@query(r"""select doc_id, md5(regexp_replace(text, 'and', '███', 'gi')) digest, cast(len(regexp_extract_all(lower(text), 'and')) as int) redacted from documents""")
def redacted_words(spark, d):
    from folio.operators import redact

    docs = _t(spark, d, "documents").select("doc_id", "text")
    return redact.redact(docs, "text", ["AND"]).select("doc_id", F.md5("text").alias("digest"), "redacted")


@query("""with l as (select doc_id, lang, unnest(string_split(text, chr(10))) line from documents), k as (select doc_id, lang, ceil(count(*) / 50.0) p from l where trim(line, ' ') <> '' group by 1, 2)
select lang, cast(sum(p) as int) pages from k group by lang""")
def merged_files(spark, d):
    from folio.sources import rewrite

    f = _documents_as_files(spark, d).withColumn("doc_id", F.col("path").cast("long")).join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rewrite.merge(f, "lang", F.col("doc_id"), "info").select("lang", "pages")


from folio.plans import layout  # noqa: E402, F401  more queries
