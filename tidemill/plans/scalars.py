"""Queries on scalar functions: text, URLs, identifiers, dates, matching, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import classify, dates, ids, match, text, url
from tidemill.plans.registry import query, read

_TAG = r"""<[^<>"'']*(?:"[^"]*"[^<>"'']*|''[^'']*''[^<>"'']*)*>"""


def _decoded(x: str) -> str:
    """One pass over entities in DuckDB: pieces, each replaced by itself."""
    named = " ".join(f"when '{name}' then '{char.replace(chr(39), chr(39) * 2)}'" for name, char in text.NAMED_ENTITIES)
    code = "case when starts_with(e, '&#x') then try_cast('0x' || regexp_extract(e, '^&#x([0-9a-fA-F]{1,8});$', 1) as bigint) when starts_with(e, '&#') then try_cast(regexp_extract(e, '^&#([0-9]{1,9})', 1) as bigint) end"
    one = f"case e {named} else case when ends_with(e, ';') and {code} between 1 and 1114111 and {code} not between 55296 and 57343 then chr(({code})::int) else e end end"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s)&(?:#x[0-9a-fA-F]+|#[0-9][0-9a-fA-F]*|[a-zA-Z]+);|[^&]+|&', 0), lambda e: {one}), '')"


_CLEAN = f"trim(regexp_replace(regexp_replace({_decoded(_decoded('html'))}, '{_TAG}', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'), ' ')"


@query("text_clean_html", f"select page_id, {_CLEAN} as clean from pages")
def text_clean_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))


@query("text_title_extract", f"select page_id, {_CLEAN.replace('html', 't')} as title from (select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as t from pages)")
def text_title_extract(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return read(spark, sf_dir, "pages").select("page_id", text.clean_text(title).alias("title"))


@query("text_links_explode", """select page_id, unnest(range(len(l)))::int as pos, unnest(l) as href from (select page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) as l from pages)""")
def text_links_explode(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


_TRACKED = """select page_id, url from pages union all
  select page_id, regexp_replace(url, '#.*$', '') || case when contains(url, '?') then '&' else '?' end || 'utm_source=feed&guccounter=1#part' from pages"""


def _tracked(spark, sf_dir):
    """URLs, and copies with tracking parameters and another fragment."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    mark = F.when(F.col("url").contains("?"), "&").otherwise("?")
    return pages.unionByName(pages.select("page_id", F.concat(F.regexp_replace("url", "#.*$", ""), mark, F.lit("utm_source=feed&guccounter=1#part")).alias("url")))


@query(
    "url_normalize",
    f"""with a as ({_TRACKED}), b as (select page_id, url, regexp_replace(url, '#.*$', '') as u from a),
    c as (select page_id, url, split_part(u, '?', 1) as base, list_filter(string_split(case when contains(u, '?') then substr(u, instr(u, '?') + 1) else '' end, '&'),
      lambda x: x <> '' and not list_contains(['.tsrc','guccounter','utm_source','utm_medium','utm_campaign','utm_term','utm_content'], split_part(x, '=', 1))) as p from b)
    select page_id, url, base || case when len(p) > 0 then '?' || array_to_string(p, '&') else '' end as normal from c""",
)
def url_normalize(spark, sf_dir):
    return _tracked(spark, sf_dir).select("page_id", "url", url.normalize_url(F.col("url")).alias("normal"))


_ODD = """select page_id, case page_id % 5 when 0 then replace(url, 'http://', 'ftp://') when 1 then replace(url, '://', '://me:pw@') when 2 then url || chr(10) else url end as url from pages"""


def _odd(spark, sf_dir):
    u = F.col("url")
    k = F.col("page_id") % 5
    return read(spark, sf_dir, "pages").select("page_id", F.when(k == 0, F.replace(u, F.lit("http://"), F.lit("ftp://"))).when(k == 1, F.replace(u, F.lit("://"), F.lit("://me:pw@"))).when(k == 2, F.concat(u, F.lit("\n"))).otherwise(u).alias("url"))


@query("url_safe_filter", f"select page_id, url from ({_ODD}) where (starts_with(url, 'http://') or starts_with(url, 'https://')) and not contains(split_part(split_part(url, '://', 2), '/', 1), '@') and not contains(url, chr(10))")
def url_safe_filter(spark, sf_dir):
    return _odd(spark, sf_dir).select("page_id", url.safe_http_url(F.col("url")).alias("url")).where(F.col("url").isNotNull())


@query(
    "url_redact",
    """select page_id, case when page_id % 3 = 0 then regexp_replace(url, '#.*$', '') || case when contains(url, '?') then '&' else '?' end || 'api_key=<redacted>&n=1' else url end as safe from pages""",
)
def url_redact(spark, sf_dir):
    u, mark = F.col("url"), F.when(F.col("url").contains("?"), "&").otherwise("?")
    secret = F.concat(F.replace(F.regexp_replace(u, "#.*$", ""), F.lit("://"), F.lit("://me:pw@")), mark, F.lit("api_key=abc%20d&n=1"))
    return read(spark, sf_dir, "pages").select("page_id", url.redact_url(F.when(F.col("page_id") % 3 == 0, secret).otherwise(u)).alias("safe"))


@query("stable_id", "select doc_id, concat_ws('|', nullif(trim(source), ''), doc_id::varchar, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')) as id from documents")
def stable_id(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.stable_id(F.col("source"), F.lit("  "), F.col("doc_id").cast("string"), F.col("text")).alias("id"))


@query(
    "byte_size_parse",
    "select p_partkey, case p_partkey % 4 when 0 then (p_size * 1024)::bigint when 1 then floor((p_size + 0.5) * 1048576 + 0.5)::bigint when 2 then (p_size * 1000)::bigint else null end as bytes from part",
)
def byte_size_parse(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    size = F.when(k == 0, F.concat(n, F.lit(" kB"))).when(k == 1, F.concat(n, F.lit(".5MiB"))).when(k == 2, F.concat(n, F.lit(",000 bytes"))).otherwise(F.concat(n, F.lit(" furlongs")))
    return read(spark, sf_dir, "part").select("p_partkey", text.byte_size(size).alias("bytes"))


_BODY13 = "('978' || lpad(p_partkey::varchar, 9, '0'))"
_SUM13 = " + ".join(f"substr(b, {i + 1}, 1)::int * {1 if i % 2 == 0 else 3}" for i in range(12))
_SUM10 = " + ".join(f"substr(b, {i + 1}, 1)::int * {10 - i}" for i in range(9))


@query("isbn_check_digit", f"select p_partkey, ((10 - ({_SUM13}) % 10) % 10)::varchar as digit from (select p_partkey, {_BODY13} as b from part)")
def isbn_check_digit(spark, sf_dir):
    body = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return read(spark, sf_dir, "part").select("p_partkey", ids.isbn13_check_digit(body).alias("digit"))


@query(
    "isbn10_to_13",
    f"""with a as (select p_partkey, lpad(p_partkey::varchar, 9, '0') as b from part),
    c as (select p_partkey, b, (11 - ({_SUM10}) % 11) % 11 as r from a), d as (select p_partkey, '978' || b as b, case when r = 10 then 'X' else r::varchar end as k from c)
    select p_partkey, case when p_partkey % 7 = 0 then null else b || ((10 - ({_SUM13}) % 10) % 10)::varchar end as isbn13 from d""",
)
def isbn10_to_13(spark, sf_dir):
    body = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    given = F.concat(F.substring(body, 1, 1), F.lit("-"), F.substring(body, 2, 8), F.lit("-"), ids.isbn10_check_digit(body))
    broken = F.concat(body, F.when(ids.isbn10_check_digit(body) == "1", "2").otherwise("1"))
    return read(spark, sf_dir, "part").select("p_partkey", ids.isbn10_to_13(F.when(F.col("p_partkey") % 7 == 0, broken).otherwise(given)).alias("isbn13"))


@query("doi_normalize", "select p_partkey, case when p_partkey % 4 = 3 then null else '10.1234/abc.' || p_partkey::varchar end as doi from part")
def doi_normalize(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    given = F.when(k == 0, F.concat(F.lit("https://doi.org/10.1234/ABC."), n)).when(k == 1, F.concat(F.lit(" doi: 10.1234/abc."), n)).when(k == 2, F.concat(F.lit("10.1234/Abc."), n)).otherwise(F.concat(F.lit("11.12/"), n))
    return read(spark, sf_dir, "part").select("p_partkey", ids.normalize_doi(given).alias("doi"))


@query("surname_extract", "select c_custkey, case when c_custkey % 2 = 0 then lower(c_mktsegment) else regexp_extract(regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9]+', ' ', 'g'), '([^ ]+)$', 1) end as surname from customer")
def surname_extract(spark, sf_dir):
    given = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(", "), "c_name")).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.surname(given).alias("surname"))


@query(
    "date_formats_parse",
    """select o_orderkey, case o_orderkey % 7 when 0 then 'iso_8601' when 1 then 'date_only' when 2 then 'rfc_822' when 3 then 'gdelt' when 4 then 'dotnet' when 5 then 'finviz' else 'iso_8601' end as format,
    case o_orderkey % 7 when 1 then epoch_ms(date_trunc('day', o_orderdate)) when 5 then epoch_ms(date_trunc('minute', o_orderdate) + interval 30 year) when 6 then null else epoch_ms(date_trunc('second', o_orderdate)) end as ms from orders""",
)
def date_formats_parse(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("at", F.date_trunc("second", "o_orderdate"))
    f = lambda p: F.date_format("at", p)
    k = F.col("o_orderkey") % 7
    eastern = F.date_format(F.from_utc_timestamp(F.col("at") + F.expr("interval 30 years"), "America/New_York"), "MMM-dd-yy hh:mma")
    given = F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, f("yyyy-MM-dd")).when(k == 2, F.concat(f("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k == 3, f("yyyyMMdd'T'HHmmss'Z'"))
    given = given.when(k == 4, F.concat(F.lit("/Date("), F.unix_millis("at").cast("string"), F.lit(")/"))).when(k == 5, eastern).otherwise(f("yyyy-02-31'T'HH:mm:ss'Z'"))
    return orders.select("o_orderkey", dates.published_format(given).alias("format"), F.unix_millis(dates.published_at(given)).alias("ms"))


@query("date_only_normalize", "select o_orderkey, case when o_orderkey % 3 = 2 then null else o_orderdate::date end as day from orders")
def date_only_normalize(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    given = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss+00:00")).otherwise(F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.date_only(given).alias("day"))


@query("tag_normalize", "select o_orderpriority, regexp_replace(lower(trim(o_orderpriority)), '\\s+', '-', 'g') as tag, count(*) as n from orders group by 1, 2")
def tag_normalize(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("o_orderpriority", text.normalize_tag(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("tag"), "n")


@query("json_field_extract", "select event_id, (props->>'$.k')::bigint as k, props->>'$.missing' as missing from events")
def json_field_extract(spark, sf_dir):
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("ipv4_to_integer", "select c_custkey, case when c_custkey % 11 = 0 then null else 10::bigint * 16777216 + (c_custkey % 256) * 65536 + (c_nationkey % 256) * 256 + 7 end as n from customer")
def ipv4_to_integer(spark, sf_dir):
    third = F.when(F.col("c_custkey") % 11 == 0, F.lit("256")).otherwise(F.col("c_nationkey").cast("string"))
    ip = F.concat_ws(".", F.lit("10"), (F.col("c_custkey") % 256).cast("string"), third, F.lit("7"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.ipv4_number(ip).alias("n"))


@query("format_signed", "select c_custkey, case when floor(c_acctbal + 0.5) >= 0 then '+' else '-' end || format('{:,}', abs(floor(c_acctbal + 0.5))::bigint) as txt from customer")
def format_signed(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.signed_integer(F.col("c_acctbal")).alias("txt"))


_WORD = lambda w, flags="(?i)": f"regexp_matches(text, '{flags}(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])')"


@query("subject_match_tokens", f"select doc_id from documents where {_WORD('the')} and {_WORD('ing')}")
def subject_match_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(match.mentions_query(F.col("text"), "\"The\" ING")).select("doc_id")


@query("subject_match_phrase", f"select doc_id from documents where {_WORD('of\\s+the')}")
def subject_match_phrase(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(match.mentions_phrase(F.col("text"), "Of  The")).select("doc_id")


@query("subject_match_ticker", f"select doc_id from documents where {_WORD('DIE', '')}")
def subject_match_ticker(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(match.mentions_ticker(F.col("text"), "die")).select("doc_id")


@query("research_query_match", r"select doc_id from documents where contains(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), 'tion') and contains(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), 'erea')")
def research_query_match(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(match.research_match(F.col("text"), "Tion, erea")).select("doc_id")


_HEADLINES = ("Q2 results beat", "earnings call", "Firm appoints new CFO", "prices senior notes due 2030", "preferred stock redeemed", "declares dividend", "Moody's rating cut", "SEC charges", "court settlement", "merger agreed", "nothing new", "fdic and lawsuit")
_HEADLINE_SQL = "[" + ", ".join("'" + h.replace("'", "''") + "'" for h in _HEADLINES) + "]"


def _case_sql() -> tuple[str, str]:
    has = lambda ws: "(" + " or ".join(f"contains(t, '{w}')" for w in ws) + ")"
    rules = [("filing", "form is not null")] + [(k, has(ws) if k != "earnings" else f"({has(ws)} or regexp_matches(t, '\\bq[1-4]\\s+results\\b'))") for k, ws in classify.KINDS]
    kind = "case " + " ".join(f"when {on} then '{k}'" for k, on in rules) + " end"
    tags = [f"case when {on} then '{k}' end" for k, on in rules]
    tags.append("lower(form)")
    tags.append(f"case when {has(dict(classify.KINDS)['capital-markets'])} and {has(classify.DEBT)} then 'debt' end")
    return kind, "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(tags) + "], lambda x: x is not null))), ',')"


_KIND_SQL, _TAGS_SQL = _case_sql()


@query("classify_event_kind", f"select doc_id, {_KIND_SQL} as event_kind, {_TAGS_SQL} as tags from (select doc_id, lower({_HEADLINE_SQL}[doc_id % {len(_HEADLINES)} + 1] || ' ' || text || ' ' || source) || case when doc_id % 17 = 0 then ' 8-k' else '' end as t, case when doc_id % 17 = 0 then '8-K' end as form from documents)")
def classify_event_kind(spark, sf_dir):
    headline = F.element_at(F.array(*map(F.lit, _HEADLINES)), (F.col("doc_id") % len(_HEADLINES) + 1).cast("int"))
    form = F.when(F.col("doc_id") % 17 == 0, "8-K")
    t = classify.item_text(headline, F.col("text"), F.col("source"), form)
    none = F.lit(None).cast("string")
    return read(spark, sf_dir, "documents").select("doc_id", classify.event_kind(t, form, none).alias("event_kind"), F.array_join(classify.event_tags(t, form, none), ",").alias("tags"))


@query("infer_kind", "select source, case source when 'src1' then 'press-release' when 'src2' then 'filing' when 'src3' then 'analysis' else 'article' end as kind, count(*) as n from documents group by 1, 2")
def infer_kind(spark, sf_dir):
    by = {"src1": "GlobeNewswire", "src2": "EDGAR", "src3": "Insider Monkey"}
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in by.items() for x in kv])[F.col("source")], F.col("source"))
    grouped = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return grouped.select("source", classify.news_kind(name, F.lit("title"), F.lit("http://x.example")).alias("kind"), "n")
