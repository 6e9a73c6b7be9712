"""Queries of the news lane: filters, merge, order, status, watchlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import match
from tidemill.operators import lanes, merge
from tidemill.plans import scalars
from tidemill.plans.registry import query, read


def _items(spark, sf_dir) -> DataFrame:
    """Documents as news items of a few hundred keys, each seen by several providers."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("k"), (d % 211).cast("string")).alias("key"),
        d.alias("seq"),
        F.when(d % 13 == 0, "sec-edgar").otherwise(F.col("source")).alias("provider"),
        F.col("source"),
        F.concat(F.lit("https://x.example/"), (d % 211).cast("string")).alias("url"),
        F.when(d % 3 != 0, F.lit("2024-01-01T00:00:00Z")).alias("published_at"),
        F.when(F.col("n_chars") > 1000, F.col("text")).alias("summary"),
        F.when(d % 5 == 0, F.lit("https://x.example/c")).alias("canonical_url"),
        F.when(d % 7 == 0, F.lit("rating")).alias("event_kind"),
        F.when(d % 4 == 3, F.array("lang", F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.array(F.concat(F.lit("T"), (d % 3).cast("string"))).alias("related_tickers"),
    )


_ITEMS = """select 'k' || (doc_id % 211)::varchar as key, doc_id as seq, case when doc_id % 13 = 0 then 'sec-edgar' else source end as provider, doc_id % 4 = 3 as tagged, lang,
  case when doc_id % 3 <> 0 then 4 else 0 end + case when doc_id % 13 = 0 then 3 else 0 end + case when n_chars > 1000 then 1 else 0 end + case when doc_id % 5 = 0 then 1 else 0 end + case when doc_id % 7 = 0 then 1 else 0 end as score from documents"""


@query(
    "news_merge_dedupe",
    f"""with items as ({_ITEMS}), folded as (
      select key, list_reduce(list({{'seq': seq, 'score': score, 'tagged': tagged}} order by seq),
        lambda a, x: case when x.score + x.tagged::int > a.score + a.tagged::int then {{'seq': x.seq, 'score': x.score, 'tagged': a.tagged or x.tagged}}
          else {{'seq': a.seq, 'score': a.score, 'tagged': a.tagged or x.tagged}} end) as k,
        array_to_string(list_sort(list_distinct(list(provider))), ',') as providers,
        array_to_string(list_sort(list_distinct(flatten(list(case when tagged then [lang, 't'] else [] end)))), ',') as tags from items group by key)
    select key, k.seq as seq, (k.score + k.tagged::int)::int as score, providers, tags from folded""",
)
def news_merge_dedupe(spark, sf_dir):
    merged = merge.merge_news(_items(spark, sf_dir))
    return merged.select("key", "seq", "score", F.array_join("providers", ",").alias("providers"), F.array_join("all_tags", ",").alias("tags"))


@query(
    "news_score",
    "select d.doc_id, (case when d.doc_id % 3 <> 0 then 4 else 0 end + case when n_chars > 1000 then 1 else 0 end + case when l.toxic is not null then 1 else 0 end + case when l.quality = 1 then 1 else 0 end)::int as score from documents d left join labels l on d.doc_id = l.doc_id",
)
def news_score(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(F.col("toxic").isNotNull(), F.lit("rating"))
    score = merge.news_score(F.when(F.col("doc_id") % 3 != 0, F.lit("x")), F.col("source"), F.lit("https://x.example"), F.when(F.col("n_chars") > 1000, F.lit("s")), F.when(F.col("quality") == 1, F.lit("c")), kind)
    return docs.select("doc_id", score.alias("score"))


@query("news_sort_limit", "select event_id, case when event_id % 10 = 0 then null else ts end as ts from events order by coalesce(case when event_id % 10 = 0 then null else ts end, timestamp '1970-01-01') desc, event_id desc limit 100")
def news_sort_limit(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp_ntz")).alias("ts"))
    return rows.orderBy(F.coalesce("ts", F.lit("1970-01-01").cast("timestamp_ntz")).desc(), F.desc("event_id")).limit(100)


@query(
    "date_window_filter",
    """with e as (select event_id, case when event_id % 10 = 0 then null else ts end as ts from events)
    select event_id, (select count(*) from e where ts is null) as undated from e where ts between timestamp '2024-01-05' and timestamp '2024-01-10'""",
)
def date_window_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp_ntz")).alias("ts"))
    undated = rows.agg(F.count_if(F.col("ts").isNull()).alias("undated"))
    inside = rows.where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-10").cast("timestamp_ntz")))
    return inside.select("event_id").crossJoin(F.broadcast(undated))  # one row


@query(
    "provider_status_rollup",
    """with p as (select event_type as provider, count(*) as items, count(*) filter (value > 90) as warned, bool_or(value < 0.5) as failed from events group by 1),
    s as (select *, case when failed then 'error' when items = 0 then 'empty' when warned > 0 then 'partial' else 'ok' end as status from p)
    select array_to_string(list_sort(list(provider || ':' || status)), ',') as statuses, bool_or(status in ('error', 'unsupported', 'partial', 'disabled')) as partial, sum(items)::bigint as items from s""",
)
def provider_status_rollup(spark, sf_dir):
    by = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("items"), F.count_if(F.col("value") > 90).alias("warned"), F.bool_or(F.col("value") < 0.5).alias("failed"))
    status = F.when(F.col("failed"), "error").when(F.col("items") == 0, "empty").when(F.col("warned") > 0, "partial").otherwise("ok")
    by = by.withColumn("status", status)
    return by.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "provider", "status"))), ",").alias("statuses"), F.bool_or(F.col("status").isin("error", "unsupported", "partial", "disabled")).alias("partial"), F.sum("items").alias("items"))


_SUBJECTS = (("a", "the"), ("b", "das"), ("c", "les"))


@query("watchlist_fanout", "with s(subject, word) as (values ('a', 'the'), ('b', 'das'), ('c', 'les')) select subject, doc_id from s, documents where regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || word || '($|[^A-Za-z0-9])')")
def watchlist_fanout(spark, sf_dir):
    """Documents with each subject that they mention: one scan for all subjects."""
    found = F.array_compact(F.array(*(F.when(match.mentions_query(F.col("text"), word), F.lit(name)) for name, word in _SUBJECTS)))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("subject"))


_FEED_KIND, _FEED_TAGS = (x.replace("form is not null", "false").replace("lower(form)", "null") for x in (scalars._KIND_SQL, scalars._TAGS_SQL))


@query(
    "topic_feed",
    f"""with d as (select 'd' || doc_id::varchar as id, source, trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') as title, case when doc_id % 10 <> 0 then 1704067200 + doc_id end as published from documents),
    m as (select *, 'https://x.example/' || md5(lower(title)) as url from d where regexp_matches(title, '(?i)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])')),
    t as (select *, lower(title || ' ' || source || ' ' || url) as t from m), c as (select id, source, url, published, {_FEED_KIND} as kind, {_FEED_TAGS} as tags from t),
    s as (select *, case when published is not null then 4 else 0 end + 1 + case when kind is not null then 1 else 0 end as score, tags <> '' as tagged from c),
    f as (select url, list_reduce(list({{'id': id, 'score': score, 'tagged': tagged}} order by source, id),
        lambda a, x: case when x.score + x.tagged::int > a.score + a.tagged::int then {{'id': x.id, 'score': x.score, 'tagged': a.tagged or x.tagged}}
          else {{'id': a.id, 'score': a.score, 'tagged': a.tagged or x.tagged}} end) as k,
        array_to_string(list_sort(list_distinct(list(source))), ',') as providers, array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(tags, ','))), lambda x: x <> ''))), ',') as tags,
        count(distinct source) as origins from s group by url)
    select s.id, s.kind as event_kind, s.published, (f.k.score + f.k.tagged::int)::int as score, f.providers, f.tags, f.origins::int as origins
    from f join s on s.id = f.k.id order by coalesce(s.published, 0) desc, s.id desc limit 50""",
)
def topic_feed(spark, sf_dir):
    """The flagship: the feed of a topic over documents as news items: match, classify, merge copies by URL, order, limit."""
    title = F.trim(F.regexp_replace("text", r"[ \t\r\n\f]+", " "))
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", title.alias("title"))
    items = rows.select(
        F.col("source").alias("provider"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "title", none.alias("summary"), "source",
        F.concat(F.lit("https://x.example/"), F.md5(F.lower("title").cast("binary"))).alias("url"), none.alias("canonical_url"),
        F.when(F.col("doc_id") % 10 != 0, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))).alias("published_at"), none.alias("kind"), none.alias("form_type"),
        F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("array<string>").alias("related_tickers"),
    )
    found = lanes.feed(items, lanes.Subject(query="the"), limit=50)
    return found.select("id", "event_kind", F.unix_seconds("published_at").alias("published"), "score", F.array_join("providers", ",").alias("providers"), F.array_join("all_tags", ",").alias("tags"), F.size("provenance").alias("origins"))


@query("union_providers", "select source as provider, doc_id as id, 'doc' as kind from documents union all select event_type, event_id, 'event' from events union all select 'pages', page_id, 'page' from pages")
def union_providers(spark, sf_dir):
    rows = [("documents", "source", "doc_id", "doc"), ("events", "event_type", "event_id", "event")]
    parts = [read(spark, sf_dir, t).select(F.col(p).alias("provider"), F.col(i).alias("id"), F.lit(k).alias("kind")) for t, p, i, k in rows]
    pages = read(spark, sf_dir, "pages").select(F.lit("pages").alias("provider"), F.col("page_id").alias("id"), F.lit("page").alias("kind"))
    return parts[0].unionByName(parts[1]).unionByName(pages)


@query("category_filter", "select doc_id from documents where lang = 'en' or starts_with(lang, 'en ') or lower(source) = 'src4'")
def category_filter(spark, sf_dir):
    """Normalised equality, or a prefix and a space, on any of several categories."""
    wanted = ("en", "src4")
    hit = F.exists(F.array(F.lower("lang"), F.lower("source")), lambda c: c.isin(*wanted) | c.startswith("en "))
    return read(spark, sf_dir, "documents").where(hit).select("doc_id")


@query("relevance_signals", "select doc_id, array_to_string(list_filter([case when contains(lower(text), 'tion') then 'tion' end, case when regexp_matches(text, '[0-9]{3}') then 'number' end, case when n_chars > 5000 then 'long' end], lambda x: x is not null), ',') as signals from documents")
def relevance_signals(spark, sf_dir):
    flags = (("tion", F.lower("text").contains("tion")), ("number", F.col("text").rlike("[0-9]{3}")), ("long", F.col("n_chars") > 5000))
    signals = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in flags)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(signals, ",").alias("signals"))
