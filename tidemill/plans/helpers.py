"""Queries on the smaller functions and operators: helpers of dates, text, numbers and severities, joins of several kinds, lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import dates, ids, severity, text, url
from tidemill.operators import joins, lanes
from tidemill.plans import scalars
from tidemill.plans.registry import query, read


def either(k, *choices):
    """The (k mod n)-th of several columns or texts."""
    return F.get(F.array(*(F.lit(c) if isinstance(c, str) else c for c in choices)), (k % len(choices)).cast("int"))


@query(
    "dates_of_publishers",
    """select o_orderkey, case when o_orderkey % 3 <> 2 then d end as us, case when o_orderkey % 3 <> 2 then d end as loose, d as compact, d as compact_us, d as map, case when o_orderkey % 5 <> 0 then d end as ended,
      case when o_orderkey % 4 <> 0 then d end as excel, last_day(d) as month_end, last_day(make_date(year(d)::int, (o_orderkey % 12 + 1)::int, 1)) as season, (d - 1)::date as pacific from (select o_orderkey, o_orderdate::date as d from orders)""",
)
def dates_of_publishers(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("d")
    f = lambda p: F.date_format("d", p)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return rows.select(
        "o_orderkey",
        dates.us_date(either(k, f("MM/dd/yyyy"), f("MM/dd/yyyy"), "02/30/2024")).alias("us"),
        dates.loose_us_date(either(k, F.concat(f("M/d/yyyy"), F.lit(" 1:02:03 PM")), f("yyyy-MM-dd"), "13/1/2024")).alias("loose"),
        dates.compact_date(f("yyyyMMdd")).alias("compact"),
        dates.compact_us_date(f("MMddyyyy")).alias("compact_us"),
        dates.map_date(either(k, f("yyyyMMdd"), F.concat(f("yyyy-MM-dd"), F.lit("T00:00:00")))).alias("map"),
        dates.open_ended(F.when(k % 5 == 0, F.lit("9999-12-31").cast("date")).otherwise(d)).alias("ended"),
        dates.excel_date(F.when(k % 4 == 0, F.lit(60.0)).otherwise(F.datediff(d, F.lit("1899-12-30").cast("date")) + 0.75)).alias("excel"),
        dates.month_end(F.year("d"), F.month("d")).alias("month_end"),
        dates.season_end(either(k, *dates.SEASONS), F.year("d")).alias("season"),
        dates.pacific_date(F.col("d").cast("timestamp")).alias("pacific"),
    )


@query(
    "text_of_publishers",
    f"""select c_custkey, case when c_custkey % 3 = 2 then 'second' else c_name end as first, case when c_custkey % 3 = 0 then 'second' end as second, case when c_custkey % 4 <> 3 then (c_custkey % 900 + 1)::int end as pages,
      case c_custkey % 5 when 0 then 'é ' || c_name || '.pdf' when 1 then c_name || '.pdf' when 2 then c_name || '.txt' end as file, c_custkey % 2 = 0 as control, c_name as bare, c_name as cleaned,
      case when c_custkey % 6 < 5 then 'abcdefgh' || lpad((c_custkey % 1000)::varchar, 3, '0') end as video, c_custkey % 2 = 0 as channel, regexp_replace(c_mktsegment, 'A', 'A', 'g') as folded,
      '<' || c_name || '> & é' as decoded, format('{{:,}}', c_custkey * 1000) as grouped from customer""",
)
def text_of_publishers(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    part = lambda i, n: F.get(F.col("b"), F.lit(i)) if n else None  # noqa: E731, F841
    bilingual = text.bilingual(either(k, F.concat(F.lit(" "), name, F.lit(" /// second")), F.concat(name, F.lit(" ")), F.lit("///second")))
    pages = either(k, (k % 900 + 1).cast("string"), F.concat((k % 900 + 1).cast("string"), F.lit("[10]")), F.concat(F.lit("  "), (k % 900 + 1).cast("string"), F.lit(" p.")), "none")
    encoded = F.concat(F.lit("attachment; filename=\"x.pdf\"; filename*=UTF-8''%C3%A9%20"), F.url_encode(name), F.lit(".pdf"))
    header = either(k, encoded, F.concat(F.lit('inline; filename="../a/'), name, F.lit('.pdf"')), F.concat(F.lit("attachment; filename="), name, F.lit(".txt")), "attachment", 'x; filename=".."')
    own = F.concat(F.lit("abcdefgh"), F.lpad((k % 1000).cast("string"), 3, "0"))
    shapes = either(k, F.concat(F.lit("https://www.youtube.com/watch?a=1&v="), own), F.concat(F.lit("https://youtu.be/"), own, F.lit("?t=1")), F.concat(F.lit("youtube.com/shorts/"), own), own, F.concat(F.lit("https://m.youtube.com/embed/"), own, F.lit("#x")), F.concat(F.lit("https://x.example/watch?v="), own))
    controlled = F.when(k % 2 == 0, F.concat(name, F.lit("\x07"))).otherwise(name)
    marked = F.translate("c_mktsegment", "AEIOU", "ÀÈÌÒÙ")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", bilingual["first"].alias("first"), bilingual["second"].alias("second"), text.page_count(pages).alias("pages"), text.disposition_file_name(header).alias("file"),
        text.has_control(controlled).alias("control"), text.strip_control(controlled).alias("bare"), text.clean_text(F.concat(F.lit("<b>"), name, F.lit("</b> "))).alias("cleaned"), url.video_id(shapes).alias("video"),
        url.is_channel_id(F.when(k % 2 == 0, F.lit("UC" + "a" * 22)).otherwise("UCx")).alias("channel"), text.fold_marks(marked).alias("folded"),
        text.decode_entities(F.concat(F.lit("&lt;"), name, F.lit("&#62; &amp; &#xe9;"))).alias("decoded"), text.grouped_integer(k * 1000).alias("grouped"),
    )


@query(
    "absolute_urls",
    """select page_id, k, case k when 0 then 'https://other.example/a?b=1&c=2' when 1 then 'https://h.example/up/x' when 2 then 'https://h.example/root/' || page_id::varchar when 3 then 'https://h.example/d/sub/page?z' when 4 then 'https://h.example/d/sub/page?q=' || page_id::varchar
      else 'https://cdn.example/y' end as link from pages, range(0, 6) r(k)""",
)
def absolute_urls(spark, sf_dir):
    n = F.col("page_id").cast("string")
    links = F.array(F.lit("https://other.example/a?b=1&amp;c=2"), F.lit("../../up/./x"), F.concat(F.lit("/root/"), n), F.lit(""), F.concat(F.lit("?q="), n), F.lit("//cdn.example/y"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("k", "link"))
    return rows.select("page_id", F.col("k").cast("long").alias("k"), url.absolute_url(F.col("link"), F.lit("https://h.example/d/sub/page?z")).alias("link"))


@query(
    "isbn_identities",
    f"""with a as (select p_partkey, lpad(p_partkey::varchar, 9, '0') as b from part), c as (select p_partkey, b, (11 - ({scalars._SUM10}) % 11) % 11 as r from a),
    d as (select p_partkey, b || case when r = 10 then 'X' else r::varchar end as ten, '978' || b as b from c), e as (select p_partkey, ten, b || ((10 - ({scalars._SUM13}) % 10) % 10)::varchar as thirteen from d)
    select p_partkey, thirteen as isbn13, ten as isbn10, thirteen || ',' || ten as found from e""",
)
def isbn_identities(spark, sf_dir):
    body = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    ten = F.concat(body, ids.isbn10_check_digit(body))
    thirteen = F.concat(F.lit("978"), body, ids.isbn13_check_digit(F.concat(F.lit("978"), body)))
    one = ids.isbn_identity(F.when(F.col("p_partkey") % 2 == 0, ten).otherwise(thirteen))
    dashed = F.concat(F.substring(thirteen, 1, 3), F.lit("-"), F.substring(thirteen, 4, 10))
    found = ids.extract_isbns(F.concat_ws(" ", F.lit("see"), dashed, F.lit("or"), ten, F.lit("and"), thirteen, F.lit("not 1234567890123")))
    return read(spark, sf_dir, "part").select("p_partkey", one["isbn13"].alias("isbn13"), one["isbn10"].alias("isbn10"), F.array_join(found, ",").alias("found"))


@query(
    "severities_of_publishers",
    """select event_id, case event_id % 5 when 0 then 'extreme' when 1 then 'severe' when 2 then 'moderate' when 3 then 'minor' else 'unknown' end as weather, case event_id % 4 when 0 then 'extreme' when 1 then 'severe' when 2 then 'minor' else 'unknown' end as disaster,
      case when value >= 96 then 'extreme' else case event_id % 3 when 0 then 'severe' when 1 then 'minor' else 'unknown' end end as storm, case event_id % 4 when 0 then 'extreme' when 1 then 'severe' when 2 then 'minor' else 'unknown' end as tsunami,
      case when event_id % 5 = 4 and value <= 20 then 'extreme' when event_id % 5 = 4 then 'severe' when event_id % 5 = 3 then 'moderate' else 'minor' end as conflict, case event_id % 3 when 0 then 'extreme' when 1 then 'moderate' else 'unknown' end as airport,
      case event_id % 3 when 0 then 'minor' when 1 then 'severe' else 'unknown' end as volcano, case when value >= 75 then 'extreme' when value >= 50 then 'severe' when value >= 37.5 then 'moderate' else 'minor' end as flood from events""",
)
def severities_of_publishers(spark, sf_dir):
    k, value = F.col("event_id"), F.col("value")
    return read(spark, sf_dir, "events").select(
        "event_id",
        severity.named(either(k, "Extreme", "Severe", "Moderate", "Minor", "extreme"), severity.WEATHER).alias("weather"),
        severity.named(either(k, "Red", "Orange", "Green", "Blue"), severity.DISASTER).alias("disaster"),
        severity.storm(either(k, "hu", "TD", "??"), value).alias("storm"),
        severity.tsunami(either(k, "Tsunami WARNING and watch", "a Watch", "Information", "nothing")).alias("tsunami"),
        severity.conflict(k % 5, value - 27).alias("conflict"),
        severity.named(either(k, "Airport_Closure", "Ground_Delay", "x"), severity.AIRPORT).alias("airport"),
        severity.named(either(k, "NORMAL", "WATCH", "UNASSIGNED"), severity.VOLCANO).alias("volcano"),
        severity.discharge(value / 25).alias("flood"),
    )


@query(
    "numbers_of_publishers",
    """select event_id, case when event_id % 3 <> 0 or event_id % 5 <> 0 then (case when event_id % 3 <> 0 then 2 else 0 end + case when event_id % 5 <> 0 then 3 else 0 end) end::double as total,
      case when event_id % 4 <> 0 then (event_id % 4 + 10) - event_id % 4 end::double as change, case when event_id % 4 <> 0 then floor(1000.0 / (event_id % 4) * 1000 + 0.5) end::bigint as percent,
      case when event_id % 7 >= 4 then 'el-nino' when event_id % 7 <= 2 then 'la-nina' else 'neutral' end as phase, case event_id % 3 when 0 then 12.5 when 1 then -12.5 end::double as latitude, event_id % 6 <> 0 as known,
      case when event_id % 6 <> 1 then (event_id % 6)::double end as placed, case when event_id % 2 = 0 then 0.5 else 0.4 end::double as implied, (event_id % 9)::double as last from events""",
)
def numbers_of_publishers(spark, sf_dir):
    k = F.col("event_id")
    none = F.lit(None).cast("double")
    quote = lanes.quote_change((k % 4 + 10).cast("double"), (k % 4).cast("double"))
    place = lanes.place(F.when(k % 6 == 1, F.lit(91.0)).otherwise((k % 6).cast("double")), (k % 6).cast("double"))
    return read(spark, sf_dir, "events").select(
        "event_id",
        lanes.sum_of_present(F.when(k % 3 != 0, 2), none, F.when(k % 5 != 0, 3)).alias("total"),
        quote["change"].alias("change"), F.floor(quote["percent"] * 1000 + 0.5).cast("long").alias("percent"),
        lanes.ocean_phase((k % 7 - 3) * 0.5).alias("phase"),
        lanes.hemisphere(either(k, "12.5 n", "12.5S", "95N"), "N", "S", 90).alias("latitude"),
        place["known"].alias("known"), place["latitude"].alias("placed"),
        lanes.implied_probability(F.lit(40.0), F.when(k % 2 == 0, 60.0), 100.0).alias("implied"),
        lanes.last_finite(F.array(F.lit(1.0), (k % 9).cast("double"), none, F.lit(float("nan")))).alias("last"),
    )


@query("joins_by_position", "select conv_id, count(*) as pairs, sum(turn * length(role))::bigint as total, min(case when turn < 2 then role else 'none' end) as shorter from conversations group by 1")
def joins_by_position(spark, sf_dir):
    """Arrays that belong together by position: of one length, and filled up with nulls."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    turns, roles = F.transform("x", lambda e: e["turn"]), F.transform("x", lambda e: e["role"])
    rows = rows.select("conv_id", joins.by_position(turns, roles).alias("p"), joins.zipped(turn=turns, role=F.slice(roles, 1, 2)).alias("z"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, e: s + e["left"] * F.length(e["right"]))
    return rows.select("conv_id", F.size("p").cast("long").alias("pairs"), total.alias("total"), F.array_min(F.transform("z", lambda e: F.coalesce(e["role"], F.lit("none")))).alias("shorter"))


@query("joins_by_code", "select c_custkey, case c_nationkey % 5 when 0 then 'A' when 1 then 'A' when 2 then 'B' end as preset, case when c_nationkey % 3 = 0 then 'zero' else 'other' end as label from customer")
def joins_by_code(spark, sf_dir):
    """Codes of which a preset has several, historical ones too; labels with a default."""
    presets = spark.createDataFrame([("A", ["0", "1"]), ("B", ["2", "1"])], "preset string, codes array<string>")
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("string").alias("code"), (F.col("c_nationkey") % 3).cast("string").alias("c"))
    found = joins.by_any_code(rows, presets, "code", "codes")
    return found.select("c_custkey", "preset", joins.label(F.col("c"), {"0": "zero"}, "other").alias("label"))


@query(
    "stitched_parts",
    """select l_orderkey as filer, 'R' || l_linenumber::varchar as code, case when l_linenumber % 2 = 0 then 'second ' else 'first ' end || count(*)::varchar as value from lineitem group by l_orderkey, l_linenumber""",
)
def stitched_parts(spark, sf_dir):
    """A table that came in two parts; the later part's cell wins, empty cells count for nothing."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").cast("string").alias("n"))
    cell = lambda part, on, word: rows.select(F.col("l_orderkey").alias("filer"), F.lit(part).alias("part"), F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("code"), F.when(on, F.concat(F.lit(word), "n")).otherwise(" ").alias("value"))
    parts = cell(1, F.lit(True), "first ").unionByName(cell(2, F.col("l_linenumber") % 2 == 0, "second "))
    return joins.stitched(parts, ["filer"], "part", "code", "value")


@query("paired_controls", "select n_nationkey as product, n_name as label, 'act' || n_nationkey::varchar as action, 'btn' || n_nationkey::varchar as button from nation")
def paired_controls(spark, sf_dir):
    """Labels that have to have exactly one action and one button."""
    k = F.col("n_nationkey")
    nation = read(spark, sf_dir, "nation")
    side = lambda name, prefix: nation.select(k.alias("product"), F.concat(F.lit(prefix), k.cast("string")).alias(name))
    return joins.paired(nation.select(k.alias("product"), F.col("n_name").alias("label")), side("action", "act"), side("button", "btn"), "product")


@query("preferred_tracks", "select user_id, arg_min(event_id, case event_type when 'click' then 0 else 2 end + case when value > 50 then 0 else 1 end + event_id / 1e9) as event_id from events group by 1")
def preferred_tracks(spark, sf_dir):
    """By preferences in order, then the first."""
    return joins.preferred(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "click", F.col("value") > 50, -F.col("event_id")).select("user_id", "event_id")


@query("series_ends", "select event_type, event_id, 'last' as side from events qualify row_number() over (partition by event_type order by event_id desc) <= 31 union all select event_type, event_id, 'first' from events qualify row_number() over (partition by event_type order by event_id) <= 31")
def series_ends(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", "event_id")
    return joins.ends(rows, ["event_type"], "event_id", 31).withColumn("side", F.lit("last")).unionByName(joins.ends(rows, ["event_type"], "event_id", 31, last=False).withColumn("side", F.lit("first")))


@query("pages_of_rows", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def pages_of_rows(spark, sf_dir):
    return joins.page(read(spark, sf_dir, "orders"), 3, 25, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey")


@query("union_with_errors", "select 'customers' as part, c_name as name, null as error from customer union all select 'suppliers', s_name, null from supplier union all select 'parts', null, 'http 500'")
def union_with_errors(spark, sf_dir):
    """A publisher that failed is a row with an error."""
    parts = {"customers": read(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "suppliers": read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))}
    return joins.with_errors(parts, {"parts": "http 500"}, ["name"])


@query("best_files", "select l_orderkey as work, arg_min(l_linenumber, case l_returnflag when 'A' then 1 when 'R' then 2 else 9 end * 100 + l_linenumber)::int as line from lineitem group by 1")
def best_files(spark, sf_dir):
    """The most wanted format of each work."""
    name = F.when(F.col("l_returnflag") == "A", "EPUB").when(F.col("l_returnflag") == "R", "pdf").otherwise("doc")
    files = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), "l_linenumber", name.alias("format"))
    return lanes.best_files(files, ["work"], F.col("format"), F.col("l_linenumber")).select("work", F.col("l_linenumber").alias("line"))


@query("pending_releases", "select event_id as sequence from events where event_id > 500 and event_id % 4 <> 0 union all select max(event_id) + 1000000 from events where event_id % 4 <> 0")
def pending_releases(spark, sf_dir):
    """A sequenced source's backlog after a checkpoint, and, without one, its newest release."""
    lanes.checked_checkpoint("2024-01-02", 500)
    releases = read(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), (F.col("event_id") % 4).alias("rows"))
    return lanes.pending(releases, 500).select("sequence").unionByName(lanes.pending(releases, None).select((F.col("sequence") + 1000000).alias("sequence")))


@query(
    "event_snapshot",
    """with e as (select event_id::varchar as id, case event_id % 6 when 0 then 'extreme' when 1 then 'severe' when 2 then 'moderate' when 3 then 'minor' else 'unknown' end as severity, case event_id % 3 when 0 then 'US' when 1 then 'fr' end as country, ts,
        case event_id % 6 when 0 then 4 when 1 then 3 when 2 then 2 when 3 then 1 else 0 end as rank from events)
    select id, severity from e where rank >= 2 and upper(country) in ('US', 'FR') order by rank desc, ts desc nulls last, id limit 100""",
)
def event_snapshot(spark, sf_dir):
    """Checked, at or above a severity, in countries, the most severe and newest first."""
    k = F.col("event_id")
    events = read(spark, sf_dir, "events").select(k.cast("string").alias("id"), either(k, "extreme", "severe", "moderate", "minor", "unknown", "odd").alias("severity"), F.when(k % 3 == 0, "US").when(k % 3 == 1, "fr").alias("country"), F.col("ts").alias("observed_at"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    return lanes.snapshot(lanes.checked_snapshot(events), floor="moderate", countries=["us", "FR"], limit=100).select("id", "severity")


@query(
    "watchlist_feeds",
    """with i as (select 'i' || doc_id::varchar as id, source, text, doc_id % 40 as page, s.subject from documents, (values ('the', 'the'), ('DIE', 'die')) s(subject, word) where regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || s.word || '($|[^A-Za-z0-9])') and (s.subject = 'the' or regexp_matches(text, '(^|[^A-Za-z0-9])die($|[^A-Za-z0-9])') or true))
    select subject, 'https://x.example/' || page::varchar as url, array_to_string(list_sort(list_distinct(list(source))), ',') as providers from i group by subject, page""",
)
def watchlist_feeds(spark, sf_dir):
    """The feeds of two subjects over one scan, each merged by URL."""
    none = F.lit(None).cast("string")
    items = read(spark, sf_dir, "documents").select(
        F.col("source").alias("provider"), F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("title"), none.alias("summary"), "source",
        F.concat(F.lit("https://x.example/"), (F.col("doc_id") % 40).cast("string"), F.lit("?utm_source=a#b")).alias("url"), none.alias("canonical_url"), F.lit(None).cast("timestamp").alias("published_at"),
        none.alias("kind"), none.alias("form_type"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("array<string>").alias("related_tickers"),
    )
    found = lanes.watchlist(items, [lanes.Subject(query="the"), lanes.Subject(company="die", ticker="DIE")])
    return found.select("subject", url.normalize_url(F.col("url")).alias("url"), F.array_join("providers", ",").alias("providers"))


@query("provider_statuses", "select event_type as provider, count(*) as items, case when event_type = 'click' then 'error' when event_type = 'view' then 'disabled' else 'ok' end as status from events group by 1 union all select 'gone', 0, 'unsupported' union all select 'quiet', 0, 'empty'")
def provider_statuses(spark, sf_dir):
    items = read(spark, sf_dir, "events").select(F.col("event_type").alias("provider"))
    known = items.distinct().select("provider", F.lit(True).alias("supported"), F.when(F.col("provider") == "click", "http").when(F.col("provider") == "view", "config").alias("error_code"))
    more = spark.createDataFrame([("gone", False, None), ("quiet", True, None)], "provider string, supported boolean, error_code string")
    return lanes.provider_status(items, known.unionByName(more)).select("provider", "items", "status")


@query(
    "areas_of_rings",
    "select s_suppkey, ((s_suppkey + 1) * 2)::double as area, ((s_suppkey + 1) / 2.0)::double as x, 1.0::double as y from supplier",
)
def areas_of_rings(spark, sf_dir):
    """The signed area of a rectangle and its middle."""
    w = (F.col("s_suppkey") + 1).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(w, F.lit(0.0)), corner(w, F.lit(2.0)), corner(F.lit(0.0), F.lit(2.0)))
    c = lanes.ring_centroid(ring)
    return read(spark, sf_dir, "supplier").select("s_suppkey", c["area"].alias("area"), c["x"].alias("x"), c["y"].alias("y"))
