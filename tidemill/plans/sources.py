"""Queries on physical formats and publishers' tables: payloads are written from the fixture tables and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.operators import joins, lanes, ranges
from tidemill.plans import payloads
from tidemill.plans.registry import query, read
from tidemill.shared import shared_dir
from tidemill.sources import captured, formats, json_records, tables

_CELL = "case when c_custkey % 3 = 0 then c_name || ', \"' || c_mktsegment || '\"' when c_custkey % 3 = 1 then c_name || chr(10) || 'two' else c_name end"


@query("source_csv", f"select c_custkey::varchar as id, {_CELL} as name, case when c_custkey % 4 = 0 then '' else c_mktsegment end as segment from customer")
def source_csv(spark, sf_dir):
    """Quotes, doubled quotes, commas and line breaks inside cells; empty cells."""
    k, name = F.col("c_custkey"), F.col("c_name")
    cell = F.when(k % 3 == 0, F.concat(name, F.lit(', "'), "c_mktsegment", F.lit('"'))).when(k % 3 == 1, F.concat(name, F.lit("\ntwo"))).otherwise(name)
    path = shared_dir(spark)
    rows = read(spark, sf_dir, "customer").select(k.cast("string").alias("id"), cell.alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return formats.csv_table(spark, path)


_COUNTRIES = {"FR": "FR", "GM": "DE", "UK": "GB"}


@query(
    "source_conflict_events",
    """with e as (select *, o_orderkey % 2000 as n from orders), k as (select * from e where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 qualify row_number() over (partition by n order by o_orderkey) = 1)
    select 'gdelt-' || n::varchar as id, case o_orderkey % 3 when 0 then 'Fight' when 1 then 'Make Public Statement' else 'GDELT Event' end || case when o_orderkey % 2 = 0 then ' — Place & ' || o_orderstatus else '' end as title,
      case when o_orderkey % 4 = 0 and -(o_orderkey % 10) <= -7 then 'extreme' when o_orderkey % 4 = 0 then 'severe' when o_orderkey % 4 = 3 then 'moderate' else 'minor' end as severity, (-(o_orderkey % 10))::double as magnitude,
      case o_orderkey % 4 when 0 then 'FR' when 1 then 'DE' when 2 then 'GB' end as country, case when o_orderkey % 5 <> 0 then o_orderkey % 90 * 1.0 end::double as latitude from k""",
)
def source_conflict_events(spark, sf_dir):
    """61 positional columns; short rows, rows at (0, 0) and repeated ids are left out."""
    k = F.col("o_orderkey")
    cells = {i: F.lit("") for i in range(61)}
    cells |= {0: (k % 2000).cast("string"), 26: F.lit("190"), 28: F.when(k % 3 == 0, "19").when(k % 3 == 1, "1").otherwise("99"), 29: F.when(k % 4 == 0, "4").otherwise((k % 4).cast("string")), 30: (-(k % 10)).cast("string")}
    cells |= {52: F.when(k % 2 == 0, F.concat(F.lit("Place &amp; "), "o_orderstatus")).otherwise(""), 53: F.get(F.array(*map(F.lit, ("fr", "GM", "UK", "ZZ"))), (k % 4).cast("int"))}
    cells |= {56: F.when(k % 13 == 0, "0").when(k % 5 == 0, "95").otherwise((k % 90).cast("string")), 57: F.when(k % 13 == 0, "0").otherwise("5"), 60: F.lit("https://x.example/e")}
    line = F.when(k % 11 == 0, F.lit("short\trow")).otherwise(F.concat_ws("\t", *(cells[i] for i in range(61))))
    rows = read(spark, sf_dir, "orders").orderBy("o_orderkey")
    path = payloads.lines(rows, line, files=1)
    return tables.conflict_events(spark, path, _COUNTRIES).select("id", "title", "severity", "magnitude", "country", "latitude")


@query("source_loans", "select 2000 + o_orderkey % 30 as activity_year, 'L' || o_custkey::varchar as lei, case when o_orderkey % 9 between 1 and 8 then o_orderkey % 9 end::int as action_taken, case when o_orderkey % 5 <> 0 then round(o_totalprice)::double end as loan_amount, o_orderstatus as state from orders")
def source_loans(spark, sf_dir):
    """Pipe-separated loans; numbers out of bounds are null."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select((2000 + k % 30).cast("string").alias("activity_year"), F.concat(F.lit("L"), F.col("o_custkey").cast("string")).alias("lei"), (k % 9).cast("string").alias("action_taken"), F.when(k % 5 == 0, "Exempt").otherwise(F.round("o_totalprice").cast("decimal(20,0)").cast("string")).alias("loan_amount"), F.col("o_orderstatus").alias("state"))
    path = shared_dir(spark)
    rows.write.option("header", True).option("sep", "|").csv(path)
    return tables.loans(spark, path).select(F.col("activity_year").cast("long").alias("activity_year"), "lei", "action_taken", "loan_amount", "state")


_LAYOUTS = {"A": [("key", 2, 8), ("flag", 10, 1), ("amount", 11, 12)], "N": [("key", 2, 8), ("year", 10, 4)]}


@query("source_fixed_width", "select case when l_linenumber % 2 = 0 then 'A' else 'N' end as type, l_orderkey as key, case when l_linenumber % 2 = 0 then floor(l_extendedprice)::bigint else year(l_shipdate) end as number, count(*) as n from lineitem group by 1, 2, 3")
def source_fixed_width(spark, sf_dir):
    """Two record types of other lengths, told apart by their first character."""
    key = F.lpad(F.col("l_orderkey").cast("string"), 8, "0")
    a = F.concat(F.lit("A"), key, "l_returnflag", F.lpad(F.floor("l_extendedprice").cast("string"), 12, " "))
    n = F.concat(F.lit("N"), key, F.year("l_shipdate").cast("string"))
    path = payloads.lines(read(spark, sf_dir, "lineitem"), F.when(F.col("l_linenumber") % 2 == 0, a).otherwise(n))
    found = formats.fixed_width(spark.read.text(path), _LAYOUTS, (1, 1))
    rows = found["A"].select(F.lit("A").alias("type"), "key", F.col("amount").alias("number")).unionByName(found["N"].select(F.lit("N").alias("type"), "key", F.col("year").alias("number")))
    return rows.groupBy("type", F.col("key").cast("long").alias("key"), F.col("number").cast("long").alias("number")).agg(F.count("*").alias("n"))


@query(
    "source_caret",
    """select s_suppkey::varchar as filer, 'BHCK0010=' || (s_suppkey * 7)::varchar || case when s_suppkey % 3 <> 0 then ';TEXT0001=' || s_name || chr(10) || 'more' else '' end as cells from supplier""",
)
def source_caret(spark, sf_dir):
    """Caret-separated rows whose cells hold line breaks, long, and only wanted codes folded to a map."""
    k = F.col("s_suppkey")
    row = F.concat_ws("^", k.cast("string"), F.when(k % 3 != 0, F.concat("s_name", F.lit("\nmore"))).otherwise(""), (k * 7).cast("string"), F.lit("x"))
    every = read(spark, sf_dir, "supplier").groupBy((k % 2).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    path = payloads.bodies(every, F.concat(F.lit("RSSD9001^TEXT0001^BHCK0010^RSSD9017\n"), "rows"))
    cells = formats.caret_records(spark, path)
    names = cells.where("code = 'RSSD9001'").select("file", "row", F.col("value").alias("filer"))
    wide = joins.folded(cells.join(names, ["file", "row"]), ["filer"], "code", "value", ["BHCK0010", "TEXT0001"])
    entries = F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return wide.select("filer", F.array_join(entries, ";").alias("cells"))


def _zipped(df, name: str):
    """(name, content) of archives with one file for each row (member, text) of a group g."""

    def pack(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in sorted(zip(table.column("member").to_pylist(), table.column("text").to_pylist(), strict=True)):
                z.writestr(member, text)
        return pa.table({"name": [f"{name}{table.column('g')[0].as_py()}"], "content": pa.array([out.getvalue()], pa.binary())})

    return df.select(F.col("g").cast("string").alias("g"), "member", "text").groupBy("g").applyInArrow(pack, "name string, content binary")


@query(
    "source_trades_zip",
    """with t as (select *, bool_or(l_linenumber = 1) over (partition by l_orderkey) as has_first from lineitem where l_orderkey % 7 = 0),
    l as (select 'T' || l_orderkey::varchar || '-' || case when has_first then 1 else l_linenumber end::varchar as lineage_id, l_shipdate from t)
    select lineage_id, count(*) as n, strftime(max(l_shipdate), '%Y-%m-%d') as latest from l group by 1""",
)
def source_trades_zip(spark, sf_dir):
    """Archives of trade tables; amendments name the first trade of their lineage."""
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    own = F.concat(F.lit("T"), k, F.lit("-"), n.cast("string"))
    items = read(spark, sf_dir, "lineitem").where("l_orderkey % 7 = 0")
    firsts = items.where("l_linenumber = 1").select("l_orderkey", F.lit(True).alias("has_first")).distinct()
    items = items.join(firsts, "l_orderkey", "left")
    original = F.when(F.col("has_first") & (n > 1), F.concat(F.lit("T"), k, F.lit("-1"))).otherwise("")
    line = F.concat_ws(",", own, original, F.lit("NEWT"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit('"Under, lier"'))
    text = items.groupBy((F.col("l_orderkey") % 3).alias("g"), (F.col("l_orderkey") % 2).alias("m")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    head = "Dissemination Identifier,Original Dissemination Identifier,Action type,Event timestamp,UPI Underlier Name\n"
    path = payloads.binaries(_zipped(text.select("g", F.concat(F.lit("t"), F.col("m").cast("string"), F.lit(".csv")).alias("member"), F.concat(F.lit(head), "rows").alias("text")), "trades"))
    entries = formats.read_zip(spark, path).where("name like '%.csv'")
    unpacked = payloads.bodies(entries, F.col("content").cast("string"))
    rows = tables.trades(formats.csv_table(spark, unpacked))
    return rows.groupBy("lineage_id").agg(F.count("*").alias("n"), F.max("event_at").alias("latest"))


@query("source_xlsx", "select 'Sheet ' || (s_nationkey % 2)::varchar as sheet, s_suppkey as \"row\", 28 as \"column\", s_name as value from supplier union all select 'Sheet ' || (s_nationkey % 2)::varchar, s_suppkey, 1, s_suppkey::varchar from supplier")
def source_xlsx(spark, sf_dir):
    """Workbooks with shared strings and numbers; cells of column AB and A."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        for b in batches:
            for g, rows in zip(b.column("g").to_pylist(), b.column("rows").to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet {g}" r:id="r1"/></sheets></workbook>')
                    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
                    z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{r['s_name']}</t></si>" for r in rows) + "</sst>")
                    cells = "".join(f'<row><c r="A{r["s_suppkey"]}"><v>{r["s_suppkey"]}</v></c><c r="AB{r["s_suppkey"]}" t="s"><v>{i}</v></c></row>' for i, r in enumerate(rows))
                    z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
                yield pa.record_batch([[f"{g}.xlsx"], pa.array([out.getvalue()], pa.binary())], names=["name", "content"])

    books = read(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 2).alias("g")).agg(F.collect_list(F.struct("s_suppkey", "s_name")).alias("rows"))
    path = payloads.binaries(books.mapInArrow(pack, "name string, content binary"))
    return formats.read_xlsx(spark, path).select("sheet", F.col("row").cast("long").alias("row"), "column", "value")


@query(
    "source_feeds",
    """select 'feed' as provider, 'feed|g' || s_suppkey::varchar || '|' || s_name || ' & the market' as id, s_name || ' & the market' as title, 'https://x.example/' || s_suppkey::varchar as url, 1704164645 + case when s_nationkey % 2 = 0 then 0 else 86400 end as published,
      case when s_nationkey % 2 = 1 then 'article' when s_suppkey % 4 = 0 then 'press-release' else 'article' end as kind, case when s_nationkey % 2 = 1 then '10-K' end as form_type from supplier where s_suppkey % 5 <> 0""",
)
def source_feeds(spark, sf_dir):
    """RSS and Atom feeds that are read whole and filtered here; items without a safe link are dropped."""
    k, t = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    title = F.concat(F.lit("<title><![CDATA["), "s_name", F.lit(" &amp; the market]]></title>"))
    link = F.when(k % 5 == 0, "javascript:x").otherwise(F.concat(F.lit("https://x.example/"), t))
    rss = F.concat(F.lit("<item>"), title, F.lit("<link>"), link, F.lit("</link><guid>g"), t, F.lit("</guid><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>"), F.when(k % 4 == 0, F.lit("<source>Business Wire</source>")).otherwise(""), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), title, F.lit('<link rel="self" href="https://x.example/self"/><link rel="alternate" href="'), link, F.lit('"/><id>g'), t, F.lit('</id><updated>2024-01-03T03:04:05Z</updated><category term="10-K"/></entry>'))
    odd = F.col("s_nationkey") % 2
    every = read(spark, sf_dir, "supplier").groupBy(odd.alias("g")).agg(F.array_join(F.collect_list(F.when(odd == 0, rss).otherwise(atom)), "").alias("x"))
    body = F.when(F.col("g") == 0, F.concat(F.lit('<rss version="2.0"><channel>'), "x", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "x", F.lit("</feed>")))
    items = formats.read_feed(spark, payloads.bodies(every, body)).withColumn("title", F.replace("title", F.lit("&amp;"), F.lit("&")))
    found = tables.feed_news(items, "feed", None, lanes.Subject(query="the MARKET"))
    return found.select("provider", "id", "title", "url", F.unix_seconds("published_at").alias("published"), "kind", "form_type")


@query(
    "source_news_table",
    """select c_nationkey as page, 'https://x.example/' || c_custkey::varchar as url, c_name as title, case when c_custkey % 2 = 0 then 'Zacks' else 'Finviz' end as source, case when c_custkey % 2 = 0 then 'analysis' else 'article' end as kind,
      epoch(timestamp '2024-01-02 14:30:00')::bigint + 86400 * least(2, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 3) as published from customer""",
)
def source_news_table(spark, sf_dir):
    """A table in which only every third row has a date, and rows between have the time of day alone."""
    customer = read(spark, sf_dir, "customer")
    ordered = customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))

    def row(r, i):
        day = F.least(F.floor(i / 3), F.lit(2)) + 2
        at = F.when((i % 3 == 0) & (i < 9), F.concat(F.lit("Jan-0"), day.cast("string"), F.lit("-24 09:30AM"))).otherwise("09:30AM")
        source = F.when(r["c_custkey"] % 2 == 0, "<span>(Zacks)</span>").otherwise("")
        return F.concat(F.lit('<tr><td align="right">'), at, F.lit('</td><td><a href="https://x.example/'), r["c_custkey"].cast("string"), F.lit('">'), r["c_name"], F.lit("</a>"), source, F.lit("</td></tr>"))

    pages = ordered.select(F.col("c_nationkey").alias("page"), F.array_join(F.transform("rows", row), "").alias("html"))
    found = tables.news_table(pages, "html", "page")
    return found.select("page", "url", "title", "source", "kind", F.unix_seconds("published").alias("published"))


@query("source_actions", "select s_name as title, 'https://base.example/recent/202401' || lpad((s_suppkey % 28 + 1)::varchar, 2, '0') || '_' || s_suppkey::varchar as url, make_date(2024, 1, (s_suppkey % 28 + 1)::int) as day from supplier")
def source_actions(spark, sf_dir):
    """A listing in which each action has a titled link and one without a title; relative links."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/recent/202401"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("_"), k.cast("string"))
    link = F.concat(F.lit('<a href="'), path, F.lit('">&gt;</a><a class="t" href="'), path, F.lit('">'), "s_name", F.lit("</a>"))
    pages = read(spark, sf_dir, "supplier").groupBy((k % 2).alias("page")).agg(F.array_join(F.collect_list(link), " ").alias("html"))
    return tables.listed_actions(pages, "html", "page", "https://base.example/list/all?x=1")


@query(
    "source_airports",
    """select 'faa-status|' || case s_suppkey % 3 when 0 then 'Ground_Stop' when 1 then 'Ground_Delay' else 'Airport_Closure' end || '|A' || s_suppkey::varchar || '|low clouds & rain' as id,
      'A' || s_suppkey::varchar || case s_suppkey % 3 when 0 then ' ground stop' when 1 then ' ground delay' else ' airport closure' end as title, case s_suppkey % 3 when 0 then 'severe' when 1 then 'moderate' else 'extreme' end as severity,
      'low clouds & rain' || case when s_suppkey % 3 = 1 then '. Average delay: 10 minutes' else '' end as summary from supplier""",
)
def source_airports(spark, sf_dir):
    """Status sections of three kinds, each twice."""
    k = F.col("s_suppkey")
    tag = F.when(k % 3 == 0, "Ground_Stop").when(k % 3 == 1, "Ground_Delay").otherwise("Airport_Closure")
    one = F.concat(F.lit("<"), tag, F.lit("><ARPT>a"), k.cast("string"), F.lit("</ARPT><Reason>low clouds &amp; rain</Reason>"), F.when(k % 3 == 1, F.lit("<Avg>10 minutes</Avg>")).otherwise(""), F.lit("</"), tag, F.lit(">"))
    body = read(spark, sf_dir, "supplier").agg(F.concat(F.lit("<AIRPORT_STATUS_INFORMATION>"), F.array_join(F.collect_list(F.concat(one, one)), ""), F.lit("</AIRPORT_STATUS_INFORMATION>")).alias("xml"))
    return tables.airport_events(body, "xml").select("id", "title", "severity", "summary")


@query("source_sondes", "select 'S' || user_id::varchar as serial, epoch(max(date_trunc('second', ts)))::bigint as at, max(event_id) filter (where true) is not null as known from events group by 1")
def source_sondes(spark, sf_dir):
    """The newest frame of each serial of {serial: {time: frame}}."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    frame = F.concat(F.lit('"'), at, F.lit('":{"lat":'), (F.col("event_id") % 90).cast("string"), F.lit(',"lon":5,"alt":100}'))
    by = read(spark, sf_dir, "events").groupBy("user_id", at.alias("at")).agg(F.first(frame).alias("frame"))
    serials = by.groupBy("user_id").agg(F.array_join(F.collect_list("frame"), ",").alias("x"))
    body = serials.groupBy((F.col("user_id") % 3).alias("g")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"S'), F.col("user_id").cast("string"), F.lit('":{'), "x", F.lit("}"))), ","), F.lit("}")).alias("text"))
    frames = tables.latest_frames(json_records.payloads(spark, payloads.bodies(body, F.col("text"))))
    return frames.select("serial", F.unix_seconds("at").alias("at"), F.col("latitude").isNotNull().alias("known"))


@query(
    "source_chart",
    """with d as (select event_type as symbol, date_trunc('day', ts) as day, floor(avg(value)) as close, count(*) as n from events group by 1, 2), l as (select symbol, arg_max(close, day) filter (where n % 2 = 0) as last, count(*) as bars from d group by 1)
    select symbol, last::double as price, (last - 50)::double as change, floor((last - 50) / 50 * 100 * 1000 + 0.5)::bigint as percent, bars, (select count(*) from d where d.symbol = l.symbol and n % 2 = 0) as closes from l""",
)
def source_chart(spark, sf_dir):
    """Bars from parallel arrays with nulls between; the change of the last close there is."""
    daily = read(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.floor(F.avg("value")).alias("close"), F.count("*").alias("n"))
    rows = daily.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds("day").alias("t"), F.when(F.col("n") % 2 == 0, F.col("close").cast("string")).otherwise("null").alias("c")))).alias("x"))
    part = lambda name: F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e[name].cast("string")), ","), F.lit("]"))
    text = F.concat(F.lit('{"chart":{"result":[{"meta":{"chartPreviousClose":50},"timestamp":'), part("t"), F.lit(',"indicators":{"quote":[{"close":'), part("c"), F.lit("}]}}]}}"))
    found = tables.chart(rows.select(F.col("event_type").alias("symbol"), text.alias("text")))
    return found.select("symbol", "price", "change", F.floor(F.col("percent") * 1000 + 0.5).cast("long").alias("percent"), F.size("bars").cast("long").alias("bars"), F.size(F.filter("bars", lambda b: b["close"].isNotNull())).cast("long").alias("closes"))


@query(
    "source_flood",
    """with d as (select event_type as basin, ts::date as day, floor(sum(value)) as flow from events group by 1, 2), p as (select * from d where day < date '2024-01-20' qualify row_number() over (partition by basin order by day desc) <= 31),
    f as (select * from d where day >= date '2024-01-20' qualify row_number() over (partition by basin order by day) <= 31), u as (select basin, quantile_cont(flow, 0.5) as usual from p group by 1), k as (select basin, max(flow) as peak from f group by 1)
    select basin, peak::double as peak, case when peak / usual >= 3 then 'extreme' when peak / usual >= 2 then 'severe' when peak / usual >= 1.5 then 'moderate' else 'minor' end as severity from k join u using (basin)""",
)
def source_flood(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("basin"), F.to_date("ts").alias("day")).agg(F.floor(F.sum("value")).cast("double").alias("flow"))
    return tables.flood_outlook(daily, "basin", "day", "flow", F.lit("2024-01-20").cast("date")).select("basin", "peak", "severity")


_SEASONS = "['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ']"


@query(
    "source_ocean_index",
    f"""select {_SEASONS}[(p_partkey % 12 + 1)::int] as season, last_day(make_date((1950 + p_partkey % 70)::int, (p_partkey % 12 + 1)::int, 1)) as as_of, ((p_partkey % 31 - 15) * 100)::bigint as anomaly,
      case when p_partkey % 31 - 15 >= 5 then 'el-nino' when p_partkey % 31 - 15 <= -5 then 'la-nina' else 'neutral' end as phase from part where p_partkey % 10 <> 0""",
)
def source_ocean_index(spark, sf_dir):
    """Columns set apart by spaces, with comments and lines of another width."""
    from tidemill.functions.dates import SEASONS

    k = F.col("p_partkey")
    tenths = k % 31 - 15
    anomaly = F.concat(F.when(tenths < 0, "-").otherwise(""), F.floor(F.abs(tenths) / 10).cast("string"), F.lit("."), (F.abs(tenths) % 10).cast("string"))
    line = F.concat_ws("  ", F.lit(""), F.get(F.array(*map(F.lit, SEASONS)), (k % 12).cast("int")), (1950 + k % 70).cast("string"), F.lit("26.1"), anomaly)
    path = payloads.lines(read(spark, sf_dir, "part"), F.when(k % 20 == 0, "# comment").when(k % 10 == 0, "SEAS YR").otherwise(line))
    found = tables.ocean_index(spark.read.text(path), "value")
    return found.select("season", "as_of", F.round(F.col("anomaly") * 1000).cast("long").alias("anomaly"), "phase")


@query("source_monthly", "select 1900 + n_nationkey as year, m as month, last_day(make_date((1900 + n_nationkey)::int, m::int, 1)) as as_of, case when (n_nationkey + m) % 5 <> 0 then (n_nationkey * 10 + m)::bigint end as anomaly from nation, range(1, 13) r(m)")
def source_monthly(spark, sf_dir):
    """A column for each month, twelve rows a year, missing values as asterisks."""
    from tidemill.functions.dates import MONTHS

    k = F.col("n_nationkey")
    cells = [F.when((k + m) % 5 == 0, "***").otherwise((k * 10 + m).cast("string")).alias(name.capitalize()) for m, name in enumerate(MONTHS, 1)]
    wide = read(spark, sf_dir, "nation").select((1900 + k).cast("string").alias("Year"), *cells)
    found = tables.monthly_wide(wide, "Year")
    return found.select("year", F.col("month").cast("long").alias("month"), "as_of", F.col("anomaly").cast("long").alias("anomaly"))


@query(
    "source_exposures",
    """select s_suppkey as line, s_name as label, case when s_suppkey % 7 = 0 then 'total' else 'country' end as kind, 'Region ' || (s_suppkey // 5)::varchar as region, s_suppkey * 10 as amount from supplier where s_suppkey % 5 <> 0 and s_suppkey >= 5 and s_suppkey % 7 <> 0
    union all select s_suppkey, 'Total ' || s_name, 'total', 'Region ' || (s_suppkey // 5)::varchar, s_suppkey * 10 from supplier where s_suppkey % 5 <> 0 and s_suppkey >= 5 and s_suppkey % 7 = 0""",
)
def source_exposures(spark, sf_dir):
    """A label without an amount names the region of the rows below it."""
    k = F.col("s_suppkey")
    label = F.when(k % 5 == 0, F.concat(F.lit("Region "), F.floor(k / 5).cast("string"))).when(k % 7 == 0, F.concat(F.lit("Total "), "s_name")).otherwise(F.col("s_name"))
    sheet = read(spark, sf_dir, "supplier").where("s_suppkey >= 5").select(k.alias("line"), label.alias("label"), F.when(k % 5 != 0, k * 10).alias("amount"))
    return tables.exposures(sheet, "line", "label", "amount")


@query("source_sections", "select s_suppkey as line, 'part' || (s_suppkey // 4)::varchar as section, case when s_suppkey % 2 = 1 then 'label ' || s_name end as label, 'https://m' || s_suppkey::varchar || '.example' as url from supplier where s_suppkey % 4 <> 0 and s_suppkey >= 4")
def source_sections(spark, sf_dir):
    """A list with section heads, labels and repeated or unsafe addresses."""
    k = F.col("s_suppkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("[part"), F.floor(k / 4).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("https://m"), k.cast("string"), F.lit(".example"), F.when(k % 2 == 1, F.concat(F.lit(" # label "), "s_name")).otherwise("")))
    rows = read(spark, sf_dir, "supplier").where("s_suppkey >= 4").select(k.alias("line"), line.alias("text"))
    more = rows.select((F.col("line") + 1_000_000).alias("line"), "text").unionByName(rows.select((F.col("line") + 2_000_000).alias("line"), F.replace("text", F.lit("https:"), F.lit("http:")).alias("text")))
    return formats.sectioned_lines(rows.unionByName(more), "line", "text")


@query("source_captions", "select conv_id, turn, (turn * 1.5)::double as start, 2.0::double as duration, trim(regexp_replace(role, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') || ' & more' as text from conversations")
def source_captions(spark, sf_dir):
    """Timed text in seconds for even conversations, in milliseconds for odd ones."""
    t = F.col("turn")
    seconds = F.concat(F.lit('<text start="'), F.format_string("%.1f", t * 1.5), F.lit('" dur="2">'), "role", F.lit(" &amp;amp; more</text>"))
    millis = F.concat(F.lit('<p t="'), (t * 1500).cast("string"), F.lit('" d="2000">'), "role", F.lit(" &amp; more</p>"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("conv_id") % 2 == 0, seconds).otherwise(millis).alias("x")))).alias("x"))
    xml = F.array_join(F.transform("x", lambda e: e["x"]), "")
    found = rows.select("conv_id", F.transform("x", lambda e: e["turn"]).alias("turns"), formats.caption_segments(xml).alias("s"))
    both = found.select("conv_id", F.inline(F.arrays_zip("turns", "s")))
    return both.select("conv_id", F.col("turns").alias("turn"), F.col("s.start").alias("start"), F.col("s.duration").alias("duration"), F.col("s.text").alias("text"))


@query("source_decoding", "select s_suppkey, s_name || ' é€“' as single_byte, s_name || ' é' as strict, case when s_suppkey % 2 = 0 then 'a' || chr(65533) || 'b' else s_name end as lossy from supplier")
def source_decoding(spark, sf_dir):
    """Bytes of windows-1252 and of UTF-8, whole and broken."""
    name = F.col("s_name").cast("binary")
    single = F.concat(name, F.lit(bytes([0x20, 0xE9, 0x80, 0x93])))
    broken = F.when(F.col("s_suppkey") % 2 == 0, F.lit(b"a\xffb")).otherwise(name)
    return read(spark, sf_dir, "supplier").select("s_suppkey", formats.decoded(single, "windows-1252").alias("single_byte"), formats.decoded(F.concat(name, F.lit(" é".encode()))).alias("strict"), formats.decoded(broken, lossy=True).alias("lossy"))


@query("source_captured", "select 'p' || (o_orderkey % 3)::varchar as provider, strftime(o_orderdate, '%Y-%m-01') as as_of, count(*) as lines from orders where o_orderkey % 3 = 1 and o_orderdate >= timestamp '1996-01-01' and o_orderkey % 10 = 0 group by 1, 2")
def source_captured(spark, sf_dir):
    """The data source over captured payloads: filters on provider and date pick the files that are opened."""
    orders = read(spark, sf_dir, "orders").where("o_orderkey % 10 = 0")
    by = orders.groupBy((F.col("o_orderkey") % 3).alias("p"), F.date_format("o_orderdate", "yyyy-MM-01").alias("d")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), "\n").alias("text"))
    name = F.concat(F.lit("provider=p"), F.col("p").cast("string"), F.lit("/as_of="), "d", F.lit("/part.txt"))
    path = payloads.binaries(by.select(name.alias("name"), F.col("text").cast("binary").alias("content")))
    captured.register(spark)
    rows = spark.read.format("captured").option("path", path).load().where("provider = 'p1' and as_of >= '1996-01-01'")
    return rows.select("provider", "as_of", F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query(
    "checked_address_ranges",
    "select c_custkey, 10::bigint * 16777216 + (c_custkey % 256) * 65536 + (c_nationkey % 256) * 256 + 7 as number from customer",
)
def checked_address_ranges(spark, sf_dir):
    """Rows that have to lie in a range of their own label and to state their own number."""
    k = F.col("c_custkey")
    number = F.lit(10 * 16777216).cast("long") + (k % 256) * 65536 + F.col("c_nationkey") * 256 + 7
    ip = F.concat_ws(".", F.lit("10"), (k % 256).cast("string"), F.col("c_nationkey").cast("string"), F.lit("7"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip"), number.alias("stated"), F.when(k % 2 == 0, "house").otherwise("senate").alias("label"))
    nets = spark.createDataFrame([("house", 10 << 24, (11 << 24) - 1), ("senate", 0, 1 << 20), ("senate", 10 << 24, (11 << 24) - 1)], "label string, low long, high long")
    return ranges.checked_ranges(rows, nets, "ip", "stated", "label", "low", "high").select("c_custkey", "number")
