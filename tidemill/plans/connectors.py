"""Queries on JSON connectors: each reads payloads in its publisher's shape that were written from the suppliers, with some records
that have to be left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.plans.payloads import long, long_sql, records
from tidemill.plans.registry import query, read
from tidemill.sources.json_records import connect

def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def shape(**fields: Column) -> Column:
    return F.struct(*(v.alias(n) for n, v in fields.items()))


def thousandths(c: str) -> Column:
    return F.floor(F.col(c) * 1000 + 0.5).cast("long")


def run(spark, sf_dir, cases: list[tuple]):
    """The union of (provider, where the records lie, a record, what tells records apart, columns to compare)."""
    out = None
    supplier = read(spark, sf_dir, "supplier")
    for provider, at, record, own, columns in cases:
        found = connect(spark, provider, records(supplier, "s_suppkey", record, at))
        one = long(found, provider, own, **columns)
        out = one if out is None else out.unionByName(one)
    return out


K_, T_ = "s_suppkey", "s_suppkey::varchar"
AT, SECONDS = "2024-01-02T03:04:05Z", "1704164645"
LINK_ = f"'https://x.example/' || {T_}"


def cols() -> tuple[Column, Column, Column, Column]:
    """A supplier's key, name, key as text, and link."""
    key = F.col("s_suppkey")
    return key, F.col("s_name"), key.cast("string"), text("https://x.example/", key.cast("string"))



def _news() -> list[tuple]:
    K, N, T, LINK = cols()  # noqa: N806
    return [
    ("hacker-news", ("hits",), shape(title=F.when(K % 7 != 0, N), url=F.when(K % 2 == 0, LINK), objectID=T, created_at=F.lit(AT)), "id", dict(title="title", url="url", published=F.unix_seconds("published"))),
    ("tickertick", ("stories",), shape(title=N, url=LINK, site=F.when(K % 3 == 0, "GlobeNewswire"), time=K * 1000, tickers=F.array(text("b", (K % 3).cast("string")), F.lit("a"), text("B", (K % 3).cast("string")))), "url", dict(source="source", kind="kind", published=F.unix_seconds("published"), tickers=F.array_join("related_tickers", ","))),
    ("yahoo-search", ("news",), shape(title=N, link=F.when(K % 4 != 0, LINK), publisher=F.lit("p"), providerPublishTime=K), "url", dict(title="title", published=F.unix_seconds("published"))),
    ("gdelt", ("articles",), shape(title=N, url=LINK, domain=F.lit("d"), seendate=F.lit("20240102T030405Z"), language=F.lit("English")), "url", dict(title="title", published=F.unix_seconds("published"), lang="lang")),
    ("federal-register", ("results",), shape(title=N, html_url=LINK, type=F.when(K % 2 == 0, "Rule"), publication_date=F.lit("2024-01-02"), agencies=F.array(shape(name=text("Agency ", T)))), "url", dict(title="title", source="source", published=F.unix_seconds("published"))),
    ("sec-fulltext", ("hits", "hits"), shape(_id=F.when(K % 5 != 0, text("acc:f", T, ".htm")).otherwise("acc"), _source=shape(adsh=text("0001-24-", T), ciks=F.array(text("000", T)), form=F.when(K % 2 == 0, "8-K"), display_names=F.array(text(N, " (CIK 000", T, ")")), xsl=F.when(K % 3 == 0, "x1"))), "accession", dict(cik="cik", title="title", url="url")),
    ("msrb-emma", ("data",), shape(IssuerName=N, SubmissionId=text("m", T), PostingDate=F.lit("/Date(1704164645000)/")), "id", dict(issuer="issuer")),
    ("who-outbreaks", ("value",), shape(Title=N, ItemDefaultUrl=text("/item/", T), PublicationDate=F.lit(AT)), "url", dict(title="title")),
]


_NEWS_SQL = [
    long_sql("hacker-news", T_, f"supplier where {K_} % 7 <> 0", title="s_name", url=f"case when {K_} % 2 = 0 then {LINK_} else 'https://news.ycombinator.com/item?id=' || {T_} end", published=SECONDS),
    long_sql("tickertick", LINK_, "supplier", source=f"case when {K_} % 3 = 0 then 'GlobeNewswire' else 'TickerTick' end", kind=f"case when {K_} % 3 = 0 then 'press-release' else 'article' end", published=K_, tickers=f"'A,B' || ({K_} % 3)::varchar"),
    long_sql("yahoo-search", LINK_, f"supplier where {K_} % 4 <> 0", title="s_name", published=K_),
    long_sql("gdelt", LINK_, "supplier", title="s_name", published=SECONDS, lang="'English'"),
    long_sql("federal-register", LINK_, "supplier", title=f"case when {K_} % 2 = 0 then 'Rule: ' else '' end || s_name", source=f"'Agency ' || {T_}", published="1704153600"),
    long_sql("sec-fulltext", f"'0001-24-' || {T_}", f"supplier where {K_} % 5 <> 0", cik=T_, title=f"case when {K_} % 2 = 0 then '8-K - ' else '' end || s_name", url=f"'https://www.sec.gov/Archives/edgar/data/' || {T_} || '/000124' || {T_} || '/' || case when {K_} % 3 = 0 then 'x1/' else '' end || 'f' || {T_} || '.htm'"),
    long_sql("msrb-emma", f"'m' || {T_}", "supplier", issuer="s_name"),
    long_sql("who-outbreaks", f"'/item/' || {T_}", "supplier", title="s_name"),
]


@query("connectors_news", " union all ".join(_NEWS_SQL))
def connectors_news(spark, sf_dir):
    return run(spark, sf_dir, _news())


def _research() -> list[tuple]:
    K, N, T, LINK = cols()  # noqa: N806
    return [
    ("openalex", ("results",), shape(id=text("W", T), title=N, doi=F.when(K % 2 == 0, text("https://doi.org/10.1/", T)), primary_location=shape(landing_page_url=F.when(K % 3 == 0, LINK)), abstract_inverted_index=F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0)), F.lit("c"), F.array(F.lit(2)))), "id", dict(url="url", canonical="canonical", abstract="abstract")),
    ("crossref", ("message", "items"), shape(DOI=text("10.1/", (K % 3).cast("string")), title=F.array(N), URL=LINK), "doi", dict(title="title")),
    ("biorxiv", ("collection",), shape(doi=text("10.2/", T), title=N, version=F.when(K % 4 == 0, "x").otherwise("2"), server=F.lit("biorxiv"), category=F.lit("c")), "doi", dict(version="version_number")),
    ("europe-pmc", ("resultList", "result"), shape(source=F.lit("MED"), id=T, title=N, pubYear=F.lit("2024"), firstPublicationDate=F.lit("2024-01-02")), "id", dict(year="year_text", published="published_at")),
    ("osf", ("data",), shape(id=T, attributes=shape(title=N, date_published=F.lit(AT)), links=shape(html=F.when(K % 4 != 0, LINK))), "id", dict(title="title", url="url")),
    ("nber", ("results",), shape(title=N, url=text("/papers/w", T), authors=F.array(F.lit("A"), F.lit("B"))), "url", dict(title="title", authors=F.array_join("authors", ";"))),
    ("ssrn", ("papers",), shape(id=F.when(K % 5 == 0, -K).otherwise(K), title=N, url=LINK, approved_date=F.lit("02 Jan 2024")), "id", dict(title="title")),
    ("hf-papers", (), shape(paper=shape(id=F.when(K % 5 == 0, text("bad", T)).otherwise(text("2401.", F.lpad(T, 5, "0"))), title=N)), "id", dict(title="title", canonical="canonical")),
    ("open-library", ("docs",), shape(key=text("/works/", T), title=N, ebook_access=F.when(K % 3 == 0, "borrowable").when(K % 3 == 1, "no_ebook"), public_scan_b=K % 4 == 0, isbn=F.array(F.lit("1"))), "id", dict(availability="availability")),
    ("internet-archive", ("response", "docs"), shape(identifier=text("ia", T), title=N, mediatype=F.lit("texts")), "id", dict(title="title", mediatype="mediatype")),
    ("alphavantage", ("transcript",), shape(speaker=N, title=F.lit("t"), content=text("says ", T)), "speaker", dict(text="text")),
    ("hf-transcripts", ("rows",), shape(row=shape(symbol=N, year=F.lit(2024), quarter=(K % 4 + 1).cast("int"), content=F.repeat(F.lit("word "), (10 * (K % 9)).cast("int")), date=F.lit(AT))), "symbol", dict(quarter="quarter", size=F.length("summary"))),
]


_RESEARCH_SQL = [
    long_sql("openalex", f"'W' || {T_}", "supplier", url=f"case when {K_} % 3 = 0 then {LINK_} when {K_} % 2 = 0 then 'https://doi.org/10.1/' || {T_} else 'W' || {T_} end", canonical=f"case when {K_} % 2 = 0 then 'https://doi.org/10.1/' || {T_} when {K_} % 3 = 0 then {LINK_} end", abstract="'a b c b'"),
    long_sql("crossref", f"'10.1/' || ({K_} % 3)::varchar", f"(select * from supplier qualify row_number() over (partition by {K_} % 3 order by {K_}) = 1)", title="s_name"),
    long_sql("biorxiv", f"'10.2/' || {T_}", f"supplier where {K_} % 4 <> 0", version="2"),
    long_sql("europe-pmc", T_, "supplier", year="2024", published="'2024-01-02'"),
    long_sql("osf", T_, f"supplier where {K_} % 4 <> 0", title="s_name", url=LINK_),
    long_sql("nber", f"'/papers/w' || {T_}", "supplier", title="s_name", authors="'A;B'"),
    long_sql("ssrn", T_, f"supplier where {K_} % 5 <> 0", title="s_name"),
    long_sql("hf-papers", f"'2401.' || lpad({T_}, 5, '0')", f"supplier where {K_} % 5 <> 0", title="s_name", canonical=f"'https://arxiv.org/abs/2401.' || lpad({T_}, 5, '0')"),
    long_sql("open-library", f"'/works/' || {T_}", "supplier", availability=f"case when {K_} % 4 = 0 then 'public-domain' when {K_} % 3 = 0 then 'borrow' else 'metadata-only' end"),
    long_sql("internet-archive", f"'ia' || {T_}", "supplier", title="s_name", mediatype="'texts'"),
    long_sql("alphavantage", "s_name", "supplier", text=f"s_name || ': says ' || {T_}"),
    long_sql("hf-transcripts", "s_name", f"supplier where {K_} % 9 <> 0", quarter=f"{K_} % 4 + 1", size=f"case when 50 * ({K_} % 9) > 280 then 281 else 50 * ({K_} % 9) end"),
]


@query("connectors_research", " union all ".join(_RESEARCH_SQL))
def connectors_research(spark, sf_dir):
    return run(spark, sf_dir, _research())


def _data() -> list[tuple]:
    K, N, T, LINK = cols()  # noqa: N806
    return [
    ("fred", ("observations",), shape(date=F.lit("2024-01-02"), value=F.when(K % 5 == 0, ".").when(K % 7 == 0, "x").otherwise(T), realtime_start=F.when(K % 11 != 0, text("2024-02-", F.lpad((K % 28 + 1).cast("string"), 2, "0"))).otherwise("never"), realtime_end=F.lit("9999-12-31")), F.concat_ws("|", "value", "realtime_start"), dict(day="day", missing="known", number=thousandths("number"))),
    ("cot", (), shape(market_and_exchange_names=N, report_date_as_yyyy_mm_dd=F.lit("2024-01-02T00:00:00.000"), cftc_contract_market_code=T, open_interest_all=T, noncomm_positions_long_all=(K * 3).cast("string"), noncomm_positions_short_all=F.when(K % 6 != 0, T), comm_positions_long_all=T, comm_positions_short_all=T), "code", dict(net="net")),
    ("cdc-wastewater", (), shape(reporting_jurisdiction=N, date_end=F.lit("2024-01-02"), percentile=text(T, ".5"), ptc_15d=F.when(K % 2 == 0, " ").otherwise("-3")), "state", dict(percentile=thousandths("percentile"), ptc=thousandths("ptc"))),
    ("unhcr", ("items",), shape(year=F.lit(2023), coo_iso=F.when(K % 2 == 1, T), refugees=K, oip=F.when(K % 3 == 0, K), ooc=F.when(K % 5 == 0, F.lit(2))), "origin", dict(others=thousandths("others"))),
    ("usaspending", ("results",), F.struct(text("A", T).alias("Award ID"), N.alias("Recipient Name"), F.when(K % 4 != 0, text("G", T)).alias("generated_internal_id"), K.alias("Award Amount")), "award_id", dict(url="url", amount=thousandths("amount"))),
    ("grants-gov", ("data", "oppHits"), shape(id=T, number=T, title=N, openDate=F.lit("01/02/2024"), closeDate=F.when(K % 3 == 0, "13/45/2024").when(K % 3 == 1, "").otherwise("02/29/2024")), "id", dict(opens="opens", closes="closes")),
    ("cisa-kev", ("vulnerabilities",), shape(cveID=text("CVE-", T), vendorProject=N, product=N, vulnerabilityName=N, dateAdded=N, shortDescription=N, requiredAction=N, dueDate=N, knownRansomwareCampaignUse=F.when(K % 2 == 0, "Known").otherwise("Unknown"), notes=F.when(K % 9 != 0, N)), "cve", dict(ransomware="ransomware", url="url")),
    ("ioda", ("data",), shape(entity=shape(code=text("c", T), name=N), scores=shape(overall=K * 2.0)), "code", dict(score=thousandths("score"))),
    ("ooni", ("result",), shape(probe_cc=text("x", T), anomaly_count=K, measurement_count=F.when(K % 3 == 0, F.lit(0)).otherwise(K * 4)), "probe_cc", dict(rate=thousandths("rate"))),
    ("wikipedia-pageviews", ("items[]", "articles"), shape(article=F.when(K % 4 == 0, text("Special:", T)).otherwise(text("A_", T)), views=K, rank=K), "title", dict(views="views")),
    ("drought-monitor", (), F.struct(F.when(K % 2 == 0, "2024-01-02T00:00:00").alias("mapDate"), F.when(K % 2 == 1, F.when(K % 3 == 0, "20240231").otherwise("20240103")).alias("MapDate"), F.when(K % 2 == 0, K * 1.0).alias("d0"), F.when(K % 2 == 1, K * 1.0).alias("D0")), thousandths("d0"), dict(day="day")),
    ("carbon-intensity", ("data",), F.struct(text("f", T).alias("from"), text("t", T).alias("to"), shape(forecast=K, index=F.lit("low")).alias("intensity")), "from", dict(index="index", forecast=thousandths("forecast"))),
    ("hunger-map", ("body", "countries"), shape(country=shape(iso3=text("I", T), name=N), date=F.lit("2024-01-02"), metrics=shape(fcs=shape(people=K, prevalence=F.lit(0.25)))), "iso3", dict(people=thousandths("fcs_people"))),
]


_RT = f"'2024-02-' || lpad(({K_} % 28 + 1)::varchar, 2, '0')"
_DATA_SQL = [
    long_sql("fred", f"case when {K_} % 5 = 0 then '.' else {T_} end || '|' || {_RT}", f"supplier where {K_} % 11 <> 0 and ({K_} % 5 = 0 or {K_} % 7 <> 0)", day="'2024-01-02'", missing=f"{K_} % 5 = 0", number=f"case when {K_} % 5 <> 0 then {K_} * 1000 end"),
    long_sql("cot", T_, f"supplier where {K_} % 6 <> 0", net=f"{K_} * 2"),
    long_sql("cdc-wastewater", "s_name", "supplier", percentile=f"{K_} * 1000 + 500", ptc=f"case when {K_} % 2 = 1 then -3000 end"),
    long_sql("unhcr", T_, f"supplier where {K_} % 2 = 1", others=f"case when {K_} % 3 = 0 or {K_} % 5 = 0 then (case when {K_} % 3 = 0 then {K_} else 0 end + case when {K_} % 5 = 0 then 2 else 0 end) * 1000 end"),
    long_sql("usaspending", f"'A' || {T_}", f"supplier where {K_} % 4 <> 0", url=f"'https://www.usaspending.gov/award/G' || {T_}", amount=f"{K_} * 1000"),
    long_sql("grants-gov", T_, f"supplier where {K_} % 3 <> 0", opens="'2024-01-02'", closes=f"case when {K_} % 3 = 2 then '2024-02-29' end"),
    long_sql("cisa-kev", f"'CVE-' || {T_}", f"supplier where {K_} % 9 <> 0", ransomware=f"{K_} % 2 = 0", url=f"'https://nvd.nist.gov/vuln/detail/CVE-' || {T_}"),
    long_sql("ioda", f"'C' || {T_}", "supplier", score=f"{K_} * 2000"),
    long_sql("ooni", f"'X' || {T_}", "supplier", rate=f"case when {K_} % 3 <> 0 then 250 end"),
    long_sql("wikipedia-pageviews", f"'A ' || {T_}", f"supplier where {K_} % 4 <> 0", views=K_),
    long_sql("drought-monitor", f"{K_} * 1000", f"supplier where {K_} % 2 = 0 or {K_} % 3 <> 0", day=f"case when {K_} % 2 = 0 then '2024-01-02' else '2024-01-03' end"),
    long_sql("carbon-intensity", f"'f' || {T_}", "supplier", index="'low'", forecast=f"{K_} * 1000"),
    long_sql("hunger-map", f"'I' || {T_}", "supplier", people=f"{K_} * 1000"),
]


@query("connectors_data", " union all ".join(_DATA_SQL))
def connectors_data(spark, sf_dir):
    return run(spark, sf_dir, _data())


def _events() -> list[tuple]:
    K, N, T, LINK = cols()  # noqa: N806
    return [
    ("kalshi", ("markets",), shape(ticker=T, title=N, yes_bid_dollars=F.lit("0.4000"), yes_ask_dollars=F.when(K % 2 == 0, "0.6000").otherwise("0.0000"), notional_value_dollars=F.lit("1.0000")), "ticker", dict(probability=thousandths("probability"))),
    ("polymarket", (), shape(id=T, question=N, outcomePrices=F.when(K % 3 != 0, '["0.25", "0.75"]').otherwise("none")), "id", dict(probability=thousandths("probability"))),
    ("manifold", (), shape(id=T, question=N, probability=(K % 3) * 0.75, url=LINK, closeTime=K * 1000), "id", dict(probability=thousandths("probability"), closes=F.unix_seconds("closes"))),
    ("gdacs", ("features",), shape(properties=shape(eventid=K, eventtype=F.lit("fl"), alertlevel=F.when(K % 2 == 0, "Red").otherwise("Blue")), geometry=shape(coordinates=F.array(K * 0.5 + 179, F.lit(10.5)))), "event_id", dict(severity="severity", placed="placed")),
    ("nhc-storms", ("activeStorms",), shape(id=T, name=N, classification=F.when(K % 2 == 0, "hu").otherwise("TD"), intensity=F.when(K % 3 == 0, "100").otherwise("40"), latitude=F.lit("12.5N"), longitude=F.when(K % 5 == 0, "200W").otherwise("80.0W")), "id", dict(severity="severity", latitude=thousandths("latitude"), longitude=thousandths("longitude"))),
    ("nws-alerts", ("features",), shape(properties=shape(id=T, event=F.when(K % 2 == 0, "Flood Watch").otherwise("Wind"), severity=F.when(K % 3 == 0, "Extreme").otherwise("?"), headline=F.when(K % 2 == 0, " ").otherwise(N), areaDesc=F.lit("A &amp; B"))), "id", dict(title="title", severity="severity", flood="flood", area="area")),
    ("usgs-volcanoes", (), shape(vnum=T, volcano_name=N, alert_level=F.when(K % 2 == 0, "WATCH").otherwise("UNASSIGNED")), "number", dict(severity="severity")),
    ("safecast", (), shape(id=K, value=K * 1.5, unit=F.lit("cpm"), latitude=K * 1.0 - 5, longitude=F.when(K % 4 == 0, F.lit(999.0)).otherwise(F.lit(5.0))), "id", dict(value=thousandths("value"), severity="severity")),
    ("wikipedia-congress-recent", ("query", "recentchanges"), shape(title=F.when(K % 2 == 0, "U.S. Senate and H.R. 12").otherwise(N), revid=K, user=N, comment=F.when(K % 3 == 0, "congressional committee"), type=F.when(K % 5 == 0, "log").otherwise("edit"), bot=K % 7 == 0), "revision", dict(signals=F.array_join("signals", ","))),
    ("tfl-cameras", (), shape(id=T, commonName=N, lat=K * 0.5, lon=F.lit(1.5)), "id", dict(name="name", latitude=thousandths("latitude"))),
]


_EVENTS_SQL = [
    long_sql("kalshi", T_, "supplier", probability=f"case when {K_} % 2 = 0 then 500 else 400 end"),
    long_sql("polymarket", T_, f"supplier where {K_} % 3 <> 0", probability="250"),
    long_sql("manifold", T_, "supplier", probability=f"least(1000, ({K_} % 3) * 750)", closes=K_),
    long_sql("gdacs", f"'gdacs-FL-' || {T_}", "supplier", severity=f"case when {K_} % 2 = 0 then 'extreme' else 'unknown' end", placed=f"{K_} * 0.5 + 179 <= 180"),
    long_sql("nhc-storms", T_, "supplier", severity=f"case when {K_} % 3 = 0 then 'extreme' when {K_} % 2 = 0 then 'severe' else 'minor' end", latitude="12500", longitude=f"case when {K_} % 5 <> 0 then -80000 end"),
    long_sql("nws-alerts", T_, "supplier", title=f"case when {K_} % 2 = 0 then 'Flood Watch' else s_name end", severity=f"case when {K_} % 3 = 0 then 'extreme' else 'unknown' end", flood=f"{K_} % 2 = 0", area="'A & B'"),
    long_sql("usgs-volcanoes", T_, "supplier", severity=f"case when {K_} % 2 = 0 then 'severe' else 'unknown' end"),
    long_sql("safecast", T_, f"supplier where {K_} % 4 <> 0 and {K_} - 5 <= 90", value=f"{K_} * 1500", severity="'unknown'"),
    long_sql("wikipedia-congress-recent", T_, f"supplier where {K_} % 5 <> 0 and {K_} % 7 <> 0 and ({K_} % 2 = 0 or {K_} % 3 = 0)", signals=f"array_to_string(list_filter([case when {K_} % 3 = 0 then 'us-congress' end, case when {K_} % 2 = 0 then 'us-senate' end, case when {K_} % 3 = 0 then 'congressional-committee' end, case when {K_} % 2 = 0 then 'federal-legislation' end], lambda x: x is not null), ',')"),
    long_sql("tfl-cameras", T_, "supplier", name="s_name", latitude=f"{K_} * 500"),
]


@query("connectors_events", " union all ".join(_EVENTS_SQL))
def connectors_events(spark, sf_dir):
    return run(spark, sf_dir, _events())
