"""Records out of captured JSON payloads, by declared connectors.

A connector names the array in the payload, its fields, which of them a record can't do without, and the key by which
records are distinct, first wins. Fields are strict: a value of another type is absent, never converted. A payload with candidates
of which none is valid has drifted, which is an error for most publishers and an empty result for some.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import dates, severity
from tidemill.functions.classify import news_kind
from tidemill.functions.text import clean_text
from tidemill.operators import lanes
from tidemill.operators.merge import first_wins

_TYPES = {"string": ("STRING",), "long": ("BIGINT",), "double": ("DOUBLE", "BIGINT", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
_CASTS = {"string": "string", "long": "bigint", "double": "double", "boolean": "boolean"}


@dataclass(frozen=True)
class Connector:
    provider: str
    records: str
    fields: dict[str, tuple[str, str]]
    required: tuple[str, ...]
    key: tuple[str, ...] = ()
    drift: bool = True
    keyed: bool = False  # records is an object whose values are the records
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)  # computed one after another from what is there
    kept: Callable[[], Column] | None = None  # which of the valid records are of interest


def strict(value: Column, path: str, kind: str) -> Column:
    """The value at a path of a VARIANT if it has the kind; null otherwise. 'strings' gives the strings of an array."""
    if kind == "strings":
        items = F.try_variant_get(value, path, "array<variant>")
        return F.filter(F.transform(items, lambda x: strict(x, "$", "string")), lambda x: x.isNotNull())
    found = F.try_variant_get(value, path, "variant")
    schema = F.schema_of_variant(found)
    good = F.lit(False)
    for name in _TYPES[kind]:
        good = good | schema.startswith(name)
    return F.when(good, F.try_variant_get(value, path, _CASTS.get(kind, "variant")))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """file, text of each captured payload, each read whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_records(captured: DataFrame, connector: Connector) -> DataFrame:
    """The valid records with derived columns, distinct by key with the first in input order kept.

    A body that isn't JSON raises, and so does one whose records are all invalid, where that means that a publisher's format has
    changed; both when rows are read. Records are judged inside their payload, so nothing is grouped."""
    bad = lambda why: F.raise_error(F.concat(F.lit(f"{connector.provider}: {why} in "), F.col("file")))
    root = F.try_parse_json("text")
    entries = F.try_variant_get(root, connector.records, "map<string,variant>" if connector.keyed else "array<variant>")
    entries = F.map_values(entries) if connector.keyed else entries
    kinds = {n: k for n, (_, k) in connector.fields.items()}

    def record(item: Column, place: Column) -> Column:
        return F.struct(place.alias("pos"), *(strict(item, p, k).alias(n) for n, (p, k) in connector.fields.items()))

    def valid(r: Column) -> Column:
        out = F.lit(True)
        for n in connector.required:
            out = out & r[n].isNotNull() & ((F.trim(r[n]) != "") if kinds[n] == "string" else F.lit(True))
        return out

    rows = captured.select("file", F.when(root.isNull(), bad("no JSON")).otherwise(F.transform(entries, record)).alias("every"))
    rows = rows.select("file", "every", F.filter("every", valid).alias("good"))
    good = F.col("good")
    if connector.drift:
        good = F.when((F.size("every") > 0) & (F.size("good") == 0), bad("no valid record")).otherwise(good)
    rows = rows.select("file", F.inline(good)).withColumn("provider", F.lit(connector.provider))
    for name, value in connector.derived.items():
        rows = rows.withColumn(name, value())
    if connector.kept is not None:
        rows = rows.where(connector.kept())
    if connector.key:
        rows = first_wins(rows.withColumn("__seq", F.struct("file", "pos")), list(connector.key), "__seq").drop("__seq")
    return rows


def _c(provider: str, records: str, required: str, key: str = "", drift: bool = True, keyed: bool = False, **fields: str) -> Connector:
    """fields: name='$.path' for a string, name='long $.path' for another kind."""
    parsed = {n: (spec, "string") if spec.startswith("$") else (spec.split(" ", 1)[1], spec.split(" ", 1)[0]) for n, spec in fields.items()}
    return Connector(provider, records, parsed, tuple(required.split()), tuple(key.split()), drift, keyed)


# Where publishers put their records and fields.
CONNECTORS: dict[str, Connector] = {
    c.provider: c
    for c in (
        _c("sec-fulltext", "$.hits.hits", "id accession cik", drift=False, id="$._id", accession="$._source.adsh", cik="$._source.ciks[0]", form="$._source.form", name="$._source.display_names[0]", published_at="$._source.file_date"),
        _c("federal-register", "$.results", "title url", drift=False, title="$.title", url="$.html_url", summary="$.abstract", kind="$.type", published_at="$.publication_date", source="$.agencies[0].name"),
        _c("hacker-news", "$.hits", "title id", drift=False, title="$.title", url="$.url", id="$.objectID", author="$.author", published_at="$.created_at"),
        _c("tickertick", "$.stories", "title url", drift=False, title="$.title", url="$.url", source="$.site", published_ms="long $.time", related_tickers="strings $.tickers"),
        _c("yahoo-search", "$.news", "title url", drift=False, title="$.title", url="$.link", source="$.publisher", published_s="long $.providerPublishTime", related_tickers="strings $.relatedTickers"),
        _c("gdelt", "$.articles", "title url", drift=False, title="$.title", url="$.url", source="$.domain", published_at="$.seendate", lang="$.language"),
        _c("msrb-emma", "$.data", "issuer id", "id", drift=False, issuer="$.IssuerName", id="$.SubmissionId", published_at="$.PostingDate"),
        _c("hf-transcripts", "$.rows", "symbol year quarter content", drift=False, symbol="$.row.symbol", year="long $.row.year", quarter="long $.row.quarter", content="$.row.content", published_at="$.row.date"),
        _c("alphavantage", "$.transcript", "speaker content", speaker="$.speaker", title="$.title", content="$.content"),
        _c("openalex", "$.results", "id title", "id", id="$.id", title="$.title", doi="$.doi", landing="$.primary_location.landing_page_url", published_at="$.publication_date"),
        _c("crossref", "$.message.items", "doi title", "doi", doi="$.DOI", title="$.title[0]", url="$.URL", container="$['container-title'][0]"),
        _c("biorxiv", "$.collection", "doi title version", "doi version", doi="$.doi", title="$.title", version="$.version", server="$.server", category="$.category", summary="$.abstract", published_at="$.date"),
        _c("europe-pmc", "$.resultList.result", "source id title", "source id", source="$.source", id="$.id", title="$.title", authors="$.authorString", published_at="$.firstPublicationDate", year_text="$.pubYear"),
        _c("osf", "$.data", "id title url", "id", id="$.id", title="$.attributes.title", url="$.links.html", summary="$.attributes.description", published_at="$.attributes.date_published"),
        _c("nber", "$.results", "title url", "url", title="$.title", url="$.url", authors="strings $.authors", published_at="$.displaydate"),
        _c("ssrn", "$.papers", "id title url", "id", id="long $.id", title="$.title", url="$.url", published_at="$.approved_date"),
        _c("world-bank", "$.documents", "id title url", "id", keyed=True, id="$.id", title="$.display_title", url="$.url", published_at="$.docdt"),
        _c("hf-papers", "$", "id title", "id", id="$.paper.id", title="$.paper.title", summary="$.paper.summary", published_at="$.paper.publishedAt"),
        _c("who-outbreaks", "$.value", "title url", drift=False, title="$.Title", url="$.ItemDefaultUrl", published_at="$.PublicationDate"),
        _c("fred", "$.observations", "date value", date="$.date", value="$.value", realtime_start="$.realtime_start", realtime_end="$.realtime_end"),
        _c("cot", "$", "date market code open_interest", date="$.report_date_as_yyyy_mm_dd", market="$.market_and_exchange_names", code="$.cftc_contract_market_code", open_interest="$.open_interest_all", traders="$.traders_tot_all"),
        _c("hmda-aggregations", "$.aggregations", "count sum", count="double $.count", sum="double $.sum", state="$.state", actions_taken="$.actions_taken"),
        _c("world-bank-indicators", "$[1]", "country year", country="$.country.value", iso3="$.countryiso3code", indicator="$.indicator.id", year="$.date", value="double $.value"),
        _c("usaspending", "$.results", "award_id recipient internal_id", award_id="$['Award ID']", recipient="$['Recipient Name']", internal_id="$.generated_internal_id", amount="double $['Award Amount']"),
        _c("grants-gov", "$.data.oppHits", "id number title", id="$.id", number="$.number", title="$.title", agency="$.agency", open_date="$.openDate", close_date="$.closeDate"),
        _c("cdc-wastewater", "$", "state date_end", state="$.reporting_jurisdiction", date_end="$.date_end", percentile="$.percentile", ptc="$.ptc_15d"),
        _c("unhcr", "$.items", "year", year="long $.year", origin="$.coo_iso", asylum="$.coa_iso", refugees="double $.refugees", asylum_seekers="double $.asylum_seekers", idps="double $.idps", stateless="double $.stateless", oip="double $.oip", ooc="double $.ooc", hst="double $.hst"),
        _c("hunger-map", "$.body.countries", "iso3 name", iso3="$.country.iso3", name="$.country.name", fcs_people="double $.metrics.fcs.people", fcs_prevalence="double $.metrics.fcs.prevalence", date="$.date"),
        _c("drought-monitor", "$", "map_date", map_date="$.mapDate", state="$.stateAbbreviation", none="double $.none", d0="double $.d0", d1="double $.d1", d2="double $.d2", d3="double $.d3", d4="double $.d4"),
        _c("carbon-intensity", "$.data", "from to", **{"from": "$.from", "to": "$.to"}, forecast="double $.intensity.forecast", actual="double $.intensity.actual", index="$.intensity.index"),
        _c("cisa-kev", "$.vulnerabilities", "cve vendor product name added description action due ransomware notes", cve="$.cveID", vendor="$.vendorProject", product="$.product", name="$.vulnerabilityName", added="$.dateAdded", description="$.shortDescription", action="$.requiredAction", due="$.dueDate", ransomware="$.knownRansomwareCampaignUse", notes="$.notes", cwes="strings $.cwes"),
        _c("ioda", "$.data", "code name", code="$.entity.code", name="$.entity.name", score="double $.scores.overall", events="double $.event_cnt"),
        _c("ooni", "$.result", "probe_cc", probe_cc="$.probe_cc", anomalies="double $.anomaly_count", measurements="double $.measurement_count", confirmed="double $.confirmed_count", failures="double $.failure_count"),
        _c("wikipedia-pageviews", "$.items[0].articles", "article views", article="$.article", views="long $.views", rank="long $.rank"),
        _c("kalshi", "$.markets", "ticker title", ticker="$.ticker", title="$.title", yes_bid="double $.yes_bid", yes_ask="double $.yes_ask", close="$.close_time"),
        _c("polymarket", "$", "id question", id="$.id", question="$.question", outcomes="$.outcomes", prices="$.outcomePrices", end="$.endDate"),
        _c("manifold", "$", "id question", id="$.id", question="$.question", probability="double $.probability", url="$.url", close="long $.closeTime"),
        _c("nws-alerts", "$.features", "id event", "id", drift=False, id="$.properties.id", event="$.properties.event", severity="$.properties.severity", headline="$.properties.headline", area="$.properties.areaDesc", starts_at="$.properties.onset", ends_at="$.properties.ends", observed_at="$.properties.sent"),
        _c("gdacs", "$.features", "id type", "type id", drift=False, id="long $.properties.eventid", type="$.properties.eventtype", level="$.properties.alertlevel", name="$.properties.name", country="$.properties.iso3", longitude="double $.geometry.coordinates[0]", latitude="double $.geometry.coordinates[1]", starts_at="$.properties.fromdate", ends_at="$.properties.todate"),
        _c("nhc-storms", "$.activeStorms", "id name", "id", drift=False, id="$.id", name="$.name", classification="$.classification", intensity="$.intensity", latitude="double $.latitudeNumeric", longitude="double $.longitudeNumeric", observed_at="$.lastUpdate"),
        _c("usgs-volcanoes", "$", "number level", "number", number="$.vnum", name="$.volcano_name", level="$.alert_level", color="$.color_code", observed_at="$.sent_utc"),
        _c("safecast", "$", "id value", "id", id="long $.id", value="double $.value", unit="$.unit", latitude="double $.latitude", longitude="double $.longitude", captured_at="$.captured_at"),
        _c("wikipedia-congress-recent", "$.query.recentchanges", "title revision", "revision", drift=False, title="$.title", revision="long $.revid", user="$.user", comment="$.comment", kind="$.type", at="$.timestamp"),
        _c("open-library", "$.docs", "id title", "id", id="$.key", title="$.title", authors="strings $.author_name", isbns="strings $.isbn", year="long $.first_publish_year", access="$.ebook_access"),
        _c("internet-archive", "$.response.docs", "id title", "id", id="$.identifier", title="$.title", creator="$.creator", year="$.year", mediatype="$.mediatype"),
        _c("tfl-cameras", "$", "id name", id="$.id", name="$.commonName", latitude="double $.lat", longitude="double $.lon"),
    )
}


def _number(name: str) -> Column:
    """A number that may have come as text; null for blank or endless ones."""
    value = F.nullif(F.trim(F.col(name)), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _on_earth(latitude: str, longitude: str) -> Column:
    return F.col(latitude).between(-90, 90) & F.col(longitude).between(-180, 180)


def _published(name: str) -> Callable[[], Column]:
    return lambda: dates.published_at(F.col(name))


def _blank(name: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))


# Pages that aren't articles, by what their titles begin with.
NOT_ARTICLES = "Main_Page|(?:Special|Wikipedia|Portal|Talk|User|User_talk|File|Template|Help|Category|Draft|Module|MediaWiki|Book|TimedText)(?:_talk)?:.*"
#: What signals that an edit is about a legislature, by name.
SIGNALS = {
    "us-congress": r"(?i)\b(?:united states|u\.?s\.?)\s+congress\b|\bcongressional\b",
    "us-house": r"(?i)\b(?:united states|u\.?s\.?)\s+house of representatives\b",
    "us-senate": r"(?i)\b(?:united states|u\.?s\.?)\s+senate\b",
    "congressional-committee": r"(?i)\b(?:house|senate|congressional)\s+committee\b",
    "federal-legislation": r"\b(?:H\.?R\.?|S\.)\s*\d+\b|\bPublic Law \d+-\d+\b",
}


def signals(text: Column) -> Column:
    """The names of all signals that a text shows, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in SIGNALS.items())))


def _extend(provider: str, kept: Callable[[], Column] | None = None, **derived: Callable[[], Column]) -> None:
    CONNECTORS[provider] = replace(CONNECTORS[provider], derived=derived, kept=kept)


def _one(value: float) -> Column:
    return F.lit(value)


def _clamped(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


for _name, _fields in {
    "sec-fulltext": {"description": ("$._source.file_description", "string"), "xsl": ("$._source.xsl", "string"), "error": ("$.errorType", "string")},
    "kalshi": {"bid_text": ("$.yes_bid_dollars", "string"), "ask_text": ("$.yes_ask_dollars", "string"), "notional_text": ("$.notional_value_dollars", "string")},
    "wikipedia-congress-recent": {"bot": ("$.bot", "boolean"), "minor": ("$.minor", "boolean")},
    "open-library": {"public_scan": ("$.public_scan_b", "boolean")},
    "drought-monitor": {"map_date_2": ("$.MapDate", "string"), **{f"{x}_2": (f"$.{x.upper() if x != 'none' else 'None'}", "double") for x in ("none", "d0", "d1", "d2", "d3", "d4")}},
    "cot": {f"{who}_{side}": (f"$.{who}_positions_{side}_all", "string") for who in ("noncomm", "comm") for side in ("long", "short")},
    "nhc-storms": {"latitude_text": ("$.latitude", "string"), "longitude_text": ("$.longitude", "string")},
    "nws-alerts": {"ring": ("$.geometry.coordinates[0]", "array")},
    "ssrn": {"authors_raw": ("$.authors", "array")},
    "openalex": {"abstract_index": ("$.abstract_inverted_index", "object")},
}.items():
    CONNECTORS[_name] = replace(CONNECTORS[_name], fields=CONNECTORS[_name].fields | _fields)
CONNECTORS["drought-monitor"] = replace(CONNECTORS["drought-monitor"], required=())
CONNECTORS["nhc-storms"] = replace(CONNECTORS["nhc-storms"], fields={n: f for n, f in CONNECTORS["nhc-storms"].fields.items() if n not in ("latitude", "longitude")})

_extend("hacker-news", url=lambda: F.coalesce(_blank("url"), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id"))), published=_published("published_at"))
_extend("tickertick", source=lambda: F.coalesce(_blank("source"), F.lit("TickerTick")), published=lambda: F.timestamp_millis("published_ms"), related_tickers=lambda: F.array_sort(F.array_distinct(F.transform("related_tickers", lambda t: F.upper(t)))), kind=lambda: news_kind(F.col("source"), F.col("title"), F.col("url")))
_extend("yahoo-search", published=lambda: F.timestamp_seconds("published_s"), related_tickers=lambda: F.array_sort(F.array_distinct(F.transform("related_tickers", lambda t: F.upper(t)))))
_extend("gdelt", published=_published("published_at"))
_extend("federal-register", title=lambda: F.concat_ws(": ", _blank("kind"), "title"), source=lambda: F.coalesce(_blank("source"), F.lit("Federal Register")), published=_published("published_at"))
_extend(
    "sec-fulltext",
    file_name=lambda: F.regexp_extract("id", r"^[^:]*:(.*)$", 1),
    cik=lambda: F.regexp_replace("cik", "^0+", ""),
    name=lambda: F.trim(F.regexp_replace("name", r"\s*\(CIK[^)]*\)\s*$", "")),
    title=lambda: F.concat_ws(" - ", _blank("form"), F.coalesce(_blank("name"), _blank("description"), F.col("accession"))),
    url=lambda: F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "cik", F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), F.coalesce(F.concat(_blank("xsl"), F.lit("/")), F.lit("")), "file_name"),
    kept=lambda: (F.col("file_name") != "") & (F.col("cik") != ""),
)
_extend("openalex", abstract=lambda: abstract_from_index(F.col("abstract_index")), url=lambda: F.coalesce(_blank("landing"), _blank("doi"), F.col("id")), canonical=lambda: F.coalesce(_blank("doi"), _blank("landing")))
_extend("biorxiv", version_number=lambda: F.col("version").try_cast("int"), kept=lambda: F.col("version_number").isNotNull())
_extend("ssrn", kept=lambda: F.col("id") > 0)
_extend("hf-papers", canonical=lambda: F.concat(F.lit("https://arxiv.org/abs/"), "id"), kept=lambda: F.col("id").rlike(r"^\d{4}\.\d{4,5}$"))
_extend("alphavantage", text=lambda: F.concat_ws(": ", "speaker", "content"))
_extend("hf-transcripts", summary=lambda: F.when(F.length("content") > 280, F.concat(F.substring("content", 1, 280), F.lit("\u2026"))).otherwise(F.col("content")))
_extend(
    "fred",
    known=lambda: F.trim("value") == ".",
    number=lambda: F.when(~F.col("known"), _number("value")),
    day=lambda: dates.date_only(F.col("date")),
    kept=lambda: (F.col("known") | F.col("number").isNotNull()) & F.col("day").isNotNull() & dates.date_only(F.col("realtime_start")).isNotNull() & dates.date_only(F.col("realtime_end")).isNotNull(),
)
_extend(
    "cot",
    **{f"{who}_{side}": (lambda c: lambda: F.nullif(F.trim(F.col(c)), F.lit("")).try_cast("long"))(f"{who}_{side}") for who in ("noncomm", "comm") for side in ("long", "short")},
    net=lambda: F.col("noncomm_long") - F.col("noncomm_short"),
    kept=lambda: F.col("noncomm_long").isNotNull() & F.col("noncomm_short").isNotNull() & F.col("comm_long").isNotNull() & F.col("comm_short").isNotNull(),
)
_extend("world-bank-indicators", kept=lambda: F.col("value").isNotNull() & F.col("year").rlike(r"^\d{4}$"))
_extend("usaspending", url=lambda: F.concat(F.lit("https://www.usaspending.gov/award/"), "internal_id"))
_extend("grants-gov", opens=lambda: dates.us_date(F.col("open_date")), closes=lambda: dates.us_date(F.col("close_date")), kept=lambda: F.col("opens").isNotNull() & (_blank("close_date").isNull() | F.col("closes").isNotNull()))
_extend("cdc-wastewater", percentile=lambda: _number("percentile"), ptc=lambda: _number("ptc"))
_extend("unhcr", others=lambda: lanes.sum_of_present(*(F.col(c) for c in ("oip", "stateless", "ooc", "hst"))), kept=lambda: _blank("origin").isNotNull() | _blank("asylum").isNotNull())
_extend("drought-monitor", **{x: (lambda c: lambda: F.coalesce(F.col(c), F.col(f"{c}_2")))(x) for x in ("none", "d0", "d1", "d2", "d3", "d4")}, day=lambda: dates.map_date(F.coalesce("map_date", "map_date_2")), kept=lambda: F.col("day").isNotNull())
_extend("cisa-kev", ransomware=lambda: F.col("ransomware") == "Known", url=lambda: F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), F.url_encode("cve")))
_extend("ioda", code=lambda: F.upper(F.trim("code")))
_extend("ooni", probe_cc=lambda: F.upper(F.trim("probe_cc")), rate=lambda: F.when(F.col("measurements") > 0, F.col("anomalies") / F.col("measurements")))
_extend("wikipedia-pageviews", title=lambda: F.translate("article", "_", " "), kept=lambda: ~F.col("article").rlike(f"^(?:{NOT_ARTICLES})$"))
_extend("wikipedia-congress-recent", signals=lambda: signals(F.concat_ws(" ", "title", F.coalesce("comment", F.lit("")))), kept=lambda: F.col("kind").isin("edit", "new") & ~F.coalesce("bot", F.lit(False)) & (F.size("signals") > 0))
_extend("kalshi", probability=lambda: _clamped(lanes.implied_probability(_number("bid_text"), _number("ask_text")) / F.coalesce(F.when(_number("notional_text") > 0, _number("notional_text")), _one(1.0))), kept=lambda: F.col("probability").isNotNull())
_extend("polymarket", probability=lambda: _clamped(F.coalesce(F.try_variant_get(F.try_parse_json("prices"), "$[0]", "string")).try_cast("double")), kept=lambda: F.col("probability").isNotNull())
_extend("manifold", probability=lambda: _clamped(F.col("probability")), closes=lambda: F.timestamp_millis("close"), kept=lambda: F.col("probability").isNotNull())
_extend("nws-alerts", title=lambda: F.coalesce(_blank("headline"), _blank("event")), severity=lambda: severity.named(F.trim("severity"), severity.WEATHER), flood=lambda: F.col("event").rlike(r"(?i)\bflood\b"), area=lambda: clean_text(F.col("area")))
_extend("gdacs", event_id=lambda: F.concat_ws("-", F.lit("gdacs"), F.upper("type"), F.col("id").cast("string")), severity=lambda: severity.named(F.trim("level"), severity.DISASTER), placed=lambda: _on_earth("latitude", "longitude"))
_extend("nhc-storms", latitude=lambda: lanes.hemisphere(F.col("latitude_text"), "N", "S", 90), longitude=lambda: lanes.hemisphere(F.col("longitude_text"), "E", "W", 180), knots=lambda: _number("intensity"), severity=lambda: severity.storm(F.col("classification"), F.col("knots")))
_extend("usgs-volcanoes", severity=lambda: severity.named(F.col("level"), severity.VOLCANO))
_extend("safecast", severity=lambda: F.lit("unknown"), kept=lambda: _on_earth("latitude", "longitude"))
_extend("open-library", availability=lambda: F.when(F.col("public_scan") | (F.col("access") == "public"), "public-domain").when(F.col("access").isin("borrowable", "printdisabled"), "borrow").otherwise("metadata-only"))


def connect(spark: SparkSession, provider: str, path: str) -> DataFrame:
    """The records of a provider's captured payloads under a path."""
    return read_records(payloads(spark, path), CONNECTORS[provider])


def abstract_from_index(index: Column) -> Column:
    """A text rebuilt from an inverted index, a VARIANT of word -> positions."""
    entries = F.map_entries(F.try_variant_get(index, "$", "map<string,array<int>>"))
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
