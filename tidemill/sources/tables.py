"""Publishers' tables and pages: delimited text, HTML listings, XML, parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import dates, severity, url
from tidemill.functions.classify import news_kind
from tidemill.functions.text import clean_text, stable_id
from tidemill.operators import joins, lanes
from tidemill.operators.merge import first_wins
from tidemill.sources import formats

# The places of an event export's 61 columns that are read, and names of its root codes in order.
EVENT_COLUMNS = {"event_id": 0, "event_code": 26, "root_code": 28, "quad_class": 29, "goldstein": 30, "area": 52, "country": 53, "latitude": 56, "longitude": 57, "source_url": 60}
ROOTS = (
    "Make Public Statement", "Appeal", "Express Intent to Cooperate", "Consult", "Engage in Diplomatic Cooperation", "Engage in Material Cooperation", "Provide Aid", "Yield",
    "Investigate", "Demand", "Disapprove", "Reject", "Threaten", "Protest", "Exhibit Force Posture", "Reduce Relations", "Coerce", "Assault", "Fight", "Use Unconventional Mass Violence",
)


def conflict_events(spark: SparkSession, path: str, countries: dict[str, str]) -> DataFrame:
    """id, title, severity, magnitude, country, area, event_type, url, latitude, longitude of an event export, the first row of each id.

    countries: the publisher's country codes and the two letters they stand for. Rows at (0, 0) are dropped, short rows skipped;
    a file of short rows only raises."""
    rows = formats.positional(spark, path, "\t", EVENT_COLUMNS, 61).withColumn("__seq", F.monotonically_increasing_id())
    number = lambda c: F.trim(c).try_cast("double")
    root = F.lpad(F.trim("root_code"), 2, "0").try_cast("int")
    label = F.coalesce(F.get(F.array(*map(F.lit, ROOTS)), root - 1), F.lit("GDELT Event"))
    area = F.nullif(clean_text(F.coalesce("area", F.lit(""))), F.lit(""))
    place = lanes.place(number("latitude"), number("longitude"))
    found = rows.where(F.trim("event_id") != "").select(
        "__seq", F.concat(F.lit("gdelt-"), F.trim("event_id")).alias("id"), F.concat_ws(" \u2014 ", label, area).alias("title"),
        severity.conflict(number("quad_class"), number("goldstein")).alias("severity"), number("goldstein").alias("magnitude"),
        joins.label(F.upper(F.trim("country")), countries).alias("country"), area.alias("area"), F.trim("event_code").alias("event_type"),
        url.safe_http_url(F.trim("source_url")).alias("url"), place.alias("p"),
    )
    kept = first_wins(found.where("p.known"), ["id"], "__seq")
    return kept.select(*(c for c in found.columns if c not in ("__seq", "p")), "p.latitude", "p.longitude")


def trades(rows: DataFrame) -> DataFrame:
    """Trades of a table with a publisher's column names: ids, lineage_id, action, event_at, underlier. Raises for a row without an id."""
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    own, original = cell("Dissemination Identifier"), cell("Original Dissemination Identifier")
    checked = F.coalesce(own, F.raise_error(F.lit("a trade has no Dissemination Identifier")))
    return rows.select(checked.alias("id"), original.alias("original_id"), F.coalesce(original, checked).alias("lineage_id"), cell("Action type").alias("action"), cell("Event timestamp").alias("event_at"), cell("UPI Underlier Name").alias("underlier"))


def loans(spark: SparkSession, path: str) -> DataFrame:
    """Loan applications of a pipe-separated file: activity_year, lei, action_taken, loan_amount, income and all else as text.

    The header has the three names that every file has, each once; a bare carriage return or a blank lei raises; numbers out of
    bounds are null."""
    rows = formats.separated(spark, path, "|")
    names = [c.lower() for c in rows.columns]
    if len(set(names)) != len(names) or not {"activity_year", "lei", "action_taken"} <= set(names):
        raise ValueError("header of a loan file")
    bare = spark.read.text(path, lineSep="\n").where(F.regexp_replace("value", "\r$", "").contains("\r")).limit(1).collect()
    if bare:
        raise ValueError("a bare carriage return")
    bounded = lambda c, low, high: F.when(F.col(c).try_cast("double").between(low, high), F.col(c).try_cast("double"))
    known = {"activity_year": bounded("activity_year", 2000, 2100).cast("int"), "action_taken": bounded("action_taken", 1, 8).cast("int"), "lei": F.coalesce(F.nullif(F.trim("lei"), F.lit("")), F.raise_error(F.lit("a loan without lei")))}
    known |= {c: bounded(c, 0, 1e12) for c in ("loan_amount", "income") if c in names}
    return rows.select(*(known.get(c.lower(), F.col(c)).alias(c.lower()) for c in rows.columns))


def news_table(pages: DataFrame, html: str, key: str) -> DataFrame:
    """key, pos, title, url, source, published of the rows of a news table, whose time of day alone means the date of the row before."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "tr"))
    at = F.trim(clean_text(F.regexp_extract("tr", r"(?is)<td[^>]*align=\"right\"[^>]*>(.*?)</td>", 1)))
    link = r"(?is)<a[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    source = F.regexp_replace(clean_text(F.regexp_extract("tr", r"(?is)<span[^>]*>(.*?)</span>", 1)), r"^\((.*)\)$", "$1")
    rows = rows.select(key, "pos", at.alias("at"), F.regexp_extract("tr", link, 1).alias("url"), clean_text(F.regexp_extract("tr", link, 2)).alias("title"), F.coalesce(F.nullif(source, F.lit("")), F.lit("Finviz")).alias("source"))
    day = F.nullif(F.regexp_extract("at", r"^([A-Z][a-z]{2}-\d{2}-\d{2})\s", 1), F.lit(""))
    carried = F.last(day, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos"))
    text = F.when(F.col("at").rlike(r"^\d{1,2}:\d{2}[AP]M$"), F.concat_ws(" ", carried, "at")).otherwise(F.col("at"))
    rows = rows.withColumn("published", dates.published_at(text))
    return rows.where("title <> '' and url <> ''").select(key, "pos", "title", "url", "source", "published", news_kind(F.col("source"), F.col("title"), F.col("url")).alias("kind"))


def listed_actions(pages: DataFrame, html: str, key: str, base: str) -> DataFrame:
    """title, url, day of the titled links of a listing whose paths end in a date, each URL once; titles have 3 characters at least."""
    pattern = r'(?is)<a[^>]*href="([^"]*/(\d{8}[^"/]*))"[^>]*>(.*?)</a>'
    links = F.arrays_zip(*(F.regexp_extract_all(html, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "path"), (2, "tail"), (3, "body"))))
    rows = pages.select(key, F.posexplode(links).alias("pos", "x")).select(key, "pos", "x.*")
    rows = rows.select(F.struct(key, "pos").alias("__seq"), clean_text(F.col("body")).alias("title"), url.absolute_url(F.col("path"), F.lit(base)).alias("url"), dates.compact_date(F.substring("tail", 1, 8)).alias("day"))
    return first_wins(rows.where(F.length("title") >= 3), ["url"], "__seq").drop("__seq")


def airport_events(bodies: DataFrame, xml: str) -> DataFrame:
    """id, title, severity, airport, summary of the sections of a status document, the first of each id."""
    inside = lambda body, tag: F.nullif(clean_text(F.regexp_extract(body, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)), F.lit(""))

    def sections(name: str) -> Column:
        found = F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}\b[^>]*>(.*?)</{name}\s*>"), F.lit(1))
        return F.transform(found, lambda b: F.struct(F.lit(name).alias("type"), b.alias("body")))

    parts = F.concat(*map(sections, severity.AIRPORT))
    rows = bodies.select(F.posexplode(parts).alias("pos", "x")).select("pos", "x.*")
    rows = rows.select("pos", "type", F.upper(inside(F.col("body"), "ARPT")).alias("airport"), inside(F.col("body"), "Reason").alias("reason"), inside(F.col("body"), "Avg").alias("average")).where("airport is not null")
    delay = F.concat(F.lit("Average delay: "), "average")
    label = joins.label(F.col("type"), {"Airport_Closure": "airport closure", "Ground_Stop": "ground stop", "Ground_Delay": "ground delay", "Arrival_Departure_Delay": "arrival/departure delay"})
    rows = rows.select("pos", stable_id(F.lit("faa-status"), F.col("type"), F.col("airport"), F.coalesce("reason", F.lit(""))).alias("id"), F.concat_ws(" ", "airport", label).alias("title"), severity.named(F.col("type"), severity.AIRPORT).alias("severity"), "airport", F.nullif(F.concat_ws(". ", "reason", delay), F.lit("")).alias("summary"))
    return first_wins(rows, ["id"], "pos").drop("pos")


def latest_frames(captured: DataFrame) -> DataFrame:
    """serial, at, latitude, longitude, altitude: the newest frame of each serial of {serial: {time: frame}} payloads (text)."""
    serials = F.try_variant_get(F.try_parse_json("text"), "$", "map<string,variant>")
    frames = captured.select(F.explode(serials).alias("serial", "by_time")).select("serial", F.explode(F.try_variant_get("by_time", "$", "map<string,variant>")).alias("time", "frame"))
    number = lambda p: F.try_variant_get("frame", p, "double")
    rows = frames.select(F.trim("serial").alias("serial"), dates.published_at(F.col("time")).alias("at"), number("$.lat").alias("latitude"), number("$.lon").alias("longitude"), number("$.alt").alias("altitude"))
    best = rows.where("serial <> '' and at is not null").groupBy("serial").agg(F.max_by(F.struct("at", "latitude", "longitude", "altitude"), "at").alias("f"))
    good = (F.col("f.latitude").between(-90, 90)) & (F.col("f.longitude").between(-180, 180))
    return best.select("serial", "f.at", F.when(good, F.col("f.latitude")).alias("latitude"), F.when(good, F.col("f.longitude")).alias("longitude"), "f.altitude")


def chart(captured: DataFrame) -> DataFrame:
    """symbol, price, change, percent and bars (array of at, open, high, low, close, volume) of chart payloads (symbol, text).

    Bars come from parallel arrays; what isn't there is null. The price is the last close there is, else the market's."""
    root = F.try_parse_json("text")
    at = "$.chart.result[0]"
    numbers = lambda name: F.coalesce(F.try_variant_get(root, f"{at}.indicators.quote[0].{name}", "array<double>"), F.array().cast("array<double>"))
    price = F.coalesce(lanes.last_finite(numbers("close")), F.try_variant_get(root, f"{at}.meta.regularMarketPrice", "double"))
    previous = F.coalesce(F.try_variant_get(root, f"{at}.meta.chartPreviousClose", "double"), F.try_variant_get(root, f"{at}.meta.previousClose", "double"))
    fields = ("open", "high", "low", "close", "volume")
    bars = joins.zipped(at=F.try_variant_get(root, f"{at}.timestamp", "array<bigint>"), **{n: numbers(n) for n in fields})
    bars = F.transform(F.filter(bars, lambda b: b["at"].isNotNull()), lambda b: F.struct(F.timestamp_seconds(b["at"]).alias("at"), *(b[n].alias(n) for n in fields)))
    rows = captured.select("symbol", price.alias("price"), previous.alias("previous"), bars.alias("bars"))
    return rows.select("symbol", "price", lanes.quote_change(F.col("price"), F.col("previous")).alias("q"), "bars").select("symbol", "price", "q.change", "q.percent", "bars")


def flood_outlook(daily: DataFrame, basin: str, day: str, flow: str, boundary: Column, days: int = 31) -> DataFrame:
    """basin, peak, ratio, severity: the highest of the next `days` values over the median of the last `days` before the boundary."""
    rows = daily.where(F.col(flow) >= 0).withColumn("__past", F.col(day) < boundary)
    past = joins.ends(rows.where("__past"), [basin], day, days).groupBy(basin).agg(F.percentile(flow, 0.5).alias("usual"))
    peaks = joins.ends(rows.where("not __past"), [basin], day, days, last=False).groupBy(basin).agg(F.max(flow).alias("peak"))
    ratio = F.when(F.col("usual") > 0, F.col("peak") / F.col("usual"))
    return peaks.join(past, basin, "left").select(basin, "peak", ratio.alias("ratio"), F.when(ratio.isNull(), "unknown").otherwise(severity.discharge(ratio)).alias("severity"))


def ocean_index(lines: DataFrame, value: str) -> DataFrame:
    """season, as_of, anomaly, phase of a table of overlapping seasons in columns set apart by spaces; other lines are skipped."""
    rows = formats.spaced_columns(lines, value, ["season", "year", "total", "anomaly"])
    anomaly = F.col("anomaly").try_cast("double")
    rows = rows.select("season", dates.season_end(F.col("season"), F.col("year").try_cast("int")).alias("as_of"), anomaly.alias("anomaly"), lanes.ocean_phase(anomaly).alias("phase"))
    return rows.where("as_of is not null and anomaly is not null")


def monthly_wide(rows: DataFrame, year: str) -> DataFrame:
    """year, month, as_of, anomaly of a table with a column for each month; twelve rows a year, missing values ('***') null."""
    months = [m.capitalize() for m in dates.MONTHS]
    long = rows.unpivot([year], months, "name", "cell")
    month = F.array_position(F.array(*map(F.lit, months)), F.col("name")).cast("int")
    y = F.col(year).try_cast("int")
    return long.select(y.alias("year"), month.alias("month"), dates.month_end(y, month).alias("as_of"), F.col("cell").try_cast("double").alias("anomaly")).where("as_of is not null")


def exposures(rows: DataFrame, order: str, label: str, amount: str) -> DataFrame:
    """order, label, kind, region, amount of a sheet's rows. A label without an amount names the region of the rows below it; totals are
    rows of their own kind, and neither the grand total nor the United States has a region."""
    w = Window.orderBy(order)  # one sheet
    head = F.when(F.col(amount).isNull(), F.col(label))
    marked = rows.withColumn("__region", F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(amount).isNotNull())
    upper = F.upper(F.trim(label))
    kind = F.when(upper == "GRAND TOTAL", "grand-total").when(upper.startswith("TOTAL"), "total").otherwise("country")
    region = F.when(~upper.isin("GRAND TOTAL", "UNITED STATES"), F.col("__region"))
    return marked.select(order, F.col(label).alias("label"), kind.alias("kind"), region.alias("region"), F.col(amount).alias("amount"))


def feed_news(items: DataFrame, provider: str, kind: str | None, subject: lanes.Subject) -> DataFrame:
    """Items of read_feed() as news of a feed that is read whole and filtered here: id, title, url, published, kind and others."""
    text = F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))
    shown = F.lit(kind) if kind else news_kind(F.coalesce("source", F.lit("")), F.col("title"), F.col("link"))
    rows = items.where(subject.normal().matches(text))
    return rows.select(F.lit(provider).alias("provider"), stable_id(F.lit(provider), F.col("id"), F.col("title")).alias("id"), "title", F.col("link").alias("url"), F.when(F.lit(provider != "google-news"), F.col("link")).alias("canonical_url"), "summary", F.coalesce("source", F.lit(provider)).alias("source"), dates.published_at(F.col("published_text")).alias("published_at"), shown.alias("kind"), "form_type")


def unwrapped_link(link: Column) -> Column:
    """The page that a search engine's redirect leads to, on its own hosts only."""
    inner = F.try_url_decode(F.nullif(F.regexp_extract(link, r"[?&]url=([^&#]+)", 1), F.lit("")))
    return F.when(link.rlike(r"^https?://(?:[^/]+\.)?bing\.com/"), F.coalesce(inner, link)).otherwise(link)


def release_news(rows: DataFrame, provider: str, title: str, counts: dict[str, Column]) -> DataFrame:
    """One news item about a release (rows have as_of): a title, and a summary of counts."""
    parts = [F.concat_ws(" ", value.cast("string"), F.lit(name)) for name, value in counts.items()]
    return rows.agg(F.max("as_of").alias("as_of"), F.concat_ws(", ", *parts).alias("summary")).select(stable_id(F.lit(provider), F.col("as_of").cast("string")).alias("id"), F.lit(title).alias("title"), "summary", F.col("as_of").cast("timestamp").alias("published_at"))
