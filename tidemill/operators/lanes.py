"""The lanes as plans: a subject's feed, a dated release, an event snapshot, and a work's identity."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemill.functions import classify, match, severity
from tidemill.functions.text import compare_form, surname
from tidemill.operators import merge, similarity
from tidemill.shared import cut

# Statuses that make a result partial, and the lowest score at which an identity counts as resolved.
PARTIAL = ("error", "unsupported", "partial", "disabled")
IDENTITY_FLOOR = 0.82
# Fixed value: the most tokens of a title all of whose sets of tokens are looked up.
SHORT_TITLE = 8


@dataclass(frozen=True)
class Subject:
    """Whom or what a feed is about. key: ticker, else cik, else name."""

    company: str = ""
    ticker: str = ""
    cik: str = ""
    query: str = ""

    def normal(self) -> Subject:
        tidy = lambda s: " ".join(s.split())
        return Subject(tidy(self.company), tidy(self.ticker).upper(), tidy(self.cik), tidy(self.query))

    @property
    def key(self) -> str:
        return self.ticker or self.cik or self.company or self.query

    def matches(self, text: Column) -> Column:
        return match.mentions(text, self.query, self.company, self.ticker)


def checked_limit(limit: int | None) -> int | None:
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise ValueError("limit must be a whole number from 0 on")
    return limit


def checked_window(since: datetime | None, until: datetime | None) -> tuple[datetime | None, datetime | None]:
    if since and until and since > until:
        raise ValueError("since is after until")
    return since, until


def in_window(items: DataFrame, at: str, since: datetime | None, until: datetime | None) -> tuple[DataFrame, Column]:
    """Items inside the window, both ends included, and an aggregate that counts undated ones, which a bound excludes."""
    since, until = checked_window(since, until)
    on = F.lit(True)
    if since:
        on = on & (F.col(at) >= F.lit(since))
    if until:
        on = on & (F.col(at) <= F.lit(until))
    return (items.where(on) if since or until else items), F.count_if(F.col(at).isNull())


def _optional(items: DataFrame, name: str) -> Column:
    return F.col(name) if name in items.columns else F.lit(None).cast("string")


def _folded(items: DataFrame, since: datetime | None, until: datetime | None, undated: Observation | None) -> DataFrame:
    """Items with a subject: those of the window, annotated, merged by subject and key."""
    found, missing = in_window(items.observe(undated, F.count_if(F.col("published_at").isNull()).alias("undated")) if undated else items, "published_at", since, until)
    shown = classify.item_text(*(F.col(c) for c in ("title", "summary", "source", "form_type", "url")))
    form, kind = F.col("form_type"), F.col("kind")
    none = F.array().cast("array<string>")
    found = found.withColumn("canonical_url", F.coalesce("canonical_url", F.when(F.col("provider") != "google-news", F.col("url"))))
    found = found.withColumn("event_kind", classify.event_kind(shown, form, kind)).withColumn("tags", F.array_sort(F.array_union(F.coalesce("tags", none), classify.event_tags(shown, form, kind))))
    accession, date_text = _optional(items, "accession_number"), _optional(items, "published_text")
    found = found.withColumn("key", F.struct("subject", news_key(accession, date_text).alias("key"))).withColumn("seq", F.struct("provider", "id"))  # the order in which a key's items fold
    found = cut(found)  # read and classified once, though the merge looks at it three times
    return merge.merge_news(found).drop("seq", "key").orderBy(F.coalesce("published_at", F.lit(0).cast("timestamp")).desc(), F.desc("id"))


def feed(items: DataFrame, subject: Subject, since: datetime | None = None, until: datetime | None = None, limit: int | None = None, undated: Observation | None = None) -> DataFrame:
    """The subject's items, annotated, merged by key, newest first.

    items: provider, id, title, summary, source, url, canonical_url, published_at, kind, form_type, tags, related_tickers, and, where there
    are such, accession_number and published_text. A limit of 0 reads nothing; the limit is taken last, after all that filters and
    merges. undated observes as `undated` how many of the subject's items have no date, which a window excludes."""
    limit, subject = checked_limit(limit), subject.normal()
    if limit == 0:
        return items.limit(0)
    text = F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))
    out = _folded(items.where(subject.matches(text)).withColumn("subject", F.lit(subject.key)), since, until, undated)
    return out if limit is None else out.limit(limit)


def news_key(accession: Column | None = None, date_text: Column | None = None) -> Column:
    """What makes two items one: URL, else accession number, else title, date and source, else the id."""
    from tidemill.functions.text import collapse_space
    from tidemill.functions.url import normalize_url

    tidy = lambda c: F.nullif(F.lower(collapse_space(F.coalesce(F.col(c), F.lit("")))), F.lit(""))
    link = F.nullif(normalize_url(F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url"))), F.lit(""))
    none = F.lit(None).cast("string")
    filed = F.concat(F.lit("sec-edgar:"), F.nullif(none if accession is None else accession, F.lit("")))
    date = F.coalesce(F.col("published_at").cast("string"), none if date_text is None else date_text, F.lit(""))
    titled = F.concat(F.lit("title:"), tidy("title"), F.lit("|"), date, F.lit("|"), tidy("source"))
    return F.coalesce(F.concat(F.lit("url:"), link), filed, titled, F.concat(F.lit("id:"), F.col("id")))


def watchlist(items: DataFrame, subjects: list[Subject], since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The feeds of several subjects, without limits, each item with its subject: one scan and one merge for all of them."""
    text = F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))
    normal = [s.normal() for s in subjects]
    met = F.array_compact(F.array(*(F.when(s.matches(text), F.lit(s.key)) for s in normal))) if normal else F.array().cast("array<string>")
    return _folded(items.withColumn("subject", F.explode(met)), since, until, None)


def provider_status(items: DataFrame, providers: DataFrame) -> DataFrame:
    """provider, items, status: unsupported, disabled or error as the provider says, else ok or empty by its items."""
    n = items.groupBy("provider").agg(F.count("*").alias("items"))
    joined = providers.join(n, "provider", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    return joined.withColumn("status", F.when(~F.col("supported"), "unsupported").when(F.col("error_code") == "config", "disabled").when(F.col("error_code").isNotNull(), "error").when(F.col("items") > 0, "ok").otherwise("empty"))


def is_partial(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.coalesce(F.bool_or(F.col("status").isin(*PARTIAL)), F.lit(False)).alias("partial"))


@dataclass(frozen=True)
class Release:
    """A dated table of a provider. sequence orders releases that share a date."""

    provider: str
    dataset: str
    as_of: date
    rows: DataFrame
    sequence: int | None = None

    def newer_than(self, as_of: date | None, sequence: int | None) -> bool:
        if self.sequence is not None and sequence is not None:
            return self.sequence > sequence
        return as_of is None or self.as_of > as_of

    def stamped(self) -> DataFrame:
        return self.rows.withColumns({"provider": F.lit(self.provider), "dataset": F.lit(self.dataset), "as_of": F.lit(self.as_of), "sequence": F.lit(self.sequence).cast("long")})


def latest_release(rows: DataFrame, as_of: str) -> DataFrame:
    """The rows of the newest date."""
    newest = rows.agg(F.max(as_of).alias(as_of))
    return rows.join(F.broadcast(newest), as_of)  # one row


def checked_snapshot(events: DataFrame) -> DataFrame:
    """Events, or an error where an id is empty or repeated, or a place is half or out of range."""
    bad = events.select(
        F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "").alias("empty"),
        (F.count("id") - F.count_distinct("id")).alias("repeated"),
        F.count_if(F.col("latitude").isNull() != F.col("longitude").isNull()).alias("half"),
        F.count_if((F.abs("latitude") > 90) | (F.abs("longitude") > 180)).alias("outside"),
    ).first()
    wrong = [name for name, n in bad.asDict().items() if n]
    if wrong:
        raise ValueError(f"snapshot has ids or places that are {', '.join(wrong)}")
    return events


def snapshot(events: DataFrame, floor: str | None = None, countries: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Events at or above a severity and in the countries, the most severe and newest first."""
    if floor:
        events = events.where(severity.meets(F.col("severity"), floor))
    if countries:
        events = events.where(F.upper("country").isin(*(c.upper() for c in countries)))
    out = events.orderBy(severity.rank(F.col("severity")).desc(), F.col("observed_at").desc_nulls_last(), "id")
    return out if checked_limit(limit) is None else out.limit(limit)


def merge_works(works: DataFrame) -> DataFrame:
    """One record for each key: each field from the first record that has it, by seq; the widest availability; all origins.

    works: key, seq, title, year, format, isbn13, doi, md5, availability, provider, url."""
    fields = ["title", "year", "format", "isbn13", "doi", "md5"]
    first = merge.first_non_null(works, ["key"], "seq", fields)
    best = works.groupBy("key").agg(F.max_by("availability", severity.rank(F.col("availability"), severity.AVAILABILITIES)).alias("availability"), F.min("seq").alias("seq"))
    origins = works.select("key", "provider", "url").distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("provider", "url"))).alias("provenance"))
    return first.join(best, "key").join(origins, "key").orderBy("seq")


IDENTIFIERS = ("isbn13", "isbn10", "doi", "oclc", "lccn")


def surnames(authors: Column) -> Column:
    """The distinct surnames of an array of names, empty ones left out."""
    return F.array_distinct(F.filter(F.transform(authors, surname), lambda n: n.isNotNull() & (n != "")))


def _weigh(title: Column, author: Column, year: Column) -> Column:
    return similarity.rounded(title * similarity.TITLE_WEIGHT + author * similarity.AUTHOR_WEIGHT + year * similarity.YEAR_WEIGHT)


def _keyed(*parts: Column) -> list[Column]:
    """A key of 128 bits as two columns."""
    return [F.xxhash64(F.lit(i), *parts).alias(f"key{i}") for i in range(2)]


def _keys(works: DataFrame, least: float, floor: float, asking: bool) -> DataFrame:
    """id, key0, key1, score: for each set of a title's tokens, a work asks for works of each size with these tokens, one of its
    surnames or any, and one of the years near its own or any, and is found under such keys. Score is what a pair of the key has at
    least; keys whose pairs can't reach the floor by it are left out.

    works: id, tokens (at most SHORT_TITLE), names, year."""
    words = F.expr("filter(tokens, (x, i) -> (mask & shiftleft(1, i)) <> 0)")
    rows = works.withColumn("n", F.size("tokens")).where("n > 0").withColumn("mask", F.explode(F.expr("sequence(1, shiftleft(1, n) - 1)"))).withColumn("s", F.bit_count("mask"))
    # The other title has at least the shared tokens.
    rows = rows.withColumn("other", F.explode(F.sequence(F.col("s"), F.lit(SHORT_TITLE))) if asking else F.col("s")).withColumn("title", similarity.rounded(2.0 * F.col("s") / (F.col("n") + F.col("other"))))
    most = lambda author, year: _weigh(F.col("title"), author, year) >= floor
    rows = rows.where((F.col("title") >= least) & most(F.lit(1.0), F.lit(1.0))).withColumn("words", words)
    rows = rows.withColumn("name", F.explode(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(F.lit(None).cast("string"))))).withColumn("author", F.when(F.col("name").isNotNull(), 1.0).otherwise(0.0)).where(most(F.col("author"), F.lit(1.0)))
    at = lambda gap: F.struct((F.col("year") + gap).cast("long").alias("at"), similarity.year_similarity(F.lit(0), F.lit(gap)).alias("weight"))
    near = F.when(F.col("year").isNotNull(), F.array(*map(at, range(-2, 3) if asking else [0]))).otherwise(F.array().cast("array<struct<at:bigint,weight:double>>"))
    rows = rows.withColumn("when", F.explode(F.concat(near, F.array(F.struct(F.lit(None).cast("long").alias("at"), F.lit(0.0).alias("weight"))))))
    score = _weigh(F.col("title"), F.col("author"), F.col("when.weight"))
    size = F.col("other" if asking else "n")
    return rows.select("id", *_keyed(F.col("words"), size, F.coalesce("name", F.lit("")), F.coalesce("when.at", F.lit(-(2**40)))), score.alias("score")).where(F.col("score") >= floor)


def resolve(records: DataFrame, authority: DataFrame, k: int = 10, floor: float = IDENTITY_FLOOR) -> DataFrame:
    """record_id, source_id, score, rank: the k best authoritative works of each record whose score reaches the floor.

    Both have id, title, authors (array), year and those of isbn13, isbn10, doi, oclc and lccn that both know. A shared identifier scores
    1, else the score is weighted from titles, surnames and years. Only pairs whose titles are similar enough to reach the floor
    are ever scored.

    Of the works with the same key, the k first ids are enough: all have at least the key's score, so whatever comes after them has k
    better ones, and each of the k best is among the first of the key that has its own score. So the pairs grow with the records, however many works
    share their titles. Longer titles, which have too many sets of tokens, are compared by rare tokens."""
    shared = [c for c in IDENTIFIERS if c in records.columns and c in authority.columns]

    def shape(df: DataFrame) -> DataFrame:
        return df.select("id", "year", *shared, F.array_sort(similarity.title_tokens(F.col("title"))).alias("tokens"), surnames(F.col("authors")).alias("names"))

    a, b = shape(records), shape(authority)
    # Authors and year give at most their weights, so a title has to make up the rest.
    least = max(0.05, (floor - similarity.AUTHOR_WEIGHT - similarity.YEAR_WEIGHT) / similarity.TITLE_WEIGHT)

    def keys(df: DataFrame, asking: bool) -> DataFrame:
        out = _keys(df.where(F.size("tokens") <= SHORT_TITLE), least, floor, asking)
        for c in shared:
            out = out.unionByName(df.where(F.col(c).isNotNull()).select("id", *_keyed(F.lit(c), F.col(c).cast("string")), F.lit(1.0).alias("score")))
        return out

    by_key = Window.partitionBy("key0", "key1").orderBy("id")
    first = keys(b, False).select("key0", "key1", "id").withColumn("place", F.dense_rank().over(by_key)).where(F.col("place") <= k)
    pairs = keys(a, True).withColumnRenamed("id", "r_id").join(first.withColumnRenamed("id", "s_id"), ["key0", "key1"]).select("r_id", "s_id", "score")

    named = lambda df, name: df.select(F.struct("id", "year", "names").alias(name), "tokens")
    long, short = F.size("tokens") > SHORT_TITLE, F.size("tokens") <= SHORT_TITLE
    for left, right in ((a.where(long), b), (a.where(short), b.where(long))):
        if not left.isEmpty() and not right.isEmpty():
            close = similarity.candidates(named(left, "r"), named(right, "s"), "r", "s", "tokens", least)
            author = F.when(F.arrays_overlap("r.names", "s.names"), 1.0).otherwise(0.0)
            total = _weigh(F.col("score"), author, similarity.year_similarity(F.col("r.year"), F.col("s.year")))
            pairs = pairs.unionByName(close.select(F.col("r.id").alias("r_id"), F.col("s.id").alias("s_id"), total.alias("score")).where(F.col("score") >= floor))
    # Dealt by record, so that neither the best score of a pair nor the ranks move rows again.
    best = pairs.repartition("r_id").groupBy("r_id", "s_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("r_id").orderBy(F.desc("score"), "s_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("r_id").alias("record_id"), F.col("s_id").alias("source_id"), "score", "rank")


def works_key(isbn13: Column, doi: Column, md5: Column, title: Column, author: Column, year: Column, format: Column) -> Column:
    """What makes two records one work: ISBN, else DOI, else content hash, else title, surname, year and format."""
    empty = F.lit("")
    work = F.concat_ws("|", F.lit("work"), compare_form(F.coalesce(title, empty)), F.coalesce(surname(F.coalesce(author, empty)), empty), F.coalesce(year.cast("string"), empty), F.coalesce(format, empty))
    return F.coalesce(F.concat(F.lit("isbn13:"), isbn13), F.concat(F.lit("doi:"), doi), F.concat(F.lit("md5:"), md5), work)


# File formats, the most wanted first.
FORMATS = ("epub", "pdf", "djvu", "mobi", "azw3", "cbz", "txt", "html")


def best_files(files: DataFrame, by: list[str], format: str, *order: Column) -> DataFrame:
    """The file of each group in the most wanted format."""
    rank = F.array_position(F.array(*map(F.lit, FORMATS)), F.lower(format))
    return merge.latest(files, by, F.when(rank > 0, rank).otherwise(len(FORMATS) + 1), *order)


def subject_query(subject: Subject, style: str) -> str:
    """A subject in a publisher's query language: 'quoted' ("Name" TICK), 'plain' (words) or 'fields' (all:"word" AND ...)."""
    s = subject.normal()
    if style == "quoted":
        return " ".join(x for x in (f'"{s.company}"' if s.company else "", s.ticker, s.query) if x)
    if style == "plain":
        return s.query or s.company or s.ticker
    if style == "fields":
        return " AND ".join(f'all:"{w}"' for w in (s.query or s.company or s.ticker).replace('"', " ").split())
    raise ValueError(f"no such style: {style}")


def implied_probability(bid: Column, ask: Column, notional: float = 1.0) -> Column:
    """The middle of a two-sided quote, else its one side, as a share of the notional between 0 and 1."""
    side = lambda c: F.when(c > 0, c)
    value = F.coalesce((side(bid) + side(ask)) / 2, side(bid), side(ask)) / notional
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def ring_centroid(ring: Column) -> Column:
    """struct<area, x, y> of a ring of struct<x, y> by the shoelace formula: its signed area and moments over it."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, following, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = lambda s, e: F.struct((s["a"] + e["c"]).alias("a"), (s["x"] + e["x"] * e["c"]).alias("x"), (s["y"] + e["y"] * e["c"]).alias("y"))
    return F.aggregate(sides, zero, total, lambda s: F.struct((s["a"] / 2).alias("area"), F.try_divide(s["x"], s["a"] * 3).alias("x"), F.try_divide(s["y"], s["a"] * 3).alias("y")))


def quote_change(price: Column, previous: Column) -> Column:
    """struct<change, percent> on the close before; null without one or for zero."""
    change = F.when(previous != 0, price - previous)
    return F.struct(change.alias("change"), (change / previous * 100).alias("percent"))


def last_finite(values: Column) -> Column:
    """The last value of an array that is a finite number."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), -1)


def sum_of_present(*values: Column) -> Column:
    """The sum of the values that aren't null; null if none is."""
    present = F.filter(F.array(*(v.cast("double") for v in values)), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda s, x: s + x))


def ocean_phase(anomaly: Column) -> Column:
    """Warm from half a degree above on, cold from half below."""
    return F.when(anomaly >= 0.5, "el-nino").when(anomaly <= -0.5, "la-nina").when(anomaly.isNotNull(), "neutral")


def hemisphere(text: Column, positive: str, negative: str, most: float) -> Column:
    """Degrees of '12.5N' and the like; null beyond `most` or for another letter."""
    pattern = r"^(\d+(?:\.\d+)?)\s*([NSEW])$"
    t = F.upper(F.trim(text))
    degrees = F.regexp_extract(t, pattern, 1).try_cast("double")
    side = F.regexp_extract(t, pattern, 2)
    return F.when(degrees <= most, F.when(side == positive, degrees).when(side == negative, -degrees))


def place(latitude: Column, longitude: Column) -> Column:
    """struct<known, latitude, longitude>: known is false for (0, 0), whose rows are dropped; what is out of range is null."""
    good = latitude.between(-90, 90) & longitude.between(-180, 180)
    both = lambda c: F.when(good, c)
    return F.struct((~F.coalesce((latitude == 0) & (longitude == 0), F.lit(False))).alias("known"), both(latitude).alias("latitude"), both(longitude).alias("longitude"))


def checked_checkpoint(as_of: str | None, sequence: int | None) -> None:
    """Raises unless a watcher can go on from here."""
    if as_of is not None:
        try:
            right = date.fromisoformat(as_of).isoformat() == as_of
        except (TypeError, ValueError):
            right = False
        if not right:
            raise ValueError("as_of must be a real date, YYYY-MM-DD")
    if sequence is not None and (isinstance(sequence, bool) or not isinstance(sequence, int) or abs(sequence) >= 1 << 53):
        raise ValueError("sequence must be a whole number that a double can hold")


def pending(releases: DataFrame, after: int | None) -> DataFrame:
    """The releases of a sequenced source that are due, in order of sequence: the newest one without a checkpoint, else all after it.
    Empty ones are left out. releases: sequence, rows (how many) and others."""
    full = releases.where("rows > 0")
    return full.orderBy(F.desc("sequence")).limit(1) if after is None else full.where(F.col("sequence") > after).orderBy("sequence")
