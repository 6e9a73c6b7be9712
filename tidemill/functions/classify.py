"""What a news item is about, and what kind of item it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import normalize_tag

# Kinds in order of precedence, with the words that show them.
KINDS = (
    ("earnings", ("earnings", "quarter results")),
    ("management", ("appoints", "named chief", "ceo", "cfo", "board of directors", "resigns", "retires")),
    ("capital-markets", ("prices", "offering", "notes due", "debentures", "senior notes", "subordinated")),
    ("preferred", ("preferred stock", "depositary shares", "preferred shares")),
    ("dividend", ("dividend",)),
    ("rating", ("downgrade", "upgrade", "rating", "moody", "s&p", "fitch")),
    ("regulatory", ("regulatory", "regulator", "sec ", "federal reserve", "federal register", "federalregister", "fdic", "doj", "ftc")),
    ("legal", ("lawsuit", "settlement", "litigation", "court")),
    ("mna", ("merger", "acquisition", "acquires", "buyout", "takeover")),
)
QUARTER_RESULTS = r"\bq[1-4]\s+results\b"
DEBT = ("notes", "debentures", "subordinated")
NEWS_KINDS = (("press-release", ("business wire", "pr newswire", "globenewswire")), ("filing", ("sec.gov", "edgar")), ("analysis", ("zacks", "stockstory", "insider monkey")))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def _shown(text: Column, form_type: Column, kind: Column) -> list[tuple[str, Column]]:
    has_form = F.coalesce(form_type != "", F.lit(False))
    rules = [("filing", has_form | (F.coalesce(kind, F.lit("")) == "filing"))]
    for name, words in KINDS:
        shown = _any(text, words)
        rules.append((name, shown | text.rlike(QUARTER_RESULTS) if name == "earnings" else shown))
    return rules + [(k, F.coalesce(kind, F.lit("")) == k) for k in ("analysis", "press-release")]


def item_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def event_kind(text: Column, form_type: Column, kind: Column) -> Column:
    """The first kind that item_text() shows; null if none."""
    return F.coalesce(*(F.when(on, F.lit(name)) for name, on in _shown(text, form_type, kind)))


def event_tags(text: Column, form_type: Column, kind: Column) -> Column:
    """All that it shows, sorted; a filing's form and 'debt' are tags of their own."""
    tags = [F.when(on, F.lit(name)) for name, on in _shown(text, form_type, kind)]
    markets = dict(KINDS)["capital-markets"]
    tags.append(F.when(F.coalesce(form_type != "", F.lit(False)), normalize_tag(form_type)))
    tags.append(F.when(_any(text, markets) & _any(text, DEBT), F.lit("debt")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))


def news_kind(source: Column, title: Column, link: Column) -> Column:
    text = F.lower(F.concat_ws(" ", source, title, link))
    return F.coalesce(*(F.when(_any(text, words), F.lit(kind)) for kind, words in NEWS_KINDS), F.lit("article"))
