"""Does a text mention a subject?"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, AFTER = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"


def _quoted(term: str) -> str:
    return r"\s+".join(re.escape(part) for part in term.split())


def mentions_query(text: Column, query: str) -> Column:
    """Every word of the query occurs, in any case, as a whole word. An empty query matches nothing."""
    words = [w for w in (w.strip("\"'") for w in query.split()) if w]
    out = F.lit(bool(words))
    for w in words:
        out = out & text.rlike(f"(?i){BEFORE}{_quoted(w)}{AFTER}")
    return out


def mentions_phrase(text: Column, phrase: str) -> Column:
    return text.rlike(f"(?i){BEFORE}{_quoted(phrase)}{AFTER}") if phrase.strip() else F.lit(False)


def mentions_ticker(text: Column, ticker: str) -> Column:
    """In upper case as a whole word; a ticker of one letter only after '$' or an exchange's name and a colon."""
    t = re.escape(ticker.strip().upper())
    if not t:
        return F.lit(False)
    return text.rlike(rf"(?:\$|[A-Z]{{2,}}:\s?){t}{AFTER}" if len(t) == 1 else f"{BEFORE}{t}{AFTER}")


def mentions(text: Column, query: str = "", company: str = "", ticker: str = "") -> Column:
    return mentions_query(text, query) | mentions_phrase(text, company) | mentions_ticker(text, ticker)


def research_form(text: Column) -> Column:
    """Lower case with runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def research_match(text: Column, query: str) -> Column:
    """Every word of the query is part of the text."""
    form = research_form(text)
    out = F.lit(True)
    for w in re.sub(r"[\W_]+", " ", query.lower()).split():
        out = out & form.contains(w)
    return out
