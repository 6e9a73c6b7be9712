"""Identifiers of works: ISBN and DOI."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once, however often f names it: a column is otherwise repeated wherever it's named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _weighted(body: Column, weights: list[int]) -> Column:
    """The sum of the first digits times weights; null if one isn't a digit."""
    return _once(body, lambda b: reduce(add, (F.substring(b, i, 1).try_cast("int") * w for i, w in enumerate(weights, 1))))


def isbn13_check_digit(body: Column) -> Column:
    """The check digit of the first twelve digits, as text."""
    return ((F.lit(10) - _weighted(body, [1, 3] * 6) % 10) % 10).cast("string")


def isbn10_check_digit(body: Column) -> Column:
    """The check digit of the first nine digits; ten is 'X'."""
    return F.element_at(F.array(*map(F.lit, "0123456789X")), (F.lit(11) - _weighted(body, list(range(10, 1, -1))) % 11) % 11 + 1)


def _if_valid(bare: Column) -> Column:
    ten = bare.rlike(r"^\d{9}[\dX]$") & (isbn10_check_digit(bare) == F.substring(bare, 10, 1))
    thirteen = bare.rlike(r"^\d{13}$") & (isbn13_check_digit(bare) == F.substring(bare, 13, 1))
    return F.when(ten | thirteen, bare)


def normalize_isbn(text: Column) -> Column:
    """The bare ISBN-10 or ISBN-13 if its check digit is right, else null."""
    return _once(F.upper(F.regexp_replace(text, r"[\s-]", "")), _if_valid)


def _ten_to_13(isbn: Column) -> Column:
    body = F.concat(F.lit("978"), F.substring(isbn, 1, 9))
    return F.when(F.length(isbn) == 10, F.concat(body, isbn13_check_digit(body)))


def isbn10_to_13(text: Column) -> Column:
    return _once(normalize_isbn(text), _ten_to_13)


def extract_isbns(text: Column) -> Column:
    """All valid ISBNs of a text, in order, each once: thirteen digits from 978 or 979 on, perhaps set apart, or ten characters."""
    thirteen = r"97[89](?:[ -]?\d){10}"
    ten = r"\d{9}[\dXx]"
    found = F.regexp_extract_all(text, F.lit(rf"(?<!\w)({thirteen}|{ten})(?!\w)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, normalize_isbn), lambda x: x.isNotNull()))


def _identity(isbn: Column) -> Column:
    body = F.substring(isbn, 4, 9)
    as_ten = F.when((F.length(isbn) == 13) & isbn.startswith("978"), F.concat(body, isbn10_check_digit(body)))
    thirteen = F.when(F.length(isbn) == 13, isbn).otherwise(_ten_to_13(isbn))
    return F.struct(thirteen.alias("isbn13"), F.when(F.length(isbn) == 10, isbn).otherwise(as_ten).alias("isbn10"))


def isbn_identity(text: Column) -> Column:
    """struct<isbn13, isbn10> of one ISBN; the ten-digit form of a thirteen-digit one exists for 978 only."""
    return _once(normalize_isbn(text), _identity)


# Fixed value: what a DOI looks like.
DOI = r"^10\.\d{4,9}/\S+$"


def normalize_doi(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^https?://(?:dx\.)?doi\.org/", ""), r"^doi:\s*", ""))
    return F.when(bare.rlike(DOI), bare)
