"""Text, HTML and number formatting as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"""<[^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>"""
CDATA = r"(?s)<!\[CDATA\[(.*?)\]\]>"
#: The named entities that are decoded, in the order of nested replacement: the ampersand comes last.
NAMED_ENTITIES = (("&apos;", "'"), ("&gt;", ">"), ("&lt;", "<"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&"))


def strip_cdata(text: Column) -> Column:
    return F.regexp_replace(text, CDATA, "$1")


def strip_tags(text: Column) -> Column:
    """Each tag becomes a space; quoted attribute values may hold '>'."""
    return F.regexp_replace(text, TAG, " ")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


_PIECES = r"(?s)&(?:#x[0-9a-fA-F]+|#[0-9][0-9a-fA-F]*|[a-zA-Z]+);|[^&]+|&"


def character(code: Column) -> Column:
    """The character of a code point; null for one that isn't a character."""
    good = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _entity(piece: Column) -> Column:
    """What one piece of a text stands for: an entity's character, or itself."""
    named = None
    for name, char in NAMED_ENTITIES:
        named = F.when(piece == name, F.lit(char)) if named is None else named.when(piece == name, F.lit(char))
    coded = piece.startswith("&#") & piece.endswith(";")
    hexadecimal = F.conv(F.regexp_extract(piece, "^&#x([0-9a-fA-F]{1,8});$", 1), 16, 10).try_cast("long")
    decimal = F.regexp_extract(piece, "^&#([0-9]{1,9})", 1).try_cast("long")
    code = F.when(piece.startswith("&#x"), hexadecimal).otherwise(decimal)
    return F.coalesce(named, F.when(coded, character(code)), piece)


def decode_entities(text: Column) -> Column:
    """Six named entities and numeric ones, in one pass, so '&amp;lt;' gives '&lt;'; what isn't known stays.

    The text is cut into entities and what stands between them; only texts with an ampersand are."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, _entity), "")).otherwise(text)


def clean_text(text: Column) -> Column:
    """CDATA opened, entities decoded twice, tags dropped, white space collapsed."""
    return collapse_space(strip_tags(decode_entities(decode_entities(strip_cdata(text)))))


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x1f\x7f]")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def stable_id(*parts: Column) -> Column:
    """The trimmed parts that aren't empty, joined by '|'."""
    trimmed = [F.regexp_replace(p, r"^\s+|\s+$", "") for p in parts]
    return F.array_join(F.filter(F.array(*trimmed), lambda p: p.isNotNull() & (p != "")), "|")


# Unit names of sizes and their powers of 1024, however they are spelled.
SIZE_UNITS = {"b": 0, "byte": 0, "bytes": 0, "kb": 1, "kib": 1, "mb": 2, "mib": 2, "gb": 3, "gib": 3}


def byte_size(text: Column) -> Column:
    """Bytes of '1.5 MB' and the like, halves upward; null if it isn't a number with a unit."""
    split = F.regexp_extract_all(F.lower(F.trim(text)), F.lit(r"^([0-9][0-9.,\s]*|[.,][0-9.,\s]*)([a-z]+)$"), F.lit(1))
    number = F.regexp_replace(F.get(split, F.lit(0)), r"[\s,]", "").try_cast("double")
    unit = F.regexp_extract(F.lower(F.trim(text)), "([a-z]+)$", 1)
    power = F.create_map(*[F.lit(x) for unit_power in SIZE_UNITS.items() for x in unit_power])[unit]
    return F.floor(number * F.pow(F.lit(1024.0), power) + 0.5)


def normalize_tag(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition without marks is one letter or digit, and those with several."""
    one, many = {}, {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if plain != chr(code) and plain.isascii():
            (one if len(plain) == 1 else many)[chr(code)] = plain
    return one, many


_ONE, _MANY = _folds()


def fold_marks(text: Column) -> Column:
    """Letters and digits without marks, and compatibility forms as plain ones, for all that folds to ASCII. In SQL functions:
    a translation, and for the few characters that fold to several a replacement of those that occur."""
    plain = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit("[" + "".join(re.escape(c) for c in _MANY) + "]"), F.lit(0)))
    folds = F.create_map(*[F.lit(x) for pair in _MANY.items() for x in pair])
    whole = F.aggregate(found, plain, lambda so_far, c: F.replace(so_far, c, F.element_at(folds, c)))
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.regexp_replace(whole, "[\u0300-\u036f]", "")).otherwise(text)


def compare_form(text: Column) -> Column:
    """Without marks, in lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(fold_marks(text)), "[^a-z0-9]+", " "))


def surname(name: Column) -> Column:
    """The first token of 'Last, First', else the last token, in compare form."""
    parts = F.split(compare_form(name), " ")
    return F.when(name.contains(","), F.element_at(parts, 1)).otherwise(F.element_at(parts, -1))


def signed_integer(value: Column) -> Column:
    """Thousands separators and a sign; zero is '+0'."""
    rounded = F.floor(value + 0.5)
    return F.concat(F.when(rounded >= 0, "+").otherwise("-"), F.format_number(F.abs(rounded), 0))


def ipv4_number(ip: Column) -> Column:
    """The address as an integer; null unless it is four numbers of 0 to 255."""
    parts = F.split(ip, r"\.")
    numbers = [F.try_element_at(parts, F.lit(i)).try_cast("long") for i in range(1, 5)]
    total = ((numbers[0] * 256 + numbers[1]) * 256 + numbers[2]) * 256 + numbers[3]
    good = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for n in numbers:
        good = good & n.between(0, 255)
    return F.when(good, total)


def grouped_integer(value: Column) -> Column:
    """Thousands separators; halves upward."""
    rounded = F.floor(value + 0.5)
    return F.concat(F.when(rounded < 0, "-").otherwise(""), F.format_number(F.abs(rounded), 0))


def bilingual(name: Column, separator: str = "///") -> Column:
    """struct<first, second> of a name in two languages; second is null where there is one only."""
    parts = F.transform(F.split(name, re.escape(separator)), lambda x: F.trim(x))
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(F.coalesce(part(0), part(1)).alias("first"), F.when(part(0).isNotNull(), part(1)).alias("second"))


def page_count(cell: Column) -> Column:
    """The positive whole number that a cell such as '312' or '312[10]' begins with."""
    number = F.regexp_extract(F.trim(cell), r"^(\d+)", 1).try_cast("int")
    return F.when(number > 0, number)


def disposition_file_name(header: Column) -> Column:
    """The file name of a Content-Disposition header, the encoded form first, without folders or control characters."""
    encoded = F.try_url_decode(F.nullif(F.trim(F.regexp_extract(header, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1)), F.lit("")))
    quoted = F.nullif(F.regexp_extract(header, r'(?i)filename\s*=\s*"([^"]*)"', 1), F.lit(""))
    bare = F.nullif(F.trim(F.regexp_extract(header, r'(?i)filename\s*=\s*([^";]+)', 1)), F.lit(""))
    name = F.regexp_replace(strip_control(F.coalesce(encoded, quoted, bare)), r"^.*[/\\]", "")
    return F.when(~F.trim(name).isin("", ".", ".."), F.trim(name))


def soql_string(value: str) -> str:
    """A string literal of a query language that doubles its quotes."""
    return "'" + value.replace("'", "''") + "'"
