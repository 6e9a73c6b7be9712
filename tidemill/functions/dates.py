"""Publication dates: text in one of several layouts to an instant. A text that has a layout's shape but isn't a real date
gives null; it isn't tried as another layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts, month names in order, and minutes east of UTC of the zone names that mail dates may use.
ISO = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(Z|z|[+-]\d{2}:?\d{2})?$"
DATE_ONLY = r"^(\d{4})-(\d{2})-(\d{2})$"
RFC_822 = r"(?i)^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s*,\s*)?(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{2,4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(UT|GMT|UTC|Z|EST|EDT|CST|CDT|MST|MDT|PST|PDT|[+-]\d{4})?$"
GDELT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$"
DOTNET = r"^/Date\((-?\d+)(?:[+-](\d{2})(\d{2}))?\)/$"
FINVIZ = r"(?i)^([A-Z][a-z]{2})-(\d{2})-(\d{2})\s+(\d{1,2}):(\d{2})([AP]M)$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"UT": 0, "GMT": 0, "UTC": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


LAYOUTS = {"iso_8601": ISO, "date_only": DATE_ONLY, "rfc_822": RFC_822, "gdelt": GDELT, "dotnet": DOTNET, "finviz": FINVIZ}
#: How many groups each layout has.
GROUPS = {"iso_8601": 8, "date_only": 3, "rfc_822": 7, "gdelt": 6, "dotnet": 3, "finviz": 6}
_MARK = "\x1f"


def _instant(year, month, day, hour, minute, second, zone_minutes, micros=None) -> Column:
    """A UTC timestamp; null if the parts aren't a real time. A second of 60 rolls over."""
    leap = second == 60
    base = F.try_make_timestamp(year, month, day, hour, minute, F.when(leap, F.lit(59)).otherwise(second).cast("decimal(8,6)"))
    us = F.unix_micros(base) + F.when(leap, F.lit(1_000_000)).otherwise(F.lit(0)) - zone_minutes.cast("long") * 60_000_000
    return F.timestamp_micros(us + micros if micros is not None else us)


def _zone(zone: Column) -> Column:
    """Minutes east of UTC; no zone is UTC; null for an impossible one."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.translate(zone, "+-:", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.upper(zone)]
    return F.when(zone == "", F.lit(0)).otherwise(F.coalesce(named, F.when((hours <= 23) & (minutes <= 59), sign * (hours * 60 + minutes))))


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("int"), F.lit(0))


def published_format(text: Column) -> Column:
    """Which layout the trimmed text has; null if none."""
    t = F.trim(text)
    out = None
    for name, pattern in LAYOUTS.items():
        out = F.when(t.rlike(pattern), name) if out is None else out.when(t.rlike(pattern), name)
    return out


def _instants(kind: Column, part: Callable[[int], Column]) -> Column:
    """The instant of the parts of a layout; part(k) is its k-th group."""
    number = lambda *places: [part(k).try_cast("int") for k in places]
    zero = F.lit(0)
    fraction = F.rpad(F.substring(part(7), 1, 3), 3, "0").try_cast("long")
    iso = _instant(*number(1, 2, 3, 4, 5), F.coalesce(*number(6), zero), _zone(part(8)), F.coalesce(fraction, zero) * 1000)
    date_only = _instant(*number(1, 2, 3), zero, zero, zero, zero)
    (year,), digits = number(3), F.length(part(3))
    year = F.when(digits == 2, F.when(year < 50, year + 2000).otherwise(year + 1900)).when(digits == 3, year + 1900).otherwise(year)
    rfc = _instant(year, _month(part(2)), *number(1, 4, 5), F.coalesce(*number(6), zero), _zone(part(7)))
    gdelt = _instant(*number(1, 2, 3, 4, 5, 6), zero)
    millis = part(1).try_cast("long")
    offset_ok = F.coalesce(part(2).try_cast("int") <= 23, F.lit(True)) & F.coalesce(part(3).try_cast("int") <= 59, F.lit(True))
    dotnet = F.when(offset_ok & (millis > 0) & (millis <= 8_640_000_000_000_000), F.timestamp_millis(millis))
    (hour12,) = number(4)
    hour = hour12 % 12 + F.when(F.upper(part(6)) == "PM", 12).otherwise(0)
    local = F.when(hour12.between(1, 12), _instant(number(3)[0] + 2000, _month(part(1)), *number(2), hour, *number(5), zero, zero))
    utc = F.to_utc_timestamp(local, "America/New_York")
    # A time in the hour that spring skips comes back changed: it's no time.
    finviz = F.when(F.from_utc_timestamp(utc, "America/New_York") == local, utc)
    out = None
    for name, value in zip(LAYOUTS, (iso, date_only, rfc, gdelt, dotnet, finviz), strict=True):
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def published_at(text: Column) -> Column:
    """The instant of a publication date. The layout is told once and its groups are taken out by one pass over the text."""
    t = F.trim(text)

    def with_kind(kind: Column) -> Column:
        found = None
        for name, pattern in LAYOUTS.items():
            groups = F.split(F.regexp_replace(t, pattern, _MARK.join(["", *(f"${k}" for k in range(1, GROUPS[name] + 1))])), _MARK)
            found = F.when(kind == name, groups) if found is None else found.when(kind == name, groups)
        return F.element_at(F.transform(F.array(found), lambda p: _instants(kind, lambda k: F.get(p, F.lit(k)))), 1)

    # A variable of a lambda is computed once, so the patterns aren't matched again for each part.
    return F.element_at(F.transform(F.array(published_format(text)), with_kind), 1)


def date_only(text: Column) -> Column:
    """The UTC date of an ISO date or date-time; null for any other layout."""
    return F.when(published_format(text).isin("iso_8601", "date_only"), published_at(text).cast("date"))


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date of numbers as text; null if there is no such day."""
    return F.try_make_timestamp(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _dated(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), real_date(part(year), part(month), part(day)))


def us_date(text: Column) -> Column:
    """MM/DD/YYYY with both digits of month and day."""
    return _dated(text, r"^(\d{2})/(\d{2})/(\d{4})$", 3, 1, 2)


def loose_us_date(text: Column) -> Column:
    """M/D/YYYY, perhaps with a time, or YYYY-MM-DD."""
    t = F.trim(text)
    return F.coalesce(_dated(t, r"^(\d{4})-(\d{2})-(\d{2})$", 1, 2, 3), _dated(t, r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+\d{1,2}:\d{2}:\d{2}\s*(?:AM|PM)?)?$", 3, 1, 2))


def open_ended(date: Column) -> Column:
    """A date, or null for the last day of the year 9999, which stands for no end."""
    return F.nullif(date, F.lit("9999-12-31").cast("date"))


def compact_date(text: Column) -> Column:
    """YYYYMMDD."""
    return _dated(text, r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3)


def compact_us_date(text: Column) -> Column:
    """MMDDYYYY."""
    return _dated(text, r"^(\d{2})(\d{2})(\d{4})$", 3, 1, 2)


def map_date(text: Column) -> Column:
    """YYYYMMDD, or a date-time that begins with YYYY-MM-DD."""
    t = F.trim(text)
    return F.coalesce(compact_date(t), _dated(t, r"^(\d{4})-(\d{2})-(\d{2})", 1, 2, 3))


def excel_date(serial: Column) -> Column:
    """The date of a spreadsheet's serial number, time of day dropped; null for day 60, which never was, and beyond 9999."""
    day = F.floor(serial).cast("int")
    kept = (serial >= 0) & (serial < 2_958_466) & (day != 60)
    return F.when(kept, F.date_add(F.lit("1899-12-31").cast("date"), F.when(day < 60, day).otherwise(day - 1)))


def month_end(year: Column, month: Column) -> Column:
    """The last day of a month; null for years without four digits and months beyond 12."""
    return F.when(year.between(1000, 9999) & month.between(1, 12), F.last_day(F.make_date(year, month, F.lit(1))))


# Three-month seasons by the month in their middle, from January on.
SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")


def season_end(season: Column, year: Column) -> Column:
    """The last day of the month in the middle of a three-month season."""
    month = F.nullif(F.array_position(F.array(*map(F.lit, SEASONS)), season).cast("int"), F.lit(0))
    return month_end(year, month)


def pacific_date(at: Column) -> Column:
    return F.from_utc_timestamp(at, "America/Los_Angeles").cast("date")
