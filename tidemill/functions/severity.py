"""Ordered scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, weakest first.
SEVERITIES = ("unknown", "minor", "moderate", "severe", "extreme")
AVAILABILITIES = ("unknown", "metadata-only", "preview", "borrow", "open-access", "public-domain")


def rank(value: Column, scale: tuple[str, ...] = SEVERITIES) -> Column:
    """The place on the scale; 0 for anything that isn't on it."""
    return F.greatest(F.array_position(F.array(*map(F.lit, scale)), F.lower(value)).cast("int") - 1, F.lit(0))


def meets(value: Column, floor: str, scale: tuple[str, ...] = SEVERITIES) -> Column:
    return F.coalesce(rank(value, scale), F.lit(0)) >= scale.index(floor)


def stepped(value: Column, *steps: tuple[float, str], default: str = "unknown") -> Column:
    """The name of the first step, highest first, that the value reaches; the default below all and for null."""
    out = F.lit(default)
    for least, name in sorted(steps):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


# publishers' own words and the severities they stand for.
WEATHER = {"Extreme": "extreme", "Severe": "severe", "Moderate": "moderate", "Minor": "minor", "Unknown": "unknown"}
DISASTER = {"Red": "extreme", "Orange": "severe", "Green": "minor"}
STORM = {"HU": "severe", "TS": "moderate", "TD": "minor", "MH": "extreme"}
AIRPORT = {"Airport_Closure": "extreme", "Ground_Stop": "severe", "Ground_Delay": "moderate", "Arrival_Departure_Delay": "minor"}
VOLCANO = {"WARNING": "extreme", "WATCH": "severe", "ADVISORY": "moderate", "NORMAL": "minor"}
TSUNAMI = (("warning", "extreme"), ("watch", "severe"), ("advisory", "moderate"), ("information|statement", "minor"))
KNOTS, GOLDSTEIN, RATIOS = 96.0, -7.0, ((3.0, "extreme"), (2.0, "severe"), (1.5, "moderate"), (0.0, "minor"))


def named(value: Column, names: dict[str, str]) -> Column:
    """The severity that a publisher's word stands for; unknown for any other."""
    found = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]
    return F.coalesce(found, F.lit("unknown"))


def storm(classification: Column, knots: Column) -> Column:
    """By class; any storm of 96 knots or more is extreme."""
    return F.when(knots >= KNOTS, "extreme").otherwise(named(F.upper(F.trim(classification)), STORM))


def tsunami(title: Column) -> Column:
    """By the first of several words that the title has."""
    out = None
    for pattern, name in TSUNAMI:
        on = title.rlike(f"(?i){pattern}")
        out = F.when(on, name) if out is None else out.when(on, name)
    return out.otherwise("unknown")


def conflict(quad_class: Column, goldstein: Column) -> Column:
    """Material conflict is severe, and extreme at -7 and below; verbal conflict is moderate, all else minor."""
    return F.when((quad_class == 4) & (goldstein <= GOLDSTEIN), "extreme").when(quad_class == 4, "severe").when(quad_class == 3, "moderate").otherwise("minor")


def discharge(ratio: Column) -> Column:
    """By a river's forecast peak over its usual discharge."""
    return stepped(ratio, *RATIOS)
