"""Derived series: frequencies, changes, gates, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate_frequency(df: DataFrame, date: str, value: str, unit: str, method: str = "avg") -> DataFrame:
    """period, value: observations of a finer series by week, month, quarter or year: avg, sum or eop (the last one)."""
    how = {"avg": F.avg(value), "sum": F.sum(value), "eop": F.max_by(value, date)}[method]
    return df.groupBy(F.date_trunc(unit, date).cast("date").alias("period")).agg(how.alias("value"))


def change(df: DataFrame, order: str, value: str, units: str, per_year: int = 12, by: list[str] | None = None) -> Column:
    """A transformed value: chg, ch1 (on a year before), pch, pc1 (percent), pca (compound annual), cch, cca (logarithmic), log."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    now, before, year = F.col(value), F.lag(value).over(w), F.lag(value, per_year).over(w)
    log = lambda c: F.when(c > 0, F.ln(c))
    return {
        "lin": now,
        "chg": now - before,
        "ch1": now - year,
        "pch": F.try_divide(now, before) * 100 - 100,
        "pc1": F.try_divide(now, year) * 100 - 100,
        "pca": (F.pow(F.try_divide(now, before), per_year) - 1) * 100,
        "cch": (log(now) - log(before)) * 100,
        "cca": (log(now) - log(before)) * 100 * per_year,
        "log": log(now),
    }[units]


def carry_forward(value: str, order: list[str], by: list[str]) -> Column:
    """The value, or the last one before it in the order."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def changed(value: str, order: list[str], by: list[str]) -> Column:
    """True where the value isn't that of the row before: the first of each run."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return ~F.col(value).eqNullSafe(before) | F.lag(F.lit(1)).over(Window.partitionBy(*by).orderBy(*order)).isNull()


def as_of(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """The vintage of a series that was known on a date."""
    return df.where((F.col(start) <= F.lit(date).cast("date")) & (F.col(end) >= F.lit(date).cast("date")))


def top_counts(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group; ties go to the smaller value; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
