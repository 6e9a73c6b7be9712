"""Range joins as equi-joins on buckets of the range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, order: str, width: float, small: int = 10_000) -> DataFrame:
    """Each row of points with the first range, by order, that holds it (both ends count); null if none does.

    Ranges are laid over buckets of `width`, so the join is on the bucket and never all against all; width should be near
    the usual size of a range. points needs a column `__id` that tells its rows apart. At most `small` ranges are broadcast, so
    points don't move but to find the first of several; more ranges join by bucket."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    few = ranges.limit(small + 1).count() <= small
    near = F.broadcast(spread) if few else spread
    holds = (F.col("__at") == F.col("__bucket")) & F.col(point).between(F.col(low), F.col(high))
    met = points.withColumn("__at", bucket(point)).join(near, holds, "left").drop("__at", "__bucket")
    if not few:
        return met.withColumn("__place", F.row_number().over(Window.partitionBy("__id").orderBy(F.asc_nulls_last(order)))).where("__place = 1").drop("__place")
    # The first range of each point: a partial aggregate, so only points in several ranges cost more than one row.
    first = F.min_by(F.struct(*ranges.columns), F.col(order))
    return met.groupBy(*points.columns).agg(first.alias("__first")).select(*points.columns, "__first.*")


def checked_ranges(rows: DataFrame, ranges: DataFrame, address: str, stated: str, label: str, low: str, high: str) -> DataFrame:
    """rows with the column `number` of their IPv4 address, each in a range of its own label and equal to the number it states.

    Raises at the first row that isn't: such a table is broken as a whole. ranges: label, low, high."""
    from tidemill.functions.text import ipv4_number

    numbered = rows.withColumn("number", ipv4_number(F.col(address))).withColumn("__id", F.monotonically_increasing_id())
    own = ranges.select(F.col(label).alias("__label"), F.col(low).alias("__low"), F.col(high).alias("__high"))
    inside = (F.col(label) == F.col("__label")) & F.col("number").between(F.col("__low"), F.col("__high")) & (F.col("number") == F.col(stated))
    bad = numbered.join(own, inside, "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][address]} isn't in a range of {bad[0][label]} or isn't {bad[0][stated]}")
    return numbered.drop("__id")
