"""Joins of the data lanes: by position, by codes of several spellings, of parts of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_position(left: Column, right: Column) -> Column:
    """Two arrays as one array of struct<left, right>; raises where they aren't equally long."""
    same = F.assert_true(F.size(left) == F.size(right), F.lit("arrays of different lengths"))
    zipped = F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.when(same.isNull(), zipped)


def zipped(**arrays: Column) -> Column:
    """Parallel arrays as one array of structs as long as the longest; the others are filled with nulls."""
    n = F.greatest(F.lit(0), *(F.size(a) for a in arrays.values()))
    places = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    return F.transform(places, lambda i: F.struct(*(F.get(a, i).alias(name) for name, a in arrays.items())))


def by_any_code(rows: DataFrame, presets: DataFrame, code: str, codes: str) -> DataFrame:
    """rows with the columns of the first preset, in order of its name, of whose codes (an array, historical ones too) the row's is one.

    presets are few; a row without a preset stays."""
    names = [c for c in presets.columns if c != codes]
    each = presets.select(F.explode(codes).alias("__code"), F.struct(*names).alias("__preset")).groupBy("__code").agg(F.min("__preset").alias("__preset"))
    return rows.join(F.broadcast(each), F.col(code) == F.col("__code"), "left").select(*rows.columns, "__preset.*")


def label(code: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """What a code stands for."""
    found = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[code]
    return found if default is None else F.coalesce(found, F.lit(default))


def stitched(parts: DataFrame, keys: list[str], part: str, name: str, value: str) -> DataFrame:
    """The cells of a table that came in several parts, long: keys, name, value; of a cell that several parts fill the last one's.

    Empty cells count for nothing. It's the full outer join of the parts on their keys, without one column for each name."""
    filled = parts.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    return filled.groupBy(*keys, name).agg(F.max_by(value, part).alias(value))


def folded(cells: DataFrame, keys: list[str], name: str, value: str, wanted: list[str] | None = None) -> DataFrame:
    """One row for each key with a map of its cells; only wanted names, chosen before anything is folded, and no row without one."""
    kept = cells if wanted is None else cells.where(F.col(name).isin(*wanted))
    return kept.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("values"))


def paired(labels: DataFrame, actions: DataFrame, buttons: DataFrame, key: str) -> DataFrame:
    """Labels with their action and their button; raises where one has none or several."""
    marked = labels.join(actions, key, "left").join(buttons, key, "left")
    other = [c for c in actions.columns + buttons.columns if c != key]
    whole = F.col(other[0]).isNotNull()
    for c in other[1:]:
        whole = whole & F.col(c).isNotNull()
    bad = marked.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(whole).alias("whole")).where("n > 1 or not whole").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][key]}: not one action and one button")
    return marked


def preferred(rows: DataFrame, by: list[str], *preference: Column) -> DataFrame:
    """The row of each group that comes first by preferences, each of which puts what is true, or larger, first."""
    w = Window.partitionBy(*by).orderBy(*(p.desc_nulls_last() for p in preference))
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def ends(rows: DataFrame, by: list[str], order: str, n: int, last: bool = True) -> DataFrame:
    """The last or first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc() if last else F.col(order))
    return rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).drop("__place")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The number-th page, from 1 on, of rows in an order."""
    if number < 1 or size < 0:
        raise ValueError("pages count from 1 on, and their size from 0 on")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def with_errors(parts: dict[str, DataFrame], failures: dict[str, str], columns: list[str]) -> DataFrame:
    """The rows of all parts with their part's name, and a row with an error for each part that failed."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), *columns, F.lit(None).cast("string").alias("error"))
        out = one if out is None else out.unionByName(one)
    spark = out.sparkSession
    lost = spark.createDataFrame(sorted(failures.items()), "part string, error string")
    return out.unionByName(lost, allowMissingColumns=True)
