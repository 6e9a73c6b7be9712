"""Order-dependent merges without gathering a key's rows.

Input order has to be a column, `seq`, because tables have none. Nothing here uses first() or dropDuplicates().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the smallest seq of each key. The window's limit of one row is taken before the shuffle, too."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def news_score(published_at: Column, provider: Column, url: Column, summary: Column, canonical_url: Column, event_kind: Column) -> Column:
    """How much an item says, but for its tags, which count one more."""
    one = lambda on, n=1: F.when(F.coalesce(on, F.lit(False)), n).otherwise(0)
    return one(published_at.isNotNull(), 4) + one(provider == "sec-edgar", 3) + one(url.contains("sec.gov") | url.contains("businesswire.com"), 2) + one(summary != "") + one(canonical_url != "") + one(event_kind.isNotNull())


def fold_winner(df: DataFrame, key: str, seq: str, score: str, tagged: str) -> DataFrame:
    """key, seq, score of the item that an ordered fold keeps.

    The fold goes through a key's rows by seq and keeps one; a row takes its place if its own score, plus one if it is tagged,
    is larger than the kept row's plus one if any row so far was tagged. Once a row has been met, a later one of the same score
    and tagging can't win any more: either the earlier one was kept, and equal isn't larger, or it lost to a kept row whose score
    only grows. So the first row of each (key, score, tagged) is enough, a few dozen at most for a key, found by a partial
    aggregate; the fold runs over those. A key with a third of all rows costs no more than another.
    """
    firsts = df.groupBy(key, score, tagged).agg(F.min(seq).alias("__seq"))
    rows = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__seq").alias("seq"), F.col(score).cast("int").alias("score"), F.col(tagged).cast("boolean").alias("tagged")))).alias("__rows"))
    start = F.struct(F.lit(None).cast(df.schema[seq].dataType).alias("seq"), F.lit(-1).alias("score"), F.lit(False).alias("tagged"))

    def step(kept: Column, row: Column) -> Column:
        wins = row["score"] + row["tagged"].cast("int") > kept["score"] + kept["tagged"].cast("int")
        any_tag = kept["tagged"] | row["tagged"]
        return F.struct(F.when(wins, row["seq"]).otherwise(kept["seq"]).alias("seq"), F.when(wins, row["score"]).otherwise(kept["score"]).alias("score"), any_tag.alias("tagged"))

    kept = rows.select(key, F.aggregate("__rows", start, step).alias("__kept"))
    return kept.select(key, F.col("__kept.seq").alias(seq), (F.col("__kept.score") + F.col("__kept.tagged").cast("int")).alias(score))


def merge_news(items: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One row for each key: the fold's winner with all columns of items, the sorted unions `providers`, `all_tags` and `tickers`,
    and `provenance`, the distinct (provider, source, url) of its items, sorted.

    items: key, seq, provider, source, url, published_at, summary, canonical_url, event_kind, tags, related_tickers. All sets come
    from one table of distinct (key, what, value) rows, so a hot key's rows shrink before they meet.
    """
    has_tags = F.coalesce(F.size("tags") > 0, F.lit(False))
    scored = items.withColumn("__score", news_score(*(F.col(c) for c in ("published_at", "provider", "url", "summary", "canonical_url", "event_kind")))).withColumn("__tagged", has_tags)
    winners = fold_winner(scored, key, seq, "__score", "__tagged").withColumnRenamed("__score", "score")
    nothing = F.lit(None).cast("string")
    entry = lambda what, a, b=nothing, c=nothing: F.struct(F.lit(what).alias("what"), a.alias("a"), b.alias("b"), c.alias("c"))
    several = lambda what, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: entry(what, v))
    own = F.array(entry("providers", F.col("provider")), entry("provenance", F.col("provider"), F.col("source"), F.col("url")))
    entries = F.concat(own, several("all_tags", F.col("tags")), several("tickers", F.col("related_tickers")))
    values = items.select(F.col(key).alias("__key"), F.inline(entries)).distinct()
    of = lambda what, value: F.array_sort(F.collect_list(F.when(F.col("what") == what, value))).alias(what)
    origin = F.struct(F.col("a").alias("provider"), F.col("b").alias("source"), F.col("c").alias("url"))
    sets = values.groupBy("__key").agg(*(of(w, F.col("a")) for w in ("providers", "all_tags", "tickers")), of("provenance", origin))
    return items.join(winners, [key, seq]).join(sets, F.col(key) == sets["__key"]).drop("__key")


def first_non_null(df: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """For each key and column the value of the earliest row that has one."""
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns))
