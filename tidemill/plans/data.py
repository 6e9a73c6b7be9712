"""Queries of the data and event lanes: releases, series, positions, severities, diffs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import severity
from tidemill.operators import merge, series
from tidemill.plans.registry import query, read


@query("latest_as_of", "select o_orderkey, o_orderdate::date as as_of from orders where o_orderdate::date = (select max(o_orderdate::date) from orders)")
def latest_as_of(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("as_of"))
    newest = rows.agg(F.max("as_of").alias("as_of"))
    return rows.join(F.broadcast(newest), "as_of").select("o_orderkey", "as_of")  # one row


_NET = """select date_trunc('week', l_shipdate)::date as week, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as long_n, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as short_n from lineitem group by 1"""


def _positions(spark, sf_dir):
    side = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    return read(spark, sf_dir, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("week")).agg(side("R").alias("long_n"), side("A").alias("short_n"))


@query("cot_net_positions", f"select week, long_n, short_n, long_n - short_n as net from ({_NET})")
def cot_net_positions(spark, sf_dir):
    return _positions(spark, sf_dir).withColumn("net", F.col("long_n") - F.col("short_n"))


@query("cot_week_over_week", f"select week, (long_n - lag(long_n) over (order by week)) - (short_n - lag(short_n) over (order by week)) as net_change from ({_NET})")
def cot_week_over_week(spark, sf_dir):
    p = _positions(spark, sf_dir)  # a few hundred weeks
    return p.select("week", (series.change(p, "week", "long_n", "chg") - series.change(p, "week", "short_n", "chg")).alias("net_change"))


@query("grouped_count_sum", "select c_mktsegment, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1, 2")
def grouped_count_sum(spark, sf_dir):
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("grouped_dims_filters", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem where l_returnflag in ('A', 'R') and year(l_shipdate) >= 1994 and l_linenumber in (1, 2, 3) group by 1, 2")
def grouped_dims_filters(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") >= F.lit("1994-01-01").cast("timestamp_ntz")) & F.col("l_linenumber").isin(1, 2, 3))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def _daily(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))


_DAILY = "select ts::date as day, round(sum(value), 6) as v from events group by 1"


@query("fred_frequency_avg", f"select date_trunc('week', day)::date as period, round(avg(v), 6) as value from ({_DAILY}) group by 1")
def fred_frequency_avg(spark, sf_dir):
    return series.aggregate_frequency(_daily(spark, sf_dir), "day", "v", "week", "avg").withColumn("value", F.round("value", 6))


@query("fred_frequency_eop", f"select date_trunc('week', day)::date as period, arg_max(v, day) as value from ({_DAILY}) group by 1")
def fred_frequency_eop(spark, sf_dir):
    return series.aggregate_frequency(_daily(spark, sf_dir), "day", "v", "week", "eop")


_MONTHLY = "select date_trunc('month', o_orderdate)::date as period, round(sum(o_totalprice), 2) as value from orders group by 1"


def _monthly(spark, sf_dir):
    return series.aggregate_frequency(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "month", "sum").withColumn("value", F.round("value", 2))


@query("fred_units_pch", f"select period, round((value / lag(value) over w) * 100 - 100, 6) as pch, round((value / lag(value, 12) over w) * 100 - 100, 6) as pc1 from ({_MONTHLY}) window w as (order by period)")
def fred_units_pch(spark, sf_dir):
    m = _monthly(spark, sf_dir)
    return m.select("period", *(F.round(series.change(m, "period", "value", u), 6).alias(u) for u in ("pch", "pc1")))


@query("fred_units_log_cumulative", f"select period, round(ln(value), 6) as log, round((ln(value) - ln(lag(value) over w)) * 1200, 6) as cca from ({_MONTHLY}) window w as (order by period)")
def fred_units_log_cumulative(spark, sf_dir):
    m = _monthly(spark, sf_dir)
    return m.select("period", *(F.round(series.change(m, "period", "value", u), 6).alias(u) for u in ("log", "cca")))


@query("wide_to_long_map", "select p_partkey, code, value from (select p_partkey, unnest(['BRAND', 'TYPE', 'SIZE']) as code, unnest([p_brand, p_type, case when p_size > 10 then p_size::varchar end]) as value from part) where value is not null and value <> ''")
def wide_to_long_map(spark, sf_dir):
    wide = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("BRAND"), F.col("p_type").alias("TYPE"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).alias("SIZE"))
    return wide.unpivot("p_partkey", ["BRAND", "TYPE", "SIZE"], "code", "value").where("value <> ''")


@query("long_pivot", "select l_linenumber, sum(l_quantity) filter (l_returnflag = 'A') as a, sum(l_quantity) filter (l_returnflag = 'N') as n, sum(l_quantity) filter (l_returnflag = 'R') as r from lineitem group by 1")
def long_pivot(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).toDF("l_linenumber", "a", "n", "r")


@query("lineage_latest", "select l_orderkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc) = 1")
def lineage_latest(spark, sf_dir):
    return merge.latest(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("top3_counts", "select event_type, user_id, n from (select event_type, user_id, count(*) as n, row_number() over (partition by event_type order by count(*) desc, user_id) as place from events group by 1, 2) where place <= 3")
def top3_counts(spark, sf_dir):
    return series.top_counts(read(spark, sf_dir, "events"), ["event_type"], "user_id", 3).select("event_type", "user_id", "n")


@query("distinct_filers", "select l_returnflag, count(distinct l_suppkey) as filers, count(distinct l_partkey) as schedules from lineitem group by 1")
def distinct_filers(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("filers"), F.count_distinct("l_partkey").alias("schedules"))


_SEVERITY = "case when value >= 90 then 'extreme' when value >= 70 then 'severe' when value >= 40 then 'moderate' when value >= 10 then 'minor' else 'unknown' end"
_STEPS = ((90, "extreme"), (70, "severe"), (40, "moderate"), (10, "minor"))


@query("event_severity_case", f"select event_id, {_SEVERITY} as severity from events")
def event_severity_case(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", severity.stepped(F.col("value"), *_STEPS).alias("severity"))


@query("event_floor_filter", f"select event_id from events where {_SEVERITY} in ('severe', 'extreme')")
def event_floor_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").where(severity.meets(severity.stepped(F.col("value"), *_STEPS), "severe")).select("event_id")


@query("event_country_filter", "select s_suppkey, upper(n_name) as country from supplier join nation on s_nationkey = n_nationkey where upper(n_name) in ('NATION_1', 'NATION_3', 'FRANCE', 'GERMANY')")
def event_country_filter(spark, sf_dir):
    wanted = ("nation_1", "nation_3", "france", "Germany")
    joined = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", F.upper("n_name").alias("country")).where(F.col("country").isin(*(w.upper() for w in wanted)))


@query("event_sort", f"select event_id, severity from (select event_id, {_SEVERITY} as severity, value, ts from events) order by case severity when 'unknown' then 0 when 'minor' then 1 when 'moderate' then 2 when 'severe' then 3 else 4 end desc, ts desc, event_id limit 200")
def event_sort(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "ts", severity.stepped(F.col("value"), *_STEPS).alias("severity"))
    return rows.orderBy(severity.rank(F.col("severity")).desc(), F.col("ts").desc_nulls_last(), "event_id").limit(200).select("event_id", "severity")


@query("first_wins_distinct", "select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by 1, 2")
def first_wins_distinct(spark, sf_dir):
    return merge.first_wins(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("latest_frame_per_key", "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id) = 1")
def latest_frame_per_key(spark, sf_dir):
    frame = F.max_by(F.struct("event_id", "value"), F.struct("ts", -F.col("event_id"))).alias("f")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(frame).select("user_id", "f.event_id", "f.value")


@query(
    "median_peak_ratio",
    """with d as (select event_type, ts::date as day, round(sum(value), 6) as v from events group by 1, 2),
    m as (select event_type, quantile_cont(v, 0.5) filter (day <= date '2024-01-15') as base, max(v) filter (day > date '2024-01-15') as peak, arg_min(day, (-v, day)) filter (day > date '2024-01-15') as peak_day from d group by 1)
    select event_type, round(base, 6) as base, peak, peak_day, case when peak / base >= 3 then 'extreme' when peak / base >= 2 then 'severe' when peak / base >= 1.5 then 'moderate' else 'minor' end as severity from m""",
)
def median_peak_ratio(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))
    past = F.col("day") <= F.lit("2024-01-15").cast("date")
    peak_day = F.min_by("day", F.when(~past, F.struct(-F.col("v"), "day")))
    m = daily.groupBy("event_type").agg(F.percentile(F.when(past, F.col("v")), 0.5).alias("base"), F.max(F.when(~past, F.col("v"))).alias("peak"), peak_day.alias("peak_day"))
    ratio = F.try_divide("peak", "base")
    return m.select("event_type", F.round("base", 6).alias("base"), "peak", "peak_day", severity.stepped(ratio, (3, "extreme"), (2, "severe"), (1.5, "moderate"), default="minor").alias("severity"))


@query("anomaly_rate", "select user_id, count(*) as n, round(case when count(*) > 0 then count(*) filter (event_type = 'error') / count(*) end, 6) as rate from events group by 1")
def anomaly_rate(spark, sf_dir):
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return by.select("user_id", "n", F.round(F.try_divide("bad", "n"), 6).alias("rate"))


@query("added_events_diff", "select distinct user_id, event_type from events where ts::date = date '2024-01-10' and (user_id, event_type) not in (select (user_id, event_type) from events where ts::date = date '2024-01-09')")
def added_events_diff(spark, sf_dir):
    day = F.to_date("ts")
    events = read(spark, sf_dir, "events").select("user_id", "event_type", day.alias("day"))
    at = lambda d: events.where(F.col("day") == F.lit(d).cast("date")).select("user_id", "event_type")
    return at("2024-01-10").distinct().join(at("2024-01-09"), ["user_id", "event_type"], "left_anti")


@query("carry_forward", "select event_id, last_value(case when event_id % 3 = 0 then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as carried from events")
def carry_forward(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("known", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return events.select("event_id", series.carry_forward("known", ["ts", "event_id"], ["user_id"]).alias("carried"))


@query("failure_suppression", "select event_id, event_type from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id order by ts, event_id) as n from events) where event_type = 'error' and (n = 1 or before <> 'error')")
def failure_suppression(spark, sf_dir):
    """Errors that begin a run of errors."""
    events = read(spark, sf_dir, "events")
    return events.withColumn("new", series.changed("event_type", ["ts", "event_id"], ["user_id"])).where("new and event_type = 'error'").select("event_id", "event_type")


@query("vintage_as_of", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, o_orderdate::date as s, coalesce(lead(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey) - 1, date '9999-12-31') as e from orders) where s <= date '1995-06-30' and e >= date '1995-06-30'")
def vintage_as_of(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    vintages = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("s"), F.coalesce(F.date_sub(F.lead(day).over(w), 1), F.lit("9999-12-31").cast("date")).alias("e"))
    return series.as_of(vintages, "1995-06-30", "s", "e").select("o_custkey", "o_orderkey")


@query("grouping_sets_totals", "select n_regionkey, c_mktsegment, grouping_id(n_regionkey, c_mktsegment)::bigint as level, count(*) as n from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, c_mktsegment)")
def grouping_sets_totals(spark, sf_dir):
    """Region and grand totals beside the parts that they sum."""
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_regionkey", "c_mktsegment").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
