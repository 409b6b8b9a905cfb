"""Queries over time series, rankings and Pareto analysis."""

from pyspark.sql import functions as F

from loupe.operators import prepare, trend
from loupe.suite.registry import R, query, rounded, table

UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
STEP = {"D": "1 DAY", "W": "7 DAY", "M": "1 MONTH", "Q": "3 MONTH", "Y": "1 YEAR"}


def periods_sql(source: str, date: str, value: str, freq: str) -> str:
    """(p, start, period_end, value) with gaps filled by 0."""
    return f"""SELECT start, strftime(start + INTERVAL {STEP[freq]} - INTERVAL 1 DAY, '%Y-%m-%d') AS period_end,
  coalesce(total, 0.0) AS value FROM (SELECT unnest(generate_series(min(p), max(p), INTERVAL {STEP[freq]})) AS start FROM
    (SELECT CAST(date_trunc('{UNIT[freq]}', {date}) AS TIMESTAMP) AS p FROM {source}))
  LEFT JOIN (SELECT CAST(date_trunc('{UNIT[freq]}', {date}) AS TIMESTAMP) AS start, sum({value}) AS total FROM {source} GROUP BY ALL) USING (start)"""


def dated(df):
    return df.withColumn("period_end", F.date_format("period_end", "yyyy-MM-dd"))


@query("resample_sum", " UNION ALL ".join(
    f"SELECT '{f}' AS freq, period_end, {R('value', 2)} AS value FROM ({periods_sql('orders', 'o_orderdate', 'o_totalprice', f)})" for f in UNIT))
def resample_sum(spark, d):
    result = None
    for f in UNIT:
        part = trend.resample_sum(table(spark, d, "orders"), "o_orderdate", "o_totalprice", f).withColumn("freq", F.lit(f))
        result = part if result is None else result.unionByName(part)
    return rounded(dated(result), 2)


# A series with gaps: every event is moved to the last day before it that is a multiple of three days after the year began
MOVED = "(SELECT ts - INTERVAL 1 DAY * (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 3) AS ts, value FROM events)"


@query("resample_sum_gaps", f"SELECT period_end, {R('value', 2)} AS value FROM ({periods_sql(MOVED, 'ts', 'value', 'D')})")
def resample_sum_gaps(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.expr("ts - make_dt_interval(datediff(ts, DATE'2024-01-01') % 3)"))
    return rounded(dated(trend.resample_sum(events, "ts", "value", "D")), 2)


@query("timeseries_line", f"SELECT period_end, {R('value', 2)} AS value FROM ({periods_sql('orders', 'o_orderdate', 'o_totalprice', 'Q')})")
def timeseries_line(spark, d):
    return rounded(dated(trend.timeseries_line(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "Q")), 2)


@query("timeseries_stats", f"""
WITH p AS ({periods_sql("lineitem", "l_shipdate", "l_extendedprice", "M")}),
n AS (SELECT value, CAST(row_number() OVER (ORDER BY start) - 1 AS DOUBLE) AS i FROM p)
SELECT count(*) AS n_periods, {R("sum(value)", 2)} AS total, {R("avg(value)", 2)} AS mean, {R("min(value)", 2)} AS "min",
  {R("max(value)", 2)} AS "max", {R("stddev(value)", 2)} AS std, {R("regr_slope(value, i)", 2)} AS trend_slope,
  CASE WHEN regr_slope(value, i) > 0 THEN 'up' WHEN regr_slope(value, i) < 0 THEN 'down' ELSE 'flat' END AS trend FROM n""")
def timeseries_stats(spark, d):
    return rounded(trend.timeseries_stats(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice", "M"), 2)


@query("eda_timeseries", f"SELECT period_end, {R('value', 2)} AS value FROM ({periods_sql('events', 'ts', 'value', 'M')})")
def eda_timeseries(spark, d):
    return rounded(dated(trend.eda_timeseries(table(spark, d, "events"), "ts", "value", "M")), 2)


def growth_sql(freq: str) -> str:
    return f"""p AS ({periods_sql("orders", "o_orderdate", "o_totalprice", freq)}),
g AS (SELECT *, lag(value) OVER (ORDER BY start) AS base FROM p),
h AS (SELECT *, (value - base) / nullif(base, 0) AS growth FROM g)"""


@query("timeseries_growth", f"""
WITH {growth_sql("Q")} SELECT period_end, {R("value", 2)} AS value, {R("growth * 100")} AS growth_pct FROM h WHERE growth IS NOT NULL""")
def timeseries_growth(spark, d):
    return rounded(dated(trend.timeseries_growth(table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="Q")), value=2)


@query("timeseries_growth_yoy", f"""
WITH {growth_sql("Y")} SELECT period_end, {R("value", 2)} AS value, {R("growth * 100")} AS growth_pct FROM h WHERE growth IS NOT NULL""")
def timeseries_growth_yoy(spark, d):
    return rounded(dated(trend.timeseries_growth(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "yoy")), value=2)


@query("growth_stats", f"""
WITH {growth_sql("Q")} SELECT {R("avg(growth) * 100")} AS mean_growth, {R("stddev(growth) * 100")} AS std_growth,
  count(*) FILTER (WHERE growth > 0) AS positive_periods, count(*) FILTER (WHERE growth < 0) AS negative_periods,
  {R("stddev(growth) / greatest(abs(avg(growth)), 1e-10)")} AS volatility, count(*) FILTER (WHERE base = 0) AS zero_bases FROM h""")
def growth_stats(spark, d):
    return rounded(trend.growth_stats(table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="Q"))


@query("fast_growth", f"""
WITH {growth_sql("M")} SELECT period_end, {R("value", 2)} AS value, {R("growth * 100")} AS growth_pct FROM h
WHERE growth > (SELECT avg(growth) + stddev(growth) FROM h)""")
def fast_growth(spark, d):
    return rounded(dated(trend.fast_growth(table(spark, d, "orders"), "o_orderdate", "o_totalprice")), value=2)


def moving_sql(source: str, key: str, order: str, value: str, before: int, after: int, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    frame = f"({part} ORDER BY {order} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"""SELECT {key}, {value} AS original, CASE WHEN count(*) OVER {frame} = {before + after + 1}
  THEN {R(f"avg({value}) OVER {frame}", 6)} END AS moving_avg FROM {source}"""


@query("moving_average", moving_sql("events", "event_id", "ts, event_id", "value", 4, 3))
def moving_average(spark, d):
    smooth = trend.moving_average(table(spark, d, "events"), "ts", "value", 8, tie_by=["event_id"])
    return rounded(smooth.drop("date"), 6)


@query("moving_average_keys", moving_sql("events", "event_id, event_type", "ts, event_id", "value", 3, 3, "event_type"))
def moving_average_keys(spark, d):
    smooth = trend.moving_average(table(spark, d, "events"), "ts", "value", 7, ["event_id"], ["event_type"])
    return rounded(smooth.drop("date"), 6)


@query("moving_average_auto", f"""
WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i, greatest(3, count(*) OVER () // 20) AS w FROM events),
s AS (SELECT *, (w - 1) // 2 AS after, w - 1 - (w - 1) // 2 AS before FROM r)
SELECT event_id, value AS original, CASE WHEN count(*) OVER f = w THEN {R("avg(value) OVER f", 6)} END AS moving_avg
FROM s WINDOW f AS (ORDER BY i ROWS BETWEEN before PRECEDING AND after FOLLOWING)""")
def moving_average_auto(spark, d):
    return rounded(trend.moving_average(table(spark, d, "events"), "ts", "value", 0, ["event_id"]).drop("date"), 6)


#: one value of 1e18 in a thousand, which no other frame may feel
SPIKED = "(SELECT event_id, ts, CASE WHEN event_id % 1000 = 5 THEN 1e18 ELSE value END AS value FROM events)"


def spiked(spark, d):
    return table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 1000 == 5, 1e18).otherwise(F.col("value")))


def spike_sql(before: int, after: int) -> str:
    return f"""SELECT event_id, round(least(original, 1e9), 6) AS original, CASE WHEN moving_avg IS NOT NULL THEN round(least(moving_avg, 1e9), 6) END AS moving_avg
  FROM ({moving_sql(SPIKED, "event_id", "ts, event_id", "value", before, after)})"""


def spike_average(spark, d, window: int):
    smooth = trend.moving_average(spiked(spark, d), "ts", "value", window, tie_by=["event_id"])
    top = F.lit(1e9)
    return smooth.select(
        "event_id", F.round(F.least("original", top), 6).alias("original"), F.when(F.col("moving_avg").isNotNull(), F.round(F.least("moving_avg", top), 6)).alias("moving_avg")
    )


@query("moving_average_spike", spike_sql(25, 24))
def moving_average_spike(spark, d):
    return spike_average(spark, d, 50)


@query("moving_average_spike_wide", spike_sql(2500, 2499))
def moving_average_spike_wide(spark, d):
    return spike_average(spark, d, 5000)


def decompose_sql(source: str, key: str, order: str, value: str, period: int, keys: str = "") -> str:
    after = (period - 1) // 2
    before = period - 1 - after
    part = f"PARTITION BY {keys}" if keys else ""
    also = f"{keys}, " if keys else ""
    frame = f"({part} ORDER BY {order} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"""a AS (SELECT {also}{key}, {value} AS v, row_number() OVER ({part} ORDER BY {order}) - 1 AS i,
  CASE WHEN count(*) OVER {frame} = {period} THEN avg({value}) OVER {frame} END AS trend FROM {source}),
b AS (SELECT *, avg(v - trend) OVER (PARTITION BY {also}i % {period}) AS seasonal FROM a),
c AS (SELECT *, v - trend - seasonal AS residual FROM b)"""


@query("timeseries_decompose", f"""
WITH {decompose_sql("events", "event_id", "ts, event_id", "value", 12)}
SELECT event_id, v AS original, {R("trend", 6)} AS trend, {R("seasonal", 6)} AS seasonal, {R("residual", 6)} AS residual FROM c""")
def timeseries_decompose(spark, d):
    parts = trend.timeseries_decompose(table(spark, d, "events"), "ts", "value", 12, ["event_id"])
    return rounded(parts.drop("date"), 6)


@query("timeseries_decompose_24", f"""
WITH {decompose_sql("events", "event_id", "ts, event_id", "value", 24)}
SELECT event_id, v AS original, {R("trend", 6)} AS trend, {R("seasonal", 6)} AS seasonal, {R("residual", 6)} AS residual FROM c""")
def timeseries_decompose_24(spark, d):
    parts = trend.timeseries_decompose(table(spark, d, "events"), "ts", "value", 24, ["event_id"])
    return rounded(parts.drop("date"), 6)


@query("timeseries_decompose_keys", f"""
WITH {decompose_sql("events", "event_id", "ts, event_id", "value", 7, "event_type")}
SELECT event_id, event_type, v AS original, {R("trend", 6)} AS trend, {R("seasonal", 6)} AS seasonal, {R("residual", 6)} AS residual FROM c""")
def timeseries_decompose_keys(spark, d):
    parts = trend.timeseries_decompose(table(spark, d, "events"), "ts", "value", 7, ["event_id"], ["event_type"])
    return rounded(parts.drop("date"), 6)


@query("timeseries_decompose_monthly", f"""
WITH p AS ({periods_sql("orders", "o_orderdate", "o_totalprice", "M")}), {decompose_sql("p", "period_end", "start", "value", 12)}
SELECT period_end, {R("v", 6)} AS original, {R("trend", 6)} AS trend, {R("seasonal", 6)} AS seasonal, {R("residual", 6)} AS residual FROM c""")
def timeseries_decompose_monthly(spark, d):
    parts = trend.timeseries_decompose(table(spark, d, "orders"), "o_orderdate", "o_totalprice", 12, freq="M")
    # twelve months make quarters of a digit: at four places, ties would hang on the order of a sum
    return rounded(dated(parts.withColumnRenamed("date", "period_end")), 6)


@query("decompose_stats", f"""
WITH {decompose_sql("events", "event_id", "ts, event_id", "value", 12)}
SELECT {R("var_pop(seasonal) / (var_pop(seasonal) + var_pop(residual))", 6)} AS seasonal_strength,
  CASE WHEN max_by(trend, i) FILTER (WHERE trend IS NOT NULL) > min_by(trend, i) FILTER (WHERE trend IS NOT NULL) THEN 'up' ELSE 'down' END AS trend_direction,
  12 AS period, count(*) AS n_points FROM c""")
def decompose_stats(spark, d):
    return rounded(trend.decompose_stats(table(spark, d, "events"), "ts", "value", 12, ["event_id"]), 6)


def ranked_sql(label: str, value: str, source: str, group: str = "") -> str:
    also, part = (f"{group} AS \"group\", ", 'PARTITION BY "group"') if group else ("", "")
    return f"""t AS (SELECT {also}{label} AS label, sum({value}) AS value FROM {source} GROUP BY ALL),
r AS (SELECT *, row_number() OVER ({part} ORDER BY value DESC, label) AS rank, sum(value) OVER ({part}) AS total,
  sum(value) OVER ({part} ORDER BY value DESC, label ROWS UNBOUNDED PRECEDING) AS running, count(*) OVER () AS items FROM t)"""


REVENUE = "(SELECT p_brand, p_type, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey)"


def revenue(spark, d):
    lines = prepare.compute_column(table(spark, d, "lineitem"), "revenue", "l_extendedprice * (1 - l_discount)")
    return lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_type", "revenue")


@query("rank_top_n", f"""
WITH {ranked_sql("CAST(l_partkey AS VARCHAR)", "l_quantity", "lineitem").replace("ORDER BY value DESC, label", "ORDER BY value DESC, CAST(label AS BIGINT)")}
SELECT rank, label, {R("value", 2)} AS value, {R("value / total * 100")} AS pct, {R("running / total * 100")} AS cum_pct FROM r WHERE rank <= 10""")
def rank_top_n(spark, d):
    return rounded(trend.rank_top_n(table(spark, d, "lineitem"), "l_quantity", "l_partkey"), value=2)


@query("rank_top_n_groups", f"""
WITH {ranked_sql("p_brand", "revenue", REVENUE, "p_type")}
SELECT "group", rank, label, {R("value", 2)} AS value, {R("value / total * 100")} AS pct, {R("running / total * 100")} AS cum_pct FROM r WHERE rank <= 3""")
def rank_top_n_groups(spark, d):
    return rounded(trend.rank_top_n(revenue(spark, d), "revenue", "p_brand", 3, "p_type"), value=2)


@query("rank_stats", f"""
WITH {ranked_sql("l_suppkey", "l_quantity", "lineitem")}, p AS (SELECT rank, value / total * 100 AS pct FROM r WHERE rank <= 10)
SELECT {R("sum(pct) FILTER (WHERE rank <= 1)")} AS top1_pct, {R("sum(pct) FILTER (WHERE rank <= 3)")} AS top3_pct,
  {R("sum(pct)")} AS top_n_pct, count(*) AS total_items FROM p""")
def rank_stats(spark, d):
    return rounded(trend.rank_stats(table(spark, d, "lineitem"), "l_quantity", "l_suppkey"))


@query("pareto_analysis", f"""
WITH {ranked_sql("p_brand", "revenue", REVENUE)}
SELECT rank, label, {R("value", 2)} AS value, {R("running / total * 100")} AS cum_pct FROM r""")
def pareto_analysis(spark, d):
    return rounded(trend.pareto_analysis(revenue(spark, d), "revenue", "p_brand"), value=2)


@query("pareto_stats", f"""
WITH {ranked_sql("l_partkey", "l_extendedprice", "lineitem")}, c AS (SELECT *, round(running / total * 100, 2) AS cum FROM r)
SELECT any_value(items) AS total_items, min(rank) FILTER (WHERE cum >= 80) AS cutoff_rank,
  {R("min(rank) FILTER (WHERE cum >= 80) / any_value(items) * 100")} AS pareto_ratio,
  {R("max(running / total * 100) FILTER (WHERE rank = greatest(1, items // 5))")} AS top_20_pct,
  bool_or(cum >= 80) FILTER (WHERE rank = greatest(1, items // 5)) AS is_pareto FROM c""")
def pareto_stats(spark, d):
    return rounded(trend.pareto_stats(table(spark, d, "lineitem"), "l_extendedprice", "l_partkey"))
