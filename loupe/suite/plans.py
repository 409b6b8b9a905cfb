"""Queries over history tables, JSON text and plans of several analyses."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loupe.operators import history, jsontext
from loupe.plans import run
from loupe.plans.analyses import ANALYSES
from loupe.suite.distribution import histogram_sql
from loupe.suite.registry import R, query, rounded, table
from loupe.suite.trend import periods_sql


@query("keep_latest_n", """
SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""")
def keep_latest_n(spark, d):
    return history.keep_latest_n(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 50).select("event_id", "user_id")


@query("latest", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest(spark, d):
    return history.latest(table(spark, d, "events"), ["ts", "event_id"], 50).select("event_id", "user_id", "value")


@query("collapse_consecutive", """
SELECT event_id, user_id, event_type FROM (
  SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
WHERE following IS NULL OR following <> event_type""")
def collapse_consecutive(spark, d):
    rows = history.collapse_consecutive(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])
    return rows.select("event_id", "user_id", "event_type")


# Answers as a model would write them around the events' JSON
@query("salvage_json", r"""
SELECT event_id, CASE event_type WHEN 'click' THEN 'clean' WHEN 'error' THEN 'repaired' WHEN 'purchase' THEN 'repaired'
  WHEN 'signup' THEN 'requoted' ELSE 'failed' END AS status,
  CASE WHEN event_type IN ('click', 'error', 'purchase', 'signup') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events""")
def salvage_json(spark, d):
    kind, props = F.col("event_type"), F.col("props")
    written = (
        F.when(kind == "click", props)
        .when(kind == "error", F.concat(F.lit("```json\n"), F.regexp_replace(props, r"\}", ",}"), F.lit("\n```")))
        .when(kind == "purchase", F.concat(F.lit("Here it is: "), props, F.lit(" Hope it helps.")))
        .when(kind == "signup", F.regexp_replace(props, '"', "'"))
        .otherwise(F.regexp_replace(props, r"\}", ""))
    )
    found = jsontext.salvage_json(table(spark, d, "events").withColumn("answer", written), "answer", "k long")
    return found.select("event_id", F.col("json_status").alias("status"), F.col("json.k").alias("k"))


ACTIONS = [
    {"function": "describe_frequency", "params": {"column": "l_returnflag", "top_n": 2, "unknown": 1}},
    {"function": "filter_aggregate", "params": {"column": "l_quantity", "operator": "gt", "threshold": 45, "agg_column": "revenue", "group_by": "l_returnflag"}},
    {"function": "rank_top_n", "params": {"column": "revenue", "label_col": "l_linestatus", "n": 1}},
    {"function": "correlate", "params": {"x": "revenue", "y": "no_such_column"}},
    {"function": "no_such_function", "params": {}},
]
MAPPINGS = [{"name": "revenue", "type": "computed", "formula": "l_extendedprice * (1 - l_discount)"}]


@query("run_plan", f"""
WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem),
a AS (SELECT l_returnflag AS label, CAST(count(*) AS DOUBLE) AS value FROM t GROUP BY ALL ORDER BY value DESC, label LIMIT 2),
b AS (SELECT l_returnflag AS label, {R("sum(revenue)", 2)} AS value FROM t WHERE l_quantity > 45 GROUP BY ALL),
c AS (SELECT l_linestatus AS label, {R("sum(revenue)", 2)} AS value FROM t GROUP BY ALL ORDER BY value DESC, label LIMIT 1)
SELECT 1 AS step, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM c""")
def run_plan(spark, d):
    steps = run.run_plan(table(spark, d, "lineitem"), ACTIONS, MAPPINGS)
    first, second, third = (s.tables["table"] for s in steps[:3])
    rows = [
        first.select(F.lit(1).alias("step"), F.col("value").alias("label"), F.col("count").cast("double").alias("value")),
        second.select(F.lit(2).alias("step"), "label", "value"),
        third.select(F.lit(3).alias("step"), "label", "value"),
    ]
    return rounded(reduce(DataFrame.unionByName, rows), 2)


@query("run_plan_all")
def run_plan_all(spark, d):
    """All named analyses over lineitem; counts the rows of every result table."""
    lines = table(spark, d, "lineitem")
    given = {
        "column": "l_extendedprice", "x": "l_quantity", "y": "l_extendedprice", "group_col": "l_returnflag",
        "value_col": "l_extendedprice", "columns": ["l_quantity", "l_extendedprice", "l_discount"], "date_col": "l_shipdate",
        "metric_col": "l_extendedprice", "label_col": "l_suppkey", "operator": "gt", "threshold": 30, "value": "901",
        "subset": ["l_orderkey", "l_linenumber"], "n_clusters": 3, "tie_by": ["l_orderkey", "l_linenumber"],
    }
    special = {
        "describe_frequency": {"column": "l_returnflag"}, "analyze_composition": {"column": "l_returnflag"},
        "cross_tabulate": {"x": "l_returnflag", "y": "l_linestatus"}, "data_lookup": {"column": "l_suppkey", "value": "7"},
        "rank_top_n": {"group_col": None},
        "anomaly_explain": {"order_by": ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]},
    }
    actions = [{"function": name, "params": {**given, **special.get(name, {})}} for name in ANALYSES]
    steps = run.run_plan(lines, actions)
    failed = [s for s in steps if s.error]
    if failed:
        raise RuntimeError(str([(s.function, s.error) for s in failed]))
    counts = [
        t.agg(F.count("*").alias("rows")).select(F.lit(s.function).alias("function"), F.lit(name).alias("table"), "rows")
        for s in steps for name, t in s.tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("auto_eda", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS count, {R(f"avg({c})", 8)} AS mean FROM lineitem
HAVING NOT (count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) / count(*) > 0.9)""" for c in NUMBERS))
def auto_eda(spark, d):
    found = run.auto_eda(table(spark, d, "lineitem"))
    return rounded(found["exploratory"].select("column", "count", "mean"), 8)


EDA = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]
EDA_STATS = {"count": "count({})", "mean": "avg({})", "std": "stddev({})", "q25": "quantile_cont({}, 0.25)", "q50": "quantile_cont({}, 0.5)", "max": "max({})"}


def eda_parts_sql() -> str:
    parts = [
        f"SELECT 'exploratory' AS part, '{c} {name}' AS key, CAST({of.format(f'CAST({c} AS DOUBLE)')} AS DOUBLE) AS value FROM lineitem"
        for c in EDA for name, of in EDA_STATS.items()
    ]
    parts += [
        f"SELECT 'histograms', '{c} ' || bin, CAST(count AS DOUBLE) FROM ({histogram_sql('(SELECT CAST(' + c + ' AS DOUBLE) AS ' + c + ' FROM lineitem)', c, 30)})"
        for c in EDA
    ]
    parts += [f"SELECT 'correlation', '{a} {b}', corr({a}, {b}) FROM lineitem" for i, a in enumerate(EDA) for b in EDA[i + 1 :]]
    parts += [
        f"SELECT 'categorical', '{c} ' || v, CAST(n AS DOUBLE) FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, v LIMIT 5)"
        for c in ("l_returnflag", "l_linestatus")
    ]
    parts.append(f"SELECT 'timeseries', period_end, value FROM ({periods_sql('lineitem', 'l_shipdate', 'l_quantity', 'M')})")
    return f"SELECT part, key, {R('value', 6)} AS value FROM ({' UNION ALL '.join(parts)})"


@query("auto_eda_parts", eda_parts_sql())
def auto_eda_parts(spark, d):
    """Every part of the automatic summary, over the whole table."""
    found = run.auto_eda(table(spark, d, "lineitem").select(*EDA, "l_returnflag", "l_linestatus", "l_shipdate"))
    key = lambda *names: F.concat_ws(" ", *[F.col(n).cast("string") for n in names]).alias("key")
    stats = found["exploratory"].unpivot(["column"], [F.col(s).cast("double").alias(s) for s in EDA_STATS], "stat", "value")
    rows = [
        ("exploratory", stats.select(key("column", "stat"), "value")),
        ("histograms", found["histograms"].select(key("column", "bin"), F.col("count").cast("double").alias("value"))),
        ("correlation", found["correlation"].select(key("column_a", "column_b"), F.col("r").alias("value"))),
        ("categorical", found["categorical"].select(key("column", "value"), F.col("count").cast("double").alias("value"))),
        ("timeseries", found["timeseries"].select(F.date_format("period_end", "yyyy-MM-dd").alias("key"), "value")),
    ]
    return rounded(reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(name)) for name, df in rows]), 6)
