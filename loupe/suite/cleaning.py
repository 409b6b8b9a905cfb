"""Queries over cleaning steps; missing values come from the rule in ``line_gaps``."""

from pyspark.sql import functions as F

from loupe.operators import cleaning
from loupe.suite.registry import LINE_GAPS, R, digits, line_gaps, query, rounded, table

SUMMARY = f"count(*) AS n, count(l_discount) AS known, {R('sum(l_discount)')} AS total"


def summary(df):
    return df.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.count("l_discount").alias("known"), digits(F.sum("l_discount")).alias("total")
    )


@query("fill_missing_mean", f"""
WITH g AS ({LINE_GAPS}), f AS (SELECT l_linenumber,
  coalesce(l_discount, (SELECT avg(l_discount) FROM g)) AS l_discount FROM g)
SELECT l_linenumber, {SUMMARY} FROM f GROUP BY l_linenumber""")
def fill_missing_mean(spark, d):
    return summary(cleaning.fill_missing(line_gaps(spark, d), "l_discount", "mean"))


@query("fill_missing_median", f"""
WITH g AS ({LINE_GAPS}), f AS (SELECT l_linenumber,
  coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM g)) AS l_discount FROM g)
SELECT l_linenumber, {SUMMARY} FROM f GROUP BY l_linenumber""")
def fill_missing_median(spark, d):
    return summary(cleaning.fill_missing(line_gaps(spark, d), "l_discount", "median"))


MODE = """SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"""


@query("fill_missing_mode", f"""
WITH g AS ({LINE_GAPS})
SELECT l_linenumber, coalesce(l_returnflag, ({MODE.format(c='l_returnflag')})) AS l_returnflag, count(*) AS n
FROM g GROUP BY ALL""")
def fill_missing_mode(spark, d):
    filled = cleaning.fill_missing(line_gaps(spark, d), "l_returnflag", "mode")
    return filled.groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))


def turns(spark, d):
    return table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") != 1, F.col("role")))


TURNS = "SELECT conv_id, turn, CASE WHEN turn <> 1 THEN role END AS role FROM conversations"


@query("fill_missing_forward", f"""
SELECT conv_id, turn, last_value(role IGNORE NULLS) OVER
  (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS role FROM ({TURNS})""")
def fill_missing_forward(spark, d):
    filled = cleaning.fill_missing(turns(spark, d), "role", "forward", order_by=["turn"], partition_by=["conv_id"])
    return filled.select("conv_id", "turn", "role")


@query("fill_missing_backward", f"""
SELECT conv_id, turn, first_value(role IGNORE NULLS) OVER
  (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS role FROM ({TURNS})""")
def fill_missing_backward(spark, d):
    filled = cleaning.fill_missing(turns(spark, d), "role", "backward", order_by=["turn"], partition_by=["conv_id"])
    return filled.select("conv_id", "turn", "role")


@query("fill_missing_forward_table", """
SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER
  (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events""")
def fill_missing_forward_table(spark, d):
    events = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return cleaning.fill_missing(events, "value", "forward", order_by=["ts", "event_id"]).select("event_id", "value")


@query("fill_missing_backward_table", """
SELECT event_id, first_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER
  (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events""")
def fill_missing_backward_table(spark, d):
    events = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return cleaning.fill_missing(events, "value", "backward", order_by=["ts", "event_id"]).select("event_id", "value")


@query("fill_missing_forward_nan", """
SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER
  (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events""")
def fill_missing_forward_nan(spark, d):
    events = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")))
    return cleaning.fill_missing(events, "value", "forward", order_by=["ts", "event_id"]).select("event_id", "value")


@query("fill_missing_custom", f"""
WITH g AS ({LINE_GAPS}), f AS (SELECT l_linenumber, coalesce(l_discount, 0.5) AS l_discount FROM g)
SELECT l_linenumber, {SUMMARY} FROM f GROUP BY l_linenumber""")
def fill_missing_custom(spark, d):
    return summary(cleaning.fill_missing(line_gaps(spark, d), "l_discount", "custom", 0.5))


@query("fill_missing_fallback", f"""
WITH g AS ({LINE_GAPS})
SELECT coalesce(l_returnflag, ({MODE.format(c='l_returnflag')})) AS l_returnflag,
       {R("sum(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM g)))")} AS l_tax, count(*) AS n
FROM g GROUP BY ALL""")
def fill_missing_fallback(spark, d):
    filled = cleaning.fill_missing(line_gaps(spark, d), "l_returnflag", "mean")
    filled = cleaning.fill_missing(filled, "l_tax", "no such method")
    return filled.groupBy("l_returnflag").agg(digits(F.sum("l_tax")).alias("l_tax"), F.count("*").alias("n"))


FENCES = """f AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""


@query("handle_outliers_cap", f"""
WITH {FENCES} SELECT event_id, {R("greatest(least(value, high), low)")} AS value FROM events, f""")
def handle_outliers_cap(spark, d):
    return rounded(cleaning.handle_outliers(table(spark, d, "events"), "value", "cap").select("event_id", "value"))


@query("handle_outliers_remove", f"""
WITH {FENCES} SELECT event_id, value FROM events, f WHERE value BETWEEN low AND high""")
def handle_outliers_remove(spark, d):
    return cleaning.handle_outliers(table(spark, d, "events"), "value", "remove").select("event_id", "value")


@query("handle_outliers_keep", "SELECT event_id, value FROM events")
def handle_outliers_keep(spark, d):
    return cleaning.handle_outliers(table(spark, d, "events"), "value", "keep").select("event_id", "value")


@query("drop_duplicates", "SELECT DISTINCT lang, source, text FROM documents")
def drop_duplicates(spark, d):
    return cleaning.drop_duplicates(table(spark, d, "documents").select("lang", "source", "text"))


@query("drop_duplicates_first", """
SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text""")
def drop_duplicates_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return cleaning.drop_duplicates(docs, "first", ["text"], ["doc_id"]).select("doc_id", "text")


@query("drop_duplicates_last", """
SELECT max(event_id) AS event_id, user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id""")
def drop_duplicates_last(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    return cleaning.drop_duplicates(events, "last", ["user_id"], ["event_id"])


@query("drop_constant_columns", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def drop_constant_columns(spark, d):
    nations = table(spark, d, "nation").withColumn("fixed", F.lit("x")).withColumn("none", F.lit(None).cast("int"))
    return cleaning.drop_constant_columns(nations)


@query("drop_missing_rows", f"""
WITH g AS ({LINE_GAPS})
SELECT l_linenumber, {SUMMARY} FROM g WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY l_linenumber""")
def drop_missing_rows(spark, d):
    return summary(cleaning.drop_missing_rows(line_gaps(spark, d), "l_discount", "l_returnflag"))


STEPS = [
    {"type": "drop_columns", "columns": ["l_suppkey"]},
    {"type": "fill_missing", "column": "l_discount", "method": "median"},
    {"type": "drop_missing_rows", "column": "l_returnflag"},
    {"type": "handle_outliers", "column": "l_extendedprice", "method": "remove"},
    {"type": "drop_constant_columns"},
]
CLEANED = f"""g AS ({LINE_GAPS}),
a AS (SELECT * REPLACE (coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM g)) AS l_discount) FROM g),
b AS (SELECT * FROM a WHERE l_returnflag IS NOT NULL),
q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM b),
c AS (SELECT b.* FROM b, q WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


@query("apply_cleaning", f"""
WITH {CLEANED} SELECT l_linenumber, {SUMMARY} FROM c GROUP BY l_linenumber""")
def apply_cleaning(spark, d):
    cleaned, _ = cleaning.apply_cleaning(line_gaps(spark, d), STEPS)
    return summary(cleaned)


@query("apply_cleaning_audit", f"""
WITH {CLEANED}, n AS (SELECT (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM c) AS c,
  (SELECT count(*) FROM g WHERE l_discount IS NULL) AS holes)
SELECT 1 AS step, 'drop_columns' AS type, '' AS "column", '' AS method, g AS rows_before, g AS rows_after,
       0 AS rows_removed, 11 AS cols_before, 10 AS cols_after, 0 AS cells_filled FROM n
UNION ALL SELECT 2, 'fill_missing', 'l_discount', 'median', g, g, 0, 10, 10, holes FROM n
UNION ALL SELECT 3, 'drop_missing_rows', 'l_returnflag', '', g, b, g - b, 10, 10, 0 FROM n
UNION ALL SELECT 4, 'handle_outliers', 'l_extendedprice', 'remove', b, c, b - c, 10, 10, 0 FROM n
UNION ALL SELECT 5, 'drop_constant_columns', '', '', c, c, 0, 10, 10, 0 FROM n""")
def apply_cleaning_audit(spark, d):
    return cleaning.apply_cleaning(line_gaps(spark, d), STEPS)[1]


MOVING = [
    {"type": "fill_missing", "column": "value", "method": "forward", "order_by": ["ts", "event_id"]},
    {"type": "drop_duplicates", "subset": ["user_id", "event_type"], "order_by": ["event_id"]},
    {"type": "fill_missing", "column": "value", "method": "mean"},
    {"type": "drop_missing_rows", "column": "value"},
]


@query("apply_cleaning_audit_moves", """
WITH e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events),
a AS (SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value) FROM e),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
n AS (SELECT (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM b) AS b, (SELECT count(value) FROM e) AS known, (SELECT count(value) FROM a) AS filled,
  (SELECT count(*) FROM b WHERE value IS NULL) AS holes)
SELECT 1 AS step, 'fill_missing' AS type, 'value' AS "column", 'forward' AS method, e AS rows_before, e AS rows_after, 0 AS rows_removed,
       5 AS cols_before, 5 AS cols_after, filled - known AS cells_filled FROM n
UNION ALL SELECT 2, 'drop_duplicates', '', '', e, b, e - b, 5, 5, 0 FROM n
UNION ALL SELECT 3, 'fill_missing', 'value', 'mean', b, b, 0, 5, 5, holes FROM n
UNION ALL SELECT 4, 'drop_missing_rows', 'value', '', b, b, 0, 5, 5, 0 FROM n""")
def apply_cleaning_audit_moves(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return cleaning.apply_cleaning(events, MOVING)[1]
