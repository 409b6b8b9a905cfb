"""Queries over loading, sanitising, derived columns, filters and lookups."""

import uuid

from pyspark.sql import functions as F

from loupe.operators import prepare
from loupe.session import shared_folder
from loupe.sources import csv, tables
from loupe.suite.registry import R, digits, query, rounded, table


@query("read_table", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers
FROM lineitem GROUP BY ALL""")
def read_table(spark, d):
    lines = tables.read_table(spark, f"{d}/lineitem.parquet")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("line_numbers")
    )


ACCENTED = "SELECT p_partkey, p_name || ' \u00e9' AS p_name, p_size, p_retailprice FROM part"


@query("read_csv", ACCENTED)
def read_csv(spark, d):
    """The table written as CSV files in two encodings, and read back."""
    folder = f"{shared_folder(spark)}/loupe-csv-{uuid.uuid4().hex}"
    parts = table(spark, d, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" \u00e9")).alias("p_name"), "p_size", "p_retailprice"
    )
    small = F.col("p_size") < 25
    parts.where(small).write.csv(f"{folder}/utf8", header=True, encoding="UTF-8")
    parts.where(~small).write.csv(f"{folder}/latin1", header=True, encoding="ISO-8859-1")
    return csv.read_csv(spark, f"{folder}/utf8", f"{folder}/latin1")


@query("read_csv_gbk", """
SELECT n_nationkey AS "编号", '国家 ' || n_name AS "名称" FROM nation
UNION ALL SELECT s_suppkey, '㐀 ' || s_name FROM supplier""")
def read_csv_gbk(spark, d):
    """Nations in GBK and suppliers in GB18030, written line by line as bytes and read back."""
    folder = f"{shared_folder(spark)}/loupe-csv-{uuid.uuid4().hex}"

    def write(rows, name, encoding):
        @F.pandas_udf("binary")
        def encoded(lines):  # noqa: ANN001
            return lines.map(lambda line: line.encode(encoding))

        lines = spark.createDataFrame([("编号,名称",)], "line string").unionByName(rows.select(F.concat_ws(",", *rows.columns).alias("line"))).coalesce(1)
        lines.select(encoded("line").cast("string").alias("value")).write.text(f"{folder}/{name}")

    write(table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("国家 "), "n_name").alias("name")), "gbk", "gbk")
    write(table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("㐀 "), "s_name").alias("name")), "gb18030", "gb18030")
    return csv.read_csv(spark, f"{folder}/gbk", f"{folder}/gb18030")


@query("write_cleaned", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def write_cleaned(spark, d):
    kept = prepare.filter_compare(table(spark, d, "customer"), "c_acctbal", "gt", 0)
    path = tables.write_cleaned(kept, f"{shared_folder(spark)}/loupe-{uuid.uuid4().hex}", "customer")
    return tables.read_table(spark, path)


@query("materialise", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def materialise(spark, d):
    copy = tables.materialise(table(spark, d, "orders"), f"{shared_folder(spark)}/loupe-{uuid.uuid4().hex}")
    return copy.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("sanitise", """
SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_name END AS c_name, c_acctbal,
       CAST(NULL AS VARCHAR) AS tokens_only
FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def sanitise(spark, d):
    kept = F.col("c_mktsegment") != "BUILDING"
    dirty = table(spark, d, "customer").select(
        F.when(kept, F.col("c_custkey")).alias("c_custkey"),
        F.when(kept & (F.col("c_nationkey") == 3), "N/A").otherwise(F.when(kept, F.col("c_name"))).alias(" c_name "),
        F.when(kept, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(kept, "None").alias("tokens_only"),
        F.lit(None).cast("double").alias("nothing"),
    )
    return prepare.sanitise(dirty)


@query("map_column", """
SELECT n_nationkey, n_name, n_regionkey, n_name AS label FROM nation""")
def map_column(spark, d):
    nations = prepare.map_column(table(spark, d, "nation"), "label", "n_name")
    return prepare.map_column(nations, "ignored", "no_such_column")


@query("compute_column", f"""
SELECT l_returnflag, {R("sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))", 2)} AS charge, count(*) AS n
FROM lineitem GROUP BY l_returnflag""")
def compute_column(spark, d):
    lines = prepare.compute_column(table(spark, d, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return lines.groupBy("l_returnflag").agg(digits(F.sum("charge"), 2).alias("charge"), F.count("*").alias("n"))


@query("compute_column_zero_divisor", f"""
SELECT l_orderkey, l_linenumber, {R("l_extendedprice / nullif(l_linenumber - 3, 0)")} AS ratio,
  {R("fmod(l_quantity, nullif(l_linenumber - 3, 0))")} AS rest FROM lineitem""")
def compute_column_zero_divisor(spark, d):
    lines = prepare.compute_column(table(spark, d, "lineitem"), "ratio", "l_extendedprice / (l_linenumber - 3)")
    return rounded(prepare.compute_column(lines, "rest", "l_quantity % (l_linenumber - 3)").select("l_orderkey", "l_linenumber", "ratio", "rest"))


@query("compute_column_overflow", f"""
SELECT p_partkey, {R("p_size::DOUBLE * 1000000 * p_size * 1000", 0)} AS product FROM part""")
def compute_column_overflow(spark, d):
    return rounded(prepare.compute_column(table(spark, d, "part"), "product", "p_size * 1000000 * p_size * 1000").select("p_partkey", "product"), 0)


@query("apply_mappings", f"""
SELECT p_brand AS brand, {R("sum(p_retailprice * p_size)", 2)} AS stock FROM part GROUP BY p_brand""")
def apply_mappings(spark, d):
    parts = prepare.apply_mappings(
        table(spark, d, "part"),
        [
            {"name": "brand", "type": "direct", "column": "p_brand"},
            {"name": "stock", "type": "computed", "formula": "p_retailprice * p_size"},
            {"name": "skipped", "type": "direct", "column": "no_such_column"},
        ],
    )
    return parts.groupBy("brand").agg(digits(F.sum("stock"), 2).alias("stock"))


@query("coerce_numeric", r"""
SELECT lang, count(TRY_CAST(regexp_extract(source, '[0-9]+$') AS DOUBLE)) AS readable,
       count(*) AS n, CAST(sum(TRY_CAST(regexp_extract(source, '[0-9]+$') AS DOUBLE)) AS DOUBLE) AS total
FROM documents GROUP BY lang""")
def coerce_numeric(spark, d):
    docs = table(spark, d, "documents").withColumn("number", F.regexp_extract("source", "[0-9]+$", 0))
    docs = prepare.coerce_numeric(docs, "number")
    return docs.groupBy("lang").agg(
        F.count("number").alias("readable"), F.count("*").alias("n"), F.sum("number").alias("total")
    )


@query("coerce_datetime", """
SELECT o_orderstatus, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderstatus""")
def coerce_datetime(spark, d):
    written = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy/MM/dd"))
    written = written.when(F.col("o_orderpriority") == "5-LOW", "not a date")
    orders = table(spark, d, "orders").withColumn("day", written.otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return prepare.coerce_datetime(orders, "day").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"),
        F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"),
    )


@query("filter_compare", f"""
SELECT op, count(*) AS n, {R("sum(l_extendedprice)", 2)} AS price FROM (
  SELECT 'gt' AS op, * FROM lineitem WHERE l_quantity > 25
  UNION ALL SELECT 'lt', * FROM lineitem WHERE l_quantity < 25
  UNION ALL SELECT 'eq', * FROM lineitem WHERE l_quantity = 25
  UNION ALL SELECT 'gte', * FROM lineitem WHERE l_quantity >= 25
  UNION ALL SELECT 'lte', * FROM lineitem WHERE l_quantity <= 25) GROUP BY op""")
def filter_compare(spark, d):
    lines = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    parts = None
    for op in ("gt", "lt", "eq", "gte", "lte"):
        part = prepare.filter_compare(lines, "l_quantity", op, 25).withColumn("op", F.lit(op))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("op").agg(F.count("*").alias("n"), digits(F.sum("l_extendedprice"), 2).alias("price"))


@query("data_lookup", """
SELECT page_id, url, html FROM pages WHERE regexp_matches(lower(url), '/fr/.*page=[0-9]')
ORDER BY page_id LIMIT 20""")
def data_lookup(spark, d):
    return prepare.data_lookup(table(spark, d, "pages"), "url", "/FR/.*page=[0-9]", limit=20, order_by=["page_id"])


@query("lookup_stats", """
SELECT 'page' AS sought, count(*) FILTER (WHERE regexp_matches(lower(url), '/fr/.*page=[0-9]')) AS matched, count(*) AS total FROM pages
UNION ALL SELECT 'size', count(*) FILTER (WHERE p_size = 11), count(*) FROM part""")
def lookup_stats(spark, d):
    pages = prepare.lookup_stats(table(spark, d, "pages"), "url", "/FR/.*page=[0-9]").withColumn("sought", F.lit("page"))
    return pages.unionByName(prepare.lookup_stats(table(spark, d, "part"), "p_size", "11.0").withColumn("sought", F.lit("size")))


@query("data_lookup_number", """
SELECT * FROM part WHERE p_size = 11""")
def data_lookup_number(spark, d):
    return prepare.data_lookup(table(spark, d, "part"), "p_size", "11.0", limit=None)


@query("drop_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def drop_columns(spark, d):
    return prepare.drop_columns(table(spark, d, "supplier"), ["s_name", "s_nationkey", "no_such_column"])


@query("high_value", """
SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS least FROM lineitem
WHERE l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.8) FROM lineitem) GROUP BY l_returnflag""")
def high_value(spark, d):
    rows = prepare.high_value(table(spark, d, "lineitem"), "l_extendedprice")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("least"))


@query("high_value_nan", """
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
SELECT event_id, value FROM e WHERE value >= (SELECT quantile_cont(value, 0.8) FROM e)""")
def high_value_nan(spark, d):
    events = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")))
    return prepare.high_value(events, "value").select("event_id", "value")


@query("low_value", """
SELECT event_type, count(*) AS n, max(value) AS most FROM events
WHERE value <= (SELECT quantile_cont(value, 0.2) FROM events) GROUP BY event_type""")
def low_value(spark, d):
    rows = prepare.low_value(table(spark, d, "events"), "value")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query("recent", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 3 MONTH FROM orders)""")
def recent(spark, d):
    return prepare.recent(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "o_totalprice")


@query("recent_days", """
SELECT event_type, count(*) AS n FROM events
WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) GROUP BY event_type""")
def recent_days(spark, d):
    return prepare.recent(table(spark, d, "events"), "ts", days=10).groupBy("event_type").agg(F.count("*").alias("n"))


@query("beyond_sigma", """
SELECT event_id, user_id, value FROM events, (SELECT avg(value) AS m, stddev(value) AS s FROM events)
WHERE value > m + 2 * s OR value < m - 2 * s""")
def beyond_sigma(spark, d):
    return prepare.beyond_sigma(table(spark, d, "events"), "value").select("event_id", "user_id", "value")


@query("majority_share", f"""
WITH t AS (SELECT l_suppkey, sum(l_extendedprice) AS value FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, sum(value) OVER (ORDER BY value DESC, l_suppkey ROWS UNBOUNDED PRECEDING) AS running,
             row_number() OVER (ORDER BY value DESC, l_suppkey) AS rank, sum(value) OVER () AS total FROM t)
SELECT rank, l_suppkey, {R("value", 2)} AS value, {R("running / total * 100")} AS cum_pct
FROM r WHERE (running - value) * 100 < total * 80""")
def majority_share(spark, d):
    return rounded(prepare.majority_share(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice"), value=2)
