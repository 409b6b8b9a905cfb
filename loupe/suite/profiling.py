"""Queries over semantic types, profiles and quality issues."""

from pyspark.sql import functions as F

from loupe.operators import cleaning, profiling
from loupe.suite.registry import LINE_GAPS, R, line_gaps, query, rounded, table

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

# What the rules need, per column, as SQL over a table.


def facts_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """columns: (name, kind) with kind one of number, text, datetime."""
    parts = []
    for place, (name, kind) in enumerate(columns):
        boolean = {
            "number": f"count(DISTINCT {name}) <= 2 AND bool_and({name} IN (0, 1))",
            "text": f"count(DISTINCT {name}) <= 2 AND bool_and({name} IN ('True', 'False', 'true', 'false'))",
        }.get(kind, "false")
        dated = f"avg(CASE WHEN TRY_CAST({name} AS TIMESTAMP) IS NOT NULL THEN 1 ELSE 0 END) FILTER (WHERE {name} IS NOT NULL) >= 0.8"
        parts.append(
            f"SELECT {place} AS ordinal, '{name}' AS \"column\", '{kind}' AS kind, count(*) AS n_rows, "
            f"count({name}) AS known, count(DISTINCT {name}) AS uniq, coalesce({boolean}, false) AS bool_like, "
            f"avg(length(CAST({name} AS VARCHAR))) AS len, {dated if kind == 'text' else 'false'} AS dated FROM t"
        )
    return f"""t AS ({source}), facts AS ({' UNION ALL '.join(parts)}), typed AS (SELECT *,
  CASE WHEN known = 0 THEN 'unknown' WHEN bool_like THEN 'boolean'
       WHEN regexp_matches(lower("column"), '(^|_)(id|no|code|key)$') THEN 'identifier'
       WHEN kind = 'number' AND uniq / known > 0.9 AND uniq > 50 THEN 'identifier'
       WHEN kind = 'number' THEN 'numeric' WHEN kind = 'datetime' THEN 'datetime' WHEN dated THEN 'datetime'
       WHEN uniq > 50 AND uniq / known >= 0.2 AND len > 80 THEN 'text'
       WHEN uniq <= 50 OR uniq / known < 0.2 THEN 'categorical' ELSE 'text' END AS semantic_type FROM facts)"""


LINE_COLUMNS = [
    ("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"),
    ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"),
    ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "datetime"),
]
LINE_FACTS = facts_sql(LINE_GAPS, LINE_COLUMNS)
DOC_SOURCE = """SELECT doc_id AS ref, text, lang, source, n_chars, quality, toxic, strftime(
  TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (n_chars % 500), '%Y-%m-%d') AS written
  FROM documents LEFT JOIN labels USING (doc_id)"""
DOC_COLUMNS = [
    ("ref", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number"),
    ("quality", "number"), ("toxic", "number"), ("written", "text"),
]


def docs(spark, d):
    """Documents with their labels (missing for most) and a date written as text."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 500).cast("int"))
    return joined.withColumn("written", F.date_format(day, "yyyy-MM-dd")).withColumnRenamed("doc_id", "ref").select(
        *[c for c, _ in DOC_COLUMNS]
    )


@query("infer_semantic_types", f"""
WITH {facts_sql(DOC_SOURCE, DOC_COLUMNS)} SELECT ordinal, "column", semantic_type FROM typed""")
def infer_semantic_types(spark, d):
    return profiling.infer_semantic_types(docs(spark, d)).drop("spark_type")


@query("infer_semantic_types_lines", f"""
WITH {LINE_FACTS} SELECT ordinal, "column", semantic_type FROM typed""")
def infer_semantic_types_lines(spark, d):
    return profiling.infer_semantic_types(line_gaps(spark, d)).drop("spark_type")


#: the first documents, and the first customers, have dates, all others the source or the name
LEADING_DOCS = f"""SELECT *, CASE WHEN ref < 300 THEN strftime(DATE '2024-01-01' + CAST(ref AS INT), '%Y-%m-%d') ELSE source END AS due
  FROM ({DOC_SOURCE})"""
LEADING = """SELECT c_custkey AS ref, CASE WHEN c_custkey < 300 THEN strftime(DATE '2024-01-01' + CAST(c_custkey AS INT), '%Y-%m-%d') ELSE c_name END AS due
  FROM customer ORDER BY c_custkey"""


@query("infer_semantic_types_leading", f"""
SELECT * FROM (WITH {facts_sql(LEADING_DOCS, [*DOC_COLUMNS, ("due", "text")])} SELECT ordinal, "column", semantic_type FROM typed)
UNION ALL
SELECT * FROM (WITH {facts_sql(LEADING, [("ref", "number"), ("due", "text")])} SELECT ordinal, "column", semantic_type FROM typed)""")
def infer_semantic_types_leading(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("ref").cast("int")), "yyyy-MM-dd")
    documents = docs(spark, d).withColumn("due", F.when(F.col("ref") < 300, day).otherwise(F.col("source")))
    customers = dated(table(spark, d, "customer"), F.col("c_custkey") < 300).select("ref", "due")
    return profiling.infer_semantic_types(documents).unionByName(profiling.infer_semantic_types(customers)).drop("spark_type")


def dated(customers, when):
    """Customers with a date for some and a name for the others."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_custkey").cast("int")), "yyyy-MM-dd")
    return customers.withColumn("ref", F.col("c_custkey")).withColumn("due", F.when(when, day).otherwise(F.col("c_name")))


@query("type_counts", f"""
WITH {facts_sql(DOC_SOURCE, DOC_COLUMNS)} SELECT semantic_type, count(*) AS columns FROM typed GROUP BY ALL""")
def type_counts(spark, d):
    return profiling.type_counts(profiling.infer_semantic_types(docs(spark, d)))


def stats_sql(columns, quartiles: bool) -> str:
    parts = []
    for name, kind in columns:
        if kind != "number":
            continue
        extra = ""
        if quartiles:
            q = f"quantile_cont({name}, [0.25, 0.5, 0.75])"
            extra = (
                f", {R(q + '[1]')} AS q25, {R(q + '[2]')} AS median, {R(q + '[3]')} AS q75, "
                f"(SELECT count(*) FROM t, (SELECT {q} AS q FROM t) WHERE {name} < q[1] - 1.5 * (q[3] - q[1]) "
                f"OR {name} > q[3] + 1.5 * (q[3] - q[1])) AS outlier_count"
            )
        parts.append(
            f"SELECT '{name}' AS \"column\", {R(f'CAST(min({name}) AS DOUBLE)')} AS \"min\", {R(f'CAST(max({name}) AS DOUBLE)')} AS \"max\", "
            f"{R(f'avg({name})')} AS mean, {R(f'stddev({name})')} AS std{extra} FROM t"
        )
    return " UNION ALL ".join(parts)


@query("describe_schema", f"""
WITH {LINE_FACTS}, stats AS ({stats_sql(LINE_COLUMNS, False)})
SELECT ordinal, "column", semantic_type, n_rows - known AS missing_count, {R("(n_rows - known) / n_rows")} AS missing_rate,
       uniq AS unique_count, CASE WHEN semantic_type = 'numeric' THEN "min" END AS "min",
       CASE WHEN semantic_type = 'numeric' THEN "max" END AS "max",
       CASE WHEN semantic_type = 'numeric' THEN mean END AS mean, CASE WHEN semantic_type = 'numeric' THEN std END AS std
FROM typed LEFT JOIN stats USING ("column")""")
def describe_schema(spark, d):
    return rounded(profiling.describe_schema(line_gaps(spark, d)).drop("spark_type", "top_values"))


@query("describe_schema_sample", "SELECT * FROM part ORDER BY p_partkey LIMIT 3")
def describe_schema_sample(spark, d):
    return profiling.sample_rows(table(spark, d, "part"), ["p_partkey"])


def tops_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{name}' AS \"column\", CAST({name} AS VARCHAR) AS value, count(*) AS n FROM t "
        f"WHERE {name} IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 5)"
        for name, _ in columns
    )


@query("describe_schema_top_values", f"""
WITH {LINE_FACTS}, tops AS ({tops_sql(LINE_COLUMNS)})
SELECT "column", value, n FROM tops JOIN typed USING ("column")
WHERE semantic_type IN ('categorical', 'boolean', 'identifier')""")
def describe_schema_top_values(spark, d):
    described = profiling.describe_schema(line_gaps(spark, d))
    return described.select("column", F.explode("top_values").alias("value", "n"))


@query("profile_table", f"""
WITH t AS (SELECT l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag FROM ({LINE_GAPS}))
SELECT count(*) AS rows, 6 AS columns,
  {R("(count(l_suppkey) + count(l_linenumber) + count(l_quantity) + count(l_discount) + count(l_tax) + count(l_returnflag)) / (6 * count(*))")} AS completeness,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows FROM t""")
def profile_table(spark, d):
    lines = line_gaps(spark, d).select("l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return rounded(profiling.profile_table(lines))


PROFILE = f"""{LINE_FACTS}, stats AS ({stats_sql(LINE_COLUMNS, True)}),
profile AS (SELECT ordinal, "column", kind, semantic_type, n_rows AS rows, n_rows - known AS missing_count,
  (n_rows - known) / n_rows AS missing_rate, uniq AS unique_count,
  CASE WHEN semantic_type = 'numeric' THEN "min" END AS "min", CASE WHEN semantic_type = 'numeric' THEN q25 END AS q25,
  CASE WHEN semantic_type = 'numeric' THEN median END AS median, CASE WHEN semantic_type = 'numeric' THEN q75 END AS q75,
  CASE WHEN semantic_type = 'numeric' THEN "max" END AS "max", CASE WHEN semantic_type = 'numeric' THEN mean END AS mean,
  CASE WHEN semantic_type = 'numeric' THEN std END AS std,
  CASE WHEN semantic_type = 'numeric' THEN outlier_count END AS outlier_count
  FROM typed LEFT JOIN stats USING ("column"))"""


def profile(spark, d):
    return profiling.profile_columns(line_gaps(spark, d))


@query("profile_columns", f"""
WITH {PROFILE} SELECT * EXCLUDE (kind) REPLACE ({R("missing_rate")} AS missing_rate) FROM profile""")
def profile_columns(spark, d):
    return rounded(profile(spark, d).drop("spark_type", "top_values"))


@query("profile_columns_top_values", f"""
WITH {LINE_FACTS}, tops AS ({tops_sql(LINE_COLUMNS)})
SELECT "column", value, n FROM tops JOIN typed USING ("column")
WHERE semantic_type IN ('categorical', 'text', 'boolean', 'identifier')""")
def profile_columns_top_values(spark, d):
    return profile(spark, d).select("column", F.explode("top_values").alias("value", "n"))


@query("high_missing", f"""
WITH {LINE_FACTS} SELECT "column", {R("(n_rows - known) / n_rows * 100")} AS pct FROM typed WHERE (n_rows - known) / n_rows > 0.12""")
def high_missing(spark, d):
    return rounded(profiling.high_missing(profile(spark, d), 0.12))


@query("constant_columns", "WITH t AS (SELECT *, 1 AS fixed, CAST(NULL AS VARCHAR) AS none FROM orders) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\" FROM t HAVING count(DISTINCT {c}) <= 1" for c in [*ORDERS, "fixed", "none"]))
def constant_columns(spark, d):
    orders = table(spark, d, "orders").withColumn("fixed", F.lit(1)).withColumn("none", F.lit(None).cast("string"))
    return profiling.constant_columns(profiling.profile_columns(orders))


@query("low_variance", f"""
WITH {LINE_FACTS} SELECT "column", {R("uniq / n_rows * 100")} AS pct FROM typed
WHERE n_rows > 100 AND uniq > 1 AND uniq / n_rows < 0.001""")
def low_variance(spark, d):
    return rounded(profiling.low_variance(profile(spark, d)))


EVENT_COLUMNS = [("event_id", "number"), ("ts", "datetime"), ("user_id", "number"), ("event_type", "text"),
                 ("value", "number"), ("props", "text")]


@query("potential_outliers", f"""
WITH {facts_sql('SELECT event_id, ts, user_id, event_type, value, props FROM events', EVENT_COLUMNS)},
stats AS ({stats_sql(EVENT_COLUMNS, True)})
SELECT "column", outlier_count AS count, {R("outlier_count / known * 100")} AS pct
FROM typed JOIN stats USING ("column") WHERE semantic_type = 'numeric' AND outlier_count > 0""")
def potential_outliers(spark, d):
    return rounded(profiling.potential_outliers(profiling.profile_columns(table(spark, d, "events"))))


@query("suggest_types", """
WITH t AS (SELECT c_custkey, n_regionkey AS region, CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'no' END AS paid,
  CASE WHEN c_custkey % 10 < 7 THEN strftime(DATE '2024-01-01' + CAST(c_custkey AS INT), '%Y-%m-%d') ELSE c_name END AS due,
  CASE WHEN c_custkey % 10 < 4 THEN strftime(DATE '2024-01-01' + CAST(c_custkey AS INT), '%Y-%m-%d') ELSE c_name END AS seldom
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT 'due' AS "column", TRY_CAST(due AS DATE) AS day FROM t UNION ALL SELECT 'seldom', TRY_CAST(seldom AS DATE) FROM t)
SELECT 'region' AS "column", 'numeric' AS current, 'categorical' AS suggested FROM t HAVING count(DISTINCT region) BETWEEN 2 AND 5
UNION ALL SELECT 'paid', 'categorical', 'boolean' FROM t HAVING count(DISTINCT paid) BETWEEN 2 AND 4 AND bool_and(lower(paid) IN ('yes', 'no'))
UNION ALL SELECT "column", 'text', 'datetime' FROM f GROUP BY "column" HAVING count(day) >= 5 AND count(day) >= 0.5 * count(*)""")
def suggest_types(spark, d):
    customers = dated(table(spark, d, "customer"), F.col("c_custkey") % 10 < 7)
    seldom = F.when(F.col("c_custkey") % 10 < 4, F.col("due")).otherwise(F.col("c_name"))
    customers = customers.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer"), F.col("n_regionkey").alias("region"), F.when(F.col("c_acctbal") > 0, "Yes").otherwise("no").alias("paid"),
        "due", seldom.alias("seldom"),
    )
    return profiling.suggest_types(customers, profiling.profile_columns(customers))


GAP_PAIRS = [("l_discount", "l_tax"), ("l_discount", "l_returnflag"), ("l_tax", "l_returnflag")]


@query("missing_patterns", f"""
WITH t AS ({LINE_GAPS}), p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS joint_missing, "
    f"count(*) FILTER (WHERE {a} IS NULL) AS ma, count(*) FILTER (WHERE {b} IS NULL) AS mb FROM t" for a, b in GAP_PAIRS
) + f""") SELECT column_a, column_b, joint_missing, {R("joint_missing / mb")} AS a_when_b_missing_rate,
  {R("joint_missing / ma")} AS b_when_a_missing_rate FROM p
WHERE joint_missing > 0 AND (joint_missing / ma > 0.8 OR joint_missing / mb > 0.8)""")
def missing_patterns(spark, d):
    return rounded(profiling.missing_patterns(line_gaps(spark, d)))


@query("duplicate_columns", f"""
SELECT 'l_extendedprice' AS column_a, 'gross' AS column_b, {R("abs(corr(l_extendedprice, l_extendedprice * 1.1 + 5))", 6)} AS correlation
FROM lineitem""")
def duplicate_columns(spark, d):
    lines = table(spark, d, "lineitem").withColumn("gross", F.col("l_extendedprice") * 1.1 + 5)
    return rounded(profiling.duplicate_columns(lines), 6)


CLEANABLE = {"l_linenumber": "median", "l_quantity": "median", "l_discount": "median", "l_tax": "median", "l_returnflag": "mode", "fixed": "mode"}


@query("recommend_cleaning", f"""
WITH t AS (SELECT l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, 'x' AS fixed FROM ({LINE_GAPS})) """ + " UNION ALL ".join(
    [f"SELECT 'fill_missing' AS type, '{c}' AS \"column\", '{m}' AS method FROM t HAVING count({c}) < count(*)" for c, m in CLEANABLE.items()]
    + [f"SELECT 'drop_constant_columns', '{c}', 'drop' FROM t HAVING count(DISTINCT {c}) <= 1" for c in CLEANABLE]
    + [f"SELECT 'handle_outliers', '{c}', 'keep' FROM t, (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM t) "
       f"HAVING count(*) FILTER (WHERE {c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) > 0"
       for c, m in CLEANABLE.items() if m == "median"]
    + ["SELECT 'drop_duplicates', '', 'first' FROM t HAVING count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM t))"]))
def recommend_cleaning(spark, d):
    lines = line_gaps(spark, d).select("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    lines = lines.withColumn("fixed", F.lit("x"))
    return cleaning.recommend_cleaning(profiling.profile_columns(lines), profiling.profile_table(lines))


#: all dimensions of the vectors, with values missing by a rule
VECTOR_GAPS = """
  SELECT vec_id, i, CASE WHEN (vec_id + i) % 7 <> 0 AND NOT (i > 60 AND vec_id % 3 = 0) THEN CAST(embedding[i] AS DOUBLE) END AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""


def vector_gaps(spark, d):
    vectors = table(spark, d, "embeddings")
    present = lambda i: ((F.col("vec_id") + i) % 7 != 0) & ~((F.lit(i) > 60) & (F.col("vec_id") % 3 == 0))
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    return vectors.select(*[F.when(present(i), F.get("embedding", F.lit(i - 1))).cast("double").alias(f"e{i}") for i in range(1, width + 1)])


@query("pairwise_correlation_gaps", f"""
WITH v AS ({VECTOR_GAPS})
SELECT 'e' || a.i AS column_a, 'e' || b.i AS column_b, {R("corr(a.x, b.x)", 6)} AS r
FROM v a JOIN v b USING (vec_id) WHERE a.i < b.i AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY a.i, b.i""")
def pairwise_correlation_gaps(spark, d):
    return rounded(profiling.pairwise_correlation(vector_gaps(spark, d)), 6)


@query("missing_patterns_wide", f"""
WITH v AS ({VECTOR_GAPS}), g AS (SELECT vec_id, i FROM v WHERE x IS NULL), n AS (SELECT i, count(*) AS n FROM g GROUP BY i),
p AS (SELECT a.i AS a, b.i AS b, count(*) AS joint FROM g a JOIN g b USING (vec_id) WHERE a.i < b.i GROUP BY a.i, b.i)
SELECT 'e' || a AS column_a, 'e' || b AS column_b, joint AS joint_missing, {R("joint / nb.n")} AS a_when_b_missing_rate, {R("joint / na.n")} AS b_when_a_missing_rate
FROM p JOIN n na ON na.i = a JOIN n nb ON nb.i = b WHERE joint / nb.n > 0.8 OR joint / na.n > 0.8""")
def missing_patterns_wide(spark, d):
    return rounded(profiling.missing_patterns(vector_gaps(spark, d)))
