"""Queries over distributions, categories, outliers, filters and segments."""

from pyspark.sql import functions as F

from loupe.operators import distribution as dist
from loupe.suite.registry import LINE_GAPS, R, line_gaps, query, rounded, table


def histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""
SELECT g.i AS bin, {R("lo + g.i * step")} AS "left",
       {R(f"CASE WHEN g.i = {bins - 1} THEN hi ELSE lo + (g.i + 1) * step END")} AS "right",
       coalesce(n, 0) AS count
FROM (SELECT unnest(range(0, {bins})) AS i) g
CROSS JOIN (SELECT min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / {bins} AS step FROM {source}) e
LEFT JOIN (
  SELECT CAST(CASE WHEN v < lo + g * step THEN g - 1 WHEN v >= CASE WHEN g + 1 = {bins} THEN hi ELSE lo + (g + 1) * step END
    AND g < {bins - 1} THEN g + 1 ELSE g END AS BIGINT) AS i, count(*) AS n
  FROM (SELECT {column} AS v, lo, hi, step, least(floor(({column} - lo) * ({bins} / (hi - lo))), {bins - 1}) AS g
        FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / {bins} AS step FROM {source})
        WHERE {column} IS NOT NULL) GROUP BY ALL) c ON c.i = g.i"""


@query("histogram", histogram_sql("lineitem", "l_extendedprice", 30))
def histogram(spark, d):
    return rounded(dist.histogram(table(spark, d, "lineitem"), "l_extendedprice"))


@query("histograms", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", * FROM ({histogram_sql('(' + LINE_GAPS + ')', c, 30)})" for c in ("l_quantity", "l_discount", "l_tax")))
def histograms(spark, d):
    return rounded(dist.histograms(line_gaps(spark, d), ["l_quantity", "l_discount", "l_tax"]))


@query("sparkline", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", bin, count FROM ({histogram_sql('lineitem', c, 20)})" for c in ("l_quantity", "l_extendedprice")))
def sparkline(spark, d):
    lines = dist.sparklines(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return lines.select("column", F.posexplode("counts").alias("bin", "count"))


@query("kde", f"""
WITH s AS (SELECT count(value) AS n, stddev(value) * pow(count(value), -0.2) AS h, min(value) AS lo, max(value) AS hi FROM events),
g AS (SELECT lo + i * (hi - lo) / 199 AS x, n, h FROM s, (SELECT unnest(range(0, 200)) AS i))
SELECT {R("x")} AS x, {R("sum(exp(-0.5 * pow((x - value) / h, 2))) / any_value(n * h * sqrt(2 * pi()))", 8)} AS density
FROM g, events GROUP BY g.x""")
def kde(spark, d):
    return rounded(dist.kde(table(spark, d, "events"), "value"), density=8)


def summary_sql(column: str, cast: str = "") -> str:
    v = f"CAST({column} AS DOUBLE)"
    return (
        f"count({v}) AS count, {R(f'avg({v})')} AS mean, {R(f'stddev({v})')} AS std, {R(f'min({v})')} AS \"min\", "
        f"{R(f'max({v})')} AS \"max\", {R(f'skewness({v})', 3)} AS skewness, {R(f'kurtosis({v})', 3)} AS kurtosis, "
        f"{R(f'quantile_cont({v}, 0.25)')} AS q25, {R(f'quantile_cont({v}, 0.5)')} AS q50, {R(f'quantile_cont({v}, 0.75)')} AS q75"
    )


@query("describe_distribution", f"""
SELECT {summary_sql("value")}, {R("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")} AS iqr,
       'Kolmogorov-Smirnov' AS normality_test FROM events""")
def describe_distribution(spark, d):
    row = dist.describe_distribution(table(spark, d, "events"), "value").drop("normality_stat", "normality_p")
    return rounded(row, skewness=3, kurtosis=3)


@query("describe_distribution_small", f"""
SELECT {summary_sql("s_acctbal")}, {R("quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25)")} AS iqr,
       'Shapiro-Wilk' AS normality_test FROM supplier""")
def describe_distribution_small(spark, d):
    row = dist.describe_distribution(table(spark, d, "supplier"), "s_acctbal", "shapiro").drop("normality_stat", "normality_p")
    return rounded(row, skewness=3, kurtosis=3)


EXPLORED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("eda_exploratory", f"""
WITH t AS ({LINE_GAPS}) """ + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {summary_sql(c)} FROM t" for c in EXPLORED))
def eda_exploratory(spark, d):
    return rounded(dist.eda_exploratory(line_gaps(spark, d), EXPLORED), skewness=3, kurtosis=3)


# Hart's normal distribution function in SQL, from the same fixed values.


def cdf_sql() -> str:
    """P(Z <= z), given columns z and a = abs(z)."""
    from loupe.functions.normal import HART_BOTTOM, HART_TOP

    def horner(c):
        out = repr(c[0])
        for k in c[1:]:
            out = f"({out} * a + {k!r})"
        return out

    near = f"exp(-a * a / 2) * {horner(HART_TOP)} / {horner(HART_BOTTOM)}"
    tail = "exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / sqrt(2 * pi())"
    upper = f"CASE WHEN a > 37 THEN 0.0 WHEN a < 7.07106781186547 THEN {near} ELSE {tail} END"
    return f"(CASE WHEN z > 0 THEN 1 - {upper} ELSE {upper} END)"


@query("kolmogorov_smirnov", f"""
WITH s AS (SELECT avg(value) AS m, stddev(value) AS sd, count(*) AS n FROM events),
r AS (SELECT CAST(row_number() OVER (ORDER BY value) AS DOUBLE) AS i, (value - m) / sd AS z, abs(value - m) / sd AS a, n FROM events, s),
f AS (SELECT i, n, {cdf_sql()} AS f FROM r)
SELECT 'Kolmogorov-Smirnov' AS test, {R("max(greatest(i / n - f, f - (i - 1) / n))", 6)} AS statistic FROM f""")
def kolmogorov_smirnov(spark, d):
    return rounded(dist.kolmogorov_smirnov(table(spark, d, "events"), "value").drop("p_value"), 6)


@query("kolmogorov_smirnov_p_value", f"""
WITH t AS (SELECT s_acctbal AS value FROM supplier), s AS (SELECT avg(value) AS m, stddev(value) AS sd, CAST(count(*) AS DOUBLE) AS n FROM t),
r AS (SELECT CAST(row_number() OVER (ORDER BY value) AS DOUBLE) AS i, (value - m) / sd AS z, abs(value - m) / sd AS a, n FROM t, s),
f AS (SELECT i, n, {cdf_sql()} AS f FROM r),
l AS (SELECT (sqrt(any_value(n)) + 0.12 + 0.11 / sqrt(any_value(n))) * max(greatest(i / n - f, f - (i - 1) / n)) AS l FROM f)
SELECT {R("2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * l * l))", 6)} AS p_value
FROM l, (SELECT unnest(range(1, 101)) AS k)""")
def kolmogorov_smirnov_p_value(spark, d):
    return rounded(dist.kolmogorov_smirnov(table(spark, d, "supplier"), "s_acctbal").select("p_value"), 6)


def ppf_sql() -> str:
    """The normal quantile of p by Acklam's formula, given columns p, q = p - 0.5 and t = sqrt(-2 ln min(p, 1 - p))."""
    from loupe.functions.normal import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D

    def horner(c, x):
        out = repr(c[0])
        for k in c[1:]:
            out = f"({out} * {x} + {k!r})"
        return out

    middle = f"q * {horner(ACKLAM_A, '(q * q)')} / {horner(ACKLAM_B, '(q * q)')}"
    outer = f"{horner(ACKLAM_C, 't')} / {horner(ACKLAM_D, 't')}"
    return f"(CASE WHEN abs(q) <= 0.47575 THEN {middle} ELSE -sign(q) * {outer} END)"


SHAPIRO = f"""
WITH r AS (SELECT s_acctbal AS v, CAST(row_number() OVER (ORDER BY s_acctbal) AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM supplier),
p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM r),
z AS (SELECT *, p - 0.5 AS q, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p),
m AS (SELECT v, i, n, {ppf_sql()} AS m FROM z),
c AS (SELECT any_value(n) AS n, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2, 1 / sqrt(any_value(n)) AS u FROM m),
a AS (SELECT *, m1 / sqrt(mm) + 0.221157 * u - 0.147981 * u * u - 2.071190 * pow(u, 3) + 4.434685 * pow(u, 4) - 2.706056 * pow(u, 5) AS a1,
  m2 / sqrt(mm) + 0.042981 * u - 0.293762 * u * u - 1.752461 * pow(u, 3) + 5.682633 * pow(u, 4) - 3.582633 * pow(u, 5) AS a2 FROM c),
w AS (SELECT m.v, CASE WHEN m.i = m.n THEN a1 WHEN m.i = 1 THEN -a1 WHEN m.i = m.n - 1 THEN a2 WHEN m.i = 2 THEN -a2
  ELSE m.m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS weight FROM m, a)"""


SHAPIRO_W = "pow(sum(weight * v), 2) / (var_pop(v) * count(*))"


@query("shapiro_wilk", f"""{SHAPIRO}
SELECT 'Shapiro-Wilk' AS test, {R(SHAPIRO_W, 6)} AS statistic FROM w""")
def shapiro_wilk(spark, d):
    return rounded(dist.shapiro_wilk(table(spark, d, "supplier"), "s_acctbal").drop("p_value"), 6)


# Royston's normal score of the statistic, for 12 values and more
@query("shapiro_wilk_p_value", f"""{SHAPIRO},
s AS (SELECT {SHAPIRO_W} AS w, ln(count(*)) AS l FROM w),
y AS (SELECT w, -(ln(1 - w) - (-1.5861 - 0.31082 * l - 0.083751 * l * l + 0.0038915 * pow(l, 3))) / exp(-0.4803 - 0.082676 * l + 0.0030302 * l * l) AS z FROM s),
u AS (SELECT w, z, abs(z) AS a FROM y)
SELECT 'Shapiro-Wilk' AS test, {R("w", 6)} AS statistic, {R(cdf_sql(), 6)} AS p_value FROM u""")
def shapiro_wilk_p_value(spark, d):
    return rounded(dist.shapiro_wilk(table(spark, d, "supplier"), "s_acctbal"), 6)


K2 = """
WITH m AS (SELECT CAST(count(*) AS DOUBLE) AS n, skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS g1,
  kurtosis_pop(value) + 3 AS b2, skewness(value) AS skewness, kurtosis(value) AS kurtosis FROM events),
a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
  sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM m),
b AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS q, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM a),
c AS (SELECT *, ln(q + sqrt(q * q + 1)) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (aa - 4)) AS den FROM b),
k AS (SELECT *, z1 * z1 + pow((1 - 2 / (9 * aa) - sign(den) * pow((1 - 2 / aa) / abs(den), 1 / 3.0)) / sqrt(2 / (9 * aa)), 2) AS k2 FROM c)"""


@query("dagostino_pearson", f"""{K2}
SELECT 'D''Agostino-Pearson' AS test, {R("k2", 3)} AS statistic, {R("exp(-k2 / 2)", 6)} AS p_value FROM k""")
def dagostino_pearson(spark, d):
    return rounded(dist.dagostino_pearson(table(spark, d, "events"), "value"), 6, statistic=3)


@query("test_normality", f"""{K2}
SELECT 'D''Agostino-Pearson' AS test, {R("k2", 3)} AS statistic, {R("exp(-k2 / 2)", 6)} AS p_value,
       exp(-k2 / 2) > 0.05 AS is_normal, {R("skewness", 3)} AS skewness, {R("kurtosis", 3)} AS kurtosis FROM k""")
def test_normality(spark, d):
    return rounded(dist.test_normality(table(spark, d, "events"), "value"), 3, p_value=6)


def qq_sql(source: str, column: str) -> str:
    return f"""
WITH r AS (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS position, count(*) OVER () AS n,
  avg({column}) OVER () AS m, stddev({column}) OVER () AS s FROM {source}),
k AS (SELECT *, (position + 0.5) / n AS p FROM r WHERE position % greatest(1, n // 500) = 0),
z AS (SELECT *, p - 0.5 AS q, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM k)
SELECT position, {R("m + s * " + ppf_sql(), 3)} AS theoretical, {R("v", 3)} AS sample FROM z"""


@query("qq_points", qq_sql("events", "value"))
def qq_points(spark, d):
    return rounded(dist.qq_points(table(spark, d, "events"), "value"), 3)


@query("qq_points_lines", qq_sql(f"(SELECT * FROM ({LINE_GAPS}) WHERE l_discount IS NOT NULL)", "l_discount"))
def qq_points_lines(spark, d):
    return rounded(dist.qq_points(line_gaps(spark, d), "l_discount"), 3)


@query("describe_frequency", f"""
WITH c AS (SELECT p_brand AS value, count(*) AS count FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rank,
  sum(count) OVER (ORDER BY count DESC, value ROWS UNBOUNDED PRECEDING) AS running, sum(count) OVER () AS total FROM c)
SELECT rank, value, count, {R("count / total * 100")} AS pct, {R("running / total * 100")} AS cum_pct FROM r WHERE rank <= 10""")
def describe_frequency(spark, d):
    return rounded(dist.describe_frequency(table(spark, d, "part"), "p_brand"))


@query("frequency_stats", f"""
WITH c AS (SELECT l_returnflag AS v, count(*) AS c FROM ({LINE_GAPS}) WHERE l_returnflag IS NOT NULL GROUP BY ALL),
t AS (SELECT sum(c) AS total, count(*) AS k FROM c)
SELECT any_value(k) AS total_categories, least(any_value(k), 10) AS shown_categories, (SELECT v FROM c ORDER BY c DESC, v LIMIT 1) AS top_category,
  {R("max(c) / any_value(total) * 100")} AS top_pct, {R("sum(-(c / total) * log2(c / total + 1e-12))")} AS entropy,
  {R("log2(any_value(k))")} AS max_entropy FROM c, t""")
def frequency_stats(spark, d):
    return rounded(dist.frequency_stats(line_gaps(spark, d), "l_returnflag"))


PARTS = """c AS (SELECT p_brand AS label, count(*) AS count FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, label) AS rank FROM c),
p AS (SELECT least(rank, 11) AS rank, CASE WHEN rank <= 10 THEN label ELSE 'other' END AS label, CAST(sum(count) AS BIGINT) AS count
      FROM r GROUP BY ALL),
s AS (SELECT *, count / sum(count) OVER () * 100 AS pct FROM p)"""


@query("analyze_composition", f"WITH {PARTS} SELECT rank, label, count, {R('pct')} AS pct FROM s")
def analyze_composition(spark, d):
    return rounded(dist.analyze_composition(table(spark, d, "part"), "p_brand"))


@query("composition_stats", f"""WITH {PARTS}
SELECT (SELECT count(*) FROM c) AS total_categories, {R("sum(pct * pct)")} AS hhi,
  CASE WHEN sum(pct * pct) > 2500 THEN 'highly concentrated' WHEN sum(pct * pct) > 1500 THEN 'moderately concentrated' ELSE 'dispersed' END AS concentration,
  {R("sum(pct) FILTER (WHERE rank <= 1)")} AS top1_pct, {R("sum(pct) FILTER (WHERE rank <= 3)")} AS top3_pct FROM s""")
def composition_stats(spark, d):
    return rounded(dist.composition_stats(table(spark, d, "part"), "p_brand"))


@query("eda_categorical", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", rank, value, count, {R("count * 100 / sum(count) OVER ()")} AS pct FROM (
  SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rank FROM (
    SELECT {c} AS value, count(*) AS count FROM {t} GROUP BY ALL)) WHERE rank <= 5"""
    for c, t in (("o_orderstatus", "orders"), ("o_orderpriority", "orders"))))
def eda_categorical(spark, d):
    return rounded(dist.eda_categorical(table(spark, d, "orders")))


def outliers_sql(source: str, column: str) -> str:
    return f"""SELECT q[1] AS q1, q[2] AS median, q[3] AS q3, q[1] - 1.5 * (q[3] - q[1]) AS low, q[3] + 1.5 * (q[3] - q[1]) AS high, m, s
  FROM (SELECT quantile_cont({column}, [0.25, 0.5, 0.75]) AS q, avg({column}) AS m, stddev({column}) AS s FROM {source})"""


CONDITIONS = {
    "iqr": "(value < low OR value > high)",
    "zscore": "abs(value - m) / s > 3",
    "both": "(value < low OR value > high OR abs(value - m) / s > 3)",
}


@query("detect_outliers", f"""
WITH f AS ({outliers_sql("events", "value")})
SELECT event_id, user_id, value FROM events, f WHERE {CONDITIONS["both"]}""")
def detect_outliers(spark, d):
    return dist.detect_outliers(table(spark, d, "events"), "value").select("event_id", "user_id", "value")


@query("outlier_summary", f"WITH f AS ({outliers_sql('events', 'value')}) " + " UNION ALL ".join(f"""
SELECT '{m}' AS method, count(*) AS total_count, count(*) FILTER (WHERE {c}) AS outlier_count,
  {R(f"count(*) FILTER (WHERE {c}) / count(*) * 100")} AS outlier_pct, min(value) AS "min", {R("any_value(q1)")} AS q1,
  {R("any_value(median)")} AS median, {R("any_value(q3)")} AS q3, max(value) AS "max", {R("any_value(low)")} AS lower_fence,
  {R("any_value(high)")} AS upper_fence, {R("any_value(q3 - q1)")} AS iqr FROM events, f""" for m, c in CONDITIONS.items()))
def outlier_summary(spark, d):
    events = table(spark, d, "events")
    rows = [dist.outlier_summary(events, "value", m) for m in CONDITIONS]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query("anomaly_stats", f"""
WITH f AS ({outliers_sql("events", "value")})
SELECT count(*) FILTER (WHERE {CONDITIONS["iqr"]}) AS anomaly_count,
  {R(f"count(*) FILTER (WHERE {CONDITIONS['iqr']}) / count(*) * 100")} AS anomaly_pct,
  {R("any_value(low)")} AS threshold_lower, {R("any_value(high)")} AS threshold_upper FROM events, f""")
def anomaly_stats(spark, d):
    return rounded(dist.anomaly_stats(table(spark, d, "events"), "value"))


@query("anomaly_explain", f"""
WITH f AS ({outliers_sql("events", "value")}),
p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events),
a AS (SELECT p.*, row_number() OVER (ORDER BY abs(value) DESC, pos) AS rank FROM p, f WHERE {CONDITIONS["iqr"]})
SELECT a.rank, a.value, a.event_type, a.user_id, p.pos - a.pos AS "offset", p.value AS near_value,
       strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS near_time
FROM a JOIN p ON p.pos BETWEEN a.pos - 2 AND a.pos + 2 WHERE a.rank <= 5""")
def anomaly_explain(spark, d):
    found = dist.anomaly_explain(
        table(spark, d, "events"), "value", "ts", ["event_type", "user_id"], order_by=["ts", "event_id"]
    )
    return found.select("rank", "value", "event_type", "user_id", F.explode("neighbours").alias("n")).select(
        "rank", "value", "event_type", "user_id", "n.offset", F.col("n.value").alias("near_value"),
        F.date_format("n.date", "yyyy-MM-dd HH:mm:ss").alias("near_time"),
    )


@query("filter_aggregate", f"""
SELECT l_returnflag AS label, {R("sum(l_extendedprice)", 2)} AS value FROM lineitem WHERE l_quantity >= 40 GROUP BY ALL""")
def filter_aggregate(spark, d):
    return rounded(dist.filter_aggregate(table(spark, d, "lineitem"), "l_quantity", "gte", 40, "l_extendedprice", "l_returnflag"), 2)


@query("filter_aggregate_count", """
SELECT event_type AS label, CAST(count(*) AS DOUBLE) AS value FROM events WHERE value > 100 GROUP BY ALL""")
def filter_aggregate_count(spark, d):
    return dist.filter_aggregate(table(spark, d, "events"), "value", "gt", 100, group_by="event_type")


@query("filter_aggregate_match", """
SELECT CASE WHEN l_discount > 0.05 THEN 'match' ELSE 'no match' END AS label, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL""")
def filter_aggregate_match(spark, d):
    return dist.filter_aggregate(table(spark, d, "lineitem"), "l_discount", "gt", 0.05)


@query("filter_stats", f"""
SELECT count(*) FILTER (WHERE l_discount > 0.05) AS filtered_rows, count(*) AS total_rows,
  {R("avg(l_extendedprice) FILTER (WHERE l_discount > 0.05)")} AS filtered_mean, {R("avg(l_extendedprice)")} AS overall_mean,
  {R("count(*) FILTER (WHERE l_discount > 0.05) / count(*) * 100")} AS filter_pct FROM lineitem""")
def filter_stats(spark, d):
    return rounded(dist.filter_stats(table(spark, d, "lineitem"), "l_discount", "gt", 0.05, "l_extendedprice"))


SEGMENT = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def segment_sql(direction: str) -> str:
    ordered = f"ORDER BY l_extendedprice {direction}, l_orderkey, l_linenumber, l_partkey, l_suppkey"
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg({c}) FILTER (WHERE rn <= 100) AS s, avg({c}) FILTER (WHERE rn > 100) AS r FROM t" for c in SEGMENT
    )
    return f"""WITH t AS (SELECT *, row_number() OVER ({ordered}) AS rn FROM lineitem), p AS ({parts})
SELECT "column", {R("s")} AS segment_mean, {R("r")} AS rest_mean, {R("(s - r) / abs(r) * 100")} AS diff_pct FROM p"""


@query("segment_profile", segment_sql("DESC"))
def segment_profile(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(dist.segment_profile(table(spark, d, "lineitem"), "l_extendedprice", SEGMENT, "top", 100, keys))


@query("segment_profile_bottom", segment_sql("ASC"))
def segment_profile_bottom(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(dist.segment_profile(table(spark, d, "lineitem"), "l_extendedprice", SEGMENT, "bottom", 100, keys))


#: the segment holds one value of 1e18 and one that is infinite
SPIKES = """SELECT * REPLACE (CASE WHEN rn = 1 THEN 1e18 ELSE l_quantity END AS l_quantity, CASE WHEN rn = 2 THEN CAST('Infinity' AS DOUBLE) ELSE l_tax END AS l_tax)
  FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)"""


@query("segment_profile_spikes", f"""WITH t AS ({SPIKES}), p AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg({c}) FILTER (WHERE rn <= 100) AS s, avg({c}) FILTER (WHERE rn > 100) AS r FROM t" for c in SEGMENT
) + f""") SELECT "column", CASE WHEN s < 1e15 THEN {R("s")} END AS segment_mean, s > 1e15 AS spike, {R("r")} AS rest_mean FROM p""")
def segment_profile_spikes(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem")
    first = lines.orderBy(F.desc("l_extendedprice"), *keys).limit(2).select(*keys).collect()
    is_row = lambda r: sum((F.when(F.col(k) == r[k], 1).otherwise(0) for k in keys), F.lit(0)) == len(keys)
    spiked = lines.withColumns({
        "l_quantity": F.when(is_row(first[0]), 1e18).otherwise(F.col("l_quantity")),
        "l_tax": F.when(is_row(first[1]), float("inf")).otherwise(F.col("l_tax")),
    })
    found = dist.segment_profile(spiked, "l_extendedprice", SEGMENT, "top", 100, keys)
    mean = F.col("segment_mean")
    return rounded(found.select("column", F.when(mean < 1e15, mean).alias("segment_mean"), (mean > 1e15).alias("spike"), "rest_mean"))


@query("test_normality_shapiro", """
SELECT 'Shapiro-Wilk' AS test, count(*) > 5000 AS many FROM events""")
def test_normality_shapiro(spark, d):
    events = table(spark, d, "events")
    found = dist.test_normality(events, "value", "shapiro").where("statistic BETWEEN 0.5 AND 1 AND NOT is_normal").select("test")
    return found.crossJoin(events.agg((F.count("*") > 5000).alias("many")))
