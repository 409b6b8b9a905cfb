"""Queries over correlation, contingency, groups, components, clusters and data quality."""

from pyspark.sql import functions as F

from loupe.operators import multivariate, quality, relationship as rel
from loupe.suite.registry import LINE_GAPS, R, digits, line_gaps, query, rounded, t_tails_sql, table

GAPS = f"({LINE_GAPS})"


def strength_sql(r: str) -> str:
    return (
        f"CASE WHEN abs({r}) > 0.7 THEN 'strong' WHEN abs({r}) > 0.4 THEN 'medium' ELSE 'weak' END AS strength, "
        f"CASE WHEN {r} > 0 THEN 'positive' ELSE 'negative' END AS direction"
    )


def fit_sql(x: str, y: str) -> str:
    return (
        f"count(*) AS n, corr({y}, {x}) AS r, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, "
        f"sqrt((regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_sxy({y}, {x})) / (count(*) - 2) / regr_sxx({y}, {x})) AS slope_se"
    )


FITTED = f"n, {R('r', 6)} AS r, {R('r * r', 6)} AS r_squared, {R('slope')} AS slope, {R('intercept')} AS intercept, {R('slope_se', 6)} AS slope_se"


@query("correlate", f"""
WITH f AS (SELECT {fit_sql("l_quantity", "l_extendedprice")} FROM lineitem)
SELECT 'pearson' AS method, {FITTED}, {strength_sql("r")} FROM f""")
def correlate(spark, d):
    row = rel.correlate(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").drop("p_value", "significant")
    return rounded(row, 6, slope=4, intercept=4)


def ranks_sql(source: str, columns: list[str]) -> str:
    return "SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in columns
    ) + f", * FROM {source} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in columns)


@query("correlate_spearman", f"""
WITH k AS ({ranks_sql(GAPS, ["l_discount", "l_extendedprice"])}),
f AS (SELECT {fit_sql("l_discount", "l_extendedprice")}, corr(r_l_discount, r_l_extendedprice) AS rho FROM k)
SELECT 'spearman' AS method, {FITTED.replace("'r'", "").replace("round(r,", "round(rho,").replace("round(r * r,", "round(rho * rho,")}, {strength_sql("rho")} FROM f""")
def correlate_spearman(spark, d):
    row = rel.correlate(line_gaps(spark, d), "l_discount", "l_extendedprice", "spearman").drop("p_value", "significant")
    return rounded(row, 6, slope=4, intercept=4)


@query("correlate_p_value", f"""
WITH f AS (SELECT count(*) AS n, corr(l_discount, l_tax) AS r FROM lineitem)
SELECT 'pearson' AS method, n, {R("r", 6)} AS r, {R("p", 6)} AS p_value, p < 0.05 AS significant
FROM ({t_tails_sql("SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS dof FROM f")})""")
def correlate_p_value(spark, d):
    found = rel.correlate(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return rounded(found.select("method", "n", "r", "p_value", "significant"), 6)


@query("trend_line", f"""
WITH f AS (SELECT {fit_sql("l_quantity", "l_extendedprice")}, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
x AS (SELECT lo + i * (hi - lo) / 49 AS x, slope, intercept FROM f, (SELECT unnest(range(0, 50)) AS i))
SELECT {R("x")} AS x, {R("slope * x + intercept", 2)} AS y FROM x""")
def trend_line(spark, d):
    return rounded(rel.trend_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), y=2)


@query("scatter_points", """
SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part ORDER BY p_partkey LIMIT 2000""")
def scatter_points(spark, d):
    return rel.scatter_points(table(spark, d, "part"), "p_size", "p_retailprice", ["p_partkey"])


@query("cross_tabulate", """
WITH c AS (SELECT l_shipdate AS x, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT strftime(x, '%Y-%m-%d') AS x, y, coalesce(n, 0) AS count
FROM (SELECT DISTINCT x FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (x, y)""")
def cross_tabulate(spark, d):
    cells = rel.cross_tabulate(table(spark, d, "lineitem"), "l_shipdate", "l_returnflag", dense=True)
    return cells.withColumn("x", F.date_format("x", "yyyy-MM-dd"))


@query("cross_tabulate_sparse", """
SELECT p_brand AS x, p_type AS y, count(*) AS count FROM part GROUP BY ALL""")
def cross_tabulate_sparse(spark, d):
    return rel.cross_tabulate(table(spark, d, "part"), "p_brand", "p_type")


def chi2_sql(source: str, x: str, y: str) -> str:
    return f"""c AS (SELECT {x} AS x, {y} AS y, count(*) AS o FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
g AS (SELECT x, y, coalesce(o, 0) AS o FROM (SELECT DISTINCT x FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (x, y)),
e AS (SELECT *, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e FROM g),
k AS (SELECT count(DISTINCT x) AS nx, count(DISTINCT y) AS ny, sum(o) AS n,
  CASE WHEN count(DISTINCT x) = 2 AND count(DISTINCT y) = 2 THEN sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e)
       ELSE sum(pow(o - e, 2) / e) END AS chi2 FROM e)
SELECT {R("chi2")} AS chi2, CAST((nx - 1) * (ny - 1) AS BIGINT) AS dof, {R("sqrt(chi2 / (n * (least(nx, ny) - 1)))", 6)} AS cramers_v FROM k"""


@query("cross_stats", f"WITH {chi2_sql('part', 'p_brand', 'p_type')}")
def cross_stats(spark, d):
    return rounded(rel.cross_stats(table(spark, d, "part"), "p_brand", "p_type").drop("p_value", "significant"), cramers_v=6)


@query("cross_stats_yates", f"WITH {chi2_sql('labels', 'quality', 'toxic')}")
def cross_stats_yates(spark, d):
    return rounded(rel.cross_stats(table(spark, d, "labels"), "quality", "toxic").drop("p_value", "significant"), cramers_v=6)


# the tail of chi-squared with two degrees of freedom is exp(-x / 2)
@query("cross_stats_p_value", f"""
WITH {chi2_sql(GAPS, "l_returnflag", "l_linestatus").replace("SELECT (round(chi2", "SELECT " + R("exp(-chi2 / 2)", 6) + " AS p_value, exp(-chi2 / 2) < 0.05 AS significant, (round(chi2")}""")
def cross_stats_p_value(spark, d):
    return rounded(rel.cross_stats(line_gaps(spark, d), "l_returnflag", "l_linestatus"), cramers_v=6, p_value=6)


@query("group_boxplot", f"""
SELECT l_returnflag AS "group", min(l_extendedprice) AS "min", {R("quantile_cont(l_extendedprice, 0.25)")} AS q1,
  {R("quantile_cont(l_extendedprice, 0.5)")} AS median, {R("quantile_cont(l_extendedprice, 0.75)")} AS q3,
  max(l_extendedprice) AS "max", {R("avg(l_extendedprice)")} AS mean, {R("stddev_pop(l_extendedprice)")} AS std,
  count(l_extendedprice) AS count FROM {GAPS} WHERE l_returnflag IS NOT NULL GROUP BY ALL HAVING count(l_extendedprice) >= 3""")
def group_boxplot(spark, d):
    return rounded(rel.group_boxplot(line_gaps(spark, d), "l_returnflag", "l_extendedprice"))


def groups_sql(source: str, group: str, value: str) -> str:
    return f"""v AS (SELECT {group} AS g, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {group} IS NOT NULL AND {value} IS NOT NULL),
g AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM v GROUP BY g HAVING count(*) >= 3),
t AS (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS grand FROM g),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * pow(m - grand, 2)) AS ssb, sum(ss) AS ssw FROM t)"""


@query("compare_groups", f"""
WITH {groups_sql("events", "event_type", "value")}
SELECT 'ANOVA' AS test, {R("(ssb / (k - 1)) / (ssw / (n - k))", 6)} AS statistic, {R("ssb / (ssb + ssw)", 6)} AS eta_squared,
  k AS n_groups, CAST(n AS BIGINT) AS total_n FROM s""")
def compare_groups(spark, d):
    return rounded(rel.compare_groups(table(spark, d, "events"), "event_type", "value").drop("p_value", "significant"), 6)


KRUSKAL = """r AS (SELECT v.g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM v SEMI JOIN g ON v.g = g.g),
o AS (SELECT g, r - avg(r) OVER () AS o FROM r),
q AS (SELECT g, count(*) AS n, sum(o) AS s, sum(o * o) AS ss FROM o GROUP BY g),
h AS (SELECT (sum(n) - 1) * sum(s * s / n) / sum(ss) AS h FROM q)"""


@query("compare_groups_ranks", f"""
WITH {groups_sql("orders", "o_custkey", "o_totalprice")}, {KRUSKAL}
SELECT 'Kruskal-Wallis' AS test, {R("h")} AS statistic, {R("ssb / (ssb + ssw)", 6)} AS eta_squared,
  k AS n_groups, CAST(n AS BIGINT) AS total_n FROM s, h""")
def compare_groups_ranks(spark, d):
    row = rel.compare_groups(table(spark, d, "orders"), "o_custkey", "o_totalprice", "kruskal").drop("p_value", "significant")
    return rounded(row, 6, statistic=4)


@query("kruskal_wallis", f"""
WITH {groups_sql(GAPS, "l_returnflag", "l_discount")}, {KRUSKAL}
SELECT 'Kruskal-Wallis' AS test, {R("h")} AS statistic, {R("exp(-h / 2)", 6)} AS p_value FROM h""")
def kruskal_wallis(spark, d):
    return rounded(rel.kruskal_wallis(line_gaps(spark, d), "l_returnflag", "l_discount"), p_value=6)


# with four degrees of freedom above, the tail of F is x^a * (1 + a * (1 - x)), a = d2 / 2, x = d2 / (d2 + 4 F)
@query("compare_groups_p_value", f"""
WITH {groups_sql("customer", "c_mktsegment", "c_acctbal")},
f AS (SELECT *, (ssb / (k - 1)) / (ssw / (n - k)) AS f, (n - k) / 2 AS a FROM s), x AS (SELECT *, (n - k) / ((n - k) + 4 * f) AS x FROM f)
SELECT 'ANOVA' AS test, {R("f", 6)} AS statistic, {R("pow(x, a) * (1 + a * (1 - x))", 6)} AS p_value,
  pow(x, a) * (1 + a * (1 - x)) < 0.05 AS significant, {R("ssb / (ssb + ssw)", 6)} AS eta_squared,
  k AS n_groups, CAST(n AS BIGINT) AS total_n FROM x""")
def compare_groups_p_value(spark, d):
    return rounded(rel.compare_groups(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), 6)


PAIRS = "(SELECT n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("compare_pairs", f"""
WITH {groups_sql(PAIRS, "CAST(n_regionkey AS VARCHAR)", "c_acctbal")}
SELECT a.g AS group_a, b.g AS group_b, {R("a.m - b.m")} AS diff,
  {R("(a.m - b.m) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n))", 6)} AS statistic
FROM g a JOIN g b ON a.g < b.g""")
def compare_pairs(spark, d):
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(rel.compare_pairs(customers, "n_regionkey", "c_acctbal").drop("p_value", "p_bonferroni", "significant"), statistic=6)


TESTED = """SELECT a.g AS group_a, b.g AS group_b, (a.m - b.m) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t,
  CAST(a.n + b.n - 2 AS DOUBLE) AS dof, (SELECT count(*) * (count(*) - 1) // 2 FROM g) AS pairs FROM g a JOIN g b ON a.g < b.g"""


@query("compare_pairs_p_value", f"""
WITH {groups_sql("events", "event_type", "value")}
SELECT group_a, group_b, {R("t", 6)} AS statistic, {R("p", 6)} AS p_value, {R("least(p * pairs, 1.0)", 6)} AS p_bonferroni, p < 0.05 AS significant
FROM ({t_tails_sql(TESTED)})""")
def compare_pairs_p_value(spark, d):
    return rounded(rel.compare_pairs(table(spark, d, "events"), "event_type", "value").drop("diff"), 6)


MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def matrix_sql(columns, cells) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {R(cells(a, b), 6)} AS r FROM t" for a in columns for b in columns
    )


@query("correlation_matrix", f"""
WITH t AS (SELECT * FROM {GAPS} WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL)
{matrix_sql(MATRIX, lambda a, b: f"corr({a}, {b})")}""")
def correlation_matrix(spark, d):
    return rounded(rel.correlation_matrix(line_gaps(spark, d), MATRIX), 6)


@query("correlation_matrix_spearman", f"""
WITH t AS ({ranks_sql(GAPS, MATRIX)}) {matrix_sql(MATRIX, lambda a, b: f"corr(r_{a}, r_{b})")}""")
def correlation_matrix_spearman(spark, d):
    return rounded(rel.correlation_matrix(line_gaps(spark, d), MATRIX, "spearman"), 6)


@query("correlation_pairs", f"""
WITH t AS (SELECT * FROM lineitem), m AS ({matrix_sql(MATRIX, lambda a, b: f"corr({a}, {b})")})
SELECT a, b, r FROM m WHERE a < b ORDER BY abs(r) DESC LIMIT 5""")
def correlation_pairs(spark, d):
    return rounded(rel.correlation_pairs(rel.correlation_matrix(table(spark, d, "lineitem"), MATRIX), 5), 6)


@query("related_columns", f"""
WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem),
m AS ({matrix_sql(["l_discount", "l_extendedprice", "l_quantity", "revenue"], lambda a, b: f"corr({a}, {b})")})
SELECT a, b, r FROM m WHERE a < b AND abs(r) > 0.3""")
def related_columns(spark, d):
    lines = table(spark, d, "lineitem").withColumn("revenue", F.expr("l_extendedprice * (1 - l_discount)"))
    return rounded(rel.related(lines, ["l_discount", "l_extendedprice", "l_quantity", "revenue"]).drop("p_value"), 6)


@query("eda_correlation", f"""
WITH t AS ({LINE_GAPS}) """ + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {R(f'corr({a}, {b})', 6)} AS r FROM t"
    for i, a in enumerate(MATRIX) for b in MATRIX[i + 1:]))
def eda_correlation(spark, d):
    from loupe.operators.profiling import pairwise_correlation

    return rounded(pairwise_correlation(line_gaps(spark, d), MATRIX), 6)


GAP_COLUMNS = ["l_discount", "l_tax", "l_returnflag"]


@query("missing_correlation", f"""
WITH t AS ({LINE_GAPS}) """ + matrix_sql(GAP_COLUMNS, lambda a, b: f"corr(({a} IS NULL)::INT, ({b} IS NULL)::INT)"))
def missing_correlation(spark, d):
    return rounded(rel.missing_correlation(line_gaps(spark, d)), 6)


@query("profile_missing", f"WITH t AS ({LINE_GAPS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {R(f'count(*) FILTER (WHERE {c} IS NULL) / count(*)')} AS missing_rate, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM t" for c in GAP_COLUMNS))
def profile_missing(spark, d):
    return rounded(quality.profile_missing(line_gaps(spark, d)))


@query("missing_stats", f"""
WITH t AS (SELECT count(*) * 11 AS cells, count(*) FILTER (WHERE l_discount IS NULL) + count(*) FILTER (WHERE l_tax IS NULL)
  + count(*) FILTER (WHERE l_returnflag IS NULL) AS missing FROM {GAPS})
SELECT cells AS total_cells, missing AS missing_cells, 3 AS columns_with_missing, 8 AS columns_no_missing,
  {R("missing / cells * 100")} AS missing_pct FROM t""")
def missing_stats(spark, d):
    return rounded(quality.missing_stats(line_gaps(spark, d)))


@query("profile_duplicates", f"""
WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_rows,
  {R("sum(n) FILTER (WHERE n > 1) / sum(n) * 100")} AS duplicate_pct FROM g""")
def profile_duplicates(spark, d):
    return rounded(quality.profile_duplicates(table(spark, d, "documents"), ["text"]))


@query("profile_duplicates_rows", f"""
WITH g AS (SELECT l_suppkey, l_linenumber, l_quantity, l_returnflag, count(*) AS n FROM {GAPS} GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_rows,
  {R("sum(n) FILTER (WHERE n > 1) / sum(n) * 100")} AS duplicate_pct FROM g""")
def profile_duplicates_rows(spark, d):
    lines = line_gaps(spark, d).select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return rounded(quality.profile_duplicates(lines))


@query("duplicate_sample", """
SELECT source, lang, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1
ORDER BY copies DESC, source, lang LIMIT 20""")
def duplicate_sample(spark, d):
    return quality.duplicate_sample(table(spark, d, "documents"), ["source", "lang"])


# Three scaled columns: the eigenvalues of their correlation matrix in closed
# form, an axis as the cross product of two rows of R - lambda I.
THREE = ["l_extendedprice", "revenue", "l_discount"]
AXES = """t AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b, l_discount AS c FROM lineitem),
r AS (SELECT corr(a, b) AS x, corr(a, c) AS y, corr(b, c) AS z, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc,
  stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM t),
p AS (SELECT *, sqrt((x * x + y * y + z * z) / 3) AS p FROM r),
f AS (SELECT *, acos(x * y * z / (p * p * p)) / 3 AS phi FROM p),
e AS (SELECT *, 1 + 2 * p * cos(phi) AS e1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM f),
g AS (SELECT 'pc1' AS component, e1 AS e, * FROM e UNION ALL SELECT 'pc2', 3 - e1 - e3, * FROM e),
v AS (SELECT *, x * z - y * (1 - e) AS va, y * x - (1 - e) * z AS vb, (1 - e) * (1 - e) - x * x AS vc FROM g),
u AS (SELECT *, sqrt(va * va + vb * vb + vc * vc) * CASE
  WHEN abs(va) >= abs(vb) AND abs(va) >= abs(vc) THEN sign(va) WHEN abs(vb) >= abs(vc) THEN sign(vb) ELSE sign(vc) END AS len FROM v),
axes AS (SELECT component, e, n, ma, mb, mc, sa, sb, sc, va / len AS a1, vb / len AS b1, vc / len AS c1 FROM u)"""


def components(spark, d):
    lines = table(spark, d, "lineitem").withColumn("revenue", F.expr("l_extendedprice * (1 - l_discount)"))
    return multivariate.dimension_reduce(lines, THREE, 2, keys=["l_orderkey", "l_linenumber"])


def score_sql(axis: str) -> str:
    return f"(a - {axis}.ma) / {axis}.sa * {axis}.a1 + (b - {axis}.mb) / {axis}.sb * {axis}.b1 + (c - {axis}.mc) / {axis}.sc * {axis}.c1"


@query("dimension_reduce", f"""
WITH {AXES} SELECT l_orderkey, l_linenumber, {R(score_sql("one"), 5)} AS pc1, {R(score_sql("two"), 5)} AS pc2
FROM t, (SELECT * FROM axes WHERE component = 'pc1') one, (SELECT * FROM axes WHERE component = 'pc2') two""")
def dimension_reduce(spark, d):
    return rounded(components(spark, d).scores, 5)


@query("dimension_reduce_variance", f"""
WITH {AXES}
SELECT component, {R("e", 6)} AS eigenvalue, {R("e / 3", 6)} AS variance_explained,
  {R("sum(e) OVER (ORDER BY component) / 3", 6)} AS cumulative_variance, n AS n_samples FROM axes""")
def dimension_reduce_variance(spark, d):
    return rounded(components(spark, d).variance, 6)


@query("dimension_reduce_loadings", f"""
WITH {AXES}, l AS (SELECT component, unnest(['l_extendedprice', 'revenue', 'l_discount']) AS variable, unnest([a1, b1, c1]) AS w FROM axes)
SELECT variable, {R("max(w) FILTER (WHERE component = 'pc1')", 6)} AS pc1, {R("max(w) FILTER (WHERE component = 'pc2')", 6)} AS pc2
FROM l GROUP BY variable""")
def dimension_reduce_loadings(spark, d):
    return rounded(components(spark, d).loadings, 6)


def vectors(spark, d, n: int = 8):
    """The first dimensions of the embeddings, as columns."""
    return table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


# All dimensions: axes have length 1 and are orthogonal, scores have the variance of their eigenvalue.
@query("dimension_reduce_embeddings", """
SELECT count(*) AS n_samples, 64 AS variables, 1.0 AS length_1, 1.0 AS length_2, 0.0 AS product, 1.0 AS scaled_1, 1.0 AS scaled_2, true AS falling
FROM embeddings""")
def dimension_reduce_embeddings(spark, d):
    found = multivariate.dimension_reduce(vectors(spark, d, 64), [f"e{i}" for i in range(64)], 2)
    one, two = found.variance.orderBy("component").collect()
    axes = found.loadings.agg(
        F.count("*").cast("int").alias("variables"), digits(F.sum(F.col("pc1") * F.col("pc1")), 6).alias("length_1"),
        digits(F.sum(F.col("pc2") * F.col("pc2")), 6).alias("length_2"), digits(F.sum(F.col("pc1") * F.col("pc2")), 6).alias("product"),
    )
    first = found.scores.agg(
        F.count("*").alias("n_samples"), digits(F.var_samp("pc1") / one.eigenvalue, 2).alias("scaled_1"), F.lit(one.eigenvalue >= two.eigenvalue).alias("falling")
    )
    second = found.scores.agg(digits(F.var_samp("pc2") / two.eigenvalue, 2).alias("scaled_2"))
    return axes.crossJoin(first).crossJoin(second)  # one row each


# Scores have mean 0, are uncorrelated and vary less from one component to the next.
@query("dimension_reduce_identity", f"""
WITH {AXES}, s AS (SELECT {score_sql("one")} AS pc1, {score_sql("two")} AS pc2
  FROM t, (SELECT * FROM axes WHERE component = 'pc1') one, (SELECT * FROM axes WHERE component = 'pc2') two)
SELECT {R("avg(pc1)", 6)} AS pc1_mean, {R("covar_pop(pc1, pc2)", 6)} AS pc1_pc2, {R("var_pop(pc1)", 6)} AS pc1_var,
  {R("var_pop(pc2)", 6)} AS pc2_var, var_pop(pc1) >= var_pop(pc2) AS falling FROM s""")
def dimension_reduce_identity(spark, d):
    return components(spark, d).scores.agg(
        digits(F.avg("pc1"), 6).alias("pc1_mean"),
        digits(F.covar_pop("pc1", "pc2"), 6).alias("pc1_pc2"),
        digits(F.var_pop("pc1"), 6).alias("pc1_var"),
        digits(F.var_pop("pc2"), 6).alias("pc2_var"),
        (F.var_pop("pc1") >= F.var_pop("pc2")).alias("falling"),
    )


def invariants(found, rows, names):
    """One row: rows, rows in clusters and in assignments, sizes and centres that aren't those of the assigned rows, rows nearer to another centre."""
    groups = found.assignments.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names])
    off = sum((F.when(F.abs(F.col(f"m_{c}") - F.col(c)) > 1e-6 * (1 + F.abs(F.col(c))), 1).otherwise(0) for c in names), F.lit(0))
    sizes = found.clusters.join(groups, "cluster", "full").agg(
        F.sum("size").alias("clustered"), F.sum("n").alias("assigned"), F.sum(F.when(F.col("size") == F.col("n"), 0).otherwise(1)).alias("wrong_sizes"),
        F.sum(F.coalesce(off, F.lit(1))).alias("wrong_centres"),
    )
    spread = found.assignments.agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    # every row beside each of the few centres, which travel as one row
    centres = found.clusters.agg(F.collect_list(F.struct("cluster", *[F.col(c).alias(f"c_{c}") for c in names])).alias("centres"))
    apart = lambda centre: sum((((F.col(c) - centre[f"c_{c}"]) / F.col(f"s_{c}")) ** 2 for c in names), F.lit(0.0))
    beside = found.assignments.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(centres))
    near = beside.select(
        F.array_min(F.transform("centres", apart)).alias("least"),
        F.array_max(F.transform("centres", lambda centre: F.when(centre["cluster"] == F.col("cluster"), apart(centre)))).alias("own"),
    )
    far = near.agg(F.sum(F.when(F.col("own") > F.col("least") + 1e-3, 1).otherwise(0)).alias("far_rows"))
    return rows.agg(F.count("*").alias("rows")).crossJoin(sizes).crossJoin(far)


def invariant_sql(source):
    return f"SELECT count(*) AS rows, count(*) AS clustered, count(*) AS assigned, 0 AS wrong_sizes, 0 AS wrong_centres, 0 AS far_rows FROM {source}"


@query("cluster_analysis", invariant_sql("lineitem"))
def cluster_analysis(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    lines = table(spark, d, "lineitem").withColumn("row", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    found = multivariate.cluster_analysis(lines, names, keys=["row"], steps=100)
    return invariants(found, lines, names)


@query("cluster_analysis_assignments", invariant_sql("customer"))
def cluster_analysis_assignments(spark, d):
    names = ["c_acctbal", "c_nationkey"]
    customers = table(spark, d, "customer").withColumn("row", F.col("c_custkey"))
    return invariants(multivariate.cluster_analysis(customers, names, 3, keys=["row"], steps=100), customers, names)
