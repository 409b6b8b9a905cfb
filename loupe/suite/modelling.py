"""Queries over regression, diagnostics and what-if analysis."""

from pyspark.sql import functions as F

from loupe.operators import regression as reg, whatif
from loupe.suite.registry import LINE_GAPS, R, digits, line_gaps, query, rounded, solved_sql, table

# l_extendedprice on l_quantity and l_discount (with gaps, filled with the median)
FEATURES = ["l_quantity", "l_discount"]
MODEL = f"""med AS (SELECT quantile_cont(l_discount, 0.5) AS m FROM ({LINE_GAPS})),
d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, l_quantity AS a, coalesce(l_discount, m) AS b FROM ({LINE_GAPS}), med),
s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(b, a) AS sab,
  regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_syy(y, a) AS syy, quantile_cont(a, 0.01) AS alo, quantile_cont(a, 0.99) AS ahi,
  quantile_cont(b, 0.01) AS blo, quantile_cont(b, 0.99) AS bhi FROM d),
k AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ca, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS cb FROM s),
m AS (SELECT *, my - ca * ma - cb * mb AS c0, syy - ca * say - cb * sby AS sse, sqrt((syy - ca * say - cb * sby) / (n - 3)) AS rs FROM k)"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def fitted(spark, d):
    return reg.train_linear_regression(line_gaps(spark, d), "l_extendedprice", FEATURES, keys=KEYS)


@query("preview_training", f"""
WITH t AS ({LINE_GAPS}), c AS (SELECT count(*) AS n, count(l_tax) AS y, count(l_discount) AS a, count(l_quantity) AS b,
  count(TRY_CAST(l_returnflag AS DOUBLE)) AS c FROM t)
SELECT f AS feature, n AS total_rows, y AS effective_rows, n - y AS y_dropped, {R("(n - y) * 100.0 / n")} AS y_dropped_pct,
  n - k AS nan_count, {R("(n - k) * 100.0 / n")} AS nan_pct, k = 0 AS all_nan
FROM (SELECT 'l_discount' AS f, n, y, a AS k FROM c UNION ALL SELECT 'l_quantity', n, y, b FROM c UNION ALL SELECT 'l_returnflag', n, y, c FROM c)""")
def preview_training(spark, d):
    return rounded(reg.preview_training(line_gaps(spark, d), "l_tax", ["l_discount", "l_quantity", "l_returnflag"]))


@query("prepare_training", f"""
WITH t AS (SELECT * FROM ({LINE_GAPS}) WHERE l_tax IS NOT NULL), m AS (SELECT quantile_cont(l_discount, 0.5) AS m FROM t)
SELECT count(*) AS n, {R("sum(l_tax)")} AS y, {R("sum(l_quantity)")} AS x0, {R("sum(coalesce(l_discount, m))")} AS x1 FROM t, m""")
def prepare_training(spark, d):
    prepared = reg.prepare_training(line_gaps(spark, d), "l_tax", FEATURES)
    return rounded(prepared.data.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("x0").alias("x0"), F.sum("x1").alias("x1")))


@query("high_cardinality_features", f"""
SELECT 'o_orderkey' AS feature, count(DISTINCT o_orderkey) AS unique_count, {R("count(DISTINCT o_orderkey) / count(*)")} AS ratio FROM orders""")
def high_cardinality_features(spark, d):
    prepared = reg.prepare_training(table(spark, d, "orders"), "o_totalprice", ["o_orderkey", "o_custkey"])
    return rounded(reg.high_cardinality_features(prepared))


@query("train_linear_regression", f"""
WITH {MODEL} SELECT 'l_extendedprice' AS target, {R("c0")} AS intercept, {R("1 - sse / syy", 6)} AS r2, {R("rs")} AS residual_std,
  n AS n_samples, 0 AS n_dropped, (SELECT count(*) FROM ({LINE_GAPS}) WHERE l_discount IS NULL) AS n_imputed,
  {R("my")} AS target_mean, {R("sqrt(syy / (n - 1))")} AS target_std FROM m""")
def train_linear_regression(spark, d):
    return rounded(fitted(spark, d).summary(), r2=6)


@query("train_single_feature", f"""
SELECT 'p_retailprice' AS target, {R("regr_intercept(p_retailprice, p_size)")} AS intercept, {R("regr_r2(p_retailprice, p_size)", 6)} AS r2 FROM part""")
def train_single_feature(spark, d):
    model = reg.train_linear_regression(table(spark, d, "part"), "p_retailprice", ["p_size"])
    return rounded(model.summary().select("target", "intercept", "r2"), r2=6)


@query("feature_table", f"""
WITH {MODEL} SELECT 'l_quantity' AS feature, {R("ca")} AS coefficient, {R("alo")} AS "min", {R("ahi")} AS "max", {R("ma", 6)} AS mean FROM m
UNION ALL SELECT 'l_discount', {R("cb")}, {R("blo")}, {R("bhi")}, {R("mb", 6)} FROM m""")
def feature_table(spark, d):
    return rounded(fitted(spark, d).feature_table(), mean=6)


@query("feature_ranges", f"""
WITH {MODEL} SELECT 'l_quantity' AS feature, {R("alo")} AS "min", {R("ahi")} AS "max", {R("ma", 6)} AS mean FROM m
UNION ALL SELECT 'l_discount', {R("blo")}, {R("bhi")}, {R("mb", 6)} FROM m""")
def feature_ranges(spark, d):
    return rounded(reg.feature_ranges(fitted(spark, d)), mean=6)


@query("feature_importance", f"""
WITH {MODEL}, w AS (SELECT *, ca * sqrt(saa / syy) AS wa, cb * sqrt(sbb / syy) AS wb FROM m)
SELECT 'l_quantity' AS feature, {R("wa", 6)} AS standardized_coefficient, {R("ca")} AS original_coefficient,
  {R("say / sqrt(saa * syy)", 6)} AS correlation_with_target, {R("abs(wa) / (abs(wa) + abs(wb)) * 100")} AS relative_importance,
  {R("ma", 6)} AS x_mean, {R("sqrt(saa / (n - 1))")} AS x_std FROM w
UNION ALL SELECT 'l_discount', {R("wb", 6)}, {R("cb")}, {R("sby / sqrt(sbb * syy)", 6)},
  {R("abs(wb) / (abs(wa) + abs(wb)) * 100")}, {R("mb", 6)}, {R("sqrt(sbb / (n - 1))")} FROM w""")
def feature_importance(spark, d):
    return rounded(reg.feature_importance(fitted(spark, d)), standardized_coefficient=6, correlation_with_target=6, x_mean=6)


@query("vif", f"""
WITH c AS (SELECT corr(l_extendedprice, l_extendedprice * (1 - l_discount)) AS r FROM lineitem)
SELECT f AS feature, {R("1 / (1 - r * r)", 3)} AS vif,
  CASE WHEN 1 / (1 - r * r) > 10 THEN 'severe' WHEN 1 / (1 - r * r) > 5 THEN 'moderate' ELSE 'low' END AS level
FROM c, (SELECT unnest(['l_extendedprice', 'revenue']) AS f)""")
def vif(spark, d):
    lines = table(spark, d, "lineitem").withColumn("revenue", F.expr("l_extendedprice * (1 - l_discount)"))
    return rounded(reg.vif(reg.train_linear_regression(lines, "l_quantity", ["l_extendedprice", "revenue"])), 3)


RESIDUALS = f"{MODEL}, e AS (SELECT d.*, c0 + ca * a + cb * b AS p, y - (c0 + ca * a + cb * b) AS e, m.n, sse FROM d, m)"


@query("residual_diagnostics", f"""
WITH {RESIDUALS} SELECT {R("avg(e)", 3)} AS mean_residual, {R("stddev_pop(e)", 3)} AS std_residual,
  {R("skewness(e) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))")} AS skewness, {R("kurtosis_pop(e)")} AS kurtosis,
  count(*) FILTER (WHERE abs(e) / sqrt(sse / (n - 1)) > 3) AS n_outliers FROM e""")
def residual_diagnostics(spark, d):
    return rounded(reg.residual_diagnostics(fitted(spark, d)), mean_residual=3, std_residual=3)


@query("residual_qq", f"""
WITH {RESIDUALS}, r AS (SELECT e / sqrt(sse / (n - 1)) AS sample, row_number() OVER (ORDER BY e) - 1 AS position, n FROM e)
SELECT position, {R("sample", 6)} AS sample FROM r WHERE position % greatest(1, n // 300) = 0""")
def residual_qq(spark, d):
    return rounded(reg.residual_qq(fitted(spark, d)).drop("theoretical"), 6)


@query("predicted_against_actual", f"""
WITH {RESIDUALS}, r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, y, b) - 1 AS position FROM e)
SELECT position, y AS actual, {R("p", 3)} AS predicted FROM r WHERE position % greatest(1, n // 500) = 0""")
def predicted_against_actual(spark, d):
    points = reg.predicted_against_actual(fitted(spark, d), [*KEYS, "y", "x1"])
    return points.select("position", "actual", digits("predicted", 3))


@query("durbin_watson", f"""
WITH {RESIDUALS}, r AS (SELECT e, e - lag(e) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, y, b) AS step FROM e)
SELECT {R("sum(step * step) / sum(e * e)", 6)} AS durbin_watson FROM r""")
def durbin_watson(spark, d):
    return rounded(reg.durbin_watson(fitted(spark, d), [*KEYS, "y", "x1"]), 6)


def folds_sql(features: list[str]) -> str:
    """CTEs over rows (k, y, x0, x1, ...) of ``rows``: ``parts`` with their fold of five, and ``trained`` with the sums of the other folds."""
    names = [*features, "y"]
    text = "'42/' || " + " || '/' || ".join(KEYS)
    covariances = " UNION ALL ".join(
        f"SELECT f, {i} AS i, {j} AS j, c{i}_{j} AS v FROM trained" for i in range(len(features)) for j in range(len(names))
    )
    sums = ", ".join(
        [f"avg({c}) AS m{i}" for i, c in enumerate(names)]
        + [f"covar_pop({a}, {b}) * count(*) AS c{i}_{j}" for i, a in enumerate(features) for j, b in enumerate(names)]
        + [f"stddev_pop({c}) AS s{i}" for i, c in enumerate(features)]
    )
    return f"""parts AS (SELECT *, CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % 5 AS fold FROM rows),
trained AS (SELECT f, count(*) AS n, {sums} FROM parts, (SELECT unnest(range(0, 5)) AS f) WHERE fold <> f GROUP BY f),
equations AS ({covariances})"""


CROSS = f"""WITH {MODEL}, rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y, a AS x0, b AS x1 FROM d), {folds_sql(["x0", "x1"])},
{solved_sql("SELECT * FROM equations", 2)},
w AS (SELECT f, max(v) FILTER (WHERE i = 0) AS b0, max(v) FILTER (WHERE i = 1) AS b1 FROM g2 WHERE j = 2 GROUP BY f),
e AS (SELECT fold, y, y - m2 - b0 * (x0 - m0) - b1 * (x1 - m1) AS e FROM parts JOIN trained t ON t.f = fold JOIN w ON w.f = fold),
r AS (SELECT fold, count(*) AS n, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY fold)"""


@query("cross_val_r2", f"{CROSS} SELECT fold, n, {R('r2', 6)} AS r2 FROM r")
def cross_val_r2(spark, d):
    return rounded(reg.cross_val_r2(fitted(spark, d), keys=KEYS), 6)


@query("cross_val_summary", f"""{CROSS}
SELECT {R("avg(r2)", 6)} AS cross_val_r2, {R("stddev_pop(r2)", 6)} AS cross_val_r2_std, count(*) AS folds FROM r""")
def cross_val_summary(spark, d):
    return rounded(reg.cross_val_summary(reg.cross_val_r2(fitted(spark, d), keys=KEYS)), 6)


COMPARED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def compared_sql() -> str:
    """The three models by Gauss-Jordan steps and, for Lasso, recursive coordinate descent."""
    xs = [f"x{i}" for i in range(4)]
    filled = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM t)) AS x{i}" for i, c in enumerate(COMPARED))
    g = lambda i, j: f"(c{i}_{j} / n / s{i} / s{j})"
    rho = lambda i: f"(c{i}_4 / n / s{i})"
    soft = lambda x, by: f"sign({x}) * greatest(abs({x}) - 0.1, 0) / {by}"
    inner = "SELECT * FROM lasso WHERE k < 400"
    for i in range(4):
        pull = rho(i) + "".join(f" - {g(i, j)} * w{j}" for j in range(4) if j != i)
        inner = f"SELECT * REPLACE ({soft(f'({pull})', g(i, i))} AS w{i}) FROM ({inner})"
    weights = lambda source: f"SELECT {', '.join(f'max(v) FILTER (WHERE i = {i}) AS b{i}' for i in range(4))} FROM {source}4 WHERE j = 4"
    ridge = "SELECT f, i, j, CASE WHEN j = 4 THEN v / s.s ELSE v / s.s / z.s END + CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM equations JOIN scales s ON s.i0 = i LEFT JOIN scales z ON z.i0 = j WHERE f = 0"
    ridge_steps = solved_sql(ridge, 4).replace("g0 ", "h0 ")
    for k in range(5):
        ridge_steps = ridge_steps.replace(f"g{k} ", f"h{k} ")
    tested = lambda name, of: f"""SELECT '{name}' AS model, (SELECT n FROM trained WHERE f = 0) AS n_train, count(*) AS n_test,
  1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, sqrt(avg(e * e)) AS rmse
  FROM (SELECT y, y - m4 - {" - ".join(f"{of}{i} * (x{i} - m{i})" + (f" / s{i}" if name != "Linear" else "") for i in range(4))} AS e
    FROM parts, (SELECT * FROM trained WHERE f = 0), {name.lower()}_w WHERE fold = 0)"""
    return f"""WITH RECURSIVE t AS ({LINE_GAPS}), rows AS (SELECT l_orderkey, l_linenumber AS l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, {filled} FROM t),
{folds_sql(xs)},
scales AS ({" UNION ALL ".join(f"SELECT {i} AS i0, s{i} AS s FROM trained WHERE f = 0" for i in range(4))}),
{solved_sql("SELECT * FROM equations WHERE f = 0", 4)},
{ridge_steps},
lasso AS (
  SELECT 0 AS k, *, {", ".join(f"0.0::DOUBLE AS w{i}" for i in range(4))} FROM trained WHERE f = 0
  UNION ALL SELECT * REPLACE (k + 1 AS k) FROM ({inner})
),
linear_w AS ({weights("g")}), ridge_w AS ({weights("h")}), lasso_w AS (SELECT {", ".join(f"w{i} AS b{i}" for i in range(4))} FROM lasso WHERE k = 400),
found AS ({" UNION ALL ".join(tested(name, "b") for name in ("Linear", "Ridge", "Lasso"))})
SELECT model, n_train, n_test, {R("r2", 6)} AS r2, {R("rmse", 3)} AS rmse FROM found"""


@query("compare_models", compared_sql())
def compare_models(spark, d):
    model = reg.train_linear_regression(line_gaps(spark, d), "l_extendedprice", COMPARED, keys=KEYS)
    return rounded(reg.compare_models(model, keys=KEYS), 6, rmse=3)


@query("predict", f"""
WITH {MODEL} SELECT l_orderkey, l_linenumber, y, {R("c0 + ca * a + cb * b", 2)} AS prediction,
  {R("c0 + ca * a + cb * b - 1.96 * rs", 2)} AS lower, {R("c0 + ca * a + cb * b + 1.96 * rs", 2)} AS upper FROM d, m""")
def predict(spark, d):
    scored = whatif.predict(fitted(spark, d), line_gaps(spark, d))
    return scored.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), digits("prediction", 2), digits("lower", 2), digits("upper", 2)
    )


@query("contributions", f"""
WITH {MODEL} SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, a AS value, {R("ca * a", 2)} AS contribution FROM d, m
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', coalesce(l_discount, 0), {R("cb * coalesce(l_discount, 0)", 2)}
FROM ({LINE_GAPS}), m""")
def contributions(spark, d):
    rows = whatif.contributions(fitted(spark, d), line_gaps(spark, d), ["l_orderkey", "l_linenumber"])
    return rounded(rows, contribution=2)


@query("scenario_compare", f"""
WITH {MODEL}, n AS (SELECT 'current' AS scenario, ma AS a, mb AS b FROM m UNION ALL SELECT 'bulk', 45, mb FROM m
  UNION ALL SELECT 'sale', ma, 0.1 FROM m UNION ALL SELECT 'both', 45, 0.1 FROM m)
SELECT scenario, {R("a", 6)} AS l_quantity, {R("b", 6)} AS l_discount, {R("c0 + ca * a + cb * b", 2)} AS prediction,
  {R("c0 + ca * a + cb * b - 1.96 * rs", 2)} AS lower, {R("c0 + ca * a + cb * b + 1.96 * rs", 2)} AS upper,
  {R("ca * (a - ma) + cb * (b - mb)", 2)} AS difference FROM n, m""")
def scenario_compare(spark, d):
    model = fitted(spark, d)
    named = {"bulk": {"l_quantity": 45}, "sale": {"l_discount": 0.1}, "both": {"l_quantity": 45, "l_discount": 0.1}}
    return rounded(whatif.scenario_compare(model, whatif.scenarios(model, named)), 6, prediction=2, lower=2, upper=2, difference=2)


GRID = f"""{MODEL}, f AS (SELECT 'l_quantity' AS feature, alo AS lo, ahi AS hi, ma AS mean FROM m
  UNION ALL SELECT 'l_discount', blo, bhi, mb FROM m),
w AS (SELECT *, CASE WHEN step < 0.001 THEN 0.001 WHEN step < 0.01 THEN round(step, 4) WHEN step < 1 THEN round(step, 2) ELSE round(step, 1) END AS width
  FROM (SELECT *, CASE WHEN hi = lo THEN 0.01 ELSE (hi - lo) / 100 END AS step FROM f)),
g AS (SELECT feature, lo, width, mean, unnest(generate_series(0, CAST(floor((hi - lo) / width + 1e-9) AS BIGINT))) AS step FROM w)"""


@query("scenario_grid", f"""
WITH {GRID} SELECT feature, step, {R("lo + step * width", 6)} AS value, {R("mean", 6)} AS mean FROM g""")
def scenario_grid(spark, d):
    return rounded(whatif.scenario_grid(fitted(spark, d).feature_table()), 6)


@query("scenario_sweep", f"""
WITH {GRID}, x AS (SELECT feature || '=' || step AS scenario, CASE WHEN feature = 'l_quantity' THEN lo + step * width ELSE ma END AS a,
  CASE WHEN feature = 'l_discount' THEN lo + step * width ELSE mb END AS b, c0, ca, cb FROM g, m)
SELECT scenario, {R("a", 6)} AS l_quantity, {R("b", 6)} AS l_discount, {R("c0 + ca * a + cb * b", 2)} AS prediction FROM x""")
def scenario_sweep(spark, d):
    model = fitted(spark, d)
    return rounded(whatif.predict(model, whatif.scenario_sweep(model)).drop("lower", "upper"), 6, prediction=2)


@query("sensitivity", f"""
WITH {MODEL} SELECT 'l_quantity' AS feature, {R("ca")} AS coefficient, {R("abs(ca * (ahi - alo))", 2)} AS impact FROM m
UNION ALL SELECT 'l_discount', {R("cb")}, {R("abs(cb * (bhi - blo))", 2)} FROM m""")
def sensitivity(spark, d):
    return rounded(whatif.sensitivity(fitted(spark, d).feature_table()), impact=2)


@query("optimize", " UNION ALL ".join(f"""
(WITH {MODEL} SELECT '{way}' AS direction, {R("c0 + " + best + "(ca * alo, ca * ahi) + " + best + "(cb * blo, cb * bhi)", 2)} AS prediction FROM m)"""
    for way, best in (("max", "greatest"), ("min", "least"))))
def optimize(spark, d):
    model = fitted(spark, d)
    features = model.feature_table()
    best = [
        whatif.optimize(features, model.summary(), way).select(F.lit(way).alias("direction"), digits("prediction", 2))
        for way in ("max", "min")
    ]
    return best[0].unionByName(best[1])


@query("optimize_many_models", f"""
WITH s AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS c, regr_intercept(l_extendedprice, l_quantity) AS c0,
  quantile_cont(l_quantity, 0.01) AS lo, quantile_cont(l_quantity, 0.99) AS hi FROM lineitem GROUP BY ALL)
SELECT l_returnflag, {R("c0 + greatest(c * lo, c * hi)", 2)} AS prediction FROM s""")
def optimize_many_models(spark, d):
    """One single-feature model per return flag, all optimised at once."""
    from loupe.quantiles import group_quantiles

    lines = table(spark, d, "lineitem")
    fits = lines.groupBy("l_returnflag").agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("coefficient"),
        F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept"),
        F.avg("l_quantity").alias("mean"),
    )
    bounds = group_quantiles(lines, ["l_returnflag"], "l_quantity", [0.01, 0.99], ["min", "max"])
    features = fits.join(bounds, "l_returnflag").withColumn("feature", F.lit("l_quantity"))
    best = whatif.optimize(features, fits.select("l_returnflag", "intercept"), "max", by=["l_returnflag"])
    return best.select("l_returnflag", digits("prediction", 2))
