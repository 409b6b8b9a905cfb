"""Relations between columns: correlation, contingency, group comparison."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loupe.frames import attach_row, col, known_value, number, pick_numeric, require
from loupe.functions.tails import chi2_p, f_p, t_p
from loupe.moments import moments, moments_by
from loupe.operators.profiling import is_missing
from loupe.ordered import POSITION, Sort, with_position, with_running_sum
from loupe.quantiles import group_quantiles
from loupe.session import durable

#: distinct values of a column up to which its ranks, 16 bytes each, are broadcast
BROADCAST_RANKS = 100_000


def column_ranks(values: DataFrame) -> tuple[DataFrame, int]:
    """(rows with each value replaced by its average rank in its column, number of rows).

    The values are numbers without NULLs.  All columns are counted and ranked in
    one sorted run over (column, value, n): every column has as many rows, so
    its ranks start where the running sum has passed that many times its
    number.  Columns of few values look their ranks up in a broadcast table of
    that checked size; several others are looked up as (row, column, value) in one
    join, and put together by row.  Written are the rows, the sorted run and, for
    more than two columns, the ranks.
    """
    names = values.columns
    rows = durable(values.withColumn("_row", F.monotonically_increasing_id()))
    n = rows.count()

    def long(columns: Sequence[int], *more: str) -> DataFrame:
        entries = [F.struct(F.lit(k).alias("_column"), col(names[k]).alias("_value")) for k in columns]
        return rows.select(*more, F.inline(F.array(*entries)))

    counted = long(range(len(names))).groupBy("_column", "_value").agg(F.count("*").alias("_n"))
    ranked = with_running_sum(counted, "_n", ["_column", "_value"])
    rank = F.col("_running") - F.col("_column") * F.lit(n) - (F.col("_n") - 1) / 2
    ranks = ranked.select("_column", "_value", rank.alias("_rank"))
    sizes = {r["_column"]: r["count"] for r in ranks.groupBy("_column").count().collect()}  # a row a column
    if len(names) > 2:
        ranks = durable(ranks)
    few = [k for k in range(len(names)) if sizes.get(k, 0) <= BROADCAST_RANKS]
    many = [k for k in range(len(names)) if k not in few]
    found = rows
    for k in few + many * (len(many) == 1):
        own = ranks.where(F.col("_column") == k).select(F.col("_value").alias(names[k]), F.col("_rank").alias(f"_r{k}"))
        found = found.join(F.broadcast(own) if k in few else own, names[k])
    if len(many) > 1:
        looked_up = long(many, "_row").join(ranks.where(F.col("_column").isin(many)), ["_column", "_value"])
        by_row = looked_up.groupBy("_row").agg(*[F.max(F.when(F.col("_column") == k, F.col("_rank"))).alias(f"_r{k}") for k in many])
        found = found.join(by_row, "_row") if few else by_row
    return found.select(*[F.col(f"_r{k}").alias(c) for k, c in enumerate(names)]), n


def rank_correlations(values: DataFrame) -> np.ndarray:
    """Spearman's r of all pairs of columns; NaN where a column does not vary."""
    ranks, n = column_ranks(values)
    middle = [(n + 1) / 2] * len(values.columns)
    found = moments_by(ranks, ranks.columns, centre=middle).get(0) if n else None
    return found.correlation() if found else np.full((len(middle), len(middle)), np.nan)


def average_ranks(counted: DataFrame, value: str, n: str) -> DataFrame:
    """(value, rank) from (value, n): ties share the mean of their places."""
    totals = counted.groupBy(col(value).alias(value)).agg(F.sum(n).alias("_t"))
    ranked = with_running_sum(totals, "_t", [value])
    return ranked.select(col(value), (F.col("_running") - (F.col("_t") - 1) / 2).alias("rank"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    require(df, x, y)
    both = df.select(number(x).alias("x"), number(y).alias("y"))
    return both.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _fit(x: str | Column, y: str | Column) -> list[Column]:
    """Least-squares sums of y on x."""
    return [
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
    ]


def correlate(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """One row: r, its two-sided p and strength, and the line y = slope * x + intercept.

    Fewer than 5 pairs give no row.
    """
    pairs = _pairs(df, x, y)
    if method == "pearson":
        row = pairs.agg(F.count("*").alias("n"), F.corr("x", "y").alias("_r"), *_fit("x", "y"))
    elif method == "spearman":
        r = float(rank_correlations(pairs)[0, 1])
        row = pairs.agg(F.count("*").alias("n"), *_fit("x", "y")).withColumn("_r", F.lit(r))
    else:
        raise ValueError("method is 'pearson' or 'spearman'")
    r, n = F.col("r"), F.col("n")
    clipped = F.greatest(F.least(F.col("_r"), F.lit(1.0)), F.lit(-1.0))
    rest = F.greatest(1 - r * r, F.lit(0.0))
    t = F.when(rest > 0, r * F.sqrt((n - 2) / F.nullif(rest, F.lit(0.0)))).otherwise(F.lit(float("inf")))
    residual = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    return (
        row.where(n >= 5)
        .withColumn("r", F.when(~F.isnan("_r"), clipped))
        .withColumn("p_value", t_p(F.when(r.isNotNull(), t), n - 2))
        .select(
            F.lit(method).alias("method"), "n", "r", (r * r).alias("r_squared"), "p_value",
            (F.col("p_value") < 0.05).alias("significant"), "slope", "intercept",
            F.sqrt(F.try_divide(residual / (n - 2), F.col("_sxx"))).alias("slope_se"),
            F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.4, "medium").otherwise("weak").alias("strength"),
            F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        )
    )


def trend_line(df: DataFrame, x: str, y: str, points: int = 50) -> DataFrame:
    """(x, y): the fitted line at evenly spaced points."""
    row = _pairs(df, x, y).agg(F.min("x").alias("low"), F.max("x").alias("high"), *_fit("x", "y"))
    spread = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.col("low") + F.col("i") * (F.col("high") - F.col("low")) / (points - 1)
    return spread.select(at.alias("x"), (F.col("slope") * at + F.col("intercept")).alias("y"))


def scatter_points(df: DataFrame, x: str, y: str, order_by: Sort = (), limit: int | None = None) -> DataFrame:
    """The complete pairs, for a chart; ``limit`` takes as many at even places of the given order."""
    require(df, x, y)
    known = df.where(number(x).isNotNull() & number(y).isNotNull())
    if limit is not None:
        rows = known.count()
        placed = with_position(known, order_by)
        part = lambda at: F.floor(at * F.lit(limit) / F.lit(max(1, rows)))
        known = placed.where(part(F.col(POSITION) + 1) > part(F.col(POSITION))) if rows > limit else known
    return known.select(number(x).alias("x"), number(y).alias("y"))


# ------------------------------------------------------------------ contingency


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    require(df, x, y)
    return df.na.drop(subset=[x, y]).groupBy(col(x).alias("x"), col(y).alias("y")).agg(F.count("*").alias("count"))


def cross_tabulate(df: DataFrame, x: str, y: str, dense: bool = False, max_levels: int = 1000) -> DataFrame:
    """(x, y, count) of the cells that occur.

    ``dense`` adds the empty ones: the levels of y are listed for every level
    of x, so then more than ``max_levels`` are refused.
    """
    cells = _cells(df, x, y)
    if not dense:
        return cells
    levels = cells.groupBy("y").agg(F.lit(1).alias("_one"))
    if len(levels.limit(max_levels + 1).select("_one").collect()) > max_levels:
        raise ValueError(f"{y!r} has more than {max_levels} levels; use dense=False, where absent cells are 0")
    every = levels.agg(F.collect_list("y").alias("_ys"))
    grid = attach_row(cells.select("x").distinct(), every).select("x", F.explode("_ys").alias("y"))
    return grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("count", F.lit(0)).alias("count"))


def cross_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: chi-squared (with Yates' correction for 2 x 2), dof, p, Cramer's V.

    Empty cells add their expected counts, which is what is missing from the
    sum of expected counts over the cells that occur; none are generated.
    """
    cells = _cells(df, x, y)
    rows = cells.groupBy("x").agg(F.sum("count").cast("double").alias("_r"))
    columns = cells.groupBy("y").agg(F.sum("count").cast("double").alias("_c"))
    size = cells.agg(F.sum("count").cast("double").alias("n"))
    margins = attach_row(
        rows.agg(F.count("*").alias("nx"), F.sum(1 / F.col("_r")).alias("_rx")),
        columns.agg(F.count("*").alias("ny"), F.sum(1 / F.col("_c")).alias("_cy")),
    )
    expected = F.col("_r") * F.col("_c") / F.col("n")
    off = F.col("count") - expected
    sums = (
        attach_row(cells.join(rows, "x").join(columns, "y"), size)
        .agg(
            F.max("n").alias("n"),
            (F.sum(off * off / expected) + F.max("n") - F.sum(expected)).alias("plain"),
            F.max(F.abs(off)).alias("off"),
        )
        .where(F.col("n").isNotNull())
    )
    # in a 2 x 2 table every cell is off by the same amount
    closer = F.greatest(F.col("off") - 0.5, F.lit(0.0))
    yates = closer * closer * F.col("n") * F.col("_rx") * F.col("_cy")
    dof = (F.col("nx") - 1) * (F.col("ny") - 1)
    least = F.least("nx", "ny") - 1
    result = attach_row(sums, margins).select(
        F.when(dof == 0, 0.0).when(dof == 1, yates).otherwise(F.greatest("plain", F.lit(0.0))).alias("chi2"),
        dof.alias("dof"), F.col("n"), least.alias("_least"),
    )
    return result.select(
        "chi2", "dof", F.when(F.col("dof") == 0, 1.0).otherwise(chi2_p(F.col("chi2"), F.greatest("dof", F.lit(1)))).alias("p_value"),
        F.coalesce(F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * F.col("_least"))), F.lit(0.0)).alias("cramers_v"),
    ).withColumn("significant", F.col("p_value") < 0.05)


# ------------------------------------------------------------------ groups


def _groups(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """(g, n, mean, ss) of the groups with enough values."""
    require(df, group, value)
    v = number(value)
    return (
        df.select(known_value(df, group).alias("g"), v.alias("_v")).where(F.col("g").isNotNull()).groupBy("g")
        .agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), (F.var_pop("_v") * F.count("_v")).alias("ss"))
        .where(F.col("n") >= least)
    )


def group_boxplot(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, min, q1, median, q3, max, mean, std, count) of groups with 3 values or more; std divides by n."""
    require(df, group, value)
    known = df.select(known_value(df, group).alias("group"), number(value).alias("v")).where(F.col("group").isNotNull())
    stats = known.groupBy("group").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"), F.count("v").alias("count"),
    ).where(F.col("count") >= 3)
    quartiles = group_quantiles(known, ["group"], "v", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return stats.join(quartiles, "group").select("group", "min", "q1", "median", "q3", "max", "mean", "std", "count")


def _between(groups: DataFrame) -> DataFrame:
    """One row: k groups, N values, sums of squares between and within."""
    size = groups.agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("total_n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"),
    )
    off = F.col("mean") - F.col("_grand")
    return attach_row(groups, size).groupBy("n_groups", "total_n").agg(
        F.sum(F.col("n") * off * off).alias("ssb"), F.sum("ss").alias("ssw")
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (test, statistic, p_value): one-way analysis of variance."""
    row = _between(_groups(df, group, value))
    d1, d2 = F.col("n_groups") - 1, F.col("total_n") - F.col("n_groups")
    f = F.try_divide(F.col("ssb") / d1, F.col("ssw") / d2)
    return row.select(F.lit("ANOVA").alias("test"), f.alias("statistic"), f_p(f, d1, d2).alias("p_value"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (test, statistic, p_value): H with the tie correction.

    H is (N - 1) times the share of the ranks' spread that lies between groups.
    """
    kept = _groups(df, group, value).select("g")
    values = df.select(col(group).alias("g"), number(value).alias("v")).where(F.col("v").isNotNull())
    counted = durable(values.join(kept, "g", "left_semi").groupBy("g", "v").agg(F.count("*").alias("_n")))
    ranked = counted.join(average_ranks(counted, "v", "_n"), "v")
    size = counted.agg(F.sum("_n").alias("_size"))
    off = F.col("rank") - (F.col("_size") + 1) / 2
    by_group = attach_row(ranked, size).groupBy("g", "_size").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * off).alias("s"), F.sum(F.col("_n") * off * off).alias("ss")
    )
    h = by_group.agg(
        F.count("*").alias("k"),
        F.try_divide((F.max("_size") - 1) * F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum("ss")).alias("statistic"),
    )
    return h.select(
        F.lit("Kruskal-Wallis").alias("test"), "statistic", chi2_p(F.col("statistic"), F.col("k") - 1).alias("p_value")
    )


def compare_groups(df: DataFrame, group: str, value: str, test: str = "anova") -> DataFrame:
    """One row: a test of the groups' difference, and eta squared.

    ``test`` is anova or kruskal, whatever the groups' sizes.  Groups need 3
    values; with fewer than 2 groups there is no row.
    """
    if test not in ("anova", "kruskal"):
        raise ValueError("test is 'anova' or 'kruskal'")
    groups = _groups(df, group, value)
    k = groups.count()
    chosen = anova if test == "anova" else kruskal_wallis
    sums = _between(groups).where(F.col("n_groups") >= 2)
    eta = F.coalesce(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0))
    if k < 2:
        return sums.select(
            F.lit("").alias("test"), F.lit(0.0).alias("statistic"), F.lit(0.0).alias("p_value"),
            F.lit(False).alias("significant"), eta.alias("eta_squared"), "n_groups", "total_n",
        )
    return attach_row(sums, chosen(df, group, value)).select(
        "test", "statistic", "p_value", (F.col("p_value") < 0.05).alias("significant"),
        eta.alias("eta_squared"), "n_groups", "total_n",
    )


def compare_pairs(df: DataFrame, group: str, value: str, max_groups: int | None = None) -> DataFrame:
    """(group_a, group_b, diff, statistic, p_value, p_bonferroni, significant): t-tests of all pairs.

    The t-test pools the variances of the two groups and its p is not
    corrected; the Bonferroni column is.  With ``max_groups``, more groups are
    refused.
    """
    groups = _groups(df, group, value).withColumn("g", F.col("g").cast("string"))
    k = groups.count()
    if max_groups is not None and k > max_groups:
        raise ValueError(f"{k} groups are too many to compare in pairs (at most {max_groups})")
    a, b = groups.alias("a"), groups.alias("b")  # one row a group
    pairs = a.join(b, F.col("a.g") < F.col("b.g"))
    diff = F.col("a.mean") - F.col("b.mean")
    dof = F.col("a.n") + F.col("b.n") - 2
    pooled = (F.col("a.ss") + F.col("b.ss")) / dof
    t = F.try_divide(diff, F.sqrt(pooled * (1 / F.col("a.n") + 1 / F.col("b.n"))))
    tested = pairs.select(
        F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), diff.alias("diff"), t.alias("statistic"), dof.alias("_dof")
    ).withColumn("p_value", t_p(F.col("statistic"), F.col("_dof")))
    return tested.drop("_dof").withColumns(
        {
            "p_bonferroni": F.least(F.col("p_value") * F.lit(max(1, k * (k - 1) // 2)), F.lit(1.0)),
            "significant": F.col("p_value") < 0.05,
        }
    ).orderBy(F.abs("diff").desc(), "group_a", "group_b")


# ------------------------------------------------------------------ matrices


def _matrix_rows(df: DataFrame, names: Sequence[str], matrix: np.ndarray) -> DataFrame:
    """(a, b, r) for every cell; NULL where a column does not vary."""
    rows = [
        (a, b, None if np.isnan(matrix[i, j]) else float(matrix[i, j]))
        for i, a in enumerate(names) for j, b in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def _complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with every column known, as c0, c1, ..."""
    return df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(names)]).na.drop()


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", max_columns: int | None = None
) -> DataFrame:
    """(a, b, r) over the rows with all columns known; ``max_columns`` takes the first ones only."""
    names = pick_numeric(df, columns)[:max_columns]
    if len(names) < 2:
        raise ValueError("a correlation matrix needs two numeric columns")
    if method not in ("pearson", "spearman"):
        raise ValueError("method is 'pearson' or 'spearman'")
    values = _complete(df, names)
    if method == "spearman":
        matrix = rank_correlations(values)
    else:
        found = moments(values, [f"c{i}" for i in range(len(names))])
        matrix = found.correlation() if found else np.full((len(names), len(names)), np.nan)
    return _matrix_rows(df, names, matrix)


def correlation_pairs(matrix: DataFrame, top: int | None = None) -> DataFrame:
    """Each pair once, strongest first."""
    pairs = matrix.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r"
    ).dropDuplicates(["a", "b"]).orderBy(F.abs("r").desc_nulls_last(), "a", "b")
    return pairs if top is None else pairs.limit(top)


def related(df: DataFrame, columns: Sequence[str] | None = None, r: float = 0.3, p: float = 0.05) -> DataFrame:
    """(a, b, r, p_value) of the column pairs with |r| > 0.3 and p < 0.05."""
    names = pick_numeric(df, columns)
    n = _complete(df, names).count()
    pairs = correlation_pairs(correlation_matrix(df, names)).where(F.abs("r") > r)
    rest = F.nullif(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0)), F.lit(0.0))
    t = F.coalesce(F.col("r") * F.sqrt(F.lit(float(n - 2)) / rest), F.lit(float("inf")))
    return pairs.withColumn("p_value", t_p(t, F.lit(float(n - 2)))).where(F.col("p_value") < p)


def missing_correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r): how the gaps of the columns that have some go together."""
    names = list(columns or df.columns)
    require(df, *names)
    counted = df.agg(*[F.count_if(is_missing(df, c)) for c in names]).first()
    partly = [c for c, n in zip(names, counted) if n > 0]
    if len(partly) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    flags = df.select(*[is_missing(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(partly)])
    return _matrix_rows(df, partly, moments(flags, flags.columns).correlation())
