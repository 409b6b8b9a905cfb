"""Distributions of one column, filtered aggregates, segments and anomalies."""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loupe.frames import attach_row, col, known_value, number, numeric_columns, require, share, single
from loupe.functions.normal import normal_cdf, normal_ppf
from loupe.functions.tails import kolmogorov_p
from loupe.operators.cleaning import iqr_fences
from loupe.operators.prepare import comparison
from loupe.operators.profiling import semantic_types, top_values, value_counts
from loupe.ordered import POSITION, Sort, at_steps, sort_columns, with_position, with_running_sum
from loupe.quantiles import column_quantiles


# ------------------------------------------------------------------ shapes


def _edges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Lowest and highest histogram edge of each column with at least 5 values."""
    row = df.agg(*[f(number(c)) for c in columns for f in (F.count, F.min, F.max)]).first() if columns else []
    edges = {}
    for i, c in enumerate(columns):
        n, low, high = row[3 * i : 3 * i + 3]
        if n >= 5:
            edges[c] = (low, high) if low < high else (low - 0.5, high + 0.5)
    return edges


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """(column, bin, left, right, count) with equal-width bins, empty ones included.

    The last bin includes its right edge.  Columns with fewer than 5 values
    are left out.
    """
    require(df, *columns)
    edges = _edges(df, columns)
    spark = df.sparkSession
    if not edges:
        return spark.createDataFrame([], "column string, bin long, left double, right double, count long")
    # Two projections, so that the guess is computed once per value.
    guesses, places = [], []
    for i, (c, (low, high)) in enumerate(edges.items()):
        v = number(c)
        # least() skips NULL, so a missing value must not reach it
        guess = F.when(v.isNotNull(), F.least(F.floor((v - low) * (bins / (high - low))), F.lit(bins - 1)))
        guesses += [v.alias(f"v{i}"), guess.alias(f"g{i}")]
        v, guess, step = F.col(f"v{i}"), F.col(f"g{i}"), (high - low) / bins
        # rounding may put a value that lies on an edge one bin off
        right = F.when(guess == bins - 1, high).otherwise((guess + 1) * step + low)
        place = F.when(v < guess * step + low, guess - 1).when((v >= right) & (guess < bins - 1), guess + 1).otherwise(guess)
        places.append(F.struct(F.lit(c).alias("column"), place.alias("bin")))
    counted = (
        df.select(*guesses)
        .select(F.inline(F.array(*places)))
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count("*").alias("count"))
    )
    spans = [F.struct(F.lit(c).alias("column"), F.lit(a).alias("low"), F.lit(b).alias("high")) for c, (a, b) in edges.items()]
    grid = spark.range(1).select(F.inline(F.array(*spans))).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")
    )
    step = (F.col("high") - F.col("low")) / bins
    # columns * bins rows
    return grid.join(F.broadcast(counted), ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("bin") * step + F.col("low")).alias("left"),
        F.when(F.col("bin") == bins - 1, F.col("high")).otherwise((F.col("bin") + 1) * step + F.col("low")).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    return histograms(df, [column], bins).drop("column")


def sparklines(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """One row per numeric column with its 20 bin counts as an array."""
    names = numeric_columns(df) if columns is None else columns
    return histograms(df, names, bins).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "count"))), lambda s: s["count"]).alias("counts")
    )


#: grid points up to this many bandwidths apart are reached by factors, which can't overflow then
_FACTORS = 8


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """(x, density): Gaussian kernel estimate with Scott's bandwidth.

    Each task adds up the kernels of its own values at every grid point and
    passes on one row per point.  From one grid point to the next, a value's
    kernel changes by a factor of its own, so there are two exponentials a
    value; further away than ``reach`` points it is 0 in double precision.
    """
    values = single(df, column)
    n, std, low, high = values.agg(F.count("v"), F.stddev("v"), F.min("v"), F.max("v")).first()
    if n < 5 or not std:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = std * n ** (-1 / 5)
    grid = np.linspace(low, high, points)
    apart = (high - low) / (points - 1) / width
    reach = min(points - 1, int(39 / apart) + 1) if 0 < apart <= _FACTORS else None

    def kernels(batches):
        total = np.zeros(points)
        for batch in batches:
            v = batch["v"].to_numpy()
            if reach is None:
                z = (grid[:, None] - v[None, :]) / width
                total += np.exp(-0.5 * z * z).sum(axis=1)
                continue
            near = np.clip(np.rint((v - low) / width / apart), 0, points - 1).astype(np.int64)
            z = (v - grid[near]) / width
            for side in (1, -1):
                part, factor = np.exp(-0.5 * z * z), np.exp(side * apart * z)
                for i in range(reach + 1):
                    if i or side > 0:  # the nearest point itself counts once
                        sums = np.bincount(near, weights=part, minlength=points) * math.exp(-0.5 * (i * apart) ** 2)
                        if side > 0:
                            total[i:] += sums[: points - i]
                        else:
                            total[: points - i] += sums[i:]
                    part = part * factor
        yield pd.DataFrame({"i": np.arange(points), "total": total})

    summed = values.mapInPandas(kernels, "i int, total double").groupBy("i").agg(F.sum("total").alias("total"))
    step = (high - low) / (points - 1)
    return summed.orderBy("i").select(
        F.when(F.col("i") == points - 1, F.lit(high)).otherwise(F.col("i") * F.lit(step) + F.lit(low)).alias("x"),
        (F.col("total") / F.lit(n * width * math.sqrt(2 * math.pi))).alias("density"),
    )


# ------------------------------------------------------------------ moments


def sample_skewness(v: Column) -> Column:
    """Bias-corrected skewness; 0 without spread, NULL below 3 values."""
    n = F.count(v)
    g = F.nanvl(F.skewness(v), F.lit(None).cast("double"))
    return F.when(n >= 3, F.when(F.min(v) == F.max(v), 0.0).otherwise(g * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0))))


def sample_kurtosis(v: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 without spread, NULL below 4 values."""
    n = F.count(v)
    g = F.nanvl(F.kurtosis(v), F.lit(None).cast("double"))
    corrected = F.try_divide(n - 1.0, (n - 2.0) * (n - 3.0)) * ((n + 1) * g + 6)
    return F.when(n >= 4, F.when(F.min(v) == F.max(v), 0.0).otherwise(corrected))


_SUMMARY = ["count", "mean", "std", "min", "max", "skewness", "kurtosis"]


def _summary(v: Column, suffix: str) -> list[Column]:
    columns = [F.count(v), F.avg(v), F.stddev(v), F.min(v), F.max(v), sample_skewness(v), sample_kurtosis(v)]
    return [c.alias(f"{n}_{suffix}") for n, c in zip(_SUMMARY, columns)]


def eda_exploratory(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, std, quartiles, skewness, kurtosis."""
    names = list(numeric_columns(df) if columns is None else columns)
    if not names:
        kinds = {"column": "string", "count": "long"} | dict.fromkeys([*_SUMMARY[1:], "q25", "q50", "q75"], "double")
        return df.sparkSession.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in kinds.items()))
    quartiles = column_quantiles(df, names, [0.25, 0.5, 0.75])
    # a few columns per pass: Spark compiles an aggregate of up to 100 buffers
    parts = [names[i : i + 4] for i in range(0, len(names), 4)]
    return reduce(DataFrame.unionByName, [_explored(df, part, quartiles) for part in parts])


def _explored(df: DataFrame, names: Sequence[str], quartiles: dict[str, list[float | None]]) -> DataFrame:
    wide = df.agg(*[e for i, c in enumerate(names) for e in _summary(number(c), str(i))])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{n}_{i}").alias(n) for n in _SUMMARY],
            *[F.lit(q).cast("double").alias(name) for name, q in zip(("q25", "q50", "q75"), quartiles[c])],
        )
        for i, c in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _chosen(test: str) -> Callable[[DataFrame, str], DataFrame]:
    named = {"shapiro": shapiro_wilk, "ks": kolmogorov_smirnov, "k2": dagostino_pearson}
    if test not in named:
        raise ValueError(f"unknown test {test!r}; use one of {sorted(named)}")
    return named[test]


def describe_distribution(df: DataFrame, column: str, test: str = "ks") -> DataFrame:
    """One row: summary, quartiles, iqr and a normality test.

    ``test`` is shapiro, ks or k2, whatever the number of values; by default
    Kolmogorov-Smirnov against the fitted normal (its p is too large, as mean
    and std come from the same data).  Fewer than 5 values give no row.
    """
    values = single(df, column)
    summary = eda_exploratory(values, ["v"]).drop("column").withColumn("iqr", F.col("q75") - F.col("q25"))
    n = values.count()
    if n < 5:
        return summary.where(F.lit(False))
    tested = _chosen(test)(df, column)
    return attach_row(
        summary,
        tested.select(
            F.col("test").alias("normality_test"),
            F.col("statistic").alias("normality_stat"),
            F.col("p_value").alias("normality_p"),
        ),
    )


# ------------------------------------------------------------------ normality


def kolmogorov_smirnov(df: DataFrame, column: str) -> DataFrame:
    """One row (test, statistic, p_value) against the normal with the data's mean and std."""
    values = single(df, column)
    n, mean, std = values.agg(F.count("v"), F.avg("v"), F.stddev("v")).first()
    counted = values.groupBy("v").agg(F.count("*").alias("_n"))
    ranked = with_running_sum(counted, "_n", ["v"])
    fitted = normal_cdf(F.try_divide(F.col("v") - F.lit(mean), F.lit(std)))
    below = fitted - (F.col("_running") - F.col("_n")) / F.lit(float(n))
    above = F.col("_running") / F.lit(float(n)) - fitted
    return ranked.agg(F.max(F.greatest(below, above)).alias("statistic")).select(
        F.lit("Kolmogorov-Smirnov").alias("test"), "statistic", kolmogorov_p(F.col("statistic"), F.lit(float(n))).alias("p_value")
    )


# Royston's polynomials for the Shapiro-Wilk weights and p-value,
# lowest power first.
_ROYSTON_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_ROYSTON_SECOND = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_ROYSTON_SMALL_BOUND = [-2.273, 0.459]
_ROYSTON_SMALL_MEAN = [0.5440, -0.39978, 0.025054, -6.714e-4]
_ROYSTON_SMALL_STD = [1.3822, -0.77857, 0.062767, -0.0020322]
_ROYSTON_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
_ROYSTON_STD = [-0.4803, -0.082676, 0.0030302]


def _polynomial(coefficients: Sequence[float], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def shapiro_wilk(df: DataFrame, column: str) -> DataFrame:
    """One row (test, statistic, p_value); for 4 values or more.

    Royston checked the p-value's polynomials up to 5000 values; beyond, they
    are carried on.
    """
    values = single(df, column)
    n = values.count()
    if n < 4:
        raise ValueError(f"Shapiro-Wilk needs 4 values, there are {n}")
    score = lambda i: statistics.NormalDist().inv_cdf((i - 0.375) / (n + 0.25))
    if n <= 5000:
        total = sum(score(i) ** 2 for i in range(1, n + 1))
    else:
        m = normal_ppf((F.col("id") - 0.375) / F.lit(n + 0.25))
        total = df.sparkSession.range(1, n + 1).agg(F.sum(m * m)).first()[0]
    root = 1 / math.sqrt(n)
    outer, given = [score(n) / math.sqrt(total) + _polynomial(_ROYSTON_LAST, root)], score(n) ** 2
    if n > 5:
        outer.append(score(n - 1) / math.sqrt(total) + _polynomial(_ROYSTON_SECOND, root))
        given += score(n - 1) ** 2
    scale = math.sqrt((total - 2 * given) / (1 - 2 * sum(a * a for a in outer)))

    place = F.col(POSITION) + 1
    weight = normal_ppf((place - 0.375) / F.lit(n + 0.25)) / F.lit(scale)
    for k, a in enumerate(outer):
        weight = F.when(place == n - k, F.lit(a)).when(place == k + 1, F.lit(-a)).otherwise(weight)
    sums = with_position(values, ["v"]).agg(
        F.sum(weight * F.col("v")).alias("slope"), (F.var_pop("v") * n).alias("spread")
    )
    w = F.least(F.try_divide(F.col("slope") * F.col("slope"), F.col("spread")), F.lit(1.0))
    miss = F.log(F.greatest(1 - F.col("statistic"), F.lit(1e-300)))
    if n <= 11:
        bound = _polynomial(_ROYSTON_SMALL_BOUND, n)
        z = (-F.log(F.greatest(F.lit(bound) - miss, F.lit(1e-300))) - _polynomial(_ROYSTON_SMALL_MEAN, n)) / math.exp(
            _polynomial(_ROYSTON_SMALL_STD, n)
        )
    else:
        z = (miss - _polynomial(_ROYSTON_MEAN, math.log(n))) / math.exp(_polynomial(_ROYSTON_STD, math.log(n)))
    return sums.select(F.lit("Shapiro-Wilk").alias("test"), w.alias("statistic")).withColumn("p_value", normal_cdf(-z))


def dagostino_pearson(df: DataFrame, column: str) -> DataFrame:
    """One row (test, statistic, p_value): K2 of skewness and kurtosis, from moments alone.

    D'Agostino's transformed skewness and Anscombe and Glynn's transformed
    kurtosis; K2 is chi-squared with two degrees of freedom, whose tail is exp(-K2/2).
    """
    row = single(df, column).agg(
        F.count("v").cast("double").alias("n"), F.skewness("v").alias("g1"), (F.kurtosis("v") + 3).alias("b2")
    )
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(0.5 * F.log(w2))
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - expected) / F.sqrt(variance)
    beta1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta1 * (2 / beta1 + F.sqrt(1 + 4 / (beta1 * beta1)))
    lower = 1 + x * F.sqrt(2 / (a - 4))
    z_kurt = (1 - 2 / (9 * a) - F.signum(lower) * F.pow((1 - 2 / a) / F.abs(lower), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = row.select((z_skew * z_skew + z_kurt * z_kurt).alias("statistic"))
    return k2.select(F.lit("D'Agostino-Pearson").alias("test"), "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"))


def test_normality(df: DataFrame, column: str, test: str = "k2") -> DataFrame:
    """One row: a normality test with skewness and kurtosis.

    ``test`` is shapiro, ks or k2, whatever the number of values; by default
    K2.  Fewer than 8 values give no row.
    """
    values = single(df, column)
    n = values.count()
    shape = values.agg(sample_skewness(F.col("v")).alias("skewness"), sample_kurtosis(F.col("v")).alias("kurtosis"))
    if n < 8:
        empty = shape.where(F.lit(False))
        return empty.select(
            F.lit("").alias("test"), F.lit(0.0).alias("statistic"), F.lit(0.0).alias("p_value"),
            F.lit(False).alias("is_normal"), "skewness", "kurtosis",
        )
    result = _chosen(test)(df, column)
    return attach_row(result.withColumn("is_normal", F.col("p_value") > 0.05), shape)


def qq_points(df: DataFrame, column: str, points: int = 500, standard: bool = False) -> DataFrame:
    """(position, theoretical, sample): every (n // points)-th sorted value and its normal quantile.

    The quantile has the data's mean and std, or is standard normal.
    """
    values = single(df, column)
    n, mean, std = values.agg(F.count("v"), F.avg("v"), F.stddev("v")).first()
    kept = at_steps(values, "v", max(1, n // points))
    z = normal_ppf((F.col("position") + 0.5) / F.lit(float(max(n, 1))))
    theoretical = z if standard else F.lit(mean) + F.lit(std) * z
    return kept.select("position", theoretical.alias("theoretical"), F.col("value").alias("sample"))


# ------------------------------------------------------------------ categories


def _category_counts(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    known = df.select(known_value(df, column).alias("v")).where(F.col("v").isNotNull())
    return known.groupBy("v").agg(F.count("*").alias("count"))


def _head(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values, each task keeping n rows at most, with rank and running count."""
    top = counts.orderBy(F.desc("count"), F.asc("v")).limit(n)
    order = W.orderBy(F.desc("count"), F.asc("v"))  # over those n rows
    return top.select(
        F.row_number().over(order).alias("rank"),
        F.col("v").cast("string").alias("value"),
        "count",
        F.sum("count").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("running"),
    )


def describe_frequency(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """(rank, value, count, pct, cum_pct) of the most frequent values."""
    counts = _category_counts(df, column)
    total = counts.agg(F.sum("count").alias("total"))
    return attach_row(_head(counts, top_n), total).select(
        "rank", "value", "count", share(F.col("count"), F.col("total")).alias("pct"),
        share(F.col("running"), F.col("total")).alias("cum_pct"),
    )


def frequency_stats(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """One row: categories, the top one and its share, entropy and its maximum."""
    counts = _category_counts(df, column)
    total = counts.agg(F.sum("count").alias("total"), F.count("*").alias("total_categories"))
    p = F.col("count") / F.col("total")
    return attach_row(counts, total).groupBy("total", "total_categories").agg(
        F.sum(-p * F.log2(p + 1e-12)).alias("entropy"),
        F.min_by(F.col("v").cast("string"), F.struct(-F.col("count"), F.col("v"))).alias("top_category"),
        F.max("count").alias("top"),
    ).select(
        "total_categories",
        F.least("total_categories", F.lit(top_n)).alias("shown_categories"),
        "top_category",
        share(F.col("top"), F.col("total")).alias("top_pct"),
        "entropy",
        F.log2("total_categories").alias("max_entropy"),
    )


def analyze_composition(df: DataFrame, column: str, top_n: int = 10, other: str = "other") -> DataFrame:
    """(rank, label, count, pct): the top categories and the rest as one."""
    counts = _category_counts(df, column)
    total = counts.agg(F.sum("count").alias("total"))
    top = _head(counts, top_n)
    rest = attach_row(top.agg((F.max("rank") + 1).alias("rank"), F.sum("count").alias("shown")), total).select(
        "rank", F.lit(other).alias("label"), (F.col("total") - F.col("shown")).alias("count")
    ).where(F.col("count") > 0)
    parts = top.select("rank", F.col("value").alias("label"), "count").unionByName(rest)
    return attach_row(parts, total).select("rank", "label", "count", share(F.col("count"), F.col("total")).alias("pct"))


def composition_stats(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """One row: categories, HHI over the shown parts, shares of the top 1 and 3."""
    parts = analyze_composition(df, column, top_n)
    categories = _category_counts(df, column).agg(F.count("*").alias("total_categories"))
    hhi = F.sum(F.col("pct") * F.col("pct"))
    return attach_row(
        parts.agg(
            hhi.alias("hhi"),
            F.sum(F.when(F.col("rank") <= 1, F.col("pct"))).alias("top1_pct"),
            F.sum(F.when(F.col("rank") <= 3, F.col("pct"))).alias("top3_pct"),
        ),
        categories,
    ).select(
        "total_categories",
        "hhi",
        F.when(F.col("hhi") > 2500, "highly concentrated").when(F.col("hhi") > 1500, "moderately concentrated")
        .otherwise("dispersed").alias("concentration"),
        "top1_pct",
        "top3_pct",
    )


def eda_categorical(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 5, first: int | None = None) -> DataFrame:
    """(column, rank, value, count, pct): top values of the categorical columns, or the first of them.

    The share is of the values shown.
    """
    if columns is None:
        columns = [c for c, t in semantic_types(df).items() if t == "categorical"][:first]
    tops = top_values(value_counts(df, columns), top_n)
    whole = F.sum("n").over(W.partitionBy("column"))  # top_n rows per column
    return tops.select("column", "rank", "value", F.col("n").alias("count"), (F.col("n") * 100.0 / whole).alias("pct"))


# ------------------------------------------------------------------ outliers


def _outlier_test(df: DataFrame, column: str, method: str) -> tuple[Column, tuple]:
    """The condition as literals, so that it reaches the scan, and the fences."""
    if method not in ("iqr", "zscore", "both"):
        raise ValueError("method is 'iqr', 'zscore' or 'both'")
    v, test = col(column), F.lit(False)
    fences = iqr_fences(df, column)
    if method != "zscore" and fences[0] is not None:
        test |= (v < F.lit(fences[2])) | (v > F.lit(fences[3]))
    if method != "iqr":
        mean, std = df.agg(F.avg(number(column)), F.stddev(number(column))).first()
        if std is not None and std > 1e-10:
            # |v - mean| / std > 3, without rounding the bounds
            test |= F.abs(v - F.lit(mean)) / F.lit(std) > 3
    return test & number(column).isNotNull(), fences


def detect_outliers(df: DataFrame, column: str, method: str = "both") -> DataFrame:
    """The rows outside the IQR fences (iqr), beyond 3 std (zscore) or either (both)."""
    require(df, column)
    return df.where(_outlier_test(df, column, method)[0])


def outlier_summary(df: DataFrame, column: str, method: str = "both") -> DataFrame:
    """One row: box plot, fences and the number of outliers."""
    require(df, column)
    test, (q1, q3, low, high) = _outlier_test(df, column, method)
    median = column_quantiles(df, [column], [0.5])[column][0]
    v = number(column)
    constant = lambda x, name: F.lit(x).cast("double").alias(name)
    return df.agg(
        F.count(v).alias("total_count"), F.count_if(test).alias("outlier_count"), F.min(v).alias("min"), F.max(v).alias("max")
    ).select(
        "total_count", "outlier_count", share(F.col("outlier_count"), F.col("total_count")).alias("outlier_pct"),
        "min", constant(q1, "q1"), constant(median, "median"), constant(q3, "q3"), "max",
        constant(low, "lower_fence"), constant(high, "upper_fence"),
        constant(None if q1 is None else q3 - q1, "iqr"), F.lit(method).alias("method"),
    )


def _anomalies(df: DataFrame, column: str) -> tuple[Column, float, float]:
    _, _, low, high = iqr_fences(df, column)
    v = col(column)
    return (v < F.lit(low)) | (v > F.lit(high)), low, high


def anomaly_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: number and share of IQR outliers, and the thresholds."""
    require(df, column)
    test, low, high = _anomalies(df, column)
    v = number(column)
    return df.agg(F.count(v).alias("known"), F.count_if(test & v.isNotNull()).alias("anomaly_count")).select(
        "anomaly_count", share(F.col("anomaly_count"), F.col("known")).alias("anomaly_pct"),
        F.lit(low).cast("double").alias("threshold_lower"), F.lit(high).cast("double").alias("threshold_upper"),
    )


def anomaly_explain(
    df: DataFrame, column: str, date_col: str | None = None, context_cols: Sequence[str] = (),
    order_by: Sort = (), top_n: int = 5, reach: int = 2,
) -> DataFrame:
    """The outliers largest in absolute value, with context and neighbours.

    Columns: rank, value, the date and context columns, and ``neighbours``, an
    array of (offset, date, value) of the two rows before and after, the row
    itself included, in ``order_by`` (the date by default).  Without a date
    column there are no neighbours.
    """
    require(df, column, *context_cols, *([date_col] if date_col else []))
    known = df.select(number(column).alias("v")).where(F.col("v").isNotNull())
    shown = [date_col] if date_col else []
    shown += [c for c in context_cols if c not in shown and c != column]
    if len(known.take(5)) < 5:
        return df.where(F.lit(False)).select(F.lit(0).alias("rank"), number(column).alias("value"), *[col(c) for c in shown])
    test, _, _ = _anomalies(df, column)
    ties: list[Column] = list(_order(date_col, order_by))
    if date_col is None:
        top = df.where(test & number(column).isNotNull()).orderBy(F.abs(number(column)).desc(), *ties).limit(top_n)
        rank = F.row_number().over(W.orderBy(F.abs("value").desc(), *[col(c) for c in shown]))  # top_n rows
        return top.select(number(column).alias("value"), *[col(c) for c in shown]).select(rank.alias("rank"), "value", *[col(c) for c in shown])
    used = {c for c in [*shown, column, *[o for o in order_by if isinstance(o, str)]]}
    slim = df if any(not isinstance(o, str) for o in order_by) else df.select(*[col(c) for c in df.columns if c in used])
    placed = with_position(slim, ties)
    top = placed.where(test & number(column).isNotNull()).orderBy(F.abs(number(column)).desc(), POSITION).limit(top_n)
    ranked = top.select(
        F.row_number().over(W.orderBy(F.abs(number(column)).desc(), POSITION)).alias("rank"),  # top_n rows
        number(column).alias("value"),
        *[col(c) for c in shown],
        F.col(POSITION).alias("_at"),
    )
    places = ranked.select(
        F.col("rank").alias("_rank"),
        F.explode(F.sequence(F.col("_at") - reach, F.col("_at") + reach)).alias(POSITION),
        F.col("_at").alias("_centre"),
    )
    around = placed.select(POSITION, col(date_col).alias("date"), number(column).alias("value")).join(
        F.broadcast(places), POSITION  # top_n * (2 * reach + 1) rows
    )
    neighbours = around.groupBy("_rank").agg(
        F.array_sort(
            F.collect_list(F.struct((F.col(POSITION) - F.col("_centre")).alias("offset"), "date", "value"))
        ).alias("neighbours")
    )
    return ranked.join(F.broadcast(neighbours), F.col("rank") == F.col("_rank")).drop("_rank", "_at")


def _order(date_col: str | None, order_by: Sort):
    if order_by:
        return sort_columns(order_by)
    return [col(date_col)] if date_col else []


# ------------------------------------------------------------------ filters and segments


def filter_aggregate(
    df: DataFrame, column: str, operator: str, threshold: float, agg_column: str | None = None,
    group_by: str | None = None,
) -> DataFrame:
    """(label, value): per group the sum of ``agg_column`` or the number of rows that match.

    Without a group: how many rows match and how many do not.
    """
    test = comparison(df, column, operator, threshold)
    if group_by is not None and group_by in df.columns:
        value = F.sum(number(agg_column)) if agg_column else F.count("*").cast("double")
        matched = df.where(test).where(col(group_by).isNotNull())
        return matched.groupBy(col(group_by).cast("string").alias("label")).agg(value.alias("value"))
    row = df.agg(F.count_if(test).alias("yes"), F.count("*").alias("n"))
    return row.select(
        F.inline(
            F.array(
                F.struct(F.lit("match").alias("label"), F.col("yes").cast("double").alias("value")),
                F.struct(F.lit("no match").alias("label"), (F.col("n") - F.col("yes")).cast("double").alias("value")),
            )
        )
    )


def filter_stats(df: DataFrame, column: str, operator: str, threshold: float, agg_column: str | None = None) -> DataFrame:
    """One row: rows that match, their share, and the mean with and without the filter."""
    test = comparison(df, column, operator, threshold)
    v = number(agg_column) if agg_column else F.lit(None).cast("double")
    return df.agg(
        F.count_if(test).alias("filtered_rows"), F.count("*").alias("total_rows"),
        F.avg(F.when(test, v)).alias("filtered_mean"), F.avg(v).alias("overall_mean"),
    ).withColumn("filter_pct", share(F.col("filtered_rows"), F.col("total_rows")))


def segment_profile(
    df: DataFrame, metric: str, compare_cols: Sequence[str] | None = None, direction: str = "top", top_n: int = 1,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """(column, segment_mean, rest_mean, diff_pct): the n rows highest or lowest by metric against the rest.

    Compares all numeric columns, or the given ones, largest difference first.  ``order_by``
    breaks ties in the metric, a hash of the compared columns what is left.
    Nothing is subtracted: a value outside the segment is summed with the rest,
    so large and infinite ones in the segment leave the rest as it is.
    """
    require(df, metric, *order_by)
    if direction not in ("top", "bottom"):
        raise ValueError("direction is 'top' or 'bottom'")
    names = [c for c in (numeric_columns(df) if compare_cols is None else compare_cols) if c in df.columns and c != metric]
    m = number(metric)
    columns = [number(c).alias(f"c{i}") for i, c in enumerate(names)]
    values = df.select(m.alias("_m"), *columns, *[col(c).alias(f"_t{i}") for i, c in enumerate(order_by)])
    parts = [p for i in range(len(names)) for p in (F.isnull(f"c{i}"), F.col(f"c{i}"))]
    sort = F.struct((-F.col("_m") if direction == "top" else F.col("_m")).alias("m"), *[F.col(f"_t{i}") for i in range(len(order_by))], F.xxhash64(F.lit(1), *parts).alias("h"))
    values = values.withColumn("_place", F.when(F.col("_m").isNotNull(), sort))
    # the segment's last place; of rows that share it as many belong as are left, and they hold the same values
    edge = values.where(F.col("_place").isNotNull()).orderBy("_place").limit(top_n).agg(F.max("_place").alias("_last"), F.count("*").alias("_n"))
    before, at = F.coalesce(F.col("_place") < F.col("_last"), F.lit(False)), F.coalesce(F.col("_place") == F.col("_last"), F.lit(False))
    sums = [F.first("_n").alias("_n"), F.count_if(before).alias("_before"), F.count_if(at).alias("_at")]
    for i in range(len(names)):
        v = F.col(f"c{i}")
        for side, rows in (("b", before), ("r", ~before & ~at)):
            sums += [F.sum(F.when(rows, v)).alias(f"{side}s{i}"), F.count(F.when(rows, v)).alias(f"{side}n{i}")]
        sums.append(F.max(F.when(at, v)).alias(f"at{i}"))
    both = attach_row(values, edge).agg(*sums)
    own = F.col("_n") - F.col("_before")

    def mean(side: str, i: int, shared: Column) -> Column:
        v = F.col(f"at{i}")
        more = F.when((shared > 0) & v.isNotNull(), shared * v)
        n = F.col(f"{side}n{i}") + F.when(v.isNotNull(), shared).otherwise(0)
        return F.when(n > 0, F.coalesce(F.col(f"{side}s{i}") + more, f"{side}s{i}", more) / n)

    rows = [
        F.struct(F.lit(c).alias("column"), mean("b", i, own).alias("segment_mean"), mean("r", i, F.col("_at") - own).alias("rest_mean"))
        for i, c in enumerate(names)
    ]
    rest = F.col("rest_mean")
    diff = F.when(F.abs(rest) > 1e-10, (F.col("segment_mean") - rest) / F.abs(rest) * 100).otherwise(0.0)
    return both.select(F.inline(F.array(*rows))).withColumn("diff_pct", diff).orderBy(F.abs("diff_pct").desc(), "column")
