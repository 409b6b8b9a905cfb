"""Linear regression with its diagnostics.

The data is passed over for medians, then once for means and cross-products.
Coefficients, R2, importance, VIF, cross-validation and the comparison with
Ridge and Lasso are algebra on those sums; only residual diagnostics read the
rows again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loupe.frames import col, require
from loupe.functions.coerce import to_number
from loupe.functions.normal import normal_ppf
from loupe.moments import Moments, moments, moments_by
from loupe.ordered import POSITION, Sort, at_steps, with_neighbour, with_position
from loupe.quantiles import column_quantiles

_SMALL = 1e-10


def _read(df: DataFrame, name: str) -> Column:
    return to_number(col(name), df.schema[name].dataType)


def _names(df: DataFrame, target, features) -> tuple[str, list[str]]:
    """Unwrap a one-element list, trim names, check that they exist."""
    if isinstance(target, (list, tuple)):
        target = target[0] if target else ""
    target = str(target).strip()
    features = [str(f).strip() for f in features if str(f).strip()]
    if not target or not features:
        raise ValueError("a target and at least one feature are needed")
    require(df, target, *features)
    return target, features


def preview_training(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """One row per feature: rows in all and with a target, unreadable cells."""
    target, features = _names(df, target, features)
    wide = df.agg(
        F.count("*").alias("total_rows"), F.count(_read(df, target)).alias("effective_rows"),
        *[F.count(_read(df, f)).alias(f"c{i}") for i, f in enumerate(features)],
    )
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("_known")) for i, f in enumerate(features)]
    total = F.col("total_rows")
    return wide.select("total_rows", "effective_rows", F.inline(F.array(*rows))).select(
        "feature", "total_rows", "effective_rows", (total - F.col("effective_rows")).alias("y_dropped"),
        F.try_divide((total - F.col("effective_rows")) * 100.0, total).alias("y_dropped_pct"),
        (total - F.col("_known")).alias("nan_count"),
        F.try_divide((total - F.col("_known")) * 100.0, total).alias("nan_pct"),
        (F.col("_known") == 0).alias("all_nan"),
    )


@dataclass
class Prepared:
    """Numbers only: the target as ``y``, features as ``x0``, ``x1``, ..."""

    data: DataFrame
    target: str
    features: list[str]
    medians: list[float]
    total_rows: int
    n_dropped: int
    n_imputed: int

    @property
    def xs(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.features))]


def prepare_training(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ()) -> Prepared:
    """Read the columns as numbers, drop rows without a target, fill features with their median.

    ``keys`` are carried along, to order or split the rows by.
    """
    target, features = _names(df, target, features)
    require(df, *keys)
    raw = df.select(
        *[col(k) for k in keys], _read(df, target).alias("y"), *[_read(df, f).alias(f"x{i}") for i, f in enumerate(features)]
    )
    xs = [f"x{i}" for i in range(len(features))]
    kept = raw.where(F.col("y").isNotNull())
    with_target = [F.when(F.col("y").isNotNull(), F.col(x)) for x in xs]
    counts = raw.agg(
        F.count("*"), F.count("y"), *[F.count(x) for x in xs], *[F.count(x) for x in with_target]
    ).first()
    total, n = counts[0], counts[1]
    unreadable = [f for f, c in zip(features, counts[2 : 2 + len(xs)]) if c == 0]
    if unreadable:
        raise ValueError(f"features without any number: {unreadable}")
    if n == 0:
        raise ValueError(f"the target {target!r} has no number")
    gaps = [n - c for c in counts[2 + len(xs) :]]
    holed = [x for x, g in zip(xs, gaps) if 0 < g < n]
    found = column_quantiles(kept, holed, [0.5]) if holed else {}
    # a feature known only where the target is not has no median; it counts as 0
    medians = {x: found[x][0] if x in found else 0.0 for x in xs}
    filled = kept.withColumns({x: F.coalesce(F.col(x), F.lit(medians[x])) for x, g in zip(xs, gaps) if g})
    return Prepared(filled, target, features, [medians[x] for x in xs], total, total - n, int(sum(gaps)))


def _solve(cross: np.ndarray, with_y: np.ndarray) -> np.ndarray:
    """Least-squares coefficients; the shortest ones where columns are collinear."""
    spread = np.sqrt(np.diag(cross))
    live = spread > 0
    b = np.zeros(len(spread))
    if not live.any():
        return b
    s = spread[live]
    values, axes = np.linalg.eigh(cross[np.ix_(live, live)] / np.outer(s, s))
    keep = values > 1e-10
    scaled = axes[:, keep] @ ((axes[:, keep].T @ (with_y[live] / s)) / values[keep])
    solution = scaled / s
    free = axes[:, ~keep] / s[:, None]
    if free.shape[1]:
        solution = solution - free @ np.linalg.lstsq(free, solution, rcond=None)[0]
    b[live] = solution
    return b


@dataclass
class LinearModel:
    """y = intercept + sum of coefficient * feature."""

    spark: SparkSession
    prepared: Prepared
    fitted: Moments  # of the features, then the target
    coefficients: np.ndarray
    intercept: float
    r2: float
    sse: float
    ranges: list[tuple[float, float]] = field(default_factory=list)

    @property
    def target(self) -> str:
        return self.prepared.target

    @property
    def features(self) -> list[str]:
        return self.prepared.features

    @property
    def n(self) -> int:
        return self.fitted.n

    @property
    def residual_std(self) -> float | None:
        free = self.n - len(self.features) - 1
        return math.sqrt(self.sse / free) if free > 0 else None

    def summary(self) -> DataFrame:
        """One row: target, intercept, R2, residual std, rows used, dropped and imputed cells."""
        return self.spark.createDataFrame(
            [(self.target, self.intercept, self.r2, self.residual_std, self.n, self.prepared.n_dropped,
              self.prepared.n_imputed, float(self.fitted.means[-1]), float(self.fitted.std()[-1]))],
            "target string, intercept double, r2 double, residual_std double, n_samples long, n_dropped long, "
            "n_imputed long, target_mean double, target_std double",
        )

    def feature_table(self) -> DataFrame:
        """(feature, coefficient, min, max, mean): P1 and P99 bound what-if values."""
        if not self.ranges:
            found = column_quantiles(self.prepared.data, self.prepared.xs, [0.01, 0.99])
            self.ranges = [tuple(found[x]) for x in self.prepared.xs]
        return self.spark.createDataFrame(
            [(f, float(b), float(low), float(high), float(m))
             for f, b, (low, high), m in zip(self.features, self.coefficients, self.ranges, self.fitted.means)],
            "feature string, coefficient double, min double, max double, mean double",
        )

    def score(self, columns: Sequence[Column]) -> Column:
        return sum((F.lit(float(b)) * c for b, c in zip(self.coefficients, columns)), F.lit(float(self.intercept)))

    def scored(self) -> DataFrame:
        """The training rows with ``prediction`` and ``residual``."""
        prediction = self.score([F.col(x) for x in self.prepared.xs])
        return self.prepared.data.withColumn("prediction", prediction).withColumn("residual", F.col("y") - F.col("prediction"))


def train_linear_regression(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ()) -> LinearModel:
    """Ordinary least squares with an intercept."""
    prepared = prepare_training(df, target, features, keys)
    fitted = moments(prepared.data, [*prepared.xs, "y"])
    p = len(prepared.features)
    b = _solve(fitted.cross[:p, :p], fitted.cross[:p, p])
    sse = max(0.0, float(fitted.cross[p, p] - 2 * b @ fitted.cross[:p, p] + b @ fitted.cross[:p, :p] @ b))
    sst = float(fitted.cross[p, p])
    model = LinearModel(df.sparkSession, prepared, fitted, b, float(fitted.means[p] - b @ fitted.means[:p]), 1.0, sse)
    if 0 < sst and sse < 1e-6 * sst:
        # a difference of sums this large has few digits left: sum the residuals themselves
        model.sse = model.scored().agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    # a constant target is fitted exactly
    model.r2 = 1 - model.sse / sst if sst > 0 else 1.0
    return model


def high_cardinality_features(prepared: Prepared, ratio: float = 0.5) -> DataFrame:
    """(feature, unique_count, ratio) of features with mostly distinct values, which are probably keys."""
    xs = prepared.xs
    stacked = prepared.data.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(x).alias("v")) for f, x in zip(prepared.features, xs)])))
    n = prepared.total_rows - prepared.n_dropped
    counted = stacked.groupBy("feature", "v").agg(F.lit(1).alias("_one")).groupBy("feature").agg(F.count("*").alias("unique_count"))
    return counted.withColumn("ratio", F.col("unique_count") / F.lit(n)).where(F.col("ratio") > ratio)


def feature_importance(model: LinearModel) -> DataFrame:
    """One row per feature, most important first: beta weight, r with the target, share of all weights.

    No rows when the target does not vary.
    """
    stds, p = model.fitted.std(), len(model.features)
    r = np.nan_to_num(model.fitted.correlation()[:p, p], nan=0.0)
    schema = (
        "feature string, standardized_coefficient double, original_coefficient double, correlation_with_target double, "
        "relative_importance double, x_mean double, x_std double"
    )
    if not stds[p] >= _SMALL:
        return model.spark.createDataFrame([], schema)
    beta = np.where(stds[:p] > _SMALL, model.coefficients * stds[:p] / stds[p], 0.0)
    total = float(np.abs(beta).sum())
    weight = np.abs(beta) / total * 100 if total > _SMALL else np.zeros(p)
    rows = [
        (f, float(beta[i]), float(model.coefficients[i]), float(r[i]), float(weight[i]), float(model.fitted.means[i]), float(stds[i]))
        for i, f in enumerate(model.features)
    ]
    return model.spark.createDataFrame(sorted(rows, key=lambda x: -abs(x[1])), schema)


def feature_ranges(model: LinearModel) -> DataFrame:
    """(feature, min, max, mean) with P1 and P99 as bounds."""
    return model.feature_table().select("feature", "min", "max", "mean")


def vif(model: LinearModel) -> DataFrame:
    """(feature, vif, level): variance inflation; infinite for exact collinearity.

    Above 5 it is moderate, above 10 severe.
    """
    p = len(model.features)
    r = np.nan_to_num(model.fitted.correlation()[:p, :p], nan=0.0)
    rows = []
    for i, f in enumerate(model.features):
        others = [j for j in range(p) if j != i]
        explained = float(r[i, others] @ np.linalg.pinv(r[np.ix_(others, others)], rcond=1e-10, hermitian=True) @ r[others, i]) if others else 0.0
        value = 1 / (1 - explained) if 1 - explained > 1e-10 else float("inf")
        rows.append((f, value, "severe" if value > 10 else "moderate" if value > 5 else "low"))
    return model.spark.createDataFrame(rows, "feature string, vif double, level string")


def residual_diagnostics(model: LinearModel) -> DataFrame:
    """One row: mean and std of the residuals, skewness, excess kurtosis, and how many exceed 3 std."""
    std = math.sqrt(model.sse / max(model.n - 1, 1))
    flat = math.sqrt(model.sse / model.n) <= _SMALL
    e = F.col("residual")
    spread = 1.0 if flat else std
    zero = F.lit(0.0)
    return model.scored().agg(
        F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("std_residual"),
        F.coalesce(F.nanvl(F.skewness(e), zero), zero).alias("skewness"),
        F.coalesce(F.nanvl(F.kurtosis(e), zero), zero).alias("kurtosis"),
        F.count_if(F.abs(e) / F.lit(spread) > 3).alias("n_outliers"),
    )


def residual_qq(model: LinearModel, points: int = 300) -> DataFrame:
    """(position, theoretical, sample): sorted standardised residuals against normal quantiles."""
    std = math.sqrt(model.sse / max(model.n - 1, 1)) or 1.0
    kept = at_steps(model.scored().select((F.col("residual") / F.lit(std)).alias("e")), "e", max(1, model.n // points))
    theoretical = normal_ppf((F.col("position") + 0.5) / F.lit(float(model.n)))
    return kept.select("position", theoretical.alias("theoretical"), F.col("value").alias("sample"))


def predicted_against_actual(model: LinearModel, order_by: Sort, points: int = 500) -> DataFrame:
    """(position, actual, predicted) of every (n // points)-th row in the given order.

    The order's columns are ``keys`` of the training.
    """
    placed = with_position(model.scored(), order_by)
    return placed.where(F.col(POSITION) % max(1, model.n // points) == 0).select(
        F.col(POSITION).alias("position"), F.col("y").alias("actual"), F.col("prediction").alias("predicted")
    )


def durbin_watson(model: LinearModel, order_by: Sort) -> DataFrame:
    """One row: the statistic of the residuals in the given order; 2 without residuals.

    The order's columns are ``keys`` of the training.
    """
    step = F.col("residual") - F.col("_neighbour.residual")
    placed = with_neighbour(model.scored(), ["residual"], order_by)
    sums = placed.agg(F.sum(step * step).alias("a"), F.sum(F.col("residual") * F.col("residual")).alias("b"))
    return sums.select(F.when(F.col("b") < _SMALL, 2.0).otherwise(F.coalesce("a", F.lit(0.0)) / F.col("b")).alias("durbin_watson"))


def _test_errors(test: Moments, b: np.ndarray, intercept: float) -> tuple[float, float]:
    """Squared error and squared spread of the target on other rows."""
    p = len(b)
    off = test.means[p] - intercept - b @ test.means[:p]
    sse = test.cross[p, p] - 2 * b @ test.cross[:p, p] + b @ test.cross[:p, :p] @ b + test.n * off * off
    return max(0.0, float(sse)), float(test.cross[p, p])


def _share_of(prepared: Prepared, keys: Sequence[str], seed: int, parts: int) -> Column:
    """A part from 0 to parts-1 that depends on the row's values only.

    It is the MD5 of the seed and the values as text, which other engines have
    as well, so that a split can be made again elsewhere.
    """
    columns = [col(k) for k in keys] or [F.col("y"), *[F.col(x) for x in prepared.xs]]
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(parts)


def cross_val_r2(model: LinearModel, folds: int = 5, keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """(fold, n, r2): each fold predicted by a model of the others, from one pass of sums.

    Rows fall into folds by a hash of ``keys``, or of their values.  Fewer than
    two rows a fold give no result.
    """
    p = len(model.features)
    schema = "fold long, n long, r2 double"
    if folds < 2 or model.n < 2 * folds:
        return model.spark.createDataFrame([], schema)
    parts = moments_by(model.prepared.data, [*model.prepared.xs, "y"], _share_of(model.prepared, keys, seed, folds), model.fitted.means)
    rows = []
    for fold, test in sorted(parts.items()):
        rest = [m for f, m in parts.items() if f != fold]
        if not rest:
            continue
        train = Moments.merge(rest)
        b = _solve(train.cross[:p, :p], train.cross[:p, p])
        sse, sst = _test_errors(test, b, train.means[p] - b @ train.means[:p])
        rows.append((int(fold), int(test.n), 1 - sse / sst if sst > 0 else None))
    return model.spark.createDataFrame(rows, schema)


def cross_val_summary(scores: DataFrame) -> DataFrame:
    """One row: mean and std (dividing by n) of R2 over the folds."""
    return scores.agg(
        F.avg("r2").alias("cross_val_r2"), F.stddev_pop("r2").alias("cross_val_r2_std"), F.count("*").alias("folds")
    )


def _lasso(r: np.ndarray, rho: np.ndarray, alpha: float, steps: int = 5000) -> np.ndarray:
    """Minimise |y - Zw|^2 / 2n + alpha |w|_1 by coordinate descent on Z'Z / n and Z'y / n."""
    w = np.zeros(len(rho))
    for _ in range(steps):
        before = w.copy()
        for j in range(len(w)):
            if r[j, j] > 0:
                pull = rho[j] - r[j] @ w + r[j, j] * w[j]
                w[j] = np.sign(pull) * max(abs(pull) - alpha, 0.0) / r[j, j]
        if np.abs(w - before).max() <= 1e-10 * max(1.0, np.abs(w).max()):
            break
    return w


def compare_models(model: LinearModel, keys: Sequence[str] = (), seed: int = 42, alpha: float = 1.0) -> DataFrame:
    """(model, n_train, n_test, r2, rmse) on a fifth of the rows held out by hash.

    Linear, and Ridge (alpha 1) and Lasso (alpha 0.1) on columns scaled by the
    training rows.  Fewer than 10 rows: no result.
    """
    p = len(model.features)
    schema = "model string, n_train long, n_test long, r2 double, rmse double"
    if model.n < 10:
        return model.spark.createDataFrame([], schema)
    held_out = _share_of(model.prepared, keys, seed, 5) == 0
    parts = moments_by(model.prepared.data, [*model.prepared.xs, "y"], held_out, model.fitted.means)
    if len(parts) < 2:
        return model.spark.createDataFrame([], schema)
    train, test = parts[False], parts[True]
    stds = train.std(ddof=0)[:p]
    scale = np.where(stds > 0, stds, 1.0)
    gram = train.cross[:p, :p] / np.outer(scale, scale)
    with_y = train.cross[:p, p] / scale
    weights = {"Linear": _solve(train.cross[:p, :p], train.cross[:p, p]) * scale}
    weights["Ridge"] = np.linalg.solve(gram + alpha * np.eye(p), with_y)
    weights["Lasso"] = _lasso(gram / train.n, with_y / train.n, alpha / 10)
    rows = []
    for name, w in weights.items():
        b = w / scale
        sse, sst = _test_errors(test, b, train.means[p] - b @ train.means[:p])
        rows.append((name, train.n, test.n, 1 - sse / sst if sst > _SMALL else 0.0, math.sqrt(sse / test.n)))
    return model.spark.createDataFrame(rows, schema)
