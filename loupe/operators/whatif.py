"""Predictions and what-if analysis with a fitted linear model.

Scenarios are tables with a ``scenario`` column and one column per feature.
The feature table (feature, coefficient, min, max, mean) may carry the keys of
many models; then every model is served at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loupe.frames import col, require
from loupe.functions.coerce import to_number
from loupe.operators.regression import LinearModel


def _inputs(model: LinearModel, df: DataFrame, missing: Sequence[float]) -> list[Column]:
    require(df, *model.features)
    return [
        F.coalesce(to_number(col(f), df.schema[f].dataType), F.lit(float(m))) for f, m in zip(model.features, missing)
    ]


def predict(model: LinearModel, df: DataFrame, missing: str = "median") -> DataFrame:
    """Add ``prediction`` and its 95 % band ``lower`` to ``upper``.

    Missing features take the training median, or 0 with ``missing="zero"``.
    """
    fill = model.prepared.medians if missing == "median" else [0.0] * len(model.features)
    half = F.lit(1.96 * (model.residual_std or 0.0))
    scored = df.withColumn("prediction", model.score(_inputs(model, df, fill)))
    return scored.withColumns({"lower": F.col("prediction") - half, "upper": F.col("prediction") + half})


def contributions(model: LinearModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, value, contribution): what each feature adds to a row's prediction."""
    inputs = _inputs(model, df, [0.0] * len(model.features))
    rows = [
        F.struct(F.lit(f).alias("feature"), v.alias("value"), (F.lit(float(b)) * v).alias("contribution"))
        for f, v, b in zip(model.features, inputs, model.coefficients)
    ]
    return df.select(*[col(k) for k in keys], F.inline(F.array(*rows)))


def scenarios(model: LinearModel, named: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """A scenario table: features left out stay at their mean."""
    means = dict(zip(model.features, map(float, model.fitted.means)))
    rows = []
    for name, values in named.items():
        unknown = set(values) - set(means)
        if unknown:
            raise ValueError(f"scenario {name!r} sets unknown features {sorted(unknown)}")
        rows.append((name, *[float(values.get(f, means[f])) for f in model.features]))
    schema = "scenario string, " + ", ".join(f"`{f}` double" for f in model.features)
    return model.spark.createDataFrame(rows, schema)


def scenario_compare(model: LinearModel, table: DataFrame) -> DataFrame:
    """Predictions of the scenarios next to ``current``, where every feature is at its mean."""
    current = scenarios(model, {"current": {}})
    both = predict(model, current.unionByName(table.select(*current.columns)), missing="zero")
    base = float(model.intercept + model.coefficients @ model.fitted.means[:-1])
    return both.withColumn("difference", F.col("prediction") - F.lit(base))


def slider_step(width: Column) -> Column:
    """A hundredth of the range, rounded to a readable step, 0.001 at least."""
    step = F.when(width == 0, F.lit(1.0)).otherwise(width) / 100
    return (
        F.when(step < 0.001, 0.001).when(step < 0.01, F.round(step, 4)).when(step < 1, F.round(step, 2)).otherwise(F.round(step, 1))
    )


def scenario_grid(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, step, value, mean): the values each feature can be set to, from P1 to P99."""
    width = slider_step(F.col("max") - F.col("min"))
    # the tolerance keeps an end point that rounding puts just beyond the range
    places = F.floor((F.col("max") - F.col("min")) / F.col("width") + 1e-9)
    stepped = features.withColumn("width", width).select(
        *[col(b) for b in by], "feature", "min", "width", "mean", F.explode(F.sequence(F.lit(0).cast("long"), places)).alias("step")
    )
    return stepped.select(
        *[col(b) for b in by], "feature", "step", (F.col("min") + F.col("step") * F.col("width")).alias("value"), "mean"
    )


def scenario_sweep(model: LinearModel) -> DataFrame:
    """Scenario table that moves one feature at a time over its grid, the others at their mean."""
    grid = scenario_grid(model.feature_table())
    means = dict(zip(model.features, map(float, model.fitted.means)))
    return grid.select(
        F.concat_ws("=", F.col("feature"), F.col("step").cast("string")).alias("scenario"),
        *[F.when(F.col("feature") == f, F.col("value")).otherwise(F.lit(means[f])).alias(f) for f in model.features],
    )


def sensitivity(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, coefficient, impact): how far the prediction moves over the feature's range."""
    impact = F.abs(F.col("coefficient") * (F.col("max") - F.col("min")))
    return features.select(*[col(b) for b in by], "feature", "coefficient", impact.alias("impact")).orderBy(
        *[col(b) for b in by], F.desc("impact"), "feature"
    )


def best_values(features: DataFrame, direction: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value): each feature at the bound that raises (or lowers) the prediction.

    The model is linear, so the bounds are the optimum.
    """
    if direction not in ("max", "min"):
        raise ValueError("direction is 'max' or 'min'")
    up, down = ("max", "min") if direction == "max" else ("min", "max")
    return features.select(
        *[col(b) for b in by], "feature", F.when(F.col("coefficient") > 0, F.col(up)).otherwise(F.col(down)).alias("value"), "coefficient"
    )


def optimize(features: DataFrame, intercepts: DataFrame, direction: str = "max", by: Sequence[str] = ()) -> DataFrame:
    """(keys, prediction, values): the best prediction of each model and the values that give it.

    ``intercepts`` has one ``intercept`` per model, named by the keys; without
    keys there is one model.
    """
    if not by and len(intercepts.limit(2).collect()) > 1:
        raise ValueError("several models need keys that tell them apart")
    best = best_values(features, direction, by).groupBy(*[col(b) for b in by]).agg(
        F.sum(F.col("coefficient") * F.col("value")).alias("_moved"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("values"),
    )
    joined = best.join(intercepts, list(by)) if by else best.crossJoin(F.broadcast(intercepts))
    return joined.select(*[col(b) for b in by], (F.col("intercept") + F.col("_moved")).alias("prediction"), "values")
