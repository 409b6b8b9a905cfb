"""The named analyses, each as a set of result tables.

Parameter names are those of an action's ``params``; columns are given by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from loupe.operators import distribution, multivariate, prepare, quality, relationship, trend
from loupe.operators.profiling import repeated_groups
from loupe.session import durable

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Analysis:
    run: Callable[..., Tables]
    category: str
    chart: str


ANALYSES: dict[str, Analysis] = {}

#: parameters that name columns
COLUMN_PARAMETERS = {
    "column", "columns", "x", "y", "group_col", "value_col", "date_col", "metric_col", "label_col", "subset",
    "context_cols", "agg_column", "group_by", "compare_cols", "order_by", "tie_by", "partition_by",
}


def analysis(category: str, chart: str):
    def register(run):
        ANALYSES[run.__name__] = Analysis(run, category, chart)
        return run

    return register


@analysis("distribution", "histogram")
def describe_distribution(df, column: str, test: str = "ks") -> Tables:
    return {
        "stats": distribution.describe_distribution(df, column, test),
        "histogram": distribution.histogram(df, column),
        "kde": distribution.kde(df, column),
    }


@analysis("distribution", "horizontal_bar")
def describe_frequency(df, column: str, top_n: int = 10) -> Tables:
    return {
        "stats": distribution.frequency_stats(df, column, top_n),
        "table": distribution.describe_frequency(df, column, top_n),
    }


@analysis("distribution", "boxplot")
def detect_outliers(df, column: str, method: str = "both") -> Tables:
    return {
        "stats": distribution.outlier_summary(df, column, method),
        "table": distribution.detect_outliers(df, column, method),
    }


@analysis("distribution", "qq")
def test_normality(df, column: str, test: str = "k2") -> Tables:
    return {"stats": distribution.test_normality(df, column, test), "qq": distribution.qq_points(df, column)}


@analysis("distribution", "donut")
def analyze_composition(df, column: str, top_n: int = 10) -> Tables:
    return {
        "stats": distribution.composition_stats(df, column, top_n),
        "table": distribution.analyze_composition(df, column, top_n),
    }


@analysis("relationship", "scatter")
def correlate(df, x: str, y: str, method: str = "pearson") -> Tables:
    return {"stats": relationship.correlate(df, x, y, method), "line": relationship.trend_line(df, x, y)}


@analysis("relationship", "stacked_bar")
def cross_tabulate(df, x: str, y: str, dense: bool = False) -> Tables:
    return {"stats": relationship.cross_stats(df, x, y), "table": relationship.cross_tabulate(df, x, y, dense)}


@analysis("relationship", "boxplot")
def compare_groups(df, group_col: str, value_col: str, test: str = "anova") -> Tables:
    return {
        "stats": relationship.compare_groups(df, group_col, value_col, test),
        "table": relationship.group_boxplot(df, group_col, value_col),
    }


@analysis("relationship", "horizontal_bar")
def compare_pairs(df, group_col: str, value_col: str) -> Tables:
    return {"table": relationship.compare_pairs(df, group_col, value_col)}


@analysis("relationship", "heatmap")
def correlation_matrix(df, columns: Sequence[str] | None = None, method: str = "pearson") -> Tables:
    matrix = relationship.correlation_matrix(df, columns, method)
    return {"matrix": matrix, "table": relationship.correlation_pairs(matrix)}


@analysis("relationship", "scatter")
def dimension_reduce(df, columns: Sequence[str] | None = None, n_components: int = 2) -> Tables:
    found = multivariate.dimension_reduce(df, columns, n_components)
    return {"stats": found.variance, "table": found.loadings, "points": found.scores}


@analysis("relationship", "scatter")
def cluster_analysis(df, columns: Sequence[str] | None = None, n_clusters: int | None = None) -> Tables:
    found = multivariate.cluster_analysis(df, columns, n_clusters)
    stats = df.sparkSession.createDataFrame([(found.n_clusters, found.silhouette)], "n_clusters int, silhouette_score double")
    return {"stats": stats, "table": found.clusters, "points": found.assignments}


@analysis("trend", "line")
def timeseries_line(df, date_col: str, metric_col: str, freq: str = "auto") -> Tables:
    return {
        "stats": trend.timeseries_stats(df, date_col, metric_col, freq),
        "table": trend.timeseries_line(df, date_col, metric_col, freq),
    }


@analysis("trend", "line")
def timeseries_decompose(
    df, date_col: str, metric_col: str, period: int = 12, tie_by: Sequence[str] = (), partition_by: Sequence[str] = (), freq: str | None = None,
) -> Tables:
    parts = trend.decomposed(df, date_col, metric_col, period, tie_by, partition_by, freq)  # sorted once for both
    return {
        "stats": trend.decompose_stats(df, date_col, metric_col, period, tie_by, partition_by, freq, parts),
        "table": trend.timeseries_decompose(df, date_col, metric_col, period, tie_by, partition_by, freq, parts),
    }


@analysis("trend", "bar")
def timeseries_growth(df, date_col: str, metric_col: str, mode: str = "auto") -> Tables:
    return {
        "stats": trend.growth_stats(df, date_col, metric_col, mode),
        "table": trend.timeseries_growth(df, date_col, metric_col, mode),
    }


@analysis("trend", "line")
def moving_average(
    df, date_col: str, metric_col: str, window: int = 7, tie_by: Sequence[str] = (), partition_by: Sequence[str] = (), freq: str | None = None,
) -> Tables:
    series = df if freq is None else trend.resample_sum(df, date_col, metric_col, freq)
    names = (date_col, metric_col) if freq is None else ("period_end", "value")
    return {"table": trend.moving_average(series, *names, window, tie_by if freq is None else (), partition_by if freq is None else ())}


@analysis("trend", "horizontal_bar")
def rank_top_n(df, column: str, label_col: str, n: int = 10, group_col: str | None = None) -> Tables:
    return {
        "stats": trend.rank_stats(df, column, label_col, n),
        "table": trend.rank_top_n(df, column, label_col, n, group_col),
    }


@analysis("trend", "pareto")
def pareto_analysis(df, column: str, label_col: str) -> Tables:
    return {"stats": trend.pareto_stats(df, column, label_col), "table": trend.pareto_analysis(df, column, label_col)}


@analysis("quality", "bar")
def profile_missing(df, columns: Sequence[str] | None = None) -> Tables:
    return {
        "stats": quality.missing_stats(df, columns),
        "table": quality.profile_missing(df, columns),
        "heatmap": relationship.missing_correlation(df, columns),
    }


@analysis("quality", "table")
def profile_duplicates(df, subset: Sequence[str] | None = None) -> Tables:
    repeated = durable(repeated_groups(df, subset))  # grouped once for both
    return {
        "stats": quality.profile_duplicates(df, subset, repeated),
        "table": quality.duplicate_sample(df, subset, repeated=repeated),
    }


@analysis("trend", "table")
def data_lookup(df, column: str, value: str, limit: int | None = None, order_by: Sequence[str] = ()) -> Tables:
    return {"stats": prepare.lookup_stats(df, column, str(value)), "table": prepare.data_lookup(df, column, str(value), limit, order_by)}


@analysis("distribution", "bar")
def anomaly_explain(
    df, column: str, date_col: str | None = None, context_cols: Sequence[str] = (), order_by: Sequence[str] = ()
) -> Tables:
    return {
        "stats": distribution.anomaly_stats(df, column),
        "table": distribution.anomaly_explain(df, column, date_col, context_cols or (), order_by),
    }


@analysis("trend", "horizontal_bar")
def filter_aggregate(
    df, column: str, operator: str, threshold: float, agg_column: str | None = None, group_by: str | None = None
) -> Tables:
    return {
        "stats": distribution.filter_stats(df, column, operator, threshold, agg_column),
        "table": distribution.filter_aggregate(df, column, operator, threshold, agg_column, group_by),
    }


#: words that ask for the lowest rows (fixed values)
LOWEST_WORDS = ["最低", "最小", "bottom"]


@analysis("distribution", "grouped_bar")
def segment_profile(
    df, metric_col: str, compare_cols: Sequence[str] | None = None, segment_condition: str = "", top_n: int = 1,
    order_by: Sequence[str] = (),
) -> Tables:
    lowest = any(w in segment_condition.lower() for w in LOWEST_WORDS)
    return {
        "table": distribution.segment_profile(df, metric_col, compare_cols, "bottom" if lowest else "top", top_n, order_by)
    }
