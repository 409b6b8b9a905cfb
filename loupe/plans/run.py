"""Run a list of named analyses over one table."""

from __future__ import annotations

import inspect
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from loupe.operators import distribution, profiling, trend
from loupe.operators.prepare import apply_mappings
from loupe.plans.analyses import ANALYSES, COLUMN_PARAMETERS


@dataclass
class Step:
    """One action: its result tables, or what went wrong."""

    step: int
    function: str
    chart: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    error: str | None = None


def _missing(params: Mapping[str, Any], columns: Sequence[str]) -> list[str]:
    named = [
        c for key, value in params.items() if key in COLUMN_PARAMETERS and value is not None
        for c in ([value] if isinstance(value, str) else value)
    ]
    return [c for c in named if c not in columns]


def run_plan(
    df: DataFrame, actions: Sequence[Mapping[str, Any]], mappings: Sequence[Mapping[str, Any]] = (), cache: bool = False,
    execute: bool = False,
) -> list[Step]:
    """Run ``{function, params, chart}`` actions after adding the mapped columns.

    Unknown parameters are dropped.  An unknown function, a column that does
    not exist or a failing analysis gives a step with an error; the others
    still run.  Tables are lazy, so what only fails on the data fails where
    they are read; ``execute`` runs every table once, which makes that an error
    of its step too.  ``cache`` keeps the columns in use for plans with several
    actions; unpersist the returned tables' source with
    ``spark.catalog.clearCache()`` when done.
    """
    table = apply_mappings(df, mappings)
    if cache and len(actions) > 1:
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
    steps = [_run(table, place, action) for place, action in enumerate(actions, start=1)]
    return [_executed(step) for step in steps] if execute else steps


def _executed(step: Step) -> Step:
    try:
        for result in step.tables.values():
            result.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError) as problem:
        return replace(step, tables={}, error=str(problem))
    return step


def _run(table: DataFrame, place: int, action: Mapping[str, Any]) -> Step:
    name = str(action.get("function", ""))
    known = ANALYSES.get(name)
    if known is None:
        return Step(place, name, "table", error=f"unknown analysis {name!r}")
    chart = str(action.get("chart") or known.chart)
    accepted = inspect.signature(known.run).parameters
    params = {k: v for k, v in dict(action.get("params") or {}).items() if k in accepted and k != "df"}
    missing = _missing(params, table.columns)
    if missing:
        return Step(place, name, chart, error=f"unknown columns {missing}")
    try:
        return Step(place, name, chart, known.run(table, **params))
    except (ValueError, TypeError, PySparkException) as problem:
        return Step(place, name, chart, error=str(problem))


def status(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """(step, function, chart, tables, error), one row per action."""
    return df.sparkSession.createDataFrame(
        [(s.step, s.function, s.chart, sorted(s.tables), s.error) for s in steps],
        "step int, function string, chart string, tables array<string>, error string",
    )


def auto_eda(df: DataFrame, sample_rows: int | None = None, seed: int = 42, first: int | None = None) -> dict[str, DataFrame]:
    """Summaries and charts of every column.

    Keys: exploratory, histograms, correlation, categorical and timeseries
    (first date by first number); parts without suitable columns are left out.
    ``first`` draws only so many columns of a kind.  ``sample_rows`` takes a
    random part for the numeric summaries; by default all rows count.
    """
    types = profiling.semantic_types(df)
    of = lambda kind: [c for c, t in types.items() if t == kind]
    numeric, dates, categories = of("numeric"), of("datetime"), of("categorical")
    rows = df
    if sample_rows is not None:
        n = df.count()
        rows = df.sample(sample_rows / n, seed) if n > sample_rows else df
    result: dict[str, DataFrame] = {}
    if numeric:
        result["exploratory"] = distribution.eda_exploratory(rows, numeric)
        result["histograms"] = distribution.histograms(rows, numeric[:first])
    if len(numeric) >= 2:
        result["correlation"] = profiling.pairwise_correlation(rows, numeric[:first])
    if categories:
        result["categorical"] = distribution.eda_categorical(df, categories[:first])
    if dates and numeric:
        result["timeseries"] = trend.eda_timeseries(df, dates[0], numeric[0])
    return result
