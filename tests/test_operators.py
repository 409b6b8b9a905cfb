"""Edge cases and known values on small tables."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loupe.operators import cleaning, distribution, history, jsontext, multivariate, prepare, profiling, quality
from loupe.operators import regression, relationship, trend, whatif
from loupe.plans import run


def table(spark, columns: dict, schema: str | None = None):
    if schema is None:  # a column with a float holds floats only
        columns = {
            c: [float(v) if v is not None else v for v in vs] if any(isinstance(v, float) for v in vs) else vs
            for c, vs in columns.items()
        }
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, schema or list(columns))


def column(df, name):
    return [r[name] for r in df.collect()]


# ------------------------------------------------------------------ preparing


def test_sanitise_order_of_steps(spark):
    df = table(
        spark,
        {"a": ["x", "NaN", None, "None"], "b": ["null", "NA", None, "N/A"], " c ": [None] * 4, "v": [float("nan"), 1.0, None, 2.0]},
        "a string, b string, ` c ` string, v double",
    )
    clean = prepare.sanitise(df)
    assert clean.columns == ["a", "b", "v"]  # b held tokens only and stays
    assert sorted(clean.collect(), key=str) == sorted([("x", None, None), (None, None, 1.0), (None, None, 2.0)], key=str)


def test_sanitise_refuses_names_that_collide(spark):
    with pytest.raises(ValueError):
        prepare.sanitise(table(spark, {"a": [1], " a": [2]}))


@pytest.mark.parametrize("formula", ["no_such + 1", "a +", "a > 1", "sum(a)", "(select 1)", "a; b"])
def test_faulty_formulas_are_skipped(spark, formula):
    df = table(spark, {"a": [1.0]})
    assert prepare.compute_column(df, "z", formula).columns == ["a"]


def test_formula(spark):
    df = table(spark, {"a": [2.0], "b c": [3.0]})
    assert prepare.compute_column(df, "z", "(a + `b c`) * 2 / 1e1 - a").first().z == pytest.approx(-1.0)


def test_compare_ignores_what_is_no_number(spark):
    df = table(spark, {"s": ["5", "x", None, "nan", "7.5"], "v": [1.0, float("nan"), 3.0, None, 9.0]})
    assert column(prepare.filter_compare(df, "s", "gte", 5), "s") == ["5", "7.5"]
    assert column(prepare.filter_compare(df, "v", "gt", 2), "v") == [3.0, 9.0]
    with pytest.raises(ValueError):
        prepare.filter_compare(df, "v", "between", 2)


def test_lookup(spark):
    df = table(spark, {"k": [3, 1, 2], "s": ["A.b", "axb", "zz"]})
    assert column(prepare.data_lookup(df, "s", "a.b", order_by=["k"]), "k") == [1, 3]
    assert column(prepare.data_lookup(df, "s", "a.b", literal=True), "k") == [3]
    assert column(prepare.data_lookup(df, "k", "2.0"), "s") == ["zz"]
    assert column(prepare.data_lookup(df, "k", "0"), "s") == []


def test_dates_in_several_layouts(spark):
    df = table(spark, {"d": ["2024-01-02", "2024/1/3", "1/4/2024 5:06", "2024-01-05T07:08:09", "20240106", "junk", "2024-13-45", None]})
    days = [r.d.strftime("%d") for r in prepare.coerce_datetime(df, "d").collect()]
    assert days == ["02", "03", "04", "05", "06"]


def test_recent_within_one_year(spark):
    days = [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 3, 1), datetime.datetime(2024, 3, 20)]
    assert prepare.recent(table(spark, {"d": days}), "d").count() == 2
    assert prepare.recent(table(spark, {"d": [datetime.datetime(2023, 12, 20), *days]}), "d").count() == 4


# ------------------------------------------------------------------ cleaning


def test_fill_edge_cases(spark):
    empty = table(spark, {"v": [None, None], "s": [None, None]}, "v double, s string")
    assert column(cleaning.fill_missing(empty, "v", "median"), "v") == [None, None]
    assert column(cleaning.fill_missing(empty, "s", "mode"), "s") == [None, None]
    assert cleaning.fill_missing(empty, "absent", "mean") is empty
    with pytest.raises(ValueError):
        cleaning.fill_missing(empty, "v", "forward")
    ints = table(spark, {"i": [1, 2, None, 2, 1]}, "i int")
    assert column(cleaning.fill_missing(ints, "i", "mode"), "i")[2] == 1
    assert column(cleaning.fill_missing(ints, "i", "mean"), "i")[2] == 1.5
    assert column(cleaning.fill_missing(ints, "i", "custom", 9), "i")[2] == 9
    assert column(cleaning.fill_missing(ints, "i", "custom"), "i")[2] == 1.5  # no value: the median


def test_few_values_have_no_outliers(spark):
    df = table(spark, {"v": [1.0, 1.0, 1.0, 99.0]})
    assert cleaning.handle_outliers(df, "v", "remove").count() == 4


def test_outlier_removal_drops_unknown_values(spark):
    df = table(spark, {"v": [1.0, 2.0, 3.0, 4.0, 5.0, 500.0, None]}, "v double")
    assert sorted(column(cleaning.handle_outliers(df, "v", "remove"), "v")) == [1.0, 2.0, 3.0, 4.0, 5.0]
    capped = column(cleaning.handle_outliers(df, "v", "cap"), "v")
    assert None in capped and max(v for v in capped if v is not None) == pytest.approx(8.5)


def test_constant_columns_with_nulls(spark):
    df = table(spark, {"a": [1, None], "b": [None, None], "c": [1, 2]}, "a int, b int, c int")
    assert cleaning.drop_constant_columns(df).columns == ["c"]
    assert cleaning.drop_constant_columns(df, ["a", "c"]).columns == ["b", "c"]
    assert cleaning.drop_constant_columns(df, []).columns == ["a", "b", "c"]


def test_unknown_cleaning_step_is_skipped(spark):
    df = table(spark, {"v": [1.0, None]}, "v double")
    cleaned, audit = cleaning.apply_cleaning(df, [{"type": "polish"}, {"type": "fill_missing", "column": "v", "method": "mean"}])
    assert column(cleaned, "v") == [1.0, 1.0]
    assert [r.cells_filled for r in audit.orderBy("step").collect()] == [0, 1]


def scanned(spark, rows, schema, partitions=3):
    """(table, number of times it was read so far)"""
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            yield batch
        reads.add(1)

    source = spark.createDataFrame(rows, schema).repartition(partitions, "i")
    return source.mapInPandas(read, schema), lambda: reads.value / partitions


CLEANING = [
    {"type": "drop_missing_rows", "column": "k"}, {"type": "fill_missing", "column": "v", "method": "custom", "fill_value": 7.0},
    {"type": "drop_columns", "columns": ["w"]}, {"type": "fill_missing", "column": "nowhere"}, {"type": "handle_outliers", "column": "v"},
]
MOVING = [
    {"type": "drop_duplicates", "subset": ["k"], "order_by": ["i"]}, {"type": "drop_missing_rows", "column": "k"},
    {"type": "fill_missing", "column": "v", "method": "forward", "order_by": ["i"]}, {"type": "drop_missing_rows", "column": "v"},
]


def test_the_audit_comes_from_one_run(spark):
    rows = [(i, f"k{i % 30}" if i % 7 else None, float(i) if i % 3 else None, "w") for i in range(200)]
    schema = "i int, k string, v double, w string"
    for steps, most in ((CLEANING, 1), (CLEANING + MOVING, 3), (MOVING, 3)):
        df, reads = scanned(spark, rows, schema)
        cleaned, audit = cleaning.apply_cleaning(df, steps)
        got = [tuple(r) for r in audit.orderBy("step").select("step", "rows_before", "rows_after", "rows_removed", "cells_filled").collect()]
        assert cleaned.count() == got[-1][2] and reads() <= most
        # step by step, every state counted by itself
        state, want = df, []
        for k, step in enumerate(steps, 1):
            after = cleaning.apply_cleaning(state, [step])[0]
            name = step.get("column")
            filled = after.where(f"{name} IS NOT NULL").count() - state.where(f"{name} IS NOT NULL").count() if step["type"] == "fill_missing" and name in state.columns else 0
            want.append((k, state.count(), after.count(), state.count() - after.count(), filled))
            state = after
        assert got == want
        assert sorted(map(str, cleaned.collect())) == sorted(map(str, state.collect()))


def test_the_audit_of_nothing(spark):
    for empty in (table(spark, {"i": [], "k": [], "v": [], "w": []}, "i int, k string, v double, w string"), spark.range(0).selectExpr("id AS i", "'x' AS k", "1.0 AS v", "'w' AS w")):
        cleaned, audit = cleaning.apply_cleaning(empty, CLEANING + MOVING)
        assert cleaned.count() == 0 and {(r.rows_before, r.rows_after, r.cells_filled) for r in audit.collect()} == {(0, 0, 0)}
    assert cleaning.apply_cleaning(empty, [])[1].count() == 0


# ------------------------------------------------------------------ profiling


def test_semantic_types(spark):
    n = 120
    df = table(
        spark,
        {
            "user_id": [i % 3 for i in range(n)],
            "flag01": [i % 2 for i in range(n)],
            "truth": ["True" if i % 2 else "false" for i in range(n)],
            "near_unique": [i * 1.5 for i in range(n)],
            "five": [i % 5 for i in range(n)],
            "written": ["2024-01-%02d" % (i % 28 + 1) if i % 10 else "junk" for i in range(n)],
            "essay": ["word %d " % i * 20 for i in range(n)],
            "name": ["name %d" % i for i in range(n)],
            "kind": ["abc"[i % 3] for i in range(n)],
            "nothing": [None] * n,
        },
        "user_id int, flag01 int, truth string, near_unique double, five int, written string, essay string, name string, kind string, nothing string",
    )
    types = profiling.semantic_types(df)
    assert types == {
        "user_id": "identifier", "flag01": "boolean", "truth": "boolean", "near_unique": "identifier", "five": "numeric",
        "written": "datetime", "essay": "text", "name": "text", "kind": "categorical", "nothing": "unknown",
    }
    assert profiling.semantic_types(df, identifier_integral_only=True)["near_unique"] == "numeric"
    counts = {r.semantic_type: r.columns for r in profiling.type_counts(profiling.infer_semantic_types(df)).collect()}
    assert counts["text"] == 2


def test_all_values_decide_dates(spark):
    table_of = lambda dates: table(spark, {"i": list(range(400)), "s": ["2024-01-01"] * dates + ["x"] * (400 - dates)})
    # wherever the dates stand
    assert profiling.semantic_types(table_of(180))["s"] == "categorical"
    assert profiling.semantic_types(table_of(319))["s"] == "categorical" and profiling.semantic_types(table_of(320))["s"] == "datetime"
    days = [str(d) for d in pd.date_range("2020-01-01", periods=400).date]
    for dates, suggested in ((150, False), (200, True), (300, True)):
        df = table(spark, {"s": [f"no date {k}" for k in range(400 - dates)] + days[:dates]})
        found = profiling.suggest_types(df, profiling.profile_columns(df))
        assert [tuple(r) for r in found.collect()] == [("s", "text", "datetime")] * suggested


def test_top_values_are_limited_before_the_shuffle(spark):
    plan = profiling.top_values(profiling.value_counts(spark.range(10)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_duplicate_rows(spark):
    df = table(spark, {"a": [1, 1, 1, 2, None, None], "b": [0.0, -0.0, 0.0, 1.0, None, None]}, "a int, b double")
    row = profiling.profile_table(df).first()
    assert (row.rows, row.duplicate_rows) == (6, 3)
    assert row.completeness == pytest.approx(8 / 12)
    stats = quality.profile_duplicates(df).first()
    assert (stats.duplicate_rows, stats.duplicate_pct) == (5, pytest.approx(500 / 6))


# ------------------------------------------------------------------ distribution


def test_histogram_of_a_constant_and_of_few_values(spark):
    rows = distribution.histogram(table(spark, {"v": [2.0] * 7}), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 0, 7, 0]
    assert (rows[0].left, rows[-1].right) == (1.5, 2.5)
    assert distribution.histogram(table(spark, {"v": [1.0] * 4}), "v").count() == 0


def test_histogram_edges(spark):
    values = [0.1 * i for i in range(31)] + [3.0]
    rows = distribution.histogram(table(spark, {"v": values}), "v", 30).orderBy("bin").collect()
    counts, edges = np.histogram(values, 30)
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r.left for r in rows], edges[:-1])


def test_kde_against_brute_force(spark):
    values = np.random.default_rng(1).gamma(2, 3, 200)
    rows = distribution.kde(table(spark, {"v": values.tolist()}).repartition(3), "v", 50).orderBy("x").collect()
    h = values.std(ddof=1) * 200 ** -0.2
    grid = np.linspace(values.min(), values.max(), 50)
    expected = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(axis=1) / (200 * h * np.sqrt(2 * np.pi))
    assert np.allclose([r.density for r in rows], expected)


def test_density_of_many_values(spark):
    # a kernel reaches a few of the grid's points, all of them, or lies between two
    for values in (np.random.default_rng(1).normal(size=3000), np.arange(5.0), np.append(np.random.default_rng(2).normal(size=3000), [1e6])):
        rows = distribution.kde(table(spark, {"v": values.tolist()}), "v").orderBy("x").collect()
        width = values.std(ddof=1) * len(values) ** (-1 / 5)
        grid = np.linspace(values.min(), values.max(), 200)
        expected = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))
        assert np.allclose([r.density for r in rows], expected, rtol=1e-9, atol=1e-300)


def test_a_plan_sorts_and_groups_once_for_both_tables(spark, monkeypatch):
    from loupe.plans import analyses

    calls, sort, group = [], trend.with_position, analyses.repeated_groups
    monkeypatch.setattr(trend, "with_position", lambda *a, **k: calls.append("sort") or sort(*a, **k))
    counted = lambda *a, **k: calls.append("group") or group(*a, **k)
    for module in (analyses, quality):
        monkeypatch.setattr(module, "repeated_groups", counted)
    df = spark.range(60).selectExpr("timestamp_seconds(id * 86400) AS d", "CAST(id % 7 AS DOUBLE) AS v")
    steps = run.run_plan(df, [
        {"function": "timeseries_decompose", "params": {"date_col": "d", "metric_col": "v"}},
        {"function": "profile_duplicates", "params": {"subset": ["v"]}},
    ])
    stats, copies = steps[0].tables["stats"].first(), steps[1].tables["stats"].first()
    assert stats.n_points == 60 and steps[0].tables["table"].count() == 60
    assert copies.duplicate_rows == 60 and steps[1].tables["table"].count() == 7
    assert sorted(calls) == ["group", "sort"]


def test_shapiro_wilk_published_example(spark):
    weights = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = distribution.shapiro_wilk(table(spark, {"v": [float(w) for w in weights]}), "v").first()
    assert row.statistic == pytest.approx(0.78881, abs=1e-4)
    assert row.p_value == pytest.approx(0.006704, abs=1e-4)


def test_shapiro_has_no_upper_bound(spark):
    rng = np.random.default_rng(3)
    df = table(spark, {"a": rng.normal(5, 2, 6000).tolist(), "b": rng.uniform(0, 1, 6000).tolist()})
    assert distribution.shapiro_wilk(df, "a").first().statistic > 0.999 > 0.97 > distribution.shapiro_wilk(df, "b").first().statistic > 0.9


def test_the_rest_of_a_segment_is_summed_alone(spark):
    inf = float("inf")
    for top, mean in ((1e18, 1e18), (inf, inf), (None, None), (-inf, -inf)):
        df = table(spark, {"m": [1.0] * 99 + [2.0, None], "v": [1.0] * 99 + [top, 1.0]}, "m double, v double")
        row = distribution.segment_profile(df, "m", ["v"]).first()
        assert (row.segment_mean, row.rest_mean) == (mean, 1.0)
        low = distribution.segment_profile(df, "m", ["v"], "bottom", 99).first()
        assert (low.segment_mean, low.rest_mean) == (1.0, pytest.approx((1.0 if top is None else (top + 1.0) / 2)))
    # rows that are alike up to the edge: as many as are left
    df = table(spark, {"m": [5.0] * 10 + [1.0] * 10, "v": [4.0] * 10 + [6.0] * 10})
    assert tuple(distribution.segment_profile(df, "m", ["v"], top_n=4).first())[1:3] == (4.0, pytest.approx((6 * 4 + 60) / 16))
    assert tuple(distribution.segment_profile(df, "m", ["v"], top_n=12).first())[1:3] == (pytest.approx((40 + 12) / 12), 6.0)
    assert tuple(distribution.segment_profile(df, "m", ["v"], top_n=50).first())[1:3] == (5.0, None)
    frame = pd.DataFrame({"m": np.arange(200) % 13, "t": np.arange(200), "v": np.random.default_rng(1).normal(size=200)})
    ranked = frame.sort_values(["m", "t"], ascending=[False, True])
    row = distribution.segment_profile(spark.createDataFrame(frame), "m", ["v"], top_n=37, order_by=["t"]).first()
    assert (row.segment_mean, row.rest_mean) == (pytest.approx(ranked["v"][:37].mean()), pytest.approx(ranked["v"][37:].mean()))


def test_normal_data_pass_and_skewed_data_fail(spark):
    rng = np.random.default_rng(2)
    for n in (500, 3000):
        df = table(spark, {"a": rng.normal(5, 2, n).tolist(), "b": rng.exponential(1, n).tolist()})
        assert distribution.test_normality(df, "a").first().is_normal
        assert not distribution.test_normality(df, "b").first().is_normal


def test_moments_of_degenerate_columns(spark):
    row = distribution.eda_exploratory(table(spark, {"v": [3.0, 3.0, 3.0, 3.0]})).first()
    assert (row.skewness, row.kurtosis, row.std) == (0.0, 0.0, 0.0)
    row = distribution.eda_exploratory(table(spark, {"v": [3.0, 4.0]})).first()
    assert (row.skewness, row.kurtosis) == (None, None)


def test_outliers_of_a_constant_by_zscore(spark):
    df = table(spark, {"v": [1.0] * 10})
    assert distribution.detect_outliers(df, "v", "zscore").count() == 0
    assert distribution.outlier_summary(df, "v", "zscore").first().outlier_count == 0


def test_outlier_filter_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = distribution.detect_outliers(events, "value", "iqr")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "Or(LessThan(value" in plan


def test_anomalies_without_a_date(spark):
    df = table(spark, {"v": [1.0, 2.0, 3.0, 2.0, 1.0, 100.0, -90.0], "k": list("abcdefg")})
    rows = distribution.anomaly_explain(df, "v", context_cols=["k"]).orderBy("rank").collect()
    assert [(r.rank, r.value, r.k) for r in rows] == [(1, 100.0, "f"), (2, -90.0, "g")]


# ------------------------------------------------------------------ relations


def test_perfect_correlation(spark):
    df = table(spark, {"x": [1.0, 2, 3, 4, 5, 6], "y": [2.0, 4, 6, 8, 10, 12]})
    row = relationship.correlate(df, "x", "y").first()
    assert (row.r, row.p_value, row.strength, row.direction) == (pytest.approx(1.0), pytest.approx(0.0, abs=1e-12), "strong", "positive")
    assert relationship.correlate(df.limit(4), "x", "y").count() == 0


def test_correlation_p_value(spark):
    # r = 0.576 is the 5 % bound for 12 pairs
    rng = np.random.default_rng(5)
    x, e = rng.normal(size=12), rng.normal(size=12)
    x, e = x - x.mean(), e - e.mean()
    e = e - (e @ x) / (x @ x) * x
    y = 0.576 * x / np.linalg.norm(x) + np.sqrt(1 - 0.576**2) * e / np.linalg.norm(e)
    row = relationship.correlate(table(spark, {"x": x.tolist(), "y": y.tolist()}), "x", "y").first()
    assert row.p_value == pytest.approx(0.05, abs=2e-4)


def test_pairs_with_gaps_in_one_pass(spark):
    passes = spark.sparkContext.accumulator(0)

    def read(batches):
        yield from batches
        passes.add(1)

    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 1))
    frame = pd.DataFrame(base * rng.normal(size=200) + rng.normal(size=(600, 200)) + 1e6, columns=[f"c{k}" for k in range(200)])
    frame = frame.where(rng.random(frame.shape) > np.linspace(0, 0.6, 200))
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame)).coalesce(1)
    df = df.mapInPandas(read, df.schema)
    got = profiling.pairwise_correlation(df).toPandas()
    assert len(got) == 19_900 and passes.value == 2  # the means, and all products
    want = frame.corr()
    assert np.allclose(got["r"], [want.loc[a, b] for a, b in zip(got["column_a"], got["column_b"])], atol=1e-9)


def test_awkward_pairs(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        # far: varies by 1 at 1e9 where near is known; alone: infinite only where others are missing
        (1e9 + k if k < 50 else 0.0, float(k % 7) if k < 50 else None, inf if k == 70 else float(k), 3.0, nan if k % 2 else float(k), None, inf if k == 60 else float(k) if k > 40 else None)
        for k in range(100)
    ]
    frame = pd.DataFrame(rows, columns=["far", "near", "alone", "fixed", "odd", "none", "endless"], dtype=float)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame))
    got = {(r.column_a, r.column_b): r.r for r in profiling.pairwise_correlation(df).collect()}
    for (a, b), r in got.items():
        both = frame[[a, b]].dropna()
        with np.errstate(all="ignore"):
            want = np.nan if np.isinf(both).any(axis=None) or len(both) < 2 or (both.nunique() < 2).any() else np.corrcoef(both[a], both[b])[0, 1]
        assert (r is None) if np.isnan(want) else r == pytest.approx(want, abs=1e-9), (a, b)
    assert got["far", "near"] is not None and got["near", "alone"] is not None and got["far", "alone"] is None
    assert profiling.pairwise_correlation(df.limit(0)).where("r IS NOT NULL").count() == 0


def test_missing_patterns_of_many_columns(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({f"c{k}": np.where(rng.random(300) < 0.02 * k, np.nan, 1.0) for k in range(40)})
    frame["twin"] = frame["c30"]
    got = profiling.missing_patterns(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame))).collect()
    gone = frame.isna()
    want = {}
    partly = [c for c in frame if 0 < gone[c].sum() < 0.95 * 300]
    for i, a in enumerate(partly):
        for b in partly[i + 1 :]:
            joint = int((gone[a] & gone[b]).sum())
            if joint and max(joint / gone[a].sum(), joint / gone[b].sum()) > 0.8:
                want[a, b] = (joint, joint / gone[b].sum(), joint / gone[a].sum())
    assert {(r.column_a, r.column_b): (r.joint_missing, r.a_when_b_missing_rate, r.b_when_a_missing_rate) for r in got} == want


@pytest.mark.parametrize("few", [0, 40, 100_000])
def test_ranks_of_many_columns_in_three_writes(spark, monkeypatch, few):
    from loupe import session

    monkeypatch.setattr(relationship, "BROADCAST_RANKS", few)
    rng = np.random.default_rng(12)
    frame = pd.DataFrame({f"v{k}": rng.integers(0, 10 ** (k + 1), 400) - 5.0 for k in range(4)} | {"zero": np.where(rng.random(400) < 0.5, -0.0, 0.0), "hot": np.where(rng.random(400) < 0.4, 7.0, rng.random(400))})
    df = spark.createDataFrame(frame).repartition(3)
    with session.scope(spark):
        got = relationship.correlation_matrix(df, method="spearman").toPandas()
        assert len(session._SCOPES[-1]) == 3
    want = frame.corr("spearman")
    for r in got.itertuples():
        assert (np.isnan(r.r) and np.isnan(want.loc[r.a, r.b])) or r.r == pytest.approx(want.loc[r.a, r.b], abs=1e-12)
    ranks, n = relationship.column_ranks(df.select(*frame))
    assert n == 400 and sorted(ranks.toPandas()["hot"]) == pytest.approx(sorted(frame["hot"].rank()))
    with pytest.raises(ValueError):
        relationship.correlation_matrix(df, ["v1"], "spearman")
    assert all(r.r is None or np.isnan(r.r) for r in relationship.correlation_matrix(df.limit(0), method="spearman").collect())


def test_spearman_with_ties(spark):
    frame = pd.DataFrame({"x": [1, 2, 2, 3, 5, 5, 5, 9], "y": [3, 1, 4, 4, 4, 8, 9, 7]}).astype(float)
    row = relationship.correlate(spark.createDataFrame(frame), "x", "y", "spearman").first()
    assert row.r == pytest.approx(frame["x"].rank().corr(frame["y"].rank()))


def test_yates_correction(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 15}
    rows = [k for k, n in cells.items() for _ in range(n)]
    row = relationship.cross_stats(spark.createDataFrame(rows, ["x", "y"]), "x", "y").first()
    observed = np.array([[10, 20], [30, 15]], dtype=float)
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    assert row.chi2 == pytest.approx(((np.abs(observed - expected) - 0.5) ** 2 / expected).sum())
    assert row.dof == 1


def test_empty_cells_count(spark):
    rows = [("a", "x")] * 10 + [("b", "y")] * 6 + [("b", "z")] * 4
    df = spark.createDataFrame(rows, ["x", "y"])
    cells = {(r.x, r.y): r["count"] for r in relationship.cross_tabulate(df, "x", "y", dense=True).collect()}
    assert len(cells) == 6 and cells["a", "z"] == 0
    row = relationship.cross_stats(df, "x", "y").first()
    assert (row.chi2, row.dof, row.cramers_v) == (pytest.approx(20.0), 2, pytest.approx(1.0))
    assert row.p_value == pytest.approx(np.exp(-10))
    single = relationship.cross_stats(spark.createDataFrame([("a", "x")] * 3, ["x", "y"]), "x", "y").first()
    assert (single.chi2, single.p_value, single.cramers_v) == (0.0, 1.0, 0.0)


def test_kruskal_wallis_published_example(spark):
    groups = {"x": [2.9, 3.0, 2.5, 2.6, 3.2], "y": [3.8, 2.7, 4.0, 2.4], "z": [2.8, 3.4, 3.7, 2.2, 2.0], "few": [9.0, 9.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    row = relationship.compare_groups(spark.createDataFrame(rows, ["g", "v"]), "g", "v", "kruskal").first()
    assert (row.test, row.n_groups, row.total_n) == ("Kruskal-Wallis", 3, 14)
    assert row.statistic == pytest.approx(0.77143, abs=1e-5)
    assert row.p_value == pytest.approx(0.68, abs=1e-3)


def test_anova_identity_with_t_test(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 40)] + [("b", float(v)) for v in rng.normal(0.7, 1, 35)]
    df = spark.createDataFrame(rows, ["g", "v"])
    f = relationship.compare_groups(df, "g", "v").first()
    t = relationship.compare_pairs(df, "g", "v").first()
    assert f.test == "ANOVA" and f.statistic == pytest.approx(t.statistic**2) and f.p_value == pytest.approx(t.p_value)
    assert relationship.compare_groups(df.where("g = 'a'"), "g", "v").count() == 0


def test_too_many_groups_to_pair(spark):
    df = spark.createDataFrame([(f"g{i % 21}", float(i)) for i in range(100)], ["g", "v"])
    with pytest.raises(ValueError):
        relationship.compare_pairs(df, "g", "v", max_groups=20)


def test_constant_column_in_matrix(spark):
    df = table(spark, {"a": [1.0, 2, 3], "b": [5.0, 5, 5]})
    assert {(r.a, r.b): r.r for r in relationship.correlation_matrix(df).collect()}["a", "b"] is None


def test_components_against_svd(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 100
    found = multivariate.dimension_reduce(spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))), None, 2)
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    variance = found.variance.orderBy("component").collect()
    assert np.allclose([r.variance_explained for r in variance], (s**2 / (s**2).sum())[:2])
    loadings = found.loadings.toPandas().set_index("variable").loc[list("abcd")].to_numpy()
    assert np.allclose(np.abs(loadings), np.abs(vt[:2].T))
    assert np.allclose(np.sort(np.abs(found.scores.toPandas()["pc1"])), np.sort(np.abs(z @ vt[0])))


def test_candidates_are_fitted_like_the_result(spark, monkeypatch):
    calls, moved = [], multivariate._moved
    monkeypatch.setattr(multivariate, "_moved", lambda vectors, centres: calls.append(sorted(centres)) or moved(vectors, centres))
    df = spark.range(40).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id * id % 11 AS DOUBLE) AS y")
    found = multivariate.cluster_analysis(df, ["x", "y"])
    # every number in the same passes, which end with the last one's steps
    assert calls[0] == list(range(2, 9)) and len(calls) <= 40
    alone = multivariate.cluster_analysis(df, ["x", "y"], found.n_clusters)
    assert alone.silhouette == pytest.approx(found.silhouette) and alone.n_clusters == found.n_clusters
    assert alone.clusters.orderBy("cluster").collect() == found.clusters.orderBy("cluster").collect()


@pytest.mark.parametrize("k, steps", [(2, 40), (4, 40), (5, 1), (6, 40)])
def test_clusters_against_numpy(spark, k, steps):
    rng = np.random.default_rng(k)
    frame = pd.DataFrame(rng.normal(size=(300, 3)) * [1, 50, 0.01] + rng.integers(0, 3, (300, 1)) * [4, 100, 0.05], columns=list("abc")).assign(i=range(300))
    frame.loc[0, "a"] = np.nan
    found = multivariate.cluster_analysis(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, i long").repartition(3), list("abc"), k, ["i"], steps=steps)
    rows = found.assignments.toPandas().sort_values("i")
    clusters = found.clusters.toPandas().set_index("cluster")
    assert len(rows) == 299 and rows["cluster"].value_counts().to_dict() == clusters["size"].to_dict() and clusters["size"].is_monotonic_decreasing
    assert np.allclose(rows.groupby("cluster")[list("abc")].mean(), clusters[list("abc")], rtol=1e-9)
    known = frame.dropna()[list("abc")]
    z = ((known - known.mean()) / known.std(ddof=0)).to_numpy()
    own = rows["cluster"].to_numpy()
    square = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    shape = []
    for i in range(len(z)):
        mean = {c: square[i, own == c].sum() / ((own == c).sum() - (c == own[i])) for c in set(own) if (own == c).sum() > (c == own[i])}
        inside, outside = mean.get(own[i]), min(v for c, v in mean.items() if c != own[i])
        shape.append(0.0 if inside is None else (outside - inside) / max(outside, inside))
    assert found.silhouette == pytest.approx(np.mean(shape), abs=1e-9)
    if steps > 1:  # settled: each row is nearest to its centre
        centres = np.array([z[own == c].mean(axis=0) for c in range(k)])
        assert (((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == own).all()


def test_clusters_of_few_points(spark):
    df = spark.createDataFrame([(float(i % 2), 5.0) for i in range(20)], "x double, y double")
    found = multivariate.cluster_analysis(df, ["x", "y"], 6)
    assert found.n_clusters == 2 and found.silhouette == pytest.approx(1.0)
    same = multivariate.cluster_analysis(spark.createDataFrame([(1.0, 5.0)] * 20, "x double, y double"), ["x", "y"])
    assert same.n_clusters == 1 and same.silhouette is None and same.clusters.first()["size"] == 20


def test_clusters_start_from_different_rows(spark):
    # each point has more copies than rows are taken for the starts
    df = spark.range(6 * 2500).selectExpr("CAST(id % 6 AS DOUBLE) AS x", "CAST((id % 6) * (id % 6) AS DOUBLE) AS y")
    found = multivariate.cluster_analysis(df, ["x", "y"], 6)
    assert found.n_clusters == 6 and found.silhouette == pytest.approx(1.0)
    assert {r["size"] for r in found.clusters.collect()} == {2500}


def test_late_steps_read_few_rows(spark, monkeypatch):
    rows, moved = [], multivariate._moved

    def counted(packed, centres):
        rows.append(packed.agg(F.sum(F.length("rows") / 16)).first()[0] or 0)
        return moved(packed, centres)

    monkeypatch.setattr(multivariate, "_moved", counted)
    x = np.random.default_rng(3).uniform(size=(20_000, 2))
    found = multivariate.cluster_analysis(spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"])), ["x", "y"], 4, steps=100)
    assert rows[0] == 20_000 and max(rows[-3:]) < 5_000  # the others keep their cluster
    # the same centres as whole steps from them give
    own = found.clusters.orderBy("cluster").toPandas()
    z, centres = x / x.std(axis=0), own[["x", "y"]].to_numpy() / x.std(axis=0)
    nearest = ((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert np.abs(np.bincount(nearest, minlength=4) - own["size"].to_numpy()).max() <= 20
    means = np.array([z[nearest == c].mean(axis=0) for c in range(4)])
    assert np.abs(means - centres).max() < 1e-3


def test_clusters_of_separate_blobs(spark):
    rng = np.random.default_rng(7)
    centres = [(0, 0), (50, 0), (0, 500)]
    rows = [(i, float(x + rng.normal()), float(y + rng.normal())) for i, (x, y) in enumerate(centres) for _ in range(30 + 5 * i)]
    df = spark.createDataFrame(rows, "blob int, x double, y double")
    found = multivariate.cluster_analysis(df, ["x", "y"], keys=["blob"])
    assert found.n_clusters == 3 and found.silhouette > 0.9
    assert [r["size"] for r in found.clusters.orderBy("cluster").collect()] == [40, 35, 30]
    assert {(r.blob, r.cluster) for r in found.assignments.collect()} == {(2, 0), (1, 1), (0, 2)}


# ------------------------------------------------------------------ trends


@pytest.fixture(scope="module")
def gaps(spark):
    days = [datetime.datetime(2024, 1, 3), datetime.datetime(2024, 3, 15), datetime.datetime(2024, 8, 20)]
    return spark.createDataFrame(list(zip(days, [1.0, 2.0, 3.0])), "d timestamp, v double")


def test_period_labels(gaps):
    label = lambda f: [(str(r.period_end), r.value) for r in trend.resample_sum(gaps, "d", "v", f).orderBy("period_end").collect()]
    assert label("M") == [
        ("2024-01-31", 1.0), ("2024-02-29", 0.0), ("2024-03-31", 2.0), ("2024-04-30", 0.0),
        ("2024-05-31", 0.0), ("2024-06-30", 0.0), ("2024-07-31", 0.0), ("2024-08-31", 3.0),
    ]
    assert label("W")[0] == ("2024-01-07", 1.0)
    assert label("Q") == [("2024-03-31", 3.0), ("2024-06-30", 0.0), ("2024-09-30", 3.0)]
    assert label("Y") == [("2024-12-31", 6.0)]
    assert len(label("D")) == 231


def test_growth_over_zero(gaps):
    rows = trend.timeseries_growth(gaps, "d", "v", freq="Q").collect()
    assert [(str(r.period_end), r.growth_pct) for r in rows] == [("2024-06-30", -100.0)]
    assert trend.growth_stats(gaps, "d", "v", freq="Q").first().zero_bases == 1


def test_periods_do_not_depend_on_the_number_of_rows(spark):
    few = spark.range(20).selectExpr("date_add(DATE'2024-01-01', CAST(id * 10 AS INT)) AS d", "1.0 AS v")
    many = few.crossJoin(spark.range(6000).select())  # 120,000 rows on the same days
    for made in (trend.eda_timeseries, trend.timeseries_line, trend.timeseries_growth):
        ends = [[r.period_end for r in made(df, "d", "v").orderBy("period_end").collect()] for df in (few, many)]
        assert ends[0] == ends[1] and len(ends[0]) >= 6
    assert trend.eda_timeseries(few, "d", "v", "Q").count() == 3


def test_short_series_give_nothing(gaps):
    assert trend.timeseries_line(gaps, "d", "v").count() == 0
    assert trend.eda_timeseries(gaps, "d", "v").count() == 0
    assert trend.timeseries_decompose(gaps, "d", "v", 2).count() == 0


@pytest.mark.parametrize("window", [3, 4, 30])
def test_centred_windows(spark, window):
    n = 8 if window < 10 else 100
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + datetime.timedelta(days=i), float(i + 1)) for i in range(n)], "d timestamp, v double")
    got = trend.moving_average(df.repartition(4), "d", "v", window).orderBy("date").toPandas()["moving_avg"]
    expected = pd.Series(np.arange(1.0, n + 1)).rolling(window, center=True).mean()
    assert np.allclose(got.astype(float), expected, equal_nan=True)


def test_decomposition_adds_up(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(days=i), i + 10.0 * (i % 4)) for i in range(48)]
    df = spark.createDataFrame(rows, "d timestamp, v double")
    parts = trend.timeseries_decompose(df, "d", "v", 4).where("trend IS NOT NULL").collect()
    assert all(r.original == pytest.approx(r.trend + r.seasonal + r.residual) for r in parts)
    row = trend.decompose_stats(df, "d", "v", 4).first()
    assert (row.trend_direction, row.n_points) == ("up", 48) and row.seasonal_strength > 0.99


def test_results_do_not_depend_on_partitions(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    smooth = lambda df: trend.moving_average(df, "ts", "value", 5, ["event_id"], ["event_type"]).orderBy("event_id").collect()
    assert smooth(events.repartition(1)) == smooth(events.repartition(8))
    share = lambda df: trend.pareto_analysis(df, "value", "user_id").orderBy("rank").select("label").collect()
    assert share(events.repartition(1)) == share(events.repartition(8))


# ------------------------------------------------------------------ regression


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 5]
    y = 3 + x @ [2, -0.5, 8, 0.0] + rng.normal(size=300)
    frame = pd.DataFrame(x, columns=list("abcd")).assign(y=y, i=range(300))
    return frame, spark.createDataFrame(frame)


def test_exact_line(spark):
    df = table(spark, {"x1": [1.0, 2, 3, 4, 5], "x2": [2.0, 1, 4, 3, 7], "y": [3 + 2 * a - b for a, b in zip([1, 2, 3, 4, 5], [2, 1, 4, 3, 7])]})
    model = regression.train_linear_regression(df, ["y"], [" x1 ", "x2", ""])
    assert np.allclose([model.intercept, *model.coefficients, model.r2], [3, 2, -1, 1])
    features = {r.feature: r for r in model.feature_table().collect()}
    best = whatif.optimize(model.feature_table(), model.summary(), "max").first()
    assert best["values"] == {"x1": features["x1"].max, "x2": features["x2"].min}
    assert [r.feature for r in whatif.sensitivity(model.feature_table()).collect()] == ["x1", "x2"]
    with pytest.raises(ValueError):
        whatif.scenarios(model, {"bad": {"nope": 1.0}})


def test_near_exact_fits_keep_their_residuals(spark):
    rng = np.random.default_rng(10)
    frame = pd.DataFrame({"a": rng.normal(0, 1e4, 2000)}).assign(y=lambda f: 3 * f["a"] + rng.normal(0, 1e-5, 2000), i=range(2000))
    model = regression.train_linear_regression(spark.createDataFrame(frame), "y", ["a"], keys=["i"])
    slope, start = np.polyfit(frame["a"], frame["y"], 1)
    residuals = frame["y"] - slope * frame["a"] - start
    assert model.residual_std == pytest.approx(np.sqrt((residuals**2).sum() / 1998), rel=1e-3)
    row = regression.residual_diagnostics(model).first()
    assert row.n_outliers == (np.abs(residuals) > 3 * np.sqrt((residuals**2).sum() / 1999)).sum() and row.n_outliers < 30


def test_days_of_many_centuries(spark):
    df = spark.createDataFrame([("0001-01-03", 1.0), ("9999-12-30", 2.0)], "d string, v double").select(F.to_date("d").cast("timestamp").alias("d"), "v")
    for freq, n in (("D", 3_652_056), ("W", None), ("M", 9999 * 12), ("Q", 9999 * 4), ("Y", 9999)):
        got = trend.resample_sum(df, "d", "v", freq)
        row = got.agg(F.count("*").alias("n"), F.countDistinct("period_end").alias("ends"), F.sum("value").alias("total")).first()
        assert row.total == 3.0 and row.n == row.ends and n in (None, row.n), (freq, row)


def test_least_squares_against_numpy(sample):
    frame, df = sample
    model = regression.train_linear_regression(df, "y", list("abcd"))
    design = np.column_stack([np.ones(300), frame[list("abcd")]])
    solution, sse, *_ = np.linalg.lstsq(design, frame["y"], rcond=None)
    assert np.allclose([model.intercept, *model.coefficients], solution)
    assert model.residual_std == pytest.approx(np.sqrt(sse[0] / 295))
    residuals = frame["y"] - design @ solution
    dw = regression.durbin_watson(regression.train_linear_regression(df, "y", list("abcd"), keys=["i"]), ["i"]).first()[0]
    assert dw == pytest.approx((np.diff(residuals) ** 2).sum() / (residuals**2).sum())


def test_collinear_features(spark):
    x = np.arange(20.0)
    df = spark.createDataFrame(pd.DataFrame({"x1": x, "x2": 2 * x, "x3": np.sin(x), "y": 5 * x + np.sin(x)}))
    model = regression.train_linear_regression(df, "y", ["x1", "x2", "x3"])
    # the shortest solution of b1 + 2 b2 = 5
    assert np.allclose(model.coefficients, [1.0, 2.0, 1.0])
    inflation = {r.feature: (r.vif, r.level) for r in regression.vif(model).collect()}
    assert inflation["x1"] == inflation["x2"] == (float("inf"), "severe") and inflation["x3"][1] == "low"


def test_folds_and_split_against_refits(sample):
    frame, df = sample
    model = regression.train_linear_regression(df, "y", list("abcd"), keys=["i"])
    fit = lambda rows: np.linalg.lstsq(np.column_stack([np.ones(len(rows)), rows[list("abcd")]]), rows["y"], rcond=None)[0]

    def r2(train, test):
        guess = np.column_stack([np.ones(len(test)), test[list("abcd")]]) @ fit(train)
        return 1 - ((test["y"] - guess) ** 2).sum() / ((test["y"] - test["y"].mean()) ** 2).sum()

    folds = df.select("i", regression._share_of(model.prepared, ["i"], 42, 5).alias("f")).toPandas().sort_values("i")["f"].to_numpy()
    expected = {f: r2(frame[folds != f], frame[folds == f]) for f in range(5)}
    got = {r.fold: r.r2 for r in regression.cross_val_r2(model, keys=["i"]).collect()}
    assert got == pytest.approx(expected)
    rows = {r.model: r for r in regression.compare_models(model, keys=["i"]).collect()}
    train, test = frame[folds != 0], frame[folds == 0]
    assert rows["Linear"].r2 == pytest.approx(r2(train, test))
    z = (train[list("abcd")] - train[list("abcd")].mean()) / train[list("abcd")].std(ddof=0)
    w = np.linalg.solve(z.T @ z + np.eye(4), z.T @ train["y"])
    z_test = (test[list("abcd")] - train[list("abcd")].mean()) / train[list("abcd")].std(ddof=0)
    error = test["y"] - train["y"].mean() - z_test @ w
    assert rows["Ridge"].rmse == pytest.approx(np.sqrt((error**2).mean()))
    assert rows["Lasso"].rmse > 0


def test_lasso_conditions():
    """At the optimum the gradient is alpha on live weights and smaller on dead ones."""
    rng = np.random.default_rng(9)
    z = rng.normal(size=(500, 5))
    y = z @ [1.0, 0.05, -2.0, 0.0, 0.0] + rng.normal(size=500)
    gram, with_y = z.T @ z / 500, z.T @ y / 500
    w = regression._lasso(gram, with_y, 0.1)
    gradient = with_y - gram @ w
    assert np.allclose(gradient[w != 0], 0.1 * np.sign(w[w != 0])) and (np.abs(gradient[w == 0]) <= 0.1 + 1e-9).all()
    assert (w == 0).any() and (w != 0).any()


def test_training_checks(spark):
    df = table(spark, {"y": [None, 1.0, 2.0, 3.0], "x": ["1", "2", "bad", "4"], "t": ["a", "b", "c", "d"]}, "y double, x string, t string")
    prepared = regression.prepare_training(df, "y", ["x"])
    assert (prepared.n_dropped, prepared.n_imputed, prepared.medians) == (1, 1, [3.0])
    for target, features in (("y", ["t"]), ("t", ["x"]), ("y", []), ("nope", ["x"])):
        with pytest.raises(ValueError):
            regression.prepare_training(df, target, features)


def test_constant_target(spark):
    model = regression.train_linear_regression(table(spark, {"x": [1.0, 2, 3, 4], "y": [5.0] * 4}), "y", ["x"])
    assert (model.intercept, model.r2) == (5.0, 1.0)
    assert regression.feature_importance(model).count() == 0
    assert regression.residual_diagnostics(model).first().n_outliers == 0


def test_zero_for_missing_inputs(spark):
    model = regression.train_linear_regression(table(spark, {"x": [1.0, 2, 3, 4], "y": [3.0, 5, 7, 9]}), "y", ["x"])
    df = table(spark, {"x": [None, 10.0]}, "x double")
    assert column(whatif.predict(model, df, missing="zero"), "prediction") == pytest.approx([1.0, 21.0])


# ------------------------------------------------------------------ history, text, plans


def test_hot_key_keeps_its_latest_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t")).withColumn("k", F.when(F.col("k") == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("t").cast("string"))))
    kept = history.keep_latest_n(df, ["k"], ["t"], 5)
    assert sorted(column(kept.where("k = 'hot'"), "t")) == [2985, 2988, 2991, 2994, 2997]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_runs_collapse_to_their_last_row(spark):
    rows = [("u", i, f) for i, f in enumerate(["a", "a", None, None, "b", "a", "a"])] + [("w", 9, "a")]
    df = spark.createDataFrame(rows, "u string, t int, f string").repartition(3)
    kept = history.collapse_consecutive(df, ["u"], "f", ["t"]).collect()
    assert sorted((r.u, r.t) for r in kept) == [("u", 1), ("u", 3), ("u", 4), ("u", 6), ("w", 9)]


@pytest.mark.parametrize(
    "text, status, value",
    [
        ('{"a": 1}', "clean", 1),
        ('  {"a": 1}\n', "clean", 1),
        ('```json\n{"a": 1}\n```', "repaired", 1),
        ('Sure: {"a": 1,} and more', "repaired", 1),
        ("{'a': 1, 'b': 'x'}", "requoted", 1),
        ("{'a': 2, 'b': 'it\\'s'}", "requoted", 2),
        ("so: {'l': ['x', 'y',], a: 3}", "requoted", 3),
        ('{"a": 4, "b": "it\'s, ]"}', "clean", 4),
        ('x {"a": 5, "b": "keeps ,] and ,}",}', "repaired", 5),
        ('{"a": 1', "failed", None),
        ('{"a": 1} {"a": 2}', "failed", None),
        ("no json", "failed", None),
        (None, "failed", None),
    ],
)
def test_salvage(spark, text, status, value):
    df = spark.createDataFrame([(text,)], "t string")
    row = jsontext.salvage_json(df, "t", "a long, b string").first()
    assert row.json_status == status and (row.json.a if row.json else None) == value


def test_plan_reports_errors_and_goes_on(spark):
    df = table(spark, {"g": ["a", "b", "a"], "v": [1.0, 2.0, 3.0]})
    steps = run.run_plan(
        df,
        [
            {"function": "nope"},
            {"function": "pareto_analysis", "params": {"column": "twice", "label_col": "g", "junk": 1}},
            {"function": "correlate", "params": {"x": "v", "y": "gone"}},
            {"function": "filter_aggregate", "params": {"column": "v", "operator": "near", "threshold": 1}},
            {"function": "correlate", "params": {"x": "v"}},
        ],
        [{"name": "twice", "type": "computed", "formula": "v * 2"}],
    )
    assert [s.error is None for s in steps] == [False, True, False, False, False]
    assert column(steps[1].tables["table"].orderBy("rank"), "value") == [8.0, 4.0]
    assert run.status(df, steps).count() == 5


def test_plan_knows_all_analyses():
    from loupe.plans.analyses import ANALYSES

    assert len(ANALYSES) == 24


def test_segment_words(spark):
    from loupe.plans.analyses import segment_profile

    df = table(spark, {"m": [1.0, 2.0, 9.0], "v": [10.0, 20.0, 30.0]})
    low = segment_profile(df, "m", segment_condition="the bottom one")["table"].first()
    high = segment_profile(df, "m", segment_condition="highest")["table"].first()
    assert (low.segment_mean, low.rest_mean, high.segment_mean) == (10.0, 25.0, 30.0)


def test_auto_eda_leaves_out_what_is_absent(spark):
    parts = run.auto_eda(table(spark, {"s": ["a", "b", "a"]}))
    assert set(parts) == {"categorical"}


def test_computed_columns_never_fail(spark):
    df = spark.createDataFrame([(6, 0, 2**31 - 1, "x"), (6, 4, 2, None)], "a int, b int, `c d` int, s string")
    got = prepare.compute_column(prepare.compute_column(df, "q", "a / b + a % b"), "p", "`c d` * `c d` * 1e300 * 1e300")
    assert [(r.q, r.p) for r in got.collect()] == [(None, float("inf")), (3.5, float("inf"))]
    assert prepare.compute_column(df, "z", "a ** b").columns == df.columns
    assert prepare.compute_column(df, "z", "nope + 1").columns == df.columns


def test_nan_is_missing_everywhere(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1.0), (nan, 2.0), (nan, 3.0), (1.0, 4.0), (1.0, 5.0), (1.0, nan), (2.0, 6.0), (2.0, 7.0), (2.0, 8.0)], "k double, v double")
    assert {r.v for r in prepare.high_value(df, "v").collect()} == {7.0, 8.0}
    assert cleaning.most_frequent(df, "k") == 2.0 or cleaning.most_frequent(df, "k") == 1.0
    assert {r.value for r in distribution.describe_frequency(df, "k").collect()} == {"1.0", "2.0"}
    assert {r.label for r in distribution.analyze_composition(df, "k").collect()} == {"1.0", "2.0"}
    assert {r.group for r in relationship.group_boxplot(df, "k", "v").collect()} == {2.0}
    assert [r.k for r in prepare.majority_share(df, "k", "v", 100.0).collect()] == [2.0, 1.0]
    assert distribution.eda_exploratory(df.select(F.lit("x").alias("s"))).count() == 0


def test_scatter_takes_even_places(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    assert relationship.scatter_points(df, "x", "y").count() == 100
    xs = sorted(r.x for r in relationship.scatter_points(df, "x", "y", ["x"], limit=10).collect())
    assert len(xs) == 10 and {b - a for a, b in zip(xs, xs[1:])} == {10.0}


def test_several_models_need_keys(spark):
    features = spark.createDataFrame([("a", 2.0, 0.0, 1.0)], "feature string, coefficient double, min double, max double")
    with pytest.raises(ValueError):
        whatif.optimize(features, spark.createDataFrame([(1.0,), (2.0,)], "intercept double"))


def test_salvage_keeps_commas_in_strings(spark):
    df = spark.createDataFrame([('x {"a": 5, "b": "keeps ,] and ,}",}',)], "t string")
    assert jsontext.salvage_json(df, "t", "a long, b string").first().json.b == "keeps ,] and ,}"


def test_executed_plans_report_failures_on_the_data(spark):
    bad = F.when(F.col("id") > 3, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("double")
    df = spark.range(6).select(F.lit("x").alias("g"), bad.alias("v"), F.col("id").cast("double").alias("w"))
    actions = [{"function": "describe_frequency", "params": {"column": c}} for c in ("v", "w")]
    steps = run.run_plan(df, actions, execute=True)
    assert [s.error is None for s in steps] == [False, True] and "broken row" in steps[0].error and not steps[0].tables


def test_scopes_delete_their_copies(spark):
    import os

    from loupe import session

    with session.scope(spark):
        copy = session.durable(spark.range(10))
        path = copy.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert copy.count() == 10 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_tests_can_be_chosen(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("g"), F.pow(F.col("id").cast("double"), F.lit(1.5)).alias("v"))
    names = {t: distribution.describe_distribution(df, "v", t).first().normality_test for t in ("shapiro", "ks", "k2")}
    # the defaults are the same at every size
    for few in (df, df.limit(20), df.crossJoin(spark.range(100).withColumnRenamed("id", "j"))):
        assert distribution.describe_distribution(few, "v").first().normality_test == "Kolmogorov-Smirnov"
        assert distribution.test_normality(few, "v").first().test == "D'Agostino-Pearson"
        assert relationship.compare_groups(few, "g", "v").first().test == "ANOVA"
    assert names == {"shapiro": "Shapiro-Wilk", "ks": "Kolmogorov-Smirnov", "k2": "D'Agostino-Pearson"}
    assert distribution.test_normality(df, "v", "k2").first().test == "D'Agostino-Pearson"
    assert relationship.compare_groups(df, "g", "v", "kruskal").first().test == "Kruskal-Wallis"
    with pytest.raises(ValueError):
        relationship.compare_groups(df, "g", "v", "t")


def test_moments_of_many_columns(spark):
    from loupe.moments import moments_by

    data = np.random.default_rng(1).normal(size=(500, 70)) * 3 + 1e6
    rows = [(i % 2, *map(float, row)) for i, row in enumerate(data)]
    names = [f"c{i}" for i in range(70)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    got = moments_by(df, names, F.col("k"))
    for k in (0, 1):
        part = data[k::2]
        off = part - part.mean(axis=0)
        assert got[k].n == 250 and np.allclose(got[k].means, part.mean(axis=0)) and np.allclose(got[k].cross, off.T @ off)
