"""Order-aware primitives against brute force, with rows spread over buckets."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest

from loupe import ordered, quantiles
from loupe.functions import normal, tails
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def series(spark):
    """A hot key with a third of all rows, and runs of NULLs."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((i, key, rng.random() * 10 if rng.random() < 0.3 else None, float(rng.randrange(50))))
    rng.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["t", "k", "gap", "v"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield frame, spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "t long, k string, gap double, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_position_and_running_sum(series):
    frame, df = series
    got = ordered.with_running_sum(df, "v", ["t"]).toPandas().sort_values("t")
    want = frame.sort_values("t")
    assert got["_position"].tolist() == list(range(len(frame)))
    assert np.allclose(got["_running"], want["v"].cumsum())


def test_rows_really_span_buckets(series):
    _, df = series
    assert ordered.in_buckets(df, ["t"], ["k"]).where("k = 'hot'").select("_bucket").distinct().count() > 1


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_fill(series, forward, keys):
    frame, df = series
    got = ordered.fill_in_order(df, "gap", ["t"], keys, forward).toPandas().sort_values("t")
    want = frame.sort_values("t")
    source = want.groupby("k")["gap"] if keys else want["gap"]
    expected = source.ffill() if forward else source.bfill()
    assert np.allclose(got["gap"].astype(float), expected.astype(float), equal_nan=True)


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour(series, ahead):
    frame, df = series
    got = ordered.with_neighbour(df, ["t"], ["t"], ["k"], ahead).select("t", F.col("_neighbour.t").alias("n")).toPandas()
    got = got.sort_values("t")
    want = frame.sort_values("t")
    expected = want.groupby("k")["t"].shift(-1 if ahead else 1)
    assert np.allclose(got["n"].astype(float), expected.astype(float), equal_nan=True)


@pytest.mark.parametrize("halo", [65_536, 4])
@pytest.mark.parametrize("width", [1, 4, 20, 61])
def test_frame_sum(series, width, halo):
    frame, df = series
    after = (width - 1) // 2
    positioned = ordered.with_position(df, ["t"], ["k"])
    got = ordered.with_frame_sum(positioned, "v", width - 1 - after, after, ["k"], halo_rows=halo).toPandas()
    got = got.sort_values("t")
    want = frame.sort_values("t")
    expected = want.groupby("k")["v"].transform(lambda s: s.rolling(width, center=True).sum())
    assert np.allclose(got["_frame_sum"].astype(float), expected.astype(float), equal_nan=True)


@pytest.mark.parametrize("width", [17, 5000])
@pytest.mark.parametrize("halo", [65_536, 40])
def test_a_spike_stays_in_its_own_frames(spark, width, halo):
    values = [1.0] * 12_000
    values[5], values[11_000] = 1e18, float("inf")
    df = spark.createDataFrame(list(enumerate(values)), "t long, v double")
    after = (width - 1) // 2
    sums = ordered.with_frame_sum(ordered.with_position(df, ["t"]), "v", width - 1 - after, after, halo_rows=halo)
    got = {r.t: r._frame_sum for r in sums.where("t between 5200 and 5800").collect()}
    assert set(got.values()) == {float(width)}
    assert {r._frame_sum for r in sums.where("t = 11000").collect()} == {float("inf") if 11_000 + after < 12_000 else None}


def test_backward_fill_is_linear(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 20_000 == 19_999, F.col("id").cast("double")).alias("v"))
    filled = ordered.fill_in_order(df, "v", ["id"], forward=False)
    assert filled.where(F.col("v") != F.floor(F.col("id") / 20_000) * 20_000 + 19_999).count() == 0
    assert filled.where("v IS NULL").count() == 0


def test_nan_is_filled_in_order(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, float("nan")), (3, None), (4, 5.0)], "t long, v double")
    for forward, want in ((True, [None, 2.0, 2.0, 2.0, 5.0]), (False, [2.0, 2.0, 5.0, 5.0, 5.0])):
        rows = ordered.fill_in_order(df, "v", ["t"], forward=forward).orderBy("t").collect()
        assert [r.v for r in rows] == want


def test_quantiles_of_infinite_values(spark):
    inf = float("inf")
    values = [float(i) for i in range(500)] + [inf] * 20 + [-inf] * 5 + [1e308, -1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.99, 1.0]
    few = quantiles.column_quantiles(df, ["v"], probs)["v"]
    assert few == [r if abs(r) < inf else r for r in df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]]
    assert few[0] == -inf and few[-1] == inf and few[3] == 257.0


def test_column_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.lognormal(0, 6, 3000), "b": np.repeat([1.0, 2.0, 3.0], 1000)})
    df = spark.createDataFrame(frame)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.column_quantiles(df, ["a", "b"], probs)
    for c in frame:
        assert np.allclose(got[c], np.quantile(frame[c], probs), rtol=1e-12)


def awkward_columns(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "normal": rng.normal(1e9, 1e-3, n), "ties": rng.integers(0, 4, n).astype(float), "heavy": rng.standard_cauchy(n) ** 3, "one": np.full(n, 2.5),
        "holes": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)), "none": np.full(n, np.nan), "spike": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(1, n)),
    })


@pytest.mark.parametrize("n, slices", [(1, 4096), (2, 4096), (7, 4096), (150, 8), (2000, 4096), (50_000, 16), (50_000, 4096)])
def test_quantiles_by_sketch_and_count(spark, monkeypatch, n, slices):
    monkeypatch.setattr(quantiles, "_SLICES", slices)
    frame, probs = awkward_columns(n, n + slices), [0.0, 0.0001, 0.01, 0.25, 0.5, 0.5001, 0.75, 0.99, 1.0]
    got = quantiles.column_quantiles(spark.createDataFrame(frame).repartition(4), list(frame), probs)
    for c in frame:
        known = frame[c].dropna()
        assert got[c] == ([None] * len(probs) if known.empty else pytest.approx(np.quantile(known, probs).tolist(), rel=1e-12)), c


def test_a_wrong_sketch_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, shares, accuracy: F.transform(shares, lambda s: s * 0 + F.max(c)))
    frame = awkward_columns(3000, 5)[["normal", "spike"]]
    got = quantiles.column_quantiles(spark.createDataFrame(frame), list(frame), [0.25, 0.5])
    assert all(got[c] == pytest.approx(np.quantile(frame[c], [0.25, 0.5]).tolist(), rel=1e-12) for c in frame)
    df = spark.createDataFrame(frame.assign(k=np.arange(3000) % 2))
    found = quantiles.group_quantiles(df, ["k"], "spike", [0.5], ["m"]).toPandas().set_index("k")["m"]
    assert np.allclose(found.loc[[0, 1]], [frame["spike"][0::2].median(), frame["spike"][1::2].median()])


@pytest.mark.parametrize("buckets", [None, 7])
def test_fills_of_several_columns_share_a_run(series, monkeypatch, spark, buckets):
    from loupe import session
    from loupe.operators import cleaning

    frame, df = series
    monkeypatch.setattr(ordered, "_buckets", lambda df: buckets)
    wide = df.withColumns({"b": F.when(F.col("t") % 7 == 0, F.col("v")), "c": F.when(F.col("t") % 11 < 2, F.col("k")), "none": F.lit(None).cast("int")})
    names, ahead = ["gap", "b", "c", "none"], [True, False, True, False]
    for keys in ([], ["k"]):
        with session.scope(spark):
            got = ordered.fill_in_order(wide, names, ["t"], keys, ahead)
            assert len(session._SCOPES[-1]) == 1
            plan = got._jdf.queryExecution().executedPlan().toString()
            # by bucket for the windows, and small ones for a row per bucket
            assert sum("hashpartitioning(_bucket" in line and "Aggregate" not in line for line in plan.splitlines()) <= 4
            found = got.toPandas().sort_values("t", ignore_index=True)
        want = wide.toPandas().sort_values("t", ignore_index=True)
        for c, on in zip(names, ahead):
            part = want.groupby("k")[c] if keys else want[c]
            expected = part.ffill() if on else part.bfill()
            assert [None if pd.isna(x) else x for x in found[c]] == [None if pd.isna(x) else x for x in expected], (c, keys)
    both = cleaning.fill_missing(wide, ["gap", "b", "nowhere"], "forward", order_by=["t"]).toPandas().sort_values("t", ignore_index=True)
    assert both["gap"].isna().sum() == want["gap"].ffill().isna().sum() and both["b"].isna().sum() == want["b"].ffill().isna().sum()
    filled = cleaning.fill_missing(wide, ["gap", "b"], "custom", 0.0).select("gap", "b").toPandas()
    assert not filled.isna().any(axis=None)


def test_buckets_follow_the_files(spark, tmp_path, monkeypatch):
    spark.range(5000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert ordered._buckets(df) is None and ordered._buckets(spark.range(10)) is None and ordered._buckets(df.join(df.withColumnRenamed("id", "j"))) is None
    monkeypatch.setattr(ordered, "BUCKET_BYTES", 500)
    n = ordered._buckets(df)
    assert n > 8
    placed = ordered.with_position(df, [F.desc("id")])
    assert placed.where(F.col("id") + F.col(ordered.POSITION) != 4999).count() == 0


def test_two_passes_over_the_data(spark):
    passes = spark.sparkContext.accumulator(0)

    def read(batches):
        yield from batches
        passes.add(1)

    rng = np.random.default_rng(8)
    frame = pd.DataFrame({f"c{k}": rng.integers(0, 50, 30_000).astype(float) for k in range(3)})
    df = spark.createDataFrame(frame).coalesce(1).mapInPandas(read, "c0 double, c1 double, c2 double")
    got = quantiles.column_quantiles(df, list(frame), [0.25, 0.5, 0.75])
    assert passes.value == 2 and all(got[c] == np.quantile(frame[c], [0.25, 0.5, 0.75]).tolist() for c in frame)


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"k": np.where(rng.random(9000) < 0.3, 0, rng.integers(0, 700, 9000)), "v": rng.lognormal(0, 4, 9000)})
    frame.loc[frame["k"] == 5, "v"] = np.nan
    expected = frame.groupby("k")["v"].quantile([0.1, 0.5, 0.9]).unstack().dropna()
    got = quantiles.group_quantiles(spark.createDataFrame(frame).repartition(3), ["k"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"]).toPandas().set_index("k")
    assert sorted(got.index) == sorted(expected.index)
    assert np.allclose(got.loc[expected.index], expected, rtol=1e-12)


def test_group_quantiles(series):
    frame, df = series
    expected = frame.groupby("k")["v"].quantile([0.25, 0.5]).unstack()
    got = quantiles.group_quantiles(df, ["k"], "v", [0.25, 0.5], ["a", "b"]).toPandas()
    got = got.set_index("k").loc[expected.index]
    assert np.allclose(got["a"], expected[0.25]) and np.allclose(got["b"], expected[0.5])


def test_normal_expressions(spark):
    points = [1e-12, 0.001, 0.02, 0.024, 0.3, 0.5, 0.77, 0.98, 0.9999, 1 - 1e-9]
    exact = statistics.NormalDist()
    df = spark.createDataFrame([(p, exact.inv_cdf(p)) for p in points], "p double, z double")
    for row in df.select("p", "z", normal.normal_ppf(F.col("p")).alias("ppf"), normal.normal_cdf(F.col("z")).alias("cdf")).collect():
        assert row.ppf == pytest.approx(row.z, rel=1e-9, abs=1e-12)
        assert row.cdf == pytest.approx(row.p, rel=1e-8)


def test_tails_against_published_tables(spark):
    assert tails.t_tail(2.228, 10) == pytest.approx(0.05, abs=2e-5)
    assert tails.t_tail(1.96, 1e7) == pytest.approx(0.0499958, abs=1e-6)
    assert tails.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-7)
    assert tails.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert tails.chi2_tail(2.0, 2) == pytest.approx(np.exp(-1), rel=1e-12)
    assert tails.f_tail(4.256495, 2, 9) == pytest.approx(0.05, abs=1e-6)
    assert tails.kolmogorov_tail(1.3581 / 1000, 1e6) == pytest.approx(0.05, abs=1e-4)
    df = spark.createDataFrame([(2.228, 10.0), (None, 3.0)], "t double, d double")
    assert [r[0] for r in df.select(tails.t_p(F.col("t"), F.col("d"))).collect()] == [pytest.approx(0.05, abs=2e-5), None]


def test_first_rows_beyond_the_window_limit(series, spark):
    frame, df = series
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        got = ordered.first_rows(df, ["k"], [F.col("t").desc()], 7).select("k", "t", "rank").toPandas()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    want = frame.sort_values("t", ascending=False).assign(rank=lambda f: f.groupby("k").cumcount() + 1)
    want = want[want["rank"] <= 7][["k", "t", "rank"]]
    key = ["k", "t"]
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()


def test_every_step_of_a_frequent_value(spark):
    values = [1.0] * 400 + [0.5] * 3 + [2.0] * 5 + [float(i) for i in range(3, 60)]
    got = ordered.at_steps(spark.createDataFrame([(v,) for v in values], ["v"]), "v", 7).orderBy("position").collect()
    assert [r.value for r in got] == sorted(values)[::7]


def test_equal_order_keys_span_buckets(series):
    _, df = series
    tied = df.withColumn("same", F.lit(1))
    assert ordered.in_buckets(tied, ["same"]).select("_bucket").distinct().count() > 1


def test_hot_key_and_equal_order_are_spread_evenly(spark):
    df = spark.range(40_000, numPartitions=8).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("same")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for bucketed in (ordered.in_buckets(df, ["id"], ["k"]), ordered.in_buckets(df, ["same"])):
            sizes = [r["count"] for r in bucketed.groupBy("_bucket").count().collect()]
            assert len(sizes) >= 6 and max(sizes) < 40_000 / 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
