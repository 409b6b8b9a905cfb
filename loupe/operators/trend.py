"""Time series, rankings and Pareto analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loupe.frames import attach_row, col, number, require, share
from loupe.functions.coerce import to_moment
from loupe.ordered import POSITION, first_rows, with_frame_sum, with_position, with_running_sum

#: period -> unit to truncate to, step between starts, days or months to the label
_STEP = {"D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}
_UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def _series(df: DataFrame, date_col: str, metric: str, extra: Sequence[str] = ()) -> DataFrame:
    """Columns d (timestamp), v (number) and the extra ones, rows with both known."""
    require(df, date_col, metric, *extra)
    moment = to_moment(col(date_col), df.schema[date_col].dataType)
    kept = df.select(moment.alias("d"), number(metric).alias("v"), *[col(c) for c in extra])
    return kept.where(F.col("d").isNotNull() & F.col("v").isNotNull())


#: periods that are listed in one row
_STRETCH = 4096


def _period_end(start: Column, freq: str) -> Column:
    if freq == "D":
        return start
    if freq == "W":
        return F.date_add(start, 6)
    months = {"M": 0, "Q": 2, "Y": 11}[freq]
    return F.last_day(F.add_months(start, months))


def _resample(series: DataFrame, freq: str) -> DataFrame:
    """(start, period_end, value): sums per period, gaps filled with 0."""
    if freq not in _UNIT:
        raise ValueError(f"unknown frequency {freq!r}; use one of {list(_UNIT)}")
    start = F.to_date(F.date_trunc(_UNIT[freq], "d"))
    sums = series.groupBy(start.alias("start")).agg(F.sum("v").alias("total"))
    step = F.expr(f"INTERVAL {_STEP[freq]}")
    span = sums.agg(F.min("start").alias("a"), F.max("start").alias("b")).where(F.col("a").isNotNull())
    # stretches of so many periods, so that no row holds millions
    least = {"D": 1, "W": 7, "M": 28, "Q": 90, "Y": 365}[freq]
    parts = span.select("b", "a", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("b", "a") / (least * _STRETCH)).cast("int"))).alias("part"))
    after = lambda n: F.date_add("a", n * least) if freq in "DW" else F.add_months("a", n * {"M": 1, "Q": 3, "Y": 12}[freq])
    low, high = after(F.col("part") * _STRETCH), after((F.col("part") + 1) * _STRETCH - 1)
    spine = parts.where(low <= F.col("b")).select(F.explode(F.sequence(low, F.least(high, F.col("b")), step)).alias("start"))
    return spine.join(sums, "start", "left").select(
        "start", _period_end(F.col("start"), freq).alias("period_end"), F.coalesce("total", F.lit(0.0)).alias("value")
    )


def resample_sum(df: DataFrame, date_col: str, metric: str, freq: str = "M") -> DataFrame:
    """(period_end, value): sums per day, week (to Sunday), month, quarter or year."""
    return _resample(_series(df, date_col, metric), freq).drop("start")


def _auto(series: DataFrame, limits: Sequence[tuple[int, str]], last: str) -> str:
    """By the days that the dates span, however many rows there are."""
    days = series.agg(F.date_diff(F.max("d"), F.min("d"))).first()[0] or 0
    return next((f for below, f in limits if days < below), last)


def timeseries_line(df: DataFrame, date_col: str, metric: str, freq: str = "auto") -> DataFrame:
    """(period_end, value) if there are five rows; D where the dates span fewer than 60 days, W 500, M 5000, else Q."""
    series = _series(df, date_col, metric)
    if freq == "auto":
        freq = _auto(series, [(60, "D"), (500, "W"), (5000, "M")], "Q")
    periods = _resample(series, freq).drop("start")
    return periods if len(series.take(5)) == 5 else periods.where(F.lit(False))


def timeseries_stats(df: DataFrame, date_col: str, metric: str, freq: str = "auto") -> DataFrame:
    """One row: periods, total, mean, min, max, std, and the slope per period."""
    periods = timeseries_line(df, date_col, metric, freq)
    # one row per period: bounded by the calendar
    numbered = periods.withColumn("i", F.row_number().over(W.orderBy("period_end")) - 1)
    return numbered.agg(
        F.count("*").alias("n_periods"), F.sum("value").alias("total"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.stddev("value").alias("std"),
        F.regr_slope("value", F.col("i").cast("double")).alias("trend_slope"),
    ).withColumn(
        "trend",
        F.when(F.col("trend_slope") > 0, "up").when(F.col("trend_slope") < 0, "down").otherwise("flat"),
    )


def eda_timeseries(df: DataFrame, date_col: str, metric: str, freq: str = "M") -> DataFrame:
    """Sums per period, monthly by default; more than 10 rows needed."""
    series = _series(df, date_col, metric)
    periods = _resample(series, freq).drop("start")
    return periods if len(series.take(11)) == 11 else periods.where(F.lit(False))


def _growth(df: DataFrame, date_col: str, metric: str, mode: str, freq: str | None) -> DataFrame:
    series = _series(df, date_col, metric)
    if mode == "yoy":
        freq = "Y"
    elif freq is None:
        freq = _auto(series, [(500, "M")], "Q")
    before = F.lag("value").over(W.orderBy("period_end"))  # one row per period
    periods = _resample(series, freq).select("period_end", "value", before.alias("base"))
    return periods.withColumn("growth", F.try_divide(F.col("value") - F.col("base"), F.col("base")))


def timeseries_growth(df: DataFrame, date_col: str, metric: str, mode: str = "auto", freq: str | None = None) -> DataFrame:
    """(period_end, value, growth_pct) against the period before; yearly for ``yoy``.

    Months where the dates span fewer than 500 days, else quarters.  A zero base has no growth rate.
    """
    growth = _growth(df, date_col, metric, mode, freq)
    return growth.where(F.col("growth").isNotNull()).select("period_end", "value", (F.col("growth") * 100).alias("growth_pct"))


def growth_stats(df: DataFrame, date_col: str, metric: str, mode: str = "auto", freq: str | None = None) -> DataFrame:
    """One row: mean, std, positive and negative periods, volatility, zero bases."""
    g = F.col("growth")
    return _growth(df, date_col, metric, mode, freq).agg(
        (F.avg(g) * 100).alias("mean_growth"),
        (F.stddev(g) * 100).alias("std_growth"),
        F.count_if(g > 0).alias("positive_periods"),
        F.count_if(g < 0).alias("negative_periods"),
        (F.stddev(g) / F.greatest(F.abs(F.avg(g)), F.lit(1e-10))).alias("volatility"),
        F.count_if(F.col("base") == 0).alias("zero_bases"),
    )


def fast_growth(df: DataFrame, date_col: str, metric: str, freq: str = "M", k: float = 1.0) -> DataFrame:
    """Periods that grew by more than the mean growth plus one std."""
    growth = timeseries_growth(df, date_col, metric, "mom", freq)
    bound = growth.agg((F.avg("growth_pct") + k * F.stddev("growth_pct")).alias("_bound"))
    return attach_row(growth, bound).where(F.col("growth_pct") > F.col("_bound")).drop("_bound")


def _row_order(tie_by: Sequence[str]) -> list:
    return ["d", *tie_by, "v"]


def moving_average(
    df: DataFrame, date_col: str, metric: str, window: int = 7, tie_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """(keys, date, ties, original, moving_avg): centred mean of ``window`` rows in date order.

    NULL where the window is not full.  For an even window the extra row lies
    before.  A window of 0 asks for a twentieth of the rows, 3 at least.  ``tie_by`` orders
    rows of one date, the value itself what is left; ``partition_by`` smooths
    each series alone.
    """
    series = _series(df, date_col, metric, [*partition_by, *tie_by])
    if window <= 0:
        window = max(3, series.count() // 20)
    after = (window - 1) // 2
    placed = with_position(series, _row_order(tie_by), partition_by)
    summed = with_frame_sum(placed, "v", window - 1 - after, after, partition_by)
    return summed.select(
        *[col(c) for c in partition_by], F.col("d").alias("date"), *[col(c) for c in tie_by],
        F.col("v").alias("original"), (F.col("_frame_sum") / window).alias("moving_avg"),
    )


def decomposed(df: DataFrame, date_col: str, metric: str, period: int, tie_by: Sequence[str], partition_by: Sequence[str], freq: str | None) -> DataFrame:
    """The series in order with trend, season and residual; the sorted rows are written once."""
    if freq is not None:
        if partition_by:
            raise ValueError("resampling works on one series")
        series, tie_by = _resample(_series(df, date_col, metric), freq).select(F.col("period_end").cast("timestamp").alias("d"), F.col("value").alias("v")), ()
    else:
        series = _series(df, date_col, metric, [*partition_by, *tie_by])
    placed = with_position(series, _row_order(tie_by), partition_by)
    keys = [col(c) for c in partition_by]
    spans = placed.groupBy(*keys).agg(F.min(POSITION).alias("_first"), F.count("*").alias("_rows"))
    after = (period - 1) // 2
    smooth = with_frame_sum(placed, "v", period - 1 - after, after, partition_by)
    joined = smooth.join(spans, list(partition_by)) if partition_by else attach_row(smooth, spans)
    phased = (
        joined.where(F.col("_rows") >= 2 * period)
        .withColumn("phase", (F.col(POSITION) - F.col("_first")) % period)
        .withColumn("trend", F.col("_frame_sum") / period)
        .withColumn("_detrended", F.col("v") - F.col("trend"))
    )
    by_phase = phased.groupBy(*keys, "phase").agg(F.avg("_detrended").alias("seasonal"))
    if not partition_by:
        by_phase = F.broadcast(by_phase)  # one row per phase
    return phased.join(by_phase, [*partition_by, "phase"]).withColumn("residual", F.col("_detrended") - F.col("seasonal"))


def timeseries_decompose(
    df: DataFrame, date_col: str, metric: str, period: int = 12, tie_by: Sequence[str] = (),
    partition_by: Sequence[str] = (), freq: str | None = None, parts: DataFrame | None = None,
) -> DataFrame:
    """(keys, date, ties, original, trend, seasonal, residual) of rows in date order.

    The trend is a centred moving average, the season the mean distance from it
    at each place of the period.  ``freq`` sums the rows per period of time
    first.  A series shorter than two periods gives no rows.  ``parts`` are
    those of :func:`decomposed` if they are known.
    """
    parts = parts if parts is not None else decomposed(df, date_col, metric, period, tie_by, partition_by, freq)
    return parts.select(
        *[col(c) for c in partition_by], F.col("d").alias("date"), *[col(c) for c in (() if freq else tie_by)],
        F.col("v").alias("original"), "trend", "seasonal", "residual",
    )


def decompose_stats(
    df: DataFrame, date_col: str, metric: str, period: int = 12, tie_by: Sequence[str] = (),
    partition_by: Sequence[str] = (), freq: str | None = None, parts: DataFrame | None = None,
) -> DataFrame:
    """One row per series: strength of the season and direction of the trend.

    The direction compares the first and last known trend.  ``parts`` are those
    of :func:`decomposed` if they are known.
    """
    parts = parts if parts is not None else decomposed(df, date_col, metric, period, tie_by, partition_by, freq)
    place = F.when(F.col("trend").isNotNull(), F.col(POSITION))
    keys = [col(c) for c in partition_by]
    grouped = parts.groupBy(*keys) if keys else parts.groupBy()
    return grouped.agg(
        F.count("*").alias("n_points"), F.var_pop("seasonal").alias("_s"), F.var_pop("residual").alias("_r"),
        F.min_by("trend", place).alias("_first"), F.max_by("trend", place).alias("_last"),
    ).where(F.col("n_points") > 0).select(
        *keys,
        F.coalesce(F.try_divide(F.col("_s"), F.col("_s") + F.col("_r")), F.lit(0.0)).alias("seasonal_strength"),
        F.when(F.col("_last") > F.col("_first"), "up").otherwise("down").alias("trend_direction"),
        F.lit(period).alias("period"),
        "n_points",
    )


# ------------------------------------------------------------------ rankings


def _label_sums(df: DataFrame, column: str, *labels: str) -> DataFrame:
    require(df, column, *labels)
    return df.na.drop(subset=list(labels)).groupBy(*[col(c).alias(f"l{i}") for i, c in enumerate(labels)]).agg(
        F.coalesce(F.sum(number(column)), F.lit(0.0)).alias("value")
    )


def rank_top_n(df: DataFrame, column: str, label_col: str, n: int = 10, group_col: str | None = None) -> DataFrame:
    """(rank, label, value, pct, cum_pct): the labels with the largest sums.

    Shares are of the column's total.  With ``group_col`` each group gets its
    own top n, with shares of the group's total.
    """
    if group_col is None:
        top = _label_sums(df, column, label_col).orderBy(F.desc("value"), F.asc("l0")).limit(n)
        order = W.orderBy(F.desc("value"), F.asc("l0"))  # over those n rows
        total = df.agg(F.sum(number(column)).alias("total"))
        ranked = attach_row(top, total)
        group = []
    else:
        sums = _label_sums(df, column, group_col, label_col).withColumnRenamed("l0", "group").withColumnRenamed("l1", "l0")
        order = W.partitionBy("group").orderBy(F.desc("value"), F.asc("l0"))
        top = first_rows(sums, ["group"], [F.desc("value"), F.asc("l0")], n)
        ranked = top.join(sums.groupBy("group").agg(F.sum("value").alias("total")), "group")
        group = ["group"]
    return ranked.select(
        *group,
        F.row_number().over(order).alias("rank"),
        F.col("l0").cast("string").alias("label"),
        "value",
        share(F.col("value"), F.col("total")).alias("pct"),
        share(F.sum("value").over(order.rowsBetween(W.unboundedPreceding, 0)), F.col("total")).alias("cum_pct"),
    )


def rank_stats(df: DataFrame, column: str, label_col: str, n: int = 10) -> DataFrame:
    """One row: shares of the top 1, 3 and n."""
    top = rank_top_n(df, column, label_col, n)
    upto = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("pct")))
    return top.agg(
        upto(1).alias("top1_pct"), upto(3).alias("top3_pct"), F.sum("pct").alias("top_n_pct"), F.count("*").alias("total_items")
    )


def _pareto(df: DataFrame, column: str, label_col: str) -> DataFrame:
    sums = _label_sums(df, column, label_col)
    ranked = with_running_sum(sums, "value", [F.desc("value"), F.asc("l0")])
    whole = sums.agg(F.sum("value").alias("total"), F.count("*").alias("items"))
    return attach_row(ranked, whole).select(
        (F.col(POSITION) + 1).alias("rank"), F.col("l0").cast("string").alias("label"), "value",
        share(F.col("_running"), F.col("total")).alias("cum_pct"), "items", "total", "_running",
    )


def pareto_analysis(df: DataFrame, column: str, label_col: str) -> DataFrame:
    """(rank, label, value, cum_pct) of every label, largest sum first."""
    return _pareto(df, column, label_col).select("rank", "label", "value", "cum_pct")


def pareto_stats(df: DataFrame, column: str, label_col: str) -> DataFrame:
    """One row: labels, share of them needed for 80 %, share held by the top fifth."""
    cum = F.round("cum_pct", 2)
    fifth = F.greatest(F.floor(F.col("items") / 5), F.lit(1))
    row = _pareto(df, column, label_col).groupBy("items", "total").agg(
        F.min(F.when(cum >= 80, F.col("rank"))).alias("cutoff"),
        F.max(F.when(F.col("rank") == fifth, F.col("_running"))).alias("held"),
        F.max(F.when(F.col("rank") == fifth, cum)).alias("fifth_pct"),
    )
    return row.select(
        F.col("items").alias("total_items"),
        F.coalesce("cutoff", F.col("items") + 1).alias("cutoff_rank"),
        share(F.coalesce("cutoff", F.col("items") + 1), F.col("items")).alias("pareto_ratio"),
        share(F.col("held"), F.col("total")).alias("top_20_pct"),
        (F.col("fifth_pct") >= 80).alias("is_pareto"),
    )
