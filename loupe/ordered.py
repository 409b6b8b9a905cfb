"""Order-aware operations without a single-task window.

``Window.orderBy`` with no partition pulls every row into one task, and a
window per key does the same for a key that holds much of the table.  Here
rows are range-partitioned by (keys, order), each row is tagged with its
bucket and its place there, and the tagged table is written once.  Whatever
crosses a bucket's edge (row counts, sums, the last value seen) is carried
over a table with one row per bucket, so its size is bounded by the number of
shuffle partitions and it can be broadcast.  A hot key simply spans several
buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from loupe.frames import col, known_value
from loupe.session import durable

BUCKET, PLACE, POSITION = "_bucket", "_place", "_position"
#: monotonically_increasing_id() keeps the partition above this many bits
_ID_BITS = 33
#: bytes of the files read that a bucket should hold
BUCKET_BYTES = 128 << 20
#: frames up to this many rows are computed with copied edge rows
HALO_ROWS = 65_536
#: rows of a block of which wider frames are put together
_BLOCK_ROWS = 4096

Sort = Sequence[str | Column]


def sort_columns(sort: Sort) -> list[Column]:
    return [col(s) if isinstance(s, str) else s for s in sort]


def in_buckets(df: DataFrame, sort: Sort, keys: Sequence[str] = ()) -> DataFrame:
    """Sort the table across buckets; adds ``_bucket`` and ``_place``."""
    order = [col(k) for k in keys] + sort_columns(sort)
    if not sort:
        raise ValueError("an order is needed: rows of a DataFrame have none of their own")
    order.append(_tie_breaker(df))
    tag = F.monotonically_increasing_id()
    buckets = _buckets(df)
    ranged = df.repartitionByRange(*order) if buckets is None else df.repartitionByRange(buckets, *order)
    tagged = ranged.sortWithinPartitions(*order).withColumn("_tag", tag)
    return durable(
        tagged.withColumn(BUCKET, F.shiftright("_tag", _ID_BITS))
        .withColumn(PLACE, F.col("_tag").bitwiseAND(F.lit((1 << _ID_BITS) - 1)))
        .drop("_tag")
    )


def _buckets(df: DataFrame) -> int | None:
    """How many buckets the tables read need, if the session's shuffle partitions would be too large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    wanted = sum(s for s in sizes if s < 1 << 62) // BUCKET_BYTES  # what isn't known says the most
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _tie_breaker(df: DataFrame) -> Column:
    """A hash of the row: equal keys get a fixed order and may span buckets.

    Only copies of a whole row stay together.
    """
    return F.xxhash64(*[col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def _earlier() -> W:
    """All earlier buckets; runs on one row per bucket."""
    return W.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)


def _join_buckets(bucketed: DataFrame, per_bucket: DataFrame) -> DataFrame:
    return bucketed.join(F.broadcast(per_bucket), BUCKET)


def _edge_rows(bucketed: DataFrame, place: Column, row: Column) -> DataFrame:
    """(bucket, _edge) for every bucket: the row at the place the aggregate picks, or NULL."""
    places = bucketed.groupBy(BUCKET).agg(place.alias(PLACE))  # one row per bucket
    rows = bucketed.join(F.broadcast(places), [BUCKET, PLACE], "left_semi").select(BUCKET, row.alias("_edge"))
    return places.select(BUCKET).join(F.broadcast(rows), BUCKET, "left")


def _with_position(bucketed: DataFrame) -> DataFrame:
    starts = bucketed.groupBy(BUCKET).agg(F.count("*").alias("_rows")).select(
        BUCKET, F.coalesce(F.sum("_rows").over(_earlier()), F.lit(0)).alias("_start")
    )
    return _join_buckets(bucketed, starts).withColumn(POSITION, F.col("_start") + F.col(PLACE)).drop("_start")


def with_position(df: DataFrame, sort: Sort, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``_position``, the 0-based place of each row in the whole order."""
    return _with_position(in_buckets(df, sort, keys)).drop(BUCKET, PLACE)


def first_rows(df: DataFrame, keys: Sequence[str], sort: Sort, n: int) -> DataFrame:
    """The first n rows of each key, with ``rank``.

    Below Spark's limit for it (1000 by default), tasks rank their own rows and
    pass on n per key.  Beyond, ranks come from positions in the whole order.
    """
    if n < int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        order = W.partitionBy(*[col(k) for k in keys]).orderBy(*sort_columns(sort))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    placed = with_position(df, sort, keys)
    starts = placed.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(POSITION).alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= col(k).eqNullSafe(F.col(f"_k{i}"))
    rank = (F.col(POSITION) - F.col("_first") + 1).alias("rank")
    return placed.join(starts, same).select(*[col(c) for c in df.columns], rank).where(F.col("rank") <= n)


def at_steps(values: DataFrame, value: str, step: int) -> DataFrame:
    """(position, value) of every step-th value in sorted order.

    Equal values are counted once, so a frequent value costs one row.
    """
    counted = values.groupBy(col(value).alias("value")).agg(F.count("*").alias("_n"))
    ranked = with_running_sum(counted, "_n", ["value"])
    first = F.ceil((F.col("_running") - F.col("_n")) / step) * step
    covered = ranked.where(first < F.col("_running"))
    return covered.select(F.explode(F.sequence(first, F.col("_running") - 1, F.lit(step).cast("long"))).alias("position"), "value")


def with_running_sum(df: DataFrame, value: str, sort: Sort, name: str = "_running") -> DataFrame:
    """Add ``_position`` and the running sum of ``value`` up to each row."""
    bucketed = in_buckets(df, sort)
    local = W.partitionBy(BUCKET).orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0)
    totals = bucketed.groupBy(BUCKET).agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows")).select(
        BUCKET,
        F.coalesce(F.sum("_sum").over(_earlier()), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(_earlier()), F.lit(0)).alias("_start"),
    )
    summed = bucketed.withColumn(name, F.sum(value).over(local))
    return (
        _join_buckets(summed, totals)
        .withColumn(name, F.col(name) + F.col("_sum_before"))
        .withColumn(POSITION, F.col("_start") + F.col(PLACE))
        .drop("_sum_before", "_start", BUCKET, PLACE)
    )


def fill_in_order(
    df: DataFrame, column: str | Sequence[str], sort: Sort, keys: Sequence[str] = (), forward: bool | Sequence[bool] = True
) -> DataFrame:
    """Replace NULLs, and NaN, by the last (or next) known value of the same key.

    Several columns, each with its own direction, are filled in one sorted run
    that is written once.
    """
    columns = [column] if isinstance(column, str) else list(column)
    ahead = [forward] * len(columns) if isinstance(forward, bool) else list(forward)
    bucketed = in_buckets(df.withColumns({c: known_value(df, c) for c in columns}), sort, keys)
    here = F.struct(F.lit(1), *[col(k) for k in keys])
    partition = [BUCKET, *[col(k) for k in keys]]
    until = lambda order: W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    # the last known one, backwards read backwards: a frame to the table's end would be read anew for every row
    onwards, backwards = until(F.asc(PLACE)), until(F.desc(PLACE))
    near = {f"_near{i}": F.last(col(c), ignorenulls=True).over(onwards if on else backwards) for i, (c, on) in enumerate(zip(columns, ahead))}
    # of every bucket the row that others may take their value from, column by column
    places = bucketed.groupBy(BUCKET).agg(*[
        (F.max if on else F.min)(F.when(col(c).isNotNull(), F.col(PLACE))).alias(f"_p{i}") for i, (c, on) in enumerate(zip(columns, ahead))
    ])  # one row per bucket
    at_edge = F.lit(False)
    for i in range(len(columns)):
        at_edge |= F.coalesce(F.col(PLACE) == F.col(f"_p{i}"), F.lit(False))
    held = bucketed.join(F.broadcast(places), BUCKET).where(at_edge)
    edges = places.select(BUCKET).join(F.broadcast(held.groupBy(BUCKET).agg(*[
        F.max_by(F.struct(col(c).alias("value"), here.alias("key")), F.when(F.col(PLACE) == F.col(f"_p{i}"), F.col(PLACE))).alias(f"_edge{i}")
        for i, c in enumerate(columns)
    ])), BUCKET, "left")
    later = W.orderBy(F.desc(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(BUCKET, *[F.last(f"_edge{i}", ignorenulls=True).over(_earlier() if on else later).alias(f"_far{i}") for i, on in enumerate(ahead)])
    filled = _join_buckets(bucketed.withColumns(near), edges)
    far = lambda i: F.when(F.col(f"_far{i}.key") == here, F.col(f"_far{i}.value"))
    return filled.withColumns({c: F.coalesce(col(c), F.col(f"_near{i}"), far(i)) for i, c in enumerate(columns)}).select(*[col(c) for c in df.columns])


def with_neighbour(
    df: DataFrame, columns: Sequence[str], sort: Sort, keys: Sequence[str] = (), ahead: bool = False
) -> DataFrame:
    """Add ``_neighbour``: the columns of the previous (or next) row of the key.

    It is NULL at the key's first (or last) row.
    """
    bucketed = in_buckets(df, sort, keys)
    key = F.struct(F.lit(1), *[col(k) for k in keys])
    row = F.struct(key.alias("_key"), *[col(c) for c in columns])
    local = W.partitionBy(BUCKET).orderBy(PLACE)
    across = W.orderBy(BUCKET)
    if ahead:
        near, place, step = F.lead(row).over(local), F.min(PLACE), F.lead
    else:
        near, place, step = F.lag(row).over(local), F.max(PLACE), F.lag
    edges = _edge_rows(bucketed, place, row).select(BUCKET, step("_edge").over(across).alias("_far"))
    joined = _join_buckets(bucketed.withColumn("_near", near), edges)
    other = F.coalesce(F.col("_near"), F.col("_far"))
    return joined.withColumn(
        "_neighbour", F.when(other["_key"] == key, F.struct(*[other[c].alias(c) for c in columns]))
    ).select(*[col(c) for c in df.columns], "_neighbour")


def with_frame_sum(
    positioned: DataFrame, value: str, before: int, after: int, keys: Sequence[str] = (),
    halo_rows: int = HALO_ROWS, block_rows: int = _BLOCK_ROWS,
) -> DataFrame:
    """Add ``_frame_sum`` over [position-before, position+after].

    NULL unless the whole frame lies in the table and in the row's key.
    ``positioned`` comes from :func:`with_position` with the same keys.

    Positions fall into blocks, and a frame is put together from the end of one
    block, whole ones, and the start of another.  Nothing is ever subtracted,
    so a frame's sum depends on its own rows alone.
    """
    width = before + after + 1
    key = F.struct(F.lit(1), *[col(k) for k in keys])
    pos = F.col(POSITION)
    if width > halo_rows:
        return _wide_frame_sum(positioned, value, before, after, key, halo_rows, max(1, min(block_rows, halo_rows // 2)))
    # Rows near a chunk's edge are copied to the neighbouring chunk, so each
    # chunk can be computed alone.  Blocks are as long as the frame: it starts
    # with one or covers the end of one and the start of the next.
    chunk = width * -(-max(8 * width, 4096) // width)
    home = F.floor(pos / chunk)
    targets = F.sequence(F.floor(F.greatest(pos - after, F.lit(0)) / chunk), F.floor((pos + before) / chunk))
    spread = positioned.withColumn("_chunk", F.explode(targets)).repartition("_chunk").withColumn("_block", F.floor(pos / width))
    order = W.partitionBy("_chunk").orderBy(POSITION)
    block = W.partitionBy("_chunk", "_block")
    summed = spread.withColumns({
        "_start": F.sum(value).over(block.orderBy(POSITION).rowsBetween(W.unboundedPreceding, 0)),
        "_end": F.sum(value).over(block.orderBy(F.desc(POSITION)).rowsBetween(W.unboundedPreceding, 0)),
    })
    inside = (F.lag(key, before).over(order) == key) & (F.lead(key, after).over(order) == key)
    end, start = F.lag("_end", before).over(order), F.lead("_start", after).over(order)
    total = F.when((pos - before) % width == 0, start).otherwise(end + start)
    return (
        summed.withColumn("_frame_sum", F.when(inside, total)).where(F.col("_chunk") == home)
        .select(*[col(c) for c in positioned.columns], "_frame_sum")
    )


def _wide_frame_sum(positioned: DataFrame, value: str, before: int, after: int, key: Column, halo_rows: int, size: int) -> DataFrame:
    """Frames of many blocks: the whole blocks between are a frame over the blocks' sums."""
    pos = F.col(POSITION)
    blocks = positioned.withColumn("_block", F.floor(pos / size))
    order = W.partitionBy("_block")
    ends = blocks.select(
        POSITION, key.alias("_key"),
        F.sum(value).over(order.orderBy(POSITION).rowsBetween(W.unboundedPreceding, 0)).alias("_start"),
        F.sum(value).over(order.orderBy(F.desc(POSITION)).rowsBetween(W.unboundedPreceding, 0)).alias("_end"),
    )
    sums = blocks.groupBy(F.col("_block").alias(POSITION)).agg(F.sum(value).alias("_sum"))
    # between the blocks of a frame's ends lie as many as fit, or one less
    most = (before + after) // size
    whole = sums.select(F.col(POSITION).alias("_first"), F.col("_sum").alias("_last_sum"))
    if most > 1:
        inner = with_frame_sum(sums, "_sum", 0, most - 2, (), halo_rows).select(F.col(POSITION).alias("_first"), F.col("_frame_sum").alias("_inner"))
    else:
        inner = sums.select(F.col(POSITION).alias("_first"), F.lit(0.0).alias("_inner"))
    upper = ends.select((pos - after).alias(POSITION), F.col("_start").alias("_upper"), F.col("_key").alias("_upper_key"))
    lower = ends.select((pos + before).alias(POSITION), F.col("_end").alias("_lower"), F.col("_key").alias("_lower_key"))
    first, last = F.floor((pos - before) / size) + 1, F.floor((pos + after) / size)
    framed = positioned.join(upper, POSITION, "left").join(lower, POSITION, "left").withColumns({"_first": first, "_more": last - first == most})
    joined = framed.join(inner, "_first", "left").withColumn("_next", F.when(F.col("_more"), F.col("_first") + most - 1))
    joined = joined.join(whole.withColumnRenamed("_first", "_next"), "_next", "left")
    total = F.col("_lower") + F.col("_upper") + F.coalesce("_inner", F.lit(0.0)) + F.when(F.col("_more"), F.coalesce("_last_sum", F.lit(0.0))).otherwise(0.0)
    inside = (F.col("_upper_key") == key) & (F.col("_lower_key") == key)
    return joined.withColumn("_frame_sum", F.when(inside, total)).select(*[col(c) for c in positioned.columns], "_frame_sum")
