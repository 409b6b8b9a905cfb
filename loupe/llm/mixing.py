"""Mix sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order.  A
document's virtual finish time is the number of words its source has served
up to and including it, divided by the source's target.  All documents are
range-sorted by finish time, and the mix ends where the running total would
exceed the budget.  A source with a target above its size starts over, at most
``max_repeats`` times in all.

Nothing but one row a source is ever ordered in one task: running totals come
from :func:`loupe.ordered.with_running_sum`, so a source that holds a third of
all rows spans many buckets.

Defined results: NULL and empty texts have size 0 and are taken with 0 words
or left; a NULL source is a source of its own and the last one; rows repeated
whole are one item, taken or left together; rows that only share a doc_id are
separate documents; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from loupe.frames import col, require
from loupe.llm.rows import fresh, row_key, word_count
from loupe.ordered import POSITION, with_running_sum

#: weights of the sources in code-point order, repeating
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, rank, before, target) from rows (source, size).

    Targets share the total by weight; one above ``max_repeats`` times its
    source's size stops there and the others share the excess.  Sorted by
    limit over weight, the stopped sources come first, so one running sum over
    the sources, one row each, finds them.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    named = total.select(
        "source", "source_size", F.row_number().over(by_name).alias("rank"),
        F.coalesce(F.sum("source_size").over(by_name.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    ).withColumn("weight", weight).withColumn("limit", F.col("source_size") * max_repeats)
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    rest = by_limit.rowsBetween(0, W.unboundedFollowing)
    earlier = by_limit.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0))
    level = named.withColumn("level", left.cast("double") / F.sum("weight").over(rest)).withColumn(
        "stopped", F.col("limit") <= F.col("weight") * F.col("level")
    )
    final = F.min(F.when(~F.col("stopped"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(everything)
    return level.withColumn("final", final["level"]).select(
        "source", "source_size", F.col("rank").cast("long").alias("rank"), "before",
        F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"),
    )


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED,
) -> DataFrame:
    """One row per distinct row of ``docs``: what the mix takes of it.

    Columns: row (its key), doc_id, source, rows (how often the row occurs), size
    (words), source_size, target, copies (0 to max_repeats), taken (words of
    each of the rows).
    """
    require(docs, "doc_id", "text", "source")
    items = (
        docs.select(row_key(docs).alias("row"), "doc_id", "source", word_count().alias("size"))
        .groupBy("row", "doc_id", "source", "size")
        .agg(F.count("*").alias("rows"))
    )
    weighed = items.select("source", (F.col("size") * F.col("rows")).alias("size"))
    targets = source_targets(weighed, weights, max_repeats).withColumnRenamed("source", "_source")
    order = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    queued = items.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumns(
        {"order": order, "words": F.col("size") * F.col("rows")}
    )
    served = with_running_sum(queued, "words", ["rank", "order", "row"], "served")
    lap = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("lap")
    finish = (F.col("lap") * F.col("source_size") + F.col("served") - F.col("before")).cast("double") / F.col("target")
    laps = served.select(F.col(POSITION).alias("place"), "rank", "words", "source_size", "served", "before", "target", lap)
    # a source with target 0 has no words
    timed = laps.withColumn("finish", F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0))).select("place", "rank", "words", "lap", "finish")
    mixed = with_running_sum(timed, "words", ["finish", "rank", "place", "lap"], "total")
    budget = items.agg(F.coalesce(F.sum(F.col("size") * F.col("rows")), F.lit(0)).alias("budget"))
    kept = (
        mixed.crossJoin(F.broadcast(budget))  # one row
        .groupBy("place")
        .agg(F.count_if((F.col("total") <= F.col("budget")) & (F.col("words") > 0)).alias("copies"))
    )
    return (
        served.join(kept, served[POSITION] == kept["place"])
        .select("row", "doc_id", "source", "rows", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    row, copies = fresh(docs, "_row"), fresh(docs, "_copies")
    plan = plan_mix(docs, weights, max_repeats, seed).where("copies > 0")
    plan = plan.groupBy(F.col("row").alias(row)).agg(F.max("copies").alias(copies))
    keyed = docs.withColumn(row, row_key(docs))
    repeated = keyed.join(plan, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return repeated.select(*[col(c) for c in docs.columns])
