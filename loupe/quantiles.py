"""Exact quantiles with linear interpolation, at any size, by one algorithm.

A first pass over all columns (or groups) leaves a mergeable quantile sketch of
each, which brackets every wanted rank by values a few ranks away.  A second
pass counts, exactly, the rows below the brackets and in equal slices of each
bracket.  A wanted rank whose slice holds one or two distinct places is found;
what is left, as in huge tables, is narrowed by further passes that read only
the rows of its slice.  A sketch only proposes: a rank that the counts don't
put into its bracket is looked for between the minimum and the maximum.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from loupe.frames import col, number
from loupe.session import durable

#: the sketch's ranks are right to 1/_ACCURACY of the rows
_ACCURACY = 10_000
#: shares of the rows on either side of a wanted rank that brackets may span; the least that is safe is taken
_REACHES = (0.0003, 0.003, 0.03)
_SLICES = 4096
#: the number of the slice of rows below a bracket, and between it and the one before
_BELOW = -2

_MOST = sys.float_info.max


def _shares(probs: Sequence[float]) -> list[float]:
    """The shares of the rows whose sketched values may bound a bracket."""
    return sorted({min(1.0, max(0.0, p + side * reach)) for p in probs for reach in _REACHES for side in (-1, 1)})


def _reach(n: int) -> float | None:
    """Ranks lie up to one beside n * p, and sketched ones n / _ACCURACY beside that."""
    return next((r for r in _REACHES if n * (r - 1 / _ACCURACY) >= 4), None)


def _slice(v: Column, low: Column, high: Column) -> Column:
    """The number of the equal slice of [low, high] that holds v; an infinite value is a slice of its own."""
    # halves, as the difference of two large numbers may overflow
    least, most = F.greatest(low, F.lit(-_MOST)), F.least(high, F.lit(_MOST))
    part = F.floor(F.try_divide(v / 2 - least / 2, most / 2 - least / 2) * _SLICES)
    inner = F.when(most > least, F.least(part, F.lit(_SLICES - 1).cast("long"))).otherwise(F.lit(0).cast("long"))
    return F.when(v == float("inf"), F.lit(_SLICES)).when(v == float("-inf"), F.lit(-1)).otherwise(inner).cast("int")


def _between(low: float, high: float, share: float) -> float:
    """Linear interpolation; equal ends, infinite ones too, are themselves."""
    return low if share == 0 or low == high else low + (high - low) * share


# whole columns


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of whole columns, as plain numbers (len(columns) * len(probs) of them).

    Known bounds become literals, so that later filters on them reach the scan.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    if not columns:
        return {}
    values = df.select([number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    facts = _facts(values, probs)
    found = _narrowed(values, [f for f in facts if f.n], probs)
    return {c: found.get(i, [None] * len(probs)) for i, c in enumerate(columns)}


def _branches(values: DataFrame, parts: Sequence[list], make) -> list[Row]:
    """Rows of the branches, each over a few columns: Spark compiles an aggregate of up to 100 buffers.

    Over a columnar file each branch reads its own columns, so that all of
    them read the file once.
    """
    return reduce(DataFrame.unionAll, [make(values, part) for part in parts]).collect()


def _facts(values: DataFrame, probs: Sequence[float]) -> list[Row]:
    """(i, n, low, high, sketch) of each column c0, c1, ..."""
    shares = F.array(*[F.lit(s) for s in _shares(probs)])
    kinds = {"n": F.count, "low": F.min, "high": F.max, "sketch": lambda c: F.percentile_approx(c, shares, _ACCURACY)}

    def make(values: DataFrame, part: list[int]) -> DataFrame:
        wide = values.agg(*[f(f"c{i}").alias(f"{k}{i}") for i in part for k, f in kinds.items()])
        return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"{k}{i}").alias(k) for k in kinds]) for i in part])))

    everything = list(range(len(values.columns)))
    return sorted(_branches(values, [everything[k : k + 3] for k in range(0, len(everything), 3)], make), key=lambda row: row.i)


def _narrowed(values: DataFrame, facts: Sequence[Row], probs: Sequence[float]) -> dict[int, list[float]]:
    """Quantiles per column, given its number of rows, minimum, maximum and sketch."""
    shares = _shares(probs)
    places = {f.i: [(f.n - 1) * p for p in probs] for f in facts}
    ends = {f.i: (f.low, f.high, 0) for f in facts}
    # (column, rank) -> lowest value, highest value, rows below or None if they aren't counted yet
    brackets: dict[tuple[int, int], tuple[float, float, int | None]] = {}
    for f in facts:
        reach = _reach(f.n)
        for p, h in zip(probs, places[f.i]):
            low = f.low if reach is None or p <= reach else f.sketch[shares.index(max(0.0, p - reach))]
            high = f.high if reach is None or p + reach >= 1 else f.sketch[shares.index(min(1.0, p + reach))]
            for rank in (math.floor(h), math.ceil(h)):
                brackets[f.i, rank] = (low, high, 0 if low == f.low else None)
    found: dict[tuple[int, int], float] = {}
    while True:
        found |= {k: b[0] for k, b in brackets.items() if b[0] == b[1] and b[2] is not None}
        brackets = {k: b for k, b in brackets.items() if k not in found}
        if not brackets:
            break
        counted = _count_slices(values, brackets)
        for (i, rank), bracket in list(brackets.items()):
            hit = next((s for s in counted[i] if s.below <= rank < s.below + s.n), None)
            if hit is None:
                if bracket == ends[i]:
                    raise RuntimeError("the table changed between two passes over it")
                brackets[i, rank] = ends[i]
            elif hit.n == 2:
                found[i, rank] = hit.low if rank == hit.below else hit.high
            elif (hit.low, hit.high, hit.below) == bracket:
                raise RuntimeError(f"no order statistic can be told apart within {bracket}")
            else:
                brackets[i, rank] = (hit.low, hit.high, hit.below)
        brackets = {k: b for k, b in brackets.items() if k not in found}
    return {
        i: [_between(found[i, math.floor(h)], found[i, math.ceil(h)], h - math.floor(h)) for h in row]
        for i, row in places.items()
    }


@dataclass
class _Counted:
    """A slice of a bracket: its rows, its lowest and highest value, and the rows of its column below it."""

    slice: int
    n: int
    low: float
    high: float
    below: int


def _count_slices(values: DataFrame, brackets: dict) -> dict[int, list[_Counted]]:
    """Per column the slices of its brackets in order, overlapping brackets as one.

    In a column with a bracket of which it isn't known how many rows lie below,
    the rows before and between the brackets are counted, too.
    """
    wanted: dict[int, list[list]] = {}
    for (i, _), (low, high, below) in sorted(brackets.items(), key=lambda x: (x[0][0], x[1][0], x[1][1])):
        own = wanted.setdefault(i, [])
        if own and low <= own[-1][1]:
            own[-1][1] = max(high, own[-1][1])
        else:
            own.append([low, high, below])
    uncounted = {i for (i, _), b in brackets.items() if b[2] is None}

    def make(values: DataFrame, part: list[int]) -> DataFrame:
        entries, inside, flags = [], F.lit(False), {}
        for i in part:
            v, within = F.col(f"c{i}"), F.lit(False)
            for k, (low, high, _) in enumerate(wanted[i]):
                if i in uncounted:
                    flags[f"f{i}_{k}"] = v < low
                if low == high:  # nothing to slice
                    flags[f"at{i}_{k}"] = v == low
            wide = [(k, low, high) for k, (low, high, _) in enumerate(wanted[i]) if low < high]
            if not wide:
                continue
            for _, low, high in wide:
                within |= v.between(low, high)
            # the bracket is the one after those that end below the value; its bounds are looked up
            place = sum((F.when(v > high, 1).otherwise(0) for _, _, high in wide[:-1]), F.lit(0))
            ends = [(max(low, -_MOST) / 2, min(high, _MOST) / 2) for _, low, high in wide]
            look = lambda numbers: F.element_at(F.array(*[F.lit(x) for x in numbers]), place + 1)
            part_of = F.floor((v / 2 - look([low for low, _ in ends])) * look([_SLICES / (high - low) if high > low else 0.0 for low, high in ends]))
            inner = F.greatest(F.least(part_of, F.lit(_SLICES - 1).cast("long")), F.lit(0).cast("long"))
            slice_ = F.when(v == float("inf"), F.lit(_SLICES)).when(v == float("-inf"), F.lit(-1)).otherwise(inner).cast("int")
            entries.append(F.when(within, F.struct(F.lit(i).alias("i"), look([k for k, _, _ in wide]).alias("b"), slice_.alias("slice"), v.alias("v"))))
            inside |= F.coalesce(within, F.lit(False))
        # a row gives an entry for each column with the value in a bracket, or none; its first one counts what it is below
        counts = [f.alias(n) for n, f in flags.items()]
        if len(entries) > 1:
            listed = F.when(inside, F.array_compact(F.array(*entries)))
            rows = values.select(*counts, F.posexplode_outer(listed).alias("at", "e"))
            first = F.coalesce(F.col("at"), F.lit(0)) == 0
        else:
            entry = entries[0] if entries else F.lit(None).cast("struct<i:int,b:int,slice:int,v:double>")
            rows, first = values.select(*counts, entry.alias("e")), F.lit(True)
        below = F.map_from_arrays(F.array(*[F.lit(n) for n in flags]).cast("array<string>"), F.array(*[F.col(f"n_{n}") for n in flags]).cast("array<bigint>"))
        return rows.groupBy("e.i", "e.b", "e.slice").agg(
            F.count("e").alias("n"), F.min("e.v").alias("low"), F.max("e.v").alias("high"), *[F.count_if(first & F.col(n)).alias(f"n_{n}") for n in flags]
        ).select("i", "b", "slice", "n", "low", "high", below.alias("below"))

    # at most _SLICES + 2 rows a bracket
    rows = _branches(values, [list(wanted)[k : k + 3] for k in range(0, len(wanted), 3)], make)
    counted: dict[str, int] = {}
    for row in rows:
        for name, n in row.below.items():
            counted[name] = counted.get(name, 0) + n
    out: dict[int, list[_Counted]] = {i: [] for i in wanted}
    last, below = None, 0
    for row in sorted((r for r in rows if r.i is not None), key=lambda r: (r.i, r.b, r.slice)):
        if last != (row.i, row.b):
            last, below = (row.i, row.b), counted[f"f{row.i}_{row.b}"] if row.i in uncounted else wanted[row.i][row.b][2]
        out[row.i].append(_Counted(row.slice, row.n, row.low, row.high, below))
        below += row.n
    for i, own in wanted.items():
        for k, (low, high, below) in enumerate(own):
            if low == high:
                out[i].append(_Counted(0, counted[f"at{i}_{k}"], low, high, counted[f"f{i}_{k}"] if i in uncounted else below))
    return out


# groups


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
) -> DataFrame:
    """One row per group with the quantiles of ``value`` (NULLs ignored).

    The same passes, with a row a group instead of numbers at the driver; the
    wanted ranks, twice ``probs`` a group, are joined to the rows.
    """
    probs, shares = [float(p) for p in probs], _shares([float(p) for p in probs])
    keys = [col(b) for b in by]
    values = df.select(F.struct(F.lit(1).alias("one"), *keys).alias("_key"), number(value).alias("_v")).where(F.col("_v").isNotNull())
    facts = durable(values.groupBy("_key").agg(
        F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"),
        F.percentile_approx("_v", F.array(*[F.lit(s) for s in shares]), _ACCURACY).alias("sketch"),
    ))
    reach = lambda value: F.coalesce(*[F.when(F.col("n") * (r - 1 / _ACCURACY) >= 4, value(r)) for r in _REACHES], value(None))
    at = lambda share: F.get("sketch", F.lit(shares.index(share)))
    pieces = []
    for j, p in enumerate(probs):
        low = reach(lambda r, p=p: F.col("least") if r is None or p <= r else at(max(0.0, p - r)))
        high = reach(lambda r, p=p: F.col("most") if r is None or p + r >= 1 else at(min(1.0, p + r)))
        h = (F.col("n") - 1) * F.lit(p)
        pieces += [F.struct(F.lit(2 * j + k).alias("id"), rank.cast("long").alias("rank"), low.alias("low"), high.alias("high")) for k, rank in enumerate((F.floor(h), F.ceil(h)))]
    wanted = facts.select("_key", "n", "least", "most", F.inline(F.array(*pieces)))
    wanted = wanted.withColumn("below", F.when(F.col("low") == F.col("least"), F.lit(0).cast("long")))
    found = None
    while True:
        wanted = durable(wanted)
        done = wanted.where("low = high AND below IS NOT NULL").select("_key", "id", F.col("low").alias("v"))
        left = wanted.where("NOT (low = high AND below IS NOT NULL)")
        found = done if found is None else found.unionByName(done)
        if left.isEmpty():
            break
        # a bracket's ranks share its counts
        ranks = F.collect_list(F.struct("id", "rank", "least", "most")).alias("ranks")
        open_ = durable(left.groupBy("_key", "low", "high", "below").agg(ranks).withColumn("bracket", F.monotonically_increasing_id()))
        v, low, high = F.col("_v"), F.col("low"), F.col("high")
        in_reach = (v <= high) & ((v >= low) | F.col("below").isNull())
        met = values.join(open_.select(F.col("_key").alias("_k"), "bracket", "low", "high", "below"), F.col("_key").eqNullSafe(F.col("_k")) & in_reach)
        slices = met.withColumn("slice", F.when(v < low, F.lit(_BELOW)).otherwise(_slice(v, low, high))).groupBy("bracket", "slice").agg(
            F.count("*").alias("n"), F.min("_v").alias("first"), F.max("_v").alias("last")
        )
        # at most _SLICES + 3 rows a bracket
        listed = slices.groupBy("bracket").agg(F.array_sort(F.collect_list(F.struct("slice", "n", "first", "last"))).alias("cells"))
        counted = listed.join(open_, "bracket").select("_key", "below", F.explode("ranks").alias("r"), "cells")
        counted = counted.withColumn("start", F.coalesce("below", F.lit(0).cast("long")))
        step = F.aggregate(
            "cells", F.struct(F.col("start").alias("below"), F.lit(None).cast("struct<slice:int,n:bigint,first:double,last:double>").alias("hit")),
            lambda state, cell: F.when(state["hit"].isNotNull(), state).otherwise(F.struct(
                F.when(F.col("r.rank") < state["below"] + cell["n"], state["below"]).otherwise(state["below"] + cell["n"]).alias("below"),
                F.when(F.col("r.rank") < state["below"] + cell["n"], cell).alias("hit"),
            )),
        )
        hit = counted.select("_key", "r.*", step.alias("s")).select("_key", "id", "rank", "least", "most", "s.below", "s.hit")
        missed = F.col("hit").isNull() | (F.col("hit.slice") == _BELOW)
        two = F.col("hit.n") == 2
        pick = F.when(F.col("rank") == F.col("below"), F.col("hit.first")).otherwise(F.col("hit.last"))
        end = lambda name, side: F.when(missed, F.col(name)).when(two, pick).otherwise(F.col(f"hit.{side}"))
        wanted = hit.select(
            "_key", "id", "rank", "least", "most", end("least", "first").alias("low"), end("most", "last").alias("high"),
            F.when(missed, F.lit(0).cast("long")).otherwise(F.col("below")).alias("below"),
        )
    row = found.groupBy("_key").agg(*[F.max(F.when(F.col("id") == k, F.col("v"))).alias(f"v{k}") for k in range(2 * len(probs))])
    joined = row.join(facts.select(F.col("_key").alias("_k"), "n"), F.col("_key").eqNullSafe(F.col("_k")))
    results = []
    for j, (p, name) in enumerate(zip(probs, names)):
        a, b, h = F.col(f"v{2 * j}"), F.col(f"v{2 * j + 1}"), (F.col("n") - 1) * F.lit(p)
        share = h - F.floor(h)
        results.append(F.when((share == 0) | (a == b), a).otherwise(a + (b - a) * share).alias(name))
    return joined.select(*[F.col("_key")[b].alias(b) for b in by], *results)
