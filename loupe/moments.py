"""Means and centred cross-products, collected as small matrices.

A pass over the data leaves p means and p * (p + 1) / 2 sums; correlations,
regressions and their diagnostics are algebra on those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


#: columns from which on products are summed as matrices; each pair's own expression would make plans too large
_WIDE = 25
#: rows of the matrix that travel together
_STRIP = 64
#: pairs of columns that are summed in one pass each with expressions of its own
_PAIRS = 100


@dataclass
class Moments:
    """Of the rows with no NULL among the columns."""

    n: int
    means: np.ndarray
    cross: np.ndarray  # sum over rows of (x_i - mean_i) * (x_j - mean_j)

    def correlation(self) -> np.ndarray:
        """NaN where a column does not vary."""
        spread = np.sqrt(np.diag(self.cross))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.cross / np.outer(spread, spread)
        return np.where(np.isfinite(r), np.clip(r, -1, 1), np.nan)

    def std(self, ddof: int = 1) -> np.ndarray:
        return np.sqrt(np.diag(self.cross) / (self.n - ddof)) if self.n > ddof else np.full(len(self.means), np.nan)

    @staticmethod
    def merge(parts: Sequence["Moments"]) -> "Moments":
        """Moments of the union of disjoint sets of rows."""
        parts = [p for p in parts if p.n]
        n = sum(p.n for p in parts)
        means = sum(p.n * p.means for p in parts) / n
        cross = sum(p.cross + p.n * np.outer(p.means - means, p.means - means) for p in parts)
        return Moments(n, means, cross)


def moments_by(
    values: DataFrame, columns: Sequence[str], by: Column | None = None, centre: Sequence[float] | None = None
) -> dict[object, Moments]:
    """Moments per value of ``by``, which must take few values (folds, splits).

    Sums are taken around the overall means, so that large offsets do not
    cancel the digits that matter; ``centre`` gives the means if they are known.
    """
    columns = list(columns)
    known = values.select(*columns, (F.lit(0) if by is None else by).alias("_by")).na.drop(subset=columns)
    if centre is None:
        centre = known.agg(*[F.avg(c) for c in columns]).first()
    if centre[0] is None:
        return {}
    p = len(columns)
    if p >= _WIDE:
        return _wide(known, columns, np.array(centre, dtype=float))
    shifted = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, centre)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = (
        known.groupBy("_by")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(s).alias(f"s{i}") for i, s in enumerate(shifted)],
            *[F.sum(shifted[i] * shifted[j]).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    result = {}
    for row in rows:
        offset = np.array([row[f"s{i}"] for i in range(p)]) / row["n"]
        cross = np.empty((p, p))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = row[f"p{i}_{j}"] - row["n"] * offset[i] * offset[j]
        result[row["_by"]] = Moments(row["n"], np.array(centre, dtype=float) + offset, cross)
    return result


def _wide(known: DataFrame, columns: Sequence[str], centre: np.ndarray) -> dict[object, Moments]:
    """Moments from one product of matrices a batch."""
    p = len(columns)

    def products(values: np.ndarray) -> np.ndarray:
        z = np.column_stack([values - centre, np.ones(len(values))])
        return z.T @ z

    result = {}
    for by, total in _summed(known, columns, products).items():
        n, offset = int(round(total[p, p])), total[:p, p] / total[p, p]
        result[by] = Moments(n, centre + offset, total[:p, :p] - n * np.outer(offset, offset))
    return result


def _summed(known: DataFrame, columns: Sequence[str], products: Callable[[np.ndarray], np.ndarray]) -> dict[object, np.ndarray]:
    """Per value of ``_by`` the sum of what ``products`` makes of each batch's rows, NULLs as NaN.

    Batches leave their matrix; strips of the matrices are added up in streams.
    """
    kind = known.schema["_by"].dataType.simpleString()
    schema = f"_by {kind}, strip int, width int, sums binary"

    def multiply(batches: Iterator) -> Iterator:
        totals: dict = {}
        for batch in batches:
            for by, part in batch.groupby("_by", dropna=False):
                totals[by] = totals.get(by, 0) + products(part[list(columns)].to_numpy(dtype=float))
        yield strips({(by, k): m[k : k + _STRIP] for by, m in totals.items() for k in range(0, len(m), _STRIP)})

    def add(batches: Iterator) -> Iterator:
        totals: dict = {}
        for batch in batches:
            for by, k, width, sums in zip(batch["_by"], batch["strip"], batch["width"], batch["sums"]):
                totals[by, k] = totals.get((by, k), 0) + np.frombuffer(sums).reshape(-1, width)
        yield strips(totals)

    def strips(totals: dict):
        import pandas as pd

        rows = [(by, k, m.shape[1], np.ascontiguousarray(m).tobytes()) for (by, k), m in totals.items()]
        return pd.DataFrame(rows, columns=["_by", "strip", "width", "sums"])

    parts = known.mapInPandas(multiply, schema).repartition("_by", "strip").mapInPandas(add, schema)
    found: dict = {}
    for row in parts.orderBy("strip").collect():  # one row per strip and value of by
        found.setdefault(row["_by"], []).append(np.frombuffer(row["sums"]).reshape(-1, row["width"]))
    return {by: np.concatenate(rows) for by, rows in found.items()}


def gaps_together(flags: DataFrame) -> np.ndarray:
    """For each pair of 0/1 columns, the rows with both; the diagonal has those of each."""
    names = flags.columns
    found = _summed(flags.withColumn("_by", F.lit(0)), names, lambda z: z.T @ z)
    return np.rint(found.get(0, np.zeros((len(names), len(names))))).astype(np.int64)


def pairwise_correlations(values: DataFrame) -> np.ndarray:
    """r of every pair of columns over the rows with both known, in one pass whatever the gaps.

    Missing values are filled with the centre, so that a product of the filled
    values, of their squares or of the values' presence sums what the pair's
    common rows hold.  NaN where a column does not vary on them, or has an
    infinite value there.  Pairs on whose rows a column varies little beside
    its distance from the centre would lose digits; the few there are, are
    summed again around means of their own.
    """
    names = values.columns
    p = len(names)
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    centre = np.array([m or 0.0 for m in values.agg(*[F.avg(finite(c)) for c in names]).first()])

    def products(x: np.ndarray) -> np.ndarray:
        known, endless = (~np.isnan(x)).astype(float), np.isinf(x).astype(float)
        z = np.where(np.isfinite(x), x - centre, 0.0)
        return np.vstack([known.T @ known, z.T @ known, (z * z).T @ known, z.T @ z, endless.T @ known])

    total = _summed(values.withColumn("_by", F.lit(0)), names, products).get(0)
    if total is None:
        return np.full((p, p), np.nan)
    n, sums, squares, cross, endless = total.reshape(5, p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - sums * sums / n
        narrow = (squares > 0) & (spread < 1e-8 * squares)
        spread = np.where(spread > 0, spread, np.nan)
        r = (cross - sums * sums.T / n) / np.sqrt(spread * spread.T)
    r = np.where((endless > 0) | (endless.T > 0) | ~np.isfinite(r), np.nan, np.clip(r, -1, 1))
    again = [(a, b) for a in range(p) for b in range(a + 1, p) if (narrow[a, b] or narrow[b, a]) and not endless[a, b] + endless[b, a]]
    for start in range(0, len(again), _PAIRS):
        part = again[start : start + _PAIRS]
        both = [(F.when(F.col(names[b]).isNotNull(), F.col(names[a])), F.when(F.col(names[a]).isNotNull(), F.col(names[b]))) for a, b in part]
        row = values.agg(*[F.corr(x, y).alias(f"r{k}") for k, (x, y) in enumerate(both)]).first()
        for (a, b), found in zip(part, row):
            r[a, b] = r[b, a] = np.nan if found is None else np.clip(found, -1, 1)
    return r


def moments(values: DataFrame, columns: Sequence[str]) -> Moments | None:
    """Moments of the rows with every column known; None without such rows."""
    return moments_by(values, columns).get(0)
