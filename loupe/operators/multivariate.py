"""Principal components and clusters of numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loupe.frames import col, number, pick_numeric, spread
from loupe.moments import Moments, moments
from loupe.session import durable


@dataclass
class Components:
    """Result of :func:`dimension_reduce`."""

    scores: DataFrame  # the given key columns and pc1, pc2, ...
    loadings: DataFrame  # (variable, pc1, pc2, ...)
    variance: DataFrame  # (component, eigenvalue, variance_explained, cumulative_variance, n_samples)


def _known(df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Complete rows: the key columns and c0, c1, ..."""
    values = [number(c).alias(f"c{i}") for i, c in enumerate(names)]
    return df.select(*[col(k) for k in keys], *values).na.drop(subset=[f"c{i}" for i in range(len(names))])


def _scaled(found: Moments) -> list[Column]:
    """Columns less their mean over their std (dividing by n); constant ones stay 0."""
    stds = found.std(ddof=0)
    return [
        (F.col(f"c{i}") - F.lit(float(m))) / F.lit(float(s) if s > 0 else 1.0)
        for i, (m, s) in enumerate(zip(found.means, stds))
    ]


def _axes(found: Moments, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and axes (one per column) of the scaled data, largest first.

    The sign of an axis is free; its largest weight is made positive.
    """
    correlation = np.nan_to_num(found.correlation(), nan=0.0)
    values, axes = np.linalg.eigh(correlation)
    order = np.argsort(values)[::-1][:n]
    values, axes = np.clip(values[order], 0, None), axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return values, axes, float(np.trace(correlation))


def _project(scaled: Sequence[Column], axes: np.ndarray) -> list[Column]:
    return [
        sum((z * F.lit(float(w)) for z, w in zip(scaled, axis)), F.lit(0.0)).alias(f"pc{k + 1}")
        for k, axis in enumerate(axes.T)
    ]


def dimension_reduce(
    df: DataFrame, columns: Sequence[str] | None = None, n_components: int = 2, keys: Sequence[str] = ()
) -> Components:
    """Principal components of the scaled columns, over the complete rows.

    One pass leaves the correlation matrix; the scores are plain expressions
    over the table.  ``keys`` are carried along to name the rows.
    """
    names = pick_numeric(df, columns)
    if len(names) < 3:
        raise ValueError("principal components need three numeric columns")
    known = _known(df, names, keys)
    found = moments(known, [f"c{i}" for i in range(len(names))])
    if found is None or found.n < 10:
        raise ValueError("principal components need ten complete rows")
    n = min(n_components, len(names) - 1, found.n - 1)
    values, axes, total = _axes(found, n)
    shares = values / total if total else values
    spark = df.sparkSession
    labels = [f"pc{k + 1}" for k in range(n)]
    return Components(
        scores=known.select(*[col(k) for k in keys], *_project(_scaled(found), axes)),
        loadings=spark.createDataFrame(
            [(c, *map(float, axes[i])) for i, c in enumerate(names)],
            "variable string, " + ", ".join(f"{c} double" for c in labels),
        ),
        variance=spark.createDataFrame(
            [(labels[k], float(values[k]), float(shares[k]), float(shares[: k + 1].sum()), found.n) for k in range(n)],
            "component string, eigenvalue double, variance_explained double, cumulative_variance double, n_samples long",
        ),
    )


@dataclass
class Clusters:
    """Result of :func:`cluster_analysis`."""

    n_clusters: int
    silhouette: float | None
    clusters: DataFrame  # (cluster, size, pct, one column per variable: the centre)
    assignments: DataFrame  # the key columns, the columns and cluster, pc1, pc2


#: Lloyd steps of every number of clusters, how far a settled centre may still move (scaled), and rows that give the starts
STEPS, SETTLED, START_ROWS = 40, 1e-4, 2048
#: shares of the rows that later steps may have to read again, each with the steps that it should last at the centres' pace
_OPEN = ((0.02, 12), (0.05, 10), (0.1, 6), (0.2, 4))
#: bytes of the rows that are written as one value, small as Arrow sends up to 10,000 values at once, and rows that are computed together
_PACK, _TOGETHER = 16 << 10, 8192


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, summed column by column as the plan's expressions do."""
    total = np.zeros((len(rows), len(centres)))
    for j in range(rows.shape[1]):
        apart = rows[:, j, None] - centres[None, :, j]
        total += apart * apart
    return total


def _sample(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``START_ROWS`` different rows with the smallest hashes, and how often each comes.

    Copies share a hash, so they are counted before the rows are limited; an
    estimate of how many different rows there are spares most of them that.
    """
    order = F.xxhash64(*vectors.columns)
    different = vectors.agg(F.approx_count_distinct(order)).first()[0]
    for part in (2 * START_ROWS / max(different, 1), 1.0):  # hashes are spread evenly over 64 bits
        low = vectors if part >= 1 else vectors.where(order < F.lit(int((2 * part - 1) * (1 << 63))))
        counted = low.groupBy(*vectors.columns).agg(F.count("*").alias("_n"))
        rows = counted.orderBy(order, *vectors.columns).limit(START_ROWS).toPandas().to_numpy(dtype=float)
        if part >= 1 or len(rows) == START_ROWS:
            return rows[:, :-1], rows[:, -1]


def _starts(sample: np.ndarray, numbers: Sequence[int], seed: int, weights: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Starting centres for each number: k-means++ and a few steps on the sample.

    Copies of one point are one centre, so there may be fewer.
    """
    weights = np.ones(len(sample)) if weights is None else weights
    starts = {}
    for k in numbers:
        choose = np.random.default_rng(seed)
        centres = sample[[choose.integers(len(sample))]]
        while len(centres) < k:
            gap = distances(sample, centres).min(axis=1) * weights
            if not gap.sum() > 0:
                break
            centres = np.vstack([centres, sample[choose.choice(len(sample), p=gap / gap.sum())]])
        for _ in range(STEPS):
            own = distances(sample, centres).argmin(axis=1)
            centres = np.array([
                np.average(sample[own == c], axis=0, weights=weights[own == c]) if (own == c).any() else centres[c] for c in range(len(centres))
            ])
        starts[k] = centres
    return starts


def _packed(vectors: DataFrame) -> DataFrame:
    """(rows): the vectors' values as doubles, column by column, of many rows in one value.

    Every step reads all of them, and values go to Python one by one otherwise.
    """
    step = max(1, _PACK // (8 * len(vectors.columns)))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            parts = [values[:, i : i + step].tobytes() for i in range(0, batch.num_rows, step)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["rows"])

    return vectors.mapInArrow(pack, "rows binary")


def _unpacked(batches: Iterator, width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(number, values) of some thousand packed rows at a time; the number is None if there is no column k."""
    waiting: dict[int | None, list[np.ndarray]] = {}
    for batch in batches:
        numbers = batch.column("k").to_pylist() if "k" in batch.schema.names else [None] * batch.num_rows
        for k, value in zip(numbers, batch.column("rows")):
            parts = waiting.setdefault(k, [])
            parts.append(np.frombuffer(value.as_buffer()).reshape(width, -1))
            if sum(p.shape[1] for p in parts) >= _TOGETHER:
                yield k, np.concatenate(waiting.pop(k), axis=1)
    for k, parts in waiting.items():
        yield k, np.concatenate(parts, axis=1)


def _nearest(columns: Sequence[np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its nearest centre (the first of equal ones) and the squared distances of that and the next."""
    nearest, least, second = np.zeros(len(columns[0]), dtype=np.int64), None, np.full(len(columns[0]), np.inf)
    for c, centre in enumerate(centres):
        total = np.zeros(len(nearest))
        for x, m in zip(columns, centre):
            apart = x - m
            total += apart * apart
        if least is None:
            least = total
            continue
        nearest[total < least] = c
        second = np.minimum(second, np.maximum(total, least))
        least = np.minimum(total, least)
    return nearest, least, second


def _assigned(packed: DataFrame, centres: dict[int, np.ndarray], margins: dict[int, float]) -> DataFrame:
    """(k, cluster, n, squares, z0, z1, ..., rows): for each number, of the rows nearest to each centre how many, their squared lengths' sum and their sums.

    Rows whose two nearest centres are at distances within the number's margin
    aren't summed but packed again, as cluster -1.  If ``packed`` has a column
    k, its rows count for that number only.
    """
    width = next(iter(centres.values())).shape[1]
    names = ["n", "squares", *[f"z{j}" for j in range(width)]]
    schema = "k int, cluster int, " + ", ".join(f"{c} double" for c in names) + ", rows binary"
    step = max(1, _PACK // (8 * width))

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def table(rows: list[tuple]):
            kinds = [pa.int32(), pa.int32(), *[pa.float64()] * (width + 2), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["k", "cluster", *names, "rows"])

        def pack(k: int, rows: np.ndarray):
            return table([(k, -1, *[None] * (width + 2), rows[:, i : i + step].tobytes()) for i in range(0, rows.shape[1], step)])

        totals = {k: np.zeros((width + 2, len(own))) for k, own in centres.items()}
        listed: dict[int, list[np.ndarray]] = {k: [] for k in margins}
        for number, values in _unpacked(batches, width):
            squares = sum(x * x for x in values)
            for k, own in centres.items() if number is None else [(number, centres[number])]:
                nearest, least, second = _nearest(values, own)
                weights = [None, squares, *values]
                if k in margins:
                    apart = np.sqrt(second) - np.sqrt(least) > margins[k]
                    listed[k].append(values[:, ~apart])
                    if sum(p.shape[1] for p in listed[k]) >= _TOGETHER:
                        yield pack(k, np.concatenate(listed[k], axis=1))
                        listed[k] = []
                    nearest, weights = nearest[apart], [None, *[w[apart] for w in weights[1:]]]
                for total, w in zip(totals[k], weights):
                    total += np.bincount(nearest, weights=w, minlength=len(own))
        for k, parts in listed.items():
            if any(p.shape[1] for p in parts):
                yield pack(k, np.concatenate(parts, axis=1))
        found = [(k, c, *total[:, c], None) for k, total in totals.items() for c in range(total.shape[1]) if total[0, c]]
        if found:
            yield table(found)

    return packed.mapInArrow(assign, schema)


def _added(parts: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """What :func:`_assigned` summed, for each number as (rows, squared lengths, sums of the columns) by cluster."""
    width = next(iter(centres.values())).shape[1]
    names = ["n", "squares", *[f"z{j}" for j in range(width)]]
    rows = parts.where("cluster >= 0").groupBy("k", "cluster").agg(*[F.sum(c).alias(c) for c in names]).collect()  # one for each centre
    found = {k: np.zeros((width + 2, len(own))) for k, own in centres.items()}
    for r in rows:
        found[r["k"]][:, r["cluster"]] = [r[c] for c in names]
    return found


def _moved(packed: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The same, of all rows."""
    return _added(_assigned(packed, centres, {}), centres)


@dataclass
class _Held:
    """A number's rows, told apart by the centres at the time.

    A row nearer to its centre than to any other by more than ``margin`` keeps
    it until two centres have moved as far together: these rows are summed
    once.  The others are listed and assigned anew in every step.
    """

    centres: np.ndarray
    margin: float
    totals: np.ndarray
    parts: DataFrame

    def holds(self, centres: np.ndarray) -> bool:
        return np.sort(np.sqrt(((centres - self.centres) ** 2).sum(axis=1)))[-2:].sum() < self.margin * (1 - 1e-6)


def _margin(sample: np.ndarray, weights: np.ndarray, centres: np.ndarray, pace: float | None) -> float | None:
    """A margin that few rows are within and that lasts for some steps; None if there is none.

    The sample tells how many rows these may be, nothing else depends on it.
    """
    if pace is None or len(centres) < 2:
        return None
    two = np.sqrt(np.sort(distances(sample, centres), axis=1)[:, :2])
    gaps = two[:, 1] - two[:, 0]
    order = np.argsort(gaps)
    below = np.cumsum(weights[order]) / weights.sum()
    for share, steps in _OPEN:
        margin = float(gaps[order][min(np.searchsorted(below, share), len(gaps) - 1)])
        if margin >= max(2 * steps * pace, 4 * SETTLED):
            return margin
    return None


def _silhouettes(packed: DataFrame, centres: dict[int, np.ndarray], sums: dict[int, tuple], n: int) -> dict[int, float | None]:
    """Mean silhouette for each number, by squared distance.

    A row's mean squared distance to the rows of a cluster follows from the
    cluster's size, sum and squared lengths, so no two rows ever meet.
    """

    def shapes(rows: np.ndarray) -> Iterator[tuple[int, float]]:
        lengths, at = (rows * rows).sum(axis=1)[:, None], np.arange(len(rows))
        for k, own in centres.items():
            size, squares, total = sums[k]
            filled = size > 0
            if filled.sum() < 2:
                continue
            nearest = _nearest(rows.T, own)[0]
            safe = np.where(filled, size, 1.0)
            mean = np.where(filled, lengths + squares / safe - 2 * rows @ (total / safe[:, None]).T, np.inf)
            alone = size[nearest] <= 1
            inside = np.maximum(mean[at, nearest], 0) * size[nearest] / np.where(alone, 1.0, size[nearest] - 1)
            mean[at, nearest] = np.inf
            outside = np.maximum(mean.min(axis=1), 0)
            larger = np.maximum(inside, outside)
            shape = np.where(alone | (larger == 0), 0.0, (outside - inside) / np.where(larger > 0, larger, 1.0))
            yield k, float(shape.sum())

    def totals(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[int, float] = {}
        for _, values in _unpacked(batches, width):
            for k, total in shapes(values.T):
                found[k] = found.get(k, 0.0) + total
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.float64())], ["k", "total"])

    width = next(iter(centres.values())).shape[1]
    rows = packed.mapInArrow(totals, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()  # one for each number
    found = {r["k"]: r["total"] for r in rows}
    return {k: found[k] / n if k in found else None for k in centres}


def k_means(vectors: DataFrame, numbers: Sequence[int], n: int, seed: int = 42, steps: int = STEPS):
    """(centres, sums, silhouettes) for each number of clusters, all fitted in the same passes.

    The starts come from ``START_ROWS`` different rows, those with the smallest
    hashes; every step, the sizes and the silhouettes come from all rows.  A
    number whose centres have settled leaves the later passes.  Once a number's
    centres move little, its steps read only the rows near the borders of two
    clusters, as the sums of all others stay (see :class:`_Held`).
    """
    sample, weights = _sample(vectors)
    packed = durable(_packed(spread(vectors)))  # read by every step
    centres = _starts(sample, numbers, seed, weights)
    moving, sums = dict(centres), {}
    held: dict[int, _Held] = {}
    pace: dict[int, float] = {}
    for _ in range(steps):
        if not moving:
            break
        held = {k: h for k, h in held.items() if k in moving and h.holds(moving[k])}
        found = {}
        whole = {k: c for k, c in moving.items() if k not in held}
        if whole:
            margins = {k: m for k, c in whole.items() if (m := _margin(sample, weights, c, pace.get(k))) is not None}
            if margins:
                parts = durable(_assigned(packed, whole, margins))
                found = _added(parts, whole)
                held |= {k: _Held(whole[k], margin, found[k], parts) for k, margin in margins.items()}
            else:
                found = _moved(packed, whole)
        if held:
            again = {k: moving[k] for k in held}
            tables = {id(h.parts): h.parts for h in held.values()}  # numbers that were told apart in one pass share one
            listed = reduce(DataFrame.unionAll, [
                parts.where((F.col("cluster") == -1) & F.col("k").isin([k for k, h in held.items() if h.parts is parts])).select("k", "rows")
                for parts in tables.values()
            ])
            near = _moved(listed, again)
            found |= {k: h.totals + near[k] for k, h in held.items()}
        for k, (size, squares, *total) in found.items():
            total = np.column_stack(total)
            means = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1.0)[:, None], moving[k])
            centres[k], sums[k] = moving[k], (size, squares, total)  # the sums are those of the rows nearest to these centres
            pace[k] = float(np.sqrt(((means - moving[k]) ** 2).sum(axis=1)).max())
            if pace[k] <= SETTLED:
                del moving[k]
            else:
                moving[k] = means
    return centres, sums, _silhouettes(packed, centres, sums, n)


def cluster_analysis(
    df: DataFrame, columns: Sequence[str] | None = None, n_clusters: int | None = None, keys: Sequence[str] = (),
    seed: int = 42, max_clusters: int = 8, steps: int = STEPS,
) -> Clusters:
    """K-means over the scaled columns of the complete rows.

    Without ``n_clusters``, the number from 2 to 8 with the best silhouette
    (squared Euclidean distance) is taken; all of them are fitted in the same
    passes over the data.  A cluster's centre is the mean of its rows; after
    ``steps`` steps each row is in the cluster that was nearest in the last one.
    Clusters are numbered by size.
    """
    names = pick_numeric(df, columns)
    if len(names) < 2:
        raise ValueError("clusters need two numeric columns")
    known = _known(df, names, keys)
    found = moments(known, [f"c{i}" for i in range(len(names))])
    if found is None or found.n < 10:
        raise ValueError("clusters need ten complete rows")
    scaled = _scaled(found)
    zs = [f"z{i}" for i in range(len(names))]
    vectors = known.select(*[z.alias(n) for n, z in zip(zs, scaled)])
    numbers = [n_clusters] if n_clusters is not None else list(range(2, min(max_clusters, found.n // 2) + 1))
    fitted, sums, scores = k_means(vectors, numbers, found.n, seed, steps)
    best = max(numbers, key=lambda k: -2 if scores[k] is None else scores[k])
    sizes, _, totals = sums[best]

    stds = np.where(found.std(ddof=0) > 0, found.std(ddof=0), 1.0)
    filled = np.flatnonzero(sizes > 0)
    centres = {c: totals[c] / sizes[c] * stds + found.means for c in filled}
    order = sorted(filled, key=lambda c: (-sizes[c], *centres[c]))
    spark = df.sparkSession
    clusters = spark.createDataFrame(
        [(rank, int(sizes[c]), float(sizes[c] * 100.0 / found.n), *map(float, centres[c])) for rank, c in enumerate(order)],
        "cluster int, size long, pct double, " + ", ".join(f"`{c}` double" for c in names),
    )
    # the nearest of the fitted centres, as an expression over the table; ties go to the first, as in the fit
    distance = lambda c: sum(
        ((z - F.lit(float(m))) * (z - F.lit(float(m))) for z, m in zip([F.col(n) for n in zs], fitted[best][c])),
        F.lit(0.0),
    )
    nearest = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(int(c)).alias("place"), F.lit(order.index(c)).alias("cluster")) for c in filled]))
    _, axes, _ = _axes(found, 2)
    placed = known.select("*", *[z.alias(n) for n, z in zip(zs, scaled)]).select(
        *[col(k) for k in keys], *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], nearest["cluster"].alias("cluster"),
        *_project([F.col(z) for z in zs], axes),
    )
    return Clusters(len(order), scores[best], clusters, placed)
