"""SimHash near-duplicates by vantage-point trees.

Fingerprints of 64 bits link when at most ``radius`` bits differ.  A
vantage-point tree splits fingerprints by their Hamming distance to a chosen
one: those up to ``mu`` are near, the others far, and by the triangle
inequality only fingerprints within the radius behind that border can have a
partner across it, so those go to both sides.  Whoever is within the radius of
another then meets it in at least one shard, and inside a shard the same kind
of tree prunes on until few enough are left to compare.

Over all 64 bits the distances of unlike texts crowd around 32, so that a
radius of 4 would copy two thirds of the fingerprints at every split.  The
trees are therefore built on three slices of the bits: two fingerprints that
differ in at most 4 bits differ in at most 1 within some slice, and there the
border is thin.  Candidates are compared in all 64 bits: the links are exact.

The upper part of the trees is planned on a sample of fingerprints that grows
with their number, ``SAMPLE`` to ``MOST_SAMPLE`` of 8 bytes; that only decides
where shards end, every fingerprint is searched.  Equal fingerprints are one point, a shard returns a spanning forest
of its links rather than the links of every pair, and forests are joined by
:func:`loupe.llm.graph.components`.

Defined results: NULL and empty texts, and those of white space alone, have
fingerprint 0; repeated rows and equal doc_ids are in one group if their texts
link; a NULL doc_id never names a group that has another; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from loupe.frames import col, require
from loupe.llm.graph import components
from loupe.llm.rows import fresh, row_key, text_of
from loupe.session import durable

WORDS, RADIUS, SEED = 4, 4, 42
SLICES = (21, 21, 22)
#: fingerprints that plan the trees' upper part, at least and at most; points a shard should hold; sampled points a leaf of the plan needs
SAMPLE, MOST_SAMPLE, SHARD, LEAST_SAMPLE = 1 << 16, 1 << 22, 1 << 16, 16
#: points that are compared with each other at once
BLOCK = 256


def simhash(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number."""
    import numpy as np
    import xxhash

    parts = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at the six ASCII blanks
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    hashed = xxhash.xxh64_intdigest
    if len(parts) < words:
        return hashed(joined, seed)
    ones, n = np.zeros(64, dtype=np.int64), len(parts) - words + 1
    for k in range(0, n, 1 << 16):
        block = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[k : min(n, k + (1 << 16))], ends[k + words - 1 :])], dtype="<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(texts: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batch):  # noqa: ANN001
        import numpy as np
        import pandas as pd

        return pd.Series(np.array([simhash(t, words, seed) for t in batch], dtype=np.uint64).view(np.int64))

    return of(texts)


def as_hex(fingerprint: str) -> Column:
    return F.lpad(F.lower(F.hex(col(fingerprint))), 16, "0")


def best_border(distances, radius: int):
    """(mu, cost): the border that leaves the fewest pairs, and the share of them left."""
    import numpy as np

    share = np.cumsum(np.bincount(distances, minlength=1)) / len(distances)
    behind = np.append(share[radius:], np.ones(min(radius, len(share))))[: len(share)]
    cost = behind**2 + (1 - share) ** 2
    mu = int(np.argmin(cost))
    return mu, float(cost[mu])


def vantage(points, mask, radius: int, choose):
    """(vantage, mu) of the best of a few random vantage points, or None if none prunes."""
    import numpy as np

    best = None
    for p in points[choose.integers(0, len(points), 4)]:
        mu, cost = best_border(np.bitwise_count((points ^ p) & mask), radius)
        if best is None or cost < best[0]:
            best = cost, p, mu
    return best[1:] if best[0] < 0.85 else None


def plan_tree(sample, mask, radius: int, least: int, depth: int, choose, shard=None):
    """Nested (vantage, mu, near, far); a leaf is its number from the iterator ``shard``."""
    import numpy as np

    split = vantage(sample, mask, radius, choose) if depth and len(sample) >= 2 * least else None
    if split is None:
        return next(shard)
    p, mu = split
    d = np.bitwise_count((sample ^ p) & mask)
    return (
        int(p), mu,
        plan_tree(sample[d <= mu + radius], mask, radius, least, depth - 1, choose, shard),
        plan_tree(sample[d > mu], mask, radius, least, depth - 1, choose, shard),
    )


def shards(tree, points, mask, radius: int) -> Iterator:
    """(leaf, points) of all leaves that the points belong to."""
    import numpy as np

    if not len(points):
        return
    if not isinstance(tree, tuple):
        yield tree, points
        return
    p, mu, near, far = tree
    d = np.bitwise_count((points ^ np.uint64(p)) & mask)
    yield from shards(near, points[d <= mu + radius], mask, radius)
    yield from shards(far, points[d > mu], mask, radius)


def forest(points, mask, slice_radius: int, radius: int):
    """(point, root) for the linked ones among distinct points, by a local tree."""
    import numpy as np

    choose = np.random.default_rng(7)
    parent = np.arange(len(points))

    def roots(at):
        r = parent[at]
        while (parent[r] != r).any():
            r = parent[r]
        parent[at] = r
        return r

    def compare(at) -> None:
        own = points[at]
        for k in range(0, len(at), BLOCK):
            near = np.bitwise_count(own[k : k + BLOCK, None] ^ own[None, k:]) <= radius
            for i in np.flatnonzero(near.sum(axis=1) > 1):
                found = np.unique(roots(at[k + np.flatnonzero(near[i])]))
                parent[found] = found[0]

    waiting = [np.arange(len(points))]
    while waiting:
        at = waiting.pop()
        split = vantage(points[at], mask, slice_radius, choose) if len(at) > 2 * BLOCK else None
        if split is None:
            compare(at)
            continue
        d = np.bitwise_count((points[at] ^ split[0]) & mask)
        waiting += [at[d <= split[1] + slice_radius], at[d > split[1]]]
    root = roots(np.arange(len(points)))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return points[linked], points[root[linked]]


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints that link, from distinct ``fingerprint`` rows."""
    import numpy as np

    n = points.count()
    size = min(max(SAMPLE, 4 * LEAST_SAMPLE * (n // SHARD)), MOST_SAMPLE)
    sample = points.orderBy(F.xxhash64("fingerprint")).limit(size).toPandas()["fingerprint"].to_numpy(dtype=np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))) + 2)
    choose = np.random.default_rng(11)
    number = iter(range(1 << 40))
    within = radius // len(SLICES)
    trees, shift, mask_of = [], 0, {}
    for width in SLICES:
        mask = np.uint64(((1 << width) - 1) << shift)
        first = next(number)
        trees.append((mask, plan_tree(sample, mask, within, LEAST_SAMPLE, depth, choose, number)))
        mask_of[first] = int(mask)
        shift += width
    firsts = sorted(mask_of)

    def deal(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            own = batch["fingerprint"].to_numpy(dtype=np.int64).view(np.uint64)
            rows = [(leaf, part.tobytes()) for mask, tree in trees for leaf, part in shards(tree, own, mask, within)]
            yield pd.DataFrame(rows, columns=["shard", "points"])

    def search(shard):
        import pandas as pd

        own = np.unique(np.frombuffer(b"".join(shard["points"]), dtype=np.uint64))
        mask = mask_of[max(f for f in firsts if f < shard["shard"].iloc[0])]
        a, b = forest(own, np.uint64(mask), within, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.mapInPandas(deal, "shard long, points binary").groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, row, fingerprint, group, component_id) of every row.

    ``row`` is the row's key, ``group`` a fingerprint that names the component:
    unlike texts of one doc_id share a component_id, but not a group.
    """
    require(docs, "doc_id", "text")
    marked = docs.select("doc_id", row_key(docs).alias("row"), fingerprint(text_of(), words).alias("fingerprint"))
    marked = durable(marked)
    points = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    groups = components(durable(links(points.select("fingerprint"), radius)))
    # only what links is grouped: a fingerprint without links is a group of its own
    groups = durable(groups.withColumnsRenamed({"node": "fingerprint", "component": "group"}))
    linked = points.join(groups, "fingerprint")
    names = linked.groupBy("group").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "group").select("fingerprint", "group", "component_id").unionByName(
        points.join(groups, "fingerprint", "left_anti").select("fingerprint", F.col("fingerprint").alias("group"), F.col("least").alias("component_id"))
    )
    return marked.join(named, "fingerprint")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Of each group the document with the smallest doc_id, once, with all its columns."""
    found = near_duplicates(docs, words, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    row = fresh(docs, "_row")
    kept = found.groupBy("group").agg(first).select(F.col("first.row").alias(row)).distinct()
    return docs.withColumn(row, row_key(docs)).join(kept, row).dropDuplicates([row]).select(*[col(c) for c in docs.columns])
