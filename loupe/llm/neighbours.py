"""Nearest neighbours by inner product with multi-index hashing.

Vectors get binary codes: centred on the mean, turned by their principal
components and by learned rotations that bring them close to the corners of a
cube (several rotations, 256 bits in all), one bit a coordinate.  A code falls
into substrings of 16 bits, and every shard of the index keeps, per substring,
the sorted values with their lists of codes.  If two codes differ in at most
``radius`` bits, then by the pigeonhole principle one of the first
``radius % m + 1`` of m substrings differs in at most ``radius // m`` bits or
another in less, so probing the values that near finds every code within the
radius.  Those are compared by their floats, in double precision.

For inner products all vectors are first brought to one length with an extra
coordinate.  Mean, rotations and radius come from a bounded sample
(``SAMPLE``): the radius is the ``COVER`` quantile of the code distances
between sampled vectors and their true neighbours among the sample.  Every row
is indexed.  Queries for which the radius holds too few vectors are searched
again without one.

Equal vectors are one entry that keeps the k + 1 smallest ids, which is all
that a result can show of them.  A shard's index is built once, and the blocks
of queries, which are small beside it, are streamed past it; blocks' results
are merged in a stream.

Defined results: vectors that are NULL, zero, hold NULL or non-finite numbers
or have another dimension than most, and rows with NULL ids, take no part;
rows that share an id are not neighbours of each other; with fewer than k
candidates all are returned; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from loupe.frames import col, require
from loupe.session import durable

K = 20
BITS, SUBSTRING = 256, 16
#: vectors that mean, rotations and radius are learned from, and those of them that are queries
SAMPLE, SAMPLE_QUERIES = 20_000, 1_000
COVER = 0.98
STEPS = 20
#: vectors of the index in a shard, at least so many where there are fewer shards than cores, and queries in a block
SHARD, LEAST_SHARD, BLOCK = 1 << 16, 1 << 12, 512


@dataclass
class Codes:
    """Mean, projections (one matrix) and radius; ``length`` is the longest vector's."""

    mean: object
    turn: object
    radius: int
    length: float

    def level(self, vectors, query: bool):
        import numpy as np

        squares = np.einsum("ij,ij->i", vectors, vectors)
        if query:
            return np.column_stack([vectors * (self.length / np.sqrt(squares))[:, None], np.zeros(len(vectors))])
        return np.column_stack([vectors, np.sqrt(np.maximum(self.length**2 - squares, 0.0))])

    def encode(self, vectors, query: bool = False):
        """Codes as rows of 16-bit substrings."""
        import numpy as np

        bits = (self.level(vectors, query) - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn(sample, length: float, k: int = K) -> Codes:
    import numpy as np

    codes = Codes(np.zeros(sample.shape[1] + 1), None, BITS, length)
    levelled = codes.level(sample, False)
    codes.mean = levelled.mean(axis=0)
    centred = levelled - codes.mean
    dims = min(64, sample.shape[1])
    main = np.linalg.svd(centred[:SAMPLE], full_matrices=False)[2][:dims].T
    if main.shape[1] < dims:  # fewer vectors than dimensions
        main = np.eye(centred.shape[1])[:, :dims]
    flat = centred @ main
    choose = np.random.default_rng(5)
    turns = []
    for _ in range(-(-BITS // dims)):
        turn = np.linalg.qr(choose.normal(size=(dims, dims)))[0]
        for _ in range(STEPS):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        turns.append(main @ turn)
    codes.turn = np.column_stack(turns)[:, :BITS]
    if len(sample) > k:
        other, distances = codes.encode(sample), []
        for first in range(0, min(len(sample), SAMPLE_QUERIES), 100):
            asked = sample[first : min(first + 100, SAMPLE_QUERIES)]
            scores = -(asked @ sample.T)
            scores[np.arange(len(asked)), np.arange(first, first + len(asked))] = np.inf
            near = np.argpartition(scores, k - 1, axis=1)[:, :k]
            distances.append(np.bitwise_count(codes.encode(asked, True)[:, None, :] ^ other[near]).sum(axis=2).ravel())
        codes.radius = int(np.quantile(np.concatenate(distances), COVER, method="higher"))
    return codes


class Index:
    """The substrings of a shard's codes, each sorted by value."""

    def __init__(self, codes):
        import numpy as np

        self.codes = codes
        self.wide = np.ascontiguousarray(codes).view(np.uint64)
        self.tables = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, counts = np.unique(codes[order, j], return_counts=True)
            self.tables.append((values, counts, order))

    def within(self, code, radius: int):
        """The codes within the radius of one."""
        import numpy as np

        found = np.zeros(len(self.codes), dtype=bool)
        share, rest = divmod(radius, len(self.tables))
        for j, (values, counts, order) in enumerate(self.tables):
            near = share if j <= rest else share - 1
            if near >= 0:
                probed = np.bitwise_count(values ^ code[j]) <= near
                found[order[np.repeat(probed, counts)]] = True
        at = np.flatnonzero(found)
        return at[np.bitwise_count(self.wide[at] ^ code.view(np.uint64)).sum(axis=1) <= radius]


def best(scores, owner, ids_of, k: int):
    """The first k + 1 (score, id) by falling score, then id; ``ids_of`` lists an entry's ids."""
    import numpy as np

    if len(scores) > k + 1:
        worst = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        scores, owner = scores[scores >= worst], owner[scores >= worst]
    pairs = sorted((-s, i) for s, o in zip(scores.tolist(), owner.tolist()) for i in ids_of[o])
    return pairs[: k + 1]


def usable(name: str) -> Column:
    vector = col(name)
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def search(queries: DataFrame, shards: DataFrame, codes: Codes, k: int, radius: int | None, n_shards: int, kind: str) -> DataFrame:
    """(entry, found): the first k + 1 ids with scores for each query entry.

    ``queries`` are rows (entry, vector, block); ``shards`` packed ones, their
    numbers of the ``kind`` that numpy names.
    """

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for block, part in batch.groupby("block"):
                vectors = np.array(part["vector"].tolist(), dtype=np.float64)
                rows.append((block, part["entry"].to_numpy(dtype=np.int64).tobytes(), vectors.astype(kind).tobytes()))
            yield pd.DataFrame(rows, columns=["block", "entries", "asked"])

    def meet(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for block, entries, asked, vectors, ids, sizes in zip(batch["block"], batch["entries"], batch["asked"], batch["vectors"], batch["ids"], batch["sizes"]):
                if vectors is not None:  # a shard, which comes before the blocks that ask it
                    ends = np.cumsum(np.frombuffer(sizes, dtype=np.int32)).tolist()
                    shard = np.frombuffer(vectors, dtype=kind).astype(np.float64).reshape(len(ends), -1)
                    flat = np.frombuffer(ids, dtype=np.int64).tolist()
                    ids_of = [flat[a:b] for a, b in zip([0, *ends], ends)]
                    index = None if radius is None else Index(codes.encode(shard))
                    continue
                entries = np.frombuffer(entries, dtype=np.int64)
                asked = np.frombuffer(asked, dtype=kind).astype(np.float64).reshape(len(entries), -1)
                own, everything = codes.encode(asked, True), np.arange(len(shard))
                found_entries, found_ids, found_scores = [], [], []
                for entry, vector, code in zip(entries.tolist(), asked, own):
                    at = everything if radius is None else index.within(code, radius)
                    pairs = best(shard[at] @ vector, at, ids_of, k)
                    found_entries += [entry] * len(pairs)
                    found_scores += [-s for s, _ in pairs]
                    found_ids += [i for _, i in pairs]
                rows.append((block, entries.tobytes(), np.array(found_entries, dtype=np.int64).tobytes(), np.array(found_ids, dtype=np.int64).tobytes(), np.array(found_scores).tobytes()))
            yield pd.DataFrame(rows, columns=["block", "entries", "owners", "ids", "scores"])

    def merge(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        here, kept = None, {}

        def rows():
            return pd.DataFrame(
                [(e, [{"vec_id": i, "score": -s} for s, i in pairs]) for e, pairs in kept.items()], columns=["entry", "found"]
            )

        for batch in batches:
            for block, entries, owners, ids, scores in zip(batch["block"], batch["entries"], batch["owners"], batch["ids"], batch["scores"]):
                if block != here and kept:
                    yield rows()
                    kept = {}
                here = block
                more: dict[int, list] = {e: [] for e in np.frombuffer(entries, dtype=np.int64).tolist()}
                for e, i, s in zip(*(np.frombuffer(x, dtype=t).tolist() for x, t in ((owners, np.int64), (ids, np.int64), (scores, np.float64)))):
                    more[e].append((-s, i))
                for e, pairs in more.items():
                    kept[e] = sorted(kept.get(e, []) + pairs)[: k + 1]
        yield rows()

    blocks = queries.repartition("block").sortWithinPartitions("block").mapInPandas(pack, "block long, entries binary, asked binary")
    # every block passes every shard, as packed rows: the stated queries against all rows
    nothing = lambda *names: {n: F.lit(None).cast("binary") for n in names}
    asking = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_shards - 1))))).withColumns(nothing("vectors", "ids", "sizes"))
    asked = shards.withColumns({"block": F.lit(-1).cast("long"), **nothing("entries", "asked")}).unionByName(asking)
    met = asked.repartition(max(1, n_shards), "shard").sortWithinPartitions("shard", "block").select("block", "entries", "asked", "vectors", "ids", "sizes")
    results = met.mapInPandas(meet, "block long, entries binary, owners binary, ids binary, scores binary")
    return results.repartition("block").sortWithinPartitions("block").mapInPandas(merge, "entry long, found array<struct<vec_id: long, score: double>>")


def nearest(vectors: DataFrame, queries: Column, k: int = K, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of the rows that ``queries`` picks.

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on them.
    """
    import numpy as np

    require(vectors, "vec_id", "embedding")
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], result)
    rows = rows.where(F.size("embedding") == sizes["n"]).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), queries.alias("asked")
    )
    # equal vectors: their smallest ids, limited by rank before the shuffle
    order = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("r", order).where(F.col("r") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where("asked").select("vector").distinct().withColumn("asked", F.lit(True))
    entries = durable(few.join(asked, "vector", "left").withColumn("entry", F.monotonically_increasing_id()))
    facts = entries.agg(
        F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
    ).first()
    sample = entries.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector").toPandas()["vector"]  # bounded
    codes = learn(np.stack(sample.to_list()), float(np.sqrt(facts["square"])), k)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_shards = max(-(-facts["n"] // SHARD), min(-(-facts["n"] // LEAST_SHARD), 2 * cores))
    # single-precision numbers are kept as they are; they are multiplied in double precision
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"

    def pack(batches: Iterator) -> Iterator:
        import pandas as pd

        names = ["shard", "vectors", "ids", "sizes"]

        def packed(shard, parts):
            part = pd.concat(parts)
            own = np.array(part["vector"].tolist(), dtype=np.float64)
            flat = np.concatenate([np.asarray(i, dtype=np.int64) for i in part["ids"]])
            return (shard, own.astype(kind).tobytes(), flat.tobytes(), part["ids"].map(len).to_numpy(dtype=np.int32).tobytes())

        here, held = None, []  # rows come sorted by shard
        for batch in batches:
            done = []
            for shard, part in batch.groupby("shard"):
                if shard != here and held:
                    done.append(packed(here, held))
                    held = []
                here = shard
                held.append(part)
            yield pd.DataFrame(done, columns=names)
        yield pd.DataFrame([packed(here, held)] if held else [], columns=names)

    numbered = entries.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(n_shards)).cast("int"))
    shards = durable(
        numbered.select("shard", "vector", "ids").repartition("shard").sortWithinPartitions("shard")
        .mapInPandas(pack, "shard int, vectors binary, ids binary, sizes binary")
    )
    asked = entries.where("asked").select("entry", "vector")
    blocks = -(-max(1, asked.count()) // BLOCK)
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(blocks)))
    found = durable(search(blocked, shards, codes, k, codes.radius if radius is None else radius, n_shards, kind))
    enough = F.size("found") >= min(k + 1, facts["ids"])
    again = blocked.join(found.where(~enough).select("entry"), "entry", "left_semi")
    whole = search(again, shards, codes, k, None, n_shards, kind)
    answers = found.where(enough).unionByName(whole).join(entries.select("entry", "vector"), "entry").select("vector", "found")
    own = rows.where("asked").select(F.col("vec_id").alias("query_id"), "vector").join(answers, "vector")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
