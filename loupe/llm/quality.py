"""Quality classifier: ridge regression on random Fourier features, calibrated.

A text becomes a few statistics of its characters, words and lines.  Random
Fourier features of the standardised statistics approximate a Gaussian kernel.
Every partition sums its part of the normal equations, the sums are added up
strip by strip, and only their total, of a size that depends on the number of
features alone, reaches the driver, which solves for the ridge weights.  Other
labelled rows, counted in a fixed number of bins of the score, calibrate it by
isotonic regression (pool adjacent violators).

All labelled rows take part; nothing is sampled.  The only input of a score is
the text.

Defined results: NULL is the empty text, whose statistics are 0 and which is
scored like any other; several labels of a doc_id count with their mean, NULL
ones not at all; without labelled rows every score is 0.5; no rows give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loupe.frames import col
from loupe.llm.rows import fresh, text_of

FOURIER, RIDGE, SEED = 512, 1.0, 3
#: rows of the normal equations in a strip; bins of the calibration
STRIP, BINS = 64, 1000
THRESHOLD = 0.3
#: fixed: bytes by kind
SYMBOLS, STOPS = b"#$%&*@^~|<>=+_\\/{}[]", b".,;:?"


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, all finite."""
    import numpy as np

    raw = text.encode()
    if not raw:
        return [0.0] * N_STATISTICS
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = counts / n
    words = raw.split()
    lines = raw.split(b"\n")
    n_words = len(words)
    known = share[share > 0]
    capitals, small = share[65:91].sum(), share[97:123].sum()
    lengths = [len(w) for w in words]
    return [
        np.log1p(n), np.log1p(n_words), np.log1p(len(lines)),
        n_words and sum(lengths) / n_words, min(100, max(lengths, default=0)) / 10,
        capitals, small, capitals / (capitals + small + 1e-9), share[48:58].sum(), share[128:].sum(),
        share[32], share[list(SYMBOLS)].sum(), share[list(STOPS)].sum(), share[33], share[124],
        -(known * np.log2(known)).sum(), share.max(),
        n_words and len(set(words)) / n_words,
        n_words and len(set(words)) / n_words**0.8,
        n_words and sum(map(bytes.__eq__, words, words[1:])) / n_words,
        n_words and sum(map(bytes.isupper, words)) / n_words,
        n_words and sum(map(bytes.isalpha, words)) / n_words,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    ]


N_STATISTICS = 24


def features(text: Column) -> Column:
    """The statistics as an array."""

    @F.pandas_udf("array<double>")
    def of(texts):  # noqa: ANN001
        return texts.map(lambda t: [float(x) for x in statistics(t)])

    return of(text)


@dataclass
class Model:
    """Standardisation, Fourier features, weights and the steps of the calibration."""

    mean: object
    scale: object
    turn: object
    phase: object
    weights: object = None
    raw: object = None
    level: object = None

    def fourier(self, rows):
        import numpy as np

        flat = (rows - self.mean) / self.scale
        waves = np.cos(np.clip(flat, -8, 8) @ self.turn + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([waves, np.ones(len(rows))])

    def score(self, rows):
        import numpy as np

        if self.weights is None:
            return np.full(len(rows), 0.5)
        raw = self.fourier(rows) @ self.weights
        return np.interp(raw, self.raw, self.level) if self.raw is not None else np.clip(raw, 0, 1)


def matrix(values):
    import numpy as np

    return np.array(values.tolist(), dtype=np.float64).reshape(len(values), -1)


def normal_equations(rows: DataFrame, model: Model):
    """(Z'Z, Z'y) over rows (features, y), summed by partition and strip."""
    import numpy as np

    width = len(model.phase) + 1

    def sums(batches: Iterator) -> Iterator:
        import pandas as pd

        total = np.zeros((width, width + 1))
        for batch in batches:
            if len(batch):
                z = model.fourier(matrix(batch["features"]))
                total += z.T @ np.column_stack([z, batch["y"].to_numpy(dtype=np.float64)])
        yield pd.DataFrame([(k, total[k : k + STRIP].tobytes()) for k in range(0, width, STRIP)], columns=["strip", "sums"])

    def add(batches: Iterator) -> Iterator:
        import pandas as pd

        totals: dict[int, object] = {}
        for batch in batches:
            for strip, part in zip(batch["strip"], batch["sums"]):
                totals[strip] = totals.get(strip, 0) + np.frombuffer(part)
        yield pd.DataFrame([(k, v.tobytes()) for k, v in totals.items()], columns=["strip", "sums"])

    schema = "strip int, sums binary"
    parts = rows.mapInPandas(sums, schema).repartition("strip").mapInPandas(add, schema).orderBy("strip").collect()
    total = np.concatenate([np.frombuffer(p["sums"]).reshape(-1, width + 1) for p in parts])
    return total[:, :width], total[:, width]


def pool(x, total, count):
    """Isotonic levels: (mean x, mean y) of pooled neighbours, from sums by bin in order."""
    blocks: list[list[float]] = []
    for sx, sy, n in zip(x, total, count):
        blocks.append([sx, sy, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # half a label of either kind keeps the ends from 0 and 1
    return [sx / n for sx, _, n in blocks], [(sy + 0.5) / (n + 1) for _, sy, n in blocks]


def fit(train: DataFrame, calibrate: DataFrame, fourier: int = FOURIER, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model from rows (features, y) for the weights and others for the calibration."""
    import numpy as np

    facts = train.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    if not facts:
        return Model(0.0, 1.0, None, None)
    choose = np.random.default_rng(seed)
    p = len(facts)
    model = Model(
        np.array([f["m"] for f in facts]), np.array([max(f["s"], 1e-6) for f in facts]),
        choose.normal(size=(p, fourier)) / np.sqrt(p), choose.uniform(0, 2 * np.pi, fourier),
    )
    gram, right = normal_equations(train, model)
    model.weights = np.linalg.solve(gram + ridge * np.eye(len(gram)), right)

    @F.pandas_udf("double")
    def raw(rows):  # noqa: ANN001
        import pandas as pd

        return pd.Series(model.fourier(matrix(rows)) @ model.weights)

    binned = calibrate.select(raw("features").alias("raw"), "y").withColumn(
        "bin", F.floor(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * (BINS // 2))
    )
    bins = binned.groupBy("bin").agg(F.sum("raw").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        x, level = pool([b["x"] for b in bins], [b["y"] for b in bins], [b["n"] for b in bins])
        # rising on beyond the last levels, so that no two scores are made equal
        model.raw, model.level = np.array([x[0] - 2, *x, x[-1] + 2]), np.array([0.0, *level, 1.0])
    return model


def scored(df: DataFrame, model: Model, given: str = "features", name: str = "score") -> DataFrame:
    """Add the score from a column of statistics, as ``name`` or, where a column has it, with ``_`` behind."""

    @F.pandas_udf("double")
    def of(rows):  # noqa: ANN001
        import pandas as pd

        return pd.Series(model.score(matrix(rows)))

    return df.withColumn(fresh(df, name), of(col(given)))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 5: 0 is held out, 4 calibrates."""
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def learn(rows: DataFrame, labels: DataFrame) -> Model:
    """A model from rows (doc_id, features) and labels (doc_id, quality), without the held-out ids."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    joined = rows.select("doc_id", "features").join(known, "doc_id")
    return fit(joined.where(remainder().isin(1, 2, 3)), joined.where(remainder() == 4))


def with_features(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", features(text_of()).alias("features"))
