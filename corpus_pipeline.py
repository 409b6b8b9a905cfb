"""From raw documents to packed training sequences, stage by stage.

Every stage takes what the one before it kept.  The stages filter by quality,
keep one document of each group of near-duplicates, cut passages that appear
earlier, repeat or leave documents to mix their sources, and pack the result
into sequences of tokens.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loupe.frames import col
from loupe.llm import mixing, packing, quality, repeats, simhash
from loupe.llm.rows import fresh, text_of
from loupe.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(durable(quality.with_features(docs)), labels)
    given, score = fresh(docs, "_features"), fresh(docs, "_score")
    scored = quality.scored(docs.withColumn(given, quality.features(text_of())), model, given, score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*[col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes that repeat something earlier; ``n_chars`` follows the text."""
    cut = repeats.remove_repeats(docs).select(*[col(c) for c in docs.columns])
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of fixed capacity."""
    return packing.pack_documents(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: fitted scores, fingerprints and tokens have no SQL; the tests compare with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
