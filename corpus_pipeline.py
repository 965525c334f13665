"""A corpus pipeline over the table ``documents``: filter, de-duplicate, decontaminate and pack.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``, and other columns pass through untouched.

Edge cases: a null or empty text is not toxic, has no language and goes at the second stage; rows with a null id are
judged like any other; a row that is repeated stands once after the near-duplicate stage, and of texts that are
near copies the row of the smallest id stays (of equal ids, that of the smallest text hash; a null id comes last); an
empty table passes every stage and gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, packing, simhash, tokens, toxicity
from tidemark.llm.common import fold
from tidemark.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labelled rows outside the fold that is held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return toxicity.without_toxic(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are near some learned profile."""
    profiles = langid.learn_profiles(langid.learnable(docs, fold(F.col("doc_id"), 4) == 2))
    return langid.in_known_language(docs, profiles)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    By SimHash with an index of byte positions and count filtering; five-word shingles, verified similarity of 0.8.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens, piece by piece, with their ids."""
    return packing.harmonic_pack(docs, tokens.public_vocabulary(), capacity=1024, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Hashing, learned models and tokenization can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
