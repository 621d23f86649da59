"""A corpus made ready for training: quality, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives rows with the columns of documents, whatever these are called; the last
one gives token ids.

Null texts count as empty, and empty texts are copies of each other. A row without an id is a copy only of equal texts (the
row with an id stays, if there is one), is no near copy of others, and is mixed by its text. Rows that share an id stay
unless they are copies; near ones among them go together. Ties go to the smallest id. Long texts are whole in each stage,
and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import bpe, exact_dedup, minhash_dedup, mixing, quality
from curata.llm.common import drop_staged, settled


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels that are not held out."""
    net = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = ["text" if c.lower() == "text" else f"c{k}" for k, c in enumerate(docs.columns)]  # none is the score's
    scored = quality.scored(docs.toDF(*names), net, names, "score")
    return scored.where(F.col("score") >= quality.CUT).drop("score").toDF(*docs.columns)


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    return exact_dedup.survivors(docs)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 of their 5-word shingles, the one with the smallest id."""
    return minhash_dedup.survivors(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same expected number of rows, in shuffled order."""
    return mixing.replicated(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and decoded_sha256, of the bytes that the ids decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(docs.select("doc_id", "source", "text"), path, pattern).drop("text")
    return both.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup_filter),
    ("minhash near-dedup", near_dedup_filter),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The classifier's answers cannot be expressed in SQL; tests/llm checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        given, docs = docs, settled(lambda f=stage, given=docs: f(spark, given, sf_dir), f"stage{k}")
        if k:
            drop_staged(given)
    return STAGES[-1][1](spark, docs, sf_dir)
