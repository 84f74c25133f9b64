"""A training corpus from raw documents: language ID, near-dedup, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm import langid, mixing, packing, secrets, simhash
from framewell.session import materialise, on_workers, release

#: A text that costs so many bits a byte in its best language is no text in any of them (even bytes cost 8).
REJECT_BITS = 7.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no language's statistics compress, go."""
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.keep_identified(docs, model, REJECT_BITS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose shingles of five words are alike to 0.8 or more, the one with the smallest id stays."""
    return simhash.keep_first(docs, simhash.similar_documents(docs, shingle=5, similarity=0.8))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret becomes a mark; the documents stay."""
    names = docs.columns
    found = secrets.scan(docs, keep=tuple(c for c in names if c not in ("text", "n_chars")))
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each time it takes some."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    return packing.pack(docs)


def _ready(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)  # the stage before is written
        return stage(on_workers(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _ready(language_id)),
    ("simhash_near_dedup", _ready(near_dedup)),
    ("secret_scan", _ready(redact_secrets)),
    ("mixing", _ready(mix_sources)),
    ("packing", _ready(pack_sequences)),
]

#: SQL can't express the language model, the trees or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
