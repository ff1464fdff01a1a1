"""From raw documents to packed training sequences: five stages, each an operator of ``origintrace.llm``.

Every stage reads what the one before has written, whole. Quality and toxicity drop what they reject, near
duplicates leave one document of each group, mixing repeats documents of small sources, and packing lays out
what is left.

Stages hand whole texts to Python, and the memory for that goes with the texts of one Arrow batch. So the stages
ask for batches of few rows and bytes; the settings are the session's and stay there, as results are lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from origintrace.llm import mixing, packing, quality_crf, simhash, toxicity
from origintrace.llm.columns import fresh
from origintrace.llm.tokens import default_tokenizer
from origintrace.sources.staging import stage

#: The flattest mix in which no source is passed over more than one and a half times, and none less than once.
MIX = mixing.Target(repeats=1.5)
#: Rows and bytes of an Arrow batch of texts, at most (one longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score reaches the threshold. Null and empty texts are scored like others."""
    _small_batches(spark)
    model = quality_crf.fit(docs, _labels(spark, sf_dir))
    return docs.where(model.score("text") >= quality_crf.THRESHOLD)


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose expected severity stays below the threshold. Null and empty texts stay."""
    _small_batches(spark)
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return docs.where(model.severity("text") < toxicity.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    _small_batches(spark)
    return simhash.keep_one(docs, width=3, distance=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources more often. A null source is one of its own."""
    epoch = fresh(docs, "mix_epoch")
    return mixing.mix(docs, MIX, epoch=epoch).drop(epoch)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    _small_batches(spark)
    return packing.pack(packing.pieces_of(docs, default_tokenizer()))


STAGES = [("quality", quality), ("toxicity", nontoxic), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Fitted models and fingerprints are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
