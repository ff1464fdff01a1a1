"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from origintrace.llm import (
    cover_tree, language_model, line_dedup, merkle, mixing, packing, posting_lists, quality_crf, simhash, spelling, token_shards,
    toxicity, warc,
)
from origintrace.llm.sampling import fold
from origintrace.llm.tokens import ROOMIEST, ROOMY, default_tokenizer

#: What ``op8_mixing`` aims at: the flattest mix in which no source is passed over more than so often.
MIX = mixing.Target(repeats=2.0)
#: What a leaf of ``op13_merkle`` covers, in this order.
MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _in_fold(number: int):
    """Whether a document is held out; a null id is in no fold."""
    return F.coalesce(fold("doc_id") == number, F.lit(False)).alias("held_out")


def op1_cover_tree(spark, d):
    return cover_tree.search(_table(spark, d, "embeddings"), k=5, every=50)


def op2_token_shards(spark, d):
    documents = _table(spark, d, "documents")
    return token_shards.read(documents, token_shards.write(documents, default_tokenizer(), memo=ROOMY))


def op3_toxicity(spark, d):
    documents = _table(spark, d, "documents")
    model = toxicity.fit(documents, _table(spark, d, "labels"))
    scored = documents.select("doc_id", _in_fold(toxicity.HELD_OUT_FOLD), model.severity("text").alias("severity"))
    return scored.withColumn("toxic", (F.col("severity") >= toxicity.THRESHOLD).cast("int"))


def op4_language_model(spark, d):
    return language_model.score_corpus(_table(spark, d, "documents"))


def op5_packing(spark, d):
    return packing.pack(packing.pieces_of(_table(spark, d, "documents"), default_tokenizer(), memo=ROOMIEST))


def op6_warc(spark, d):
    return warc.read(warc.write(_table(spark, d, "pages"))).drop("payload", "url")


def op7_quality(spark, d):
    documents = _table(spark, d, "documents")
    model = quality_crf.fit(documents, _table(spark, d, "labels"))
    scored = documents.select("doc_id", _in_fold(quality_crf.HELD_OUT_FOLD), model.score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_crf.THRESHOLD).cast("int"))


def op8_mixing(spark, d):
    mixed = mixing.mix(_table(spark, d, "documents"), MIX)
    return mixed.select(
        "doc_id", "source", F.col("mix_epoch").alias("epoch"), mixing.token_count("text").alias("tokens"),
        mixing.permutation("doc_id", MIX.seed).alias("place"),
    )


def op9_posting_lists(spark, d):
    return posting_lists.search(_table(spark, d, "embeddings"), k=20, every=20)


def op10_simhash(spark, d):
    found = simhash.near_duplicates(_table(spark, d, "documents"), width=3, distance=3)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op11_line_dedup(spark, d):
    kept = line_dedup.drop_repeated_lines(_table(spark, d, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_spelling(spark, d):
    return spelling.variants(spelling.word_counts(_table(spark, d, "documents"), noise=97))


def op13_merkle(spark, d):
    changed = [F.col("n_chars").cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in MANIFEST]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf(*changed)).otherwise(merkle.leaf(*MANIFEST))
    proved = merkle.manifest(
        _table(spark, d, "documents"), MANIFEST, group="lang", order="doc_id", keep={"doc_id": F.col("doc_id"), "tampered": tampered}
    )
    folded = merkle.folded("tampered", "witness", "position", "nodes", "group_position", "groups")
    text = merkle.hexadecimal
    return proved.withColumn("folded", folded).select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("witness").cast("binary"), 256).alias("proof_sha256"), text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def queries():
    return {
        "op1_cover_tree": op1_cover_tree,
        "op2_token_shards": op2_token_shards,
        "op3_toxicity": op3_toxicity,
        "op4_language_model": op4_language_model,
        "op5_packing": op5_packing,
        "op6_warc": op6_warc,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_posting_lists": op9_posting_lists,
        "op10_simhash": op10_simhash,
        "op11_line_dedup": op11_line_dedup,
        "op12_spelling": op12_spelling,
        "op13_merkle": op13_merkle,
    }
