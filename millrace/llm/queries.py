"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_ngrams, jaccard_join, language_mixture, line_frequency, one_bit_search, packing, passage_chains, piece_lattice, sharding, toxicity_grammar
from .common import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_search.nearest(_table(spark, sf_dir, "embeddings"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_quality(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    train = _table(spark, sf_dir, "labels").where(crc_fold("doc_id", 4) != 2)
    model = toxicity_grammar.fit(docs, train)
    return toxicity_grammar.score(docs.withColumn("held_out", crc_fold("doc_id", 4) == 2), model)


def op4_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_mixture.fit(docs.where(crc_fold("doc_id", 4) != 2))
    rows = docs.select("doc_id", "text", (crc_fold("doc_id", 4) == 2).alias("held_out"))
    return language_mixture.identify(rows, model)


def op6_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_chains.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


def op8_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold("doc_id", 10) == 0).alias("held_out"))
    model, counts = class_ngrams.fit(docs.where(~F.col("held_out")))
    return class_ngrams.score(docs, model, counts, keep=["doc_id", "held_out"])


def op9_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_lattice.encode_documents(_table(spark, sf_dir, "documents"), piece_lattice.load(public_tokenizers.path("piece_bpe_32k.model")))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.jump_shards(rows, ["doc_id"], 8, order=["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_one_bit_search": op1_one_bit_search,
    "op2_line_frequency": op2_line_frequency,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_tiles": op4_jaccard_tiles,
    "op5_language_mixture": op5_language_mixture,
    "op6_passage_chains": op6_passage_chains,
    "op7_cutting_stock": op7_cutting_stock,
    "op8_class_ngrams": op8_class_ngrams,
    "op9_piece_lattice": op9_piece_lattice,
    "op10_jump_sharding": op10_jump_sharding,
}
