"""Corpus pipeline: language ID, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. ``run`` writes every stage as Parquet below
the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, language_mixture, packing, passage_chains, toxicity_grammar
from millrace.llm.common import clear, crc_fold, scope, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, or with none that half of their words are in."""
    model = language_mixture.fit(docs.where(crc_fold("doc_id", 4) != 2))
    return language_mixture.identify(docs, model, keep=COLUMNS).where(~language_mixture.rejects()).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the pattern grammar calls toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold("doc_id", 4) != 2)
    model = toxicity_grammar.fit(docs, labels)
    return toxicity_grammar.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with ``_m_row``, a number of their own in order of id, null ids last.

    Written before use, so that every reader sees the same numbers. Stages that tell rows
    apart by it neither join rows that lack an id nor mix texts that repeat one.
    """
    rows = docs.select(*COLUMNS).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(*COLUMNS))
    return staged(rows.withColumn("_m_row", F.monotonically_increasing_id()), "rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of each class of near copies (five words, 0.8): the one of least id, a null id after all others."""
    with scope("near_duplicates"):
        rows = numbered(docs)
        classes = jaccard_join.jaccard_components(rows, key="_m_row", k=5, percent=80, with_links=False)
    return rows.join(classes.where("_m_row = component_id").select("_m_row"), "_m_row", "left_semi").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier row holds out of later ones; a text of which nothing is left goes."""
    with scope("passages"):
        rows = numbered(docs)
        clear(spark, "near_duplicates")  # its result has been copied
        spans = passage_chains.repeated_passages(rows, key="_m_row")
    cut = passage_chains.cut_passages(rows, spans, key="_m_row")
    left = cut.where(F.col("text").isNull() | (F.length(F.trim("text")) > 0) | (F.col("n_chars") == 0))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left."""
    import public_tokenizers

    with scope("packing"):
        pieces = staged(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "pieces")
        clear(spark, "passages")  # its result has been read
        return packing.pack(pieces)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("packing", sequences),
]

#: No stage could be written in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
