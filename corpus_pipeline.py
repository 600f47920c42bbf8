"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality classifier -> exact dedup -> SimHash near-dedup -> mixing to target
weights -> packing. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import drop, staged
from inkwell.llm.exact import exact_dedup
from inkwell.llm.mixing import mixed_rows
from inkwell.llm.packing import pack
from inkwell.llm.quality import fit, good_rows
from inkwell.llm.simhash import near_dedup

#: The near-duplicate stage: words in a shingle, and the similarity from which texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null text is empty; null sources and languages are groups of their own; rows that repeat
    an id stay or go each by its own text. An empty table gives an empty one.
    """
    return good_rows(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the largest id; null text is empty, a null id stays only without any other.

    Of rows that repeat id and text one stays. An empty table gives an empty one.
    """
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; null text is empty, a null id stays only without any other.

    Texts without words are alike; of rows that repeat id and text one stays. An empty table gives an empty one.
    """
    return near_dedup(docs, shingle=SHINGLE, similarity=SIMILARITY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    A null source is a source; documents without words, null ones too, stay once; rows that
    repeat an id are documents of their own. An empty table gives an empty one.
    """
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into windows.

    A null or empty text is its end mark alone; rows that repeat an id are documents of
    their own, which share their id. An empty table gives no pieces.
    """
    return pack(docs).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]
#: A fitted model, a hash and a tokenizer have no SQL form; tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
        if i and i + 1 < len(STAGES):
            drop(before)
    return docs
