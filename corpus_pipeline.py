"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode
from tidemark.llm.language_id import keep_identified
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near import keep_one_of_each
from tidemark.llm.shared import table
from tidemark.llm.suffix_dedup import without_repeats
from tidemark.shipping import shipped

#: SQL has no language models, suffix arrays or vocabularies.
ORACLE_SQL = None


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; models fitted on the labelled rows of docs."""
    return keep_identified(docs)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: the smallest doc_id."""
    return keep_one_of_each(docs)


@shipped
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes and more that a document with a smaller doc_id holds too."""
    return without_repeats(docs)


@shipped
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of sources, once for each epoch that takes any of their words."""
    return mixed_documents(docs)


@shipped
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text that they decode to."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("source", "lang"), digests=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
