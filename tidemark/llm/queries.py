"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import shipped


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    return encode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir), digests=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import similarity_components

    return similarity_components(_documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import shard

    return shard(_documents(spark, sf_dir))


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .telephony import audio_digests

    return audio_digests(_documents(spark, sf_dir))


def op9_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .id_shards import id_documents

    return id_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Each query's scores against all rows; SQL has no bounds to prune by.
OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_voronoi_top_k": OP10_SQL}
