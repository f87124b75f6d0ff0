"""Hybrid retrieval: a vector ranking and a keyword ranking, fused by reciprocal ranks, and hits with their provenance.

The fusion is one union and one aggregate, not a full outer join. A hit's score is its cosine, not its fused
value, so scores needn't fall along the ranking; in keyword-only (degraded) search every score is 0.

Empty rankings fuse to nothing; a chunk in one ranking only gets that part. Null columns of a chunk become
empty strings, a null chunk_index 0. Ids without a chunk drop out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone import runtime
from siltstone.functions import text as tx
from siltstone.operators import lexical, vector

# The constant of reciprocal rank fusion, the default and largest k, and the candidate pool.
RRF_K = 60
K_DEFAULT, K_MAX = 5, 10
POOL_FACTOR, POOL_LEAST = 4, 20


def clamp_k(top_k: Column) -> Column:
    return F.least(F.coalesce(top_k, F.lit(K_DEFAULT)), F.lit(K_MAX))


def rrf(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, rank) of rankings (query_id, retriever, chunk_id, rank), rank from 1:
    the sum of 1 / (k + rank), ties by chunk_id."""
    fused = rankings.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 12).alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def pool_size(k: int) -> int:
    return max(POOL_FACTOR * k, POOL_LEAST)


def hydrate(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with text and provenance: (query_id, rank, score, chunk_id, text, ...), and what else they carry."""
    more = [c for c in ranked.columns if c not in ("query_id", "rank", "score", "chunk_id")]
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    kept = chunks.select("chunk_id", *(blank(c) for c in ("text", "source_repo", "file_path", "doc_type", "last_updated")), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"))
    return ranked.join(kept, "chunk_id").select("query_id", "rank", F.round("score", 4).alias("score"), "chunk_id", "text", "source_repo", "file_path", "doc_type", "last_updated", "chunk_index", *more)


def hybrid_ids(chunks: DataFrame, queries: DataFrame, k: int = K_DEFAULT, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): ``chunks`` (chunk_id, vec_id, text, embedding), ``queries`` (query_id, query,
    vector). Both pools hold ``pool_size(k)``."""
    pool = pool_size(k)
    ids = chunks.select("chunk_id", F.col("vec_id").alias("id"))
    near = vector.top_k(chunks.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, pool).join(ids, "id").select("query_id", F.lit("vector").alias("retriever"), "chunk_id", "rank")
    worded = lexical.bm25(chunks, queries, pool, index=index).select("query_id", F.lit("lexical").alias("retriever"), "chunk_id", "rank")
    fused = rrf(near.unionByName(worded)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")
    met = fused.join(chunks.select("chunk_id", "embedding"), "chunk_id").join(queries.select("query_id", "vector"), "query_id")
    return met.select("query_id", "chunk_id", F.coalesce(tx.cosine(F.col("embedding"), F.col("vector")), F.lit(0.0)).alias("score"), "rank")


def degraded_ids(chunks: DataFrame, queries: DataFrame, k: int = K_DEFAULT, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Keyword-only answers; no vector is read, and every score is 0."""
    return lexical.bm25(chunks, queries, k, index=index).withColumn("score", F.lit(0.0))


def search(chunks: DataFrame, queries: DataFrame, k: int = K_DEFAULT) -> DataFrame:
    """Hits of a batch: hybrid for queries with a vector, keyword-only for those without, in one plan. The terms of the
    chunks are counted once for both."""
    index = lexical.indexed(chunks)
    with_vector = hybrid_ids(chunks, queries.where(F.col("vector").isNotNull()), k, index).withColumn("degraded", F.lit(False))
    without = degraded_ids(chunks, queries.where(F.col("vector").isNull()), k, index).withColumn("degraded", F.lit(True))
    for written in index:
        runtime.drop(written)
    return hydrate(with_vector.unionByName(without.select(*with_vector.columns)), chunks)


def compare(vector_ids: DataFrame, hybrid: DataFrame, best: int = 3) -> DataFrame:
    """(query_id, rank, vector_chunk, hybrid_chunk): side by side, null on the shorter side."""
    side = lambda df, name: df.where(F.col("rank") <= best).select("query_id", "rank", F.col("chunk_id").alias(name))
    return side(vector_ids, "vector_chunk").join(side(hybrid, "hybrid_chunk"), ["query_id", "rank"], "full_outer")

