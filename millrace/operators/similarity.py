"""Exact copies, term-set similarity and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.blocks import alike_sets, best_vectors


def exact_copies(docs: DataFrame) -> DataFrame:
    """(digest, n, first_id) of texts that occur more than once."""
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def jaccard(tok: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard): each asked document against all others that share a term.

    All pairs are counted, block by block, without pairs or terms as rows: terms are
    told apart by 64-bit hashes, and only pairs of sizes that can reach ``least`` meet.
    """
    hashed = lambda df: df.where("doc_id is not null and size(toks) > 0").select(F.col("doc_id").cast("long").alias("id"), F.array_distinct(F.transform("toks", lambda t: F.xxhash64(t))).alias("v"), F.array().cast("array<bigint>").alias("marks"))
    met = alike_sets(hashed(tok), hashed(asked), least - 1e-6)
    return met.select("a", "b", F.round("share", 6).alias("jaccard")).where(F.col("jaccard") >= least)


def _vectors(df: DataFrame, key: str, *marks: Column) -> DataFrame:
    """(id, v, marks) of rows with an id; a vector with null elements is null."""
    v = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding").cast("array<double>"))
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.array(*marks).cast("array<bigint>").alias("marks"))


def _ranked(near: DataFrame, score: Column, name: str, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("qid", "vec_id", score.alias(name), "rk")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, blocks: int = 32) -> DataFrame:
    """Exact top ``k`` by cosine of each query (qid, embedding): (qid, vec_id, cosine, rk).

    All pairs are scored, block by block; each part of the vectors keeps its own best
    ``k`` before one shuffle, so no pair beyond those leaves its task.
    """
    near = best_vectors(_vectors(vectors, "vec_id"), _vectors(queries, "qid"), k, False, blocks)
    return _ranked(near, F.col("score"), "cosine", k)


def approximate(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 8, width: float = 1.0, blocks: int = 32) -> DataFrame:
    """Approximate neighbours (qid, vec_id, distance, rk) by random projections, verified by distance.

    Pairs that share a bucket in any table are candidates. On unit vectors most pairs do,
    so they are met in blocks, as in ``nearest``, and not written as rows.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    whole = lambda df, key: df.where(F.col(key).isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: x.isNull()), F.lit(True))).withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    x, q = whole(vectors, "vec_id"), whole(queries, "qid")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=7).fit(x)
    buckets = [vector_to_array(F.col("h")[t])[0].cast("long") for t in range(tables)]
    near = best_vectors(_vectors(model.transform(x), "vec_id", *buckets), _vectors(model.transform(q), "qid", *buckets), k, True, blocks)
    return _ranked(near, -F.col("score") + F.lit(0.0), "distance", k)
