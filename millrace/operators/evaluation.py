"""Retrieval metrics over ranked lists (item_id, doc_id, rk) and judgments (item_id, doc_id, rel); link analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, p, r, f1) at ``k`` for items that have relevant documents."""
    need = judged.where("rel > 0").groupBy("item_id").agg(F.count("*").alias("need"))
    hits = ranked.where(F.col("rk") <= k).join(judged.where("rel > 0"), ["item_id", "doc_id"]).groupBy("item_id").agg(F.count("*").alias("hits"))
    met = need.join(hits, "item_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    p, r = F.col("hits") / F.lit(float(k)), F.col("hits") / F.col("need")
    return met.select("item_id", p.alias("p"), r.alias("r"), F.when(F.col("hits") > 0, F.round(2 * p * r / (p + r), 9)).otherwise(0.0).alias("f1"))


def map_mrr(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """One row (map, mrr): means over items that have relevant documents."""
    need = judged.where("rel > 0").groupBy("item_id").agg(F.count("*").alias("need"))
    w = Window.partitionBy("item_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    met = ranked.join(judged.where("rel > 0"), ["item_id", "doc_id"]).withColumn("k", F.count("*").over(w))
    per = met.groupBy("item_id").agg(F.sum(F.col("k") / F.col("rk")).alias("s"), F.min("rk").alias("best"))
    full = need.join(per, "item_id", "left")
    return full.agg(F.round(F.avg(F.coalesce(F.col("s") / F.col("need"), F.lit(0.0))), 9).alias("map"), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 9).alias("mrr"))


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, ndcg) at ``k`` with gains 2^rel - 1."""
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col(rank) + F.lit(1.0))
    got = ranked.where(F.col("rk") <= k).join(judged, ["item_id", "doc_id"]).groupBy("item_id").agg(F.sum(gain("rk")).alias("dcg"))
    w = Window.partitionBy("item_id").orderBy(F.desc("rel"), "doc_id")
    ideal = judged.where("rel > 0").withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("item_id").agg(F.sum(gain("i")).alias("idcg"))
    return ideal.join(got, "item_id", "left").select("item_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 9).alias("ndcg"))


def pagerank(edges: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds over distinct edges (src, dst); sinks share with all."""
    edges = edges.select("src", "dst").distinct().persist()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().persist()
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    linked = edges.join(out, "src").persist()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        given = linked.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        lost = ranks.join(out, F.col("node") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        ranks = nodes.join(given, F.col("node") == F.col("to"), "left").crossJoin(F.broadcast(lost)).select("node", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if edges.sparkSession.sparkContext.getCheckpointDir() or edges.sparkSession.conf.get("spark.checkpoint.dir", None):
            ranks = ranks.checkpoint()
    return ranks.select("node", F.round("rank", 9).alias("rank"))
