"""The corpus pipeline: raw documents to token ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import bpe_encode
from millrace.llm.common import checkpointed, fresh_path, small
from millrace.llm.decontaminate import decontaminate
from millrace.llm.quality import judge
from millrace.llm.queries import table, vocabulary
from millrace.llm.secret_scan import redact
from millrace.llm.simhash import components, keep_first, near_duplicates, shingle_near_duplicates


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit are cut out of the others."""
    kept = judge(docs).where("kept").withColumn("text", F.col("clean_text"))
    return _sized(kept.select(docs.columns))


def _merged(x: DataFrame, y: DataFrame) -> DataFrame:
    """(doc_id, component_id): groups of two such tables that share a document become one.

    Groups are linked by their smallest ids, so copies add no links of their own.
    """
    rows = x.select("doc_id", "component_id").union(y.select("doc_id", "component_id")).distinct()
    rows = checkpointed(rows.withColumn("least", F.min("component_id").over(Window.partitionBy("doc_id"))))
    labels = components(rows.where("least < component_id").select(F.col("least").alias("a"), F.col("component_id").alias("b")).distinct())
    found = rows.join(small(labels, 16), F.col("least") == F.col("node"), "left")
    return found.select("doc_id", F.coalesce("label", "least").alias("component_id")).distinct()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by SimHash, or by five-word shingles alike by 0.8 or more."""
    return keep_first(docs, _merged(near_duplicates(docs.where("doc_id IS NOT NULL")), shingle_near_duplicates(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row, or a whole shorter item, go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return _sized(redact(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids take the place of the texts' further use; the text stays beside them."""
    return bpe_encode(docs, vocabulary()).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: SimHash, the network and byte-pair merges can't be put in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
