"""Tokens, postings and statistics.

Tokenised documents are larger than their texts, so they are not kept: operators take
what they need of them in one pass, or two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import stemmer, tokens
from millrace.operators import scan
from millrace.sources.tables import stored


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, toks, dl)."""
    return docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("toks")).withColumn("dl", F.size("toks").cast("long"))


def occurrences(tok: DataFrame) -> DataFrame:
    """(doc_id, pos, tok)."""
    return tok.select("doc_id", F.posexplode("toks").alias("pos", "tok"))


def postings(tok: DataFrame) -> DataFrame:
    """(tok, doc_id, tf), counted in the scan; only documents whose id stands in several rows are shuffled."""
    one, several = _by_rows(tok)
    own = scan.postings(one)
    return own if several is None else own.unionByName(several.select("doc_id", F.explode("toks").alias("tok")).groupBy("tok", "doc_id").agg(F.count("*").alias("tf")))


def _by_rows(tok: DataFrame, few: int = 1_000_000) -> tuple[DataFrame, DataFrame | None]:
    """Documents of one row each, and those whose id stands in several rows; the ids alone are read for it."""
    double = stored(tok.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "double")
    n = double.count()
    if not n:
        return tok, None
    same = tok["doc_id"].eqNullSafe(double["doc_id"])
    double = F.broadcast(double) if n <= few else double
    return tok.join(double, same, "left_anti"), tok.join(double, same, "left_semi")


def postings_for(tok: DataFrame, terms: DataFrame) -> DataFrame:
    """(tok, doc_id, dl, tf) of the terms asked for; the filter comes before the shuffle."""
    rows = tok.select("doc_id", "dl", F.explode("toks").alias("tok")).join(F.broadcast(bounded(terms.select("tok").distinct())), "tok", "left_semi")
    return rows.groupBy("tok", "doc_id", "dl").agg(F.count("*").alias("tf"))


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Check a side's size before it is broadcast."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"over {rows} rows can't be broadcast; join the index on disk instead")
    return df


def positions(tok: DataFrame) -> DataFrame:
    """(tok, doc_id, positions)."""
    one, several = _by_rows(tok)
    own = scan.postings(one, True)
    return own if several is None else own.unionByName(occurrences(several).groupBy("tok", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions")))


def document_frequency(tok: DataFrame) -> DataFrame:
    """(tok, df)."""
    return tok.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))


def collection(tok: DataFrame) -> DataFrame:
    """One row: n documents, cf tokens, avgdl."""
    return tok.agg(F.count("*").alias("n"), F.sum("dl").alias("cf"), F.avg("dl").alias("avgdl"))


def without_stops(occ: DataFrame, stops: list[str]) -> DataFrame:
    """Occurrences of words that aren't in the stop list."""
    listed = occ.sparkSession.createDataFrame([(s,) for s in stops], "tok string")
    return occ.join(F.broadcast(listed), "tok", "left_anti")


def stemmed(tok: DataFrame) -> DataFrame:
    """(stem, terms): the stemmer runs once for each distinct term."""
    terms = tok.select(F.explode(F.array_distinct("toks")).alias("tok")).distinct()
    return terms.withColumn("stem", stemmer()("tok"))


def write_index(posts: DataFrame, path: str, files: int = 16) -> None:
    """Term-sorted parquet, so that row-group statistics prune a term's lookup."""
    posts.repartitionByRange(files, "tok", "doc_id").sortWithinPartitions("tok", "doc_id").write.mode("overwrite").parquet(path)
