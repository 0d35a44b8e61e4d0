"""Benchmark decontamination on a hash set of the items' windows.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words,
but not none, is one window. All windows of the documents are hashed in place,
exploded inside one stage, and looked up in the hash set; every hit is verified
word by word. Only DataFrame functions run.

The hash set is broadcast while its measured size stays under ``BROADCAST_BYTES``.
Beyond that the documents' window hashes are shuffled against it, and the hits are
verified against the documents in a second join, so that no text is shuffled with
the windows.

Edge cases: null and empty texts have no words and are clean; rows that repeat are
answered once each; ids may be null; items without an id contaminate but are not
counted; an empty benchmark leaves every document clean. Other columns are kept
out of the work, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ITEM_CLASS, checkpointed, lower_ascii, packed, small, words_of

BROADCAST_BYTES = 64 << 20


def item_words(col) -> Column:
    """Words of digits, a-z and what lies beyond ASCII, after lower-casing A-Z."""
    return words_of(lower_ascii(col), ITEM_CLASS)


def _windows(words: Column, length: Column | int) -> Column:
    """Hashes of all windows of ``length`` words; no rows where there are fewer words."""
    last = F.size(words) - length + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, length)))


def item_windows(items: DataFrame, n: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (h, len, win) with the ids of the items that have them."""
    words = items.select(F.col(item_id).cast("string").alias("item"), item_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    sized = words.withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = sized.select("item", "w", "len", F.explode_outer(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    wins = at.select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("win"))
    return wins.groupBy(F.xxhash64("win").alias("h"), "len", "win").agg(F.collect_set("item").alias("items"))


def _first(lengths: list[int], n_words: Column, length: Column) -> Column:
    """Where the hashes of windows of ``length`` begin in a document's row of hashes."""
    out = F.lit(1)
    for x in lengths:
        out = out + F.when(F.lit(x) < length, F.greatest(F.lit(0), n_words - x + 1)).otherwise(0)
    return out


def hits(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, spans [(start, stop)] of hit words, items.

    Starts count words from 0, stops are exclusive; spans are sorted and may overlap.
    """
    wins = checkpointed(item_windows(items, n))
    sizes = wins.groupBy("len").agg(F.count("*").alias("rows"), F.sum(F.length(F.array_join("win", " ")) + 40 * F.size("items") + 64).alias("bytes")).collect()  # n rows at most
    lengths = sorted(r["len"] for r in sizes)
    bounded = sum(r["bytes"] for r in sizes) <= broadcast_bytes
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), item_words(F.col(text)).alias("w"))
    hashed = own.withColumn("n_words", F.size("w")).withColumn("hs", F.concat(F.array(F.lit(None).cast("long")), *(_windows(F.col("w"), x) for x in lengths)))
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("len")).alias("stop"))
    start = F.col("at") - _first(lengths, F.col("n_words"), F.col("len"))
    same = F.slice(F.col("w"), start + 1, F.col("len")) == F.col("win")
    # The outer form keeps Catalyst from testing the array's size below, where it would tokenise anew.
    if bounded:
        rows = hashed.select("doc_id", "text_hash", "n_words", "w", F.posexplode_outer("hs").alias("at", "key"))
        met = rows.join(F.broadcast(wins), (F.col("key") == F.col("h")) & same, "left")
        met = met.where((F.col("at") == 0) | F.col("h").isNotNull())
        met = met.select("doc_id", "text_hash", "n_words", (F.col("at") == 0).cast("int").alias("row"), "items", "len", start.alias("start"))
    else:
        rows = hashed.select("doc_id", "text_hash", "n_words", F.posexplode_outer("hs").alias("at", "key")).where(F.col("key").isNotNull())
        near = rows.join(wins, F.col("key") == F.col("h")).select("doc_id", "text_hash", "at", "items", "len", "win")
        full = own.withColumn("n_words", F.size("w")).alias("o")
        met = full.join(near.alias("m"), F.col("o.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("o.text_hash") == F.col("m.text_hash")))
        met = met.where(same).select("o.doc_id", "o.text_hash", "n_words", F.lit(0).alias("row"), "items", "len", start.alias("start"))
        base = own.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.lit(1).alias("row"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("int").alias("start"))
        met = met.unionByName(base)
    found = met.groupBy("doc_id", "text_hash").agg(
        F.sum("row").cast("int").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("row") == 0, span))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def covered(spans) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["stop"]).alias("to"))
    return F.aggregate(spans, zero, add, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, mode: str = "documents", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop contaminated documents, or with mode "spans" cut the hit words out of them.

    Cutting drops each hit word with the separators before it.
    """
    found = hits(docs, items, n, doc_id, text).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").distinct()
    own = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    rows = packed(docs, id=F.col(doc_id), hash=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    if mode == "documents":
        gone = small(checkpointed(found.select("doc_id", "text_hash")), 24)
        return rows.join(gone, own, "left_anti").select("row.*")
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    rows = rows.withColumn("text", F.col(f"row.`{text}`"))
    hit = F.col("text_hash").isNotNull()
    pieces = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    # Neighbouring hits become one span; then words are looked up by place in one sweep over the spans.
    rows = rows.join(found, own, "left").withColumn("sizes", F.when(hit, F.transform(pieces, F.length)))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("starts"))
    add = lambda a, x: F.struct((a["at"] + x).alias("at"), (a["k"] + 1).alias("k"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
    rows = rows.withColumn("found", F.aggregate("sizes", begin, add))
    flat = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))
    gone = F.map_from_entries(F.transform(F.array_distinct(flat), lambda i: F.struct(i, F.lit(True))))
    rows = rows.withColumn("gone", F.when(hit, gone))
    kept = F.transform("sizes", lambda x, i: F.when(F.col("gone")[i].isNotNull(), F.lit("")).otherwise(F.substring(F.col("text"), F.get("found.starts", i) + 1, x)))
    tail = F.substring(F.col("text"), F.col("found.at") + 1, F.length("text"))
    new = F.when(hit, F.concat(F.array_join(kept, ""), tail)).otherwise(F.col("text"))
    return rows.select("row", new.alias("cut")).select(*(F.col("cut").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
