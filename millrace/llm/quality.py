"""Quality rules: statistics of each text, and lines that many documents of a host share.

Lines are normalised (lower-cased, white space runs to one space, trimmed) and hashed.
For each host the distinct documents that have a line are counted: documents whose
normalised lines are the same, in order, are copies and count once. A line in more than
``max(floor, share * distinct documents of the host)`` of them is boilerplate and is
removed; a document that keeps less than ``least`` of its words is depleted. Near copies
are documents of their own: a group of them that makes more than ``share`` of a host's
distinct documents has its common lines taken for boilerplate.

Plain counts, which can't be smaller, come first and leave few lines; only for these are
(host, line, document) rows made distinct. A host's boilerplate lines travel as one array
in a broadcast while the measured size of all arrays allows it, else in a shuffled join
that adaptive execution can split; a host can't have more than ``lines per document /
share`` of them. Only DataFrame functions run.

Windows of eight words are hashed by doubling: words once, then pairs of hashes, of pairs
and of fours; texts without an equal window pay for no more.

Edge cases: null and empty texts have no words and fail; a null host is a host of
its own; rows that repeat are answered once each; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, packed, stored

FLOOR, SHARE, LEAST = 10, 0.05, 0.3
WINDOW = 8
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 500_000
NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left", "clean_text", "base_failed", "kept")
SYMBOLS = "[#*$%&|<>]"
BLANK = " \t\n\x0b\f\r"


def _spaced(text, blanks: str) -> Column:
    """Each of ``blanks`` becomes a space."""
    for b in blanks:
        text = F.replace(text, F.lit(b), F.lit(" "))
    return text


def _words(text) -> Column:
    return F.array_remove(F.split(_spaced(text, "\t\n\x0b\f\r"), " "), "")


def _tidy(spaced) -> Column:
    """Lower-cased text without blanks but spaces and newlines to its normalised lines that have a word, joined by newlines."""
    untidy = F.contains(spaced, F.lit("  ")) | F.contains(spaced, F.lit(" \n")) | F.contains(spaced, F.lit("\n ")) | F.contains(spaced, F.lit("\n\n"))
    t = F.when(untidy, F.regexp_replace(F.regexp_replace(spaced, " +", " "), " ?\n[ \n]*", "\n")).otherwise(spaced)
    return F.btrim(t, F.lit(" \n"))


def with_hashes(rows: DataFrame) -> DataFrame:
    """Replace the column text by normal, the normalised text, and lines, its lines' hashes; one column at a time, so that none is computed twice."""
    rows = rows.withColumn("lowered", _spaced(F.lower(F.coalesce("text", F.lit(""))), "\t\x0b\f\r")).withColumn("normal", _tidy(F.col("lowered")))
    lines = F.transform(F.split("normal", "\n"), lambda x: F.xxhash64(x))
    return rows.withColumn("lines", F.when(F.col("normal") == "", F.array().cast("array<long>")).otherwise(lines)).drop("text", "lowered")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", floor: int = FLOOR, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(host, hashes): the hashes of each host's lines that too many of its distinct documents share."""
    own = with_hashes(docs.select(F.col(host).alias("host"), F.col(text).alias("text")))
    own = stored(own.select("host", F.xxhash64("normal").alias("doc"), F.array_distinct("lines").alias("lines")), "lines")
    many = own.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > floor)
    many = checkpointed(many.select(F.col("host").alias("of"), F.col("line").alias("shared")))
    many = F.broadcast(many) if many.count() <= broadcast_rows else many
    met = own.select("host", "doc", F.explode("lines").alias("line")).join(many, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("shared")))
    # A null line stands for the document itself; it counts the host's documents.
    rows = met.select("host", "line", "doc").unionByName(own.select("host", F.lit(None).cast("long").alias("line"), "doc")).distinct()
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = checkpointed(counts.where((F.col("n") > floor) | F.col("line").isNull()))
    total = counts.where(F.col("line").isNull()).select(F.col("host").alias("of"), F.col("n").alias("docs"))
    over = counts.where(F.col("line").isNotNull()).join(total, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > share * F.col("docs"))
    return over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("hashes"))


def _statistics(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` (with a column text), words, lines and the statistics' columns."""
    t = F.coalesce(F.col("text"), F.lit(""))
    w = rows.withColumn("spaced", _spaced(t, "\t\n\x0b\f\r"))
    w = w.withColumn("words", F.array_remove(F.split("spaced", " "), "")).withColumn("lines", F.filter(F.split(t, "\n"), lambda x: F.ltrim(x, F.lit(BLANK)) != ""))
    doubled = F.transform("words", lambda x: F.xxhash64(x))
    for step in (1, 2, 4):  # the arrays' ends, which lack words, are cut below
        w = w.withColumn("h", doubled)
        doubled = F.zip_with("h", F.slice("h", step + 1, F.size("h")), lambda a, b: F.xxhash64(a, b))
    w = w.withColumn("hashes", F.slice(doubled, 1, F.greatest(F.size("words") - WINDOW + 1, F.lit(0))))
    w = w.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("sorted", k)["h"] == x["h"], F.lit(False))
    w = w.withColumn("found", F.sort_array(F.transform(F.filter("sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    repeat = F.aggregate("found", zero, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["to"])).alias("n"), (i + WINDOW).alias("to")), lambda a: a["n"])
    return w.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.replace("spaced", F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(repeat, F.lit(0)).cast("long"),
    })


def judge(docs: DataFrame, host: str = "source", text: str = "text", floor: int = FLOOR, share: float = SHARE, least: float = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The columns of ``docs``, the statistics, n_left (words outside boilerplate), clean_text, base_failed and kept.

    A column of ``docs`` with a new column's name is replaced.
    """
    flags = checkpointed(boilerplate(docs, host, text, floor, share)).select(F.col("host").alias("of"), F.col("hashes").alias("flags"))
    size = flags.agg(F.coalesce(F.sum(8 * F.size("flags") + 64), F.lit(0))).first()[0]
    flags = F.broadcast(flags) if size <= broadcast_bytes else flags
    rows = packed(docs, NEW, text=F.col(text), host=F.col(host))
    rows = rows.join(flags, F.col("host").eqNullSafe(F.col("of")), "left")
    rows = with_hashes(rows.withColumn("whole", F.col("text"))).withColumnRenamed("whole", "text")
    rows = rows.withColumn("held", F.when(F.col("flags").isNotNull(), F.array_intersect("lines", "flags"))).drop("lines", "normal", "flags")
    w = _statistics(rows)
    flagged = lambda x: F.array_contains("held", F.xxhash64(_tidy(_spaced(F.lower(x), "\t\x0b\f\r"))))
    kept_line = lambda x: (F.ltrim(x, F.lit(BLANK)) == "") | ~flagged(x)
    w = w.withColumn("gone", F.when(F.size("held") > 0, F.filter("lines", flagged)))
    gone = F.aggregate("gone", F.lit(0), lambda a, x: a + F.size(_words(x)))
    w = w.withColumn("n_left", F.col("n_words") - F.coalesce(gone, F.lit(0)))
    clean = F.when(F.size("gone") > 0, F.array_join(F.filter(F.split(F.col("text"), "\n"), kept_line), "\n")).otherwise(F.col("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    w = w.withColumn("clean_text", clean).withColumn("base_failed", failed)
    w = w.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= least * F.col("n_words")))
    # One generated row: a filter on the verdict can't move below it, where it would copy
    # the expressions above into the lambdas and evaluate them for every word.
    return w.select("row", F.explode_outer(F.array(F.struct(*NEW))).alias("new")).select("row.*", "new.*")
