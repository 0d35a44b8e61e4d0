"""URL filters: host and path rules, and a path-template tree with smoothed purity.

Paths are cut into segments. Numbers and hexadecimal runs in a segment become marks;
then, level by level, a node of a host's tree with more than ``branching`` distinct
children turns them all into a wildcard. The last of ``depth`` levels takes all segments
that are left as one. Labelled urls are counted for every node that they pass, the
host's root included. A branch whose share of bad labels doesn't differ significantly
(two-proportion z) from that of its siblings together is alike; alike siblings are merged,
any other branch stands alone. A branch is bad if its share of bad labels, smoothed
towards the share of all labels, is ``reject`` or more. The deepest branch with labels
that a url passes judges it, so templates without labels inherit from above.
Only DataFrame functions run; nodes and distinct templates, not urls, are compared.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is judged as the empty host's root; hosts without labels are allowed; rows that
repeat are answered once each; without labels everything is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, lower_ascii, packed, small

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules travel inside the plan; more belong in a table of their own.
MOST_RULES = 1000
DEPTH, BRANCHING, WEIGHT, REJECT, Z = 4, 16, 5.0, 0.8, 1.96
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, told in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = told.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(told)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    marked = F.regexp_replace(segment, r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{16,}", "<x>")
    return F.regexp_replace(marked, "[0-9]+", "<n>")


def templates(urls: DataFrame, depth: int = DEPTH, branching: int = BRANCHING) -> DataFrame:
    """Add chain, the templates from the host's root ("") down to the url's own, to rows with host and path (and no column seg, template, child, wh or wt).

    Wide nodes are found one level at a time, as a wildcard above changes the nodes below.
    """
    segments = F.transform(F.filter(F.split(F.col("path"), "/"), lambda s: s != ""), _shape)
    rows = urls.withColumn("seg", segments).withColumn("template", F.lit("")).withColumn("chain", F.array(F.lit("")))
    for level in range(depth):
        rest = F.array_join(F.slice("seg", level + 1, F.greatest(F.size("seg"), F.lit(1))), "/")
        at = rows.withColumn("child", rest if level == depth - 1 else F.coalesce(F.get("seg", F.lit(level)), F.lit("")))
        nodes = at.where("child != ''").select("host", "template", "child").distinct()
        wide = nodes.groupBy("host", "template").agg(F.count("*").alias("n")).where(F.col("n") > branching)
        wide = checkpointed(wide.select(F.col("host").alias("wh"), F.col("template").alias("wt")))
        if wide.count() <= BROADCAST_ROWS:
            wide = F.broadcast(wide)
        met = at.join(wide, (F.col("host") == F.col("wh")) & (F.col("template") == F.col("wt")), "left")
        step = F.when(F.col("child") == "", "").when(F.col("wh").isNotNull(), "/<*>").otherwise(F.concat(F.lit("/"), F.col("child")))
        rows = met.withColumn("template", F.concat("template", step)).withColumn("chain", F.when(F.col("child") == "", F.col("chain")).otherwise(F.concat("chain", F.array("template")))).drop("wh", "wt", "child")
    return rows.drop("seg", "template")


def branches(labelled: DataFrame, weight: float = WEIGHT, reject: float = REJECT, z: float = Z) -> DataFrame:
    """(host, depth, template, reject) of every branch with labels, from rows (host, chain, bad)."""
    steps = F.transform("chain", lambda t, k: F.struct(k.alias("depth"), F.get("chain", k - 1).alias("parent"), t.alias("template")))
    each = labelled.groupBy("host", "chain").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).select("host", "bad", "n", F.explode(steps).alias("s"))
    nodes = checkpointed(each.groupBy("host", "s.depth", "s.parent", "s.template").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    total = nodes.where("depth = 0").agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("prior"))  # one row
    # The root has no siblings; its parent is null and meets no family.
    family = ["host", "depth", "parent"]
    told = lambda df, b, n: df.groupBy(*family).agg(F.sum("bad").alias(b), F.sum("n").alias(n))
    met = nodes.join(told(nodes, "fbad", "fn"), family, "left")
    pooled = F.col("fbad") / F.col("fn")
    rest = F.col("fn") - F.col("n")
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.greatest(rest, F.lit(1))))
    gap = F.abs(F.col("bad") / F.col("n") - (F.col("fbad") - F.col("bad")) / F.greatest(rest, F.lit(1)))
    met = checkpointed(met.withColumn("alike", F.coalesce((rest > 0) & (gap <= z * error), F.lit(False))).drop("fbad", "fn"))
    merged = told(met.where("alike"), "abad", "an").withColumn("alike", F.lit(True))
    met = met.join(merged, [*family, "alike"], "left").join(F.broadcast(total))
    share = (F.coalesce("abad", "bad") + weight * F.col("prior")) / (F.coalesce("an", "n") + weight)
    return met.select("host", "depth", "template", (share >= reject).alias("reject"))


def judge(pages: DataFrame, url: str = "url", rules=RULES, depth: int = DEPTH, branching: int = BRANCHING, weight: float = WEIGHT, reject: float = REJECT) -> DataFrame:
    """Add host, path, rule and verdict, in place of columns with these names; the rules' own verdicts are the labels of the tree."""
    own = packed(pages, ("host", "path", "rule", "verdict"), url=F.coalesce(F.col(url), F.lit("")))
    own = own.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, told = rule_for(F.col("host"), F.col("path"), rules)
    rows = templates(own.withColumn("rule", rule).withColumn("told", told), depth, branching)
    labelled = rows.where(F.col("told").isNotNull()).select("host", "chain", (F.col("told") == "block").cast("long").alias("bad"))
    known = checkpointed(branches(labelled, weight, reject))
    # Distinct templates meet the branches on their way; the deepest one says what becomes of them.
    passed = rows.where(F.col("told").isNull()).select("host", "chain").distinct().select("host", "chain", F.posexplode("chain").alias("depth", "template"))
    passed = passed.join(small(known, 200), ["host", "depth", "template"])
    gone = passed.groupBy("host", "chain").agg(F.max_by("reject", "depth").alias("reject")).where("reject")
    gone = checkpointed(gone.select(F.col("host").alias("gh"), F.col("chain").alias("gc")))
    met = rows.join(small(gone, 200), (F.col("host") == F.col("gh")) & (F.col("chain") == F.col("gc")) & F.col("told").isNull(), "left")
    own_verdict = F.when(F.col("gh").isNotNull(), "block").otherwise("allow")
    return met.select("row.*", "host", "path", "rule", F.coalesce("told", own_verdict).alias("verdict"))
