"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint bit is 1 if over half of a text's shingle hashes have it (XXH64 of
the UTF-8 shingle, seed 42; repeats count). Two fingerprints within ``radius`` bits
have a common point within half the radius of both, so every distinct fingerprint
emits its whole ball of that half radius, the rows are shuffled on those variants,
and fingerprints that meet are linked. All members of one variant's bucket lie
within ``radius`` of each other, so a star to the smallest member says as much as
all pairs, and a bucket never holds more than one ball's size (65 for radius 2).

Copies of a text share a fingerprint and are folded before the ball is emitted;
a hot group costs as much as one document. Components are found by repeated
minimum propagation with pointer jumping, on shuffled tables, cut by checkpoint().

Edge cases: null, empty and white-space texts have fingerprint zero and are linked
like any other; a text of fewer words than a shingle counts as one shingle; rows
that repeat share an answer; rows without an id keep their fingerprint and take
their group's smallest id, if it has one; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import checkpointed, map_rows, packed, small, stored, texts_of

SEED = 42
#: Shingle hashes whose bits are unpacked at once.
BLOCK = 1 << 14
#: Odd factors that mix word hashes into a shingle's.
MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
#: One distinct text in SAMPLE tells which shingles are frequent: in OFTEN of them; the HOT most frequent are kept.
SAMPLE, OFTEN, HOT = 16, 3, 1 << 19
#: Bytes of an Arrow batch of texts whose shingles are hashed; the sets take several times as much.
SET_BYTES = 2 << 20
#: Open pairs a row above which another head is tried before all are compared, heads tried at most, members compared in one piece.
PAIRS, TURNS, PAIR_BLOCK = 200, 4, 256


def fingerprint_of(text: str, shingle: int) -> int:
    """The fingerprint as a signed 64-bit number."""
    # bytes.lower and bytes.split know ASCII alone: A-Z, and 0x20 and 0x09-0x0D.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        n, hashes = 1, [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        n = len(stops)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)]
    each = np.array(hashes, dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, BLOCK):
        ones += np.unpackbits(each[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """Add each whole text's fingerprint as a long; the text is dropped."""

    def make():
        return lambda batch: [[fingerprint_of(t, shingle) for t in texts_of(batch, text)]]

    return map_rows(docs, make, [(out, T.LongType())], [c for c in docs.columns if c != text])


def ball(half: int, bits: int = 64) -> list[int]:
    """All masks of at most ``half`` set bits, as signed numbers."""
    masks = [sum(1 << b for b in flipped) for k in range(half + 1) for flipped in combinations(range(bits), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Star edges (a, b), a < b, among distinct fingerprints ``nodes(node, fp)``."""
    if radius < 0 or radius % 2:
        raise ValueError("the ball meets in the middle for even radii")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    rows = nodes.select("node", "fp", F.explode(masks).alias("mask"))
    rows = rows.select("node", "mask", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    own = Window.partitionBy("variant")
    head = F.min(F.struct("node", "mask")).over(own)
    pairs = rows.select(head.alias("head"), "node", "mask").where(F.col("head.node") < F.col("node"))
    near = F.bit_count(F.col("head.mask").bitwiseXOR(F.col("mask"))) <= radius
    return pairs.where(near).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, label): the smallest node that each end of an edge (a, b) can reach.

    Every round takes the smallest label among a node's neighbours, then the label
    of that label, until a round changes nothing.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = checkpointed(labels.select("node", F.least("node", "least").alias("label")))
    for _ in range(most):
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("seen"))
        step = labels.join(seen, labels["node"] == seen["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("above"))
        new = checkpointed(step.join(up, F.col("label") == F.col("up"), "left").select("node", "old", F.least("label", "above").alias("label")))
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components have not settled")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable."""
    own = checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle))
    nodes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("node")))
    labels = components(links(nodes.where(F.col("node").isNotNull()), radius))
    found = nodes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return own.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(text: str, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, in order; fewer words count as one shingle."""
    words = _words(text)
    if not words:
        return np.empty(0, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    n, x, power = len(words) - width + 1, np.full(len(words) - width + 1, width, dtype=np.uint64), MIX[0]
    with np.errstate(over="ignore"):
        for k in range(width):
            x += each[k : k + n] * power
            power = power * MIX[0]
        for m in MIX[1:]:
            x = (x ^ (x >> np.uint64(33))) * m
    return np.unique((x ^ (x >> np.uint64(33))).view(np.int64))


def prefix_of(own: np.ndarray, hot: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The shingles of which sets alike share one at least, the rarest first, and how many shingles aren't hot.

    A set alike shares ``similarity`` of these shingles, so it can't miss all of the
    first n - that + 1 in an order that holds for all sets. Here: by the count in
    ``hot``, then by value. What is in ``hot`` bears on the cost alone.
    """
    held = np.zeros(len(own), dtype=np.int64)
    if len(hot) and len(own):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        held = np.where(hot[at] == own, counts[at], 0)
    first = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
    return own[np.lexsort((own, held))][:first], int((held == 0).sum())


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each of m slots has an odd number of the set's hashes, as m bits; m is a power of two, two to four times the set's size, 64 at least.

    A hash that only one of two sets has changes one slot, so the sets differ in no
    fewer hashes than their parities (the longer ones folded) in slots.
    """
    m = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own.view(np.uint64) >> np.uint64(7)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), pa.int64()))


def _fits(x: str, y: str, similarity: float):
    """Whether two sets that first meet at these places of their orders can be alike."""
    left = lambda r: F.col(f"{r}.n") - F.col(f"{r}.pos")
    return F.least(left(x), left(y)) >= F.lit(similarity / (1 + similarity)) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - F.lit(1e-6)


def _stars(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (a, b) of each shingle's head and its other groups' members.

    The first head is the text with the fewest shingles of its own: of edited copies, their base.
    """
    order = F.struct("rare", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)).alias("rare"), "node")
    head = F.min(F.struct(order.alias("order"), "node", "label", "n", "pos")).over(Window.partitionBy("h"))
    met = rows.select(head.alias("x"), F.struct("node", "label", "n", "pos").alias("y")).where(F.col("x.label") != F.col("y.label"))
    met = met.where(_fits("x", "y", similarity))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _all_pairs(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs (a, b) of all members of different groups; a shingle of over ``block`` members is dealt by pairs of blocks."""
    size = F.count("*").over(Window.partitionBy("h"))
    rows = rows.withColumn("g", F.ceil(size / F.lit(block)).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    dealt = rows.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label", "n", "pos")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("h", "lo", "hi")]
    met = dealt.alias("x").join(dealt.alias("y"), on).where(F.col("x.node") < F.col("y.node"))
    met = met.where((F.col("x.label") != F.col("y.label")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.lo") == F.col("x.hi"))))
    return met.where(_fits("x", "y", similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _can_be_alike(similarity: float):
    """Whether the parities of sets a and b let them be alike: they may differ in (1 - s) / (1 + s) of both sizes' sum at most."""
    half = lambda c: F.size(c) / F.lit(2).cast("int")
    folded = lambda c: F.zip_with(F.slice(c, F.lit(1), half(c).cast("int")), F.slice(c, half(c).cast("int") + 1, half(c).cast("int")), lambda x, y: x.bitwiseXOR(y))
    a = F.when(F.size("oa") > F.size("ob"), folded("oa")).otherwise(F.col("oa"))
    b = F.when(F.size("ob") > F.size("oa"), folded("ob")).otherwise(F.col("ob"))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    # Sizes apart by more than one doubling can't be alike at all from a similarity of 0.5 on.
    near = F.greatest(F.size("oa"), F.size("ob")) <= 2 * F.least(F.size("oa"), F.size("ob"))
    return near & (apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("na") + F.col("nb")) + F.lit(1e-6))


def shingle_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", pairs: int = PAIRS, block: int = PAIR_BLOCK) -> DataFrame:
    """(doc_id, component_id): groups linked by a Jaccard similarity of word shingles, 0.5 or more.

    Exact: texts alike share one of their rarest shingles (``prefix_of``), so all that
    share one are compared, but for those that are linked already: first by bits that
    bound the difference from below (``parities``), then on the shingle sets of their
    whole texts. Equal texts are one node. First each shingle's texts are compared with
    one head; while more than ``pairs`` pairs a row are open, with another, at most
    ``TURNS`` times; then all open pairs are.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("the similarity must be from 0.5 to 1")
    spark = docs.sparkSession
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    marked = checkpointed(own.select("doc_id", F.unhex(F.md5("text")).alias("k")))
    nodes = checkpointed(marked.groupBy("k").agg(F.min("doc_id").alias("node")))
    copies = marked.join(nodes, "k").where(F.col("doc_id") != F.col("node")).select("doc_id").distinct()
    copies = checkpointed(copies.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_anti"))
    texts = own.join(small(copies, 16), "doc_id", "left_anti")

    def sets():
        return lambda batch: [_lists([shingles_of(t, shingle) for t in texts_of(batch, "text")])]

    # Frequent shingles by a sample of distinct texts: they only order the shingles.
    sampled = map_rows(texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), sets, [("set", longs)], [], SET_BYTES)
    often = sampled.select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN)
    often = sorted((r["h"], r["c"]) for r in often.orderBy(F.desc("c"), "h").limit(HOT).collect())  # bounded
    hot = spark.sparkContext.broadcast((np.array([h for h, _ in often], np.int64), np.array([c for _, c in often], np.int64)))

    def prefixes():
        def step(batch):
            n, rare, first, odd = [], [], [], []
            for t in texts_of(batch, "text"):
                x = shingles_of(t, shingle)
                p, r = prefix_of(x, *hot.value, similarity)
                n.append(len(x)), rare.append(r), first.append(p), odd.append(parities(x))
            return [n, rare, _lists(first), _lists(odd)]

        return step

    firsts = stored(map_rows(texts, prefixes, [("n", long), ("rare", long), ("first", longs), ("odd", longs)], ["doc_id"], SET_BYTES), "prefixes")
    rows = firsts.select(F.col("doc_id").alias("node"), F.col("n").cast("int"), F.col("rare").cast("int"), F.posexplode("first").alias("pos", "h"))
    each = Window.partitionBy("h")
    rows = checkpointed(rows.withColumn("least", F.min("node").over(each)).withColumn("most", F.max("node").over(each)).where("least < most").drop("least", "most"))
    odds = firsts.select("doc_id", "n", "odd")

    def alike(met: DataFrame) -> DataFrame:
        met = checkpointed(met)
        asked = small(checkpointed(met.select(F.col("a").alias("doc_id")).union(met.select("b")).distinct()), 16)
        bits = odds.join(asked, "doc_id", "left_semi")
        x, y = (bits.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}")) for c in "ab")
        met = checkpointed(met.join(x, "a").join(y, "b").where(_can_be_alike(similarity)).select("a", "b").distinct())
        asked = checkpointed(met.select(F.col("a").alias("doc_id")).union(met.select("b")).distinct())
        found = map_rows(own.join(small(asked, 16), "doc_id", "left_semi"), sets, [("set", longs)], ["doc_id"], SET_BYTES).distinct()
        found = stored(found, "sets")
        x, y = found.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), found.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        near = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)
        return checkpointed(met.join(x, "a").join(y, "b").where(near).select("a", "b"))

    edges = labels = None
    rows = rows.withColumn("label", F.col("node"))
    for turn in range(TURNS + 1):
        if labels is not None:
            rows = rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            rows = rows.withColumn("least", F.min("label").over(each)).withColumn("most", F.max("label").over(each))
            rows = checkpointed(rows.where("least < most").drop("least", "most"))
        sizes = rows.groupBy("h", "label").agg(F.count("*").alias("s")).groupBy("h").agg(F.sum("s").alias("n"), ((F.pow(F.sum("s"), F.lit(2)) - F.sum(F.col("s") * F.col("s"))) / 2).alias("open"))
        held, still = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("open"), F.lit(0.0))).first()
        last = turn == TURNS or (turn > 0 and still <= pairs * held)
        found = alike(_all_pairs(rows, similarity, block) if last else _stars(rows, similarity, turn))
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
        if last:
            break
    found = nodes.join(labels, "node", "left").select("k", F.coalesce("label", "node").alias("component_id"))
    return marked.join(found, "k").select("doc_id", "component_id")


def keep_first(docs: DataFrame, marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Drop the documents whose component's smallest id, by ``marked``, is another's.

    Rows without an id stay, as nothing tells them apart; rows that repeat an id stay
    or go together.
    """
    gone = checkpointed(marked.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct())
    return packed(docs, id=F.col(doc_id)).join(small(gone, 16), F.col("id") == F.col("gone"), "left_anti").select("row.*")
