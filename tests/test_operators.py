"""Hand-computed cases, properties and odd rows of the operators."""

import math
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import char_grams, grams, porter, tokens
from millrace.operators import evaluation, index, ranking, relational, similarity
from millrace.sources.tables import read, through
from millrace.streaming import windows


@pytest.fixture(scope="module")
def tok(spark):
    rows = [(1, "The cat sat. The CAT ran"), (2, "a dog sat"), (3, None), (4, ""), (5, "cat dog cat dog bird")]
    return index.tokenised(spark.createDataFrame(rows, "doc_id long, text string"))


def test_tokens_and_grams(spark):
    df = spark.createDataFrame([("Größe, 3.5 x_y",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["größe", "3", "5", "x", "y"], [], []]
    two = df.limit(1).select(grams(tokens(F.col("t")), 2), grams(tokens(F.col("t")), 9), char_grams(F.lit("abcd"), 3), char_grams(F.lit("ab"), 3)).first()
    assert list(two) == [["größe 3", "3 5", "5 x", "x y"], [], ["abc", "bcd"], []]


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "triplicate": "triplic", "goodness": "good", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "größe": "größe", "": ""}
    assert {w: porter(w) for w in pairs} == pairs


def test_index(tok):
    assert {tuple(r) for r in index.postings(tok).where("tok = 'cat'").collect()} == {("cat", 1, 2), ("cat", 5, 2)}
    assert index.positions(tok).where("tok = 'cat' and doc_id = 1").first()["positions"] == [1, 4]
    assert tuple(index.collection(tok).first()) == (5, 14, 2.8)
    sums = index.postings(tok).groupBy("doc_id").agg(F.sum("tf").alias("n")).join(tok, "doc_id").where("n <> dl")
    assert sums.count() == 0


def test_bm25_by_hand(spark, tok):
    q = ranking.query_terms(spark.createDataFrame([(7, "cat bird unknown"), (8, None), (9, "")], "item_id long, text string"))
    got = {(r["item_id"], r["doc_id"]): (r["score"], r["rk"]) for r in ranking.bm25(tok, q).collect()}
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2.8))
    assert got == {(7, 5): (round(part(2, 5, 2) + part(1, 5, 1), 6), 1), (7, 1): (round(part(2, 6, 2), 6), 2)}


def test_matching(tok):
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert ids(ranking.boolean_and(tok, ["cat", "sat"])) == {1} and ids(ranking.boolean_or(tok, ["cat", "sat"])) == {1, 2, 5} and ids(ranking.boolean_not(tok, ["cat"], ["bird"])) == {1}
    assert {tuple(r) for r in ranking.phrase(tok, ["cat", "dog"]).collect()} == {(5, 2)}
    assert {tuple(r) for r in ranking.proximity(tok, "cat", "sat", 2).collect()} == {(1, 2)}
    assert {r["tok"] for r in ranking.fuzzy(tok, "cut", 1).collect()} == {"cat"}
    assert {tuple(r) for r in ranking.snippets(tok, "sat", 1).collect()} == {(1, 3, "cat sat the"), (2, 3, "dog sat")}


def test_short_known_items_are_found(spark):
    """Passages of any length, cut inside a token or without one, as ``contains`` finds them."""
    texts = {1: "one two three four five six seven eight", 2: "x two three y", 3: "wo thr", 4: "", 5: None, 6: "-- two"}
    passages = {1: "two three", 2: "wo thr", 3: "--", 4: "one two three four five six", 5: "two three four five six seven eight", 6: "none", 7: "", 8: None}
    docs, items = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(passages.items()), "item_id long, text string")
    want = {(i, d) for i, p in passages.items() for d, t in texts.items() if p is not None and t is not None and p in t}
    assert {tuple(r) for r in ranking.known_items(docs, items).collect()} == want


def test_broadcasts_are_checked(spark):
    with pytest.raises(ValueError):
        index.bounded(spark.range(11), 10)


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "item_id long, doc_id long, rk int")
    judged = spark.createDataFrame([(1, 10, 1), (1, 12, 1), (1, 99, 1), (2, 21, 1), (3, 1, 0)], "item_id long, doc_id long, rel int")
    assert {tuple(r) for r in evaluation.precision_recall(ranked, judged, 3).collect()} == {(1, 2 / 3, 2 / 3, round(2 / 3, 9)), (2, 0.0, 0.0, 0.0)}
    m = evaluation.map_mrr(ranked, judged).first()
    assert m["map"] == pytest.approx((1 + 2 / 3) / 3 / 2) and m["mrr"] == pytest.approx(0.5)
    n = {r["item_id"]: r["ndcg"] for r in evaluation.ndcg(ranked, judged, 3).collect()}
    assert n[1] == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3) + 0.5), abs=1e-8) and n[2] == 0


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("a", "b")], "src string, dst string")
    got = {r["node"]: r["rank"] for r in evaluation.pagerank(edges, 30).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-6) and got["b"] == pytest.approx(got["d"], abs=1e-6) and got["c"] > got["b"]


def test_jaccard_equals_all_pairs(spark, tiny):
    own = index.tokenised(spark.read.parquet(f"{tiny}/documents.parquet"))
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.jaccard(own, own.where("doc_id % 4 = 0"), 0.3).collect()}
    sets = {r["doc_id"]: set(r["toks"]) for r in own.collect() if r["toks"]}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets.items() if a % 4 == 0 for b, y in sets.items() if a != b and len(x & y) / len(x | y) >= 0.3}
    assert got == pytest.approx(want) and want


def test_approximate_neighbours_recall(spark, tiny):
    own = spark.read.parquet(f"{tiny}/embeddings.parquet")
    q = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r["qid"], r["vec_id"]) for r in similarity.nearest(own, q).collect()}
    near = {(r["qid"], r["vec_id"]) for r in similarity.approximate(own, q).collect()}
    assert len(exact) == 250 and len(exact & near) >= 0.9 * len(exact)


def test_asof_join(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(1)), (3, None, at(5)), (4, "b", None), (5, "a", at(5))], "id long, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(2), 1.0), ("a", at(5), 2.0), ("a", at(6), 3.0), (None, at(1), 4.0), ("b", None, 5.0)], "k string, t timestamp_ntz, v double")
    got = {r["id"]: r["v"] for r in relational.asof_join(left, right, "k", "t", "t", ["v"]).collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: None, 5: 2.0}
    assert relational.asof_join(left.limit(0), right, "k", "t", "t", ["v"]).count() == 0


def test_range_join_meets_each_pair_once(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    points = spark.createDataFrame([(1, "a", at(3)), (2, "a", at(9)), (3, None, at(3))], "id long, k string, t timestamp_ntz")
    spans = spark.createDataFrame([("x", "a", at(1), at(9)), ("y", "a", at(3), at(3)), ("z", "b", at(0), at(20))], "s string, k string, a timestamp_ntz, b timestamp_ntz")
    got = sorted((r["id"], r["s"]) for r in relational.range_join(points, spans, "k", "t", "a", "b", 3600).collect())
    assert got == [(1, "x"), (1, "y"), (2, "x")]


def test_late_events_are_dropped_in_append_mode(spark, tmp_path):
    """The third file holds an event far behind the watermark; lateness counts from the batch after the one that moved it."""
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = "event_id long, ts timestamp_ntz, value double"
    for k, rows in enumerate(([(1, at(1), 1.0), (2, at(10), 1.0)], [(4, at(10, 30), 1.0)], [(3, at(1, 30), 1.0)], [(5, at(20), 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)  # files are taken in the order of their times
    out = windows.drain(windows.tumbling(windows.timed(windows.source(spark, str(tmp_path), "events")), "1 hour"), "append")
    assert {(r["start"].hour, r["n"]) for r in out.collect()} == {(1, 1), (10, 2)}


@pytest.mark.parametrize("kind", ["orc", "json", "csv"])
def test_formats_keep_nulls(spark, kind):
    df = spark.createDataFrame([(1, "a,\"b\"", 1.5), (2, None, None), (None, "x y", -0.0)], "i long, s string, d double")
    assert sorted(map(str, through(df, kind).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        read(spark, "/nowhere", "avro")
    with pytest.raises(ValueError):
        read(spark, "/nowhere", "csv")


def test_entry_points(spark, tiny):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["item_id", "doc_id", "score", "rk"]


def test_filters_and_columns_reach_the_scan(spark, tiny, capsys):
    from millrace.plans.catalog import QUERIES

    QUERIES["q1_scan"](spark, tiny).explain("formatted")
    told = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_shipdate" in told and "l_tax" not in told


def test_not_in_is_not_broadcast(spark, tiny, capsys):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "a long")
    for held in ([], [2, 3], [2, 2, None], [None]):
        right = spark.createDataFrame([(x,) for x in held], "b long")
        want = sorted(str(r[0]) for r in spark.sql("SELECT a FROM {l} WHERE a NOT IN (SELECT b FROM {r})", l=left, r=right).collect())
        assert sorted(str(r[0]) for r in relational.not_in(left, "a", right, "b").collect()) == want
    from millrace.plans.catalog import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["q6_not_in"](spark, tiny).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_nearest_with_odd_vectors(spark):
    """Zero and null vectors, copies (ties by id), other widths: as SQL ranks them, not a number first and null last."""
    import numpy as np

    rng = np.random.default_rng(3)
    own = {i: list(map(float, rng.normal(size=4))) for i in range(1, 40)} | {50: [0.0] * 4, 51: None, 52: [1.0, None, 0.0, 0.0], 53: [1.0, 2.0]}
    own |= {60 + i: own[7] for i in range(8)}
    df = spark.createDataFrame(list(own.items()), "vec_id long, embedding array<double>")
    q = df.where("vec_id in (7, 9, 20, 53)").select(F.col("vec_id").alias("qid"), "embedding")
    got = {(r["qid"], r["rk"]): (r["vec_id"], r["cosine"]) for r in similarity.nearest(df, q, 12, 3).collect()}

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else math.nan

    key = lambda s: math.inf if s is None else -math.inf if math.isnan(s) else -s
    for i in (7, 9, 20, 53):
        want = sorted(((v, cosine(own[i], x)) for v, x in own.items() if v != i), key=lambda r: (key(r[1]), r[0]))[:12]
        assert str([got[i, rk] for rk in range(1, 13)]) == str([(v, None if s is None else s + 0.0) for v, s in want])


def test_approximate_equals_the_join_of_the_model(spark, tiny):
    """The same neighbours as from joining candidate rows; no candidate becomes a row."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window

    own = spark.read.parquet(f"{tiny}/embeddings.parquet")
    q = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    for width in (1.0, 0.05):
        near = similarity.approximate(own, q, width=width)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
        x, y = (d.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>"))) for d in (own, q))
        model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=8, seed=7).fit(x)
        met = model.approxSimilarityJoin(y, x, 2.0, "d").select("datasetA.qid", "datasetB.vec_id", F.round("d", 6).alias("d")).where("qid <> vec_id")
        want = met.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("d", "vec_id"))).where("rk <= 10")
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, want.collect()))


def test_jaccard_of_odd_sets(spark, monkeypatch):
    """One word that all texts hold, copies, empty and null texts, several blocks and parts; no pair is a row before it counts."""
    import numpy as np

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = {i: "the " + " ".join(rng.choice(words, size=int(rng.integers(1, 30)))) for i in range(1, 120)} | {200: "", 201: None, 202: "the", 203: "the the"}
    own = index.tokenised(spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "the")], "doc_id long, text string"))
    near = similarity.jaccard(own, own.where("doc_id % 3 = 0"), 0.2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    sets = {i: set((t or "").split()) for i, t in texts.items()}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets.items() if a % 3 == 0 for b, y in sets.items() if a != b and x and y and len(x & y) / len(x | y) >= 0.2}
    assert {(r["a"], r["b"]): r["jaccard"] for r in near.collect()} == pytest.approx(want) and len(want) > 50
    from millrace.operators import blocks

    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda df, *_: pack(df, 16, 64))
    sets = lambda df: df.where("doc_id is not null and size(toks) > 0").select(F.col("doc_id").alias("id"), F.array_distinct(F.transform("toks", lambda t: F.xxhash64(t))).alias("v"), F.array().cast("array<bigint>").alias("marks"))
    got = blocks.alike_sets(sets(own), sets(own.where("doc_id % 3 = 0")), 0.2, apart=10).collect()
    assert {(r["a"], r["b"]): round(r["share"], 6) for r in got} == pytest.approx(want) and len(got) == len(want)


@pytest.mark.parametrize("name", ["r2_bm25", "r3_tfidf", "r4_dirichlet", "r4_jelinek_mercer", "r11_rocchio", "e1_precision_recall", "e2_map_mrr", "e3_ndcg", "r10_known_items"])
def test_rankings_shuffle_no_postings(spark, tiny, name):
    """Documents are scored in the scan: nothing is persisted."""
    from millrace.plans.catalog import QUERIES

    df = QUERIES[name](spark, tiny)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryRelation" not in plan and ("MapInArrow" in plan or name.startswith(("e", "r11")))


def test_tfidf_of_rare_terms_and_empty_vectors(spark):
    """The same scores whether terms are held in the tasks or joined; a document whose terms are in all has no length."""
    own = index.tokenised(spark.createDataFrame([(1, "the cat sat"), (2, "the the"), (3, "the cat cat ran far"), (4, "the dog")], "doc_id long, text string"))
    q = ranking.query_terms(spark.createDataFrame([(7, "the cat"), (8, "dog zebra"), (9, "the")], "item_id long, text string"))
    few, all_held = ({tuple(r) for r in ranking.tfidf(own, q, frequent=n).collect()} for n in (1, 1000))
    w = lambda tf, df: (1 + math.log(tf)) * math.log(4 / df)
    one, three = math.hypot(w(1, 2), w(1, 1)), math.sqrt(w(2, 2) ** 2 + 2 * w(1, 1) ** 2)
    want = {(7, 3, round(w(2, 2) / three, 6), 1), (7, 1, round(w(1, 2) / one, 6), 2), (7, 4, 0.0, 3), (8, 4, 1.0, 1)}
    assert few == all_held == want


def test_postings_need_no_shuffle_of_terms(spark):
    """Ids in one row are counted in the scan; ids in several rows, null among them, are still brought together."""
    rows = [(1, "b a b"), (2, ""), (3, None), (4, "a"), (4, "b a"), (None, "a c"), (None, "a")]
    tok = index.tokenised(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["tok"], r["doc_id"]): r["tf"] for r in index.postings(tok).collect()}
    assert got == {("b", 1): 2, ("a", 1): 1, ("a", 4): 2, ("b", 4): 1, ("a", None): 2, ("c", None): 1}
    places = {(r["tok"], r["doc_id"]): r["positions"] for r in index.positions(tok).collect()}
    assert places == {("b", 1): [0, 2], ("a", 1): [1], ("a", 4): [0, 1], ("b", 4): [0], ("a", None): [0, 0], ("c", None): [1]}
    for made in (index.postings(tok), index.positions(tok)):
        assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    for made in (index.postings(tok.where("doc_id < 4")), index.positions(tok.where("doc_id < 4"))):
        assert made.count() == 2 and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
