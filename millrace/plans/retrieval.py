"""Text analysis, retrieval, similarity and evaluation over documents, benchmark, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import evaluation as E
from millrace.operators import index as I
from millrace.operators import ranking as R
from millrace.operators import similarity as S
from millrace.plans.register import Register
from millrace.sources.tables import scratch, stored, table

query = Register()

STOPS = ["a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"]
KNOWN_FIRST = 3

TOK = r"toks AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS toks FROM documents)"
OCC = "occ AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM toks)"
POST = "post AS (SELECT tok, doc_id, count(*) AS tf FROM occ GROUP BY ALL)"
STAT = "df AS (SELECT tok, count(*) AS df, sum(tf) AS ctf FROM post GROUP BY tok), dl AS (SELECT doc_id, len(toks) AS dl FROM toks), n AS (SELECT count(*) AS n, sum(dl) AS cf, avg(dl) AS avgdl FROM dl)"
BASE = f"WITH {TOK}, {OCC}, {POST}, {STAT}"


def _q(name: str, first: int | None = None) -> str:
    toks = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    return f"{name} AS (SELECT DISTINCT item_id, unnest({toks}{f'[1:{first}]' if first else ''}) AS tok FROM benchmark)"


def _ranked(name: str, q: str, part: str, outer: str = "round(sum(part), 6)", k: int = 10) -> str:
    """SQL of a ranked list: ``part`` is summed over the terms of ``q``."""
    return f"""{name}_s AS (SELECT item_id, doc_id, {outer} AS score FROM (SELECT item_id, p.doc_id, dl, {part} AS part FROM {q} JOIN post p USING (tok) JOIN df USING (tok) JOIN dl USING (doc_id), n) GROUP BY item_id, doc_id),
{name} AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rk FROM {name}_s QUALIFY rk <= {k})"""


BM25 = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"


def docs(spark, sf):
    return table(spark, sf, "documents")


def tok(spark, sf):
    return I.tokenised(docs(spark, sf))


def items(spark, sf, first=None):
    return R.query_terms(table(spark, sf, "benchmark"), first=first)


# ---- text


@query("t1_tokens", f"WITH {TOK} SELECT doc_id, len(toks)::BIGINT AS dl, md5(array_to_string(toks, ' ')) AS digest FROM toks")
def t1(spark, sf):
    return tok(spark, sf).select("doc_id", "dl", F.md5(F.array_join("toks", " ")).alias("digest"))


@query("t2_positions", f"WITH {TOK}, {OCC} SELECT doc_id, pos::INT AS pos, tok FROM occ")
def t2(spark, sf):
    return I.occurrences(tok(spark, sf))


@query("t3_stop_words", f"WITH {TOK}, {OCC} SELECT doc_id, count(*) AS n FROM occ WHERE tok NOT IN ({', '.join(repr(s) for s in STOPS)}) GROUP BY doc_id")
def t3(spark, sf):
    return I.without_stops(I.occurrences(tok(spark, sf)), STOPS).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("t4_stems")
def t4(spark, sf):
    """Stems with the number of terms that share them, and the first of those."""
    return I.stemmed(tok(spark, sf)).groupBy("stem").agg(F.count("*").alias("n_terms"), F.min("tok").alias("first_term"))


@query("t5_shingles", f"WITH {TOK} SELECT doc_id, CASE WHEN len(toks) < 3 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(toks) - 1), lambda i: array_to_string(toks[i:i+2], ' ')))) END::BIGINT AS n FROM toks")
def t5(spark, sf):
    return tok(spark, sf).select("doc_id", F.size(F.array_distinct(X.grams(F.col("toks"), 3))).cast("long").alias("n"))


@query("t6_char_grams", f"WITH {TOK}, {OCC}, d AS (SELECT DISTINCT tok FROM occ) SELECT gram, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(range(1, length(tok) - 1), lambda i: substr(tok, i, 3)))) AS gram FROM d WHERE length(tok) >= 3) GROUP BY gram")
def t6(spark, sf):
    """Terms of the dictionary that have each character trigram."""
    terms = tok(spark, sf).select(F.explode("toks").alias("tok")).distinct()
    return terms.select(F.explode(F.array_distinct(X.char_grams(F.col("tok"), 3))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("t7_inverted_index", f"WITH {TOK}, {OCC}, {POST} SELECT tok, doc_id, tf FROM post")
def t7(spark, sf):
    return I.postings(tok(spark, sf))


@query("t8_positional_index", f"WITH {TOK}, {OCC} SELECT tok, doc_id, string_agg(pos, ' ' ORDER BY pos) AS positions FROM occ GROUP BY tok, doc_id")
def t8(spark, sf):
    return I.positions(tok(spark, sf)).select("tok", "doc_id", F.array_join("positions", " ").alias("positions"))


@query("t9_statistics", f"{BASE} SELECT tok, df, ctf::BIGINT AS ctf, n, cf::BIGINT AS cf, round(avgdl, 6) AS avgdl FROM df, n")
def t9(spark, sf):
    own = tok(spark, sf)
    counts = own.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("ctf"))
    one = I.collection(own).select("n", "cf", F.round("avgdl", 6).alias("avgdl"))
    return I.document_frequency(own).join(counts, "tok").crossJoin(F.broadcast(one))  # one row


@query("t10_html_text", r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
  length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')))::INT AS n_visible FROM pages""")
def t10(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.title(F.col("html")).alias("title"), F.length(X.visible(F.col("html"))).alias("n_visible"))


@query("t11_links", """SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, len(l)::INT AS n_links, array_to_string(l, ' ') AS links FROM (SELECT *, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def t11(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), X.hrefs(F.col("html")).alias("l"))
    return rows.select("page_id", "host", F.size("l").alias("n_links"), F.array_join("l", " ").alias("links"))


@query("t12_index_layout", f"WITH {TOK}, {OCC}, {POST} SELECT tok, doc_id, tf FROM post WHERE tok IN ('from', 'tion', 'und')")
def t12(spark, sf):
    """Postings looked up in an index on disk; the filter reaches the sorted files."""
    at = scratch(spark, "index")
    I.write_index(I.postings(tok(spark, sf)), at)
    return spark.read.parquet(at).where(F.col("tok").isin("from", "tion", "und"))


# ---- retrieval


@query("r1_boolean_and", f"WITH {TOK} SELECT doc_id FROM toks WHERE list_contains(toks, 'the') AND list_contains(toks, 'of') AND list_contains(toks, 'from')")
def r1_and(spark, sf):
    return R.boolean_and(tok(spark, sf), ["the", "of", "from"])


@query("r1_boolean_or", f"WITH {TOK} SELECT doc_id FROM toks WHERE list_has_any(toks, ['und', 'que'])")
def r1_or(spark, sf):
    return R.boolean_or(tok(spark, sf), ["und", "que"])


@query("r1_boolean_not", f"WITH {TOK} SELECT doc_id FROM toks WHERE list_contains(toks, 'the') AND NOT list_has_any(toks, ['la', 'der'])")
def r1_not(spark, sf):
    return R.boolean_not(tok(spark, sf), ["the"], ["la", "der"])


@query("r2_bm25", f"{BASE}, {_q('q')}, {_ranked('r', 'q', BM25)} SELECT * FROM r")
def r2(spark, sf):
    """BM25 top 10 of every benchmark passage."""
    return R.bm25(tok(spark, sf), items(spark, sf))


@query("r3_tfidf", f"""{BASE}, {_q('q')}, w AS (SELECT p.tok, doc_id, (1 + ln(tf)) * ln(n::DOUBLE / df) AS w, ln(n::DOUBLE / df) AS idf FROM post p JOIN df USING (tok), n),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
qn AS (SELECT item_id, sqrt(sum(idf * idf)) AS qnorm FROM (SELECT DISTINCT item_id, tok, idf FROM q JOIN w USING (tok)) GROUP BY item_id),
s AS (SELECT item_id, doc_id, round(sum(w * idf) / any_value(norm) / any_value(qnorm), 6) AS score FROM q JOIN w USING (tok) JOIN norms USING (doc_id) JOIN qn USING (item_id) WHERE norm > 0 AND qnorm > 0 GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rk FROM s QUALIFY rk <= 10""")
def r3(spark, sf):
    return R.tfidf(tok(spark, sf), items(spark, sf))


@query("r4_dirichlet", f"""{BASE}, {_q('q')}, ql AS (SELECT item_id, count(*) AS ql FROM q SEMI JOIN df USING (tok) GROUP BY item_id),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + tf * cf::DOUBLE / (1000.0::DOUBLE * ctf))) + any_value(ql) * ln(1000.0::DOUBLE / (any_value(dl) + 1000.0::DOUBLE)), 6) AS score FROM q JOIN post USING (tok) JOIN df USING (tok) JOIN dl USING (doc_id) JOIN ql USING (item_id), n GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rk FROM s QUALIFY rk <= 10""")
def r4_dirichlet(spark, sf):
    return R.dirichlet(tok(spark, sf), items(spark, sf))


@query("r4_jelinek_mercer", f"{BASE}, {_q('q')}, {_ranked('r', 'q', 'ln(1 + 0.7::DOUBLE * tf * cf / (0.3::DOUBLE * dl * ctf))')} SELECT * FROM r")
def r4_jm(spark, sf):
    return R.jelinek_mercer(tok(spark, sf), items(spark, sf))


@query("r5_phrase", f"WITH {TOK}, {OCC} SELECT a.doc_id, count(*) AS n FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.tok = 'of' AND b.tok = 'the' GROUP BY a.doc_id")
def r5(spark, sf):
    return R.phrase(tok(spark, sf), ["of", "the"])


@query("r6_proximity", f"WITH {TOK}, {OCC} SELECT a.doc_id, count(*) AS n FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 3 WHERE a.tok = 'from' AND b.tok = 'was' GROUP BY a.doc_id")
def r6(spark, sf):
    return R.proximity(tok(spark, sf), "from", "was", 3)


@query("r7_wildcard", f"{BASE} SELECT tok, df FROM df WHERE tok LIKE 'tion%e'")
def r7(spark, sf):
    return R.wildcard(tok(spark, sf), "tion%e")


@query("r8_fuzzy", f"{BASE} SELECT tok, df, levenshtein(tok, 'thing')::INT AS d FROM df WHERE regexp_full_match(tok, '[a-z]+') AND levenshtein(tok, 'thing') <= 2")
def r8(spark, sf):
    return R.fuzzy(tok(spark, sf), "thing", 2)


@query("r9_phonetic")
def r9(spark, sf):
    return R.phonetic(tok(spark, sf), "thing")


KNOWN = "rel AS (SELECT DISTINCT item_id, doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("r10_known_items", f"WITH {KNOWN} SELECT item_id, doc_id FROM rel")
def r10(spark, sf):
    return R.known_items(docs(spark, sf), table(spark, sf, "benchmark"))


@query("r11_rocchio", f"""{BASE}, {_q('q', KNOWN_FIRST)}, {_ranked('r', 'q', BM25, k=3)},
fb AS (SELECT item_id, tok, sum(tf::DOUBLE / dl) / 3 * 0.75::DOUBLE AS w FROM (SELECT item_id, doc_id FROM r) JOIN post USING (doc_id) JOIN dl USING (doc_id) GROUP BY item_id, tok UNION ALL SELECT item_id, tok, 1.0::DOUBLE FROM q)
SELECT item_id, tok, round(sum(w), 9) AS weight FROM fb GROUP BY item_id, tok QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, tok) <= 10""")
def r11(spark, sf):
    own, q = tok(spark, sf), items(spark, sf, KNOWN_FIRST)
    return R.rocchio(own, q, R.bm25(own, q))


@query("r12_fusion", f"""{BASE}, {_q('q', KNOWN_FIRST)}, {_ranked('a', 'q', BM25)}, {_ranked('b', 'q', 'ln(1 + 0.7::DOUBLE * tf * cf / (0.3::DOUBLE * dl * ctf))')},
f AS (SELECT item_id, doc_id, round(coalesce(1::DOUBLE / (60 + a.rk), 0) + coalesce(1::DOUBLE / (60 + b.rk), 0), 9) AS score FROM a FULL JOIN b USING (item_id, doc_id))
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rk FROM f QUALIFY rk <= 10""")
def r12(spark, sf):
    own, q = tok(spark, sf), items(spark, sf, KNOWN_FIRST)
    return R.fuse(R.bm25(own, q), R.jelinek_mercer(own, q))


def _field(name: str, text: str) -> str:
    return rf"{name}t AS (SELECT page_id AS doc_id, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS t FROM pages), {name} AS (SELECT doc_id, tok, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(t) AS tok, len(t) AS dl FROM {name}t) GROUP BY doc_id, tok)"


VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query("r13_fielded", f"""WITH {_q('q', KNOWN_FIRST)}, {_field('fa', "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, {_field('fb', VISIBLE)},
s AS (SELECT item_id, doc_id, round(sum(x), 6) AS score FROM (SELECT item_id, doc_id, 3.0::DOUBLE * tf / dl AS x FROM q JOIN fa USING (tok) UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE * tf / dl FROM q JOIN fb USING (tok)) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rk FROM s QUALIFY rk <= 10""")
def r13(spark, sf):
    pages = table(spark, sf, "pages")
    title = I.tokenised(pages.select("page_id", X.title(F.col("html")).alias("t")), "page_id", "t")
    body = I.tokenised(pages.select("page_id", X.visible(F.col("html")).alias("t")), "page_id", "t")
    return R.fielded([(title, 3.0), (body, 1.0)], items(spark, sf, KNOWN_FIRST))


@query("r14_snippets", f"WITH {TOK}, p AS (SELECT doc_id, toks, list_position(toks, 'und') AS pos FROM toks WHERE list_contains(toks, 'und')) SELECT doc_id, pos::BIGINT AS pos, array_to_string(toks[greatest(1, pos - 3):pos + 3], ' ') AS snippet FROM p")
def r14(spark, sf):
    return R.snippets(tok(spark, sf), "und")


@query("r15_facets", f"WITH {TOK} SELECT lang, source, count(*) AS n FROM toks JOIN documents USING (doc_id) WHERE list_has_any(toks, ['und', 'que']) GROUP BY lang, source")
def r15(spark, sf):
    hits = R.boolean_or(tok(spark, sf), ["und", "que"])
    return docs(spark, sf).select("doc_id", "lang", "source").join(hits, "doc_id", "left_semi").groupBy("lang", "source").agg(F.count("*").alias("n"))


# ---- similarity


@query("s1_exact_copies", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def s1(spark, sf):
    return S.exact_copies(docs(spark, sf))


@query("s2_jaccard", f"""WITH {TOK}, s AS (SELECT doc_id, list_distinct(toks) AS s FROM toks WHERE len(toks) > 0), o AS (SELECT doc_id, unnest(s) AS tok FROM s),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM o a JOIN o b USING (tok) WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL)
SELECT a, b, round(shared::DOUBLE / (len(x.s) + len(y.s) - shared), 6) AS jaccard FROM m JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id WHERE jaccard >= 0.4::DOUBLE""")
def s2(spark, sf):
    """Documents whose id is divisible by 20 against all others."""
    own = tok(spark, sf)
    return S.jaccard(own, own.where("doc_id % 20 = 0"), 0.4)





@query("s5_nearest", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(q.e, v.e) / v.n / q.n, 6) + 0::DOUBLE AS cosine FROM v, v q WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT qid, vec_id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id)::INT AS rk FROM s QUALIFY rk <= 10""")
def s5(spark, sf):
    own = table(spark, sf, "embeddings")
    return S.nearest(own, own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"))


@query("s6_approximate")
def s6(spark, sf):
    own = table(spark, sf, "embeddings")
    return S.approximate(own, own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"))


# ---- evaluation

EVAL = f"{BASE}, {_q('q', KNOWN_FIRST)}, {_ranked('r', 'q', BM25)}, {KNOWN}, need AS (SELECT item_id, count(*) AS need FROM rel GROUP BY item_id)"


def judged(spark, sf):
    """Known items are the judgments: the documents that hold an item's passage."""
    ranked = R.bm25(tok(spark, sf), items(spark, sf, KNOWN_FIRST))
    return ranked, stored(R.known_items(docs(spark, sf), table(spark, sf, "benchmark")).withColumn("rel", F.lit(1)), "judged")


@query("e1_precision_recall", f"""{EVAL}, h AS (SELECT item_id, count(*) AS hits FROM r JOIN rel USING (item_id, doc_id) GROUP BY item_id),
m AS (SELECT item_id, coalesce(hits, 0) / 10.0::DOUBLE AS p, coalesce(hits, 0)::DOUBLE / need AS r FROM need LEFT JOIN h USING (item_id)) SELECT item_id, p, r, CASE WHEN p > 0 THEN round(2 * p * r / (p + r), 9) ELSE 0.0::DOUBLE END AS f1 FROM m""")
def e1(spark, sf):
    return E.precision_recall(*judged(spark, sf))


@query("e2_map_mrr", f"""{EVAL}, h AS (SELECT item_id, rk, row_number() OVER (PARTITION BY item_id ORDER BY rk) AS k FROM r JOIN rel USING (item_id, doc_id)),
p AS (SELECT item_id, sum(k::DOUBLE / rk) AS s, min(rk) AS best FROM h GROUP BY item_id) SELECT round(avg(coalesce(s / need, 0)), 9) AS map, round(avg(coalesce(1::DOUBLE / best, 0)), 9) AS mrr FROM need LEFT JOIN p USING (item_id)""")
def e2(spark, sf):
    return E.map_mrr(*judged(spark, sf))


@query("e3_ndcg", f"""{EVAL}, g AS (SELECT item_id, sum(1 / log2(rk + 1)) AS dcg FROM r JOIN rel USING (item_id, doc_id) GROUP BY item_id),
i AS (SELECT item_id, list_sum(list_transform(range(1, least(need, 10) + 1), lambda k: 1 / log2(k + 1))) AS idcg FROM need) SELECT item_id, round(coalesce(dcg, 0) / idcg, 9) AS ndcg FROM i LEFT JOIN g USING (item_id)""")
def e3(spark, sf):
    return E.ndcg(*judged(spark, sf))


def _rounds(k: int) -> str:
    step = lambda i: f""", l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM p{i - 1} ANTI JOIN o ON node = src), g{i} AS (SELECT dst, sum(rank / deg) AS got FROM e JOIN o USING (src) JOIN p{i - 1} ON src = node GROUP BY dst),
p{i} AS (SELECT v.node, (1 - 0.85::DOUBLE) / c + 0.85::DOUBLE * (coalesce(got, 0) + lost / c) AS rank FROM v LEFT JOIN g{i} ON v.node = dst, l{i}, c)"""  # noqa: E731
    return "".join(step(i) for i in range(1, k + 1))


@query("e4_pagerank", f"""WITH e AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages),
v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*)::DOUBLE AS c FROM v), o AS (SELECT src, count(*) AS deg FROM e GROUP BY src), p0 AS (SELECT node, 1 / c AS rank FROM v, c){_rounds(5)} SELECT node, round(rank, 9) AS rank FROM p5""")
def e4(spark, sf):
    """Over hosts and the paths that their pages link to; the pages don't link to each other."""
    pages = table(spark, sf, "pages")
    edges = pages.select(F.try_parse_url("url", F.lit("HOST")).alias("src"), F.explode(X.hrefs(F.col("html"))).alias("dst"))
    return E.pagerank(edges)
