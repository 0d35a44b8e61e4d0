"""The queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    if at := os.environ.get("MILLRACE_VOCABULARY"):
        return at
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hex64(col):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import covered, hits

    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered("spans").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path; source and language serve as directories."""
    from millrace.llm.license_scan import scan

    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "license", "license_score", "license_from")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bpe import bpe_round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_round_trip(docs, vocabulary())
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ngram_lm import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.html_extract import extract_text

    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.common import fresh_path
    from millrace.llm.warc import read_archives, write_archives

    at = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), at)
    return read_archives(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.secret_scan import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told("secrets").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_lm": op5_lm,
    "op6_html": op6_html,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_secrets": op10_secrets,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ITEM_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {ITEM_WORDS} AS ws FROM benchmark),
bs AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
bi AS (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bs),
win AS (SELECT DISTINCT item_id, k, list_slice(ws, i, i + k - 1) AS w FROM bi),
lens AS (SELECT DISTINCT k FROM win),
di AS (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, lens),
dw AS (SELECT rid, k, i, list_slice(ws, i, i + k - 1) AS w FROM di),
hit AS (SELECT rid, dw.k, i, item_id FROM dw JOIN win ON dw.k = win.k AND dw.w = win.w),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {SPACED.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wi AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
ww AS (SELECT rid, i, list_slice(ws, i, i + 7) AS v FROM wi),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS c FROM ww) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, source, unnest(ls) AS l, unnest(range(len(ls))) AS k FROM w),
nl AS (SELECT rid, source, k, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS l, len({SPACED.format("l")}) AS lw FROM ln),
tx AS (SELECT w.rid, any_value(w.source) AS source, coalesce(string_agg(l, chr(10) ORDER BY k), '') AS doc FROM w LEFT JOIN nl ON w.rid = nl.rid GROUP BY w.rid),
fr AS (SELECT nl.source, l, count(DISTINCT doc) AS n FROM nl JOIN tx USING (rid) GROUP BY nl.source, l),
ho AS (SELECT source, count(DISTINCT doc) AS docs FROM tx GROUP BY source),
bad AS (SELECT fr.source, l FROM fr JOIN ho ON fr.source IS NOT DISTINCT FROM ho.source WHERE n > 10 AND n > 0.05::DOUBLE * docs),
gone AS (SELECT rid, sum(lw) AS n_gone FROM nl JOIN bad ON nl.source IS NOT DISTINCT FROM bad.source AND nl.l = bad.l GROUP BY rid),
s AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(n_repeat, 0) > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(n_repeat, 0) > 30 * n_words) AND n_words - coalesce(n_gone, 0) >= 0.3::DOUBLE * n_words AS kept
FROM s LEFT JOIN rw USING (rid) LEFT JOIN gone USING (rid)
"""

_SEG = "list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(regexp_replace(s, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}', '<x>', 'g'), '[0-9]+', '<n>', 'g'))"
_LEVELS = "".join(
    f"""
c{k} AS (SELECT *, {"coalesce(array_to_string(seg[4:], '/'), '')" if k == 3 else f"coalesce(seg[{k + 1}], '')"} AS child FROM t{k}),
w{k} AS (SELECT host AS wh, tmpl AS wt FROM c{k} WHERE child <> '' GROUP BY host, tmpl HAVING count(DISTINCT child) > 16),
s{k} AS (SELECT page_id, host, path, rule, told, seg, chain, child, tmpl || CASE WHEN child = '' THEN '' WHEN wh IS NOT NULL THEN '/<*>' ELSE '/' || child END AS tmpl
  FROM c{k} LEFT JOIN w{k} ON host = wh AND tmpl = wt),
t{k + 1} AS (SELECT page_id, host, path, rule, told, seg, tmpl, CASE WHEN child = '' THEN chain ELSE list_append(chain, tmpl) END AS chain FROM s{k}),"""
    for k in range(4)
)
OP9_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(told, rule, rh, rp) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
hh AS (SELECT row_number() OVER () AS rid, * FROM h),
f AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(told, length(rule)) AS told FROM hh, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
t0 AS (SELECT page_id, host, path, rule, told, {_SEG} AS seg, '' AS tmpl, [''] AS chain FROM hh LEFT JOIN f USING (rid)),{_LEVELS}
x AS (SELECT host, told, chain, unnest(range(len(chain))) AS d FROM t4 WHERE told IS NOT NULL),
n AS (SELECT host, d, chain[d + 1] AS tmpl, CASE WHEN d > 0 THEN chain[d] END AS parent, sum((told = 'block')::INT)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
p AS (SELECT coalesce(sum(bad), 0) / greatest(coalesce(sum(n), 0), 1) AS prior FROM n WHERE d = 0),
fam AS (SELECT host AS fh, d AS fd, parent AS fp, sum(bad) AS fbad, sum(n) AS fn FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT *, fbad / fn AS q, fn - n AS rest FROM n LEFT JOIN fam ON host = fh AND d = fd AND parent = fp),
e AS (SELECT host, d, tmpl, parent, bad, n, coalesce(rest > 0 AND abs(bad / n - (fbad - bad) / greatest(rest, 1)) <= 1.96 * sqrt(q * (1 - q) * (1 / n + 1 / greatest(rest, 1))), false) AS alike FROM m),
al AS (SELECT host AS ah, d AS ad, parent AS ap, sum(bad) AS abad, sum(n) AS an FROM e WHERE alike GROUP BY ALL),
g AS (SELECT host, d, tmpl, (coalesce(abad, bad) + 5 * prior) / (coalesce(an, n) + 5) >= 0.8 AS gone FROM e LEFT JOIN al ON alike AND host = ah AND d = ad AND parent = ap CROSS JOIN p),
l AS (SELECT DISTINCT host, chain FROM t4 WHERE told IS NULL),
k AS (SELECT host, chain, unnest(range(len(chain))) AS d FROM l),
v AS (SELECT k.host AS vh, k.chain AS vc, arg_max(gone, k.d) AS gone FROM k JOIN g ON k.host = g.host AND k.d = g.d AND k.chain[k.d + 1] = g.tmpl GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN gone THEN 'block' ELSE 'allow' END) AS verdict FROM t4 LEFT JOIN v ON host = vh AND chain = vc
"""

_BITS = "list_aggregate(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), 'string_agg', '')"
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, {_BITS} AS bits FROM f)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_position({[format(i, "05b") for i in range(32)]}, substr(bits, 5 * i + 1, 5)) - 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op7_warc": OP7_SQL,
    "op8_quality": OP8_SQL,
    "op9_urls": OP9_SQL,
}
