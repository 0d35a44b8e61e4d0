"""Operators 1, 2, 8 and 9 against brute force, and on odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm.decontaminate import covered, decontaminate, hits
from millrace.llm.quality import judge as judge_quality
from millrace.llm.simhash import components, keep_first, near_duplicates, shingle_near_duplicates
from millrace.llm.url_filter import judge as judge_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd(spark, extra=""):
    """Nulls, empty and long texts, repeats, and columns with internal names."""
    rows = [(1, "a b c d e f g h i j k l", 7), (1, "a b c d e f g h i j k l", 7), (2, None, None), (3, "", 1), (None, "x y z", 2), (4, "word " * 30_000, 3), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source int")
    for c in ("_id", "_host", "row", "node", "h", "w", "key", "fp", "spans", "items", "new", "flags", "lines", "component_id", "gone", "id", "hash"):
        df = df.withColumn(c, F.lit("own"))
    return df


# ---- 1


def windows_of(items):
    """(windows by length, items of each) by plain loops."""
    out = defaultdict(set)
    for item, text in items:
        w = ITEM.findall((text or "").translate(LOWER))
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if w else ():
            out[tuple(w[i : i + k])].add(item)
    return out


def brute_hits(text, wins):
    w = ITEM.findall((text or "").translate(LOWER))
    hit, items = set(), set()
    for k in {len(x) for x in wins}:
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                items |= wins[tuple(w[i : i + k])]
    return len(w), hit, sorted(str(x) for x in items if x is not None)


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_hits_equal_brute_force(spark, tiny, broadcast_bytes):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(900, "one TWO, three"), (901, None), (900, "one TWO, three"), (902, ("one two three " * 5))], "doc_id long, text string")
    docs = docs.union(more)
    items = spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(70, "two three"), (71, "Three"), (72, ""), (73, None), (None, "one")], "item_id long, text string"))
    wins = windows_of([tuple(r) for r in items.collect()])
    want = []
    for i, t in docs.collect():
        n, hit, own = brute_hits(t, wins)
        want.append((i, n, len(hit), own))
    found = hits(docs, items, broadcast_bytes=broadcast_bytes).select("doc_id", "n_words", covered("spans").alias("n"), "items")
    got = [(r[0], r[1], r[2], list(r[3])) for r in found.collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] > 0 for x in got) > 5


def test_decontaminate_modes(spark):
    docs = odd(spark)
    items = spark.createDataFrame([(1, "C d e"), (2, "nothing here")], "item_id int, text string")
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4", "None", "None"]
    cut = decontaminate(spark.createDataFrame([(1, "a, b! C d-E? f.", "x"), (2, None, "y")], "doc_id long, text string, sizes string"), items, mode="spans")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "a, b? f.", 2: None}  # the separators before a hit word go with it
    assert decontaminate(docs, items.limit(0)).count() == docs.count()
    assert decontaminate(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        decontaminate(docs, items, mode="other")


# ---- 2


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(nodes, near):
    label = {n: n for n in nodes}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    return {n: top(n) for n in nodes}


def test_near_duplicates_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, " \n"), (9003, "Ä b"), (9004, "Ä B")], "doc_id long, text string"))
    prints = {i: brute_fingerprint(t) for i, t in docs.collect()}
    ids = sorted(prints)
    each = np.array([prints[i] for i in ids], dtype=np.uint64)
    near = [(ids[a], ids[int(b)]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(each[a] ^ each) <= 2) if a < b]
    want = brute_components(ids, near)
    got = {r["doc_id"]: (r["fp"] & ((1 << 64) - 1), r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in ids}
    assert any(want[i] != i for i in ids)


def test_near_duplicates_on_odd_rows(spark):
    got = near_duplicates(odd(spark)).collect()
    assert len(got) == 7 and {r["component_id"] for r in got if r["fp"] == 0} == {2}
    assert near_duplicates(odd(spark).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 500: 500, 501: 500}


def test_shingle_groups_against_brute_force(spark, small):
    """All pairs of 0.8 or more meet, and no others."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    sets = {}
    for i, t in docs.collect():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    shared = Counter((a, b) for own in by.values() if len(own) > 1 for a in own for b in own if a < b)
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    want = brute_components(list(sets), near)
    got = {r["doc_id"]: r["component_id"] for r in shingle_near_duplicates(docs).collect()}
    assert got.keys() == want.keys()
    together = sum(got[a] == got[b] for a, b in near)
    assert together == len(near) > 50
    assert all(want[i] == got[i] or not sets[i] for i in got)
    kept = {r["doc_id"] for r in keep_first(docs, shingle_near_duplicates(docs)).collect()}
    assert kept == {i for i in got if got[i] == i}


def brute_groups(texts, least=0.8):
    """Components of all pairs of ``texts`` (id, text) whose five-word shingles are alike by ``least``."""
    sets = {}
    for i, t in texts:
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return brute_components(list(sets), near), near


def edited(words, rng, n):
    """The words with ``n`` of them, six places apart at least, replaced."""
    out = list(words)
    for k in rng.choice(len(words) // 6, n, replace=False):
        out[6 * k] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


@pytest.mark.parametrize("cost", [{}, {"pairs": 0, "block": 8}, {"block": 8}])
def test_copies_of_a_late_base_are_one_group(spark, cost):
    """Copies are alike to their base alone, whose id isn't the smallest."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(397)]
    texts = [(k, edited(base, rng, 6)) for k in range(50)] + [(50, " ".join(base))]
    other = [f"v{k}" for k in range(200)]
    texts += [(100 + k, " ".join([*other[:150], *(f"u{k}x{j}" for j in range(50))])) for k in range(30)]
    want, _ = brute_groups(texts)
    assert sum(i == label for i, label in want.items()) == 31
    got = {r["doc_id"]: r["component_id"] for r in shingle_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), **cost).collect()}
    assert got == want


def test_appended_cut_and_edited_copies_all_meet(spark):
    """Each kind apart: every pair of 0.8 or more ends up together."""
    rng = np.random.default_rng(7)
    kinds, texts = {}, []
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        more = int(rng.integers(15, 72))
        made = {"base": " ".join(words), "appended": " ".join([*words, *(f"p{x}" for x in rng.integers(0, 3000, more))]), "cut": " ".join(words[: 300 - more * 2 // 3]), "edited": edited(words, rng, 6)}
        for j, (kind, t) in enumerate(made.items()):
            kinds[10 * k + j] = kind
            texts.append((10 * k + j, t))
    want, near = brute_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in shingle_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    recall = {kind: [got[a] == got[b] for a, b in near if kinds[a] == "base" and kinds[b] == kind] for kind in ("appended", "cut", "edited")}
    assert all(len(x) > 60 and all(x) for x in recall.values())
    assert got == want


def test_pipeline_near_dedup_follows_simhash_and_shingles(spark):
    """The stage's groups are those of brute force over both kinds of links, which each find what the other misses."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    texts = [(900, " \n"), (901, "\t")]
    for k in range(8):
        chorus, verse, other = ([f"{c}{x}" for x in rng.integers(0, 1 << 40, n)] for c, n in (("c", 41), ("v", 60), ("o", 60)))
        song = chorus * 30
        # Another verse leaves the fingerprint, fewer choruses and an appended passage leave the shingles; 2 meets 0 by 5 alone.
        texts += [(10 * k + 2, " ".join([*song, *verse])), (10 * k + 5, " ".join([*song, *other])), (10 * k, " ".join([*chorus * 2, *other]))]
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
        texts += [(10 * k + 4, " ".join(base)), (10 * k + 3, " ".join([*base, *(f"p{x}" for x in range(50))]))]
    sets, prints = {}, {i: brute_fingerprint(t) for i, t in texts}
    for i, t in texts:
        w = WORD.findall(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    hashed = {(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 2}
    alike = {(a, b) for a, b in pairs if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(hashed - alike) > 5 and len(alike - hashed) > 5
    want = brute_components(list(sets), hashed | alike)
    assert all(want[10 * k + 2] == 10 * k for k in range(8)) and not {(10 * k, 10 * k + 2) for k in range(8)} & (hashed | alike)
    docs = spark.createDataFrame([*texts, (None, texts[0][1]), *texts[2:4], (999, texts[2][1])], "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    kept = sorted(str(r["doc_id"]) for r in got.collect())
    repeated = [i for i, _ in texts[2:4] if want[i] == i]
    assert kept == sorted(["None", *(str(i) for i in [*(i for i in want if want[i] == i), *repeated])])


def test_keep_first_on_odd_rows(spark):
    docs = odd(spark)
    kept = keep_first(docs, shingle_near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "4", "None", "None"]
    assert keep_first(docs.limit(0), shingle_near_duplicates(docs.limit(0))).count() == 0


# ---- 8


def brute_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    wins = defaultdict(list)
    for i in range(len(w) - 7):
        wins[tuple(w[i : i + 8])].append(i)
    repeat = {p for at in wins.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat)


def test_statistics_equal_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source")
    odd_texts = [(5001, None, "a"), (5002, "", None), (5003, "x\n\nx\n \n x", "a"), (5004, "a b c d e f g h a b c d e f g h " * 2, "a"), (5005, "one two 𝒳𝒴 \x85 é", None)]
    docs = docs.union(spark.createDataFrame(odd_texts, "doc_id long, text string, source string"))
    got = {r["doc_id"]: tuple(r)[1:] for r in judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    for i, t, _ in docs.collect():
        s = brute_statistics(t)
        assert got[i] == (*s, s[0] < 20 or 100 * s[4] > 30 * s[0]), i


def test_shared_lines_go_and_depleted_documents_fall(spark):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    menu = "Home   About us Contact\tPrivacy terms of use"
    rows = [(k, f"{menu}\n{body(k)}", "h") for k in range(40)] + [(100, f"{menu}\n" * 6 + body(100)[:30] + " more", "h")]
    rows += [(200 + k, f"{body(0)}\ncopy", "copies") for k in range(50)] + [(300, f"{menu}\n{body(300)}", "other"), (301, f"{menu}\n{body(301)}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(1)).withColumn("flags", F.lit(2))
    got = {r["doc_id"]: r for r in judge_quality(docs).collect()}
    assert all(got[k]["kept"] and got[k]["clean_text"] == body(k) for k in range(40))
    assert not got[100]["kept"]
    assert all(got[200 + k]["kept"] and "copy" in got[200 + k]["clean_text"] for k in range(50))
    assert got[300]["clean_text"].startswith(menu) and got[301]["clean_text"].startswith(menu)
    plain = {(r["doc_id"], r["clean_text"], r["kept"]) for r in judge_quality(docs, broadcast_bytes=0).collect()}
    assert plain == {(r["doc_id"], r["clean_text"], r["kept"]) for r in got.values()}


def test_lines_are_counted_by_distinct_documents(spark):
    """A footer of words longer than the bodies' is counted whole; copies of a text, whatever their case and spaces, count once."""
    footer = " ".join(f"footerword{k:030d}" for k in range(20))
    rows = [(k, f"{' '.join(f'b{k}x{j}' for j in range(40))}\n{footer}", "h") for k in range(30)] + [(100 + k, " ".join(f"o{k}x{j}" for j in range(40)), "h") for k in range(500)]
    rows += [(700 + k, " ".join(f"c{j}" for j in range(25)) + " " * k + "\nAnd\tthis" + " too" * (k % 2), "h") for k in range(600)]
    got = {r["doc_id"]: r for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["kept"] and got[k]["n_left"] == 40 and footer not in got[k]["clean_text"] for k in range(30))
    assert all(got[700 + k]["kept"] and got[700 + k]["n_left"] == got[700 + k]["n_words"] for k in range(600))


def test_quality_on_odd_rows(spark):
    docs = odd(spark)
    got = judge_quality(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == 7
    assert {r["doc_id"] for r in got.where("kept").collect()} == set()
    assert judge_quality(docs.limit(0)).count() == 0


# ---- 9

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_rules_equal_brute_force(spark, small):
    urls = [r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "http://a.b.NET/fr/", "http://net/es/1", "http://notnet/es/1", "x://www.example.com/en/", "http://example.com?/en/", "http://ÄB.com#/x", "a://b://c.com/x\ny"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("seg", F.lit(1)).withColumn("rule", F.lit("old"))
    got = {r["page_id"]: r for r in judge_urls(df).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule = brute_rule(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        if rule:
            assert got[k]["verdict"] == RULES[rule]


def brute_tree(urls, rules, depth=4, branching=16, weight=5.0, reject=0.8):
    """Verdicts by a tree of dictionaries."""
    found = [brute_rule(u) for u in urls]
    paths = []
    for _, path, _ in found:
        seg = [re.sub("[0-9]+", "<n>", re.sub(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{16,}", "<x>", x)) for x in path.split("/") if x]
        paths.append(seg[: depth - 1] + (["/".join(seg[depth - 1 :])] if seg[depth - 1 :] else []))
    chains = [[(f[0],)] for f in found]
    for level in range(depth):
        below = defaultdict(set)
        for chain, seg in zip(chains, paths, strict=True):
            if level < len(seg):
                below[chain[-1]].add(seg[level])
        for chain, seg in zip(chains, paths, strict=True):
            if level < len(seg):
                chain.append((*chain[-1], "<*>" if len(below[chain[-1]]) > branching else seg[level]))
    bad, n = Counter(), Counter()
    for chain, (_, _, rule) in zip(chains, found, strict=True):
        for node in chain if rule else ():
            n[node] += 1
            bad[node] += rules[rule] == "block"
    prior = sum(bad[x] for x in n if len(x) == 1) / max(1, sum(n[x] for x in n if len(x) == 1))
    families = defaultdict(list)
    for x in n:
        if len(x) > 1:
            families[x[:-1]].append(x)
    gone = {x: (bad[x] + weight * prior) / (n[x] + weight) >= reject for x in n}
    for own in families.values():
        fb, fn = sum(bad[x] for x in own), sum(n[x] for x in own)
        alike = [x for x in own if fn > n[x] and abs(bad[x] / n[x] - (fb - bad[x]) / (fn - n[x])) <= 1.96 * (fb / fn * (1 - fb / fn) * (1 / n[x] + 1 / (fn - n[x]))) ** 0.5]
        for x in alike:
            gone[x] = (sum(bad[y] for y in alike) + weight * prior) / (sum(n[y] for y in alike) + weight) >= reject
    return [rules[rule] if rule else "block" if next((gone[x] for x in chain[::-1] if x in gone), False) else "allow" for chain, (_, _, rule) in zip(chains, found, strict=True)]


def test_tree_equals_brute_force_and_decides_rows(spark, small):
    urls = [r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").select("url").collect()]
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("o", "u", "an")]
    for _ in range(1500):
        host = ("a.net", "b.net", "shop.example.com", "www.example.com", "c.org")[rng.integers(5)]
        urls.append(f"http://{host}/" + "/".join([("es", "fr", "en", "x")[rng.integers(4)], *(words[k] for k in rng.integers(0, len(words), rng.integers(0, 6)))]))
    urls += [None, "http://a.net/es/" + "p/" * 3000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(df).collect()}
    want = brute_tree(urls, RULES)
    assert [got[k] for k in range(len(urls))] == want
    free = [v for v, u in zip(want, urls, strict=True) if brute_rule(u)[2] is None]
    assert min(free.count("block"), free.count("allow")) > 50


def test_template_tree_rejects_bad_branches(spark):
    rules = (("block", "s.org/bad/1"), ("allow", "s.org/good/1"))
    urls = [f"http://s.org/bad/{k}" for k in range(10, 60)] + [f"http://s.org/good/{k}" for k in range(10, 60)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in judge_urls(df, rules=rules).collect()}
    assert got["http://s.org/bad/55"] == (None, "block") and got["http://s.org/good/55"] == (None, "allow")
    wide = spark.createDataFrame([(k, f"http://w.org/user{chr(97 + k % 26)}{chr(97 + k // 26)}/x") for k in range(100)], "page_id long, url string")
    assert {r["verdict"] for r in judge_urls(wide, rules=(("block", "w.org/usera"),)).collect()} == {"block"}
    assert judge_urls(df.limit(0)).count() == 0
