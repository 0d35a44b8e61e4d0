"""The relational operators over the star schema and the events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.plans.register import Register
from millrace.sources.tables import bucketed, scratch, table, through

query = Register()


def _of(spark, sf, *names: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in names]


def _sql(spark, sf, text: str, *names: str) -> DataFrame:
    """Spark SQL over tables given as {name}; no global view is left behind."""
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


@query("q1_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_quantity < 10")
def q1(spark, sf):
    return table(spark, sf, "lineitem").where((F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_linenumber", "l_quantity")


def _format(kind: str, **options):
    @query(f"q1_{kind}", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    def f(spark, sf):
        return through(table(spark, sf, "customer"), kind, **options)


_format("csv", header="true")
_format("json")
_format("orc")


@query("q1_text", "SELECT c_name AS value FROM customer")
def q1_text(spark, sf):
    return through(table(spark, sf, "customer").select(F.col("c_name").alias("value")), "text")


@query("q2_partitioned_sink", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
def q2(spark, sf):
    """Folders of the two values alone are read."""
    at = scratch(spark, "orders")
    table(spark, sf, "orders").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(at)
    return spark.read.parquet(at).where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("q2_bucketed_sink", "SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def q2_bucketed(spark, sf):
    """Both sides are bucketed by the key: neither the join nor the aggregate shuffles."""
    name = scratch(spark, "b").rpartition("-")[2]
    a = bucketed(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), f"o_{name}", ["o_custkey"], 8)
    b = bucketed(table(spark, sf, "customer").select("c_custkey"), f"c_{name}", ["c_custkey"], 8)
    return a.join(b, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("q3_project_filter", """SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE""")
def q3(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R") & F.col("l_discount").between(0.05, 0.07))
    size = F.when(F.col("l_quantity") < 10, "few").when(F.col("l_quantity") < 30, "some").otherwise("many")
    return rows.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), size.alias("size"))


@query("q4_inner_join", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q4(spark, sf):
    """Totals by customer come before the joins, so the larger side shrinks first."""
    o, c, n = _of(spark, sf, "orders", "customer", "nation")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    met = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("t"), 2).alias("total"))


def _outer(kind: str):
    @query(f"q5_{kind}_join", f"SELECT o_orderkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) {kind.upper()} JOIN (SELECT * FROM lineitem WHERE l_quantity < 5) ON o_orderkey = l_orderkey")
    def f(spark, sf):
        o, i = _of(spark, sf, "orders", "lineitem")
        met = o.where("o_orderkey % 3 <> 0").join(i.where("l_quantity < 5"), F.col("o_orderkey") == F.col("l_orderkey"), kind)
        return met.select("o_orderkey", "l_orderkey", "l_linenumber", "l_quantity")


for _k in ("left", "right", "full"):
    _outer(_k)


@query("q6_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def q6_semi(spark, sf):
    c, o = _of(spark, sf, "customer", "orders")
    return c.join(o.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("q6_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q6_anti(spark, sf):
    o, i = _of(spark, sf, "orders", "lineitem")
    return o.join(i, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("q6_not_in", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q6_not_in(spark, sf):
    o, i = _of(spark, sf, "orders", "lineitem")
    return R.not_in(o.select("o_orderkey"), "o_orderkey", i.select("l_orderkey"), "l_orderkey")


@query("q7_null_safe_join", "SELECT k, a, b FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS k, count(*) AS a FROM customer GROUP BY 1) x JOIN (SELECT nullif(c_mktsegment, 'BUILDING') AS j, max(c_custkey) AS b FROM customer GROUP BY 1) y ON k IS NOT DISTINCT FROM j")
def q7(spark, sf):
    rows = table(spark, sf, "customer").withColumn("k", F.nullif("c_mktsegment", F.lit("BUILDING")))
    x, y = rows.groupBy("k").agg(F.count("*").alias("a")), rows.groupBy(F.col("k").alias("j")).agg(F.max("c_custkey").alias("b"))
    return x.join(y, F.col("k").eqNullSafe(F.col("j"))).select("k", "a", "b")


@query("q8_theta_join", "SELECT a.n_name AS poorer, b.n_name AS richer FROM (SELECT n_name, n_regionkey, max(c_acctbal) AS m FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) a JOIN (SELECT n_name, n_regionkey, max(c_acctbal) AS m FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) b ON a.n_regionkey = b.n_regionkey AND a.m < b.m")
def q8(spark, sf):
    c, n = _of(spark, sf, "customer", "nation")
    m = c.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("m")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n_regionkey", "m")
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.m") < F.col("b.m"))).select(F.col("a.n_name").alias("poorer"), F.col("b.n_name").alias("richer"))


@query("q9_range_join", "SELECT p.event_id AS error_id, e.event_id FROM (SELECT * FROM events WHERE event_type = 'error') p JOIN events e ON e.user_id = p.user_id AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 2 HOUR AND e.event_id <> p.event_id")
def q9(spark, sf):
    """Events of a user within two hours after an error."""
    e = table(spark, sf, "events")
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("user_id").alias("u"), F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("t1"))
    return R.range_join(e.select("event_id", "user_id", "ts"), spans.withColumnRenamed("u", "user_id"), "user_id", "ts", "t0", "t1", 7200).where("event_id <> error_id").select("error_id", "event_id")


@query("q10_asof_join", "SELECT p.event_id, c.event_id AS click_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def q10(spark, sf):
    e = table(spark, sf, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("value").alias("click_value"), "user_id", "ts")
    return R.asof_join(p, c, "user_id", "ts", "ts", ["click_id", "click_value"]).select("event_id", "click_id", "click_value")


@query("q11_lateral_join", "SELECT n_name, s_suppkey, s_acctbal FROM nation, LATERAL (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2)")
def q11(spark, sf):
    return _sql(spark, sf, "SELECT n_name, s_suppkey, s_acctbal FROM {nation}, LATERAL (SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2)", "nation", "supplier")


@query("q12_aggregate", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_net,
round(avg(l_discount), 6) AS avg_discount, min(l_shipdate) AS first_ship, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q12(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_net"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.min("l_shipdate").alias("first_ship"), F.max("l_tax").alias("max_tax"), F.count("*").alias("n"),
    )


@query("q13_distinct_aggregate", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey")
def q13(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_returnflag").alias("flags"))


@query("q13_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def q13_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("q14_approx_distinct")
def q14(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("q15_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus")
def q15(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("p50"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@query("q15_approx_quantiles")
def q15_approx(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", [0.5, 0.9], 10_000).alias("p"))


@query("q16_statistics", """SELECT p_brand, round(stddev_samp(l_extendedprice), 4) AS sd, round(var_samp(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS corr, arg_max(p_partkey, p_retailprice * 1e6::DOUBLE + p_partkey) AS dearest, round(covar_samp(l_quantity, l_discount), 6) AS covar
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def q16(spark, sf):
    i, p = _of(spark, sf, "lineitem", "part")
    return i.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(
        F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"), F.round(F.var_samp("l_quantity"), 6).alias("var"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"),
        F.max_by("p_partkey", F.col("p_retailprice") * 1e6 + F.col("p_partkey")).alias("dearest"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("covar"),
    )


@query("q16_mode")
def q16_mode(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.mode("l_quantity").alias("mode"))


_GROUPS = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n FROM lineitem GROUP BY "


@query("q17_cube", _GROUPS + "CUBE (l_returnflag, l_linestatus)")
def q17_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("q17_rollup", _GROUPS + "ROLLUP (l_returnflag, l_linestatus)")
def q17_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("q17_grouping_sets", _GROUPS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def q17_sets(spark, sf):
    return _sql(spark, sf, "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g1, CAST(grouping(l_linestatus) AS INT) AS g2, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "lineitem")


@query("q18_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY l_returnflag")
def q18_pivot(spark, sf):
    """The values are given, so that no job looks for them."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@query("q18_unpivot", "SELECT s_suppkey, 'nation' AS what, s_nationkey::DOUBLE AS x FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def q18_unpivot(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return rows.unpivot("s_suppkey", ["nation", "balance"], "what", "x")


@query("q19_collect", "SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS names, count(*) AS n FROM supplier GROUP BY s_nationkey")
def q19(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("names"), F.count("*").alias("n"))


_BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query("q20_ranking", f"""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER w AS nt,
round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS ({_BY})""")
def q20(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"), F.ntile(3).over(w).cast("long").alias("nt"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("q21_offsets", f"""SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders WINDOW w AS ({_BY})""")
def q21(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_orderkey", 2, -1).over(w).alias("after"), F.first_value("o_orderkey").over(w).alias("first"), F.last_value("o_orderkey").over(full).alias("last"), F.nth_value("o_orderkey", 2).over(full).alias("second"))


@query("q22_frames", f"""SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, max(o_totalprice) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_max,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS n90 FROM orders WINDOW w AS ({_BY})""")
def q22(spark, sf):
    return _sql(spark, sf, f"""SELECT o_orderkey, round(sum(o_totalprice) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, max(o_totalprice) OVER ({_BY} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_max,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n90 FROM {{orders}}""", "orders")


@query("q23_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def q23(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("q24_top_per_group", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rk FROM orders QUALIFY rk <= 3")
def q24(spark, sf):
    return R.top_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).drop("o_totalprice")


_A, _B = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'"


def _sets(name: str, call: str):
    @query(f"q25_{name}", f"({_A}) {name.upper().replace('_', ' ')} ({_B})")
    def f(spark, sf):
        o = table(spark, sf, "orders")
        a, b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
        out = getattr(a, call)(b)
        return out.distinct() if name == "union" else out


for _n, _c in (("union", "unionByName"), ("union_all", "unionByName"), ("intersect", "intersect"), ("intersect_all", "intersectAll"), ("except", "subtract"), ("except_all", "exceptAll")):
    _sets(_n, _c)

_SUB = "SELECT l_orderkey, l_partkey, l_quantity FROM {0} a WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM {0} b WHERE b.l_partkey = a.l_partkey) AND l_extendedprice > (SELECT avg(l_extendedprice) FROM {0})"


@query("q26_subqueries", _SUB.format("lineitem"))
def q26(spark, sf):
    return _sql(spark, sf, _SUB.replace("{0}", "{lineitem}"), "lineitem")


_REC = "WITH RECURSIVE up(k, depth) AS (SELECT r_regionkey, 0 FROM {0} UNION ALL SELECT k + 5, depth + 1 FROM up WHERE depth < 3) SELECT k, depth FROM up"


@query("q27_recursive", _REC.format("region"))
def q27(spark, sf):
    return _sql(spark, sf, _REC.replace("{0}", "{region}"), "region")


@query("q28_strings", r"""SELECT p_partkey, split_part(p_name, ' ', 2) AS second, translate(p_name, 'aeiou', '12345') AS swapped, regexp_replace(p_brand, '[a-z]+', '-', 'g') AS brand, substring(p_type, 2, 3) AS part, concat_ws('|', p_name, p_type) AS both,
lpad(p_size::VARCHAR, 4, '0') AS padded, reverse(p_name) AS backward, upper(p_name) AS loud, strpos(p_name, 'i')::INT AS at, length(p_name)::INT AS n, replace(p_type, 'O', '0') AS zero, trim('  ' || p_brand || ' ') AS trimmed, p_name LIKE '%ring' AS ring, repeat(p_brand, 2) AS twice FROM part""")
def q28(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"), F.translate("p_name", "aeiou", "12345").alias("swapped"), F.regexp_replace("p_brand", "[a-z]+", "-").alias("brand"), F.substring("p_type", 2, 3).alias("part"), F.concat_ws("|", "p_name", "p_type").alias("both"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.reverse("p_name").alias("backward"), F.upper("p_name").alias("loud"), F.instr("p_name", "i").alias("at"), F.length("p_name").alias("n"), F.replace("p_type", F.lit("O"), F.lit("0")).alias("zero"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"), F.col("p_name").like("%ring").alias("ring"), F.repeat("p_brand", 2).alias("twice"),
    )


@query("q29_dates", """SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01')::INT AS days, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, dayofweek(o_orderdate)::INT + 1 AS dow,
o_orderdate + INTERVAL 10 DAY AS later, last_day(o_orderdate) AS last, strftime(o_orderdate, '%Y/%m/%d') AS told FROM orders""")
def q29(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), F.date_diff(F.lit("2000-01-01").cast("date"), d.cast("date")).alias("days"), F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.quarter(d).alias("q"), F.dayofweek(d).alias("dow"),
        (d + F.make_dt_interval(F.lit(10))).alias("later"), F.last_day(d.cast("date")).alias("last"), F.date_format(d, "yyyy/MM/dd").alias("told"),
    )


@query("q30_math", """SELECT o_orderkey, round(ln(o_totalprice), 6) AS ln, round(sqrt(o_totalprice), 6) AS root, o_orderkey % 7 AS rest, floor(o_totalprice)::BIGINT AS low, ceil(o_totalprice)::BIGINT AS high, abs(o_orderkey - 500) AS off, round(o_totalprice / 7, 4) AS seventh, round(pow(o_orderkey % 10, 3), 2) AS cube,
sign(o_orderkey - 500)::DOUBLE AS sign, greatest(o_orderkey, o_custkey) AS most, o_orderkey & 255 AS low_byte, round(sin(o_orderkey), 6) + 0::DOUBLE AS sine FROM orders""")
def q30(spark, sf):
    t, k = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k, F.round(F.log(t), 6).alias("ln"), F.round(F.sqrt(t), 6).alias("root"), (k % 7).alias("rest"), F.floor(t).alias("low"), F.ceil(t).alias("high"), F.abs(k - 500).alias("off"), F.round(t / 7, 4).alias("seventh"), F.round(F.pow(k % 10, F.lit(3)), 2).alias("cube"),
        F.sign(k - 500).alias("sign"), F.greatest(k, F.col("o_custkey")).alias("most"), k.bitwiseAND(255).alias("low_byte"), F.round(F.sin(k), 6).alias("sine"),
    )


@query("q31_arrays", """SELECT o_custkey, list_sort(list_transform(ks, lambda x: x % 10)) AS digits, list_sort(list_filter(ks, lambda x: x % 2 = 0)) AS even, len(list_distinct(list_transform(ks, lambda x: x % 10)))::INT AS kinds, list_contains(ks, o_custkey) AS own, list_sum(ks)::BIGINT AS total, list_sort(ks)[1:2] AS two
FROM (SELECT o_custkey, list(o_orderkey) AS ks FROM orders GROUP BY o_custkey)""")
def q31(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
    return rows.select(
        "o_custkey", F.sort_array(F.transform("ks", lambda x: x % 10)).alias("digits"), F.filter("ks", lambda x: x % 2 == 0).alias("even"), F.size(F.array_distinct(F.transform("ks", lambda x: x % 10))).alias("kinds"), F.array_contains("ks", F.col("o_custkey")).alias("own"),
        F.aggregate("ks", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.slice("ks", 1, 2).alias("two"),
    )


@query("q31_nested", "SELECT s_nationkey, unnest(list_sort(flatten(list([s_suppkey, -s_suppkey])))) AS k FROM supplier GROUP BY s_nationkey")
def q31_nested(spark, sf):
    rows = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.flatten(F.collect_list(F.array(F.col("s_suppkey"), -F.col("s_suppkey")))).alias("ks"))
    return rows.select("s_nationkey", F.explode(F.sort_array("ks")).alias("k"))


@query("q32_maps", "SELECT n_regionkey, string_agg(n_name || '=' || n_nationkey, ',' ORDER BY n_name) AS pairs, count(*)::INT AS n, max(n_nationkey) FILTER (n_name = (SELECT min(n_name) FROM nation)) AS first FROM nation GROUP BY n_regionkey")
def q32(spark, sf):
    n = table(spark, sf, "nation")
    m = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m")).crossJoin(F.broadcast(n.agg(F.min("n_name").alias("least"))))  # one row
    entry = lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    return m.select("n_regionkey", F.array_join(F.transform(F.sort_array(F.map_entries("m")), entry), ",").alias("pairs"), F.size(F.map_keys("m")).alias("n"), F.try_element_at("m", F.col("least")).alias("first"))


@query("q33_json", "SELECT event_id, (props->>'$.k')::INT AS k, json_extract_string(props, '$.none') AS none, '{\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}' AS made FROM events")
def q33(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.get_json_object("props", "$.none").alias("none"), F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t"))).alias("made"))


@query("q33_variant", "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT > 90")
def q33_variant(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))
    return e.where("k > 90")


# ---- extension surface


@query("u1_scalar_udf", "SELECT o_orderkey, round(o_totalprice * 1.19::DOUBLE, 4) AS gross FROM orders")
def u1(spark, sf):
    @F.pandas_udf("double")
    def gross(x: pd.Series) -> pd.Series:
        return x * 1.19

    return table(spark, sf, "orders").select("o_orderkey", F.round(gross("o_totalprice"), 4).alias("gross"))


@query("u2_udaf", "SELECT o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 2) AS span FROM orders GROUP BY o_orderstatus")
def u2(spark, sf):
    """Spans of salted parts are joined by built-ins, so no group meets in one task."""

    @F.pandas_udf("double")
    def least(x: pd.Series) -> float:
        return float(x.min())

    @F.pandas_udf("double")
    def most(x: pd.Series) -> float:
        return float(x.max())

    parts = table(spark, sf, "orders").groupBy("o_orderstatus", F.pmod("o_orderkey", F.lit(64)).alias("part")).agg(least("o_totalprice").alias("lo"), most("o_totalprice").alias("hi"))
    return parts.groupBy("o_orderstatus").agg(F.round(F.max("hi") - F.min("lo"), 2).alias("span"))


@query("u3_udtf", "SELECT n_nationkey, unnest(string_split(lower(n_name), 'a')) AS piece FROM nation")
def u3(spark, sf):
    class Pieces:
        def eval(self, text: str):
            for piece in text.lower().split("a"):
                yield (piece,)

    pieces = F.udtf(Pieces, returnType="piece string")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name").alias("n")
    return n.lateralJoin(pieces(F.col("n.n_name").outer())).select("n_nationkey", "piece")
