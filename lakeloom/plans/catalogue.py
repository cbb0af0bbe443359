"""The relational operators as named queries: Spark SQL, and DuckDB SQL that must give the same rows.

A query is registered over the tables that it names. Money is summed as decimals or rounded, so that the
order of addition can't show; whatever either engine types otherwise is cast.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compat
from ..session import TABLES, table
from . import engine_queries, ranks

SPARK: dict[str, str] = {}
DUCK: dict[str, str] = {}


def both(name: str, sql: str, duck: str | None = None) -> None:
    SPARK[name], DUCK[name] = sql, duck or sql


def runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


REVENUE = "CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))"

both("const_select", "SELECT 42 AS answer, 'plain text' AS greeting, 1 + 41 AS total")
Q1 = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
both("q1", Q1)
Q6 = """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '{y}-01-01' AND l_shipdate < DATE '{y}-01-01' + INTERVAL '1' YEAR AND l_discount BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.07 AS DOUBLE) AND l_quantity < 24"""
both("q6", Q6.format(y=1994))
both("q6_1996", Q6.format(y=1996))
both("filter_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R' AND l_discount < CAST(0.02 AS DOUBLE)")
both("projection_arith", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) * (1 + CAST(l_tax AS DECIMAL(15,2))) AS DOUBLE) AS charge, l_linenumber * 10 + 1 AS tag FROM lineitem")
both("column_equality", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey AND l_linenumber <> 5")
both("between_null_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority IS NOT NULL AND NOT (o_custkey IS NULL)")
both("like_predicate", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment LIKE '%U%' AND c_name NOT LIKE '%9'")
both("is_null_case", "SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'open' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS state FROM orders")
both("group_count", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
both("group_multi_key", "SELECT l_returnflag, l_linestatus, l_linenumber, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
both("group_only", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority")
both("high_card_group", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey")
both("global_agg", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o_orderstatus) AS BIGINT) AS n_status, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS lo, max(o_orderkey) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders")
both("join_inner", "SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey")
both("join_three_way", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
both("join_group_by", "SELECT n_name, CAST(round(sum(rev), 2) AS DOUBLE) AS revenue, CAST(sum(k) AS BIGINT) AS n FROM (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS rev, count(*) AS k FROM lineitem GROUP BY l_orderkey) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", f"SELECT n_name, CAST(round(sum({REVENUE}), 2) AS DOUBLE) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
both("self_join_group_order", "SELECT a.n_regionkey AS region, CAST(count(*) AS BIGINT) AS pairs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_regionkey ORDER BY region")
both("broadcast_join", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey WHERE l_quantity > 40")  # by the size of supplier, which grows: no hint
both("shuffle_join", "SELECT /*+ MERGE(o) */ l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders o ON l_orderkey = o_orderkey WHERE l_quantity > 40", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders o ON l_orderkey = o_orderkey WHERE l_quantity > 40")
both("shuffle_hash_join", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders o ON l_orderkey = o_orderkey WHERE l_discount > 0.05")  # hashed where every partition is small: see session.py
both("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
both("small_left_big", "SELECT r_name, CAST(count(o_orderkey) AS BIGINT) AS n FROM region LEFT JOIN orders ON o_orderkey % 7 = r_regionkey AND o_totalprice > 400000 GROUP BY r_name")
both("right_join", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
both("full_join", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 0")
both("semi_join_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
both("exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
both("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
both("theta_join", "SELECT a.n_nationkey AS lo, b.n_nationkey AS hi FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
both("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("lateral_join", "SELECT r_name, x.n FROM region, LATERAL (SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_regionkey = r_regionkey) AS x")
both("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM orders)")
both("order_by_total", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey")
both("group_order_by", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority")
both("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
both("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey NULLS FIRST LIMIT 20 OFFSET 10")
both("agg_over_limit", "SELECT CAST(count(*) AS BIGINT) AS n, sum(o_orderkey) AS s FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10) t", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10) t")
both("union_all_two_aggs", "SELECT o_orderstatus AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT l_returnflag AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
both("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
both("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
both("intersect_all", "SELECT l_linenumber AS k FROM lineitem INTERSECT ALL SELECT n_regionkey AS k FROM nation")
both("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000")
both("except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey AS k FROM region")
both("cte", "WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS spent FROM orders GROUP BY o_custkey) SELECT c_name, CAST(spent AS DOUBLE) AS spent FROM big JOIN customer ON o_custkey = c_custkey WHERE spent > 500000")
both("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
both("derived_table", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderstatus AS status, o_totalprice AS price FROM orders) AS t WHERE price > 100000 GROUP BY status")
both("values_source", "SELECT id, status FROM (VALUES (1, 'open'), (2, 'shipped'), (3, 'open')) AS t(id, status) WHERE status = 'open'")
both("running_sum", "SELECT o_custkey, o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running FROM orders", "SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS running FROM orders")
both("window_global", "SELECT n_nationkey, sum(n_nationkey) OVER (ORDER BY n_nationkey) AS running FROM nation", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (ORDER BY n_nationkey) AS BIGINT) AS running FROM nation")
both("rank_family", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS r, CAST(dense_rank() OVER v AS BIGINT) AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)")
both("lag_lead", "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS head, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
both("rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near, last_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders")
both("range_frame", "SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS BIGINT) AS near FROM customer")
both("groups_frame", "SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_nationkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM (SELECT c_custkey, c_nationkey, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS g FROM customer) t", "SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM customer")
both("qualify", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
both("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
both("count_distinct", "SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS statuses FROM orders GROUP BY o_orderpriority")
both("filter_agg", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS done, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_orderpriority")
both("having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
for kind, by in (("cube", "CUBE (l_returnflag, l_linestatus)"), ("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    both(kind, f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY {by}")
both("stats_agg", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY l_returnflag")
both("regr_agg", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM lineitem GROUP BY l_returnflag")
both("bool_bit_agg", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS ba, bool_or(o_totalprice > 500000) AS bo, bit_and(o_orderkey) AS bita, bit_or(o_orderkey) AS bito, bit_xor(o_orderkey) AS bitx FROM orders GROUP BY o_orderstatus")
both("string_agg", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("array_agg", "SELECT n_regionkey, array_join(transform(sort_array(collect_list(n_nationkey)), x -> CAST(x AS STRING)), ' ') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), ' ') AS keys FROM nation GROUP BY n_regionkey")
both("approx_distinct", "SELECT o_orderpriority, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.15 * count(DISTINCT o_custkey) AS close FROM orders GROUP BY o_orderpriority")
both("approx_percentile", "SELECT l_returnflag, abs(percentile_approx(l_quantity, 0.5) - percentile(l_quantity, 0.5)) <= 1 AS close FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, abs(approx_quantile(l_quantity, 0.5) - median(l_quantity)) <= 1 AS close FROM lineitem GROUP BY l_returnflag")
both("case_coalesce", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, greatest(c_nationkey, 5) AS hi, least(c_nationkey, 5) AS lo, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal = 0 THEN 'even' ELSE 'credit' END AS state, ifnull(nullif(c_nationkey, 3), -1) AS nk FROM customer")
both("string_fns", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, CAST(length(c_name) AS BIGINT) AS len, substr(c_name, 1, 4) AS head, concat(c_mktsegment, '-', c_name) AS cat, replace(c_name, '0', 'o') AS rep, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '.') AS rp, trim('  x ') AS tr, reverse(c_name) AS rev, CAST(instr(c_name, '#') AS BIGINT) AS pos, left(c_name, 3) AS lf, right(c_name, 3) AS rt, split_part(c_name, '#', 2) AS part, repeat('ab', 2) AS rp2, translate(c_name, '01', 'xy') AS tl, ascii(c_name) AS ac, concat_ws('/', c_mktsegment, c_name) AS cw, CAST(levenshtein(c_mktsegment, 'BUILDING') AS BIGINT) AS lev FROM customer")
both("regex_fns", "SELECT p_partkey, regexp_like(p_type, '^[A-Z]+') AS is_up, regexp_replace(p_name, '[aeiou]', '_') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS num FROM part", "SELECT p_partkey, regexp_matches(p_type, '^[A-Z]+') AS is_up, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS num FROM part")
both("hash_fns", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, sha1(c_name) AS s1, lower(hex(c_custkey)) AS h, base64(encode(c_name, 'UTF-8')) AS b, decode(unbase64(base64(encode(c_name, 'UTF-8'))), 'UTF-8') AS d, lower(hex(encode(c_mktsegment, 'UTF-8'))) AS hx FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS s1, lower(hex(c_custkey)) AS h, base64(encode(c_name)) AS b, decode(from_base64(base64(encode(c_name)))) AS d, lower(hex(c_mktsegment)) AS hx FROM customer")
both("math_fns", "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, CAST(ceil(l_tax * 100) AS BIGINT) AS ce, CAST(floor(l_extendedprice) AS BIGINT) AS fl, round(sqrt(l_quantity), 6) AS sq, round(ln(l_quantity), 6) AS l_n, round(power(l_discount, 2), 6) AS pw, round(exp(l_tax), 6) AS ex, l_partkey % 7 AS md, round(sin(l_quantity), 6) AS si, round(atan2(l_quantity, 2), 6) AS at2, round(log10(l_quantity), 6) AS lg, CAST(sign(l_discount - 0.05) AS BIGINT) AS sg, round(cbrt(l_quantity), 6) AS cb, round(degrees(l_tax), 6) AS dg FROM lineitem")
both("date_fns", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS mon, CAST(CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS STRING) AS nxt, CAST(last_day(o_orderdate) AS STRING) AS ld, CAST(make_date(2020, 2, 29) AS STRING) AS md FROM orders")
both("array_fns", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, round(CAST(element_at(embedding, 1) AS DOUBLE), 5) AS first, round(CAST(array_max(embedding) AS DOUBLE), 5) AS hi, round(CAST(array_min(embedding) AS DOUBLE), 5) AS lo, array_contains(array(1, 2, 3), label) AS small, CAST(size(slice(embedding, 2, 3)) AS BIGINT) AS part, array_join(array_distinct(array('a', 'b', 'a')), '') AS dis, array_position(array(5, 6), 6) AS pos FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(list_max(embedding) AS DOUBLE), 5) AS hi, round(CAST(list_min(embedding) AS DOUBLE), 5) AS lo, list_contains([1, 2, 3], label) AS small, len(embedding[2:4]) AS part, 'ab' AS dis, CAST(list_position([5, 6], 6) AS BIGINT) AS pos FROM embeddings")
both("unnest", "SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
both("map_struct_fns", "SELECT n_nationkey, element_at(map(n_name, n_regionkey, 'k', n_nationkey), 'k') AS v, named_struct('a', n_regionkey, 'b', n_name).b AS b, CAST(size(map_keys(map(n_name, 1, 'y', 2))) AS BIGINT) AS n, array_join(array_sort(map_keys(map_concat(map(n_name, 1), map('z', 2)))), '-') AS ks, map_contains_key(map(n_name, 1), 'FRANCE') AS has FROM nation", "SELECT n_nationkey, map([n_name, 'k'], [n_regionkey, n_nationkey])['k'] AS v, struct_pack(a := n_regionkey, b := n_name).b AS b, CAST(len(map_keys(map([n_name, 'y'], [1, 2]))) AS BIGINT) AS n, array_to_string(list_sort(map_keys(map_concat(map([n_name], [1]), map(['z'], [2])))), '-') AS ks, list_contains(map_keys(map([n_name], [1])), 'FRANCE') AS has FROM nation")
both("json_fns", "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(length(props) AS BIGINT) AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(length(props) AS BIGINT) AS n FROM events")
both("try_cast_typeof", "SELECT n_nationkey, try_cast(n_name AS INT) AS bad, try_cast(CAST(n_nationkey AS STRING) AS BIGINT) AS good FROM nation")
both("sequence", "SELECT explode(sequence(1, 20, 3)) AS n", "SELECT CAST(n AS INTEGER) AS n FROM range(1, 21, 3) r(n)")
both("session_windows", "SELECT user_id, CAST(session_window.start AS STRING) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(min(ts)) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(min(ts)) % 1000000 AS VARCHAR), 6, '0'), '0') END AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, sess")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: runner(sql) for name, sql in SPARK.items()}


def gcd_lcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", compat.gcd(F.col("p_partkey"), F.col("p_size")).alias("gcd"), compat.lcm(F.col("p_partkey"), F.col("p_size")).alias("lcm"))


def date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(compat.date_bin(5400, F.col("ts"), "1970-01-01 00:10:00").cast("string").alias("bin")).agg(F.count("*").alias("n"))


def trunc_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", compat.trunc_number(F.col("c_acctbal")).alias("whole"))


def rank_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement of this name, whose three partitions would be three tasks."""
    out = ranks.ranked(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_totalprice", "o_orderkey"], "o_orderpriority", ["o_orderkey"])
    return out.select("o_orderkey", "rn", "r", "dr", F.round("pr", 6).alias("pr"), F.round("cd", 6).alias("cd"), "nt")


def range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement of this name over stretches of 65,536 keys, not whole nations; a row within 50 keys of an end also counts in the next stretch."""
    key, own = F.col("c_custkey"), F.shiftright("c_custkey", 16)
    place = key.bitwiseAND(65535)
    among = F.when(place < 50, F.array(own, own - 1)).when(place >= 65536 - 50, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy("c_nationkey", "stretch").orderBy("c_custkey").rangeBetween(-50, 50)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.explode(among).alias("stretch"))
    return rows.withColumn("near", F.count("*").over(w)).filter(F.col("stretch").eqNullSafe(own)).select("c_custkey", "near")


def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement of this name by the number of rows of each group. Nulls come last, as DuckDB sorts."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    w = Window.partitionBy("n").orderBy(F.col("g").asc_nulls_last()).rowsBetween(-1, 1)
    groups = rows.groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("g")).count().select("n", "g", F.sum("count").over(w).alias("near"))
    return rows.join(groups, F.col("c_nationkey").eqNullSafe(F.col("n")) & F.col("c_mktsegment").eqNullSafe(F.col("g"))).select("c_custkey", "near")


QUERIES |= {"gcd_lcm": gcd_lcm, "date_bin": date_bin, "trunc_number": trunc_number, "rank_family": rank_family, "range_frame": range_frame, "groups_frame": groups_frame} | engine_queries.QUERIES
DUCK |= {
    "gcd_lcm": "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS gcd, CAST(lcm(p_partkey, p_size) AS BIGINT) AS lcm FROM part",
    "date_bin": "SELECT strftime(time_bucket(INTERVAL '90 minutes', ts, TIMESTAMP '1970-01-01 00:10:00'), '%Y-%m-%d %H:%M:%S') AS bin, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
    "trunc_number": "SELECT c_custkey, trunc(c_acctbal) AS whole FROM customer",
} | engine_queries.DUCK
