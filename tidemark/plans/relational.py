"""Scan, join, subquery, aggregate, window, sort and set queries.

Each is (Spark SQL, DuckDB SQL); None as the second means that the first serves
both.
"""

from __future__ import annotations

from .tpch import money

REGION_OF = "CASE user_id % 6 WHEN 0 THEN 'us-east' WHEN 1 THEN 'us-west' WHEN 2 THEN 'eu-west' WHEN 3 THEN 'eu-central' WHEN 4 THEN 'ap-south' ELSE 'ap-east' END"
REGIONS = f"WITH ev AS (SELECT *, {REGION_OF} AS region FROM events)"

SCAN = {
    "select_literal": ("SELECT 1 AS ok, 'x' AS s", None),
    "point_lookup": ("SELECT l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem WHERE l_orderkey = 4 ORDER BY l_linenumber, l_partkey LIMIT 5", None),
    "select_star": ("SELECT * FROM nation", None),
    "arithmetic": ("SELECT o_orderkey, o_totalprice * 2 + 1 - o_totalprice / 4 AS x, -o_orderkey AS neg FROM orders", None),
    "comparisons": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity <> 5 AND l_discount >= 0.02 AND l_tax <= 0.06 AND l_partkey > l_suppkey", None),
    "boolean_nesting": ("SELECT COUNT(*) AS n FROM part WHERE (p_size < 10 OR (p_brand = 'Brand#3' AND NOT p_type = 'PROMO')) AND p_retailprice > 905", None),
    "date_window_count": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-02-01'", None),
    "in_list": ("SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size IN (1, 7, 49) AND p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY p_brand", None),
    "like_patterns": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_name LIKE '%ring' OR p_name LIKE '%ed w%'", None),
    "not_like": ("SELECT COUNT(*) AS n FROM part WHERE p_name NOT LIKE '%red%widget%'", None),
    "between_num_date": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_shipdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", None),
    "case_when": ("SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done, COUNT(*) AS n FROM orders GROUP BY 1, 2", None),
    "dotted_identifier": ("SELECT `customer.id`, COUNT(*) AS n FROM (SELECT user_id AS `customer.id` FROM events) GROUP BY `customer.id`", 'SELECT "customer.id", COUNT(*) AS n FROM (SELECT user_id AS "customer.id" FROM events) GROUP BY "customer.id"'),
    "implicit_date_coercion": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01'", None),
    "values_relation": ("SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)", None),
    "generate_series": ("SELECT CAST(id AS BIGINT) AS v FROM range(1, 20, 3)", "SELECT CAST(range AS BIGINT) AS v FROM range(1, 20, 3)"),
    "unnest_array": ("SELECT vec_id, pos, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings)", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
}

JOINS = {
    "join_inner": ("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 300000", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_left_residual": ("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey", None),
    "join_right": ("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal > 9000", None),
    "join_full": ("SELECT a.c_custkey AS l, b.s_suppkey AS r FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey", None),
    "join_cross_small": ("SELECT r.r_name AS a, s.r_name AS b FROM region r CROSS JOIN region s", None),
    "join_theta_range": ("SELECT o_orderkey, band FROM orders JOIN (VALUES ('a', 0, 1000), ('b', 1000, 2500), ('c', 2500, 5000)) AS t(band, lo, hi) ON o_orderkey >= lo AND o_orderkey < hi", None),
    "join_null_safe": ("WITH a AS (SELECT NULLIF(n_regionkey, 2) AS k, n_name FROM nation), b AS (SELECT NULLIF(r_regionkey, 2) AS k, r_name FROM region) SELECT n_name, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k", None),
    "join_using": ("SELECT user_id, a.n AS views, b.n AS clicks FROM (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) a JOIN (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) b USING (user_id)", None),
    "join_natural": ("SELECT l_orderkey, k FROM (SELECT l_orderkey, l_linenumber FROM lineitem) a NATURAL JOIN (SELECT l_orderkey, l_linenumber, l_partkey AS k FROM lineitem) b", None),
    "join_composite": ("SELECT COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.l_orderkey < b.l_orderkey", None),
    "join_semi_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)", None),
    "join_semi_theta": ("SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)", None),
    "join_semi_in": ("SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)", None),
    "join_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", None),
    "join_anti_theta": ("SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_quantity > a.l_quantity)", None),
    "join_not_in_nullaware": ("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 3) FROM region)", None),
    "join_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_asof": (
        "SELECT event_id, last_click FROM (SELECT event_id, event_type, LAST_VALUE(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'purchase' AND last_click IS NOT NULL",
        "SELECT e.event_id, arg_max(p.event_id, (p.ts, p.event_id)) AS last_click FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'click' AND p.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id",
    ),
}

SUBQUERIES = {
    "scalar_uncorrelated": ("SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    "scalar_correlated": ("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "having_scalar": ("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > (SELECT COUNT(*) / 100e0 FROM lineitem)", None),
    "nested_in": ("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 499000))", None),
    "derived_table": ("SELECT d.m, COUNT(*) AS n FROM (SELECT o_custkey, MAX(o_orderpriority) AS m FROM orders GROUP BY o_custkey) d GROUP BY d.m", None),
    "cte_twice": ("WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM t a WHERE a.n = (SELECT MAX(n) FROM t)", None),
    "recursive_cte": ("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", None),
    "lateral_join": ("SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 2) t", None),
}

AGGREGATES = {
    "agg_global": (f"SELECT COUNT(*) AS n, COUNT(NULLIF(l_linestatus, 'F')) AS nn, {money('l_quantity')} AS q, MIN(l_discount) AS lo, MAX(l_discount) AS hi FROM lineitem", None),
    "agg_group": (f"SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, {money('o_totalprice')} AS total, ROUND(AVG(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "agg_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, COUNT(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus", None),
    "select_distinct": ("SELECT DISTINCT p_brand, p_type FROM part", None),
    "agg_filter": ("SELECT event_type, COUNT(*) FILTER (WHERE value > 100) AS big, COUNT(*) AS n FROM events GROUP BY event_type", None),
    "agg_two_level": ("SELECT n, COUNT(*) AS users FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) t GROUP BY n", None),
    "agg_conditional": ("SELECT l_returnflag, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS many, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS share FROM lineitem GROUP BY l_returnflag", None),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15", None),
    "agg_group_by_expr": ("SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, COUNT(*) AS n FROM orders GROUP BY 1, 2", None),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(GROUPING(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "agg_cube": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "agg_grouping_sets": ("SELECT p_brand, p_type, COUNT(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())", None),
    "agg_stats": ("SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(STDDEV_POP(l_quantity), 6) AS sdp, ROUND(VAR_SAMP(l_quantity), 6) AS v, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c, ROUND(COVAR_SAMP(l_quantity, l_discount), 6) AS cs, ROUND(COVAR_POP(l_quantity, l_discount), 6) AS cp FROM lineitem GROUP BY l_returnflag", None),
    "agg_regression": ("SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS s, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 3) AS i, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2, CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem", None),
    "agg_median": ("SELECT l_linestatus, MEDIAN(l_extendedprice) AS m, ROUND(percentile(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, MEDIAN(l_extendedprice) AS m, ROUND(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY l_linestatus"),
    "agg_listagg": ("SELECT r_name, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, sort_array(collect_list(n_nationkey)) AS ks FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name", "SELECT r_name, STRING_AGG(n_name, ',' ORDER BY n_name) AS names, LIST(n_nationkey ORDER BY n_nationkey) AS ks FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"),
    "agg_bool_bit": ("SELECT p_type, bool_and(p_size > 0) AS a, bool_or(p_size = 50) AS o, bit_and(p_partkey) AS ba, bit_or(p_partkey) AS bo, bit_xor(p_partkey) AS bx FROM part GROUP BY p_type", None),
    "agg_first_last": ("SELECT user_id, min_by(event_type, struct(ts, event_id)) AS f, max_by(event_type, struct(ts, event_id)) AS l FROM events GROUP BY user_id", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS f, arg_max(event_type, (ts, event_id)) AS l FROM events GROUP BY user_id"),
    # the estimates lie within their stated errors (three standard errors, and 1 / accuracy in rank, or one row) of the exact values
    "agg_approx_distinct": (
        "WITH a AS (SELECT event_type, approx_count_distinct(user_id, 0.02) AS d, approx_percentile(value, 0.5, 1000) AS m, approx_percentile(value, 0.9, 1000) AS u FROM events GROUP BY event_type) SELECT event_type, COUNT(DISTINCT user_id) AS exact, abs(first(d) - COUNT(DISTINCT user_id)) <= 1 + 0.06 * COUNT(DISTINCT user_id) AS near, count_if(value < m) <= 0.501 * COUNT(*) + 1 AND count_if(value <= m) >= 0.499 * COUNT(*) - 1 AS inside, count_if(value < u) <= 0.901 * COUNT(*) + 1 AND count_if(value <= u) >= 0.899 * COUNT(*) - 1 AS upper FROM events JOIN a USING (event_type) GROUP BY event_type",
        "SELECT event_type, COUNT(DISTINCT user_id) AS exact, true AS near, true AS inside, true AS upper FROM events GROUP BY event_type",
    ),
    "agg_empty_input": ("SELECT COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders WHERE o_orderkey < 0", None),
}

_W = "PARTITION BY user_id ORDER BY ts, event_id"
WINDOWS = {
    "win_ranking": (f"SELECT event_id, ROW_NUMBER() OVER ({_W}) AS rn, RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS dr, NTILE(4) OVER ({_W}) AS nt FROM events", f"SELECT event_id, CAST(ROW_NUMBER() OVER ({_W}) AS INT) AS rn, CAST(RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS INT) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS INT) AS dr, CAST(NTILE(4) OVER ({_W}) AS INT) AS nt FROM events"),
    "win_distribution": ("SELECT o_orderkey, ROUND(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 6) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 6) AS cd FROM orders", None),
    "win_offset": (f"SELECT event_id, LAG(event_type) OVER ({_W}) AS a, LEAD(value, 2, -1e0) OVER ({_W}) AS b FROM events", None),
    "win_value": (f"SELECT event_id, FIRST_VALUE(event_id) OVER ({_W}) AS f, LAST_VALUE(event_id) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(event_id, 3) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM events", None),
    "win_rows_frame": (f"SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(12, 2))) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS s FROM events", None),
    "win_range_interval": ("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events", None),
    "win_groups_rewrite": (
        "SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part)",
        "SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part",
    ),
    "win_running_total": ("SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(14, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS running FROM orders", None),
    "win_qualify_rewrite": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "win_topk_per_group": ("SELECT p_brand, p_partkey, rk FROM (SELECT p_brand, p_partkey, CAST(ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS rk FROM part) t WHERE rk <= 3", None),
    "win_ignore_nulls": ("SELECT event_id, LAST_VALUE(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)", "SELECT event_id, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)"),
}

SORT_SET = {
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "order_nulls": ("SELECT n_nationkey, k, CAST(ROW_NUMBER() OVER (ORDER BY k ASC NULLS LAST, n_nationkey DESC) AS INT) AS place FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) ORDER BY k ASC NULLS LAST, n_nationkey DESC", None),
    "order_default_nulls": ("SELECT n_nationkey, k, CAST(ROW_NUMBER() OVER (ORDER BY k, n_nationkey DESC) AS INT) AS place FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) ORDER BY k, n_nationkey DESC", "SELECT n_nationkey, k, CAST(ROW_NUMBER() OVER (ORDER BY k NULLS FIRST, n_nationkey DESC) AS INT) AS place FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation)"),
    "limit_offset": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20", None),
    "outer_limit": ("SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50) ORDER BY o_orderkey LIMIT 10", None),
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect_q": ("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", None),
    "intersect_all": ("SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT s_nationkey % 5 FROM supplier", None),
    "except_q": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000", None),
    "except_all": ("SELECT s_nationkey % 5 AS k FROM supplier EXCEPT ALL SELECT n_regionkey FROM nation", None),
    "distinct_on_rewrite": ("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn = 1", "SELECT DISTINCT ON (p_brand) p_brand, p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey"),
    "pivot": ("SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (COUNT(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority"),
}

WORKLOADS = {
    "perf_count_all": ("SELECT COUNT(*) AS total_events FROM events", None),
    "perf_count_region": (f"{REGIONS} SELECT region, COUNT(*) AS cnt FROM ev GROUP BY region", None),
    "perf_prune_single": (f"{REGIONS} SELECT COUNT(*) AS cnt, ROUND(AVG(value), 4) AS avg_amount FROM ev WHERE region = 'us-east'", None),
    "perf_prune_multi": (f"{REGIONS} SELECT region, event_type, COUNT(*) AS cnt FROM ev WHERE region IN ('us-east', 'eu-west') GROUP BY region, event_type", None),
    "perf_time_range": (f"{REGIONS} SELECT region, COUNT(*) AS cnt, {money('value')} AS total FROM ev WHERE region = 'us-east' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY region", None),
    "perf_top_customers": (f"{REGIONS} SELECT user_id, COUNT(*) AS order_count, {money('value')} AS total FROM ev WHERE region = 'eu-west' AND event_type = 'purchase' GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20", None),
    "perf_payment": (f"SELECT user_id % 5 AS method, COUNT(*) AS cnt, ROUND(AVG(value), 4) AS mean, {money('value')} AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id % 5", None),
    "perf_full_scan": (f"{REGIONS} SELECT region, event_type, COUNT(*) AS events, ROUND(AVG(value), 4) AS mean, MIN(value) AS lo, MAX(value) AS hi FROM ev GROUP BY region, event_type", None),
    "nation_supplier_join": ("SELECT n_name, COUNT(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name", None),
    "gross_by_flag": (f"SELECT l_returnflag, {money('l_extendedprice')} AS gross FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1995-04-01' GROUP BY l_returnflag", None),
    "sensor_average": ("SELECT user_id, ROUND(AVG(value), 6) AS mean FROM events GROUP BY user_id ORDER BY user_id LIMIT 5", None),
    "field_sums": (f"SELECT {money('l_quantity')} AS q, {money('l_tax')} AS t, {money('l_extendedprice')} AS p FROM lineitem", None),
}

RELATIONAL = {**SCAN, **JOINS, **SUBQUERIES, **AGGREGATES, **WINDOWS, **SORT_SET, **WORKLOADS}
