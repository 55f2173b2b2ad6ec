"""The 22 TPC-H questions over the driver's tables.

The tables lack partsupp and some columns; ``DERIVED`` makes those from keys, by
arithmetic that Spark and DuckDB share.  Money is summed as DECIMAL, so results
don't depend on the order of rows.
"""

from __future__ import annotations


def money(x: str) -> str:
    """An exact sum of x, which has at most six decimals."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(20, 6))) AS DOUBLE)"


REVENUE = money("l_extendedprice * (1 - l_discount)")

#: Common table expressions by name; a query names those it needs.
DERIVED = {
    "partsupp": """partsupp AS (
    SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST((l_partkey * 7 + l_suppkey * 13) % 9999 + 1 AS BIGINT) AS ps_availqty,
           CAST((l_partkey * 31 + l_suppkey * 17) % 100000 AS DOUBLE) / 1e2 AS ps_supplycost
    FROM lineitem GROUP BY l_partkey, l_suppkey)""",
    "li": """li AS (
    SELECT *, CAST(l_shipdate AS DATE) AS shipdate, CAST((l_orderkey * 3 + l_linenumber) % 21 - 10 AS INT) AS commit_after, CAST((l_orderkey + l_linenumber * 5) % 15 + 1 AS INT) AS receipt_after,
           CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'AIR' WHEN 1 THEN 'MAIL' WHEN 2 THEN 'SHIP' WHEN 3 THEN 'RAIL' WHEN 4 THEN 'TRUCK' WHEN 5 THEN 'FOB' ELSE 'REG AIR' END AS l_shipmode
    FROM lineitem)""",
}


def _q(body: str, *derived: str) -> str:
    if not derived:
        return body
    with_ = ",\n".join(DERIVED[d] for d in derived)
    body = body.strip()
    return f"WITH {with_}{',' + body[4:] if body.startswith('WITH') else body and chr(10) + body}"


TPCH: dict[str, str] = {
    "tpch_q01": _q(f"""
SELECT l_returnflag, l_linestatus, {money("l_quantity")} AS sum_qty, {money("l_extendedprice")} AS sum_base_price, {REVENUE} AS sum_disc_price,
       {money("l_extendedprice * (1 - l_discount) * (1 + l_tax)")} AS sum_charge, ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price,
       ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '2001-08-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""),
    "tpch_q02": _q("""
WITH offers AS (
    SELECT p_partkey, p_brand, s_acctbal, s_name, n_name, ps_supplycost FROM part JOIN partsupp ON ps_partkey = p_partkey JOIN supplier ON s_suppkey = ps_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' AND p_size = 15 AND p_type LIKE '%ARD')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM offers o
WHERE ps_supplycost = (SELECT MIN(i.ps_supplycost) FROM offers i WHERE i.p_partkey = o.p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""", "partsupp"),
    "tpch_q03": _q(f"""
SELECT l_orderkey, {REVENUE} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""),
    "tpch_q04": _q("""
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-07-01' + INTERVAL '3' MONTH
  AND EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey AND commit_after < receipt_after)
GROUP BY o_orderpriority ORDER BY o_orderpriority""", "li"),
    "tpch_q05": _q(f"""
SELECT n_name, {REVENUE} AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey
WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name ORDER BY revenue DESC"""),
    "tpch_q06": _q(f"""
SELECT {money("l_extendedprice * l_discount")} AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.049 AND 0.071 AND l_quantity < 24"""),
    "tpch_q07": _q(f"""
SELECT supp_nation, cust_nation, l_year, {money("volume")} AS revenue FROM (
    SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
    WHERE ((a.n_name = 'NATION_6' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_6'))
      AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year"""),
    "tpch_q08": _q("""
SELECT o_year, CAST(SUM(CASE WHEN nation = 'NATION_6' THEN volume ELSE 0 END) AS DOUBLE) / CAST(SUM(volume) AS DOUBLE) AS mkt_share FROM (
    SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20, 6)) AS volume, s.n_name AS nation
    FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN region ON r_regionkey = c.n_regionkey JOIN nation s ON s.n_nationkey = s_nationkey
    WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') v
GROUP BY o_year ORDER BY o_year"""),
    "tpch_q09": _q(f"""
SELECT nation, o_year, {money("amount")} AS sum_profit FROM (
    SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
    FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey
    JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey WHERE p_name LIKE '%red%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""", "partsupp"),
    "tpch_q10": _q(f"""
SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1996-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""),
    "tpch_q11": _q("""
WITH held AS (
    SELECT ps_partkey, CAST(SUM(CAST(ps_supplycost * ps_availqty AS DECIMAL(20, 2))) AS DOUBLE) AS value
    FROM partsupp JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_7' GROUP BY ps_partkey)
SELECT ps_partkey, value FROM held WHERE value > (SELECT SUM(CAST(value AS DECIMAL(20, 2))) * 0.001 FROM held) ORDER BY value DESC, ps_partkey""", "partsupp"),
    "tpch_q12": _q("""
SELECT l_shipmode, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(SUM(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN li ON l_orderkey = o_orderkey
WHERE l_shipmode IN ('MAIL', 'SHIP') AND commit_after < receipt_after AND commit_after > 0 AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY l_shipmode ORDER BY l_shipmode""", "li"),
    "tpch_q13": _q("""
SELECT c_count, COUNT(*) AS custdist FROM (
    SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority NOT LIKE '1-%' GROUP BY c_custkey) c
GROUP BY c_count ORDER BY custdist DESC, c_count DESC"""),
    "tpch_q14": _q("""
SELECT 100 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20, 6)) ELSE 0 END) AS DOUBLE)
       / CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20, 6))) AS DOUBLE) AS promo_revenue
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'"""),
    "tpch_q15": _q(f"""
WITH revenue AS (
    SELECT l_suppkey AS supplier_no, {REVENUE} AS total_revenue FROM lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '3' MONTH GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON supplier_no = s_suppkey WHERE total_revenue = (SELECT MAX(total_revenue) FROM revenue) ORDER BY s_suppkey"""),
    "tpch_q16": _q("""
SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""", "partsupp"),
    "tpch_q17": _q("""
SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) / 7.0e0 AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * AVG(x.l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)"""),
    "tpch_q18": _q(f"""
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, {money("l_quantity")} AS sum_qty
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 230)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100"""),
    "tpch_q19": _q(f"""
SELECT {REVENUE} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#14' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)"""),
    "tpch_q20": _q("""
SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE n_regionkey = 2 AND s_suppkey IN (
    SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
      AND ps_availqty > (SELECT 0.5 * SUM(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR))
ORDER BY s_name, s_suppkey""", "partsupp"),
    "tpch_q21": _q("""
SELECT s_name, COUNT(*) AS numwait FROM supplier JOIN li a ON a.l_suppkey = s_suppkey JOIN orders ON o_orderkey = a.l_orderkey JOIN nation ON n_nationkey = s_nationkey
WHERE o_orderstatus = 'F' AND a.receipt_after > a.commit_after AND n_regionkey = 1
  AND EXISTS (SELECT 1 FROM li b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM li c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.receipt_after > c.commit_after)
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""", "li"),
    "tpch_q22": _q("""
WITH cust AS (SELECT c_custkey, c_acctbal, SUBSTRING(CAST(c_nationkey + 10 AS VARCHAR(20)) FROM 1 FOR 2) AS cntrycode FROM customer)
SELECT cntrycode, COUNT(*) AS numcust, CAST(SUM(CAST(c_acctbal AS DECIMAL(20, 2))) AS DOUBLE) AS totacctbal FROM cust
WHERE cntrycode IN ('13', '31', '23', '29', '30', '18', '17')
  AND c_acctbal > (SELECT AVG(c_acctbal) FROM cust WHERE c_acctbal > 0 AND cntrycode IN ('13', '31', '23', '29', '30', '18', '17'))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
GROUP BY cntrycode ORDER BY cntrycode"""),
}
