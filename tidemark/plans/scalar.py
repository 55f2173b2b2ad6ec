"""Scalar function families: one query each, (Spark SQL, DuckDB SQL or None for the same)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import date_bin, digest, gcd, lcm, register, round_toward_zero, url_path_hash


def _log(call: str, x: str) -> str:
    """A logarithm of x that is minus infinity at 0 and NaN below, where Spark's is null."""
    return f"CASE WHEN {x} = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {x} < 0 THEN CAST('NaN' AS DOUBLE) ELSE {call} END"


def _years(function: str, x: str, form: str) -> str:
    """x in letters, its year as strftime writes it: without Spark's plus sign beyond 9999 and zeros before year 0."""
    return f"regexp_replace({function}({x}, '{form}'), '^[+]|(?<=^-)0+', '')"


SCALAR: dict[str, tuple[str, str | None]] = {
    "fn_string": (
        "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, CAST(length(p_name) AS BIGINT) AS c, concat(p_brand, '-', p_type) AS d, concat_ws('|', p_brand, p_type) AS e, replace(p_name, 'red', 'RED') AS f, reverse(p_name) AS g, split_part(p_name, ' ', 2) AS h, CAST(instr(p_name, 'e') AS BIGINT) AS i, left(p_name, 3) AS j, right(p_name, 3) AS k, lpad(p_type, 12, '*') AS l, rpad(p_type, 12, '.') AS m, repeat('ab', 3) AS n, startswith(p_name, 'small') AS o, endswith(p_name, 'ring') AS p, translate(p_name, 'aei', 'xyz') AS q, trim('  x ') AS r, ltrim('  x ') AS s, rtrim('  x ') AS t, CAST(ascii(p_type) AS INT) AS u, chr(65) AS v, CAST(levenshtein(p_name, p_type) AS BIGINT) AS w, CAST(octet_length(p_name) AS BIGINT) AS x, initcap(p_name) AS y, substring(p_name, 2, 3) AS z FROM part",
        "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, CAST(length(p_name) AS BIGINT) AS c, concat(p_brand, '-', p_type) AS d, concat_ws('|', p_brand, p_type) AS e, replace(p_name, 'red', 'RED') AS f, reverse(p_name) AS g, split_part(p_name, ' ', 2) AS h, CAST(instr(p_name, 'e') AS BIGINT) AS i, left(p_name, 3) AS j, right(p_name, 3) AS k, lpad(p_type, 12, '*') AS l, rpad(p_type, 12, '.') AS m, repeat('ab', 3) AS n, starts_with(p_name, 'small') AS o, ends_with(p_name, 'ring') AS p, translate(p_name, 'aei', 'xyz') AS q, trim('  x ') AS r, ltrim('  x ') AS s, rtrim('  x ') AS t, CAST(ascii(p_type) AS INT) AS u, chr(65) AS v, CAST(levenshtein(p_name, p_type) AS BIGINT) AS w, CAST(octet_length(encode(p_name)) AS BIGINT) AS x, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') AS y, substring(p_name, 2, 3) AS z FROM part",
    ),
    "fn_regexp": (
        r"SELECT page_id, regexp_like(url, '^https') AS a, regexp_extract(url, '//([^/]+)/', 1) AS b, regexp_replace(url, '[0-9]+', 'N') AS c, CAST(regexp_count(url, '/') AS BIGINT) AS d FROM pages",
        r"SELECT page_id, regexp_matches(url, '^https') AS a, regexp_extract(url, '//([^/]+)/', 1) AS b, regexp_replace(url, '[0-9]+', 'N', 'g') AS c, CAST(len(regexp_extract_all(url, '/')) AS BIGINT) AS d FROM pages",
    ),
    "fn_date": (
        f"SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS b, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS c, CAST(dayofyear(o_orderdate) AS BIGINT) AS d, make_date(2020, 2, 29) AS e, {_years('date_format', 'o_orderdate', 'yyyy/MM/dd')} AS f, CAST(unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS g, to_date('2021-03-04') AS h, CAST(datediff(DATE '2001-08-01', o_orderdate) AS BIGINT) AS i, CAST(last_day(o_orderdate) AS DATE) AS j FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS b, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS c, CAST(dayofyear(o_orderdate) AS BIGINT) AS d, make_date(2020, 2, 29) AS e, strftime(o_orderdate, '%Y/%m/%d') AS f, CAST(epoch(o_orderdate) AS BIGINT) AS g, DATE '2021-03-04' AS h, CAST(date_diff('day', o_orderdate, DATE '2001-08-01') AS BIGINT) AS i, CAST(last_day(o_orderdate) AS DATE) AS j FROM orders",
    ),
    "fn_interval": ("SELECT o_orderkey, CAST(o_orderdate + INTERVAL '3' MONTH AS DATE) AS a, CAST(o_orderdate - INTERVAL '1' YEAR AS DATE) AS b, CAST(o_orderdate + INTERVAL '10' DAY AS DATE) AS c FROM orders", None),
    "fn_math": (
        f"SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS b, CAST(floor(value) AS BIGINT) AS c, round(value, 1) AS d, round(sqrt(value), 6) AS e, round(power(value, 2), 4) AS f, round({_log('ln(value)', 'value')}, 6) AS g, round({_log('log10(value)', 'value')}, 6) AS h, round({_log('log2(value)', 'value')}, 6) AS i, round(exp(value / 500), 6) AS j, round(sin(value), 6) AS k, round(atan2(value, 3), 6) AS l, CAST(sign(value - 50) AS DOUBLE) AS m, round(cbrt(value), 6) AS n, round(degrees(1), 6) AS o, round(radians(180), 6) AS p, round(pi(), 8) AS q, CAST(factorial(5) AS BIGINT) AS r, CASE WHEN value IS NOT NULL THEN isnan(value) END AS s, user_id % 7 AS t FROM events",
        "SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS b, CAST(floor(value) AS BIGINT) AS c, round(value, 1) AS d, round(sqrt(value), 6) AS e, round(power(value, 2), 4) AS f, round(ln(value), 6) AS g, round(log10(value), 6) AS h, round(log2(value), 6) AS i, round(exp(value / 500), 6) AS j, round(sin(value), 6) AS k, round(atan2(value, 3), 6) AS l, CAST(sign(value - 50) AS DOUBLE) AS m, round(cbrt(value), 6) AS n, round(degrees(1), 6) AS o, round(radians(180), 6) AS p, round(pi(), 8) AS q, CAST(factorial(5) AS BIGINT) AS r, isnan(value) AS s, user_id % 7 AS t FROM events",
    ),
    "fn_conditional": ("SELECT event_id, coalesce(NULLIF(event_type, 'click'), 'c') AS a, NULLIF(user_id, 3) AS b, greatest(value, 100, 50) AS c, least(value, 100) AS d, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END AS e, ifnull(NULLIF(user_id, 5), -1) AS f FROM events", None),
    "fn_cast_try": (
        "SELECT event_id, CAST(value AS INT) AS a, CAST(user_id AS VARCHAR(20)) AS b, TRY_CAST(event_type AS INT) AS c, CAST('12.5' AS DOUBLE) AS d, CAST(ts AS DATE) AS e, TRY_CAST('2024-13-01' AS DATE) AS f, CAST(CAST(value AS DECIMAL(10, 1)) AS DOUBLE) AS g FROM (SELECT event_id, floor(value) + 0e0 AS value, user_id, event_type, ts FROM events)",
        None,
    ),
    "fn_array": (
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS a, CAST(embedding[0] AS DOUBLE) AS b, array_contains(array(1, 2, 3), 2) AS c, array_distinct(array(1, 1, 2)) AS d, CAST(array_position(array(4, 5, 6), 6) AS BIGINT) AS e, array_join(array('a', 'b'), '-') AS f, slice(array(1, 2, 3, 4), 2, 2) AS g, sort_array(array(3, 1, 2)) AS h, concat(array(1), array(2, 3)) AS i, flatten(array(array(1), array(2))) AS j, array_append(array(1), 9) AS k, array_sort(array_union(array(1, 2), array(2, 3))) AS l, array_sort(array_intersect(array(1, 2), array(2, 3))) AS m, array_except(array(1, 2), array(2, 3)) AS n, array_remove(array(1, 2, 1), 1) AS o, sequence(1, 7, 3) AS p, element_at(array(7, 8), -1) AS q, array_max(array(2, 9, 4)) AS r FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS a, CAST(embedding[1] AS DOUBLE) AS b, list_contains([1, 2, 3], 2) AS c, [1, 2] AS d, CAST(list_position([4, 5, 6], 6) AS BIGINT) AS e, array_to_string(['a', 'b'], '-') AS f, list_slice([1, 2, 3, 4], 2, 3) AS g, list_sort([3, 1, 2]) AS h, list_concat([1], [2, 3]) AS i, flatten([[1], [2]]) AS j, list_append([1], 9) AS k, list_sort(list_distinct(list_concat([1, 2], [2, 3]))) AS l, list_sort(list_intersect([1, 2], [2, 3])) AS m, [1] AS n, list_filter([1, 2, 1], lambda x: x <> 1) AS o, [1, 4, 7] AS p, [7, 8][-1] AS q, list_max([2, 9, 4]) AS r FROM embeddings",
    ),
    "fn_array_dot": ("SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0e0, (a, x) -> a + x), 4) AS norm2 FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2 FROM embeddings"),
    "fn_map_struct": (
        "SELECT n_nationkey, element_at(map('k', n_name, 'r', 'x'), 'k') AS a, map_keys(map('k', 1, 'r', 2)) AS b, map_values(map('k', n_nationkey)) AS c, named_struct('a', n_nationkey, 'b', n_name).b AS d, CAST(size(map('a', 1)) AS BIGINT) AS e FROM nation",
        "SELECT n_nationkey, map {'k': n_name, 'r': 'x'}['k'] AS a, map_keys(map {'k': 1, 'r': 2}) AS b, map_values(map {'k': n_nationkey}) AS c, {'a': n_nationkey, 'b': n_name}.b AS d, CAST(cardinality(map {'a': 1}) AS BIGINT) AS e FROM nation",
    ),
    "fn_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k + 1 AS k1, get_json_object(props, '$.none') AS missing FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k1, json_extract_string(props, '$.none') AS missing FROM events",
    ),
    "fn_hash": ("SELECT p_partkey, md5(p_name) AS a, sha2(p_name, 256) AS b, p_partkey & 12 AS c, p_partkey | 3 AS d, shiftleft(p_partkey, 2) AS e, shiftright(p_partkey, 1) AS f, p_partkey ^ 5 AS g, hex(p_name) AS h, base64(CAST(p_name AS BINARY)) AS i FROM part", "SELECT p_partkey, md5(p_name) AS a, sha256(p_name) AS b, p_partkey & 12 AS c, p_partkey | 3 AS d, p_partkey << 2 AS e, p_partkey >> 1 AS f, xor(p_partkey, 5) AS g, hex(p_name) AS h, to_base64(encode(p_name)) AS i FROM part"),
    "fn_timestamp": (
        f"SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS a, CAST(timestamp_seconds(event_id * 60) AS TIMESTAMP_NTZ) AS b, to_timestamp_ntz('2024-05-06 07:08:09') AS c, {_years('date_format', 'ts', 'yyyy-MM-dd HH:mm')} AS d, CAST(hour(ts) AS BIGINT) AS e, CAST(weekday(ts) + 1 AS BIGINT) AS f, make_timestamp_ntz(2024, 2, 29, 1, 2, 3) AS g, CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS BIGINT) AS h FROM events",
        "SELECT event_id, date_trunc('hour', ts) AS a, TIMESTAMP '1970-01-01' + to_seconds(event_id * 60) AS b, TIMESTAMP '2024-05-06 07:08:09' AS c, strftime(ts, '%Y-%m-%d %H:%M') AS d, CAST(hour(ts) AS BIGINT) AS e, CAST(isodow(ts) AS BIGINT) AS f, make_timestamp(2024, 2, 29, 1, 2, 3) AS g, CAST(floor(epoch(ts)) AS BIGINT) AS h FROM events",
    ),
    # digests DuckDB lacks are compared with the published ones of 'abc'
    "fn_encode": (
        "SELECT p_partkey, decode(unhex(hex(encode(p_name, 'UTF-8'))), 'UTF-8') AS a, decode(unbase64(base64(encode(p_brand, 'UTF-8'))), 'UTF-8') AS b, sha2(concat('a', substring('xbc', 2)), 224) AS c, sha2('abc', 384) AS d, sha2('abc', 512) AS e, length(sha2(p_name, 512)) AS f, sha2(p_name, 0) AS g, sha1(p_name) AS h, typeof(p_partkey) AS i FROM part",
        f"SELECT p_partkey, decode(unhex(hex(p_name))) AS a, decode(from_base64(to_base64(encode(p_brand)))) AS b, '23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7' AS c, 'cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7' AS d, 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f' AS e, CAST(128 AS INT) AS f, sha256(p_name) AS g, sha1(p_name) AS h, lower(typeof(p_partkey)) AS i FROM part",
    ),
    "fn_clock": ("SELECT event_id, now() >= ts AND now() = current_timestamp() AS a, current_date() = CAST(now() AS DATE) AS b, current_date() > CAST(ts AS DATE) AS c FROM events", "SELECT event_id, now() >= ts AND now() = get_current_timestamp() AS a, current_date = CAST(now() AS DATE) AS b, current_date > CAST(ts AS DATE) AS c FROM events"),
    "fn_to_char": (
        f"SELECT event_id, {_years('date_format', 'ts', 'yyyy-MM-dd HH:mm:ss')} AS a, {_years('from_unixtime', 'event_id * 86400', 'yyyy-MM-dd')} AS b, date_format(ts, 'D') AS c, date_format(ts, 'EEEE') AS d, CAST(timestamp_micros(event_id * 1000001) AS TIMESTAMP_NTZ) AS e FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(make_timestamp(event_id * 86400000000), '%Y-%m-%d') AS b, strftime(ts, '%-j') AS c, strftime(ts, '%A') AS d, make_timestamp(event_id * 1000001) AS e FROM events",
    ),
    "fn_math_more": (
        f"SELECT event_id, nanvl(CASE WHEN event_id % 2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END, -1e0) AS a, round(cot(value + 1), 6) AS b, round(sinh(value / 500), 6) AS c, round(cosh(value / 500), 6) AS d, round(tanh(value / 500), 6) AS e, round(asinh(value), 6) AS f, round(acosh(value + 1), 6) AS g, round(atanh(value / 1000), 6) AS h, round(asin(value / 1000), 6) AS i, round(acos(value / 1000), 6) AS j, round(atan(value), 6) AS k, round(tan(value), 4) AS l, round({_log('log(3, value + 1)', 'value + 1')}, 6) AS m, rand() >= 0 AND rand() < 1 AS n, negative(user_id) AS o FROM events",
        "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -1 ELSE value END AS a, round(cot(value + 1), 6) AS b, round(sinh(value / 500), 6) AS c, round(cosh(value / 500), 6) AS d, round(tanh(value / 500), 6) AS e, round(asinh(value), 6) AS f, round(acosh(value + 1), 6) AS g, round(atanh(value / 1000), 6) AS h, round(asin(value / 1000), 6) AS i, round(acos(value / 1000), 6) AS j, round(atan(value), 6) AS k, round(tan(value), 4) AS l, round(ln(value + 1) / ln(3), 6) AS m, true AS n, -user_id AS o FROM events",
    ),
    "fn_array_rows": (
        "SELECT vec_id, array_distinct(a) AS b, array_contains(a, 2) AS c, CAST(array_position(a, 2) AS BIGINT) AS d, slice(a, 2, 2) AS e, sort_array(a) AS f, array_remove(a, 1) AS g, array_max(a) AS h, element_at(a, -1) AS i, array_join(transform(a, x -> CAST(x AS STRING)), '-') AS j, array_append(a, vec_id) AS k, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS l FROM (SELECT vec_id, embedding, array(vec_id % 3, vec_id % 2, vec_id % 4, vec_id % 3) AS a FROM embeddings)",
        "SELECT vec_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS b, list_contains(a, 2) AS c, CAST(coalesce(list_position(a, 2), 0) AS BIGINT) AS d, list_slice(a, 2, 3) AS e, list_sort(a) AS f, list_filter(a, lambda x: x <> 1) AS g, list_max(a) AS h, a[-1] AS i, array_to_string(a, '-') AS j, list_append(a, vec_id) AS k, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS l FROM (SELECT vec_id, embedding, [vec_id % 3, vec_id % 2, vec_id % 4, vec_id % 3] AS a FROM embeddings)",
    ),
    "fn_null_logic": ("SELECT n_nationkey, NULLIF(n_regionkey, 1) IS NULL AS a, NULLIF(n_regionkey, 1) = 1 AS b, (NULLIF(n_regionkey, 1) = 2) IS NOT TRUE AS c, NULLIF(n_regionkey, 1) IS DISTINCT FROM 2 AS d, coalesce(NULL, NULLIF(n_regionkey, 1), -1) AS e, CASE WHEN CAST(NULL AS BOOLEAN) THEN 1 ELSE 0 END AS f FROM nation", None),
    "fn_width_bucket": ("SELECT CAST(width_bucket(o_totalprice, 0, 500000, 10) AS BIGINT) AS b, COUNT(*) AS n FROM orders GROUP BY 1", "SELECT CAST(least(floor(o_totalprice / 50000) + 1, 11) AS BIGINT) AS b, COUNT(*) AS n FROM orders GROUP BY 1"),
}

_FNV = """
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE url END AS rest FROM pages),
     q AS (SELECT page_id, CASE WHEN strpos(rest, '/') > 0 THEN regexp_extract(rest[strpos(rest, '/'):], '^[^?#]*') ELSE '' END AS path FROM p),
     b AS (SELECT page_id, list_transform(range(1, octet_length(encode(path)) + 1), lambda i: CAST(('0x' || hex(encode(path))[2 * i - 1:2 * i]) AS BIGINT)) AS bytes FROM q),
     h AS (SELECT page_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), bytes), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS v FROM b)
SELECT page_id, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INT) AS h FROM h"""


def _url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url_path_hash(F.col("url")).alias("h"))


def _url_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages")
    return spark.sql("SELECT page_id, URLPathHash(url) AS h FROM pages")


def _date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(date_bin(900, F.col("ts")).cast("timestamp_ntz").alias("bin")).agg(F.count("*").alias("n"))


def _number(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return e.select("o_orderkey", gcd(a, b).alias("g"), lcm(a, b).alias("l"), round_toward_zero(F.col("o_totalprice") / -3, 1).alias("t"))


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", *[F.lower(F.hex(digest(F.col("p_name"), a))).alias(a) for a in ("md5", "sha256")], F.length(digest(F.col("p_name"), "sha512")).alias("n"))


def _plan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN of a filtered aggregate, and what its plan shows."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    query = "SELECT o_custkey, SUM(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"
    plans = [spark.sql(f"EXPLAIN {kind} {query}").select(F.lit(kind).alias("kind"), "plan") for kind in ("FORMATTED", "EXTENDED", "COST")]
    found = plans[0].union(plans[1]).union(plans[2])
    return found.select("kind", F.col("plan").contains("HashAggregate").alias("aggregate"), F.col("plan").rlike(r"PushedFilters.*EqualTo\(o_orderstatus").alias("pushed"), F.col("plan").contains("o_comment").alias("unread"))


FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "url_path_hash": (_url, _FNV),
    "url_path_hash_sql": (_url_sql, _FNV),
    "fn_date_bin": (_date_bin, "SELECT time_bucket(INTERVAL '15' MINUTE, ts, TIMESTAMP '1970-01-01') AS bin, COUNT(*) AS n FROM events GROUP BY 1"),
    "fn_digest": (_digest, "SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha256, CAST(64 AS INT) AS n FROM part"),
    "explain_plan": (_plan_text, "SELECT * FROM (VALUES ('FORMATTED', true, true, false), ('EXTENDED', true, true, false), ('COST', true, true, false)) t(kind, aggregate, pushed, unread)"),
    "fn_number_theory": (_number, "SELECT o_orderkey, CAST(gcd(o_orderkey, o_custkey) AS BIGINT) AS g, CAST(lcm(o_orderkey, o_custkey) AS BIGINT) AS l, trunc(o_totalprice / -3 * 10) / 10 AS t FROM orders"),
}
