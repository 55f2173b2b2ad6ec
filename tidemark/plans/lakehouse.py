"""Queries that build tables in a fresh warehouse from the driver's files, and the SQL of what they should return."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintain, scan
from ..sources.catalog import columns_of, resolve
from ..sources.files import append
from ..sources.transforms import Transform, parse, value_of
from .engine import Engine

_homes: dict[str, str] = {}


def warehouse(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share, or (unset, on a local master) a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        app = spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _homes:
            _homes[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        shared = _homes[app]
    return f"{shared.rstrip('/')}/warehouse-{uuid.uuid4().hex[:12]}"


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, warehouse(spark))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, partitions=(), sort=()) -> Engine:
    e = _engine(spark)
    e.create_from("shop.orders", _read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")), partitions, sort)
    return e


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"


def snapshot_append_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    half = e.table("shop.orders").where("o_orderkey < 100")
    append(e.catalog, ("shop", "orders"), half)
    return e.sql("SELECT o_orderkey, COUNT(*) AS n FROM shop.orders GROUP BY o_orderkey")


def partition_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, [Transform("identity", "o_orderstatus")]).table("shop.orders", [("o_orderstatus", "=", "F"), ("o_totalprice", ">", 400000.0)])


def stats_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir, [parse("truncate(2000, o_orderkey)")], [("o_orderkey", False)])
    return e.table("shop.orders", [("o_orderkey", ">=", 900), ("o_orderkey", "<", 1100)])


def position_delete_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    scan.delete_where(e.catalog, ("shop", "orders"), [("o_orderstatus", "=", "P")])
    scan.delete_where(e.catalog, ("shop", "orders"), [("o_orderkey", "<", 50)])
    return e.table("shop.orders")


def empty_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.sql("CREATE TABLE a.b (x INT NOT NULL, y VARCHAR(5))")
    return e.sql("SELECT COUNT(*) AS n, MAX(x) AS m FROM a.b")


def time_travel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    first = e.catalog.load(("shop", "orders")).snapshot()["id"]
    scan.delete_where(e.catalog, ("shop", "orders"), [("o_orderstatus", "=", "F")])
    return e.table("shop.orders", snapshot_id=first)


def compaction_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    src = _read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    ident = resolve("shop.orders")
    e.catalog.create_table(ident, columns_of(src.schema), [Transform("identity", "o_orderstatus")])
    for i in range(3):
        append(e.catalog, ident, src.where(F.col("o_orderkey") % 3 == i))
    scan.delete_where(e.catalog, ident, [("o_orderpriority", "=", "5-LOW")])
    if not maintain.compact(e.catalog, ident) or e.catalog.load(ident).snapshot()["deletes"]:
        raise RuntimeError("nothing was compacted")
    return e.table("shop.orders")


def retention_and_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    ident = ("shop", "orders")
    append(e.catalog, ident, e.table("shop.orders").where("o_orderkey < 10"))
    maintain.compact(e.catalog, ident)
    maintain.expire(e.catalog, ident, max_age=0, keep_last=1)
    maintain.sweep(e.catalog, ident, min_age=0)
    return e.sql("SELECT COUNT(*) AS n FROM shop.orders")


def json_flatten_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    rows = [{"id": i, "customer": {"id": i % 3, "address": {"city": f"c{i % 2}"}}, "tags": [i, str(i)], "note": None if i % 2 else "even"} for i in range(6)]
    e.ingest.json("perf.events", {"rows": rows})
    e.ingest.flush("perf.events")
    return e.sql("SELECT id, `customer.id` AS cust, `customer.address.city` AS city, tags, note FROM perf.events")


def idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.sql("CREATE TABLE m.t (id BIGINT NOT NULL, v DOUBLE)")
    body = json.dumps({"rows": [{"id": 1, "v": 0.5}, {"id": 2, "v": 1}], "idempotency_key": "a"})
    e.ingest.json("m.t", body)
    e.ingest.json("m.t", body)
    e.ingest.json("m.t", {"id": 3, "unknown": True})
    e.ingest.flush("m.t")
    e.ingest.flush("m.t")
    return e.sql("SELECT id, v FROM m.t")


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.sql("CREATE TABLE t (a INT, b STRING, c DECIMAL(10, 2)) PARTITIONED BY (b)")
    e.sql("INSERT INTO t VALUES (1, 'x/y', 1.25), (2, NULL, 2.5)")
    e.sql("INSERT INTO t (b, a) SELECT 'z', 3")
    return e.sql("SELECT a, b, CAST(c AS DOUBLE) AS c FROM t")


def show_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.sql("CREATE TABLE IF NOT EXISTS x.t (a INT NOT NULL, b VARCHAR(10), c NUMERIC(12, 3), d TIMESTAMP, e BIGINT UNSIGNED)")
    return e.sql("DESCRIBE x.t").rows


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    for t in ("n1.a", "n1.b", "n2.c"):
        e.sql(f"CREATE TABLE {t} (x INT)")
    e.sql("DROP TABLE n1.b")
    return e.sql("SELECT table_schema, table_name FROM information_schema.tables")


def partition_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    kinds = {f.name: f.dataType for f in ev.schema}
    cols = [value_of(parse(t), kinds[parse(t).column]).cast("long").alias(n) for n, t in (("y", "year(ts)"), ("m", "month(ts)"), ("d", "day(ts)"), ("h", "hour(ts)"), ("t", "truncate(7, user_id)"))]
    return ev.select("event_id", *cols, value_of(parse("truncate(2, event_type)"), kinds["event_type"]).alias("s"))


def stream_ingest_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark)
    e.sql("CREATE TABLE s.events (event_id BIGINT NOT NULL, user_id BIGINT, event_type STRING, value DOUBLE) PARTITION BY (event_type)")
    home = warehouse(spark)
    _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").repartition(4).write.json(f"{home}/in")
    for _ in range(2):  # the second run finds nothing new
        e.ingest.stream("s.events", f"{home}/in", f"{home}/checkpoint", max_files=2).awaitTermination()
    return e.sql("SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS total FROM s.events GROUP BY event_type")


def sql_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a partitioned table; fails if the filter doesn't keep files from being read."""
    e = _orders(spark, sf_dir, [Transform("identity", "o_orderstatus")], [("o_orderkey", False)])
    df = e.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM shop.orders o WHERE o.o_orderstatus = 'F' AND o_totalprice > 400000")
    if len(df.inputFiles()) >= len(e.table("shop.orders").inputFiles()):
        raise RuntimeError("no file was pruned")
    return df


def sql_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of tables in literals, columns and common table expressions."""
    e = _orders(spark, sf_dir)
    e.create_from("shop.nation", _read(spark, sf_dir, "nation").withColumnRenamed("n_name", "orders"))
    return e.sql("WITH nation AS (SELECT n_nationkey AS k, nation.orders FROM shop.nation) SELECT k, orders, 'from shop.orders' AS s, (SELECT COUNT(*) FROM shop.orders WHERE o_custkey = k) AS n FROM nation")


def flush_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flush that ends after its commit, before it has cleared up; then more rows and another flush."""
    e = _engine(spark)
    e.sql("CREATE TABLE m.t (id BIGINT NOT NULL)")
    ids = [r.n_nationkey for r in _read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    e.ingest.json("m.t", [{"id": i} for i in ids])
    real = e.catalog.store.delete

    def ended(path: str) -> None:
        raise OSError("the process ends here")

    e.catalog.store.delete = ended
    try:
        e.ingest.flush("m.t")
    except OSError:
        pass
    finally:
        e.catalog.store.delete = real
    e.ingest.json("m.t", [{"id": i + 100} for i in ids])
    e.ingest.flush("m.t")
    return e.sql("SELECT id FROM m.t")


LAKEHOUSE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "snapshot_append_scan": (snapshot_append_scan, "SELECT o_orderkey, CAST(CASE WHEN o_orderkey < 100 THEN 2 ELSE 1 END AS BIGINT) AS n FROM orders"),
    "partition_pruned_scan": (partition_pruned_scan, f"{_ORDERS} WHERE o_orderstatus = 'F' AND o_totalprice > 400000"),
    "stats_pruned_scan": (stats_pruned_scan, f"{_ORDERS} WHERE o_orderkey >= 900 AND o_orderkey < 1100"),
    "position_delete_scan": (position_delete_scan, f"{_ORDERS} WHERE o_orderstatus <> 'P' AND o_orderkey >= 50"),
    "sql_pruned_scan": (sql_pruned_scan, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000"),
    "sql_binding": (sql_binding, "SELECT n_nationkey AS k, n_name AS orders, 'from shop.orders' AS s, (SELECT COUNT(*) FROM orders WHERE o_custkey = n_nationkey) AS n FROM nation"),
    "flush_after_failure": (flush_after_failure, "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT) FROM nation"),
    "empty_table_scan": (empty_table_scan, "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS INT) AS m"),
    "time_travel_scan": (time_travel_scan, _ORDERS),
    "compaction_preserves_rows": (compaction_preserves_rows, f"{_ORDERS} WHERE o_orderpriority <> '5-LOW'"),
    "retention_and_sweep": (retention_and_sweep, "SELECT COUNT(*) + COUNT(*) FILTER (WHERE o_orderkey < 10) AS n FROM orders"),
    "json_flatten_ingest": (json_flatten_ingest, "SELECT CAST(i AS BIGINT) AS id, CAST(i % 3 AS BIGINT) AS cust, 'c' || (i % 2) AS city, '[' || i || ',\"' || i || '\"]' AS tags, CASE WHEN i % 2 = 0 THEN 'even' END AS note FROM range(6) t(i)"),
    "idempotent_ingest": (idempotent_ingest, "SELECT CAST(id AS BIGINT) AS id, CAST(v AS DOUBLE) AS v FROM (VALUES (1, 0.5), (2, 1), (3, NULL)) t(id, v)"),
    "insert_values": (insert_values, "SELECT a, b, CAST(c AS DOUBLE) AS c FROM (VALUES (1, 'x/y', 1.25), (2, NULL, 2.5), (3, 'z', NULL)) t(a, b, c)"),
    "show_columns": (show_columns, "SELECT * FROM (VALUES (1, 'a', 'int32', false), (2, 'b', 'string', true), (3, 'c', 'decimal(12,3)', true), (4, 'd', 'timestamp', true), (5, 'e', 'uint64', true)) t(field_id, name, type, nullable)"),
    "show_tables": (show_tables, "SELECT * FROM (VALUES ('n1', 'a'), ('n2', 'c')) t(table_schema, table_name)"),
    "partition_transforms": (partition_transforms, "SELECT event_id, CAST(year(ts) - 1970 AS BIGINT) AS y, CAST((year(ts) - 1970) * 12 + month(ts) - 1 AS BIGINT) AS m, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS d, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, user_id - user_id % 7 AS t, event_type[1:2] AS s FROM events"),
    "stream_ingest_flush": (stream_ingest_flush, "SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS total FROM events GROUP BY event_type"),
}
