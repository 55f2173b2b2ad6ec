import datetime
import threading

import pytest

from tidemark.operators import maintain, prune, scan
from tidemark.plans import ddl
from tidemark.sources import catalog as C
from tidemark.sources import transforms as X
from tidemark.sources.files import append
from tidemark.sources.types import UnsupportedType, type_name
from tidemark.streaming import ingest as I


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# pruning


FILES = {
    "us_low": {"rows": 10, "nulls": {"x": 0}, "bounds": {"x": [0, 50]}, "partition": {"region": "us"}},
    "us_high": {"rows": 10, "nulls": {"x": 0}, "bounds": {"x": [100, 200]}, "partition": {"region": "us"}},
    "eu_low": {"rows": 10, "nulls": {"x": 0}, "bounds": {"x": [0, 50]}, "partition": {"region": "eu"}},
}


@pytest.mark.parametrize(
    "predicates, kept",
    [
        ([("region", "=", "us")], {"us_low", "us_high"}),
        ([("x", ">", 75)], {"us_high"}),
        ([("region", "=", "eu"), ("x", ">", 75)], set()),
        ([("x", "in", [60, 150])], {"us_high"}),
        ([("x", "<>", 7)], {"us_low", "us_high", "eu_low"}),
        ([("x", "=", "text")], {"us_low", "us_high", "eu_low"}),
        ([("x", "<=", 0)], {"us_low", "eu_low"}),
        ([("x", "<", 0)], set()),
        ([("x", "is null", None)], set()),
        ([("other", "=", 1)], {"us_low", "us_high", "eu_low"}),
    ],
)
def test_prune(predicates, kept):
    files = [f | {"path": n} for n, f in FILES.items()]
    assert {f["path"] for f in prune.prune(files, [X.Transform("identity", "region")], predicates)} == kept


@pytest.mark.parametrize("file", [{}, {"bounds": {"x": [None, None]}}, {"bounds": {"x": [0, None]}}, {"rows": 3, "nulls": {}}])
def test_unknown_statistics_keep_a_file(file):
    assert prune.prune([file], [X.Transform("identity", "region")], [("x", ">", 5), ("x", "is null", None)][:1]) == [file]
    assert prune.keep_by_statistics(file, [("x", "is null", None)])


def test_other_transforms_and_null_values_do_not_prune():
    file = {"partition": {"region_trunc_1": "u", "region": None}}
    assert prune.keep_by_partition(file, [X.Transform("truncate", "region", 1)], [("region", "=", "eu")])
    assert prune.keep_by_partition(file, [X.Transform("identity", "region")], [("region", "=", "eu")])


# transforms and types


def test_directory_names():
    t = X.Transform
    assert X.directory([t("identity", "region")], ["eu/west"]) == "region=eu%2Fwest"
    assert X.directory([t("identity", "r")], ["a b%"]) == "r=a+b%25"
    assert X.directory([t("day", "event")], [0]) == "event_day=1970-01-01"
    assert X.directory([t("month", "d"), t("year", "d"), t("hour", "d")], [13, -1, 25]) == "d_month=1971-02/d_year=1969/d_hour=1970-01-02-01"


def test_bucket_vectors():
    assert X._murmur3((34).to_bytes(8, "little")) == 2017239379
    assert X._murmur3(b"iceberg") == 1210000089
    assert X.bucket_of(None, 4) is None and X.bucket_of(datetime.date(2017, 11, 16), 1 << 31) == (-653330422 & 0x7FFFFFFF)


def test_transform_values(spark):
    df = spark.sql("SELECT * FROM VALUES (-3, 'abcdef', DATE '1969-12-31'), (10, 'é', DATE '1970-01-01'), (NULL, NULL, NULL) t(i, s, d)")
    kinds = {f.name: f.dataType for f in df.schema}
    got = df.select(*[X.value_of(X.parse(t), kinds[X.parse(t).column]).alias(str(i)) for i, t in enumerate(("truncate(5, i)", "truncate(2, s)", "day(d)", "year(d)", "bucket(16, s)", "void(i)"))]).collect()
    assert [tuple(r) for r in got] == [(-5, "ab", -1, -1, X.bucket_of("abcdef", 16), None), (10, "é", 0, 0, X.bucket_of("é", 16), None), (None,) * 6]


@pytest.mark.parametrize("spelling, name", [("INT", "int32"), ("varchar(3)", "string"), ("DECIMAL", "decimal(38,10)"), ("numeric(7)", "decimal(7,0)"), ("DOUBLE PRECISION", "float64"), ("bigint unsigned", "uint64"), ("DATETIME", "timestamp"), ("hugeint", "int64"), ("bytea", "binary")])
def test_type_names(spelling, name):
    assert type_name(spelling) == name


@pytest.mark.parametrize("spelling", ["ARRAY<INT>", "JSON", "INTERVAL", "UUID", "MAP(INT, INT)"])
def test_unsupported_types(spelling):
    with pytest.raises(UnsupportedType):
        type_name(spelling)


# statements


def test_classify():
    p = ddl.classify("create table if not exists A.b (x int not null, `y.z` decimal(5,2), w varchar(9) null) partition by (x, bucket(4, w), day(\"y.z\")) sorted by (x desc)")
    assert (p.kind, p.name, p.flag) == ("create_table", "A.b", True)
    assert p.columns == [("x", "int32", False), ("y.z", "decimal(5,2)", True), ("w", "string", True)]
    assert [t.name for t in p.partitions] == ["x", "w_bucket_4", "y.z_day"] and p.sort == [("x", True)]
    assert ddl.classify("CREATE TABLE t (a INT) PARTITIONED BY (a)").partitions == [X.Transform("identity", "a")]
    assert ddl.classify("DROP TABLE IF EXISTS a.b PURGE;").purge
    assert ddl.classify("SHOW TABLES IN n").name == "n" and ddl.classify("describe a.b").kind == "show_columns"
    assert ddl.classify("SELECT 'a;b' -- drop table x") == "SELECT 'a;b'"


@pytest.mark.parametrize("sql", ["", " ; ", "SELECT 1; SELECT 2", "DROP VIEW v", "DROP TABLE a, b", "CREATE TABLE t (a INT) PARTITIONED BY (day(a))", "CREATE TABLE t (a INT) PARTITION BY (nope(a))"])
def test_bad_statements(sql):
    with pytest.raises(C.InvalidArgument):
        ddl.classify(sql)


def test_names():
    assert C.resolve("t") == ("default", "t") and C.resolve("c.n.t") == ("n", "t")
    with pytest.raises(C.InvalidArgument):
        C.check_name("1x")


def test_purge_leaves_siblings(engine):
    for t in ("events", "events2"):
        engine.sql(f"CREATE TABLE n.{t} (x INT)")
        engine.sql(f"INSERT INTO n.{t} VALUES (1)")
    engine.sql("DROP TABLE n.events PURGE")
    assert not engine.catalog.store.exists(engine.catalog.location(("n", "events")))
    assert engine.sql("SELECT x FROM n.events2").count() == 1
    with pytest.raises(C.NotFound):
        engine.sql("DROP TABLE n.events")
    assert not engine.sql("DROP TABLE IF EXISTS n.events").changed
    assert engine.sql("CREATE TABLE n.events (y INT)").changed and engine.sql("SELECT y FROM n.events").count() == 0


# snapshots, deletes, commits


def test_a_plan_keeps_its_snapshot(engine):
    engine.sql("CREATE TABLE t (x INT)")
    engine.sql("INSERT INTO t VALUES (1)")
    df = engine.sql("SELECT x FROM t")
    engine.sql("INSERT INTO t VALUES (2)")
    assert rows(df) == [(1,)] and rows(engine.sql("SELECT x FROM t")) == [(1,), (2,)]


def test_position_deletes(spark, engine):
    engine.create_from("t", spark.range(6).selectExpr("cast(id as int) x").coalesce(1))
    ident = ("default", "t")
    path = engine.catalog.load(ident).snapshot()["files"][0]["path"]
    positions = spark.createDataFrame([(path, 3), (path, 3), (path.split("/")[-1], 0)], "file_path string, pos long")
    scan.add_deletes(engine.catalog, ident, positions)
    scan.add_deletes(engine.catalog, ident, spark.createDataFrame([(path, 3)], "file_path string, pos long"))
    assert rows(engine.table("t")) == [(1,), (2,), (4,), (5,)]
    assert maintain.compact(engine.catalog, ident) == 1
    assert rows(engine.table("t")) == [(1,), (2,), (4,), (5,)] and not engine.catalog.load(ident).snapshot()["deletes"]


@pytest.mark.parametrize("bad", [(None, 1), ("", 1), ("f", None), ("f", -1)])
def test_bad_position_deletes(spark, engine, tmp_path, bad):
    engine.create_from("t", spark.range(3).coalesce(1))
    positions = spark.createDataFrame([bad], "file_path string, pos long")
    with pytest.raises(C.InvalidArgument):
        scan.add_deletes(engine.catalog, ("default", "t"), positions)
    assert not engine.catalog.load(("default", "t")).snapshot()["deletes"]
    positions.write.parquet(f"file://{tmp_path}/deletes")  # of another writer
    engine.catalog.commit_snapshot(("default", "t"), "delete", [], deletes=[{"path": f"file://{tmp_path}/deletes", "rows": 1, "content": "position"}])
    with pytest.raises(C.InvalidArgument):
        engine.table("t")


def test_writers_at_once_lose_nothing(spark, engine):
    engine.sql("CREATE TABLE t (x INT)")
    threads = [threading.Thread(target=lambda i=i: append(engine.catalog, ("default", "t"), spark.createDataFrame([(i,)], "x int"))) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert rows(engine.table("t")) == [(i,) for i in range(4)]


def test_replace_needs_its_base(engine):
    engine.sql("CREATE TABLE t (x INT)")
    engine.sql("INSERT INTO t VALUES (1)")
    base = engine.catalog.load(("default", "t")).snapshot()["id"]
    engine.sql("INSERT INTO t VALUES (2)")
    with pytest.raises(C.Conflict):
        engine.catalog.commit_snapshot(("default", "t"), "replace", [], base=base)
    with pytest.raises(C.Conflict):
        engine.catalog.set_property(("default", "t"), "k", "v", expected="other")


def test_manifests(spark, engine):
    """An append writes the files it adds; a delete of some rewrites their manifest only; many manifests become one."""
    engine.create_from("t", spark.range(4).coalesce(1))
    ident = ("default", "t")
    for i in range(3):
        append(engine.catalog, ident, spark.range(10 * i + 10, 10 * i + 12).coalesce(1))
    snapshots = [engine.catalog.load(ident).snapshot(s["id"]) for s in engine.catalog.load(ident).state["snapshots"]]
    assert [len(s["manifests"]) for s in snapshots] == [1, 2, 3, 4] and all(b["manifests"][: len(a["manifests"])] == a["manifests"] for a, b in zip(snapshots, snapshots[1:]))
    gone = snapshots[-1]["files"][1]["path"]
    after = engine.catalog.commit_snapshot(ident, "replace", [], {gone}).snapshot()
    assert [m for m in after["manifests"] if m in snapshots[-1]["manifests"]] == [m for i, m in enumerate(snapshots[-1]["manifests"]) if i != 1] and len(after["manifests"]) == 3
    maintain.expire(engine.catalog, ident, max_age=0)
    names = {p.rsplit("/", 1)[1] for p, *_ in engine.catalog.store.list(engine.catalog.location(ident) + "/metadata") if "/files-" in p}
    assert names == {f"{m}.json" for m, _ in after["manifests"]}
    for i in range(C.MAX_MANIFESTS):
        engine.catalog.commit_snapshot(ident, "append", [{"path": f"p{i}", "rows": 0, "bytes": 0}])
    last = engine.catalog.load(ident).snapshot()
    assert len(last["manifests"]) < 10 and len(last["files"]) == 3 + C.MAX_MANIFESTS


def test_statistics_come_from_footers(spark, engine, monkeypatch):
    """The same entries as by reading the rows; files of one hot partition value are written by several tasks."""
    from tidemark.sources import files

    df = spark.sql("SELECT id, CASE WHEN id % 10 < 9 THEN 'hot' ELSE concat('p', id % 3) END AS region, CASE WHEN id % 7 > 0 THEN id / 4 END AS x, cast(id AS decimal(9, 2)) AS d, date_add(DATE '2024-01-01', cast(id % 3 AS int)) AS day, timestamp_micros(id * 1000003) AS ts, id % 2 = 0 AS b, cast(null AS string) AS n, repeat(cast(id AS string), 3000) AS long, cast('z' AS binary) AS raw FROM range(300)")
    engine.catalog.create_table(("default", "t"), C.columns_of(df.schema), [X.parse("region"), X.parse("truncate(50, id)"), X.parse("bucket(4, day)"), X.parse("hour(ts)"), X.parse("n")])
    table = engine.catalog.load(("default", "t"))
    entries = files.write_files(engine.catalog, ("default", "t"), files.conform(df.repartition(2), table), table)
    read = files._read_again(spark, table.schema, table.partitions, {e["path"]: e["bytes"] for e in entries})
    plain = lambda e: e | {"bounds": {k: v for k, v in e["bounds"].items() if k != "long"}, "nulls": {k: v for k, v in e["nulls"].items() if k != "long"}}
    assert len(entries) > 10 and [plain(e) for e in entries] == [plain(e) for e in read]
    assert all(e["bounds"]["long"] == [None, None] or e["bounds"]["long"] == r["bounds"]["long"] for e, r in zip(entries, read))
    monkeypatch.setattr(files, "_filesystem", crash)
    assert files.file_entries(spark, table.schema, table.partitions, [(e["path"], e["bytes"]) for e in entries]) == read


def test_a_hot_partition_value_is_split(spark, engine):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64k")
    try:
        engine.create_from("t", spark.range(200_000).selectExpr("id", "CASE WHEN id % 100 > 0 THEN 'hot' ELSE 'cold' END AS p", "md5(cast(id AS string)) AS h").repartition(16), [X.parse("p")])
    finally:
        spark.conf.unset(key)
    files = engine.catalog.load(("default", "t")).snapshot()["files"]
    assert sum(f["partition"]["p"] == "hot" for f in files) > 4 and sum(f["partition"]["p"] == "cold" for f in files) <= 2
    assert engine.table("t").count() == 200_000


def test_pins_of_other_processes(spark, engine):
    engine.create_from("t", spark.range(3))
    ident, other = ("default", "t"), C.Catalog(spark, engine.catalog.warehouse)
    old = engine.catalog.load(ident).snapshot()["id"]
    append(engine.catalog, ident, spark.range(3, 5))
    with other.pin(ident, old, lease=3):
        assert engine.catalog.pinned(ident) == {old} and maintain.expire(engine.catalog, ident, max_age=0) == set()
        import time

        time.sleep(3.5)  # renewed meanwhile
        assert engine.catalog.pinned(ident) == {old}
    assert engine.catalog.pinned(ident) == set() and maintain.expire(engine.catalog, ident, max_age=0) == {old}
    engine.catalog.store.create(engine.catalog.location(ident) + "/pins/dead-0.json", '{"snapshot": 1, "until": 5}')
    assert engine.catalog.pinned(ident) == set() and not engine.catalog.store.list(engine.catalog.location(ident) + "/pins")


def test_metadata_cache(spark, engine):
    """Within its time to live a table is not read again, unless this catalog changed it."""
    engine.create_from("t", spark.range(2))
    cached = C.Catalog(spark, engine.catalog.warehouse, ttl=60)
    ident = ("default", "t")
    first = cached.load(ident)
    append(engine.catalog, ident, spark.range(3))
    assert cached.load(ident) is first and engine.catalog.load(ident).state["version"] > first.state["version"]
    append(cached, ident, spark.range(4))
    assert len(cached.load(ident).state["snapshots"]) == 3


def test_equality_deletes_are_refused(spark, engine):
    engine.create_from("t", spark.range(2))
    engine.catalog.commit_snapshot(("default", "t"), "delete", [], deletes=[{"path": "x", "rows": 1, "content": "equality"}])
    with pytest.raises(NotImplementedError):
        engine.table("t")


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "lz4_raw", "zstd"])
def test_codecs(spark, engine, codec):
    import pyarrow.parquet as pq

    from tidemark.sources import files

    engine.create_from("t", spark.range(0))
    written = files.write_files(engine.catalog, ("default", "t"), spark.range(1000).coalesce(1), codec=codec)
    engine.catalog.commit_snapshot(("default", "t"), "append", written)
    meta = pq.read_metadata(written[0]["path"].removeprefix("file:"))
    assert meta.row_group(0).column(0).compression == {"none": "UNCOMPRESSED", "lz4_raw": "LZ4"}.get(codec, codec.upper()) and engine.table("t").count() == 1000
    with pytest.raises(C.InvalidArgument):
        files.write_files(engine.catalog, ("default", "t"), spark.range(1), codec="other")


def test_properties_by_compare_and_set(engine):
    engine.sql("CREATE TABLE t (x INT)")
    ident, c = ("default", "t"), engine.catalog
    c.set_property(ident, "k", "1", expected=None)
    c.set_property(ident, "k", "2", expected="1")
    with pytest.raises(C.Conflict):
        c.set_property(ident, "k", "3", expected="1")
    assert c.load(ident).state["properties"] == {"k": "2"}
    c.set_property(ident, "k", None, expected="2")
    assert c.load(ident).state["properties"] == {}


def test_not_null(engine):
    engine.sql("CREATE TABLE t (x INT NOT NULL)")
    with pytest.raises(C.InvalidArgument):
        engine.sql("INSERT INTO t VALUES (NULL)")


# ingest


def test_flatten():
    assert I.flatten({"a": {"b": {"c": 1}}, "l": [1, {"x": "é"}], "n": None, "e": {}}) == {"a.b.c": 1, "l": '[1,{"x":"é"}]', "n": None}
    assert I.normalise({"x": 1}) == ([{"x": 1}], None) and I.normalise('{"rows": [{}], "idempotency_key": "k"}') == ([{}], "k")
    for bad in ([], {"rows": []}, [1]):
        with pytest.raises(C.InvalidArgument):
            I.normalise(bad)


def test_flatten_columns(spark):
    df = spark.sql("SELECT named_struct('b', 1, 'c', named_struct('d', 'x')) AS a, array(1, 2) AS l")
    assert I.flatten_columns(df).collect()[0].asDict() == {"a.b": 1, "a.c.d": "x", "l": "[1,2]"}


def test_rejected_requests_leave_nothing(engine):
    engine.sql("CREATE TABLE t (id BIGINT NOT NULL, v DOUBLE)")
    for bad in ({"v": 1.0}, {"id": "text"}):
        with pytest.raises(C.InvalidArgument):
            engine.ingest.json("t", {"rows": [{"id": 1}, bad], "idempotency_key": "k"})
    assert engine.ingest.flush("t") == "no_pending_data"
    assert not engine.ingest.json("t", {"rows": [{"id": 1}], "idempotency_key": "k"}).duplicate
    assert engine.ingest.json("t", {"rows": [{"id": 1}], "idempotency_key": "k"}).duplicate
    assert engine.sql("SELECT id FROM t").count() == 0  # not before the flush
    assert engine.ingest.flush("t") == "flushed" and engine.sql("SELECT id FROM t").count() == 1


def crash(*_, **__):
    raise OSError("the process ended here")


def test_a_flush_ends_after_its_commit(engine, monkeypatch):
    """Clean-up fails, another batch is staged: nothing is committed twice, even when the snapshot has expired."""
    engine.sql("CREATE TABLE t (x INT)")
    engine.ingest.json("t", [{"x": 1}, {"x": 2}])
    with monkeypatch.context() as m:
        m.setattr(type(engine.catalog.store), "delete", crash)
        with pytest.raises(OSError):
            engine.ingest.flush("t")
    engine.ingest.json("t", {"x": 3})
    maintain.expire(engine.catalog, ("default", "t"), max_age=0)
    assert engine.ingest.flush("t") == "flushed" and engine.ingest.flush("t") == "no_pending_data"
    assert rows(engine.table("t")) == [(1,), (2,), (3,)]
    engine.ingest.json("t", {"x": 4})
    engine.ingest.flush("t")
    assert len(engine.catalog.load(("default", "t")).state["ingested"]) == 1  # names of deleted batches go


@pytest.mark.parametrize("after", [False, True])
def test_an_unknown_outcome_is_found_out(engine, monkeypatch, after):
    """The commit fails before or after it took place: the next flush, or recheck, settles it with the files that were written."""
    engine.sql("CREATE TABLE t (x INT)")
    engine.ingest.json("t", {"x": 1})
    real = C.Catalog.commit_snapshot

    def broken(self, *a, **k):
        if after:
            real(self, *a, **k)
        raise OSError("no answer")

    with monkeypatch.context() as m:
        m.setattr(C.Catalog, "commit_snapshot", broken)
        with pytest.raises(I.FlushBlocked):
            engine.ingest.flush("t")
    data = lambda: sum(p.endswith(".parquet") for p, *_ in engine.catalog.store.files(engine.catalog.location(("default", "t")) + "/data"))
    before = data()
    assert engine.ingest.recheck("t") == 1 and engine.ingest.recheck("t") == 0
    assert engine.ingest.flush("t") == "no_pending_data" and rows(engine.table("t")) == [(1,)] and data() == before


def test_two_flushers(engine, monkeypatch):
    """One flush comes in while another is between writing and committing: each row is there once."""
    engine.sql("CREATE TABLE t (x INT)")
    engine.ingest.json("t", {"x": 1})
    real, other = I.Ingest._commit, I.Ingest(engine.catalog)

    def late(self, *a):
        if self is engine.ingest and not late.done:
            late.done = True
            engine.ingest.json("t", {"x": 2})
            assert other.flush("t") == "flushed"
        return real(self, *a)

    late.done = False
    monkeypatch.setattr(I.Ingest, "_commit", late)
    assert engine.ingest.flush("t") in ("flushed", "no_pending_data")
    assert engine.ingest.flush("t") == "no_pending_data" and rows(engine.table("t")) == [(1,), (2,)]
    threads = [threading.Thread(target=f) for f in [lambda: engine.ingest.json("t", {"x": 3}), *[lambda: other.flush("t")] * 2, lambda: engine.ingest.flush("t")]]
    [t.start() for t in threads]
    [t.join() for t in threads]
    other.flush("t")
    assert rows(engine.table("t")) == [(1,), (2,), (3,)]


def test_a_key_counts_when_its_rows_are_there(engine, monkeypatch):
    """A crash between claim and staging: in progress at first, then the request is taken; a slow first request is a duplicate of the second."""
    engine.sql("CREATE TABLE t (x INT)")
    body = {"rows": [{"x": 1}], "idempotency_key": "k"}
    with monkeypatch.context() as m:
        m.setattr(I.files, "conform", crash)
        m.setattr(type(engine.catalog.store), "delete", crash)
        with pytest.raises(OSError):
            engine.ingest.json("t", body)
    with pytest.raises(I.InProgress):
        engine.ingest.json("t", body)
    monkeypatch.setattr(I, "CLAIM_SECONDS", 0)
    real, slow = I.Ingest._enter, []

    def enter(self, *a):
        if not slow:
            slow.append(True)
            assert not engine.ingest.json("t", body).duplicate  # overtakes
        return real(self, *a)

    monkeypatch.setattr(I.Ingest, "_enter", enter)
    assert engine.ingest.json("t", body).duplicate and engine.ingest.json("t", body).duplicate
    assert engine.ingest.flush("t") == "flushed" and rows(engine.table("t")) == [(1,)]
    assert engine.ingest.json("t", body).duplicate
    monkeypatch.setattr(I, "KEY_HOURS", 0)
    assert not engine.ingest.json("t", body).duplicate and engine.ingest.purge_keys("t") == 0  # its batch is staged
    engine.ingest.flush("t")
    assert engine.ingest.purge_keys("t") == 1 and engine.table("t").count() == 2


def test_only_nulls_have_no_type(engine):
    with pytest.raises(C.InvalidArgument):
        engine.ingest.json("new", [{"a": None, "b": 1}])


def test_strict_frames(spark, engine):
    engine.sql("CREATE TABLE t (a INT, b STRING)")
    engine.ingest.frame("t", spark.createDataFrame([(1, "x")], "a int, b string"))
    for schema in ("b string, a int", "a long, b string", "a int"):
        with pytest.raises(C.InvalidArgument):
            engine.ingest.frame("t", spark.createDataFrame([], schema))
    engine.ingest.flush("t")
    assert rows(engine.table("t")) == [(1, "x")]


# maintenance


def entry(path, size, rows=100, part="a"):
    return {"path": path, "bytes": size, "rows": rows, "partition": {"p": part}}


def test_selection():
    mb = 1 << 20
    small, mid, large = [entry(f"s{i}", mb) for i in range(3)], [entry(f"m{i}", 40 * mb) for i in range(7)], [entry("l", 100 * mb)]
    paths = lambda groups: [sorted(f["path"] for f in g) for g in groups]
    assert paths(maintain.select(small + mid + large)) == [["s0", "s1", "s2"]]
    assert len(paths(maintain.select(small + mid + [entry("m7", 40 * mb)]))[0]) == 11
    assert paths(maintain.select(large, {"l": 30})) == [["l"]] and paths(maintain.select(large, {"l": 20})) == []
    assert paths(maintain.select([entry("x", mb)])) == []
    assert len(maintain.select([entry(f"f{i}", mb) for i in range(100)])[0]) == 64
    assert len(maintain.select([entry("a", mb), entry("b", mb), entry("c", mb, part="z"), entry("d", mb, part="z")])) == 2


def test_retention():
    s = [{"id": i, "at": 1000.0 * i} for i in range(5)]
    assert maintain.expired(s, 4, 1500, 1, set(), now=4000) == {0, 1, 2}
    assert maintain.expired(s, 4, 1500, 3, {0}, now=4000) == {1}
    assert maintain.expired(s, 0, 0, 0, set(), now=9000) == {1, 2, 3}


def test_sweep(engine):
    engine.sql("CREATE TABLE t (x INT)")
    engine.sql("INSERT INTO t VALUES (1)")
    ident, at = ("default", "t"), engine.catalog.location(("default", "t"))
    engine.catalog.store.create(f"{at}/data/orphan", "x")
    engine.catalog.store.create(f"{at}/data2/other", "x")
    assert maintain.sweep(engine.catalog, ident, min_age=3600) == []
    with engine.catalog.pin(ident, 12345):
        assert maintain.sweep(engine.catalog, ident, min_age=0) == []
    assert any(p.endswith("/orphan") for p in maintain.sweep(engine.catalog, ident, min_age=0))
    assert engine.catalog.store.exists(f"{at}/data2/other") and engine.sql("SELECT x FROM t").count() == 1


# running


def test_rows_limits(engine):
    engine.sql("CREATE TABLE t (x INT, y STRING)")
    engine.sql("INSERT INTO t VALUES (1, NULL), (2, 'b')")
    assert engine.rows("SELECT * FROM t ORDER BY x", limit=0) == ['{"x":1,"y":null}']
    from tidemark.plans.engine import ResultTooLarge

    with pytest.raises(ResultTooLarge):
        engine.rows("SELECT * FROM t", max_bytes=5)
    assert sorted(engine.status().values()) == ["completed", "failed"]
    with pytest.raises(C.NotFound):
        engine.sql("SELECT * FROM nowhere")
    assert "nowhere" in engine.explain("SELECT * FROM nowhere")
    assert rows(engine.sql("SELECT x FROM t WHERE x > :least", args={"least": 1})) == [(2,)]


def test_url_path_hash(spark):
    want = {"http://h/foo": 185146782, "/bar?x": -630422841, "https://u/é/x#y": 1547095365, "http://host": -2128831035, "": -2128831035, None: None}
    from pyspark.sql import functions as F

    from tidemark.functions import register, url_path_hash

    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.h for r in df.select("u", url_path_hash(F.col("u")).alias("h")).collect()} == want
    register(spark)
    df.createOrReplaceTempView("urls")
    assert {r.u: r.h for r in spark.sql("SELECT u, URLPathHash(u) AS h FROM urls").collect()} == want


def test_prepared_statements_and_api(engine):
    assert engine.create_table("n.t", [("id", "BIGINT", False), ("ts", "TIMESTAMP", True)], ["day(ts)", "bucket(8, id)"], ["id desc"])
    assert not engine.create_table("n.t", [("id", "INT", True)], if_not_exists=True)
    engine.sql("INSERT INTO n.t VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (2, NULL)")
    h = engine.prepare("SELECT id FROM n.t WHERE id >= :least")
    assert rows(engine.execute(h, {"least": 2})) == [(2,)] and rows(engine.execute(h, {"least": 0})) == [(1,), (2,)]
    engine.close(h)
    with pytest.raises(C.NotFound):
        engine.execute(h)
    with pytest.raises(C.InvalidArgument):
        engine.prepare("DROP TABLE n.t")
    assert engine.page(list(range(5000)), 10, 9999) == list(range(10, 1010))
    assert {r.table_type for r in engine.metadata("table_types").collect()} == {"TABLE", "VIEW"} and engine.metadata("primary_keys").count() == 0
    assert [r.db_schema_name for r in engine.metadata("schemas").collect()] == ["n"]


def test_arrow_and_backpressure(engine):
    import pyarrow as pa

    from tidemark.streaming.ingest import Backpressure

    engine.sql("CREATE TABLE t (a BIGINT, b STRING)")
    data = pa.table({"a": [1, 2], "b": ["x", None]})
    engine.ingest.arrow("t", data, key="k")
    assert engine.ingest.arrow("t", data, key="k").duplicate
    engine.ingest.soft_bytes = 1
    engine.ingest.arrow("t", data)  # flushes the first
    assert engine.table("t").count() == 2
    engine.ingest.hard_bytes = 1
    with pytest.raises(Backpressure):
        engine.ingest.arrow("t", data)
    assert engine.ingest.purge_keys("t") == 0


def test_joins_of_tables_with_aliases(engine):
    engine.sql("CREATE TABLE s.a (id INT, v STRING)")
    engine.sql("CREATE TABLE s.b (id INT, w STRING)")
    engine.sql("INSERT INTO s.a VALUES (1, 'x'), (2, 'y')")
    engine.sql("INSERT INTO s.b VALUES (1, 'from s.a'), (3, 'z')")
    assert rows(engine.sql("SELECT a.id, b.w FROM s.a JOIN s.b ON a.id = b.id")) == [(1, "from s.a")]
    assert rows(engine.sql("SELECT l.v, r.w FROM s.a AS l, s.b r WHERE l.id = r.id")) == [("x", "from s.a")]
    assert rows(engine.sql("WITH t AS (SELECT id FROM s.a) SELECT t.id FROM t LEFT ANTI JOIN s.b ON t.id = b.id")) == [(2,)]
    assert rows(engine.sql("SELECT v FROM s.a WHERE id IN (SELECT id FROM s.b)")) == [("x",)]
    assert rows(engine.sql("SELECT x.v FROM `s`.`a` x")) == [("x",), ("y",)]


def test_names_are_bound_where_they_stand(spark, engine):
    """Literals, columns, common table expressions, comments, other alphabets; no view is left behind."""
    engine.sql("CREATE TABLE events (id INT, events STRING, kind STRING)")
    engine.sql("CREATE TABLE n.other (id INT)")
    engine.sql("INSERT INTO events VALUES (1, 'from events', 'a'), (2, 'x', 'b')")
    engine.sql("INSERT INTO n.other VALUES (2)")
    before = {t.name for t in spark.catalog.listTables()}
    assert rows(engine.sql("SELECT 'all from events, n.other' AS s")) == [("all from events, n.other",)]
    assert rows(engine.sql("SELECT events.events, '😀é from events' FROM events WHERE events = 'from events'")) == [("from events", "😀é from events")]
    assert rows(engine.sql("WITH events AS (SELECT 7 AS id) SELECT id FROM events")) == [(7,)]
    assert rows(engine.sql("WITH events AS (SELECT id + 10 AS id FROM events) SELECT events.id FROM events")) == [(11,), (12,)]
    assert rows(engine.sql("WITH a AS (SELECT id FROM events), other AS (SELECT id FROM n.other) SELECT a.id FROM a, other WHERE a.id = other.id")) == [(2,)]
    assert rows(engine.sql("SELECT e.id FROM events e WHERE EXISTS (SELECT 1 FROM n.other WHERE other.id = e.id) /* from nowhere */")) == [(2,)]
    assert rows(engine.sql("SELECT (SELECT max(id) FROM n.other) + events.id FROM events, LATERAL (SELECT 1) l")) == [(3,), (4,)]
    assert rows(engine.sql("SELECT events.id FROM events TABLESAMPLE (100 PERCENT)")) == [(1,), (2,)]
    assert rows(engine.sql("TABLE n.other")) == [(2,)] and rows(engine.sql("FROM n.other SELECT other.id")) == [(2,)]
    assert rows(engine.sql("SELECT a.id, b.id FROM events a JOIN events b ON a.id < b.id")) == [(1, 2)]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_sql_prunes_files(spark, engine):
    """A query reads only files its filters leave, by partition value and by statistics, and gives the same rows."""
    engine.sql("CREATE TABLE events (id BIGINT, kind STRING, day DATE, ts TIMESTAMP, d DECIMAL(9, 2)) PARTITION BY (kind)")
    for i, k in enumerate("abc"):
        engine.sql(f"INSERT INTO events SELECT id, '{k}', date_add(DATE '2024-01-01', {i}), timestamp_seconds({i} * 3600 + id), id * 9.5 FROM range({i * 100}, {i * 100 + 50})")

    def files(sql, **args):
        return len(engine.sql(sql, args=args or None).inputFiles())

    assert files("SELECT * FROM events") == 3
    for where, n in {
        "kind = 'a'": 1, "kind IN ('a', 'c')": 2, "kind > 'a' AND id < 120": 1, "day = DATE '2024-01-02'": 1, "ts >= TIMESTAMP '1970-01-01 01:00:00'": 2, "d > 1000.5": 2, "d > 99.99 AND d < 500": 1,
        "kind LIKE 'c%'": 1, "kind = 'a' OR (kind = 'b' AND id > 500)": 1, "(kind = 'a' OR id > 220) AND (kind = 'c' OR id < 3)": 2, "kind = 'a' OR length(kind) = 2": 3, "id IS NULL": 0, "upper(kind) = 'A'": 3, "id + 1 = 5": 3, "kind <> 'a'": 2,
    }.items():
        df = engine.sql(f"SELECT id FROM events e WHERE {where}")
        assert len(df.inputFiles()) <= n, where
        assert rows(df) == rows(spark.createDataFrame(engine.table("events").collect(), engine.table("events").schema).where(where).select("id")), where
    assert files("SELECT * FROM events WHERE kind = :k", k="b") == 1
    assert files("SELECT count(*) FROM events WHERE id = 3 UNION ALL SELECT count(*) FROM events WHERE id = 210") == 2
    assert rows(engine.sql("SELECT count(*) FROM events WHERE id = 3 UNION ALL SELECT count(*) FROM events")) == [(1,), (150,)]
    assert files("SELECT * FROM (SELECT * FROM events LIMIT 3) WHERE kind = 'a'") == 3
    assert rows(engine.sql("WITH e AS (SELECT * FROM events) SELECT a.id FROM e a JOIN e b ON a.id = b.id - 100 WHERE a.kind = 'a' AND b.kind = 'b' AND a.id < 2")) == [(0,), (1,)]
    h = engine.prepare("SELECT id FROM events WHERE id = :x")
    assert len(engine.execute(h, {"x": 110}).inputFiles()) == 1 and rows(engine.execute(h, {"x": 110})) == [(110,)]


def test_planning_is_tried_again(engine, monkeypatch):
    from tidemark.plans import binding

    engine.sql("CREATE TABLE t (x INT)")
    real, tries = binding.plan, []

    def flaky(*a):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return real(*a)

    monkeypatch.setattr(binding, "plan", flaky)
    assert engine.sql("SELECT x FROM t").count() == 0 and len(tries) == 3
    monkeypatch.setattr(binding, "plan", crash)
    with pytest.raises(OSError):
        engine.sql("SELECT x FROM t")


def test_arrow_results(engine):
    engine.sql("CREATE TABLE t (x INT, y STRING, ts TIMESTAMP)")
    assert engine.arrow("SELECT * FROM t").read_all().num_rows == 0
    engine.sql("INSERT INTO t VALUES (1, NULL, TIMESTAMP '2024-01-01 00:00:00'), (2, 'b', NULL), (3, 'c', NULL)")
    out = engine.arrow("SELECT * FROM t ORDER BY x", limit=2).read_all()
    assert out.column_names == ["x", "y", "ts"] and out.column("x").to_pylist() == [1, 2] and out.column("y").to_pylist() == [None, "b"]
    assert engine.arrow("SELECT y FROM t WHERE x > :n", args={"n": 2}).read_all().column("y").to_pylist() == ["c"]
    with pytest.raises(Exception, match="(?i)divi"):
        engine.arrow("SELECT 1 / (x - x) FROM t").read_all()
    assert sorted(engine.status().values()) == ["completed"] * 3 + ["failed"] and engine.metrics()["query_rows"] == 3
    assert engine.health() == {"live": True, "ready": True}


def test_tokens():
    from tidemark.plans import access as A

    key, claims = b"secret", {"sub": "user:a", "roles": ["reader"], "exp": 2000, "iss": "me", "aud": ["tables", "x"]}
    token = A.sign(claims, key)
    assert A.authenticate(f"Bearer {token}", key, "me", "tables", now=1000) == A.Principal("user:a", ("reader",))
    head, body, mac = token.split(".")
    none = A.base64.urlsafe_b64encode(b'{"alg":"none"}').rstrip(b"=").decode()
    for bad, k, issuer, audience, now in ((token, b"other", None, None, 1000), (token, key, "you", None, 1000), (token, key, None, "y", 1000), (token, key, None, None, 2000), (f"{none}.{body}.", key, None, None, 1), (f"{head}.{body}x.{mac}", key, None, None, 1), ("a.b", key, None, None, 1), (A.sign({"sub": "x"}, key), key, None, None, 1)):
        with pytest.raises(A.Unauthenticated):
            A.authenticate(bad, k, issuer, audience, now)


def test_rules_and_admission():
    from tidemark.plans import access as A

    rules = A.Rules([A.Rule("ops_*", "Admin", "Cluster"), A.Rule("*", "Query", "Table(secret.*)", allow=False), A.Rule("reader", "Query", "Table(*.events)"), A.Rule("writer", "*", "Table(shop.*)")])
    may = lambda role, action, resource: rules.check(A.Principal("p", (role,)), action, resource)
    for ok in (("ops_x", "Admin", "Cluster"), ("reader", "Query", "Table(a.events)"), ("writer", "Ingest", "Table(shop.t)"), ("writer", "DropTable", "Table(shop.t)")):
        may(*ok)
    for no in (("ops", "Admin", "Cluster"), ("reader", "Query", "Table(secret.events)"), ("reader", "Ingest", "Table(a.events)"), ("writer", "Query", "Table(shopping.t)"), ("writer", "CreateTable", "Namespace(shop)"), ("nobody", "Query", "Cluster")):
        with pytest.raises(A.Forbidden):
            may(*no)
    a, p = A.Admission(reads=2, writes=1, window=10, max_bytes=5), A.Principal("p")
    a.admit(p, "read", now=0)
    a.admit(p, "read", now=9)
    a.admit(p, "write", now=9)
    a.admit(A.Principal("q"), "read", now=9)
    with pytest.raises(A.TooManyRequests) as e:
        a.admit(p, "read", now=9.5)
    assert e.value.retry_after == 0.5
    a.admit(p, "read", now=10)
    with pytest.raises(C.InvalidArgument):
        a.admit(p, "write", size=6, now=20)
    for i in range(A.MAX_CALLERS + 500):  # callers beyond the bound share counters
        try:
            a.admit(A.Principal(f"c{i}"), "read", now=30)
        except A.TooManyRequests:
            assert i > A.MAX_CALLERS - 10
    assert len(a._used) <= A.MAX_CALLERS + A.SHARED


def test_guarded_engine(engine):
    from tidemark.plans import access as A

    rules = A.Rules([A.Rule("reader", "Query", "Table(shop.*)"), A.Rule("owner", resource="Table(shop.*)"), A.Rule("owner", "CreateTable", "Namespace(shop)"), A.Rule("owner", "Query", "Table(other.*)")])
    owner, reader = (A.Guarded(engine, A.Principal(r, (r,)), rules) for r in ("owner", "reader"))
    owner.sql("CREATE TABLE shop.t (x INT)")
    engine.sql("CREATE TABLE other.t (x INT)")
    engine.sql("INSERT INTO other.t VALUES (5)")
    owner.sql("INSERT INTO shop.t SELECT x FROM other.t")
    owner.json("shop.t", {"x": 6})
    assert owner.flush("shop.t") == "flushed" and owner.maintain("shop.t")["compacted"] == 2
    assert rows(reader.sql("SELECT x FROM shop.t")) == [(5,), (6,)] and reader.rows("SELECT max(x) AS m FROM shop.t") == ['{"m":6}']
    assert reader.arrow("SELECT x FROM shop.t WHERE x > 5").read_all().num_rows == 1
    for no in ("SELECT x FROM other.t", "SELECT (SELECT max(x) FROM other.t) FROM shop.t", "WITH t AS (SELECT * FROM other.t) SELECT * FROM t", "INSERT INTO shop.t VALUES (1)", "DROP TABLE shop.t", "CREATE TABLE shop.u (x INT)", "SELECT 1", "DESCRIBE other.t", "SHOW TABLES"):
        with pytest.raises(A.Forbidden):
            reader.sql(no)
    for call in (lambda: reader.json("shop.t", {"x": 1}), lambda: reader.flush("shop.t"), lambda: reader.maintain("shop.t"), lambda: reader.metrics(), lambda: owner.sql("CREATE TABLE other.u (x INT)"), lambda: owner.sql("INSERT INTO other.t SELECT x FROM shop.t")):
        with pytest.raises(A.Forbidden):
            call()
    assert rows(engine.sql("SELECT x FROM shop.t")) == [(5,), (6,)]


def test_maintenance_loop(spark, engine):
    engine.create_from("t", spark.range(3).coalesce(1))
    for i in range(3):
        append(engine.catalog, ("default", "t"), spark.range(i, i + 1))
    stop = engine.maintain_every(["t", "none"], 0.2, max_age=0, keep_last=1, min_age=0)
    import time

    for _ in range(100):
        time.sleep(0.2)
        state = engine.catalog.load(("default", "t"))
        if len(state.snapshot()["files"]) == 1 and len(state.state["snapshots"]) == 1:
            break
    errors = stop()
    assert len(engine.catalog.load(("default", "t")).snapshot()["files"]) == 1 and engine.table("t").count() == 6 and errors and all(e.startswith("none") for e in errors)


def test_dotted_columns(engine):
    engine.ingest.json("e", [{"customer": {"id": 1, "tier": "gold"}, "amount": 2.5}, {"customer": {"id": 2}, "amount": 1}])
    engine.ingest.flush("e")
    assert rows(engine.sql("SELECT `customer.id`, amount FROM e")) == [(1, 2.5), (2, 1.0)]
    engine.ingest.json("e", {"customer.id": 3, "customer": {"tier": "x"}, "amount": 0})
    engine.ingest.flush("e")
    assert rows(engine.sql("SELECT `customer.id`, `customer.tier` FROM e WHERE amount = 0")) == [(3, "x")]


def test_streaming_batches_commit_once(spark, engine, tmp_path):
    engine.sql("CREATE TABLE t (a INT)")
    spark.createDataFrame([(1,), (2,)], "a int").write.json(f"file://{tmp_path}/in")
    for _ in range(2):
        engine.ingest.stream("t", f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination()
    assert rows(engine.table("t")) == [(1,), (2,)]
    # the batch runs again as if its checkpoint entry had not been written, after its snapshot has gone
    import shutil

    append(engine.catalog, ("default", "t"), spark.createDataFrame([(9,)], "a int"))
    maintain.expire(engine.catalog, ("default", "t"), max_age=0)
    shutil.rmtree(tmp_path / "cp" / "commits")
    engine.ingest.stream("t", f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination()
    assert rows(engine.table("t")) == [(1,), (2,), (9,)]


def _files(engine, ident):
    return engine.catalog.load(ident).snapshot()["files"]


def _shuffled(spark, job):
    """What a job returns, and the most bytes a stage of it wrote for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    out = job()
    return out, max((n for i, n in stages().items() if i not in before), default=0)


def test_sets_of_files_that_a_task_reads():
    sizes = [5, 5, 40, 90, 60, 60, 300, 1, 0, 0, 100]
    files = [{"path": f"f{i}", "bytes": n} for i, n in enumerate(sizes)]
    sets = maintain.bins(files, 100)
    assert sorted(f["path"] for b in sets for f in b) == sorted(f["path"] for f in files)
    assert all(b and (len(b) == 1 or sum(f["bytes"] for f in b) <= 100) for b in sets) and [files[6]] in sets and len(sets) == 5
    assert maintain.bins(files[:1], 100) == [files[:1]] and len(maintain.bins([files[8], files[9], files[6]], 100)) == 2


def test_compaction_reads_its_files_without_a_shuffle(spark, engine):
    engine.create_from("t", spark.range(0, 600_000, 1, 12))
    ident = ("default", "t")
    before = [f["bytes"] for f in _files(engine, ident)]
    rule = maintain.Selection(target_bytes=5 * max(before))
    replaced, written = _shuffled(spark, lambda: maintain.compact(engine.catalog, ident, rule))
    assert replaced == 12 and written < 50_000  # paths of files only
    # one file a set, written by a task of its own
    assert len(_files(engine, ident)) == -(-sum(before) // rule.target_bytes) > 1 and all(f["bytes"] <= 1.1 * rule.target_bytes for f in _files(engine, ident))
    assert rows(engine.table("t")) == [(i,) for i in range(600_000)]
    assert spark.conf.get("spark.sql.unionOutputPartitioning", None) is None


@pytest.mark.parametrize("how", ["plain", "sorted", "deletes"])
def test_compaction_takes_no_more_rows_to_a_task_than_a_file_holds(spark, engine, monkeypatch, how):
    engine.create_from("t", spark.range(0, 6000, 1, 6), sort=[("id", True)] if how == "sorted" else ())
    ident = ("default", "t")
    if how == "deletes":
        scan.delete_where(engine.catalog, ident, [("id", "<", 700)])
    seen = []
    write = maintain.write_files

    def watched(*args, pieces, **kw):
        seen.append(pieces)
        return write(*args, pieces=pieces, **kw)

    monkeypatch.setattr(maintain, "write_files", watched)
    monkeypatch.setattr(maintain, "MAX_RECORDS_PER_FILE", 2500)
    assert maintain.compact(engine.catalog, ident) == 6
    assert rows(engine.table("t")) == [(i,) for i in range(700 if how == "deletes" else 0, 6000)]
    assert len(_files(engine, ident)) == (1 if how == "plain" else 3) and not engine.catalog.load(ident).snapshot()["deletes"]
    assert seen == [3]
