"""Writing data files and what the catalog keeps about them.

Row, null and value statistics come from the footers of the files just written,
read in tasks; only where pyarrow can't reach a file system, or a footer leaves
out a partition's value, is data read again.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import transforms
from .catalog import Catalog, InvalidArgument, Table

#: Names of codecs and what Spark calls them.
CODECS = {"none": "none", "snappy": "snappy", "gzip": "gzip", "lz4_raw": "lz4_raw", "zstd": "zstd", "lzo": "lzo", "brotli": "brotli"}
MAX_RECORDS_PER_FILE = 8 << 20
_BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.BooleanType)


def conform(df: DataFrame, table: Table) -> DataFrame:
    """df with the table's columns in their order and types; columns it lacks are null, others are left out.

    Field ids go along as metadata and so into the files.
    """
    have = set(df.columns)
    ids = {c["name"]: {"parquet.field.id": c["id"]} for c in table.state["columns"]}
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name, metadata=ids[f.name]) for f in table.schema])


def check_rows(df: DataFrame, table: Table) -> None:
    """Raises InvalidArgument if a NOT NULL column holds a null; one aggregation for all of them."""
    needed = [c["name"] for c in table.state["columns"] if not c["nullable"]]
    if needed:
        row = df.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(f"c{i}") for i, n in enumerate(needed)]).first()
        _refuse([n for n, x in zip(needed, row) if x])


def _refuse(columns: list[str]) -> None:
    if columns:
        raise InvalidArgument(f"null in NOT NULL column {', '.join(columns)}")


def _plain(value):
    return value if value is None or isinstance(value, (bool, int, float, str)) else value.isoformat() if hasattr(value, "isoformat") else str(value)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def _uri(path: str) -> str:
    """A path of Hadoop's as pyarrow spells it."""
    return re.sub(r"^file:/(?!/)", "file:///", path)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, json): rows, and by column its nulls, least and greatest value as far as the footer has them; times as microseconds."""

    def plain(v):
        if isinstance(v, datetime.datetime):
            return round((v if v.tzinfo else v.replace(tzinfo=datetime.timezone.utc)).timestamp() * 1_000_000)
        return v if v is None or isinstance(v, (bool, int, float, str)) else None if isinstance(v, bytes) else str(v)

    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            fs, at = _filesystem(path)
            with fs.open_input_file(at) as f:
                meta = pq.read_metadata(f)
            columns: dict[str, list] = {}
            for g in range(meta.num_row_groups):
                for i in range(meta.num_columns):
                    c = meta.row_group(g).column(i)
                    s = c.statistics
                    known = columns.setdefault(c.path_in_schema, [0, None, None, True])
                    known[0] = known[0] + s.null_count if s is not None and s.has_null_count and known[0] is not None else None
                    if s is not None and s.has_min_max:
                        known[1] = s.min if known[1] is None else min(known[1], s.min)
                        known[2] = s.max if known[2] is None else max(known[2], s.max)
                    elif not (s is not None and s.has_null_count and s.null_count == c.num_values):
                        known[3] = False  # values without bounds
            out.append(json.dumps({"rows": meta.num_rows, "columns": {k: [n, plain(lo) if ok else None, plain(hi) if ok else None] for k, (n, lo, hi, ok) in columns.items()}}))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "footer"])


def _typed(value, kind: T.DataType):
    """A footer's value as Spark hands out values of this type."""
    if value is None:
        return None
    if isinstance(kind, T.TimestampType):
        return datetime.datetime.fromtimestamp(value // 1_000_000).replace(microsecond=value % 1_000_000)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(value)
    return decimal.Decimal(value) if isinstance(kind, T.DecimalType) else value


def file_entries(spark, schema: T.StructType, parts: list[transforms.Transform], found: list[tuple[str, int]]) -> list[dict]:
    """One entry a file (path, bytes): path, bytes, rows, per column nulls and bounds, and the values of its partition."""
    if not found:
        return []
    try:
        _filesystem(_uri(found[0][0]))
    except (pa.ArrowInvalid, OSError):
        return _read_again(spark, schema, parts, dict(found))
    kinds = {f.name: f.dataType for f in schema}
    paths = spark.createDataFrame([(_uri(p),) for p, _ in found], "path string").repartition(min(len(found), 4 * spark.sparkContext.defaultParallelism))
    footers = {r.path: json.loads(r.footer) for r in paths.mapInArrow(_footers, "path string, footer string").collect()}  # one row a file just written
    out, values, again = [], [], []
    for i, (path, size) in enumerate(sorted(found)):
        f = footers[_uri(path)]
        none = [0 if not f["rows"] else None, None, None]
        columns = {c.name: f["columns"].get(c.name, none) for c in schema}
        bounds = {c.name: [_plain(_typed(x, c.dataType)) for x in columns[c.name][1:]] for c in schema if isinstance(c.dataType, _BOUNDED)}
        out.append({"path": path, "bytes": size, "rows": f["rows"], "nulls": {k: v[0] for k, v in columns.items() if v[0] is not None}, "bounds": bounds, "partition": {}})
        # all rows of a file have one partition, so any value of its column will do
        if any(columns[t.column][1] is None and columns[t.column][0] != f["rows"] for t in parts):
            again.append(i)
        else:
            values.append((i, *(_typed(columns[n][1], kinds[n]) for n in dict.fromkeys(t.column for t in parts))))
    if parts and values:
        names = list(dict.fromkeys(t.column for t in parts))
        small = spark.createDataFrame(values, T.StructType([T.StructField("__file", T.IntegerType()), *(T.StructField(n, kinds[n]) for n in names)]))
        for r in small.select("__file", *[transforms.value_of(t, kinds[t.column]).alias(f"p{i}") for i, t in enumerate(parts)]).collect():
            out[r["__file"]]["partition"] = {t.name: _plain(r[f"p{i}"]) for i, t in enumerate(parts)}
    if again:
        read = {e["path"]: e for e in _read_again(spark, schema, parts, {out[i]["path"]: out[i]["bytes"] for i in again})}
        for i in again:
            out[i]["partition"] = read[out[i]["path"]]["partition"]
    return out


def _read_again(spark, schema: T.StructType, parts: list[transforms.Transform], sizes: dict[str, int]) -> list[dict]:
    """The same entries from the files' rows."""
    df = spark.read.schema(schema).parquet(*sizes).withColumn("__file", F.col("_metadata.file_path"))
    bounded = [f for f in schema if isinstance(f.dataType, _BOUNDED)]
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(schema):
        aggs.append(F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}"))
    for i, f in enumerate(bounded):
        aggs += [F.min(f"`{f.name}`").alias(f"a{i}"), F.max(f"`{f.name}`").alias(f"b{i}")]
    kinds = {f.name: f.dataType for f in schema}
    aggs += [F.first(transforms.value_of(t, kinds[t.column])).alias(f"p{i}") for i, t in enumerate(parts)] if all(t.kind != "bucket" for t in parts) else []
    if any(t.kind == "bucket" for t in parts):
        df = df.withColumns({f"__p{i}": transforms.value_of(t, kinds[t.column]) for i, t in enumerate(parts)})
        aggs += [F.first(f"__p{i}").alias(f"p{i}") for i in range(len(parts))]
    out = []
    for r in df.groupBy("__file").agg(*aggs).collect():  # one row a file just written
        out.append({
            "path": r["__file"], "bytes": sizes.get(r["__file"], 0), "rows": r["rows"], "nulls": {f.name: r[f"n{i}"] for i, f in enumerate(schema)},
            "bounds": {f.name: [_plain(r[f"a{i}"]), _plain(r[f"b{i}"])] for i, f in enumerate(bounded)}, "partition": {t.name: _plain(r[f"p{i}"]) for i, t in enumerate(parts)},
        })
    return sorted(out, key=lambda x: x["path"])


def write_files(catalog: Catalog, ident, df: DataFrame, table: Table | None = None, codec: str = "zstd", pieces: int | None = None) -> list[dict]:
    """Writes df (conformed) as the table's data files and returns their entries; nothing is visible before a commit.

    Rows of one partition value are brought together, so each value gets few
    files; a value with much data is split over tasks again.  Each file is sorted
    by the table's order.  pieces: df holds one partition value, written by
    its own tasks, or, if the table has an order, by so many, each a range of it.
    A null in a NOT NULL column is found in the written footers; then the files go
    and InvalidArgument is raised.
    """
    table = table or catalog.load(ident)
    if codec not in CODECS:
        raise InvalidArgument(f"unknown codec {codec}")
    catalog.spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # the other has no bounds
    parts, kinds = table.partitions, {f.name: f.dataType for f in table.schema}
    folder = f"{catalog.location(ident)}/data/{uuid.uuid4().hex}"
    order = [F.col(f"`{c}`").desc_nulls_last() if desc else F.col(f"`{c}`").asc_nulls_first() for c, desc in table.state["sort"]]
    # one folder a combination of values, named by a digest: values may hold what paths can't
    derived, out = [], df
    if parts:
        values = F.to_json(F.struct(*[transforms.value_of(t, kinds[t.column]).alias(f"v{i}") for i, t in enumerate(parts)]))
        derived = ["part" if "part" not in kinds else "__part"]
        out = df.withColumn(derived[0], F.substring(F.sha2(values, 256), 1, 32))
    if pieces:
        out = out.repartitionByRange(pieces, *order) if order else out
    elif derived:
        out = out.hint("rebalance", F.col(derived[0]))
    if derived or order:
        out = out.sortWithinPartitions(*derived, *order)
    writer = out.write.option("compression", CODECS[codec]).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    (writer.partitionBy(*derived) if derived else writer).parquet(folder)
    entries = file_entries(catalog.spark, table.schema, parts, [(p, n) for p, n, _ in catalog.store.files(folder) if p.endswith(".parquet")])
    try:
        needed = [c["name"] for c in table.state["columns"] if not c["nullable"]]
        _refuse([n for n in needed if any(e["nulls"].get(n) for e in entries)])
        if unsure := [e["path"] for e in entries if any(n not in e["nulls"] for n in needed)]:
            check_rows(catalog.spark.read.schema(table.schema).parquet(*unsure), table)
    except InvalidArgument:
        catalog.store.delete(folder)
        raise
    return entries


def append(catalog: Catalog, ident, df: DataFrame, commit_id: str | None = None, also=None) -> Table:
    """df as a new snapshot of the table."""
    table = catalog.load(ident)
    return catalog.commit_snapshot(ident, "append", write_files(catalog, ident, conform(df, table), table), commit_id=commit_id, also=also)


def same_columns(df: DataFrame, table: Table) -> None:
    """Raises InvalidArgument unless df has the table's columns, in order, with its types (the strict form of ingest)."""
    want = [(f.name, f.dataType) for f in table.schema]
    have = [(f.name, f.dataType) for f in df.schema]
    if len(want) != len(have):
        raise InvalidArgument(f"{len(have)} columns, the table has {len(want)}")
    for (a, x), (b, y) in zip(want, have):
        if a != b or x != y:
            raise InvalidArgument(f"column {b} {json.dumps(y.simpleString())} does not match {a} {json.dumps(x.simpleString())}")
