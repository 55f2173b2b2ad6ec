"""A snapshot as a DataFrame: pruned files, without deleted positions.

The list of files is fixed when the DataFrame is made, so a later commit doesn't
change it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, InvalidArgument, Table
from .prune import Predicate, prune


def condition(predicates: list[Predicate]) -> Column:
    """The conjunction as a column."""
    makes = {
        "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
        "in": lambda c, v: c.isin(*v), "is null": lambda c, _: c.isNull(), "is not null": lambda c, _: c.isNotNull(),
    }
    return reduce(lambda a, b: a & b, [makes[op](F.col(f"`{c}`"), v) for c, op, v in predicates], F.lit(True))


def check_deletes(raw: DataFrame) -> None:
    """Null or empty paths and null or negative positions are errors."""
    if raw.where("file_path is null or file_path = '' or pos is null or pos < 0").limit(1).count():
        raise InvalidArgument("a position delete needs a path and a position from 0 on")


def read_deletes(catalog: Catalog, deletes: list[dict], data_paths: list[str]) -> DataFrame:
    """(path, pos), each once, of position-delete files; path is a data file's.

    A file_path matches a data file exactly, or as the end of its path after a
    slash.  Positions are checked here unless that was done when they were added.
    """
    reader = catalog.spark.read.schema("file_path string, pos long")
    if unchecked := [d["path"] for d in deletes if not d.get("checked")]:
        check_deletes(reader.parquet(*unchecked))
    raw = reader.parquet(*[d["path"] for d in deletes])
    # paths that match have the same last part
    data = catalog.spark.createDataFrame([(p, p.rsplit("/", 1)[-1]) for p in data_paths], "path string, base string")
    met = raw.withColumn("base", F.substring_index("file_path", "/", -1)).join(data, "base")
    return met.where((F.col("path") == F.col("file_path")) | F.col("path").endswith(F.concat(F.lit("/"), "file_path"))).select("path", "pos").distinct()


def scan(catalog: Catalog, ident, predicates: list[Predicate] = (), snapshot_id: int | None = None, table: Table | None = None, any_of: list[list[Predicate]] | None = None) -> DataFrame:
    """The rows of a snapshot (the current one if not named) that pass the predicates.

    any_of leaves out files none of whose rows meets one of these conjunctions,
    without filtering rows.
    """
    table = table or catalog.load(ident)
    snapshot = table.snapshot(snapshot_id)
    files = prune(snapshot["files"], table.partitions, list(predicates)) if snapshot else []
    if any_of is not None:
        kept = {f["path"] for p in any_of for f in prune(files, table.partitions, p)}
        files = [f for f in files if f["path"] in kept]
    if any(d.get("content") == "equality" for d in (snapshot or {"deletes": []})["deletes"]):
        raise NotImplementedError("equality deletes are not supported")
    if not files:
        return catalog.spark.createDataFrame([], table.schema)
    deletes = snapshot["deletes"]
    marked = {p for d in deletes for p in d.get("targets", [f["path"] for f in files])}
    clean = [f["path"] for f in files if f["path"] not in marked]
    touched = [f["path"] for f in files if f["path"] in marked]
    reader = catalog.spark.read.schema(table.schema)
    parts = [reader.parquet(*clean)] if clean else []
    if touched:
        rows = reader.parquet(*touched).select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__pos"))
        gone = read_deletes(catalog, deletes, touched).toDF("__path", "__pos")
        parts.append(rows.join(gone, ["__path", "__pos"], "left_anti").drop("__path", "__pos"))
    df = reduce(DataFrame.unionByName, parts)
    return df.where(condition(list(predicates))) if predicates else df


def delete_where(catalog: Catalog, ident, predicates: list[Predicate]) -> Table:
    """Deletes rows by writing their positions; data files stay as they are."""
    table = catalog.load(ident)
    snapshot = table.snapshot()
    files = prune(snapshot["files"], table.partitions, list(predicates)) if snapshot else []
    if not files:
        return table
    rows = catalog.spark.read.schema(table.schema).parquet(*[f["path"] for f in files])
    hit = rows.where(condition(list(predicates))).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    return add_deletes(catalog, ident, hit, snapshot["id"])


def add_deletes(catalog: Catalog, ident, positions: DataFrame, base: int | None = None) -> Table:
    """Commits (file_path, pos) rows as a position-delete file set."""
    folder = f"{catalog.location(ident)}/data/deletes-{uuid.uuid4().hex}"
    positions.select("file_path", F.col("pos").cast("long")).write.parquet(folder)
    written = catalog.spark.read.schema("file_path string, pos long").parquet(folder)
    count = written.count()
    if not count:
        catalog.store.delete(folder)
        return catalog.load(ident)
    try:
        check_deletes(written)
    except InvalidArgument:
        catalog.store.delete(folder)
        raise
    snapshot = catalog.load(ident).snapshot()
    by_name: dict[str, list[str]] = {}
    for f in snapshot["files"] if snapshot else []:
        by_name.setdefault(f["path"].rsplit("/", 1)[-1], []).append(f["path"])
    targets = set()
    for r in written.select("file_path").distinct().toLocalIterator():  # one a data file and spelling
        targets.update(p for p in by_name.get(r.file_path.rsplit("/", 1)[-1], ()) if p == r.file_path or p.endswith("/" + r.file_path))
    return catalog.commit_snapshot(ident, "delete", [], base=base, deletes=[{"path": folder, "rows": count, "content": "position", "targets": sorted(targets), "checked": True}])
