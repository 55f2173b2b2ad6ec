"""JSON and DataFrame ingest: staged first, visible after a flush.

``ingest`` flattens, conforms and checks rows and writes them to the table's
staging folder (they survive a restart there); ``flush`` commits everything
staged as one snapshot.  ``stream`` does the same with a Structured Streaming
query over a folder of JSON lines.

Rows are committed once, whatever fails and whoever flushes:

* a request with an idempotency key counts only once its batch is written; the
  first batch to be entered for the key is the key's, later ones are duplicates,
  and while one is being written others are told so (``InProgress``);
* the commit that makes batches visible enters their names in the table's state,
  at once and by compare and set, and fails if one of them was committed by
  another.  A name goes from there only when its staged folder is gone;
* what a flush has written is noted (``prepared``) before the commit, so after an
  unknown outcome the next flush finds out, and commits the same files if need be;
* a stream's last batch stands in the table's state, under its checkpoint.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..sources.catalog import Catalog, Conflict, InvalidArgument, NotFound, columns_of, resolve

KEY_HOURS = 24
MAX_KEYS = 100_000
#: A request that has claimed its key counts as under way for so long.
CLAIM_SECONDS = 300


@dataclass(frozen=True)
class Receipt:
    batch: str
    rows: int
    duplicate: bool = False


def normalise(body) -> tuple[list[dict], str | None]:
    """(rows, idempotency key) of a request: one object, a list of them, or {"rows": [...], "idempotency_key": ...}."""
    body = json.loads(body) if isinstance(body, (str, bytes)) else body
    key = None
    if isinstance(body, dict) and isinstance(body.get("rows"), list):
        body, key = body["rows"], body.get("idempotency_key")
    rows = body if isinstance(body, list) else [body]
    if not rows:
        raise InvalidArgument("no rows")
    if not all(isinstance(r, dict) for r in rows):
        raise InvalidArgument("rows must be objects")
    return rows, key


def flatten(row: dict, prefix: str = "") -> dict:
    """Nested objects as dotted names; lists as compact JSON text; all else as it is."""
    out = {}
    for k, v in row.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out.update(flatten(v, f"{name}."))
        else:
            out[name] = json.dumps(v, separators=(",", ":"), ensure_ascii=False) if isinstance(v, list) else v
    return out


def flatten_columns(df: DataFrame) -> DataFrame:
    """The same for a DataFrame: struct fields as dotted columns, arrays and maps as JSON text."""

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name), f.dataType

    cols = []
    for path, kind in leaves(df.schema):
        c = F.col(".".join(f"`{p}`" for p in path))
        cols.append((F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType)) else c).alias(".".join(path)))
    return df.select(*cols)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[1]


class Backpressure(RuntimeError):
    """More is staged than a table may hold; flush first."""


class InProgress(RuntimeError):
    """Another request with this idempotency key is under way."""


class FlushBlocked(RuntimeError):
    """A commit's outcome is unknown; ``recheck`` or the next flush finds out."""


class Ingest:
    """soft_bytes of staged data make the next request flush by itself; beyond hard_bytes requests are refused."""

    def __init__(self, catalog: Catalog, soft_bytes: int = 384 << 20, hard_bytes: int = 512 << 20):
        self.catalog, self.spark, self.soft_bytes, self.hard_bytes = catalog, catalog.spark, soft_bytes, hard_bytes
        self.counts: Counter[str] = Counter()

    def _staging(self, ident) -> str:
        return f"{self.catalog.location(ident)}/staging"

    def _lines(self, rows: list[dict]) -> list[str]:
        return [json.dumps(flatten(r), ensure_ascii=False) for r in rows]

    def json(self, name: str, body) -> Receipt:
        """Rows of a request; a table that isn't there is made from what they look like.

        An existing table's columns rule: unknown fields are passed over, and a value
        that can't be read as its column's type rejects the whole request.
        """
        rows, key = normalise(body)
        ident = resolve(name)
        lines = self._lines(rows)
        df = self.spark.createDataFrame([(x,) for x in lines], "line string")
        try:
            table = self.catalog.load(ident)
        except NotFound:
            schema = infer([flatten(r) for r in rows])
            self.catalog.create_table(ident, columns_of(schema), if_not_exists=True)
            table = self.catalog.load(ident)
        return self._stage(ident, parse_lines(df, table.schema), key, len(rows))

    def frame(self, name: str, df: DataFrame, strict: bool = True, key: str | None = None) -> Receipt:
        """A DataFrame (or, made into one, an Arrow table); strict: with exactly the table's columns."""
        ident = resolve(name)
        table = self.catalog.load(ident)
        if strict:
            files.same_columns(df, table)
        return self._stage(ident, df, key, None)

    def arrow(self, name: str, data, key: str | None = None) -> Receipt:
        """A pyarrow Table, with exactly the table's columns."""
        return self.frame(name, self.spark.createDataFrame(data), key=key)

    # idempotency keys: keys/<digest>/claim-<n> and done-<n>, each created once; n goes up when a key has expired

    def _keys(self, ident) -> str:
        return f"{self.catalog.location(ident)}/keys"

    def purge_keys(self, name: str) -> int:
        """Forgets idempotency keys older than KEY_HOURS, and the oldest beyond MAX_KEYS; not those of staged batches."""
        ident = resolve(name)
        staged = {p.rsplit(".", 2)[1] for p in self._staged(ident) if p.endswith(".k")}
        newest: dict[str, float] = {}
        for path, _, modified in self.catalog.store.files(self._keys(ident)):
            key = path.rsplit("/", 1)[0]
            newest[key] = max(modified, newest.get(key, 0.0))
        keys = sorted(newest.items(), key=lambda k: -k[1])
        old = [k for i, (k, at) in enumerate(keys) if (i >= MAX_KEYS or time.time() - at > KEY_HOURS * 3600) and k.rsplit("/", 1)[1] not in staged]
        for path in old:
            self.catalog.store.delete(path)
        return len(old)

    def _newest(self, folder: str, kind: str) -> tuple[int, dict] | None:
        """The highest n of <kind>-<n> in a key's folder, and what it holds."""
        found = [int(p.rsplit("-", 1)[1].removesuffix(".json")) for p, *_ in self.catalog.store.list(folder) if f"/{kind}-" in p]
        return (max(found), json.loads(self.catalog.store.read(f"{folder}/{kind}-{max(found)}.json"))) if found else None

    def _claim(self, ident, digest: str) -> tuple[int, str | None]:
        """(n, the batch that has used the key in the last KEY_HOURS or None after claiming it); InProgress if another claim is young."""
        folder, now = f"{self._keys(ident)}/{digest}", time.time()
        done, claim = self._newest(folder, "done"), self._newest(folder, "claim")
        if done and now - done[1]["at"] < KEY_HOURS * 3600:
            return done[0], done[1]["batch"]
        n = done[0] + 1 if done else 0
        if claim and claim[0] >= n and now - claim[1]["at"] < CLAIM_SECONDS:
            raise InProgress("a request with this idempotency key is under way")
        # a claim that ran out is followed by the next number; done-<n> of any of them decides
        n = max(n, claim[0] + 1 if claim else 0)
        try:
            self.catalog.store.create(f"{folder}/claim-{n}.json", json.dumps({"at": now}))
        except Conflict:
            raise InProgress("a request with this idempotency key is under way") from None
        return n, None

    def _enter(self, ident, digest: str, n: int, batch: str) -> str:
        """The batch that has the key: this one, or one that was entered before."""
        folder = f"{self._keys(ident)}/{digest}"
        done = self._newest(folder, "done")
        if done and time.time() - done[1]["at"] < KEY_HOURS * 3600:
            return done[1]["batch"]
        # one name for all claims since the last expiry, so that only one can be entered
        slot = done[0] + 1 if done else 0
        try:
            self.catalog.store.create(f"{folder}/done-{slot}.json", json.dumps({"batch": batch, "at": time.time()}))
            return batch
        except Conflict:
            return json.loads(self.catalog.store.read(f"{folder}/done-{slot}.json"))["batch"]

    def _stage(self, ident, df: DataFrame, key: str | None, rows: int | None) -> Receipt:
        table = self.catalog.load(ident)
        batch = uuid.uuid4().hex
        staged = sum(size for _, size, _ in self.catalog.store.files(self._staging(ident)))
        if staged >= self.hard_bytes:
            raise Backpressure(f"{staged} bytes are staged for {'.'.join(ident)}")
        if staged >= self.soft_bytes:
            self.flush(".".join(ident))
        digest = n = None
        if key is not None:
            digest = hashlib.sha256(key.encode()).hexdigest()
            n, known = self._claim(ident, digest)
            if known:
                self.counts["duplicates"] += 1
                return Receipt(known, rows or 0, True)
        path = f"{self._staging(ident)}/{int(time.time() * 1e6):020d}-{batch}" + (f".{digest}.k" if digest else "")
        try:
            files.conform(df, table).write.parquet(path)
            written = self.spark.read.schema(table.schema).parquet(path)
            files.check_rows(written, table)
        except Exception as e:
            self.catalog.store.delete(path)
            if digest:
                self.catalog.store.delete(f"{self._keys(ident)}/{digest}/claim-{n}.json")
            if "MALFORMED_RECORD_IN_PARSING" in str(e):
                raise InvalidArgument("a row does not fit the table's columns") from e
            raise
        if digest and (first := self._enter(ident, digest, n, batch)) != batch:
            self.catalog.store.delete(path)
            return Receipt(first, rows or 0, True)
        rows = rows if rows is not None else written.count()
        self.counts["requests"] += 1
        self.counts["rows"] += rows
        return Receipt(batch, rows)

    def _staged(self, ident) -> list[str]:
        return sorted(p for p, folder, _, _ in self.catalog.store.list(self._staging(ident)) if folder)

    def pending(self, name: str) -> list[str]:
        """Staged batches in their order; only complete ones, and of those with a key only the key's own."""
        ident = resolve(name)
        done: dict[str, set[str]] = {}

        def entered(path: str) -> bool:
            if not path.endswith(".k"):
                return True
            batch, digest = path.rsplit("/", 1)[1].split("-", 1)[1].split(".")[:2]
            if digest not in done:
                folder = f"{self._keys(ident)}/{digest}"
                done[digest] = {json.loads(self.catalog.store.read(p))["batch"] for p, *_ in self.catalog.store.list(folder) if "/done-" in p}
            return batch in done[digest]

        return [p for p in self._staged(ident) if self.catalog.store.exists(f"{p}/_SUCCESS") and entered(p)]

    def flush(self, name: str) -> str:
        """Commits what is staged; "flushed" or "no_pending_data". FlushBlocked if it isn't known whether it did."""
        ident, store = resolve(name), self.catalog.store
        for _ in range(20):
            self._resolve(ident)
            table = self.catalog.load(ident)
            batches = [b for b in self.pending(name) if _name(b) not in table.state.get("ingested", {})]
            if not batches:
                return "no_pending_data"
            df = self.spark.read.schema(table.schema).parquet(*batches)
            note = f"{self.catalog.location(ident)}/prepared/{uuid.uuid4().hex}.json"
            written = files.write_files(self.catalog, ident, df, table)
            store.create(note, json.dumps({"batches": batches, "files": written}))
            if self._commit(ident, note, batches, written):
                self.counts["flushes"] += 1
                return "flushed"
        raise Conflict(f"{name}: other writers came first 20 times")

    def _commit(self, ident, note: str, batches: list[str], written: list[dict]) -> bool:
        """Commits written files of staged batches and clears up; False if another flush has committed one of the batches.

        Files that are not committed are left to the sweep.
        """
        store, names = self.catalog.store, [_name(b) for b in batches]

        def also(state: dict) -> dict:
            known = state.get("ingested", {})
            if set(known) & set(names) or not all(store.exists(f"{b}/_SUCCESS") for b in batches):
                raise Conflict("committed by another")
            still = {n: by for n, by in known.items() if store.exists(f"{self._staging(ident)}/{n}")}
            return state | {"ingested": still | dict.fromkeys(names, _name(note))}

        try:
            self.catalog.commit_snapshot(ident, "append", written, also=also)
            done = True
        except Conflict:
            known = self.catalog.load(ident).state.get("ingested", {})
            done = all(known.get(n) == _name(note) for n in names)  # by one who found the note
        except Exception as e:
            raise FlushBlocked(f"{'.'.join(ident)}: {e}") from e
        store.delete(note)
        for b in batches if done else ():
            store.delete(b)
        return done

    def _resolve(self, ident) -> int:
        """Settles flushes that ended between writing and clearing up; returns how many."""
        store, settled = self.catalog.store, 0
        for path, *_ in list(store.files(f"{self.catalog.location(ident)}/prepared")):
            try:
                note = json.loads(store.read(path))
            except Exception:  # noqa: BLE001  its owner was faster
                continue
            self._commit(ident, path, note["batches"], note["files"])
            settled += 1
        # batches that were committed but not deleted
        for name in self.catalog.load(ident).state.get("ingested", {}):
            if store.exists(f"{self._staging(ident)}/{name}"):
                store.delete(f"{self._staging(ident)}/{name}")
        return settled

    def recheck(self, name: str) -> int:
        """Finds out about commits of unknown outcome; returns how many there were."""
        return self._resolve(resolve(name))

    def stream(self, name: str, source: str, checkpoint: str, available_now: bool = True, max_files: int = 100, interval: str = "10 seconds") -> StreamingQuery:
        """A streaming query that appends the JSON lines of a folder; each micro-batch is one commit, made once.

        The last batch's id stands in the table's state under the query's checkpoint,
        so a batch that runs again after a failure is known, however old its snapshot
        is.  max_files bounds a batch.
        """
        ident = resolve(name)
        table = self.catalog.load(ident)

        def commit(df: DataFrame, batch_id: int) -> None:
            def also(state: dict) -> dict | None:
                streams = state.get("streams", {})
                return state | {"streams": streams | {checkpoint: batch_id}} if streams.get(checkpoint, -1) < batch_id else None

            if also(self.catalog.load(ident).state) is None:
                return
            rows = parse_lines(df.select(F.col("value").alias("line")), table.schema)
            if rows.limit(1).count():
                files.append(self.catalog, ident, rows, also=also)

        lines = self.spark.readStream.option("maxFilesPerTrigger", max_files).text(source)
        writer = lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def parse_lines(df: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON lines (flat or nested) read by a table's schema; fails where a value does not fit."""
    flat = [f for f in schema if "." not in f.name]
    dotted = [f for f in schema if "." in f.name]
    # a dotted column may come flat or nested
    nested: dict = {}
    for f in dotted:
        at = nested
        *path, last = f.name.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = f.dataType

    def struct(tree: dict) -> T.StructType:
        return T.StructType([T.StructField(k, struct(v) if isinstance(v, dict) else v) for k, v in tree.items()])

    taken = {f.name for f in flat}
    wide = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [x for x in struct(nested) if x.name not in taken])
    parsed = df.where("trim(line) <> ''").select(F.from_json("line", wide, {"mode": "FAILFAST"}).alias("j"))
    cols = []
    for f in schema:
        c = F.col(f"j.`{f.name}`")
        if "." in f.name and f.name.split(".")[0] not in taken:
            c = F.coalesce(c, F.col("j." + ".".join(f"`{p}`" for p in f.name.split("."))))
        cols.append(c.alias(f.name))
    return parsed.select(*cols)


def infer(rows: list[dict]) -> T.StructType:
    """Columns of flat rows: boolean, bigint, double or string, in the order they appear; a column of nulls only is an error."""
    kinds: dict[str, str | None] = {}
    for row in rows:
        for k, v in row.items():
            kind = None if v is None else "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
            old = kinds.get(k)
            if kind is None or old == kind:
                kinds.setdefault(k, None)
            elif old is None:
                kinds[k] = kind
            else:
                kinds[k] = "double" if {old, kind} == {"long", "double"} else "string"
    bad = [k for k, v in kinds.items() if v is None]
    if bad or not kinds:
        raise InvalidArgument(f"no type for column {', '.join(bad) or '(none)'}: only nulls")
    make = {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(k, make[v]) for k, v in kinds.items()])
