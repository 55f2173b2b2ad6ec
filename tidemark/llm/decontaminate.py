"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The benchmark's word windows go to every executor as a hash set; each training
text is scanned once, its window hashes are looked up, every hit is verified
word for word, and the hit spans are reported, cut out, or their documents
dropped.  There is no shuffle.  The set is flat arrays (sorted hashes, and where
the words of a window stand in one buffer of all items' words), and is broadcast
only up to ``max_broadcast_bytes`` of what it takes in memory.  A larger benchmark
is dealt with in blocks of that size: each is read, broadcast over the whole
corpus and forgotten before the next, and the spans of all blocks are united per
document row before anything is judged or cut, so the result doesn't depend on
the bound.

Defined cases: a null or empty text has no words and is kept; an item without
words has no window; an item shorter than the window is one window of its own
length; repeated items and repeated documents are judged row by row, null and
repeated ids included, and the same item_id counts once; an item whose id is null
takes part under the empty string; an empty benchmark hits nothing; extra columns
of either table are carried or ignored, never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import bounded_batches, cut

WINDOW_WORDS = 13
#: What a hash set takes in memory, in the driver and in each Python worker, at most (and one item more).
MAX_BROADCAST_BYTES = 64 << 20
#: A document counts as contaminated from one hit word in so many.
ONE_IN = 20

DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "row long, k long, size long, items array<string>"
ACTIONS = ("documents", "spans", "both")
_BITS = 20
#: Bytes a window takes besides its words: hash, place, length and item.
_WINDOW_BYTES = 8 + 8 + 4 + 4

Item = tuple[str, str]


def _item_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of an item, and where its words begin and end."""
    data = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
    return data, starts, ends


class WindowSet:
    """Windows of benchmark items: by length, sorted hashes with the place of their words and their item, and a bit table before them."""

    def __init__(self, items: list[Item], n: int = WINDOW_WORDS):
        self.names = sorted({i for i, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        buffer, at = bytearray(), 0
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for item, text in items:
            data, starts, ends = _item_words(text)
            if not len(starts):
                continue
            size = min(n, len(starts))
            m = len(starts) - size + 1
            width = ends - starts
            begin = at + np.cumsum(width + 1) - (width + 1)  # of each word in the buffer
            buffer += b" ".join(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())) + b" "
            at = len(buffer)
            h = K.window_hashes(K.span_hashes(data, starts, ends), size)
            length = begin[size - 1 :] + width[size - 1 :] - begin[:m]
            parts.setdefault(size, []).append((h, begin[:m], length.astype(np.int32), np.full(m, number[item], np.int32)))
        self.words = bytes(buffer)
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        self.bits: dict[int, np.ndarray] = {}
        for size, p in parts.items():
            h, place, length, item = (np.concatenate(c) for c in zip(*p))
            order = np.lexsort((item, h))
            h, place, length, item = h[order], place[order], length[order], item[order]
            again = np.flatnonzero((h[1:] == h[:-1]) & (item[1:] == item[:-1]) & (length[1:] == length[:-1])) + 1
            again = [i for i in again.tolist() if self._text(place[i], length[i]) == self._text(place[i - 1], length[i - 1])]
            self.windows[size] = tuple(np.delete(x, again) for x in (h, place, length, item))
            self.bits[size] = np.zeros(1 << _BITS, bool)
            self.bits[size][h >> np.uint64(64 - _BITS)] = True

    def _text(self, place, length) -> bytes:
        return self.words[int(place) : int(place) + int(length)]

    def nbytes(self) -> int:
        return len(self.words) + sum(x.nbytes for w in self.windows.values() for x in w) + sum(b.nbytes for b in self.bits.values()) + sum(60 + len(x) for x in self.names)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(first word, words, items) of each verified window of a block."""
        found = []
        if not len(starts):
            return found
        h = K.span_hashes(data, starts, ends)
        for size, (known, place, length, item) in self.windows.items():
            w = K.window_hashes(h, size)
            at = np.flatnonzero(self.bits[size][w >> np.uint64(64 - _BITS)])
            at = at[doc[at] == doc[at + size - 1]]
            lo, hi = np.searchsorted(known, w[at]), np.searchsorted(known, w[at], side="right")
            met = lo < hi
            for k, a, b in zip(at[met].tolist(), lo[met].tolist(), hi[met].tolist()):
                text = b" ".join(data[x:y].tobytes() for x, y in zip(starts[k : k + size], ends[k : k + size]))
                if items := {self.names[item[i]] for i in range(a, b) if length[i] == len(text) and self._text(place[i], length[i]) == text}:
                    found.append((k, size, items))
        return found


def _scan(batch: pa.RecordBatch, windows: WindowSet):
    """Per block: first row, end row, bytes, word starts and ends, text of each word, and its hits."""
    for a, b, data, off in K.blocks(batch):
        low = K.LOWER[data]
        starts, ends, doc = K.words(low, off, K.ALNUM)
        yield a, b, data, off, starts, ends, doc, windows.find(low, starts, ends, doc)


def _contaminated(n_words, n_hit):
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def _sha(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _item_blocks(benchmark: DataFrame, max_bytes: int) -> Iterator[list[Item]]:
    """The benchmark's items in lists whose sets take about max_bytes each (one item may take more); an empty list for none.

    Items are fetched as they are asked for, so the driver holds one list at a time.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null")
    bounded_batches(benchmark.sparkSession)
    held, size = [], 0
    for r in items.toLocalIterator():
        cost = len(r.t.encode()) + _WINDOW_BYTES * len(_item_words(r.t)[1]) + 60 + len(r.i)
        if held and size + cost > max_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += cost
    yield held


def _one_or_more(benchmark: DataFrame, max_bytes: int) -> tuple[list[Item], bool]:
    """The items and False if one list holds them all; else nothing and True."""
    lists = _item_blocks(benchmark, max_bytes)
    first = next(lists)
    return ([], True) if next(lists, None) is not None else (first, False)


def _broadcast(docs: DataFrame, items: list[Item], n: int):
    return docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))


def _spans(rows: DataFrame, benchmark: DataFrame, n: int, max_bytes: int) -> DataFrame:
    """(row, k, size, items) of every verified window, block of items after block; rows: row, text, as they lie in a table."""
    spans = None
    for items in _item_blocks(benchmark, max_bytes):
        windows = _broadcast(rows, items, n)

        def run(batches, windows=windows):
            for batch in batches:
                out, row = [], batch.column("row")
                for a, _, _, _, _, _, doc, found in _scan(batch, windows.value):
                    first = np.searchsorted(doc, np.arange(doc[-1] + 1)) if len(doc) else None
                    for k, size, ids in found:
                        d = int(doc[k])
                        out.append((row[a + d].as_py(), int(k - first[d]), int(size), sorted(ids)))
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))], names=["row", "k", "size", "items"])

        part = cut(rows.select("row", "text").mapInArrow(run, SPANS), "decontaminate-spans")
        windows.destroy()
        spans = part if spans is None else spans.union(part)
    return spans


def _judged(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The digest of each row, with its key row, from the spans of all blocks; rows: row, doc_id, text."""
    hit = spans.select("row", F.explode(F.sequence("k", F.expr("k + size - 1"))).alias("p")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    ids = spans.select("row", F.explode("items").alias("i")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("i")).alias("ids"))
    count = F.expr(r"size(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0))")
    out = rows.select("row", "doc_id", F.coalesce(F.greatest(count, F.lit(0)), F.lit(0)).cast("long").alias("n_words")).join(hit, "row", "left").join(ids, "row", "left")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    out = out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words")))


def score_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and the verdict."""
    items, more = _one_or_more(benchmark, max_broadcast_bytes)
    if more:
        rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "decontaminate-docs")
        return _judged(rows, _spans(rows, benchmark, n, max_broadcast_bytes)).drop("row")
    windows = _broadcast(docs, items, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n_words, n_hit = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            items: dict[int, set[str]] = {}
            for a, b, _, _, starts, _, doc, found in _scan(batch, windows.value):
                n_words[a:b] = np.bincount(doc, minlength=b - a)
                if found:
                    n_hit[a:b] = np.bincount(doc[_covered(starts, found)], minlength=b - a)
                    for i, _, x in found:
                        items.setdefault(a + int(doc[i]), set()).update(x)
            none = _sha(set())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([len(items.get(i, ())) for i in range(rows)], pa.int64()), pa.array([_sha(items[i]) if i in items else none for i in range(rows)], pa.string()), pa.array(_contaminated(n_words, n_hit))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)


def _covered(starts: np.ndarray, found: list) -> np.ndarray:
    """Which words lie in a found window."""
    k, size = np.array([x[:2] for x in found]).T
    return K.covered(len(starts), k, size)


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = WINDOW_WORDS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs without contamination, with all their columns.

    ``"documents"`` drops contaminated documents; ``"spans"`` keeps every document
    and cuts each hit window out of its text, from the first byte of its first word
    to the last byte of its last; ``"both"`` drops the contaminated ones and cuts
    the hit windows out of the others.  Documents are judged as they come in.
    Where a cut brings words together that are a window again, that one is cut as
    well, until no window is left.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    items, more = _one_or_more(benchmark, max_broadcast_bytes)
    if more:
        return _in_blocks(docs, benchmark, action, n, max_broadcast_bytes)
    windows = _broadcast(docs, items, n)

    def run(batches):
        for batch in batches:
            texts: list[str | None] | None = None
            keep = np.ones(batch.num_rows, bool)
            for a, b, data, _, starts, ends, doc, found in _scan(batch, windows.value):
                if not found:
                    continue
                hit = _covered(starts, found)
                if action != "spans":
                    keep[a:b] = ~_contaminated(np.bincount(doc, minlength=b - a), np.bincount(doc[hit], minlength=b - a))
                if action != "documents":
                    texts = texts or batch.column("text").to_pylist()
                    for d in set(doc[hit].tolist()):
                        if keep[a + d]:
                            own = doc == d
                            texts[a + d] = _clean(_without(texts[a + d], hit[own]), windows.value)
            if texts is not None:
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))
            yield batch.filter(pa.array(keep)) if not keep.all() else batch

    return docs.mapInArrow(run, docs.schema)


def _clean(text: str, windows: WindowSet) -> str:
    """A text without the windows that are left or new in it; each round has fewer words."""
    while True:
        data = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
        starts, ends, doc = K.words(data, np.array([0, len(data)]), K.ALNUM)
        found = windows.find(data, starts, ends, doc)
        if not found:
            return text
        text = _without(text, _covered(starts, found))


def _without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two neighbouring ones; hit: one entry a word."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = K.words(K.LOWER[data], np.array([0, len(data)]), K.ALNUM)
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for x, y in edges.reshape(-1, 2).tolist():
        out.append(raw[at : int(starts[x])])
        at = int(ends[y - 1])
    out.append(raw[at:])
    return b"".join(out).decode()


def _in_blocks(docs: DataFrame, benchmark: DataFrame, action: str, n: int, max_bytes: int) -> DataFrame:
    """The same rows for a benchmark beyond the broadcast bound; every round unites the spans of all blocks, and only texts it cut go into the next."""
    docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate-in")
    rows = docs.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = _spans(rows, benchmark, n, max_bytes)
    if action != "spans":
        bad = cut(_judged(rows, spans).where("contaminated").select(F.col("row").alias("__row")), "contaminated")
        docs = docs.join(bad, "__row", "left_anti")
        spans = spans.join(bad.withColumnRenamed("__row", "row"), "row", "left_anti")
    if action == "documents":
        return docs.drop("__row")
    texts = cut(docs.select(F.col("__row").alias("row"), "text"), "decontaminate-texts")
    done = None
    while spans.limit(1).count():
        texts = cut(_cut_out(texts, spans), "decontaminate-texts")
        spans = _spans(texts, benchmark, n, max_bytes)
        clean = texts.join(spans.select("row").distinct(), "row", "left_anti")
        done = clean if done is None else done.union(clean)
        texts = texts.join(spans.select("row").distinct(), "row", "left_semi")
    if done is None:
        return docs.drop("__row")
    done = done.select(F.col("row").alias("__row"), F.col("text").alias("__text"), F.lit(True).alias("__cut"))
    out = docs.join(done, "__row", "left")
    return out.select(*[(F.when(F.col("__cut"), F.col("__text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns if c != "__row"])


def _cut_out(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, text) of the texts with spans, without them; a text's spans are at most its words times the window lengths."""
    of = spans.groupBy("row").agg(F.collect_list("k").alias("ks"), F.collect_list("size").alias("sizes"))

    def run(batches):
        for batch in batches:
            out = []
            for text, k, size in zip(*(batch.column(c).to_pylist() for c in ("text", "ks", "sizes"))):
                n_words = len(_item_words(text)[1])
                out.append(_without(text, K.covered(n_words, np.array(k), np.array(size))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    return texts.join(of, "row").mapInArrow(run, "row long, text string")
