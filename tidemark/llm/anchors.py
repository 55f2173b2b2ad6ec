"""Where repeated windows can lie: content-chosen anchors, counted over the corpus.

A window is ``window`` consecutive symbols (words or bytes) of one document.
Its anchor is the k-gram with the smallest hash in it (the first one, of equals),
so equal windows have equal anchors at equal places.  Only a small share of all
k-grams anchors any window; those that anchor at two places or more are found by
one aggregation of their hashes, and windows with any other anchor occur once.

What remains, the *segments* (the symbols of all windows of one anchor
occurrence), is sent to the anchor's shard.  A shard holds every occurrence of
each of its windows, so it can compare them exactly.  Two things keep hot anchors
from filling a shard: equal segments of a task are sent once (``combine``), and
the windows of an anchor that occurs more than ``HOT`` times are sent one by one,
by their own hash.

Documents are known by (did, h): did is doc_id with null as the smallest number,
h is 0 where ids are unique and the text's hash otherwise; rows with equal id and
text are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import bounded_batches, cut

NULL_ID = -(1 << 63)
HOT = 4_000
#: Hot anchors are known to every task (16 bytes each) if there are at most so many.
MAX_BROADCAST = 200_000
#: Distinct segments of a task wait for equal ones up to so many bytes.
COMBINE_BYTES = 12 << 20
#: Segments of neighbouring keys are worked on together up to so many bytes.
SHARD_BYTES = 1 << 20


class Shape(NamedTuple):
    window: int
    k: int
    words: bool


class Segments(NamedTuple):
    """Runs of windows with one anchor: first and last window, the anchor's place and hash; all by symbol number in the block."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    hash: np.ndarray


class Block(NamedTuple):
    """A block's symbols: byte start and end of each, its text's number, and the first symbol of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    begins: np.ndarray


def symbols(data: np.ndarray, off: np.ndarray, shape: Shape) -> Block:
    if shape.words:
        starts, ends, doc = K.words(data, off, K.NOT_SPACE)
        return Block(data, starts, ends, doc, np.searchsorted(starts, off))
    starts = np.arange(len(data))
    return Block(data, starts, starts + 1, np.repeat(np.arange(len(off) - 1), np.diff(off)), off)


def segments(b: Block, shape: Shape) -> Segments:
    w, n = shape.window - shape.k + 1, len(b.starts)
    none = np.zeros(0, np.int64)
    if n < shape.window:
        return Segments(none, none, none, np.zeros(0, np.uint64))
    if shape.words:
        g = K.window_hashes(K.span_hashes(b.data, b.starts, b.ends), shape.k)
    else:
        g = K.span_hashes(b.data, b.starts[: n - shape.k + 1], b.starts[: n - shape.k + 1] + shape.k)
    g |= np.uint64(1)
    least = K.sliding(g, w)  # of the k-grams of the window that starts here
    valid = b.doc[: len(least)] == b.doc[shape.window - 1 :]
    if not valid.any():
        return Segments(none, none, none, np.zeros(0, np.uint64))
    pad = np.zeros(w - 1, np.uint64)
    chosen = K.sliding(np.concatenate([pad, np.where(valid, least, np.uint64(0)), pad]), w, least=False) == g
    places = np.flatnonzero(chosen)
    s = np.flatnonzero(valid)
    i = (np.cumsum(chosen) - chosen)[s]  # the first chosen place from the window's start on
    late = np.flatnonzero(g[places[i]] != least[s])
    while len(late):
        i[late] += 1
        late = late[g[places[i[late]]] != least[s[late]]]
    owner = places[i]
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = s[np.append(cut[1:], len(s)) - 1]
    return Segments(s[cut], last, owner[cut], g[owner[cut]])


def known_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(did, h, text) of each row, the same with one row a document, and whether ids are unique."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    unique = d.groupBy("did").count().where("count > 1").limit(1).count() == 0
    if unique:
        rows = d.select("did", F.lit(0).cast("long").alias("h"), "text")
        return rows, rows, True
    rows = d.select("did", F.xxhash64("text").alias("h"), "text")
    return rows, rows.dropDuplicates(["did", "h"]), False


def _repeat(batch: pa.RecordBatch, i: np.ndarray, *names: str) -> list[pa.Array]:
    return [batch.column(name).take(pa.array(i)) for name in names]


def anchor_places(docs: DataFrame, shape: Shape) -> DataFrame:
    """(did, h, place, a) of each anchor occurrence; place counts symbols of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, off in K.blocks(batch):
                b = symbols(data, off, shape)
                s = segments(b, shape)
                if len(s.place):
                    d = b.doc[s.place]
                    yield pa.RecordBatch.from_arrays([*_repeat(batch, x + d, "did", "h"), pa.array((s.place - b.begins[d]).astype(np.int32)), pa.array(s.hash.view(np.int64))], names=["did", "h", "place", "a"])

    return docs.mapInArrow(run, "did long, h long, place int, a long")


def repeated_places(docs: DataFrame, shape: Shape, hot: int = HOT) -> DataFrame:
    """(did, h, places): per document its anchor places whose k-gram anchors elsewhere too, as 2 * place + (1 if hot)."""
    spots = anchor_places(docs, shape)
    counts = cut(spots.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    many = counts.where(F.col("n") > hot).select("a", F.lit(True).alias("hot"))
    if many.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        # places of hot anchors are settled where they are, and go on under keys of their own
        spots = spots.join(F.broadcast(many), "a", "left").withColumn("a", F.when(F.col("hot"), F.xxhash64("did", "h", "place", F.lit(1))).otherwise(F.col("a")))
        spots = spots.join(counts, "a", "left").where("hot or n > 1")
    else:
        spots = spots.join(counts, "a").withColumn("hot", F.col("n") > hot)
    spots = spots.select("did", "h", (F.col("place").cast("long") * 2 + F.coalesce("hot", F.lit(False)).cast("long")).alias("place"))
    return spots.groupBy("did", "h").agg(F.collect_list("place").alias("places"))


SENT = "key long, did long, h long, first int, seg binary"


def sent_segments(docs: DataFrame, shape: Shape, hot: int = HOT) -> DataFrame:
    """What goes to the shards, (key, did, h, first, seg), and spans already decided, with key null and seg the span's length in symbols.

    seg has the segment's symbols (words joined by one space).  Of equal segments
    in a task only the earliest is sent.  With words (where the earliest of equal
    windows is kept) the spans of the others are decided at once; with bytes (where
    all go) those of all of them.
    """
    joined = docs.join(repeated_places(docs, shape, hot), ["did", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bytes, tuple] = {}
        held, spans = 0, []

        def flush():
            nonlocal held
            out = list(waiting.values())
            cols = list(zip(*out)) or [()] * 4
            whole = merged(spans)
            done = list(zip(*whole)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(cols[0]) + [None] * len(whole), pa.int64()), pa.array([*cols[1], *done[0]], pa.int64()), pa.array([*cols[2], *done[1]], pa.int64()), pa.array([*cols[3], *done[2]], pa.int32()), pa.array([*waiting, *(n.to_bytes(4, "little") for n in done[3])], pa.binary())],
                names=["key", "did", "h", "first", "seg"],
            )
            waiting.clear()
            spans.clear()
            held = 0

        for batch in batches:
            did, h = batch.column("did").to_pylist(), batch.column("h").to_pylist()
            flat = batch.column("places")
            places, ends = flat.flatten().to_numpy(), np.append(0, np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False)))
            for x, y, data, off in K.blocks(batch):
                b = symbols(data, off, shape)
                s = segments(b, shape)
                own = places[ends[x] : ends[y]]
                row = np.repeat(np.arange(y - x), np.diff(ends[x : y + 1]))
                at = b.begins[row] + (own >> 1)
                order = np.argsort(at)
                at, is_hot = at[order], (own & 1)[order]
                i = np.searchsorted(at, s.place)
                keep = (i < len(at)) & (at[np.minimum(i, len(at) - 1)] == s.place)
                first, last, hashes, hots = s.first[keep], s.last[keep], s.hash[keep].view(np.int64), is_hot[i[keep]].astype(bool)
                if hots.any():
                    n = (last - first + 1)[hots]
                    w = np.repeat(first[hots], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    first, last = np.concatenate([first[~hots], w]), np.concatenate([last[~hots], w])
                    hashes = np.concatenate([hashes[~hots], np.zeros(len(w), np.int64)])
                    hots = np.arange(len(first)) >= len(first) - len(w)
                if shape.words:
                    norm, nstart, nend = normalised(b)
                else:
                    norm, nstart, nend = data, b.starts, b.ends
                raw = norm.tobytes()
                lo, hi = nstart[first].tolist(), nend[last + shape.window - 1].tolist()
                doc = b.doc[first]
                length = last - first + shape.window
                if hots.any():  # a window that goes alone goes by its own hash
                    one = np.flatnonzero(hots)
                    hashes[one] = K.span_hashes(norm, nstart[first[one]], nend[last[one] + shape.window - 1]).view(np.int64)
                for key, d, f, n, p, q in zip(hashes.tolist(), doc.tolist(), (first - b.begins[doc]).tolist(), length.tolist(), lo, hi):
                    seg = raw[p:q]
                    new = (key, did[x + d], h[x + d], f)
                    old = waiting.get(seg)
                    if old is None:
                        waiting[seg] = new
                        held += q - p + 100
                        if held > COMBINE_BYTES:
                            yield from flush()
                        continue
                    least, other = (new, old) if new[1:] < old[1:] else (old, new)
                    waiting[seg] = least
                    for g in (other,) if shape.words else (other, least):
                        spans.append((g[1], g[2], g[3], n))
                if len(spans) > 200_000:
                    spans[:] = merged(spans)
                    if len(spans) > 100_000:
                        yield from flush()
        yield from flush()
        K.release()

    return joined.select("did", "h", "text", "places").mapInArrow(run, SENT)


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (did, h, first, n) with those of a document that touch or overlap made one."""
    out: list[tuple[int, int, int, int]] = []
    for did, h, first, n in sorted(spans):
        if out and out[-1][0] == did and out[-1][1] == h and first <= (end := out[-1][2] + out[-1][3]):
            out[-1] = (did, h, out[-1][2], max(end, first + n) - out[-1][2])
        else:
            out.append((did, h, first, n))
    return out


def normalised(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's words, those of a text joined by one space, and where each begins and ends in it."""
    keep = K.NOT_SPACE[b.data]
    out = np.where(keep, b.data, np.uint8(0x20))
    after = b.ends[b.ends < len(b.data)]
    keep[after] = True
    at = np.cumsum(keep) - keep
    return out[keep], at[b.starts], at[b.starts] + (b.ends - b.starts)


SPANS = "did long, h long, first int, n int"


def decided(sent: DataFrame, judge: Callable[[list], Iterator[tuple[int, int, int, int]]]) -> DataFrame:
    """(did, h, first, n): spans to remove, from those already decided and from judge, called with all segments of some keys at a time.

    judge gets [(did, h, first, seg), ...] and yields spans.  A partition is sorted
    by key, so a call holds about SHARD_BYTES of segments, or one key's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        spans: list[tuple] = []

        def out():
            cols = list(zip(*merged(spans))) or [()] * 4
            spans.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["did", "h", "first", "n"])

        for batch in batches:
            for key, *seg in zip(*(batch.column(c).to_pylist() for c in ("key", "did", "h", "first", "seg"))):
                if key is None:
                    spans.append((*seg[:3], int.from_bytes(seg[3], "little")))
                    continue
                if key != last and size >= SHARD_BYTES:
                    spans.extend(judge(held))
                    held, size = [], 0
                held.append(tuple(seg))
                size += len(seg[3])
                last = key
                if len(spans) >= 200_000:
                    yield out()
        if held:
            spans.extend(judge(held))
        held = []
        yield out()
        K.release()

    # decided spans have no key: dealt by document, so that they don't all meet in one task
    by = F.coalesce("key", F.xxhash64("did", "first"))
    return sent.withColumn("by", by).repartition("by").sortWithinPartitions("key").drop("by").mapInArrow(run, SPANS)


def removed_spans(docs: DataFrame, shape: Shape, judge, hot: int = HOT) -> DataFrame:
    """(did, h, text, firsts, ns): each document with the spans to remove."""
    spans = decided(sent_segments(docs, shape, hot), judge).groupBy("did", "h").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("ns"))
    return docs.join(spans, ["did", "h"], "left").select("did", "h", "text", "firsts", "ns")


def removal_mask(batch: pa.RecordBatch, x: int, y: int, b: Block) -> np.ndarray:
    """Which symbols of rows x..y-1 lie in their spans."""
    firsts, ns = batch.column("firsts").slice(x, y - x), batch.column("ns").slice(x, y - x)
    n = firsts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(y - x), n)
    return K.covered(len(b.starts), b.begins[row] + firsts.flatten().to_numpy(), ns.flatten().to_numpy())
