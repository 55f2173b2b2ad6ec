"""Exact substring dedup of bytes by suffix sorting with bucket-pointer refinement.

Every byte covered by a 400-byte string that also starts anywhere else is
removed.  Anchors (see ``anchors``) confine the work to strings whose 48-byte
anchor recurs, and send them to shards that hold all occurrences of each of
their strings.  In a shard the suffixes are put into buckets by their first
``Q`` bytes, and the bucket pointers are refined: those at depth d are sorted by
the pair of their own bucket and the bucket d bytes later, which gives the
buckets at depth 2d, reused for the next round, until depth 400.  Only suffixes
that share their bucket take part, and only those the next rounds still point at.
Buckets with two suffixes or more then hold repeated strings; each is compared
with the first of its bucket byte by byte before it counts (the initial buckets
come from 64-bit hashes; should two different strings ever meet in one, the shard
is done again with buckets of 8 plain bytes).

Defined cases: a null or empty text has no bytes; rows with equal id and text are
one document with equal results, and do not repeat each other; different texts
with one id are different documents; an empty table gives no rows; other columns
are not read, and ``without_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import kernels as K

WINDOW_BYTES = 400
ANCHOR_BYTES = 48
Q = 50
DIGEST = "did long, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def buckets(data: np.ndarray, off: np.ndarray, window: int, q: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bucket of each): the windows of each text (positions in data) that share their bucket at depth ``window``.

    Bucket pointers are kept for all positions, and refined only where a window
    that still shares its bucket will look.
    """
    size = np.diff(off)
    inside = np.repeat(off[1:], size) - np.arange(len(data))  # bytes left in the text
    live = np.flatnonzero(inside >= window)
    depth = min(q, window)
    pointer = np.full(len(data), -1, np.int64)
    # the rounds: depth, and how much later the second pointer stands
    rounds, d = [], depth
    while d < window:
        step = min(d, window - d)
        rounds.append((d, step))
        d += step
    # what each depth's pointers are needed at: offsets from a window, backwards from the last round
    needed = [{0}]
    for _, step in reversed(rounds):
        needed.append({o + x for o in needed[-1] for x in (0, step)})
    needed = needed[::-1]

    def positions(offsets: set[int]) -> np.ndarray:
        mark = np.zeros(len(data), bool)
        for o in offsets:
            mark[live + o] = True
        return np.flatnonzero(mark)

    at = positions(needed[0])
    if exact:
        key = np.zeros(len(at), np.uint64)
        for j in range(depth):
            key = (key << np.uint64(8)) | data[at + j].astype(np.uint64)
    else:
        key = K.span_hashes(data, at, at + depth)
    pointer[at] = np.unique(key, return_inverse=True)[1]
    for i, (_, step) in enumerate(rounds):
        # windows alone in their bucket are settled; pointers of theirs that others need stay
        shared = np.bincount(pointer[live])[pointer[live]] > 1
        live = live[shared]
        if not len(live):
            return live, live
        at = positions(needed[i + 1])
        pointer[at] = np.unique((pointer[at].astype(np.uint64) << np.uint64(32)) | pointer[at + step].astype(np.uint64), return_inverse=True)[1]
    shared = np.bincount(pointer[live])[pointer[live]] > 1 if len(live) else np.zeros(0, bool)
    return live[shared], pointer[live[shared]]


def repeated(data: np.ndarray, off: np.ndarray, window: int, exact: bool = False) -> np.ndarray:
    """Positions of the windows that occur at two or more of these positions, each verified."""
    q = 8 if exact else Q
    live, bucket = buckets(data, off, window, min(q, window), exact)
    if not len(live):
        return live
    _, first, inverse = np.unique(bucket, return_index=True, return_inverse=True)
    source = live[first][inverse]
    if not exact:
        begin = np.flatnonzero(np.concatenate([[True], (live[1:] != live[:-1] + 1) | (source[1:] != source[:-1] + 1)]))
        length = np.diff(np.append(begin, len(live))) + window - 1
        raw = data.tobytes()
        for a, b, n in zip(live[begin].tolist(), source[begin].tolist(), length.tolist()):
            if a != b and raw[a : a + n] != raw[b : b + n]:
                return repeated(data, off, window, exact=True)
    return live


def judge(held: list[tuple[int, int, int, bytes]], window: int = WINDOW_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Spans (did, h, first byte, bytes) of the windows that occur twice in the shard."""
    off = np.cumsum([0, *(len(s[3]) for s in held)])
    data = np.frombuffer(b"".join(s[3] for s in held), np.uint8)
    live = repeated(data, off, window)
    if not len(live):
        return
    seg = np.searchsorted(off, live, side="right") - 1
    begin = np.flatnonzero(np.concatenate([[True], (live[1:] != live[:-1] + 1) | (seg[1:] != seg[:-1])]))
    run = np.diff(np.append(begin, len(live)))
    for a, k, n in zip(live[begin].tolist(), seg[begin].tolist(), run.tolist()):
        did, h, first, _ = held[k]
        yield did, h, first + a - int(off[k]), n + window - 1


def _shape(window: int) -> A.Shape:
    return A.Shape(window, min(ANCHOR_BYTES, window), False)


def _kept(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bytes, removed bytes, maximal removed runs, what is left) of each row of (text, firsts, ns)."""
    for x, y, data, off in K.blocks(batch):
        b = A.symbols(data, off, _shape(window))
        gone = A.removal_mask(batch, x, y, b)
        n_removed = np.bincount(b.doc[gone], minlength=y - x)
        before = np.concatenate([[False], gone[:-1]])
        before[off[:-1][off[:-1] < len(data)]] = False
        n_spans = np.bincount(b.doc[gone & ~before], minlength=y - x)
        raw = data[~gone].tobytes()
        cuts = np.append(0, np.cumsum(np.diff(off) - n_removed)).tolist()
        yield from zip(np.diff(off).tolist(), n_removed.tolist(), n_spans.tolist(), (raw[p:q] for p, q in zip(cuts[:-1], cuts[1:])))


def without_repeats(docs: DataFrame, window: int = WINDOW_BYTES, hot: int = A.HOT) -> DataFrame:
    """docs, all rows and columns, with the bytes that are left in ``kept``; text stays as it is.

    Bytes, as a span may begin or end within a character.
    """
    _, once, unique = A.known_documents(docs)
    found = A.removed_spans(once, _shape(window), lambda held: judge(held, window), hot)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("h"), pa.array([k[3] for k in _kept(batch, window)], pa.binary())], names=["__did", "__h", "kept"])

    left = found.mapInArrow(run, "__did long, __h long, kept binary")
    h = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.drop("kept").withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(A.NULL_ID)), "__h": h})
    return keyed.join(left, ["__did", "__h"]).drop("__did", "__h")


def suffix_dedup(docs: DataFrame, window: int = WINDOW_BYTES, hot: int = A.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    rows, once, unique = A.known_documents(docs)
    found = A.removed_spans(once, _shape(window), lambda held: judge(held, window), hot)

    def run(batches):
        for batch in batches:
            out = [(n, m, s, hashlib.sha256(kept).hexdigest()) for n, m, s, kept in _kept(batch, window)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("h"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["did", "h", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    digest = found.mapInArrow(run, DIGEST)
    if not unique:
        digest = rows.select("did", "h").join(digest, ["did", "h"])
    return digest.select(F.expr(f"case when did = {A.NULL_ID + 1} - 1 then null else did end").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
