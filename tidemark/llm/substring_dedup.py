"""Substring dedup by repeated-phrase automata.

Windows of 20 words that occur at several places are found in three steps:

1. recurring anchors are confirmed by counting (see ``anchors``), and the
   segments around them are sent to the anchors' shards;
2. in a shard, recurring passages are confirmed: each maximal run of windows that
   start earlier at one place becomes a phrase with that place as its source, and
   all phrases are compiled into one Aho-Corasick automaton;
3. every segment of the shard streams through the automaton.  Each place a phrase
   is located at, other than its source, is removed.  If a phrase isn't located,
   word for word, at its source, hashes of different windows have met, and the
   shard is done again with the windows' words in place of their hashes.

Shards are bounded by bytes, there are as many as the repeats need, and a segment
meets the automaton of its own shard only, so the work grows with the input.

Defined cases: a null or empty text has no words; rows with equal id and text are
one document, with equal results; different texts with one id are different
documents, ordered by their hash; a null id comes before all others; an empty
table gives no rows; other columns are not read, and ``without_repeats`` keeps
them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import kernels as K

WINDOW_WORDS = 20
ANCHOR_WORDS = 5
DIGEST = "did long, h long, n_words long, n_removed long, kept_sha256 string"


def _by_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """A number of each window, equal for equal words only."""
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[: len(starts) - window + 1].tolist(), ends[window - 1 :].tolist())], np.uint64)


def judge(held: list[tuple[int, int, int, bytes]], window: int = WINDOW_WORDS, exact: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """Spans (did, h, first word, words) that an automaton of the shard's recurring phrases locates away from their source.

    exact: windows are told apart by their words, not by 64-bit hashes.
    """
    held = sorted(held)
    off = np.cumsum([0, *(len(s[3]) for s in held)])
    data = np.frombuffer(b"".join(s[3] for s in held), np.uint8)
    starts, ends, doc = K.words(data, off, K.NOT_SPACE)
    begins = np.searchsorted(doc, np.arange(len(held) + 1))
    w = _by_words(data, starts, ends, window) if exact else K.window_hashes(K.span_hashes(data, starts, ends), window)
    s = np.flatnonzero(doc[: len(w)] == doc[window - 1 : window - 1 + len(w)])
    if not len(s):
        return
    # windows stand in the order of (document, place), so the first of equal ones is the earliest
    _, first, inverse = np.unique(w[s], return_index=True, return_inverse=True)
    # equal places may come twice, in segments of neighbouring anchors' windows of a hot one; they are one occurrence
    source = s[first][inverse]
    place = np.array([x[2] for x in held])[doc] + np.arange(len(doc)) - begins[doc]
    name = np.unique(np.array([x[:2] for x in held], np.int64).reshape(-1, 2), axis=0, return_inverse=True)[1].reshape(-1)[doc]
    same = (name[s] == name[source]) & (place[s] == place[source])
    later, source = s[~same], source[~same]
    if not len(later):
        return
    begin = np.concatenate([[True], (later[1:] != later[:-1] + 1) | (doc[later[1:]] != doc[later[:-1]]) | (source[1:] != source[:-1] + 1) | (doc[source[1:]] != doc[source[:-1]])])
    at = np.flatnonzero(begin)
    run = np.diff(np.append(at, len(later)))
    automaton = ahocorasick.Automaton()
    texts = [f" {x[3].decode()} " for x in held]
    phrases: list[tuple[int, int, int, int]] = []  # characters, words, source segment, source word in it
    for i, n, src in zip(later[at].tolist(), (run + window - 1).tolist(), source[at].tolist()):
        phrase = " " + data[starts[i] : ends[i + n - 1]].tobytes().decode() + " "
        if phrase not in automaton:
            automaton.add_word(phrase, len(phrases))
            d = int(doc[src])
            phrases.append((len(phrase), n, d, src - int(begins[d])))
    automaton.make_automaton()
    located: list[list[tuple[int, int]]] = [[] for _ in phrases]
    for k, text in enumerate(texts):
        for end, p in automaton.iter(text):
            located[p].append((k, text.count(" ", 0, end - phrases[p][0] + 1)))
    if not exact and any((d, j) not in places for (_, _, d, j), places in zip(phrases, located)):  # not the same words: hashes met
        yield from judge(held, window, exact=True)
        return
    for (_, n, d, j), places in zip(phrases, located):
        home = (held[d][0], held[d][1], held[d][2] + j)
        for k, i in places:
            spot = (held[k][0], held[k][1], held[k][2] + i)
            if spot != home:
                yield (*spot, n)


def _shape(window: int) -> A.Shape:
    return A.Shape(window, min(ANCHOR_WORDS, window), True)


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS, hot: int = A.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs."""
    rows, once, unique = A.known_documents(docs)
    found = A.removed_spans(once, _shape(window), lambda held: judge(held, window), hot)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for x, y, data, off in K.blocks(batch):
                b = A.symbols(data, off, _shape(window))
                gone = A.removal_mask(batch, x, y, b)
                n_words, n_removed = np.diff(b.begins), np.bincount(b.doc[gone], minlength=y - x)
                keep = A.Block(data, b.starts[~gone], b.ends[~gone], b.doc[~gone], None)
                parts = _joined(keep, off)
                out += zip(n_words.tolist(), n_removed.tolist(), (hashlib.sha256(t).hexdigest() for t in parts))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("h"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["did", "h", "n_words", "n_removed", "kept_sha256"])

    digest = found.mapInArrow(run, DIGEST)
    if not unique:
        digest = rows.select("did", "h").join(digest, ["did", "h"])
    return digest.select(F.expr(f"case when did = {A.NULL_ID + 1} - 1 then null else did end").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def _joined(b: A.Block, off: np.ndarray) -> Iterator[bytes]:
    """Of each text the given words, joined by one space."""
    mark = np.zeros(len(b.data) + 1, np.int8)
    np.add.at(mark, b.starts, 1)
    np.add.at(mark, b.ends, -1)
    member = np.cumsum(mark[:-1]) > 0
    size = b.ends - b.starts + 1
    total = np.append(0, np.cumsum(size))
    out = np.full(int(total[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[total[1:] - 1] = False
    out[inside] = b.data[member]
    raw = out.tobytes()
    cuts = total[np.searchsorted(b.doc, np.arange(len(off)))].tolist()
    return (raw[p : max(p, q - 1)] for p, q in zip(cuts[:-1], cuts[1:]))


def without_repeats(docs: DataFrame, window: int = WINDOW_WORDS, hot: int = A.HOT) -> DataFrame:
    """docs, all rows and columns, with the removed words cut out of their texts.

    A text that loses nothing stays as it is; of another, each maximal run of
    removed words goes from its first byte up to the next kept word.
    """
    _, once, unique = A.known_documents(docs)
    spans = A.decided(A.sent_segments(once, _shape(window), hot), lambda held: judge(held, window)).groupBy("did", "h").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("ns"))
    spans = spans.select(F.col("did").alias("__did"), F.col("h").alias("__h"), F.col("firsts").alias("__firsts"), F.col("ns").alias("__ns"))
    h = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(spans, (F.coalesce(docs["doc_id"].cast("long"), F.lit(A.NULL_ID)) == F.col("__did")) & (h == F.col("__h")), "left").drop("__did", "__h")

    def run(batches):
        for batch in batches:
            spans = pa.RecordBatch.from_arrays([batch.column("__firsts"), batch.column("__ns")], names=["firsts", "ns"])
            column = batch.column("text")
            if spans.column(0).null_count < batch.num_rows:
                texts = column.to_pylist()
                for x, y, data, off in K.blocks(batch):
                    b = A.symbols(data, off, _shape(window))
                    gone = A.removal_mask(spans, x, y, b)
                    for d in np.unique(b.doc[gone]).tolist():
                        lo, hi = int(b.begins[d]), int(b.begins[d + 1])
                        own = gone[lo:hi]
                        out, at = [], int(off[d])
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2)
                        for p, q in edges.tolist():
                            out.append(data[at : b.starts[lo + p]].tobytes())
                            at = int(b.starts[lo + q]) if lo + q < hi else int(off[d + 1])
                        texts[x + d] = (b"".join(out) + data[at : off[d + 1]].tobytes()).decode()
                column = pa.array(texts, column.type)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", column).drop_columns(["__firsts", "__ns"])

    return joined.mapInArrow(run, docs.schema)
