"""A quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Tokens are runs of letters, digits and bytes beyond ASCII, or runs of other
printable signs; uni- and bigrams (a token twice over is one bigram whatever the
token) are hashed into ``2**BITS`` weights, with
1 + ln(count) as their values and unit length per text.  FTRL-proximal makes
``EPOCHS`` passes over a bounded sample of labelled texts (``MAX_TRAIN`` at most,
those with the smallest hash of their id), in one task whose result is one row
of weights, 4 * 2**BITS bytes.  Every text is then scored as a sparse dot
product, in one pass without a shuffle.

Defined cases: a null or empty text has no n-gram and gets the bias's score; a
null id is never learned from and never held out; several labels of one id count
as 1 if half of them or more are 1; null labels are passed over; without labels
every score is 0.5; repeated documents are scored row by row.  Other columns are
carried by ``keep_good`` and ignored by ``score_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import bounded_batches

BITS = 18
NGRAMS = 2
MAX_TRAIN = 6_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.0
#: The hash of every n-gram that is one token n times over.
REPEATED = np.uint64(0x5EED5EED5EED5EED)
#: A text is predicted good from this score.
GOOD_FROM = 0.3

SCORES = "doc_id long, held_out boolean, score double, predicted int"

#: 1: letters, digits, beyond ASCII; 2: other printable signs; 0: the rest.
_CLASS = np.array([1 if chr(b).isalnum() and b < 128 or b >= 128 else 2 if 0x21 <= b <= 0x7E else 0 for b in range(256)], np.uint8)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each token of a block, in order."""
    kinds = _CLASS[data]
    parts = [K.words(kinds, off, np.arange(256) == kind) for kind in (1, 2)]
    starts = np.concatenate([p[0] for p in parts])
    order = np.argsort(starts, kind="stable")
    return starts[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight number, value) of a block's n-grams, ordered by text; each text's values have length 1."""
    starts, ends, doc = tokens(data, off)
    h = K.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    keys = []
    for n in range(1, NGRAMS + 1):
        g = K.window_hashes(h, n)
        if n > 1:  # a token said n times over is one n-gram whatever the token
            said = np.ones(len(g), bool)
            for j in range(1, n):
                said &= h[: len(g)] == h[j : j + len(g)]
            g[said] = REPEATED
        same = doc[: len(g)] == doc[n - 1 : n - 1 + len(g)]
        keys.append((doc[: len(g)][same] << BITS) | (g[same] >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return key, key, np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    value = 1 + np.log(np.diff(np.append(first, len(key))))
    key = key[first]
    doc = key >> BITS
    norm = np.sqrt(np.bincount(doc, value * value, len(off) - 1))
    return doc, key & ((1 << BITS) - 1), value / norm[doc]


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last weight is the bias."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the weights as float32, learned from all rows of the partition in their order."""
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False)
        for a, b, data, off in K.blocks(batch):
            doc, i, x = features(data, off)
            cuts = np.searchsorted(doc, np.arange(b - a + 1))
            for k in range(b - a):
                s = slice(cuts[k], cuts[k + 1])
                rows.append((np.append(i[s], 1 << BITS).astype(np.int32), np.append(x[s], 1.0).astype(np.float32), int(good[a + k])))
    model = Ftrl()
    for _ in range(EPOCHS):
        for i, x, y in rows:
            model.learn(i, x.astype(np.float64), y)
    rows.clear()
    K.release()
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["w"])


def held_out():
    """Whether a row's label is kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from at most max_train labelled texts that are not held out."""
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").where(~held_out())
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(F.broadcast(marks), "doc_id").select("doc_id", "text", "good")
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    found = one.mapInArrow(_train, "w binary").collect()
    return np.frombuffer(found[0].w, "<f4") if found else np.zeros((1 << BITS) + 1, "<f4")


def _scores(batch: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
    z = np.full(batch.num_rows, float(w[-1]))
    for a, b, data, off in K.blocks(batch):
        doc, i, x = features(data, off)
        z[a:b] += np.bincount(doc, w[i] * x, b - a)
    return 1 / (1 + np.exp(-z))


def score_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    w = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, max_train))

    def run(batches):
        for batch in batches:
            s = _scores(batch, w.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= GOOD_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs predicted good, with all their columns; learned from training_docs (docs if not given)."""
    w = docs.sparkSession.sparkContext.broadcast(train_quality(docs if training_docs is None else training_docs, labels, max_train))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, w.value) >= GOOD_FROM))

    return docs.mapInArrow(run, docs.schema)
