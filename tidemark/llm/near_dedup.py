"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text's k-mers are its five-word shingles (lower-cased words of letters, digits
and characters beyond ASCII), each labelled with its occurrence number in the
text.  Each of ``TABLES`` hash orders takes the ``TAKEN`` smallest labelled k-mers
and keeps them in text order; texts with an equal list meet in a bucket.  So only
texts that share k-mers in the same order meet, which follows edit similarity.

Two texts are linked if a banded alignment of their labelled k-mers matches m of
them with m / (n1 + n2 - m) >= 0.8.  The band is the largest shift such a link
allows; within it the alignment is exact (sparse dynamic programming over the
matches).  A class is a connected component of links; its id is its smallest
doc_id.

Large groups are not paired off, and joins by a bucket or an equal text are with one
row of each key, so Spark's skew join may split hot keys.  Equal texts are one.  In each bucket every text
is first paired with the bucket's smallest only; links found that way give
components; then, in buckets that still hold several components, texts from
different components are compared as well, so that a link that joins two
components is not missed because its ends did not link to the smallest.  Only
texts that can be linked at all take part: k-mers that no other text of these
buckets has can't be matched, so a text needs enough others.  The comparison is an
exact count of common k-mers by an index inside the task, which puts out no more
than the links that join components.

A link of similarity s meets in a bucket with a chance of about
1 - (1 - s**TAKEN)**TABLES: 0.999997 at 0.8.  The minima are drawn without
replacement, so of links with m common k-mers of u, (1 - C(m, TAKEN) / C(u, TAKEN))**TABLES
never meet, which is more for short texts.  Texts of up to ``SHORT`` k-mers
therefore take ``TAKEN_SHORT`` minima only: of links of 0.8, 3e-10 are missed for
4 of 5, 7e-11 for 8 of 10, 5e-6 for 25 of 31, the first to take ``TAKEN``.

Defined cases: texts without words (null, empty) are each a class of their own;
a text of one to four words is one k-mer; rows with equal text are one class;
rows of one id are one document, with the class of the smallest class among its
texts; rows without an id are documents by their text, which link as all others
do, and their class_id is null if no document of their class has an id (of equal
ones without an id ``one_of_each`` keeps one row); an empty table gives no rows;
other columns are not read, and ``one_of_each`` keeps them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import bounded_batches, cut

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TABLES = 24
TAKEN = 4
#: Texts of up to so many k-mers take fewer minima (those that can be linked with longer ones take both numbers).
SHORT, TAKEN_SHORT = 30, 2
#: Bytes of a bucket's texts that one task compares with as many others.
BLOCK_BYTES = 8 << 20
#: Rows without an id are known by numbers from here on, made of their text's hash.
NO_ID = 1 << 62

_RNG = np.random.RandomState(20240229)
_XOR = _RNG.randint(0, 1 << 62, TABLES).astype(np.uint64)
_MUL = (_RNG.randint(0, 1 << 62, TABLES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_LABEL = np.uint64(0xA24BAED4963EE407)
_ORDER = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def kmers(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, labelled k-mer) of a block in text order."""
    low = K.LOWER[data]
    starts, ends, doc = K.words(low, off, K.ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = K.span_hashes(low, starts, ends)
    g = K.window_hashes(h, SHINGLE_WORDS)
    same = doc[: len(g)] == doc[SHINGLE_WORDS - 1 :] if len(g) else np.zeros(0, bool)
    d, g = doc[: len(g)][same], g[same]
    n = np.bincount(doc, minlength=len(off) - 1)
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    short = np.flatnonzero((n > 0) & (n < SHINGLE_WORDS))
    if len(short):
        extra = np.array([K.window_hashes(h[first[i] : first[i] + n[i]], int(n[i]))[0] for i in short], np.uint64)
        d, g = np.concatenate([d, short]), np.concatenate([g, extra])
        order = np.argsort(d, kind="stable")
        d, g = d[order], g[order]
    own = K.mix(g ^ K.mix(d.astype(np.uint64)))
    s = np.sort(own)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        at = np.flatnonzero(np.isin(own, twice))
        order = at[np.argsort(own[at], kind="stable")]
        begin = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
        nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        with np.errstate(over="ignore"):
            g = g.copy()
            g[order] = np.where(nth > 0, K.mix(g[order] + nth.astype(np.uint64) * _LABEL), g[order])
    return d, g


def sketches(d: np.ndarray, g: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket key), ordered by text: TABLES keys of each text, or twice as many near the bound of the short ones."""
    n = np.bincount(d, minlength=n_texts)
    short = (n > 0) & (n <= SHORT)
    long = n > int(SHORT * SIMILARITY)
    texts, keys = [], []
    for some, taken in ((short, TAKEN_SHORT), (long, TAKEN)):
        at = np.flatnonzero(some)
        if len(at):
            own = some[d]
            texts.append(np.repeat(at, TABLES))
            keys.append(_keys(np.cumsum(some)[d[own]] - 1, g[own], n[at], taken).reshape(-1))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts, keys = np.concatenate(texts), np.concatenate(keys)
    order = np.argsort(texts, kind="stable")
    return texts[order], keys[order]


def _keys(d: np.ndarray, g: np.ndarray, n: np.ndarray, taken: int) -> np.ndarray:
    """Keys of each of len(n) texts, all with k-mers, x TABLES."""
    texts = np.arange(len(n))
    keys = np.zeros((len(n), TABLES), np.int64)
    want = np.minimum(n, taken)
    # nearly always the smallest few lie below this; where not, the text is done without it
    below = np.full(len(n), 0xFFFFFFFFFFFFFFFF, np.uint64)
    long = n > 32
    below[long] = (2.0**64 * 20 / n[long]).astype(np.uint64)
    limit = below[d]
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            v = (g ^ _XOR[t]) * _MUL[t]
            at = np.flatnonzero(v <= limit)
            few = np.bincount(d[at], minlength=len(n)) < want
            if few.any():
                at = np.flatnonzero((v <= limit) | few[d])
            at = at[np.lexsort((v[at], d[at]))]
            begin = np.searchsorted(d[at], texts)
            rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            least = np.sort(at[rank < taken])
            begin = np.searchsorted(d[least], texts)
            rank = np.arange(len(least)) - np.repeat(begin, np.diff(np.append(begin, len(least))))
            key = np.add.reduceat(g[least] * np.array(_ORDER)[rank], begin)
            keys[:, t] = K.mix(key + np.uint64(t + TABLES * taken) * _LABEL).view(np.int64)
    return keys


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """m / (n1 + n2 - m) for the m k-mers a banded alignment matches; 0 if it can't reach similarity.

    Labelled k-mers occur once in a text, so the alignment that matches most is a
    longest increasing run of places among the common ones.
    """
    total = len(a) + len(b)
    least = similarity / (1 + similarity) * total
    if not total or min(len(a), len(b)) < least - 1e-9:
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = total - 2 * least  # more unmatched k-mers than this and no link is left
    near = np.abs(i - j) <= band
    order = np.argsort(i[near], kind="stable")
    j = j[near][order]
    if len(j) < least - 1e-9:
        return 0.0
    if (np.diff(j) > 0).all():
        m = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            p = bisect_left(tails, x)
            tails[p : p + 1] = [x]
        m = len(tails)
    return m / (total - m)


def _sketched(docs: DataFrame) -> DataFrame:
    """(id, text's md5, n k-mers, keys) of every document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, off in K.blocks(batch):
                d, g = kmers(data, off)
                n = np.bincount(d, minlength=y - x)
                text, keys = sketches(d, g, y - x)
                lists = pa.ListArray.from_arrays(np.searchsorted(text, np.arange(y - x + 1)).astype(np.int32), pa.array(keys))
                out = pa.RecordBatch.from_arrays([batch.column("id").slice(x, y - x), batch.column("same").slice(x, y - x), pa.array(n, pa.int64()), lists], names=["id", "same", "n", "keys"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "id long, same binary, n long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are linked."""
    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")

    def run(batches):
        one = lru_cache(64)(lambda t: kmers(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1])
        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            keep = [aligned(one(ta[i].as_py()), one(tb[i].as_py()), similarity) >= similarity - 1e-9 for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _own_kmers(texts: DataFrame) -> DataFrame:
    """(id, own): how many k-mers of a document no other of these texts has; ids with several texts are left out."""

    def run(batches):
        for batch in batches:
            for x, y, data, off in K.blocks(batch):
                d, g = kmers(data, off)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(x + d)), pa.array(g.view(np.int64))], names=["id", "k"])

    single = texts.groupBy("id").agg(F.count("*").alias("c")).where("c = 1").select("id")
    once = texts.mapInArrow(run, "id long, k long").groupBy("k").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    return once.groupBy("id").agg(F.count("*").alias("own")).join(single, "id", "left_semi")


def bucket_links(ids: np.ndarray, roots: np.ndarray, texts: list[np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links that join the components of a bucket's texts (given by their k-mers) as far as their links do; a spanning forest of them.

    An index of the k-mers gives the exact number of common ones of a text and all
    others; those that have enough are aligned, unless they are joined by then.
    """
    share = similarity / (1 + similarity)
    n = np.array([len(t) for t in texts])
    comp = np.unique(roots, return_inverse=True)[1]
    _, inv = np.unique(np.concatenate(texts), return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.argsort(inv, kind="stable")
    begin = np.append(0, np.cumsum(np.bincount(inv)))
    owner = owner[order]
    own = np.split(inv, np.cumsum(n)[:-1])
    for i in range(len(texts) - 1):
        if (comp == comp[0]).all():
            return
        if (comp[i + 1 :] == comp[i]).all():
            continue
        common = np.bincount(np.concatenate([owner[begin[k] : begin[k + 1]] for k in own[i]]), minlength=len(texts))
        may = (comp != comp[i]) & (common >= share * (n + n[i]) - 1e-9)
        may[: i + 1] = False
        for j in np.flatnonzero(may)[np.argsort(-common[may], kind="stable")].tolist():
            if comp[j] != comp[i] and aligned(texts[i], texts[j], similarity) >= similarity - 1e-9:
                comp[comp == comp[j]] = comp[i]
                yield int(ids[i]), int(ids[j])


def _across(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components that still share a bucket; rows: key, id, root, text.

    A bucket of more than ``BLOCK_BYTES`` is dealt out in blocks, each pair of
    blocks under a key of its own.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_BYTES).cast("int"), F.lit(1))
    sized = rows.join(rows.groupBy("key").agg(F.sum(F.octet_length("text")).alias("size")), "key")
    own = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    sized = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    sized = sized.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "root", "text")

    def run(batches):
        held: list[tuple[int, int, np.ndarray]] = []
        last = None
        out: list[tuple[int, int]] = []

        def close():
            ids, roots = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            if len(held) > 1 and (roots != roots[0]).any():
                out.extend(bucket_links(ids, roots, [x[2] for x in held], similarity))
            held.clear()

        for batch in batches:
            key, ids, roots = (batch.column(c).to_numpy() for c in ("key", "id", "root"))
            for x, y, data, off in K.blocks(batch):
                d, g = kmers(data, off)
                parts = np.split(g, np.cumsum(np.bincount(d, minlength=y - x))[:-1])
                for i in range(x, y):
                    if key[i] != last:
                        close()
                        last = key[i]
                    held.append((ids[i], roots[i], parts[i - x]))
        close()
        K.release()
        cols = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["a", "b"])

    return sized.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long")


def _split(rows: DataFrame) -> DataFrame:
    """The rows (key, id, root) of buckets that hold several components."""
    several = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return rows.join(several, "key", "left_semi").select("key", "id", "root")


def _id():
    """A document's number: its id, or one made of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) of every document that has a class with another document or text, by their numbers."""
    bounded_batches(docs.sparkSession)
    d = docs.select(_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sk = cut(_sketched(d.withColumn("same", F.unhex(F.md5("text")))), "sketches")
    # equal texts are one: the smallest id stands for them
    head = sk.groupBy("same").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1").select("same", "head")
    copies = cut(sk.select("id", "same").join(head, "same").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"), "same").distinct(), "copies")
    # an id's other texts stay
    reps = sk.join(copies.select(F.col("a").alias("id"), "same"), ["id", "same"], "left_anti") if copies.limit(1).count() else sk
    rows = reps.select("id", F.explode("keys").alias("key"))
    least = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1").select("key", "least")
    met = cut(rows.join(least, "key").distinct(), "buckets")
    stars = met.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    texts = cut(d.join(met.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    links = cut(_verified(stars, texts, similarity), "links")
    roots = components(links)
    label = met.select("id").distinct().join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    label = cut(label, "labels")
    # only buckets that still hold several components go on, with those of their texts that can be linked with another
    open_ = cut(_split(met.select("key", "id").join(label, "id")), "open-buckets")
    alone = _own_kmers(texts.join(open_.select("id").distinct(), "id", "left_semi"))
    sides = reps.select("id", "n").join(open_.select("id").distinct(), "id", "left_semi").join(alone, "id", "left")
    # at best with a text of 0.8 times its k-mers
    able = sides.where((F.col("n") - F.coalesce("own", F.lit(0))) >= similarity * F.col("n") - 1e-9).select("id").distinct()
    open_ = _split(open_.join(able, "id", "left_semi"))
    more = cut(_across(open_.join(texts, "id").select("key", "id", "root", "text"), similarity), "links")
    edges = copies.select("a", "b").distinct().union(links).union(more)
    found = components(edges)
    return found.select(F.col("node").alias("id"), F.col("root").alias("class_id"))


def _named(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """classes, each by its smallest document with an id, or of those without one; only needed where there are documents without."""
    known = docs.select(_id().alias("id"), F.col("doc_id").isNull().alias("none")).distinct()
    of = classes.join(known, "id").groupBy("class_id").agg(F.min(F.struct("none", "id")).alias("least"))
    return classes.join(of, "class_id").select("id", F.col("least.id").alias("class_id"), F.col("least.none").alias("none"))


def _ids_missing(docs: DataFrame) -> bool:
    return docs.where("doc_id is null").limit(1).count() > 0


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of each row of docs."""
    classes = near_classes(docs, similarity)
    if not _ids_missing(docs):
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        return d.join(classes, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _id().alias("key"))
    named = _named(docs, cut(classes, "classes")).where("not none")
    return d.join(named, F.col("key") == F.col("id"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents whose class has a smaller id; all rows of the ids that stay, with all columns."""
    classes = near_classes(docs, similarity)
    if not _ids_missing(docs):
        gone = classes.where("id <> class_id").select(F.col("id").alias("__gone"))
        return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
    gone = _named(docs, cut(classes, "classes")).where("id <> class_id").select(F.col("id").alias("__id"))
    left = docs.withColumn("__id", _id()).join(gone, "__id", "left_anti")
    # texts without words are no copies of each other
    one = (F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)))
    return left.where(~one).unionByName(left.where(one).dropDuplicates(["__id"])).select(*docs.columns)
