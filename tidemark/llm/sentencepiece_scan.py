"""SentencePiece encoding and decoding, with giant documents cut into chunks by a max-plus parallel scan.

A BPE tokenisation is the one path of pieces over a text in which every two
neighbours stay apart when merged on their own.  That makes encoding a max-plus
path problem: states are pieces, a step from piece to piece weighs 0 if the pair
stays apart and minus infinity if it doesn't, and the path of weight 0 is unique.
(The scores of a BPE model order its merges and are no weights of a path, so they
serve here through that test only.)

A giant document is cut at fixed places, wherever they fall.  The states at a cut
are the pieces that hold or end at it.  Each chunk yields the transfer matrix
between its two cuts' states; the matrices are combined associatively, in groups
of ``FAN`` and then groups of groups, from the left and from the right; the state
of every cut is the one that both sides reach; then each chunk is traced back on
its own.  Where no piece of the vocabulary spans two characters, the path must
pass between them: such places split a chunk's matrix into an outer product, and
what lies between the first and the last of them goes through the library.
Documents of at most ``GIANT`` characters are one chunk without cuts, which the
library encodes.

The model's pieces must not hold ``GUARD``, which keeps the library's leading
space off a part of a text.

Defined cases: a null or empty text has no ids and decodes to the empty string;
repeated rows are encoded row by row; a text's own U+2581 is a space, as the
library has it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, cut

GIANT = 32_768
CHUNK = 8_192
FAN = 64
GUARD = "\n"
SPACE = "▁"
NEVER = float("-inf")

_CHUNKS = pa.schema([("row", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("part", pa.string()), ("doc_id", pa.int64()), ("said", pa.binary())])
ENCODED = "doc_id long, n_tokens long, ids_crc32 long, n_chunks long, round_trip boolean, ids binary"


class Pieces:
    """The model's pieces, and the test whether two neighbours stay apart."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.pieces = {p.piece for p in proto.pieces if p.type == 1}
        if any(GUARD in p for p in self.pieces):
            raise ValueError("the model has pieces with the guard character")
        self.longest = max(map(len, self.pieces))
        self.inner = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        pairs = np.array(sorted((ord(x[0]) << 21) | ord(x[1]) for x in self.inner), np.int64)
        self.pairs = pairs if len(pairs) else np.zeros(1, np.int64)
        self.head = len(self.library.encode(GUARD))
        self.apart_: dict[tuple[str, str], bool] = {}

    def ids(self, part: str) -> list[int]:
        """Ids of a part of a text that begins and ends where the path must pass."""
        return self.library.encode(GUARD + part)[self.head :] if part else []

    def apart(self, u: str, v: str) -> bool:
        """Whether the pieces u, v are how u + v is encoded."""
        key = (u, v)
        known = self.apart_.get(key)
        if known is None:
            if len(self.apart_) > 1 << 20:
                self.apart_.clear()
            if u[-1] + v[0] not in self.inner:
                known = True
            else:
                got = self.library.encode(GUARD + (u + v), out_type=str)[self.head :]
                known = got == [u, v]
            self.apart_[key] = known
        return known

    def passes(self, text: str) -> np.ndarray:
        """Places 1..len-1 between two characters that no piece spans."""
        c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        pair = (c[:-1] << 21) | c[1:]
        i = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.flatnonzero(self.pairs[i] != pair) + 1

    def ending(self, text: str, q: int) -> list[int]:
        """Where pieces that end at q begin; a single character always is one."""
        return [p for p in range(max(0, q - self.longest), q) if p == q - 1 or text[p:q] in self.pieces]

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(begin, end) relative to ``at`` of the pieces that hold or end at it."""
        out = []
        for p in range(max(0, at - self.longest), at):
            for q in range(at, min(len(text), p + self.longest) + 1):
                if q == p + 1 or text[p:q] in self.pieces:
                    out.append((p - at, q - at))
        return out


State = tuple[int, int]


def _reach(pieces: Pieces, text: str, sources: list[tuple[int, int]], targets: set[tuple[int, int]], lo: int, hi: int) -> dict[tuple[int, int], int]:
    """For each target piece the set (bits) of source pieces it can be reached from; all as (begin, end) in text, between lo and hi."""
    masks: dict[int, dict[int, int]] = {}  # end -> begin -> bits
    for i, (p, q) in enumerate(sources):
        masks.setdefault(q, {})
        masks[q][p] = masks[q].get(p, 0) | 1 << i
    first = min(q for _, q in sources)
    for q in range(first + 1, hi + 1):
        for p in pieces.ending(text, q):
            if p < first or p not in masks:
                continue
            bits = 0
            v = text[p:q]
            for o, b in masks[p].items():
                if b & ~bits and pieces.apart(text[o:p], v):
                    bits |= b
            if bits:
                at = masks.setdefault(q, {})
                at[p] = at.get(p, 0) | bits
    return {(p, q): masks.get(q, {}).get(p, 0) for p, q in targets}


def _trace(pieces: Pieces, text: str, source: tuple[int, int], target: tuple[int, int]) -> list[tuple[int, int]]:
    """The pieces between source and target, without them."""
    if source == target:
        return []
    back: dict[tuple[int, int], tuple[int, int] | None] = {source: None}
    by_end: dict[int, list[int]] = {source[1]: [source[0]]}
    for q in range(source[1] + 1, target[1] + 1):
        for p in pieces.ending(text, q):
            for o in by_end.get(p, ()):
                if pieces.apart(text[o:p], text[p:q]):
                    back[p, q] = (o, p)
                    by_end.setdefault(q, []).append(p)
                    break
    path, at = [], back[target]
    while at is not None and at != source:
        path.append(at)
        at = back[at]
    return path[::-1]


class Chunk:
    """One chunk with the characters around it: its own are text[lo:hi]."""

    def __init__(self, pieces: Pieces, text: str, lo: int, hi: int, first: bool, last: bool):
        self.pieces, self.text, self.lo, self.hi, self.first, self.last = pieces, text.replace(" ", SPACE), lo, hi, first, last
        halo = pieces.longest
        inner = pieces.passes(self.text) if len(self.text) > 1 else np.zeros(0, np.int64)
        inner = inner[(inner > lo + halo) & (inner < hi - halo)]
        # the first and last place the path must pass, past all states of the cuts
        self.a, self.b = (0 if first else None), (len(self.text) if last else None)
        if len(inner):
            self.a = 0 if first else int(inner[0])
            self.b = len(self.text) if last else int(inner[-1])
        self.split = self.a is not None and self.b is not None
        self.left = [] if first else [(p + lo, q + lo) for p, q in pieces.states(self.text, lo)]
        self.right = [] if last else [(p + hi, q + hi) for p, q in pieces.states(self.text, hi)]

    def _from_left(self) -> list[float]:
        """Weight from each state of the left cut to the place a."""
        ends = {(p, self.a) for p in self.pieces.ending(self.text, self.a)}
        got = _reach(self.pieces, self.text, self.left, ends, self.lo, self.a)
        bits = 0
        for b in got.values():
            bits |= b
        return [0.0 if bits >> i & 1 else NEVER for i in range(len(self.left))]

    def _to_right(self) -> list[float]:
        """Weight from the place b to each state of the right cut."""
        begin = [(self.b - 1, self.b)]
        got = self._reach_from(begin, set(self.right))
        return [0.0 if got[s] else NEVER for s in self.right]

    def _reach_from(self, begin, targets):
        # the piece before a place that must be passed never matters
        return _reach(self.pieces, self.text, begin, targets, begin[0][1], max(q for _, q in targets))

    def matrix(self) -> np.ndarray:
        """States of the left cut by states of the right cut (one state at either end of a document)."""
        if self.split:
            left = np.zeros(1) if self.first else np.array(self._from_left())
            right = np.zeros(1) if self.last else np.array(self._to_right())
            return left[:, None] + right[None, :]
        targets = {(p, len(self.text)) for p in self.pieces.ending(self.text, len(self.text))} if self.last else set(self.right)
        sources = [(-1, 0)] if self.first else self.left
        text, shift = self.text, 0
        if self.first:  # something that never merges stands before a text
            text, shift = GUARD + SPACE + text, 2
            sources, targets = [(0, 1)], {(p + shift, q + shift) for p, q in targets}
            if self.last:
                targets = {(p, len(text)) for p in self.pieces.ending(text, len(text))}
        got = _reach(self.pieces, text, sources, targets, 0, max(q for _, q in targets))
        if self.last:
            bits = 0
            for b in got.values():
                bits |= b
            cols = [bits]
        else:
            cols = [got[(p + shift, q + shift)] for p, q in self.right]
        return np.array([[0.0 if c >> i & 1 else NEVER for c in cols] for i in range(len(sources))])

    def ids(self, state_in: int, state_out: int) -> list[int]:
        """The ids of the pieces that end after the left cut, up to the one that holds or ends at the right cut."""
        library, out = self.pieces.library, []
        text, shift = (GUARD + SPACE + self.text, 2) if self.first else (self.text, 0)

        def spell(path):
            for p, q in path:
                piece = text[p:q]
                out.extend([library.piece_to_id(piece)] if piece in self.pieces.pieces else self.pieces.ids(piece))

        source = (0, 1) if self.first else self.left[state_in]
        if not self.split:
            if self.last:
                for p in self.pieces.ending(text, len(text)):
                    target = (p, len(text))
                    if target == source:
                        return out
                    if _reach(self.pieces, text, [source], {target}, 0, len(text))[target]:
                        spell([*_trace(self.pieces, text, source, target), target])
                        return out
                raise ValueError("no path to the end")
            p, q = self.right[state_out]
            target = (p + shift, q + shift)
            if target != source:
                spell([*_trace(self.pieces, text, source, target), target])
            return out
        a, b = self.a, self.b
        if self.first:
            out.extend(library.encode(self.text[:b]))
        else:
            for p in self.pieces.ending(text, a):
                if _reach(self.pieces, text, [source], {(p, a)}, self.lo, a)[p, a]:
                    spell([*_trace(self.pieces, text, source, (p, a)), (p, a)])
                    break
            out.extend(self.pieces.ids(text[a:b]))
        if not self.last:
            p, q = self.right[state_out]
            begin = (b + shift - 1, b + shift)
            spell([*_trace(self.pieces, text, begin, (p + shift, q + shift)), (p + shift, q + shift)])
        return out


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    out = np.full((a.shape[0], b.shape[1]), NEVER)
    for k in range(a.shape[1]):
        np.maximum(out, a[:, k, None] + b[None, k, :], out=out)
    return out


def _pack(m: np.ndarray) -> dict:
    return {"rows": m.shape[0], "cols": m.shape[1], "free": np.packbits(m == 0).tobytes()}


def _unpack(rows: int, cols: int, free: bytes) -> np.ndarray:
    return np.where(np.unpackbits(np.frombuffer(free, np.uint8))[: rows * cols].reshape(rows, cols), 0.0, NEVER)


_loaded: list[tuple[object, Pieces]] = []


def _pieces(shared) -> Pieces:
    if not _loaded or _loaded[0][0] is not shared:
        _loaded[:] = [(shared, Pieces(shared.value))]
    return _loaded[0][1]


MATRIX = "row long, i long, rows int, cols int, free binary"


def _scan(matrices: DataFrame, most: int) -> DataFrame:
    """(row, i, before, after) for every matrix: which rows of it are reached from the document's start, and which columns reach its end.

    Groups of FAN neighbours are multiplied into one matrix each, those are
    scanned the same way, and what they find enters the groups: log(most) rounds,
    none of which holds more than FAN matrices of a document at once.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("g", (F.col("i") / FAN).cast("long"))

    def product(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        m = _unpack(rows[0]["rows"], rows[0]["cols"], rows[0]["free"])
        for r in rows[1:]:
            m = plus(m, _unpack(r["rows"], r["cols"], r["free"]))
        return pa.table({"row": [key[0].as_py()], "i": [key[1].as_py()], **{k: [v] for k, v in _pack(m).items()}}, schema=pa.schema([("row", pa.int64()), ("i", pa.int64()), ("rows", pa.int32()), ("cols", pa.int32()), ("free", pa.binary())]))

    def inside(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        ms = [_unpack(r["rows"], r["cols"], r["free"]) for r in rows]
        before = [np.where(np.frombuffer(rows[0]["before"], np.uint8), 0.0, NEVER)[None, :]]
        for m in ms[:-1]:
            before.append(plus(before[-1], m))
        after = [np.where(np.frombuffer(rows[0]["after"], np.uint8), 0.0, NEVER)[:, None]]
        for m in reversed(ms[1:]):
            after.append(plus(m, after[-1]))
        after.reverse()
        return pa.table({"row": [r["row"] for r in rows], "i": [r["i"] for r in rows], "before": [(x[0] == 0).astype(np.uint8).tobytes() for x in before], "after": [(x[:, 0] == 0).astype(np.uint8).tobytes() for x in after]})

    found = "row long, i long, before binary, after binary"
    if most <= FAN:
        whole = keyed(matrices).withColumn("before", F.lit(b"\x01")).withColumn("after", F.lit(b"\x01"))
    else:
        groups = cut(keyed(matrices).groupBy("row", "g").applyInArrow(product, MATRIX), "matrices")
        upper = _scan(groups, -(-most // FAN)).select("row", F.col("i").alias("g"), "before", "after")
        whole = keyed(matrices).join(upper, ["row", "g"])
    return whole.groupBy("row", "g").applyInArrow(inside, found)


def _said(text: str) -> bytes:
    """A fingerprint of what a text's ids decode to."""
    return hashlib.md5(text.replace(SPACE, " ").encode()).digest()


def _encode_giants(giants: DataFrame, shared) -> DataFrame:
    """doc_id, ids (little-endian u32), n_chunks and the text's fingerprint of giant documents, by way of their chunks."""
    halo = _pieces(shared).longest * 2 + 2

    def chop(batches):
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                n = -(-len(text) // CHUNK)
                for i in range(n):
                    lo, hi = i * CHUNK, min(len(text), (i + 1) * CHUNK)
                    a, b = max(0, lo - halo), min(len(text), hi + halo)
                    yield pa.RecordBatch.from_pylist([{"row": row, "i": i, "n": n, "lo": lo - a, "hi": hi - a, "part": text[a:b], "doc_id": doc_id, "said": None if i else _said(text)}], schema=_CHUNKS)

    # the texts are kept as chunks only; the row numbers are those written here
    chunks = cut(giants.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(chop, "row long, i long, n long, lo long, hi long, part string, doc_id long, said binary"), "chunks")

    def chunk(r: dict) -> Chunk:
        return Chunk(_pieces(shared), r["part"], r["lo"], r["hi"], r["i"] == 0, r["i"] == r["n"] - 1)

    def transfer(batches):
        for batch in batches:
            out = [{"row": r["row"], "i": r["i"], **_pack(chunk(r).matrix())} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("i", pa.int64()), ("rows", pa.int32()), ("cols", pa.int32()), ("free", pa.binary())]))

    matrices = cut(chunks.mapInArrow(transfer, MATRIX), "matrices")
    most = matrices.agg(F.max("i")).first()[0]
    if most is None:
        return chunks.select("doc_id", "said", F.lit(None).cast("binary").alias("ids"), F.lit(0).cast("long").alias("n_chunks"))
    states = _scan(matrices, most + 1)
    joined = chunks.join(states, ["row", "i"]).join(matrices, ["row", "i"])

    def trace(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m = _unpack(r["rows"], r["cols"], r["free"])
                before, after = np.frombuffer(r["before"], np.uint8), np.frombuffer(r["after"], np.uint8)
                live = [(a, b) for a in np.flatnonzero(before) for b in np.flatnonzero(after) if m[a, b] == 0]
                ids = chunk(r).ids(int(live[0][0]), int(live[0][1]))
                out.append({"row": r["row"], "i": r["i"], "ids": np.array(ids, "<u2" if small else "<u4").tobytes(), "doc_id": r["doc_id"], "said": r["said"]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("i", pa.int64()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("said", pa.binary())]))

    small = _pieces(shared).library.get_piece_size() <= 1 << 16
    traced = joined.mapInArrow(trace, "row long, i long, ids binary, doc_id long, said binary")
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("said").alias("said"), F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts"))  # one document's, like its text

    def join_parts(batches):
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<u2" if small else "<u4").astype("<u4").tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("said"), pa.array(ids, pa.binary()), pa.array([len(p) for p in parts], pa.int64())], names=["doc_id", "said", "ids", "n_chunks"])

    return whole.mapInArrow(join_parts, "doc_id long, said binary, ids binary, n_chunks long")


def encode(docs: DataFrame, model_path: str, giant: int = GIANT) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chunks, round_trip and ids (little-endian u32) of each row of docs.

    ids_crc32 is of those bytes; round_trip tells whether the ids decode to the
    text (its U+2581 as spaces).
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def finish(doc_id, same: list[bool], ids: list[list[int]], chunks: list[int]) -> pa.RecordBatch:
        raw = [np.array(x, "<u4").tobytes() for x in ids]
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(chunks, pa.int64()), pa.array(same, pa.bool_()), pa.array(raw, pa.binary())],
            names=["doc_id", "n_tokens", "ids_crc32", "n_chunks", "round_trip", "ids"],
        )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _pieces(shared).library
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column("text").to_pylist()
                ids = library.encode(texts, num_threads=1)
                same = [t.replace(SPACE, " ") == x for t, x in zip(texts, library.decode(ids, num_threads=1))]
                yield finish(part.column("doc_id"), same, ids, [1] * len(ids))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _pieces(shared).library
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part = batch.slice(a, 16)
                ids = [np.frombuffer(x, "<u4").tolist() for x in part.column("ids").to_pylist()]
                same = [_said(x) == y for x, y in zip(library.decode(ids, num_threads=1), part.column("said").to_pylist())]
                yield finish(part.column("doc_id"), same, ids, part.column("n_chunks").to_pylist())

    small = d.where(F.length("text") <= giant).mapInArrow(whole, ENCODED)
    return small.union(_encode_giants(d.where(F.length("text") > giant), shared).mapInArrow(chunked, ENCODED))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())

    def run(batches):
        library = _pieces(shared).library
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(library.decode(ids, num_threads=1), pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
