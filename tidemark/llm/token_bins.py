"""Token ids in files of fixed-width bit-packed blocks, with random access.

Documents are dealt out by ranges of doc_id and sorted; each task encodes its
texts and streams one file into the shared folder:

    magic (8 bytes) | blocks | index | length of the index (u64) | magic

A block holds up to ``BLOCK_IDS`` ids, each in the fewest bits that fit the
vocabulary, lowest bits first; the index (little-endian) has the width, the
block size, the byte offset of every block, and id and first token of every
document.  ``unpack`` decodes whole blocks with a fixed number of numpy passes;
``read_ids`` reads any token range of a file and touches only its blocks.

Each writing task returns its file's name and counts; only files named in that
list belong to the data set, so a task that ran twice leaves no second copy in it.

Splitting into pieces before the merges is vectorised, and the ids of a piece are
kept in a hash table, so the tokenizers library encodes each piece once for as
long as it stays there (``CACHE_PIECES``; then the table starts afresh).  What the
table holds of each piece is compared with the text, character by character; a
block in which two pieces' hashes met goes through the library.  The
split follows the byte-level pattern; which characters are letters, digits,
spaces or others is asked from the library itself.

Defined cases: a null or empty text is the end id alone; rows of one id stand in
the order of their texts; a null id comes first; an empty table has no files and
no rows; other columns are not read.

Files go through pyarrow's file systems (file, s3 and s3a, gs, abfs, and hdfs and
viewfs where libhdfs is installed); a
checkpoint folder of another scheme needs a ``path`` of one of these.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import bounded_batches, fresh_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAGIC = b"TIDEBIN1"
END_ID = 2
BLOCK_IDS = 1 << 16
CACHE_PIECES = 1 << 20

_LETTER, _DIGIT, _OTHER, _SPACE, _UNSEEN = range(5)


# --- packing -----------------------------------------------------------------


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids at ``width`` bits each, lowest bits first, in whole bytes; the rest of the last byte is 0."""
    n = len(ids)
    groups = np.zeros((-(-n // 8), 8), np.uint64)
    groups.reshape(-1)[:n] = ids
    out = np.zeros((len(groups), width), np.uint8)
    for k in range(8):
        first = k * width
        for j in range(first // 8, (first + width - 1) // 8 + 1):
            s = 8 * j - first
            v = groups[:, k] >> np.uint64(s) if s >= 0 else groups[:, k] << np.uint64(-s)
            out[:, j] |= (v & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: (n * width + 7) // 8]


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids of packed bytes, as uint32."""
    m = -(-n // 8)
    data = np.zeros(m * width, np.uint8)
    data[: min(len(raw), m * width)] = np.frombuffer(raw, np.uint8, min(len(raw), m * width))
    data = data.reshape(m, width)
    out = np.zeros((m, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        first, v = k * width, np.zeros(m, np.uint64)
        for j in range(first // 8, (first + width - 1) // 8 + 1):
            s = 8 * j - first
            b = data[:, j].astype(np.uint64)
            v |= b << np.uint64(s) if s >= 0 else b >> np.uint64(-s)
        out[:, k] = v & mask
    return out.reshape(-1)[:n]


class BinWriter:
    """Streams ids of documents into one file; memory is a block and the index."""

    def __init__(self, sink, width: int, block_ids: int = BLOCK_IDS):
        self.sink, self.width, self.block = sink, width, block_ids
        self.sink.write(MAGIC)
        self.at, self.offsets, self.pending, self.held = len(MAGIC), [len(MAGIC)], [], 0
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.starts.append(self.n_ids + np.cumsum(lengths) - lengths)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(self.held // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for a in range(0, n, self.block):
            raw = pack(ids[a : min(a + self.block, n)], self.width)
            self.sink.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.pending, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        starts = np.concatenate(self.starts) if self.starts else np.zeros(0, np.int64)
        index = struct.pack("<IIQQQ", self.width, self.block, self.n_ids, len(docs), len(self.offsets) - 1)
        index += np.array(self.offsets, "<u8").tobytes() + docs.astype("<i8").tobytes() + starts.astype("<u8").tobytes()
        self.sink.write(index + struct.pack("<Q", len(index)) + MAGIC)


class BinReader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        length = struct.unpack("<Q", tail[:8])[0]
        source.seek(size - 16 - length)
        index = source.read(length)
        self.width, self.block, self.n_ids, n_docs, n_blocks = struct.unpack_from("<IIQQQ", index)
        at = struct.calcsize("<IIQQQ")
        self.offsets = np.frombuffer(index, "<u8", n_blocks + 1, at).astype(np.int64)
        at += 8 * (n_blocks + 1)
        self.docs = np.frombuffer(index, "<i8", n_docs, at)
        self.starts = np.append(np.frombuffer(index, "<u8", n_docs, at + 8 * n_docs).astype(np.int64), self.n_ids)

    def read_ids(self, a: int, b: int) -> np.ndarray:
        """Tokens a..b-1 of the file; only the blocks they lie in are read."""
        if b <= a:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        self.source.seek(int(self.offsets[i]))
        raw = self.source.read(int(self.offsets[j] - self.offsets[i]))
        parts = []
        for k in range(i, j):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(raw[int(self.offsets[k] - self.offsets[i]) : int(self.offsets[k + 1] - self.offsets[i])], n, self.width))
        return np.concatenate(parts)[a - i * self.block : b - i * self.block]


# --- encoding ----------------------------------------------------------------


def character_kinds(tokenizer, points: np.ndarray) -> np.ndarray:
    """Kind of each code point, as the tokenizer's own split sees it: glued to a letter, a digit or another sign, or a space."""
    kinds = np.full(len(points), _SPACE, np.uint8)
    for kind, sign in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")):
        line = np.full((len(points), 3), ord("\n"), "<u4")
        line[:, 0], line[:, 1] = ord(sign), points
        begins = np.zeros(line.size + 1, bool)
        begins[[a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(line.tobytes().decode("utf-32-le"))]] = True
        kinds[~begins[1:-1:3]] = kind
    return kinds


def pieces(points: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pieces of a block of texts begin (code point positions, ascending); off: where its texts begin and end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    last = np.zeros(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    space = kind == _SPACE
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # the last of a run of spaces before something else stands alone, or joins what follows if it is x20
    ends = np.zeros(n, bool)
    ends[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    at = np.flatnonzero(ends)
    begin[at] = True
    joined = at[points[at] == 0x20]
    begin[joined + 1] = False
    # 's 't 're 've 'm 'll 'd where an apostrophe begins a piece of its own and a letter follows
    quote = np.flatnonzero((points == 0x27) & begin & ~last)
    quote = quote[kind[quote + 1] == _LETTER]
    if len(quote):
        two = points[np.minimum(quote + 2, n - 1)] * ((quote + 2 < n) & ~last[quote + 1])
        one = points[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((short, 2), (pair & ~short, 3)):
            q = quote[hit]
            begin[q + 1] = False
            nxt = q + size
            nxt = nxt[nxt < n]
            begin[nxt] |= kind[nxt] == _LETTER
    return np.flatnonzero(begin)


class Encoder:
    """Ids of blocks of texts, equal to those of tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, tokenizer, room: int = CACHE_PIECES):
        self.tokenizer, self.room = tokenizer, room
        self.kinds = np.full(0x110000, _UNSEEN, np.uint8)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.size = 2 * self.room
        self.keys, self.slot_piece = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64)
        self.known, self.start, self.length = 0, np.zeros(self.room + 1, np.int64), np.zeros(self.room + 1, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text_start, self.text_length = np.zeros(self.room + 1, np.int64), np.zeros(self.room + 1, np.int32)
        self.text, self.text_used = np.zeros(1 << 16, "<u4"), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 where it isn't kept."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(3)).astype(np.int64) % self.size
        open_ = np.arange(len(h))
        while len(open_):
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.slot_piece[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) % self.size
        return out

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        length = np.array([len(t) for t in texts])
        some = slice(self.known, self.known + len(texts))
        self.text_start[some], self.text_length[some] = self.text_used + np.cumsum(length) - length, length
        while self.text_used + len(points) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_used : self.text_used + len(points)] = points
        self.text_used += len(points)
        for key, e in zip(h.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = e.ids
            slot = (key >> 3) % self.size
            while self.keys[slot]:
                slot = (slot + 1) % self.size
            self.keys[slot], self.slot_piece[slot] = key, self.known
            self.start[self.known], self.length[self.known] = self.used, len(ids)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.known += 1

    def _plain(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as block, by the library alone."""
        ids = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(off[:-1], off[1:])]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _same(self, piece: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether the pieces found are, one after the other, the text."""
        length = self.text_length[piece]
        if (length != ends - starts).any():
            return False
        return bool((self.text[np.arange(len(points)) + np.repeat(self.text_start[piece] - starts, length)] == points).all())

    def block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each text)."""
        raw = data.tobytes()
        if any(a.encode() in raw for a in self.added):
            return self._plain(raw, off)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        if len(new := np.unique(points[self.kinds[points] == _UNSEEN])):
            self.kinds[new] = character_kinds(self.tokenizer, new)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]  # code points before each text
        starts = pieces(points, begins, self.kinds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        ends = np.append(starts[1:], len(points))
        h = K.span_hashes(points, starts, ends) | np.uint64(1)
        piece = self._find(h)
        if (piece < 0).any():
            new, where = np.unique(h[piece < 0], return_index=True)
            where = np.flatnonzero(piece < 0)[where]
            if self.known + len(new) > self.room:
                self._clear()
                self.room = self.room if len(new) <= self.room else 2 * len(new)
                self._clear()
                new, where = np.unique(h, return_index=True)
            self._learn(new, [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[where], ends[where])])
            piece = self._find(h)
        if not self._same(piece, points, starts, ends):
            return self._plain(raw, off)
        n = self.length[piece].astype(np.int64)
        total = np.cumsum(n)
        at = np.arange(int(total[-1])) + np.repeat(self.start[piece] - (total - n), n)
        text = np.searchsorted(begins, starts, side="right") - 1
        return self.ids[at], np.bincount(text, n, len(off) - 1).astype(np.int64)


_encoders: list[tuple[object, Encoder]] = []


def _encoder(shared) -> Encoder:
    from tokenizers import Tokenizer

    if not _encoders or _encoders[0][0] is not shared:
        _encoders[:] = [(shared, Encoder(Tokenizer.from_str(shared.value)))]
    return _encoders[0][1]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path, and the path in it."""
    try:
        return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"token files can't be written to {uri}: give a path of a file system pyarrow knows") from e


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, path: str | None = None) -> list[dict]:
    """Writes the files and returns their list, in order: path, docs, ids, base (ids in the files before)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or fresh_path(spark, "tokens")
    text = open(tokenizer_path, encoding="utf-8").read()
    own = Tokenizer.from_str(text)
    width = width_of(max(own.get_vocab_size(with_added_tokens=True), end_id + 1))
    shared = spark.sparkContext.broadcast(text)
    pafs_, root = _filesystem(path)
    pafs_.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(path)
        encoder, part = _encoder(shared), TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.bin"
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                sink = fs.open_output_stream(name)
                out = BinWriter(sink, width)
            doc_ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            for a, b, data, off in K.blocks(batch):
                ids, n = encoder.block(data, off)
                ends = np.cumsum(n + 1) - 1
                with_end = np.full(len(ids) + b - a, end_id, np.uint32)
                inside = np.ones(len(with_end), bool)
                inside[ends] = False
                with_end[inside] = ids
                out.add(doc_ids[a:b], with_end, n + 1)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [sum(map(len, out.docs))], "ids": [out.n_ids]})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "part long, name string, docs long, ids long").collect()  # one row a file
    out, base = [], 0
    for f in sorted(files, key=lambda r: r.part):
        out.append({"path": path.rstrip("/") + "/" + f.name.rsplit("/", 1)[1], "docs": f.docs, "ids": f.ids, "base": base})
        base += f.ids
    with pafs_.open_output_stream(f"{root}/files.json") as sink:
        sink.write(json.dumps({"end_id": end_id, "width": width, "files": out}).encode())
    return out


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, decoded from their blocks."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, at = _filesystem(name)
                with fs.open_input_file(at) as source:
                    reader = BinReader(source)
                    n, a = len(reader.docs), 0
                    while a < n:  # whole documents of about a few blocks at a time
                        b = min(n, max(a + 1, int(np.searchsorted(reader.starts, reader.starts[a] + 8 * reader.block, side="right")) - 1))
                        s = reader.starts[a : b + 1]
                        raw = memoryview(reader.read_ids(int(s[0]), int(s[-1])).astype("<u4")).cast("B")
                        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((s[:-1] - s[0]).tolist(), (s[1:] - s[0]).tolist())]
                        doc = reader.docs[a:b]
                        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == np.iinfo(np.int64).min), pa.array(s[:-1] + base), pa.array(np.diff(s)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        a = b

    rows = [(f["path"], f["base"]) for f in files]
    paths = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encodes docs into files and returns, read back from them, where each document starts, its ids' number and crc32."""
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer_path, end_id))
