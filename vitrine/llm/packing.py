"""Packing by best-fit decreasing.

Texts are tokenised whole and end with a separator id. A document longer than
a window is first cut into full windows; full windows and the shorter rests
are dealt to packers by a hash, sorted by decreasing length (Spark's external
sort), and each packer streams over its pieces: a segment tree indexed by
remaining capacity finds the tightest open window that still holds the piece,
or a new window is opened. Memory of a packer: one small integer per open
window.

A batch's text is cut around its special-token strings and before single
blanks, and every distinct piece is encoded once; a blank before a non-blank always
starts a new pre-token and a special token stands alone, so the ids are those of
the whole text. The ids of ``byte_bpe_50k.json`` are
produced with its rank file, ``byte_bpe_50k.tiktoken``, the same vocabulary
for the faster library.

Defined cases: null or empty text is the separator alone; the string
``<|endoftext|>`` in a text is that token's one id, as the vocabulary has it; rows with equal ids are packed each; an
empty table gives no pieces. ``sequence_id`` is unique, not consecutive. Only
doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import frees, slices

WINDOW = 2048
#: Fixed value: the special token of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def default_vocabulary() -> tuple[str, str]:
    """(rank file, split pattern) of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _specials(whole: bytes, offset: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the special tokens inside concatenated texts."""
    out = []
    for name in map(str.encode, SPECIAL):
        at = whole.find(name)
        while at >= 0:
            inside = at + len(name) <= offset[np.searchsorted(offset, at, side="right")]
            if inside:
                out.append((at, at + len(name)))
            at = whole.find(name, at + (len(name) if inside else 1))
    return out


def _pieces(whole: bytes, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each piece, row of each piece) of concatenated texts."""
    data = np.frombuffer(whole, dtype=np.uint8)
    plain = (data > 32) & (data < 127)
    cut = np.zeros(len(data) + 1, dtype=bool)
    special = np.array(_specials(whole, offset), dtype=np.int64).reshape(-1, 2)
    plain[special[:, 0]] = False                        # blanks before a special token stay together
    cut[1:-2] = (data[1:-1] == 32) & plain[2:]          # a blank before a visible ASCII byte
    cut[special] = True
    cut[offset[:-1][np.diff(offset) > 0]] = True
    start = np.flatnonzero(cut[:-1])
    return start, np.searchsorted(offset, start, side="right") - 1


def encode(texts: list[bytes], vocabulary: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text)."""
    offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    whole = b"".join(texts)
    start, row = _pieces(whole, offset)
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
    bounds = np.append(start, len(whole)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(whole)]).dictionary_encode()
    enc = encoder(vocabulary, pattern)
    ids = [[SPECIAL[w]] if w in SPECIAL else enc.encode_ordinary(w)
           for w in (x.decode("utf-8", "replace") for x in coded.dictionary.to_pylist())]
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter((i for w in ids for i in w), dtype=np.uint32, count=int(size.sum()))
    first = np.cumsum(size) - size
    code = coded.indices.to_numpy(zero_copy_only=False)
    n = size[code]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[code], n)
    return flat[at], np.bincount(row, n, len(texts)).astype(np.int64)


@frees
def _tokenise(batches, vocabulary: str, pattern: str, window: int, end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            doc_ids = part.column("doc_id").to_pylist()
            ids, size = encode([t or b"" for t in part.column("text").to_pylist()], vocabulary, pattern)
            cut = np.concatenate([[0], np.cumsum(size)])
            rows: tuple[list, ...] = ([], [], [], [], [])
            for k, doc in enumerate(doc_ids):
                own = np.append(ids[cut[k]:cut[k + 1]], end).astype("<u4")
                for at in range(0, len(own), window):
                    piece = own[at:at + window]
                    for column, value in zip(rows, (doc, at, len(piece), piece.tobytes(), len(own)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                ["doc_id", "start", "length", "ids", "doc_tokens"])


def tokenise(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, window: int = WINDOW,
             end: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens): full windows and the
    rest of each document; ``ids`` are little-endian unsigned 32-bit."""
    if vocabulary is None:
        vocabulary, pattern = default_vocabulary()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(partial(_tokenise, vocabulary=vocabulary, pattern=pattern, window=window, end=end),
                          "doc_id long, start long, length long, ids binary, doc_tokens long")


class Windows:
    """Open windows by remaining capacity, under a segment tree whose node
    tells whether any window lies below it."""

    def __init__(self, window: int):
        self.window, self.leaves = window, 1 << (window - 1).bit_length()
        self.live = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.made = 0

    def _tightest(self, length: int) -> int:
        """Smallest capacity >= length with an open window, or 0."""
        live, node = self.live, length + self.leaves
        if length >= self.window:
            return 0
        if live[node]:
            return length
        while node > 1:                       # up to the first live right sibling
            if not node & 1 and live[node + 1]:
                node += 1
                while node < self.leaves:     # down to its leftmost live leaf
                    node = 2 * node if live[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0

    def _mark(self, capacity: int, on: int) -> None:
        live, node = self.live, capacity + self.leaves
        live[node] = on
        while node > 1:
            node >>= 1
            value = live[2 * node] | live[2 * node + 1]
            if live[node] == value:
                break
            live[node] = value

    def place(self, length: int) -> tuple[int, int]:
        """(window number, offset in it) of a piece."""
        room = self._tightest(length)
        if room:
            number = self.open[room].pop()
            if not self.open[room]:
                self._mark(room, 0)
        else:
            number, room = self.made, self.window
            self.made += 1
        left = room - length
        if left:
            if not self.open[left]:
                self._mark(left, 1)
            self.open[left].append(number)
        return number, self.window - room


@frees
def _pack(batches, window: int) -> Iterator[pa.RecordBatch]:
    tree, base = Windows(window), TaskContext.get().partitionId() << 40
    for batch in batches:
        placed = [tree.place(n) for n in batch.column("length").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([base + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())],
            [*batch.schema.names, "sequence_id", "offset"])


def assign_windows(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length and any others) with sequence_id and
    offset."""
    dealt = pieces.repartition(F.xxhash64("doc_id", "start")) \
        .sortWithinPartitions(F.desc("length"), "doc_id", "start")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.mapInArrow(partial(_pack, window=window), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their ids and places."""
    return assign_windows(tokenise(docs, window=window), window)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    pieces = tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign_windows(digest)
