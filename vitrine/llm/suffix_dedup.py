"""Suffix-array deduplication: cut every byte covered by a string of
``length`` bytes that also starts earlier in the corpus.

Equal strings are brought together by content: in every window of ``length``
bytes the k-gram with the smallest hash is its anchor, so equal windows have
equal anchors. Neighbouring windows with the same anchor form one snippet (at
most 2 * length - k bytes). Snippets are dealt by their anchor's hash:

1. Equal snippets of an anchor are one class; all but the first (doc_id,
   start) are repeats. Classes are cut down map-side first, so a crowd of
   copies reaches the shuffle as one row per batch.
2. Anchors with several classes (passages with different surroundings) need
   the strings themselves. Their snippets are concatenated in bounded
   buffers, whose suffixes are sorted in two stages: only suffixes smaller
   than their successors are sorted directly, the others are induced by
   scanning the buckets of first bytes; then adjacent common prefixes of at
   least ``length`` mark the equal windows.
3. An anchor with more classes than a buffer may hold is cut into chunks; the
   first window of every string in a chunk is then matched across chunks by a
   128-bit digest, aggregated map-side.

Anchor and snippet equality is that of two independent 64-bit hashes.

Defined cases: null text is empty; texts shorter than ``length`` keep all;
equal doc_ids are ordered by a hash of their texts, and fully equal rows are
one document whose result each row gets; a null doc_id comes before all
others; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import frees, materialise, slices, unused
from vitrine.llm.linear import mix

LENGTH = 100
GRAM = 24
SEGMENT = 1 << 20          # bytes hashed at once
BUFFER = 1 << 20           # bytes sorted at once
SLICE = 4 << 20            # bytes of a batch turned into Python objects at once
CHUNK = 4096               # classes of an anchor in one buffer
NULL_ID = -(1 << 63)

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_CODE = "doc long, tie long, place long"

# place packs a range of window starts: first start << 17 | repeat << 16 |
# (anchor - first) << 8 | (last - first)
_START, _REPEAT, _ANCHOR, _MASK = 17, 16, 8, 255


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, dtype=np.uint64), np.full(n, _P_INV, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def snippets(text: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Snippets of a buffer: (first start, last start, anchor, anchor hash,
    snippet hash). ``valid``: rising array of (begin, end) of the window
    starts that may be used, one row per document segment."""
    n = len(text)
    up, down = _powers(1 << (n + length).bit_length())
    table = mix(np.arange(1, 257, dtype=np.uint64))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[text] * up[:n], out=prefix[1:])
    h = mix((prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1])
    low = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)     # ties go to the leftmost
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, dtype=np.int64)
    np.add.at(inside, valid[:, 0], 1)
    np.add.at(inside, valid[:, 1], -1)
    inside = np.cumsum(inside[:-1]) > 0
    cut = np.ones(len(anchor), dtype=bool)
    cut[1:] = anchor[1:] != anchor[:-1]
    cut[valid[:, 0][valid[:, 0] < len(anchor)]] = True
    cut[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(anchor)) - 1
    use = inside[first]
    first, last = first[use], last[use]
    anchor = anchor[first]
    body = mix((prefix[last + length] - prefix[first]) * down[first] * np.uint64(0xD6E8FEB86659FD93)
               + ((anchor - first) * 256 + (last - first)).astype(np.uint64))
    return first, last, anchor, h[anchor], body


def _segments(batches, length: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Buffers of about SEGMENT bytes: ([(doc, tie, offset in text)], text,
    (begin, end) of window starts); long texts are cut with an overlap."""
    parts, meta, valid, size = [], [], [], 0
    for batch in (part for b in batches for part in slices(b, "text", SLICE)):
        for doc, tie, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text")), strict=True):
            for at in range(0, len(text) - length + 1, SEGMENT // 2):
                piece = text[at:at + SEGMENT // 2 + length - 1]
                if size and size + len(piece) > SEGMENT:
                    yield meta, np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(valid)
                    parts, meta, valid, size = [], [], [], 0
                parts.append(piece)
                meta.append((doc, tie, at))
                valid.append((size, size + len(piece) - length + 1))
                size += len(piece)
    if size:
        yield meta, np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(valid)


def _place(start, anchor, last, repeat) -> np.ndarray:
    return (start << _START) | (np.asarray(repeat, dtype=np.int64) << _REPEAT) | ((anchor - start) << _ANCHOR) | (last - start)


@frees
def _anchors(batches, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, body, doc, tie, place); repeats inside a run of buffers are
    told apart here and leave their anchor's group."""
    held: list[list[np.ndarray]] = []
    for meta, text, valid in _segments(batches, length):
        first, last, anchor, h, body = snippets(text, valid, length, gram)
        seg = np.searchsorted(valid[:, 0], first, side="right") - 1
        doc, tie, at = (np.array(c, dtype=np.int64) for c in zip(*meta, strict=True))
        shift = (at - valid[:, 0])[seg]
        held.append([h.view(np.int64), body.view(np.int64), doc[seg], tie[seg],
                     _place(first + shift, anchor + shift, last + shift, np.zeros(len(first)))])
        if sum(len(x[0]) for x in held) > 250_000:
            yield _local(held)
            held = []
    if held:
        yield _local(held)


def _local(held: list) -> pa.RecordBatch:
    h, body, doc, tie, place = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((place, tie, doc, body, h))
    h, body, doc, tie, place = (c[order] for c in (h, body, doc, tie, place))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (body[1:] == body[:-1])
    away = mix((doc * 31 + place).astype(np.uint64)).view(np.int64)      # repeats are spread evenly
    h = np.where(again, away, h)
    place = place | (again.astype(np.int64) << _REPEAT)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (h, body, doc, tie, place)], ["h", "body", "doc", "tie", "place"])


@frees
def _classes(batches, chunk: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, body, doc, tie, place): repeats, and the first
    row of every class of anchors with several classes (with h and a chunk
    number). Holds one row back between batches."""
    prev = None          # (h, body) of the last row
    number = 0           # classes of its anchor so far
    pending = None       # the anchor's first class, while it is the only one

    def out(h, c, doc, tie, place):
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(c, pa.int32()), pa.array(doc), pa.array(tie), pa.array(place)],
            ["h", "chunk", "doc", "tie", "place"])

    for batch in batches:
        h, body, doc, tie, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "body", "doc", "tie", "place"))
        known = (place >> _REPEAT) & 1 == 1
        if known.any():
            yield out([None] * int(known.sum()), [0] * int(known.sum()), doc[known], tie[known], place[known])
            h, body, doc, tie, place = (c[~known] for c in (h, body, doc, tie, place))
        if len(h) == 0:
            continue
        new_h, new_c = np.ones(len(h), dtype=bool), np.ones(len(h), dtype=bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (body[1:] != body[:-1])
        if prev is not None:
            new_h[0] = h[0] != prev[0]
            new_c[0] = new_h[0] or body[0] != prev[1]
        again = np.flatnonzero(~new_c)
        if len(again):
            yield out([None] * len(again), [0] * len(again), doc[again], tie[again], place[again])
        prev = (h[-1], body[-1])
        f = np.flatnonzero(new_c)
        if len(f) == 0:
            continue
        opens = new_h[f]
        lead = np.maximum.accumulate(np.where(opens, np.arange(len(f)), -1))
        index = np.where(lead >= 0, np.arange(len(f)) - lead, number + np.arange(len(f)))
        several = ~opens
        several[:-1] |= ~opens[1:]
        several[-1] = not opens[-1]
        if pending is not None and not opens[0]:
            yield out([pending[0]], [0], *(np.array([x]) for x in pending[1:]))
        number = int(index[-1]) + 1
        pending = (int(h[f[-1]]), doc[f[-1]], tie[f[-1]], place[f[-1]]) if opens[-1] else None
        s = f[several]
        if len(s):
            yield out(h[s], index[several] // chunk, doc[s], tie[s], place[s])


# ------------------------------------------------------- two-stage suffix sort

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte array in the order of their first ``depth`` bytes
    (suffixes equal that far stand together)."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # type B: smaller than the successor; equal bytes take the type behind them
    step = np.ones(n, dtype=bool)
    step[:-1] = text[:-1] != text[1:]
    turn = np.flatnonzero(step)
    small = np.append(text[turn[:-1]] < text[turn[:-1] + 1], False)
    is_b = small[np.searchsorted(turn, np.arange(n))]
    # direct sort of type B
    padded = np.zeros(n + depth, dtype=np.uint8)
    padded[:n] = text
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    b = np.flatnonzero(is_b)
    key = np.ascontiguousarray(rows[b]).view(f"S{depth}").ravel()
    b = b[np.argsort(key, kind="stable")]
    b_cut = np.searchsorted(text[b], np.arange(257))
    # the rest by bucket scans: a scanned suffix puts its predecessor of type A
    # at the front of that one's bucket
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    front[text[n - 1]].append(np.array([n - 1]))
    order = []

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~is_b[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        first, before = first[by], before[by]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(first)]]) if len(first) else [0]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            front[first[x]].append(before[x:y])

    for c in range(256):
        done = 0
        while done < len(front[c]):            # runs of equal bytes add to their own bucket
            part = front[c][done]
            done += 1
            order.append(part)
            induce(part)
        part = b[b_cut[c]:b_cut[c + 1]]
        if len(part):
            order.append(part)
            induce(part)
    return np.concatenate(order)


def common_prefix_at_least(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` bytes with the one before it in
    ``order`` (all have that many bytes)."""
    same = np.zeros(len(order), dtype=bool)
    left = np.arange(1, len(order))
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    words = np.zeros(len(text) + 1, dtype=np.uint64)
    for k in range(8):
        words |= padded[k:k + len(words)].astype(np.uint64) << np.uint64(8 * (7 - k))
    for at in [*range(0, length - 7, 8), length - 8]:
        left = left[words[order[left] + at] == words[order[left - 1] + at]]
    same[left] = True
    return same


def equal_windows(pieces: list[bytes], starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable windows of snippets and their string: (buffer position, string
    number); ``starts``: usable starts at the head of each snippet."""
    size = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"\x00".join(pieces) + b"\x00", dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    usable = np.zeros(len(text), dtype=bool)
    usable[np.repeat(begin, starts) + np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)] = True
    order = suffix_order(text, length + 4)
    order = order[usable[order]]
    return order, np.cumsum(~common_prefix_at_least(text, order, length)) - 1


@frees
def _sort_snippets(batches, length: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows; and the first window of every string, with
    its digest, where an anchor has several chunks."""
    rows, size = [], 0
    for batch in (part for b in batches for part in slices(b, "snippet", SLICE)):
        cols = (batch.column(c).to_pylist() for c in ("h", "chunk", "doc", "tie", "place", "snippet"))
        for r in zip(*cols, strict=True):
            if size > BUFFER and (r[0], r[1]) != (rows[-1][0], rows[-1][1]):
                yield _resolve(rows, length, chunk)
                rows, size = [], 0
            rows.append(r)
            size += len(r[5])
    if rows:
        yield _resolve(rows, length, chunk)


def _resolve(rows: list, length: int, chunk: int) -> pa.RecordBatch:
    pieces = [r[5] for r in rows]
    place = np.array([r[4] for r in rows], dtype=np.int64)
    doc, tie = (np.array([r[k] for r in rows], dtype=np.int64) for k in (2, 3))
    start, starts = place >> _START, (place & _MASK) + 1
    begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])[:-1]])
    at, string = equal_windows(pieces, starts, length)
    own = np.searchsorted(begin, at, side="right") - 1
    where = start[own] + at - begin[own]
    by = np.lexsort((where, tie[own], doc[own], string))
    at, string, own, where = at[by], string[by], own[by], where[by]
    head = np.ones(len(at), dtype=bool)
    head[1:] = string[1:] != string[:-1]
    # repeats, neighbours joined to ranges
    r = np.flatnonzero(~head)
    r = r[np.argsort(at[r])]
    cut = np.ones(len(r), dtype=bool)
    cut[1:] = (np.diff(at[r]) != 1) | (own[r][1:] != own[r][:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(r)) - 1
    a, z = r[first], r[last]
    out = [(None, int(doc[own[i]]), int(tie[own[i]]), int(p)) for i, p in
           zip(a, _place(where[a], where[a], where[z], np.ones(len(a))), strict=True)]
    # anchors cut into chunks: one row per string goes on
    count: dict = {}
    for r_ in rows:
        count[r_[0], r_[1]] = count.get((r_[0], r_[1]), 0) + 1
    many = np.array([r_[1] > 0 or count[r_[0], r_[1]] >= chunk for r_ in rows])
    if many.any():
        text = b"\x00".join(pieces)
        for i in np.flatnonzero(head & many[own]):
            digest = hashlib.blake2b(text[at[i]:at[i] + length], digest_size=16).digest()
            out.append((digest, int(doc[own[i]]), int(tie[own[i]]), int(_place(where[i], where[i], where[i], 1))))
    cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["digest", "doc", "tie", "place"])


# -------------------------------------------------------------------- assembly

def order_key(docs: DataFrame) -> tuple[dict, bool]:
    """Columns (doc, tie) that order the documents, and whether ids repeat;
    the tie, a hash of the text, is needed only then."""
    repeat = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    tie = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))) if repeat else F.lit(0).cast("long")
    return {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "tie": tie}, repeat


def keyed(docs: DataFrame, key: dict, repeat: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with their order key and bytes; and the distinct
    documents among them."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        *[c.alias(n) for n, c in key.items()])
    texts = own.select("doc", "tie", "text")
    return own, texts.dropDuplicates(["doc", "tie"]) if repeat else texts


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """(doc, tie, place): ranges of window starts whose string starts earlier
    in the distinct documents ``texts`` (doc, tie, text)."""
    if not gram < length <= gram + _MASK:
        raise ValueError("length must exceed gram by 1 to 255")
    rows = texts.mapInArrow(partial(_anchors, length=length, gram=gram), f"h long, body long, {_CODE}")
    dealt = rows.repartition("h").sortWithinPartitions("h", "body", "doc", "tie", "place")
    found = materialise(dealt.mapInArrow(partial(_classes, chunk=chunk), f"h long, chunk int, {_CODE}"), "snippet-classes")
    snippet = F.expr(f"substring(text, int(shiftright(place, {_START})) + 1, int(place & {_MASK}) + {length})")
    asked = found.filter("h is not null").join(texts, ["doc", "tie"]).select(
        "h", "chunk", "doc", "tie", "place", snippet.alias("snippet"))
    ordered = materialise(
        asked.repartition("h", "chunk").sortWithinPartitions("h", "chunk", "doc", "tie", "place")
        .mapInArrow(partial(_sort_snippets, length=length, chunk=chunk), f"digest binary, {_CODE}"), "snippet-ranges")
    across = ordered.filter("digest is not null")
    heads = materialise(across.groupBy("digest").agg(F.min(F.struct("doc", "tie", "place")).alias("head")), "chunk-heads")
    later = across.join(heads, "digest").filter(F.struct("doc", "tie", "place") != F.col("head"))
    parts = (found.filter("h is null"), ordered.filter("digest is null"), later)
    return reduce(DataFrame.union, (p.select("doc", "tie", "place") for p in parts))


def cut_out(text: bytes, places: list[int] | None, length: int) -> tuple[bytes, int]:
    """(remaining bytes, number of maximal removed runs)."""
    if not places:
        return text, 0
    place = np.sort(np.array(places, dtype=np.int64))
    begin = place >> _START
    end = np.maximum.accumulate(begin + (place & _MASK) + length)
    run = np.ones(len(begin), dtype=bool)
    run[1:] = begin[1:] > end[:-1]                              # touching ranges are one run
    first = np.flatnonzero(run)
    begin, end = begin[first], end[np.append(first[1:], len(end)) - 1]
    edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)), len(begin)


@frees
def _cut(batches, length: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in slices(b, "text", SLICE)):
        texts = batch.column("text").to_pylist()
        done = [cut_out(t, p, length) for t, p in zip(texts, batch.column("places").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([k for k, _ in done], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([len(t) - len(k) for t, (k, _) in zip(texts, done, strict=True)], pa.int64()),
             pa.array([n for _, n in done], pa.int64())],
            ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


@frees
def _cut_rows(batches, length: int, columns: list[str], places_name: str) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in slices(b, "text", SLICE)):
        at, texts, sizes = columns.index("text"), [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column(places_name).to_pylist(), strict=True):
            if places:       # a cut may fall inside a character, whose rest goes too
                text = cut_out(text.encode(), places, length)[0].decode("utf-8", "ignore")
            texts.append(text)
            sizes.append(None if text is None else len(text))
        out = [batch.column(c) for c in columns]
        out[at] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            out[columns.index("n_chars")] = pa.array(sizes, batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays(out, columns)


def _places(texts: DataFrame, length: int, gram: int, chunk: int) -> DataFrame:
    return repeated_ranges(texts, length, gram, chunk).groupBy("doc", "tie").agg(F.collect_list("place").alias("places"))


def cut_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """``docs`` (all rows and columns) with the repeated bytes cut out of text,
    and n_chars, if there, set to the new length."""
    key, repeat = order_key(docs)
    _, texts = keyed(docs, key, repeat)
    doc, tie, places = unused(docs, "_sd_doc", "_sd_tie", "_sd_places")
    found = _places(texts, length, gram, chunk).select(
        F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("places").alias(places))
    rows = docs.withColumns({doc: key["doc"], tie: key["tie"]})
    rows = rows.join(found, [doc, tie], "left").drop(doc, tie)
    return rows.mapInArrow(partial(_cut_rows, length=length, columns=docs.columns, places_name=places), docs.schema)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) of every row; ``kept`` is
    the remaining bytes."""
    own, texts = keyed(docs, *order_key(docs))
    return own.join(_places(texts, length, gram, chunk), ["doc", "tie"], "left").select("doc_id", "text", "places") \
        .mapInArrow(partial(_cut, length=length), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
