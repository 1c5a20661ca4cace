"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into m blocks of n = 31, 15 or 7 bits (m = 2, 4,
8; spare bits only count in the final check). Two fingerprints within t < 2m
bits differ by at most one bit in some block. The anchors of a block are the
codewords of the perfect Hamming code of length n: its covering radius is 1,
so every block value has a home anchor within one bit, and a value one bit
further lies within radius 1 + 1 of that anchor. Each fingerprint is
therefore replicated to all anchors within two bits (16 per block at n = 31)
and compared, per anchor, with the fingerprints at home there.

Equal fingerprints are one class first (combined map-side). A crowded anchor
is split into tiles of bounded size and a tile returns a spanning forest of
its links, never all pairs. Components are then found by star contraction.

Defined cases: null or empty text has no words and fingerprint zero, linked
like any other; fewer words than a shingle give one shingle of all words;
rows with equal doc_id or equal text each keep a row; a null doc_id takes
part in its class but is never its smallest id unless alone (then null); an
empty table gives an empty result. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import connected_components, frees, groups, materialise, shuffle_width, slices, spanning, tiles, unused

TILE = 1024
#: Block length and number of blocks by the largest distance they serve.
BLOCKS = ((3, 31, 2), (7, 15, 4), (15, 7, 8))


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Bit majority (strictly over half) of the shingles' XXH64."""
    w = text.lower().split()          # bytes: A-Z and the six ASCII blanks only
    if not w:
        return 0
    if len(w) < shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


@frees
def _fingerprints(batches, shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 8 << 20):
            fp = [fingerprint(t or b"", shingle, seed) for t in part.column("text").to_pylist()]
            fp = np.array(fp, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array(fp)], ["doc_id", "mark", "fp"])


def text_mark():
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp): a hash of the text, and the fingerprint's 64 bits as
    a signed long."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"),
                      F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(partial(_fingerprints, shingle=shingle, seed=seed), "doc_id long, mark long, fp long")


def anchors(fp: np.ndarray, n: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor key, at home) for every anchor within two bits."""
    position = np.arange(1, n + 1, dtype=np.uint64)
    bits = np.uint64(1) << (position - np.uint64(1))
    own, key, home = [], [], []
    for b in range(blocks):
        x = (fp >> np.uint64(b * n)) & np.uint64((1 << n) - 1)
        syndrome = np.zeros(len(x), dtype=np.uint64)
        for p, bit in zip(position, bits, strict=True):
            syndrome ^= np.where(x & bit, p, np.uint64(0))
        tag = np.uint64(b << n)
        fix = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))
        own.append(np.arange(len(x)))
        key.append(tag | (x ^ fix))
        home.append(np.ones(len(x), dtype=bool))
        for p, bit in zip(position, bits, strict=True):
            other = p ^ syndrome                       # flipping p and other lands on a codeword
            at = np.flatnonzero((syndrome > 0) & (other > p))
            own.append(at)
            key.append(tag | (x[at] ^ bit ^ (np.uint64(1) << (other[at] - np.uint64(1)))))
            home.append(np.zeros(len(at), dtype=bool))
    return np.concatenate(own), np.concatenate(key), np.concatenate(home)


@frees
def _replicate(batches, n: int, blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = batch.column("fp").to_numpy(zero_copy_only=False)
        own, key, home = anchors(signed.view(np.uint64), n, blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(signed[own]), pa.array(home)], ["anchor", "fp", "home"])


@frees
def _compare(batches, distance: int) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for g in groups(batches, ["anchor", "tile_i", "tile_j"]):
        fp, home = g["fp"].view(np.uint64), g["home"].astype(bool)
        one, two = np.ones(len(fp), dtype=bool), np.ones(len(fp), dtype=bool)
        if g["tile_i"][0] != g["tile_j"][0]:
            one, two = g["chunk"] == g["tile_i"][0], g["chunk"] == g["tile_j"][0]
        left, right = [], []
        for x, y in ((one & home, two), (two & home, one)) if one is not two else ((home, one),):
            x, y = np.flatnonzero(x), np.flatnonzero(y)
            for at in range(0, len(x), 256):
                i, j = np.nonzero(np.bitwise_count(fp[x[at:at + 256], None] ^ fp[None, y]) <= distance)
                left.append(x[at:at + 256][i])
                right.append(y[j])
        if left:
            root = spanning(len(fp), np.concatenate(left), np.concatenate(right))
            own = np.flatnonzero(root != np.arange(len(fp)))
            a.append(g["fp"][own])
            b.append(g["fp"][root[own]])
        if sum(map(len, a)) > 50_000:
            yield _links(a, b)
            a, b = [], []
    if a:
        yield _links(a, b)


def _links(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def links(fps: DataFrame, distance: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within
    ``distance`` bits: per tile a spanning forest, so the components are
    those of all links."""
    _, n, blocks = next(x for x in BLOCKS if distance <= x[0])
    rows = fps.select("fp").mapInArrow(partial(_replicate, n=n, blocks=blocks), "anchor long, fp long, home boolean")
    split = tiles(rows, "anchor", "fp", tile)
    dealt = split.repartition(shuffle_width(fps.sparkSession), "anchor", "tile_i", "tile_j").sortWithinPartitions("anchor", "tile_i", "tile_j")
    return dealt.mapInArrow(partial(_compare, distance=distance), "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42,
                       tile: int = TILE) -> DataFrame:
    """Per document (doc_id, mark, fp, component_id, kept): the smallest doc_id
    reachable over links of at most ``distance`` differing bits; ``kept`` marks
    the group's smallest (doc_id, mark), null ids last."""
    own = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    classes = materialise(
        own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(order).alias("head")), "classes")
    comp = connected_components(links(classes, distance, tile))
    joined = materialise(
        classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp")), "joined")
    low = materialise(
        joined.groupBy("component").agg(F.min("first").alias("component_id"), F.min("head").alias("head")), "lowest")
    named = materialise(joined.select("fp", "component").join(low, "component").drop("component"), "named")
    return own.join(named, "fp").select(
        "doc_id", "mark", "fp", "component_id",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one of each group."""
    kept = simhash_components(docs, shingle, distance, seed).filter("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("mark").alias("_kept_mark")).distinct()
    kept = materialise(kept, "kept")
    (own,) = unused(docs, "_own_mark")
    marked = docs.withColumn(own, text_mark())
    same = marked["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]) & (marked[own] == kept["_kept_mark"])
    rows = marked.join(kept, same, "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():     # fully equal rows: one stays
        rows = rows.dropDuplicates(["doc_id", own])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_cover(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_components(docs, shingle=3, distance=3, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
