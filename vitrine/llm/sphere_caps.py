"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: the dimensions are
cut into m blocks, each block has B random unit codewords, and a direction is
one codeword per block scaled to unit length (B^m directions). A vector is
list-decoded to all directions whose inner product with it exceeds a
threshold: block by block, dropping partial sums that the best remaining
codewords cannot lift over it. Vectors meeting in a filter are verified by
their exact cosine.

The threshold follows from the number n of distinct vectors: a cap holds
about 32 random ones at any size, and the number of directions makes a pair
at the cosine limit share ``expected_common`` filters on average (a pair is
then missed with probability about exp(-expected_common); closer pairs share
more). A vector that exceeds the threshold in fewer directions than that
calls for (its weight lies in few dimensions) gets a lower one. Equal vectors are one class first. A crowded filter is split into
tiles of bounded size; a tile returns the number of links of each class and
a spanning forest, never all pairs. A pair counts only in the smallest filter
that both vectors lie in; a tile decodes the vectors that have a partner in it
once more to know it, so no filter list is sent along.

Defined cases: null, empty or zero vectors and those with null or non-finite
components link with nothing (n_links 0, component is their own id); vectors
of different lengths never link; repeated rows and equal ids are vectors of
their own; a null id takes the smallest id of its component, null if there is none;
an empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import connected_components, groups, materialise, spanning, tiles

CAP_ROWS = 32
TILE = 1024
GRID = 22


def design(n: int, cosine: float, expected_common: float) -> tuple[int, int, float, int]:
    """(blocks, codewords per block, threshold in units of 1/sqrt(dim), least
    directions of a vector)."""
    normal = NormalDist()
    share = min(0.05, CAP_ROWS / max(n, 1))              # of random vectors in a cap
    a = normal.inv_cdf(1 - share)
    spread = math.sqrt(1 - cosine * cosine)
    x = np.linspace(a, a + 6, 2001)
    density = np.exp(-x * x / 2)
    both = np.array([1 - normal.cdf((a - cosine * v) / spread) for v in x])
    common = float((density * both).sum() / density.sum())   # P(y in cap | x in cap)
    filters = expected_common / (common * share)
    blocks = max(2, math.ceil(math.log(filters) / math.log(256)))
    return blocks, math.ceil(filters ** (1 / blocks)), a, math.ceil(expected_common / common)


def codebook(dim: int, blocks: int, codes: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng([seed, dim, blocks, codes])
    out = []
    for cols in np.array_split(np.arange(dim), min(blocks, dim)):
        c = rng.standard_normal((codes, len(cols)))
        out.append(on_grid(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(min(blocks, dim))))
    return out


def on_grid(x: np.ndarray) -> np.ndarray:
    """Rounded to multiples of 2^-GRID: products of two such numbers and their
    sums are exact in double precision, whatever the order of addition."""
    return np.round(x * (1 << GRID)) / (1 << GRID)


def list_decode(x: np.ndarray, book: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every direction whose inner product reaches ``threshold``."""
    scores, at = [], 0
    for c in book:
        scores.append(x[:, at:at + c.shape[1]] @ c.T)
        at += c.shape[1]
    rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
    row, key, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for b, s in enumerate(scores):
        least = threshold - (rest[b + 1][row] if b + 1 < len(scores) else 0.0) - total
        i, j = np.nonzero(s[row] >= least[:, None])
        row, key, total = row[i], key[i] * s.shape[1] + j, total[i] + s[row[i], j]
    return row, key


def directions(x: np.ndarray, book: list[np.ndarray], threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``list_decode``, with the threshold lowered step by step for the
    vectors that exceed it in fewer than ``least`` directions. A vector gets the
    same filters wherever it is decoded (both sides lie on the grid)."""
    x = on_grid(x)
    least = min(least, math.prod(len(c) for c in book))
    rows, keys, left = [], [], np.arange(len(x))
    while len(left):
        row, key = list_decode(x[left], book, threshold)
        full = np.bincount(row, minlength=len(left)) >= least
        rows.append(left[row[full[row]]])
        keys.append(key[full[row]])
        left, threshold = left[~full], threshold - 0.1 * abs(threshold) - 1e-3
    return np.concatenate(rows), np.concatenate(keys)


def _unit(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column("vec_id"), []
        for v in batch.column("embedding").to_pylist():
            unit = None
            if v and None not in v:
                x = np.asarray(v, dtype=np.float64)
                big = np.abs(x).max()
                if np.isfinite(big) and big > 0:
                    x = x / big                      # no overflow or underflow in the norm
                    unit = (x / np.linalg.norm(x) + 0.0).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["vec_id", "unit"])


def _filters(batches, blocks: int, codes: int, a: float, least: int, seed: int) -> Iterator[pa.RecordBatch]:
    books: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        cid = batch.column("cid").to_numpy(zero_copy_only=False)
        units = batch.column("unit").to_pylist()
        size = np.array([len(u) // 8 for u in units], dtype=np.int64)
        for dim in np.unique(size).tolist():
            if dim not in books:
                books[dim] = codebook(dim, blocks, codes, seed)
            own = np.flatnonzero(size == dim)
            for at in range(0, len(own), 512):
                sel = own[at:at + 512]
                x = np.frombuffer(b"".join(units[i] for i in sel), dtype=np.float64).reshape(-1, dim)
                row, key = directions(x, books[dim], a / math.sqrt(dim), least)
                # filters of different lengths are different
                yield pa.RecordBatch.from_arrays([pa.array(cid[sel][row]), pa.array(key + (dim << 40))], ["cid", "filter"])


def _met_before(x: np.ndarray, f: int, book: list[np.ndarray], a: float, least: int) -> np.ndarray:
    """0/1 matrix: rows of ``x`` by the filters below ``f`` that hold them."""
    dim, rows, keys = x.shape[1], [], []
    for at in range(0, len(x), 512):
        row, key = directions(x[at:at + 512], book, a / math.sqrt(dim), least)
        below = key + (dim << 40) < f
        rows.append(row[below] + at)
        keys.append(key[below])
    names, code = np.unique(np.concatenate(keys), return_inverse=True)
    met = np.zeros((len(x), len(names)), dtype=np.float32)
    met[np.concatenate(rows), code] = 1
    return met


def _verify(batches, cosine: float, blocks: int, codes: int, a: float, least: int, seed: int) -> Iterator[pa.RecordBatch]:
    books: dict[int, list[np.ndarray]] = {}
    for g in groups(batches, ["filter", "tile_i", "tile_j"]):
        f, n = int(g["filter"][0]), len(g["cid"])
        x = np.frombuffer(b"".join(g["unit"]), dtype=np.float64).reshape(n, -1)
        one = two = np.arange(n)
        cross = g["tile_i"][0] != g["tile_j"][0]
        if cross:
            one, two = np.flatnonzero(g["chunk"] == g["tile_i"][0]), np.flatnonzero(g["chunk"] == g["tile_j"][0])
        ok = np.zeros((len(one), len(two)), dtype=bool)      # a tile is of bounded size
        for at in range(0, len(one), 256):
            ok[at:at + 256] = x[one[at:at + 256]] @ x[two].T >= cosine
        if not cross:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok.any(axis=1))[0], np.nonzero(ok.any(axis=0))[0]
        if not len(i):
            continue
        # a pair counts in its smallest filter: those of the vectors with a partner here are decoded again
        dim = x.shape[1]
        if dim not in books:
            books[dim] = codebook(dim, blocks, codes, seed)
        near = np.union1d(one[i], two[j])
        met = _met_before(x[near], f, books[dim], a, least)
        left, right = np.searchsorted(near, one[i]), np.searchsorted(near, two[j])
        links, pairs_a, pairs_b = np.zeros(n, dtype=np.int64), [], []
        for at in range(0, len(i), 256):
            new = ok[np.ix_(i[at:at + 256], j)] & (met[left[at:at + 256]] @ met[right].T < 0.5)
            p, q = np.nonzero(new)
            p, q = one[i[at + p]], two[j[q]]
            links += np.bincount(p, g["n"][q], n).astype(np.int64) + np.bincount(q, g["n"][p], n).astype(np.int64)
            pairs_a.append(p)
            pairs_b.append(q)
        root = spanning(n, np.concatenate(pairs_a), np.concatenate(pairs_b))
        own = np.flatnonzero(links)
        if len(own):
            yield pa.RecordBatch.from_arrays(
                [pa.array(g["cid"][own]), pa.array(g["cid"][root[own]]), pa.array(links[own])], ["a", "b", "links"])


def vector_links(vectors: DataFrame, cosine: float = 0.9, expected_common: float = 6.0, seed: int = 17,
                 tile: int = TILE) -> DataFrame:
    """Per row (vec_id, n_links, component_id)."""
    own = materialise(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .mapInArrow(_unit, "vec_id long, unit binary"), "units")
    classes = materialise(
        own.filter("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    blocks, codes, a, least = design(classes.count(), cosine, expected_common)
    code = {"blocks": blocks, "codes": codes, "a": a, "least": least, "seed": seed}
    members = materialise(classes.select("cid", "unit").mapInArrow(partial(_filters, **code), "cid long, filter long"), "filters")
    rows = tiles(members, "filter", "cid", tile).join(classes.select("cid", "unit", "n"), "cid")
    dealt = rows.select("filter", "tile_i", "tile_j", "chunk", "cid", "n", "unit") \
        .repartition("filter", "tile_i", "tile_j").sortWithinPartitions("filter", "tile_i", "tile_j")
    found = materialise(dealt.mapInArrow(partial(_verify, cosine=cosine, **code), "a long, b long, links long"), "found")
    comp = connected_components(found.select("a", "b"))
    number = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    named = materialise(
        classes.join(number, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
        .select("unit", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "cid").alias("component")), "named")
    low = materialise(named.groupBy("component").agg(F.min("first").alias("component_id")), "lowest")
    result = materialise(named.join(low, "component").select("unit", "n_links", "component_id"), "result")
    return own.join(result, "unit", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))


def op9_sphere_caps(spark, sf_dir: str) -> DataFrame:
    out = vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
