"""Shared helpers of the training-data operators.

Intermediate tables go to the shared folder of the session
(``spark.checkpoint.dir``), so a lost executor never loses them and lineage
is cut there.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it
    (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``max_bytes`` of ``text``
    (a longer single row stands alone)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc alone


def frees(work: Callable) -> Callable:
    """A task function over batches that gives freed memory back to the system
    after each input batch and at its end: Spark keeps its Python workers, and
    what they hold back would count in every later stage."""
    def free() -> None:
        pa.default_memory_pool().release_unused()
        if _trim() is not None:
            _trim()(0)

    def fed(batches):
        for batch in batches:
            yield batch
            del batch
            free()

    @wraps(work)
    def run(batches, *args, **kwargs):
        try:
            yield from work(fed(batches), *args, **kwargs)
        finally:
            free()
    return run


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: no words).

    Returns (document row of each word, dictionary code of each word, the
    dictionary of distinct words). The case is left as it is."""
    # the Arrow splitter cuts at exactly these six bytes; a leading or
    # trailing cut leaves an empty piece, which is dropped here
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        flat, doc = flat.filter(full), doc[keep]
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of a stream of batches sorted by ``keys`` (long columns),
    as numpy columns; holds one batch and one group at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if table.num_rows == 0:
            continue
        cols = {n: _numpy(table.column(n)) for n in table.column_names}
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for k in keys:
            change |= np.diff(cols[k]) != 0
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield {n: c[a:b] for n, c in cols.items()}
        rest = table.slice(int(cuts[-1])).combine_chunks()
    if rest is not None and rest.num_rows:
        yield {n: _numpy(rest.column(n)) for n in rest.column_names}


def _numpy(col: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_list(col.type):
        return np.array(col.to_pylist() + [None], dtype=object)[:-1]
    return col.to_numpy()


def tiles(df: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Split the groups of ``key`` into bounded compare tasks.

    A group of n rows gets k = ceil(n / limit) chunks by hash of ``member``;
    every pair of chunks is one tile, so each pair of rows meets in exactly
    one tile and no task holds more than about 2 * limit rows of a group.
    Groups of one row have no pair and go. Adds ``tile_i`` <= ``tile_j`` and
    ``chunk`` (this row's)."""
    counts = materialise(df.groupBy(key).agg(F.count(F.lit(1)).alias("tile_n")).filter("tile_n > 1"), "tiles")
    k = F.ceil(F.col("tile_n") / F.lit(limit)).cast("int")
    out = df.join(counts, key).withColumn("tile_k", k)
    out = out.withColumn("chunk", F.pmod(F.xxhash64(member), F.col("tile_k")).cast("int"))
    out = out.withColumn("tile_o", F.explode(F.sequence(F.lit(0), F.col("tile_k") - 1)))
    return (out.withColumn("tile_i", F.least("chunk", "tile_o"))
            .withColumn("tile_j", F.greatest("chunk", "tile_o"))
            .drop("tile_n", "tile_k", "tile_o"))


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest index reachable) of each of n nodes under links a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable, by alternating large-star and small-star.

    ``edges``: two long columns (a, b). Returns (node, component) for the
    nodes on a link. Each half step is a minimum per node (combined
    map-side) and a join of written tables, so a hub's rows are split by the
    skew join; rounds grow with the logarithm of the component size."""
    e = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "large")
        e = materialise(both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                        .distinct(), "edges")
        low = materialise(e.groupBy("a").agg(F.min("b").alias("m")), "small")
        star = e.join(low, "a").select("a", "b", "m")
        e = materialise(star.select("a", F.col("m").alias("b"))
                        .union(star.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
                        .distinct(), "edges")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
