"""Audit of how quality filters interact, with wide packed counters.

Five filters are applied in every one of the 120 orders; what happens to a
document depends only on the set of filters it fails (its mask) and on its
labels. So every mask is mapped to one big integer whose 64-bit fields hold the
outcomes at all 600 (order, step) places at once: kept, removed, redundant,
unique, good lost, toxic lost. Tasks add up these integers per part, the sums
travel through the shuffle as bytes, and the total is unpacked into 600 rows. A
field counts rows; Spark counts rows in signed 64-bit longs, so no field can
carry into its neighbour (``shapley``, 120 orders added up, fits a long up to 2^56 rows).

The filters see whole texts. Exact copies (filter E) are found by SHA-256: rows
collapse to one per digest, part and labels before the smallest id of a digest is
looked up, so a text that fills a third of the table is a few rows. A part's
partial sums (29 kB a task) are added in two steps, first in salted groups.

Defined cases: null text is empty, null lang the part ``''``; a null doc_id has
no label, is no smaller id and has none; rows of one id do not make each other
copies; several label rows of an id count as their maximum; an empty table gives
an empty result. Only doc_id, text, lang and doc_id, quality, toxic are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import UPPER

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50       # percent of the words
MOST_CAPITALS = 3         # percent of the code points
MARKS = "[#$%&*|]"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD = 8                 # bytes of a field
SALTS = 32
HELD_PARTS = 256


# ------------------------------------------------------------- wide counters

@lru_cache(maxsize=4)
def places(filters: str) -> list[tuple[str, int]]:
    """(order, step) of every field group, steps from 1."""
    return [("".join(o), k + 1) for o in permutations(filters) for k in range(len(filters))]


def outcome(filters: str, mask: int, good: bool, toxic: bool) -> np.ndarray:
    """0 or 1 per place and outcome of one document; bit k of the mask: it
    fails filter k."""
    out = np.zeros((len(places(filters)), len(OUTCOMES)), dtype="<u8")
    for row, (order, step) in zip(out, places(filters), strict=True):
        fails = [mask >> filters.index(f) & 1 for f in order[:step]]
        before, here = any(fails[:-1]), fails[-1] == 1
        removed = here and not before
        only = mask == 1 << filters.index(order[step - 1])
        row[:] = not any(fails), removed, here and before, only, removed and good, removed and toxic
    return out


@lru_cache(maxsize=4)
def counters(filters: str) -> list[int]:
    """The big integer of each class, 4 * mask + 2 * good + toxic."""
    return [int.from_bytes(outcome(filters, c >> 2, bool(c & 2), bool(c & 1)).tobytes(), "little")
            for c in range(4 << len(filters))]


def _sums(filters: str, sums: dict[str, int]) -> pa.RecordBatch:
    size = len(places(filters)) * len(OUTCOMES) * FIELD
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([s.to_bytes(size, "little") for s in sums.values()], pa.binary())], ["part", "wide"])


def _sum_masks(batches: Iterable[pa.RecordBatch], filters: str) -> Iterator[pa.RecordBatch]:
    """Sum of the integers of this task's rows, per part."""
    wide, sums = counters(filters), {}
    for batch in batches:
        part = batch.column("part").dictionary_encode()
        names = part.dictionary.to_pylist()
        key = part.indices.to_numpy().astype(np.int64) * len(wide) + batch.column("class").to_numpy()
        key, index = np.unique(key, return_inverse=True)
        n = np.zeros(len(key), dtype=np.int64)
        np.add.at(n, index, batch.column("n").to_numpy())
        for k, count in zip(key.tolist(), n.tolist(), strict=True):
            name = names[k // len(wide)]
            sums[name] = sums.get(name, 0) + count * wide[k % len(wide)]
            if len(sums) > HELD_PARTS:
                yield _sums(filters, sums)
                sums = {}
    yield _sums(filters, sums)


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    """Total per part of rows sorted by part; holds one sum."""
    name, total = None, 0
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("wide").to_pylist(), strict=True):
            if part != name and name is not None:
                yield name, total
            if part != name:
                name, total = part, 0
            total += int.from_bytes(blob, "little")
    if name is not None:
        yield name, total


def _add_up(batches: Iterable[pa.RecordBatch], filters: str) -> Iterator[pa.RecordBatch]:
    for name, total in _add(batches):
        yield _sums(filters, {name: total})


def _unpack(batches: Iterable[pa.RecordBatch], filters: str) -> Iterator[pa.RecordBatch]:
    """One row per place of each part."""
    at = places(filters)
    order, step = pa.array([o for o, _ in at]), pa.array([s for _, s in at], pa.int32())
    own = np.array([filters.index(o[s - 1]) for o, s in at])
    for name, total in _add(batches):
        fields = np.frombuffer(total.to_bytes(len(at) * len(OUTCOMES) * FIELD, "little"), dtype="<u8").reshape(len(at), -1).astype(np.int64)
        share = np.zeros(len(filters), dtype=np.int64)
        np.add.at(share, own, fields[:, OUTCOMES.index("removed")])
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), order, step, *(pa.array(f) for f in fields.T), pa.array(share[own])],
            ["part", "filter_order", "step", *OUTCOMES, "shapley"])


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Outcomes per part, order and step of ``rows`` (part, mask, good, toxic,
    n: so many documents; bit k of the mask: they fail ``filters[k]``).

    ``shapley``: documents the step's filter removes, summed over all orders."""
    group = F.col("mask") * 4 + F.col("good").cast("int") * 2 + F.col("toxic").cast("int")
    wide = rows.select("part", group.cast("long").alias("class"), F.col("n").cast("long").alias("n")) \
        .mapInArrow(partial(_sum_masks, filters=filters), "part string, wide binary") \
        .withColumn("salt", F.spark_partition_id() % SALTS)
    some = wide.repartition("part", "salt").sortWithinPartitions("part") \
        .select("part", "wide").mapInArrow(partial(_add_up, filters=filters), "part string, wide binary")
    counts = ", ".join(f"{c} long" for c in (*OUTCOMES, "shapley"))
    return some.repartition("part").sortWithinPartitions("part") \
        .mapInArrow(partial(_unpack, filters=filters), f"part string, filter_order string, step int, {counts}")


# ------------------------------------------------------------------- filters

def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which see one text and its words only."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [n < LEAST_WORDS,
             100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"),
             100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
             text.rlike(MARKS)]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n) of the five filters over all documents."""
    src = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                      F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    src = src.withColumn("words", F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != ""))
    src = src.select("doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    label = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    known = src.filter("doc_id IS NOT NULL").join(label, "doc_id", "left") \
        .withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    same = ["digest", "part", "mask", "good", "toxic"]
    ids = known.groupBy("doc_id", *same).agg(F.count(F.lit(1)).alias("n"))
    group = ids.groupBy(*same).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    first = F.min("low").over(Window.partitionBy("digest"))
    group = group.withColumn("alone", F.when(F.col("low") == first, F.col("n_low")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    split = group.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), F.col("alone").cast("long").alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("alone")).cast("long").alias("n")))))
    nameless = src.filter("doc_id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")) \
        .withColumns({"good": no, "toxic": no})
    columns = ["part", "mask", "good", "toxic", "n"]
    return split.filter("n > 0").select(columns).unionByName(nameless.select(columns))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(masks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = r"""
WITH letters(f, bit) AS (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, s::INT AS step, (SELECT bit FROM letters WHERE f = filter_order[s]) AS own,
    (SELECT coalesce(sum(1 << bit), 0)::INT FROM letters WHERE strpos(filter_order, f) < s) AS before
  FROM orders, range(1, 6) r(s)),
words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id, part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM words),
label AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
  FROM labels GROUP BY doc_id),
classes AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM marks LEFT JOIN label USING (doc_id) GROUP BY ALL),
counts AS (
  SELECT part, filter_order, step, own,
    sum(n * ((mask & (before | (1 << own))) = 0)::INT) AS kept,
    sum(n * ((mask & before) = 0 AND (mask >> own) & 1 = 1)::INT) AS removed,
    sum(n * ((mask & before) > 0 AND (mask >> own) & 1 = 1)::INT) AS redundant,
    sum(n * (mask = (1 << own))::INT) AS unique_fails,
    sum(n * good * ((mask & before) = 0 AND (mask >> own) & 1 = 1)::INT) AS good_lost,
    sum(n * toxic * ((mask & before) = 0 AND (mask >> own) & 1 = 1)::INT) AS toxic_lost
  FROM classes, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counts
"""
