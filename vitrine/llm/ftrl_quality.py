"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features of a text, averaged over its tokens: hashed words, word pairs, and
pairs of word shapes (case, digits, punctuation; a word equal to the one
before it has a shape of its own). They add up over tokens, so a score is one
gather and one sum over the whole text.

Training uses a bounded sample: at most ``sample`` labelled documents chosen
by a hash of the id, cut into ``shards``; each shard runs per-coordinate
FTRL-proximal over its documents on its own, and the weights (2^18 per shard) are
averaged.

Defined cases: null or empty text has no features and gets the score of the
bias alone; several labels of a document are averaged (one half counts as 1);
labels without a document or a quality go; without any label the score is 0.5
everywhere; repeated rows get equal scores; an empty table gives an empty
result. Only doc_id and text, and doc_id and quality of the labels, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import id_crc, slices, words
from vitrine.llm.linear import mix, shape_hashes, word_hashes

BITS = 18
SCALE = 10.0
SAMPLE = 20_000
SHARDS = 4
_A, _B, _SAME = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0x5851F42D4C957F2D)


def token_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document row of each token, features (3 x tokens), tokens per row)."""
    doc, code, dictionary = words(texts)
    n = len(texts)
    word, shape = word_hashes(dictionary), shape_hashes(dictionary)
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    w, s = word[code], np.where(again, _SAME, shape[code])
    first = np.ones(len(code), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    before = lambda h: np.where(first, np.uint64(1), np.concatenate([h[:1], h[:-1]]))
    pair = np.where(again, _SAME, mix(before(w) * _A + w))
    shapes = mix(before(s) * _B + s)
    cut = np.uint64(64 - BITS)
    feature = np.stack([(h >> cut).astype(np.int64) for h in (mix(w), pair, shapes)])
    return doc, feature, np.bincount(doc, minlength=n)


class Ftrl:
    """Per-coordinate FTRL-proximal for the logistic loss."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def _fit_shard(rows: list, epochs: int) -> pa.RecordBatch:
    model = Ftrl()
    for _ in range(epochs):
        for at, x, y in rows:
            model.update(at, x, y)
    return pa.RecordBatch.from_arrays(
        [pa.array([model.weights().astype("<f4").tobytes()]), pa.array([len(rows)])], ["weights", "rows"])


def _fit(batches, epochs: int) -> Iterator[pa.RecordBatch]:
    """One model per shard; several shards may fall into one task."""
    rows, now = [], None
    for batch in batches:
        for shard, text, y in zip(*(batch.column(c).to_pylist() for c in ("shard", "text", "y")), strict=True):
            if rows and shard != now:
                yield _fit_shard(rows, epochs)
                rows = []
            now = shard
            _, feature, tokens = token_features(pa.array([text], pa.string()))
            names, count = np.unique(feature, return_counts=True)
            rows.append((np.append(names, 1 << BITS), np.append(SCALE * count / max(int(tokens[0]), 1), 1.0), y))
    if rows:
        yield _fit_shard(rows, epochs)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, epochs: int = 3) -> np.ndarray:
    """Averaged weights (the last one is the bias) from (doc_id, text) and
    (doc_id, quality)."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    mark = F.xxhash64("doc_id", F.lit("sample"))
    chosen = one.select("doc_id", (F.col("q") >= 0.5).cast("double").alias("y"), mark.alias("mark")) \
        .orderBy("mark", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")     # at most ``sample`` small rows
    shard = rows.select("text", "y", "mark", "doc_id", F.pmod("mark", F.lit(shards)).alias("shard")) \
        .repartition(shards, "shard").sortWithinPartitions("shard", "mark", "doc_id")
    parts = shard.select("shard", "text", "y").mapInArrow(partial(_fit, epochs=epochs), "weights binary, rows long").collect()
    total = np.zeros((1 << BITS) + 1)
    for r in parts:                                                              # one row of 1 MB per shard
        total += r["rows"] * np.frombuffer(r["weights"], dtype="<f4")
    return total / max(sum(r["rows"] for r in parts), 1)


def _score(batches, weights) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for batch in batches:
        for part in slices(batch, "text", 8 << 20):
            doc, feature, tokens = token_features(part.column("text"))
            dot = np.bincount(doc, w[feature].sum(axis=0), part.num_rows)
            z = SCALE * dot / np.maximum(tokens, 1) + w[-1]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(partial(_score, weights=shared), "doc_id long, score double")


def op4_ftrl_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = id_crc(F.col("doc_id")) % 5 == 0
    weights = train(docs.select("doc_id", "text"), labels.filter(~held))
    return score(docs, weights).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
