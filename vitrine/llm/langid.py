"""Language identification by hierarchical discrimination.

First the language family is predicted (one linear support vector machine per
family, one versus rest), then, inside the winning family, one-versus-one
linear support vector machines separate its languages; the language with most
won duels is the answer. The score is the share of the family times that of the
answer's weakest duel, so it does not shrink with the number of sister
languages. Features are hashed byte 2- and 3-grams inside lower-cased
words (word edges included), averaged over the whole text. They add up over
words, so each distinct word of a batch is scored once.

Training uses a bounded sample: about ``per_language`` labelled documents of
each language, chosen by a hash of the id. Each machine is trained in its own
task on the sampled documents of its classes only (AdaGrad on the hinge loss).
The model is (families + pairs) x 196,608 weights and is broadcast.

Defined cases: null text or text without a letter is ``und`` with score 0;
languages without an entry in ``FAMILY`` are a family of their own; with one
learned language or family the machines that would separate more are absent;
with none every row is ``und``; repeated rows get equal answers; an empty table
gives an empty result. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import frees, id_crc, slices, words
from vitrine.llm.linear import buffers, mix

#: Language families by ISO 639-1 code.
FAMILY = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi", "fo"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la", "co", "sc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk", "tt"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "gu", "mr", "ne", "si", "sa"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "austronesian": ("id", "ms", "tl", "jv", "mg"),
    "sinitic": ("zh",),
}
TRIGRAMS = 1 << 17
DIM = (1 << 16) + TRIGRAMS
SCALE = 30.0
PER_LANGUAGE = 600
LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILY.items() if lang in langs), f"only:{lang}")


def word_grams(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) of every 2- and 3-gram of the distinct words."""
    data, offset = buffers(dictionary)
    n = len(offset) - 1
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.full(len(data) + n + 1, 32, dtype=np.uint32)          # one blank around each word
    text[np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offset))] = data
    blank = text == 32
    owner = np.cumsum(blank) - 1
    two = (text[:-1] << np.uint32(8)) | text[1:]
    three = (two[:-1] << np.uint32(8)) | text[2:]
    inner = ~blank[1:-1]                                             # a 3-gram over a blank joins two words
    hashed = (mix(three[inner].astype(np.uint64) + np.uint64(1)) >> np.uint64(20)).astype(np.int64) % TRIGRAMS
    return (np.concatenate([owner[:-1], owner[:-2][inner]]),
            np.concatenate([two.astype(np.int64), hashed + (1 << 16)]))


def _documents(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, code, dictionary = words(pc.utf8_lower(texts))
    owner, feature = word_grams(dictionary)
    return doc, code, owner, feature


def _example(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and averaged counts of one text."""
    _, code, owner, feature = _documents(pa.array([text]))
    times = np.bincount(code, minlength=1)
    if len(owner) == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    names, at = np.unique(feature, return_inverse=True)
    count = np.bincount(at, times[owner])
    return names, SCALE * count / count.sum()


def _train(pdf: pd.DataFrame, epochs: int) -> pd.DataFrame:
    """One machine: AdaGrad on the hinge loss, classes weighted evenly."""
    pdf = pdf.sort_values("mark", kind="stable")
    rows = [(*_example(t), y) for t, y in zip(pdf["text"], pdf["y"], strict=True)]
    rows = [r for r in rows if len(r[0])]
    w, g, bias, gb = np.zeros(DIM), np.full(DIM, 1e-6), 0.0, 1e-6
    up = sum(1 for r in rows if r[2] > 0)
    weight = {1: len(rows) / (2 * max(up, 1)), -1: len(rows) / (2 * max(len(rows) - up, 1))}
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f, x, y = rows[k]
            if y * (w[f] @ x + bias) < 1:
                step = weight[y] * y
                g[f] += (step * x) ** 2
                w[f] += 0.2 * step * x / np.sqrt(g[f])
                gb += step * step
                bias += 0.05 * step / np.sqrt(gb)
    return pd.DataFrame({"machine": [pdf["machine"].iloc[0]], "weights": [w.astype("<f4").tobytes()], "bias": [float(bias)]})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 4) -> dict:
    """Model from the labelled rows (text, lang, key): key orders the sample."""
    known = docs.filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}     # one row per language
    langs = sorted(counts)
    families = sorted({family_of(x) for x in langs})
    jobs = [(f"family:{f}", x, 1 if family_of(x) == f else -1) for f in families for x in langs] if len(families) > 1 else []
    pairs = [(a, b) for a, b in combinations(langs, 2) if family_of(a) == family_of(b)]
    jobs += [(f"pair:{a}:{b}", x, 1 if x == a else -1) for a, b in pairs for x in (a, b)]
    model = {"langs": langs, "families": families, "pairs": pairs, "weights": {}, "bias": {}}
    if not jobs:
        return model
    spark = docs.sparkSession
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per_language / counts[x]))])
    mark = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.withColumn("mark", mark).filter(F.col("mark") < share[F.col("lang")])
    plan = spark.createDataFrame(jobs, "machine string, lang string, y int")
    dealt = sample.select("text", "lang", "mark").join(F.broadcast(plan), "lang")    # a row per machine and language
    out = dealt.groupBy("machine").applyInPandas(
        lambda pdf: _train(pdf, epochs), "machine string, weights binary, bias double").collect()
    for r in out:
        model["weights"][r["machine"]] = np.frombuffer(r["weights"], dtype="<f4")
        model["bias"][r["machine"]] = r["bias"]
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def decide(model: dict, margin: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(language index, score) from the machines' margins."""
    langs, families = model["langs"], model["families"]
    if len(families) > 1:
        m = np.stack([margin[f"family:{f}"] for f in families], axis=1)
        best = m.argmax(axis=1)
        e = np.exp(2 * (m - m.max(axis=1, keepdims=True)))
        sure = e.max(axis=1) / e.sum(axis=1)
    else:
        best, sure = np.zeros(n, dtype=np.int64), np.ones(n)
    answer, score = np.zeros(n, dtype=np.int64), np.zeros(n)
    for k, f in enumerate(families):
        own = [i for i, x in enumerate(langs) if family_of(x) == f]
        duel = {p: margin[f"pair:{p[0]}:{p[1]}"] for p in model["pairs"] if family_of(p[0]) == f}
        won = np.zeros((n, len(own)))
        prob = np.ones((n, len(own)))
        for (a, b), v in duel.items():
            i, j = own.index(langs.index(a)), own.index(langs.index(b))
            won[:, i] += (v > 0) + 1e-3 * np.tanh(v)
            won[:, j] += (v <= 0) - 1e-3 * np.tanh(v)
            prob[:, i] = np.minimum(prob[:, i], _sigmoid(2 * v))
            prob[:, j] = np.minimum(prob[:, j], _sigmoid(-2 * v))
        top = won.argmax(axis=1)
        here = best == k
        answer[here] = np.array(own)[top[here]]
        score[here] = (sure * prob[np.arange(n), top])[here]
    return answer, score


def _predict(batches, model) -> Iterator[pa.RecordBatch]:
    value = model.value
    machines = sorted(value["weights"])
    table = np.stack([value["weights"][m] for m in machines], axis=1) if machines else None
    for batch in batches:
        for part in slices(batch, "text", 8 << 20):
            texts, n = part.column("text"), part.num_rows
            letter = np.array([bool(t) and LETTER.search(t) is not None for t in texts.to_pylist()], dtype=bool)
            margin = {}
            if machines:
                doc, code, owner, feature = _documents(texts)
                size = int(owner.max()) + 1 if len(owner) else 0
                count = np.bincount(owner, minlength=size)
                total = np.maximum(np.bincount(doc, count[code], n), 1)
                # features are sorted by word twice (2-grams, then 3-grams): add in bounded pieces
                score = np.zeros((size, len(machines)))
                for at in range(0, len(owner), 1 << 20):
                    o, w = owner[at:at + (1 << 20)], table[feature[at:at + (1 << 20)]]
                    for k in range(len(machines)):
                        score[:, k] += np.bincount(o, w[:, k], size)
                for k, m in enumerate(machines):
                    margin[m] = SCALE * np.bincount(doc, score[code, k], n) / total + value["bias"][m]
            if value["langs"]:
                answer, sure = decide(value, margin, n)
                lang = np.where(letter, np.array(value["langs"], dtype=object)[answer], "und")
                sure = np.where(letter, sure, 0.0)
            else:
                lang, sure = np.full(n, "und", dtype=object), np.zeros(n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held"), pa.array(lang, pa.string()), pa.array(sure)],
                ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; ``docs`` has doc_id,
    text and a boolean ``held``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", "held").mapInArrow(
        partial(_predict, model=shared), "doc_id long, held_out boolean, lang_pred string, score double")


@frees
def _accept(batches, model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 8 << 20):
            doc = pa.RecordBatch.from_arrays(
                [pa.nulls(part.num_rows, pa.int64()), part.column("text"), pa.nulls(part.num_rows, pa.bool_())],
                ["doc_id", "text", "held"])
            keep = [pc.and_(pc.not_equal(out.column("lang_pred"), "und"),
                                    pc.greater_equal(out.column("score"), least)) for out in _predict([doc], model)]
            yield part.filter(pa.concat_arrays(keep))


def accepted(docs: DataFrame, model: dict, least: float) -> DataFrame:
    """The rows of ``docs`` (all columns) with a language and a score of at
    least ``least``; a filter without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_accept, model=shared, least=least), docs.schema)


def fold_model(docs: DataFrame, folds: int = 5, per_language: int = PER_LANGUAGE) -> dict:
    """Model learned from the rows whose crc32(doc_id) mod ``folds`` is not 0."""
    learn = docs.filter(id_crc(F.col("doc_id")) % folds != 0)
    return train(learn.select(F.col("text").cast("string").alias("text"), "lang", F.col("doc_id").alias("key")), per_language)


def language_id(docs: DataFrame, folds: int = 5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from the rows of the other folds, answer for all."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      (id_crc(F.col("doc_id")) % folds == 0).alias("held"))
    return identify(own, fold_model(docs, folds, per_language))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"), folds=5)
