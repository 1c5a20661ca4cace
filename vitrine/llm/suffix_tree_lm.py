"""Language-model scoring with a probabilistic suffix tree over words.

Contexts are word sequences of up to ``depth`` words. Every context and every
continuation that occurs at least ``least`` times in the training rows is
counted, at any corpus size. A context is a state of the tree if its next-word
distribution diverges from that of the context without its oldest word
(Kullback-Leibler, in bits, of the counts) by at least ``min_bits``.
Distributions are smoothed by interpolation: a state takes ``discount`` off each
counted continuation and gives that mass, and that of all others, to the next
shorter state, down to the root, (c + 1) / (N + V + 1) for every word. A token is
scored in the state of the longest suffix of the words before it.

The tree grows level by level. A sequence is no commoner than its parts, so one
of d + 1 words is looked at only where both its parts of d words were counted.
And a context that is always followed by the same word has no descendant that
differs from it: a longer one is followed by that word as often as it occurs, so
nothing is sent. Both rules are exact; they drop most sequences after two words
and leave little after four, copied passages included. Nothing that grows with the corpus is collected or broadcast.

Documents are dealt by a hash into blocks of a few MB, tokenised once. In each
round a block sends its distinct candidate sequences as 64-bit hashes with their
counts to buckets (ranges of the hash), and the sums of the divergence test of
each context one level up. A bucket adds up and answers each block in the block's
own order, so answers are bare arrays. Blocks and buckets depend on the bytes of
the corpus alone, not on the shuffle width; messages are packed, so there are at
most (blocks x buckets) of them a round and never more than sequences. The blocks
are a bucketed table, which a round joins its mail to without a shuffle; answers
are deleted once they are used. Two sequences whose
hashes collide would be counted as one (about n^2 / 2^63 pairs among n).

Defined cases: null or empty text is the end token alone; the end token is a
symbol but never a context; without training rows N = V = 0 and every score
is 0; repeated rows count and score each; a null doc_id has the crc32 of the
empty text; a very long text is a block of its own; an empty table gives an
empty result. Only doc_id, text (and held) are read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import id_crc, shared_path, shuffle_width, words
from vitrine.llm.linear import mix, word_hashes
from vitrine.session import remove_path

BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20   # of text a bucket
BLOCKS_A_TASK = 4
LEAST = 2
MIN_BITS = 0.01
DEPTH = 5                 # words of the longest context: the order of the model
DISCOUNT = 0.5
_END = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x2545F4914F6CDD1D)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Document row and dictionary code of each token; the end token is the
    code after the last word."""
    n = len(texts)
    doc, code, dictionary = words(pc.ascii_lower(texts))
    rows = np.repeat(np.arange(n), np.bincount(doc, minlength=n) + 1)
    out = np.full(len(rows), len(dictionary), dtype=np.int64)
    out[np.arange(len(doc)) + doc] = code
    return rows, out, dictionary


# ------------------------------------------------------------------- packing

def _pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array of 8-byte numbers: all their first bytes,
    then all their second bytes and so on; of whole numbers (none negative) only
    the bytes in use."""
    used = 8
    if values.dtype == np.int64:
        used = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :used].T)
    return used.to_bytes(1, "little") + len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpack(blob: bytes, dtype=np.int64) -> np.ndarray:
    used, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[9:], used * n), dtype=np.uint8).reshape(used, n)
    if used == 8:
        return np.ascontiguousarray(planes.T).view(dtype).ravel()
    out = planes[0].astype(np.int64)
    for k in range(1, used):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def _cut(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The packed runs of an array (or of the columns of a matrix)."""
    return [_pack(np.ascontiguousarray(values[..., a:b]).reshape(-1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _cut_keys(keys: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Packed runs of sorted keys, as steps from one to the next."""
    return [_pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


#: Kinds of mail. To buckets: sequences with their counts, contexts with the
#: sums of their test. To blocks: the counts of each token (level 0: of each
#: word), which a block keeps for itself, and the answers of the buckets.
GRAMS, CONTEXTS, KEPT, COUNTED, JUDGED = range(5)
_MAIL = pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("blk", pa.int64()), ("bucket", pa.int64()),
                   ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
MAIL = "kind int, level int, blk long, bucket long, keys binary, a binary, b binary, tokens long, types long"


def _mail(kind: int, level: int, blk, bucket, a: list, keys: list | None = None, b: list | None = None,
          tokens_=None, types=None) -> pa.Table:
    n = len(a)
    column = lambda v: pa.array(v if v is not None else [None] * n, pa.binary())
    whole = lambda v: pa.array(np.broadcast_to(np.asarray(v, dtype=np.int64), n))
    return pa.table([pa.array(np.full(n, kind, dtype=np.int32)), pa.array(np.full(n, level, dtype=np.int32)), whole(blk), whole(bucket),
                     column(keys), column(a), column(b), whole(0 if tokens_ is None else tokens_), whole(0 if types is None else types)],
                    schema=_MAIL)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, the index of each)."""
    code, own = pd.factorize(h)
    order = np.argsort(own)
    rank = np.empty(len(own), dtype=np.int64)
    rank[order] = np.arange(len(own))
    return own[order], rank[code]


def _deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets with keys, where each starts and the end) of sorted keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    names, start = np.unique(bucket, return_index=True)
    return names, np.append(start, len(keys))


# -------------------------------------------------------------------- blocks

CODED = "blk long, doc_id array<long>, held array<boolean>, size binary, code binary, word binary"
_CODED = pa.schema([("blk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                    ("size", pa.binary()), ("code", pa.binary()), ("word", pa.binary())])


def _code_block(block: pa.Table) -> pa.Table:
    """A block as one row: its documents, tokens and the hashes of its words."""
    rows, code, dictionary = tokens(block.column("text").combine_chunks())
    return pa.table([[block.column("blk")[0].as_py()], [block.column("doc_id").to_pylist()], [block.column("held").to_pylist()],
                     [_pack(np.bincount(rows, minlength=block.num_rows))], [_pack(code)],
                     [_pack(np.append(word_hashes(dictionary), _END))]], schema=_CODED)


class Block:
    """The tokens of a block: ``code`` and ``hash`` of the word, ``place`` in the
    document; ``count[d]``: training occurrences of the sequence of d + 1 words
    that ends at each token (from d = 1 on 0 if not counted)."""

    def __init__(self, coded: pa.Table, mail: pa.Table, least: int):
        self.least = least
        self.blk = coded.column("blk")[0].as_py()
        self.docs, self.held = coded.column("doc_id")[0].as_py(), np.array(coded.column("held")[0].as_py(), dtype=bool)
        size = _unpack(coded.column("size")[0].as_py())
        self.row = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(size) - size, size)
        self.code, self.word = _unpack(coded.column("code")[0].as_py()), _unpack(coded.column("word")[0].as_py(), np.uint64)
        self.hash = self.word[self.code]
        self.runs = [mix(self.word)[self.code]]
        self.train = ~self.held[self.row]
        self.mail = mail
        self.count = {r["level"]: _unpack(r["a"]) for r in self._of(KEPT).select(["level", "a"]).to_pylist()}
        if 0 in self.count:                 # kept per word
            self.count[0] = self.count[0][self.code]

    def _of(self, kind: int, level: int | None = None) -> pa.Table:
        keep = pc.equal(self.mail.column("kind"), kind)
        if level is not None:
            keep = pc.and_(keep, pc.equal(self.mail.column("level"), level))
        return self.mail.filter(keep)

    def answer(self, kind: int, level: int, column: str = "a") -> np.ndarray:
        """The buckets' answers, in the order of the sorted keys."""
        parts = [_unpack(x) for x in self._of(kind, level).sort_by("bucket").column(column).to_pylist()]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def sequences(self, d: int) -> np.ndarray:
        """Hash of the sequence of d + 1 words that ends at each token with
        so many words before it (longer ones from shorter ones)."""
        while len(self.runs) <= d:
            self.runs.append(np.concatenate([self.hash[:1], mix(self.runs[-1][:-1] * _STEP + self.hash[1:])]))
        return self.runs[d]

    def candidates(self, d: int) -> np.ndarray:
        """Tokens that end a sequence of d + 1 words worth counting: both its
        parts are counted, and the shorter context has other continuations."""
        part = self.count[d - 1]
        ok = (self.place[1:] >= d) & (part[:-1] >= self.least) & (part[1:] >= self.least)
        if d > 1:
            ok &= part[1:] < self.count[d - 2][:-1]
        return np.flatnonzero(ok) + 1

    def in_context(self, d: int) -> np.ndarray:
        """Tokens after a counted context of d words that may be a state: some
        continuation may be counted, and the shorter context has others."""
        part = self.count[d - 1]
        ok = (self.place[1:] >= d) & (part[:-1] >= self.least)
        ok &= (self.count[d][1:] >= self.least) | (part[:-1] > self.least) | ~self.train[1:]
        if d > 1:
            ok &= part[1:] != self.count[d - 2][:-1]
        return np.flatnonzero(ok) + 1

    def grams(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, their sequences' index, sorted distinct hashes) of level d."""
        if d == 0:
            keys, index = _distinct(mix(self.word))
            return np.arange(len(self.code)), index[self.code], keys
        at = self.candidates(d)
        keys, index = _distinct(self.sequences(d)[at])
        return at, index, keys

    def contexts(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, their contexts' index, sorted distinct hashes) of contexts
        of d words."""
        at = self.in_context(d)
        keys, index = _distinct(self.sequences(d - 1)[at - 1])
        return at, index, keys

    def send_grams(self, d: int, buckets: int) -> pa.Table:
        at, index, keys = self.grams(d)
        n = np.bincount(index[self.train[at]], minlength=len(keys))
        names, cuts = _deal(keys, buckets)
        return _mail(GRAMS, d, self.blk, names, _cut(n, cuts), _cut_keys(keys, cuts))

    def take_counts(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Fill ``count[d]`` from the answers; returns a token of each sequence
        that no earlier block holds, and is counted."""
        at, index, keys = self.grams(d)
        answer = self.answer(COUNTED, d)
        total = answer >> 1
        if d:
            total[total < self.least] = 0
        count = np.zeros(len(self.code), dtype=np.int64)
        count[at] = total[index]
        if d > 1:                           # after a context always followed by this word: as often as the context
            part = self.count[d - 1]
            sure = np.flatnonzero((self.place[1:] >= d) & (part[:-1] >= self.least) & (part[1:] >= self.least)
                                  & (part[1:] == self.count[d - 2][:-1]))
            count[sure + 1] = part[sure]
        self.count[d] = count
        token = np.zeros(len(keys), dtype=np.int64)
        token[index] = at
        return token[(answer & 1 == 1) & (total >= self.least)]

    def send_contexts(self, d: int, new: np.ndarray, n_train: int, vocabulary: int, buckets: int) -> pa.Table:
        """Per context of the block its count, and over the continuations
        this block is the first to hold: their number, counts, shares in the
        parent and divergence in bits."""
        at, index, keys = self.contexts(d)
        where = np.zeros(len(self.code), dtype=np.int64)
        where[at] = index
        n = np.zeros(len(keys), dtype=np.int64)
        n[index] = self.count[d - 1][at - 1]
        ctx, c, short = where[new], self.count[d][new], self.count[d - 1][new]
        q = (short + 1) / (n_train + vocabulary + 1) if d == 1 else short / self.count[d - 2][new - 1]
        p = c / n[ctx]
        sums = np.stack([np.bincount(ctx, x, len(keys)) for x in (np.ones(len(new)), c, q, p * np.log2(p / q))])
        names, cuts = _deal(keys, buckets)
        return _mail(CONTEXTS, d, self.blk, names, _cut(sums, cuts), _cut_keys(keys, cuts), _cut(n, cuts))

    def scores(self, depth: int, n_train: int, vocabulary: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token in the root and in the tree."""
        p = (self.count[0] + 1) / (n_train + vocabulary + 1)
        base = np.log10(p)
        for d in range(1, depth + 1):                               # from the root to the longest suffix state
            if d not in self.count:
                break
            at, index, _ = self.contexts(d)
            own = self.answer(JUDGED, d)[index]
            at, index, own = at[own > 0], index[own > 0], own[own > 0]
            free = discount * self.answer(JUDGED, d, "b")[index]
            c, n = self.count[d][at], self.count[d - 1][at - 1]
            p[at] = (np.where(c >= self.least, c - discount, 0) + (n - own + free) * p[at]) / n
        return base, np.log10(p)


def _start(coded: pa.Table, buckets: int, least: int) -> pa.Table:
    return Block(coded, _MAIL.empty_table(), least).send_grams(0, buckets)


def _round(coded: pa.Table, mail: pa.Table, d: int, depth: int, n_train: int, vocabulary: int, buckets: int, least: int) -> pa.Table:
    """A block takes the counts of level d, sends the contexts of d words and
    the sequences of the next level."""
    if coded.num_rows == 0:
        return _MAIL.empty_table()
    block = Block(coded, mail, least)
    new = block.take_counts(d)
    kept = block.count[d]
    if d == 0:                              # a count per word says it all
        kept = np.zeros(len(block.word), dtype=np.int64)
        kept[block.code] = block.count[0]
    out = [_mail(KEPT, d, block.blk, block.blk, [_pack(kept)])]
    if d:
        out.append(block.send_contexts(d, new, n_train, vocabulary, buckets))
    if d < depth:
        out.append(block.send_grams(d + 1, buckets))
    return pa.concat_tables(out)


# ------------------------------------------------------------------- buckets

def _sum_bucket(table: pa.Table, min_bits: float) -> pa.Table:
    """Per block, of each sequence it sent 2 * (its count) + (this block is the
    first to hold it); of each context, if it is a state, the sum and number of its
    counted continuations, else 0."""
    kind, level = table.column("kind")[0].as_py(), table.column("level")[0].as_py()
    if kind == KEPT:                        # what a block keeps passes through
        return table
    table = table.sort_by("blk")
    sent = [_unpack_keys(x) for x in table.column("keys").to_pylist()]
    cuts = np.cumsum([0, *map(len, sent)])
    keys, index = _distinct(np.concatenate(sent))
    blk, bucket = table.column("blk").to_numpy(), table.column("bucket").to_numpy()
    if kind == GRAMS:
        total = np.bincount(index, np.concatenate([_unpack(x) for x in table.column("a").to_pylist()]), len(keys)).astype(np.int64)
        first = np.zeros(len(keys), dtype=np.int64)
        first[index[::-1]] = np.arange(len(index))[::-1]            # the last one written stays
        answer = 2 * total[index]
        answer[first] += 1
        tokens_, types = np.zeros(len(sent), dtype=np.int64), np.zeros(len(sent), dtype=np.int64)
        if level == 0:
            tokens_[0], types[0] = total.sum(), np.count_nonzero(total)
        return _mail(COUNTED, level, blk, bucket, _cut(answer, cuts), tokens_=tokens_, types=types)
    parts = np.concatenate([_unpack(x, np.float64).reshape(4, -1) for x in table.column("a").to_pylist()], axis=1)
    m, own, q, bits = (np.bincount(index, x, len(keys)) for x in parts)
    n = np.zeros(len(keys))
    n[index] = np.concatenate([_unpack(x) for x in table.column("b").to_pylist()])
    rest_p, rest_q = np.clip(1 - own / n, 0, 1), np.clip(1 - q, 1e-12, 1)
    bits += np.where(rest_p > 1e-15, rest_p * np.log2(np.maximum(rest_p, 1e-300) / rest_q), 0)
    state = (m > 0) & (bits >= min_bits)
    return _mail(JUDGED, level, blk, bucket, _cut((own * state).astype(np.int64)[index], cuts),
                 b=_cut((m * state).astype(np.int64)[index], cuts))


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_cleared(spark):
    """Shuffle files of the writes inside, which nobody reads again, go at once."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


class _Post:
    """The buckets' answers to mail, written by kind in the shared folder."""

    def __init__(self, mail: DataFrame, name: str, min_bits: float):
        self.spark, self.path = mail.sparkSession, shared_path(mail.sparkSession, name)
        add = partial(_sum_bucket, min_bits=min_bits)
        df = mail.groupBy("kind", "bucket").applyInArrow(lambda t: add(t), MAIL)
        with _shuffles_cleared(self.spark):
            df.write.partitionBy("kind").parquet(self.path)

    def of(self, kind: int) -> DataFrame:
        return self.spark.read.schema(MAIL).parquet(self.path).filter(F.col("kind") == kind).select(_MAIL.names)

    def drop(self, kind: int) -> None:
        remove_path(self.spark, f"{self.path}/kind={kind}")


def _code_blocks(src: DataFrame, blocks: int) -> tuple[DataFrame, str]:
    """The blocks as a table bucketed by block: the rounds join their mail to
    it without moving it again. Returns it with its name in the catalog."""
    spark, name = src.sparkSession, f"coded_blocks_{uuid.uuid4().hex}"
    n = max(shuffle_width(spark), blocks // BLOCKS_A_TASK + 1)
    coded = src.repartition(n, "blk").groupBy("blk").applyInArrow(_code_block, CODED)   # a task writes one bucket
    with _shuffles_cleared(spark):
        coded.write.option("path", shared_path(spark, "coded-blocks")).bucketBy(n, "blk").saveAsTable(name)
    return spark.table(name), name


def score_texts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, min_bits: float = MIN_BITS,
                block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, discount: float = DISCOUNT) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text, boolean held); learns
    from the rows not held."""
    assert depth >= 0 and least >= 2
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = size // block_bytes + 1, size // bucket_bytes + 1
    src = src.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    coded, table = _code_blocks(src, blocks)
    post = partial(_Post, min_bits=min_bits)
    start = partial(_start, buckets=buckets, least=least)
    got = [post(coded.groupBy("blk").applyInArrow(lambda t: start(t), MAIL), "words")]
    n_train, vocabulary = got[0].of(COUNTED).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    for d in range(depth + 1):
        step = partial(_round, d=d, depth=depth, n_train=n_train, vocabulary=vocabulary, buckets=buckets, least=least)
        inbox = got[-1].of(COUNTED)
        for back in got[-2:]:
            inbox = inbox.unionByName(back.of(KEPT))
        sent = coded.groupBy("blk").cogroup(inbox.groupBy("blk")).applyInArrow(lambda t, m: step(t, m), MAIL)
        got.append(post(sent, f"round-{d}"))
        got[-2].drop(COUNTED)
        if d < depth and got[-1].of(COUNTED).isEmpty():             # no sequence is left
            break
    inbox = got[-1].of(KEPT).unionByName(got[-1].of(JUDGED))
    for back in got[1:-1]:
        inbox = inbox.unionByName(back.of(KEPT)).unionByName(back.of(JUDGED))
    score = partial(_score_block, depth=depth, n_train=n_train, vocabulary=vocabulary, least=least, discount=discount)
    out = coded.groupBy("blk").cogroup(inbox.groupBy("blk")).applyInArrow(lambda t, m: score(t, m), RESULT)
    docs.sparkSession.sql(f"DROP TABLE {table}")                    # the name; the files stay for the result
    return out


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(coded: pa.Table, mail: pa.Table, depth: int, n_train: int, vocabulary: int, least: int, discount: float) -> pa.Table:
    if coded.num_rows == 0:
        return _RESULT.empty_table()
    block = Block(coded, mail, least)
    base, score = block.scores(depth, n_train, vocabulary, discount)
    n = len(block.docs)
    return pa.table([
        pa.array(block.docs, pa.int64()), pa.array(block.held), pa.array(np.bincount(block.row, minlength=n)),
        pa.array(np.bincount(block.row, block.count[0] > 0, n).astype(np.int64)), pa.array(np.full(n, n_train, dtype=np.int64)),
        pa.array(np.bincount(block.row, base, n)), pa.array(np.bincount(block.row, score, n))], schema=_RESULT)


def op1_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                   (id_crc(F.col("doc_id")) % 7 == 2).alias("held")))
