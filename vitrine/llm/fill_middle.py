"""Fill-in-middle transformation with a sparse exception index.

A text is cut into units (a word with the blanks before it; or single code
points), two cuts divide it into prefix, middle and suffix, and the parts are
written behind sentinels in prefix-suffix-middle or suffix-prefix-middle order.

Texts are handled as the concatenated UTF-8 bytes of a slice of rows. Blanks
are ASCII, so word cuts are found on bytes. Of all characters only the multibyte
ones are recorded: their positions and the sum of excess bytes up to each. A
binary search in that list converts byte cuts to code points or back; between
two entries the positions differ by a constant, so a pure ASCII text needs no
entry at all. Choices are drawn from a SHA-256 of seed and doc_id: the result
does not depend on partitions or retries.

No sentinel can arise across a cut, as no proper prefix of a sentinel is its
suffix, and texts that contain one stay plain; so the output splits at its
sentinels into exactly the three parts, and ``restore`` rebuilds every text.

Defined cases: null or empty text is plain with n = 0; a null doc_id draws from
the seed alone; repeated rows are transformed alike; very long texts are a slice
of their own; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import slices

SEED = 42
RATE = 50                 # percent of the texts
SPM_RATE = 80             # percent of the transformed ones
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 8 << 20


class Exceptions:
    """Multibyte characters of UTF-8 bytes: ``byte`` and ``char``, where each
    starts, and ``excess``, the bytes beyond one of all before it (and, last,
    of all)."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64))])
        self.char = self.byte - self.excess[:-1]

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte cut."""
        return cuts - self.excess[np.searchsorted(self.byte, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return cuts + self.excess[np.searchsorted(self.char, cuts)]


def word_ends(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Byte after each unit: a word with the blanks before it, or the blanks
    at the end of a text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.zeros(len(data), dtype=bool)
    last[offset[1:][np.diff(offset) > 0] - 1] = True
    stop = last.copy()
    stop[:-1] |= ~blank[:-1] & blank[1:]
    return np.flatnonzero(stop) + 1


def _cuts(data: np.ndarray, offset: np.ndarray, draw: np.ndarray, unit: str, index: Exceptions) -> tuple[np.ndarray, np.ndarray]:
    """(units of each text, byte position of its two cuts, the smaller first)."""
    if unit == "word":
        ends = word_ends(data, offset)
        first = np.searchsorted(ends, offset[:-1], side="right")
        n = np.searchsorted(ends, offset[1:], side="right") - first
    else:
        place = index.chars(offset)
        n = np.diff(place)
    at = np.sort(draw % (n + 1)[:, None], axis=1)
    if unit == "char":
        return n, index.bytes(place[:-1, None] + at)
    ends = np.append(ends, 0)                                       # looked up where no unit is before the cut
    return n, np.where(at > 0, ends[first[:, None] + at - 1], offset[:-1, None])


def _transform(batches: Iterable[pa.RecordBatch], unit: str, rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            texts = part.column("text").to_pylist()
            offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            h = np.stack([part.column(f"h{k}").to_numpy() for k in range(1, 5)])
            index = Exceptions(data)
            n, cut = _cuts(data, offset, h[:2].T, unit, index)
            held = np.zeros(len(texts), dtype=bool)
            for mark in (p, s, m):
                held |= pc.match_substring(part.column("text"), mark).to_numpy(zero_copy_only=False)
            plain = (np.diff(offset) == 0) | held | (h[2] % 100 >= rate)
            spm = h[3] % 100 < spm_rate
            chars = np.diff(index.chars(np.concatenate([offset[:-1, None], cut], axis=1)), axis=1)
            out = list(texts)
            for k in np.flatnonzero(~plain).tolist():
                a, b = (cut[k] - offset[k]).tolist()
                pre, mid, suf = texts[k][:a], texts[k][a:b], texts[k][b:]
                out[k] = b"".join((s, suf, p, pre, m, mid) if spm[k] else (p, pre, s, suf, m, mid))
            form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), form, pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1], mask=plain),
                 pa.array(out, pa.binary())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, unit: str = "word", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output) of every
    row; ``unit``: ``word`` or ``char``."""
    assert unit in ("word", "char")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    src = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), digest.alias("digest"))
    src = src.select("doc_id", "text", *(
        F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))
    kind = src.schema["doc_id"].dataType.simpleString()
    done = src.mapInArrow(partial(_transform, unit=unit, rate=rate, spm_rate=spm_rate),
                          f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])) \
        .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    done = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
numbers AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
    ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM drawn),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p,
    coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
