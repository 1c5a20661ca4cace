"""Removal of lines that many documents share. DataFrame functions only.

Every text is split at line feeds. A line's key is the line without blanks at
both ends, A-Z in lower case; it is hashed to 128 bits. The distinct keys of each
document are exploded and counted per hash, which gives the number of documents.
Lines are then exploded with their position, those with a frequent key are
found by an equi-join on the hash, their positions are gathered per document
(bounded by the document's own lines), and the document is put together again
from the lines at all other positions, in order.

Only hashes and positions move until the last join, which returns the dropped
positions to the texts. A line that stands in a third of all documents is
counted map-side first; in the join its rows are split by the skew join (the
frequent hashes are a written table with one row each), and nothing is ever
gathered by line.

Defined cases: null or empty text is one empty line; keys shorter than
``least_chars`` stay in place, so empty lines do; each row is a document, so
repeated rows count and are cut alike; rows are told apart by a 128-bit hash of
id and text, a null doc_id being an id of its own; an empty table gives an
empty result. Other columns are kept by ``drop_lines`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import lower_ascii, materialise

LEAST_CHARS = 1
LEAST_DOCUMENTS = 10
BLANKS = " \t\n\x0b\x0c\r"


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _all(names: list[str], of: str = "") -> list[Column]:
    """The columns, quoted; ``of``: fields of this struct."""
    return [F.col(of + "`" + c.replace("`", "``") + "`").alias(c) for c in names]


def _hash(*values: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes, the second from another starting value."""
    return F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(1), *values).alias("h2")


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def frequent_keys(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, documents) of the line keys that so many documents hold."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(_split(lower_ascii(_text(docs))), _key))).alias("key"))
    return keys.filter(F.length("key") >= least_chars).select(*_hash(F.col("key"))) \
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= least_documents)


def cut_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row: all columns of ``docs``, n_lines, n_dropped, kept) of every row."""
    frequent = materialise(frequent_keys(docs, least_documents, least_chars).select("h1", "h2"), "frequent-lines")
    d1, d2 = _hash(docs["doc_id"], _text(docs))
    src = docs.select(F.struct(*_all(docs.columns)).alias("row"), _text(docs).alias("text"),
                      d1.alias("d1"), d2.alias("d2"))
    lines = src.select("d1", "d2", F.posexplode(_split(lower_ascii(F.col("text")))).alias("pos", "line")) \
        .select("d1", "d2", "pos", _key(F.col("line")).alias("key")).filter(F.length("key") >= least_chars) \
        .select("d1", "d2", "pos", *_hash(F.col("key")))
    drops = materialise(
        lines.join(frequent, ["h1", "h2"]).groupBy("d1", "d2").agg(F.collect_set("pos").alias("dropped")), "dropped-lines")
    out = src.join(drops, ["d1", "d2"], "left").select(
        "row", "text", _split(F.col("text")).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n")
    return out.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
                      F.when(F.size("dropped") == 0, F.col("text")).otherwise(kept).alias("kept"))


def drop_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the frequent lines cut out of ``text``."""
    done = cut_lines(docs, least_documents, least_chars)
    return done.select(*(F.col("kept").alias(n) if n == "text" else c for n, c in zip(docs.columns, _all(docs.columns, "row."), strict=True)))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH rows AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT k, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM rows),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT k) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY k
"""
