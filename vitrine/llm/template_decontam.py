"""Benchmark decontamination by template canonicalisation.

Every token becomes a template token: numbers, units and names turn into the
typed placeholders <num>, <unit>, <name>, other words into their lower-cased
core without outer punctuation. Windows of five template tokens (an item
shorter than that: all its tokens) of the benchmark are hash-joined with those
of the documents. For each document, item and alignment (difference of the
window positions) the slots must be consistent: one value of the item always
stands for the same value of the document. An item has leaked into a document
if its windows found in consistent alignments are at least 0.8 of all its
windows. So a question whose numbers or names were exchanged is caught, and
two questions that only share a frame with contradicting slots are not. An item
shorter than a window has no context of its own, so it has leaked only into a
document that is (nearly) the item: it must be at least the same share, 0.8, of
the document's tokens.

Document windows are prefiltered by a bitmap of fixed size over the benchmark
hashes (2^22 bits, broadcast); the equi-join on the full 64-bit hash decides.
Windows with fewer than two plain words carry no text and do not count.

A capitalised word is a name unless it starts a sentence (first token, or
after a token ending in . ! or ?). As the sentence start of an item can fall
into the middle of a document's sentence, its first window is also offered
with that word as a name.

Typing depends on case and place, so each window is offered in more forms, and
a position counts as matched if one form matches: with the words typed as names
anywhere in the benchmark as names whatever their case or place, and those
typed as names elsewhere in the same text as names where they open a sentence
too; and untyped, all tokens lower-cased and without slots (a match stands for
equal values). An alignment is judged on the plain typing alone and on all
forms together; windows of either, if consistent, count. The benchmark's names
are a bitmap of fixed size too; a word that shares a bit with a name is typed as
a name in that form, on both sides alike.

An item's rarest windows, a fifth and one more, find its candidate documents
(one of them must match), and only those are held against all its windows.

Defined cases: null or empty texts have no windows; an item without a counting
window never matches; repeated documents and items are matched each (equal
item_ids are one item per row), a null doc_id as an id of its own; very long
texts are a slice of their own; empty tables give an empty result. Documents may
come from any plan: a row is known by a hash of its id and text, not by its
place. Only doc_id, text and item_id, text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import frees, materialise, slices, words
from vitrine.llm.linear import mix, word_hashes

WINDOW = 5
SIMILARITY = 0.8
BITS = 22
PLAIN = 2
#: Number words and units.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
                "million billion dozen").split()
UNITS = ("mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs hz khz mhz ghz w kw mw v a j kj cal "
         "kcal pa kpa bar k c f usd eur gbp cent cents dollar dollars euro euros pound pounds meter meters metre metres "
         "kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram "
         "kilograms ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
         "week weeks month months year years percent degree degrees").split()
NUMBER = r"^[+\-$€£]*\d[\d.,:/\-]*(%|st|nd|rd|th)?$"
QUANTITY = r"^[+\-$€£]*\d[\d.,]*(mm|cm|m|km|mg|g|kg|ml|l|s|h|w|kw|v|mb|gb|tb)$"
_EDGE = ".,;:!?()[]{}\"'`*#%&$<>|"
_STEP = np.uint64(0x2545F4914F6CDD1D)
_NUM, _UNIT, _NAME, _PLAIN = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _flag(mask) -> np.ndarray:
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = _place(h)
    return (bitmap[place >> 3] >> (place & 7)) & 1 == 1


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of 2^22 bits over a column of hashes; the set bits come to the
    driver, a fixed number at most."""
    place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - BITS).cast("int")
    at = np.asarray(hashes.select(place.alias("b")).distinct().toPandas()["b"], dtype=np.int64)
    bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def template(texts: pa.Array, name_start: bool = False, names: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Per token: document row, template token, slot type flag, value hash, and
    whether it is a name.

    ``name_start``: a capitalised word at the very start is taken as a name.
    ``names``: bitmap of the words that are names in any case and place; then
    also words that are names elsewhere in the same text where they open a sentence."""
    doc, code, dictionary = words(texts)
    lower = pc.utf8_lower(dictionary)
    core = pc.utf8_trim(lower, _EDGE)
    core = pc.if_else(pc.equal(core, ""), lower, core)
    kind = np.zeros(len(dictionary), dtype=np.int8)
    kind[_flag(pc.is_in(core, value_set=pa.array(UNITS)))] = 2
    kind[_flag(pc.or_(pc.match_substring_regex(core, NUMBER), pc.or_(
        pc.match_substring_regex(core, QUANTITY), pc.is_in(core, value_set=pa.array(NUMBER_WORDS)))))] = 1
    capital = _flag(pc.match_substring_regex(dictionary, r"^[(\[\"'`]*\p{Lu}[\p{Ll}'-]")) & (kind == 0)
    ends = _flag(pc.match_substring_regex(dictionary, r"[.!?][)\]\"'`]*$"))
    value = word_hashes(core)
    first = np.ones(len(code), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    opens = first.copy()
    opens[1:] |= ends[code[:-1]]
    own = kind[code]
    own[capital[code] & (~opens | (first & name_start))] = 3
    v = value[code]
    if names is not None:
        own[(own == 0) & _held(names, v)] = 3
        here = mix(v + doc.astype(np.uint64) * _STEP)
        own[(own == 0) & capital[code] & np.isin(here, here[own == 3])] = 3
    token = np.where(own == 1, _NUM, np.where(own == 2, _UNIT, np.where(own == 3, _NAME, v)))
    return {"doc": doc, "token": token, "slot": own > 0, "value": v, "name": own == 3}


def untyped(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The same tokens without slots."""
    return {**t, "token": mix(t["value"] + _PLAIN), "slot": np.zeros(len(t["doc"]), dtype=bool)}


def _differ(t: dict, other: dict, at: np.ndarray, length: int) -> np.ndarray:
    """Windows in which the two forms differ."""
    changed = np.concatenate([[0], np.cumsum(t["token"] != other["token"])])
    return changed[at + length] > changed[at]


def windows(t: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token index, hash) of the counting windows of ``length`` tokens."""
    n = len(t["doc"]) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, length, dtype=np.uint64)
    slots = np.zeros(n, dtype=np.int64)
    for k in range(length):
        h = mix(h * _STEP + t["token"][k:k + n])
        slots += t["slot"][k:k + n]
    ok = (t["doc"][:n] == t["doc"][length - 1:]) & (length - slots >= min(PLAIN, length))
    at = np.flatnonzero(ok)
    return at, h[at]


def _rows(ids: pa.Array, t: dict, at: np.ndarray, h: np.ndarray, length: int, start: np.ndarray,
          form: int) -> pa.RecordBatch:
    """One row per window: id, position in its text, hash, slot values, form."""
    use = t["slot"][at[:, None] + np.arange(length)] if len(at) else np.zeros((0, length), dtype=bool)
    values = t["value"][at[:, None] + np.arange(length)][use] if len(at) else np.zeros(0, np.uint64)
    cuts = np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(t["doc"][at])), pa.array(at - start[t["doc"][at]]), pa.array(h.view(np.int64)),
         pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.view(np.int64))),
         pa.array(np.full(len(at), form, dtype=np.int32))], ["row", "pos", "hash", "slots", "form"])


def _starts(t: dict, n: int) -> np.ndarray:
    return np.searchsorted(t["doc"], np.arange(n))


#: Forms of a window: plain typing, typing with more names, untyped.
TYPED, NAMED, UNTYPED = range(3)


def _item_names(batches) -> Iterator[pa.RecordBatch]:
    """Value hashes of the words typed as names."""
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            t = template(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(t["value"][t["name"]]).view(np.int64))], ["name"])


def _item_windows(batches, window: int, names) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            ids, n, texts = part.column("row"), part.num_rows, part.column("text")
            plain = template(texts)
            size = np.bincount(plain["doc"], minlength=n)
            start = _starts(plain, n)
            more = template(texts, names=names.value)
            forms = [(plain, None, TYPED), (template(texts, name_start=True), plain, TYPED), (more, plain, NAMED),
                     (template(texts, name_start=True, names=names.value), more, NAMED), (untyped(plain), None, UNTYPED)]
            for t, other, form in forms:
                for length in range(1, window + 1):
                    at, h = windows(t, length)
                    at_doc = t["doc"][at]
                    keep = (size[at_doc] >= window) if length == window else (size[at_doc] == length)
                    if form == UNTYPED:         # the positions that count are those of the plain typing
                        keep &= np.isin(at, windows(plain, length)[0])
                    elif other is more or (form == TYPED and other is plain):
                        # only the first window, and only where the name changes it
                        keep &= (at == start[at_doc]) & (t["token"][at] != other["token"][at])
                    elif other is plain:
                        keep &= _differ(t, plain, at, length)
                    out = _rows(ids, plain if form == UNTYPED else t, at[keep], h[keep], length, start, form)
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(np.full(out.num_rows, length, dtype=np.int32))], [*out.schema.names, "length"])


@frees
def _doc_windows(batches, lengths: list[int], bitmap, names, window: int, similarity: float) -> Iterator[pa.RecordBatch]:
    bits = bitmap.value
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            plain = template(part.column("text"))
            start = _starts(plain, part.num_rows)
            size = np.bincount(plain["doc"], minlength=part.num_rows)
            for form in (TYPED, NAMED, UNTYPED):
                t = plain if form == TYPED else template(part.column("text"), names=names.value) if form == NAMED else untyped(plain)
                for length in lengths:
                    at, h = windows(t, length)
                    hit = _held(bits, h)
                    if length < window:
                        hit &= length >= similarity * size[t["doc"][at]]
                    if form == NAMED:
                        hit &= _differ(t, plain, at, length)
                    yield _rows(part.column("row"), t, at[hit], h[hit], length, start, form)


WINDOW_SCHEMA = "row {}, pos long, hash long, slots array<long>, form int"


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, coverage, same_values,
    text_mark) of every leak; ``same_values``: all slots hold the item's own
    values; ``text_mark``, a hash of the text, tells rows of one id apart."""
    spark = docs.sparkSession
    items = materialise(
        benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
        .withColumn("row", F.monotonically_increasing_id()), "items")
    names = spark.sparkContext.broadcast(_bitmap(items.select("text").mapInArrow(_item_names, "name long")))
    own = materialise(items.select("row", "text").mapInArrow(
        partial(_item_windows, window=window, names=names), f"{WINDOW_SCHEMA.format('long')}, length int"), "item-windows")
    size = own.groupBy("row").agg(F.countDistinct("pos").alias("item_windows"))
    named = materialise(items.select("row", "item_id").join(size, "row"), "item-sizes")
    # both at most of a fixed size: the distinct window lengths, the set bits
    lengths = sorted(r[0] for r in own.select("length").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(own.select("hash")))

    # a document is known by its own hash, whatever plan brings it: equal rows are one until the end
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.concat_ws("-", F.xxhash64("doc_id", text), F.xxhash64(F.lit(1), "doc_id", text))
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), row.alias("row"))
    found = materialise(keyed.select("row", "text").mapInArrow(
        partial(_doc_windows, lengths=lengths, bitmap=bitmap, names=names, window=window, similarity=similarity),
        WINDOW_SCHEMA.format("string")).distinct(), "document-windows")
    item = own.select(F.col("row").alias("item"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"),
                      F.col("form").alias("item_form"))
    pairs = materialise(candidates(found, item, similarity), "candidates")
    found = found.join(pairs, "row")
    values = F.when(F.col("form") == UNTYPED, F.col("item_slots")).otherwise(F.col("slots"))
    # plain typing is judged alone (0) and with the other forms (1)
    judged = F.when((F.col("form") == TYPED) & (F.col("item_form") == TYPED), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    hit = found.join(item, ["item", "hash"]).select(
        "row", "item", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos",
        F.arrays_zip(F.col("item_slots").alias("i"), values.alias("d")).alias("pairs"), F.explode(judged).alias("judged"))
    # one alignment holds each window of the item once, so its sets are bounded by the item
    line = hit.groupBy("row", "item", "shift", "judged").agg(
        F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    line = line.filter(F.size(F.array_distinct(F.col("pairs.i"))) == F.size("pairs"))
    whole = line.groupBy("row", "item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("matched_windows"),
        F.min(F.forall("pairs", lambda p: p["i"] == p["d"])).alias("same_values"))
    whole = whole.join(named.withColumnRenamed("row", "item"), "item") \
        .withColumn("coverage", F.col("matched_windows") / F.col("item_windows")) \
        .filter(F.col("coverage") >= similarity)
    return materialise(whole, "leaks").join(keyed.select("row", "doc_id", text_mark().alias("text_mark")), "row").select(
        "doc_id", "item_id", F.col("matched_windows").cast("long"), "item_windows", "coverage", "same_values", "text_mark")


def candidates(found: DataFrame, item: DataFrame, similarity: float) -> DataFrame:
    """(row, item) of the documents that may hold an item.

    An item that leaked misses at most a share of 1 - similarity of its
    positions, so of any more of them one matches: the rarest ones are taken,
    by the document windows all their forms meet. A frame that many items and
    many documents share is joined only where an item has nothing rarer."""
    often = found.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    met = item.join(often, "hash", "left").groupBy("item", "item_pos").agg(F.sum(F.coalesce("often", F.lit(0))).alias("often"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("often", "item_pos"))
    n = F.count(F.lit(1)).over(Window.partitionBy("item"))
    few = met.withColumns({"rank": rank, "n": n}).filter(F.col("rank") <= F.floor(F.col("n") * (1 - similarity) + 1e-9) + 1)
    keys = item.join(few.filter("often > 0").select("item", "item_pos"), ["item", "item_pos"]).select("item", "hash").distinct()
    return found.select("row", "hash").distinct().join(keys, "hash").select("row", "item").distinct()


def text_mark():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (all columns) into which no item has leaked."""
    bad = materialise(
        leaks(docs, benchmark, window, similarity).select(
            F.col("doc_id").alias("_leak_id"), F.col("text_mark").alias("_leak_mark")).distinct(), "leaked")
    same = docs["doc_id"].eqNullSafe(bad["_leak_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["_leak_mark"])
    return docs.join(bad, same, "left_anti")


def op2_template_decontam(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
