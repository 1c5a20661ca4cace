"""The learned and the many-stage operators against plain Python versions of
their methods: one text, one token, one update at a time."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_text_ops as brute
from vitrine.llm import ftrl_quality, langid, template_decontam
from vitrine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FULL = (1 << 64) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix(h):
    h = ((h ^ h >> 31) * 0xBF58476D1CE4E5B9) & FULL
    return h ^ h >> 29


def hashed(data: bytes) -> int:
    out, power = 0, 1
    for b in data:
        power = power * 0x9E3779B97F4A7C15 & FULL
        out += (b + 1) * power
    return mix(out & FULL)


def spark_hash(*values) -> int:
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def held_out(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def sigmoid(z):
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


# ------------------------------------------------------------------ op4

def quality_features(text):
    """Counts of the hashed words, word pairs and shape pairs; number of words."""
    out, before, last = Counter(), (1, 1), None
    found = WORD.findall(text or "")
    for word in found:
        again = word == last
        kind = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in word.encode())
        shape = 0x5851F42D4C957F2D if again else hashed(bytes(b for k, b in enumerate(kind) if k == 0 or kind[k - 1] != b))
        w = hashed(word.encode())
        pair = 0x5851F42D4C957F2D if again else mix((before[0] * 0xD6E8FEB86659FD93 + w) & FULL)
        for h in (mix(w), pair, mix((before[1] * 0xA0761D6478BD642F + shape) & FULL)):
            out[h >> 46] += 1
        before, last = (w, shape), word
    return out, max(len(found), 1)


def plain_quality(docs, labels, sample, shards=4, epochs=3, alpha=0.3, beta=1.0, l1=0.02, l2=0.02):
    """Scores of (doc_id, text) rows, in their order."""
    given = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            given[i].append(q)
    signed = {i: spark_hash(i, "sample") for i in given}
    chosen = sorted(given, key=lambda i: (signed[i], i))[:sample]
    total, rows = defaultdict(float), 0
    for shard in range(shards):
        own = [(signed[i], i, t) for i, t in docs if i in set(chosen) and signed[i] % shards == shard]
        z, n = defaultdict(float), defaultdict(float)

        def weight(f):
            return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)
        examples = []
        for _, i, t in sorted(own, key=lambda r: r[:2]):
            count, size = quality_features(t)
            examples.append(({**{f: 10 * c / size for f, c in count.items()}, "bias": 1.0}, float(np.mean(given[i]) >= 0.5)))
        for _ in range(epochs):
            for x, y in examples:
                w = {f: weight(f) for f in x}
                miss = sigmoid(sum(w[f] * v for f, v in x.items())) - y
                for f, v in x.items():
                    g = miss * v
                    root = math.sqrt(n[f])
                    n[f] += g * g
                    z[f] += g - (math.sqrt(n[f]) - root) / alpha * w[f]
        for f in z:
            total[f] += len(examples) * float(np.float32(weight(f)))
        rows += len(examples)
    mean = {f: v / max(rows, 1) for f, v in total.items()}
    out = []
    for _, t in docs:
        count, size = quality_features(t)
        out.append(sigmoid(10 * sum(c * mean.get(f, 0.0) for f, c in count.items()) / size + mean.get("bias", 0.0)))
    return out


def test_quality_equals_plain_training(spark, table):
    docs = list(table("sf0.001", "documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    labels = [(i, q) for i, q in table("sf0.001", "labels")[["doc_id", "quality"]].itertuples(index=False, name=None)]
    want = plain_quality(docs, [(i, q) for i, q in labels if not held_out(i)], ftrl_quality.SAMPLE)
    out = {r["doc_id"]: r for r in QUERIES["op4_ftrl_quality"](spark, SF).collect()}
    assert len(out) == len(docs)
    for (i, _), score in zip(docs, want, strict=True):
        assert out[i]["held_out"] == held_out(i) and math.isclose(out[i]["score"], score, abs_tol=1e-6)
        assert out[i]["predicted"] == int(out[i]["score"] >= 0.3)


def test_quality_sample_is_the_smallest_marks(spark):
    """A bound below the number of labels, labels twice, missing and unknown ones, odd texts."""
    docs = [(k, t) for k, t in enumerate(["Good plain text here", "BUY now $$$ 100%", None, "", "x x x", "é À 12", "Good text", "buy buy"] * 3)]
    labels = [(k, k % 8 in (0, 6)) for k in range(20)] + [(0, 0), (3, None), (None, 1), (99, 1)]
    labels = [(i, None if q is None else int(q)) for i, q in labels]
    weights = ftrl_quality.train(spark.createDataFrame(docs, "doc_id long, text string"),
                                 spark.createDataFrame(labels, "doc_id long, quality int"), sample=9, shards=2, epochs=2)
    out = {r["doc_id"]: r["score"] for r in ftrl_quality.score(spark.createDataFrame(docs, "doc_id long, text string"), weights).collect()}
    for (i, _), score in zip(docs, plain_quality(docs, labels, 9, 2, 2), strict=True):
        assert math.isclose(out[i], score, abs_tol=1e-6)


# ------------------------------------------------------------------ op6

def grams(text):
    """Counts of the byte 2- and 3-grams of the words with a blank at each edge."""
    out = Counter()
    for word, times in Counter(WORD.findall((text or "").lower())).items():
        b = b" " + word.encode() + b" "
        for k in range(len(b) - 1):
            out[b[k] << 8 | b[k + 1]] += times
        for k in range(len(b) - 2):
            out[(1 << 16) + (mix((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) + 1) >> 20) % (1 << 17)] += times
    return out


def plain_machine(rows):
    """AdaGrad on the hinge loss over (grams, +-1) rows; weights and bias."""
    rows = [({f: 30 * c / sum(x.values()) for f, c in x.items()}, y) for x, y in rows if x]
    up = sum(y > 0 for _, y in rows)
    share = {1: len(rows) / (2 * max(up, 1)), -1: len(rows) / (2 * max(len(rows) - up, 1))}
    w, g, bias, gb = defaultdict(float), defaultdict(lambda: 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(5)
    for _ in range(4):
        for k in rng.permutation(len(rows)):
            x, y = rows[k]
            if y * (sum(w[f] * v for f, v in x.items()) + bias) < 1:
                step = share[y] * y
                for f, v in x.items():
                    g[f] += (step * v) ** 2
                    w[f] += 0.2 * step * v / math.sqrt(g[f])
                gb += step * step
                bias += 0.05 * step / math.sqrt(gb)
    return {f: float(np.float32(v)) for f, v in w.items()}, bias


def plain_language(docs, per_language):
    """(language, score) of (doc_id, text, lang) rows, in their order."""
    learn = [(i, t, x) for i, t, x in docs if not held_out(i) and t is not None and x is not None]
    size = Counter(x for _, _, x in learn)
    marked = sorted(((spark_hash(i, "sample") % (1 << 30), t, x) for i, t, x in learn), key=lambda r: r[0])
    sample = [(grams(t), x) for m, t, x in marked if m / (1 << 30) < min(1.0, per_language / size[x])]
    langs = sorted(size)
    family = {x: langid.family_of(x) for x in langs}
    one_rest = {f: plain_machine([(g, 1 if family[x] == f else -1) for g, x in sample]) for f in sorted(set(family.values()))}
    duel = {(a, b): plain_machine([(g, 1 if x == a else -1) for g, x in sample if x in (a, b)])
            for a, b in itertools.combinations(langs, 2) if family[a] == family[b]}
    out = []
    for _, t, _ in docs:
        x = grams(t)
        if not langs or not regex.search(r"\p{L}", t or ""):
            out.append(("und", 0.0))
            continue

        def margin(machine):
            return 30 * sum(c * machine[0].get(f, 0.0) for f, c in x.items()) / sum(x.values()) + machine[1]
        sure = {f: margin(m) for f, m in one_rest.items()}
        top = max(sure, key=sure.get)
        share = 1 / sum(math.exp(2 * (v - sure[top])) for v in sure.values())
        won, weakest = Counter(), defaultdict(lambda: 1.0)
        for (a, b), m in duel.items():
            if family[a] == top:
                v = margin(m)
                for lang, side in ((a, v), (b, -v)):
                    won[lang] += (side > 0 or (side == 0 and lang == b)) + 1e-3 * math.tanh(side)
                    weakest[lang] = min(weakest[lang], sigmoid(2 * side))
        best = max([y for y in langs if family[y] == top], key=lambda y: won[y])
        out.append((best, share * weakest[best]))
    return out


def check_language(docs, out, per_language=600):
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in out)
    want = plain_language(docs, per_language)
    assert got == Counter((i, held_out(i), lang, round(score, 6)) for (i, _, _), (lang, score) in zip(docs, want, strict=True))


def test_language_equals_plain_training(spark, table):
    docs = list(table("sf0.001", "documents")[["doc_id", "text", "lang"]].itertuples(index=False, name=None))
    check_language(docs, QUERIES["op6_language_id"](spark, SF).collect())


def test_language_sample_and_odd_rows(spark, table, repeated_docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in repeated_docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    check_language(rows, langid.language_id(df).collect())
    docs = [(i, t, x) for i, t, x in table("sf0.001", "documents")[["doc_id", "text", "lang"]].itertuples(index=False, name=None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    check_language(docs, langid.language_id(df, per_language=7).collect(), 7)


def test_language_does_not_depend_on_the_batch(spark):
    """The last word of a batch has both its edges."""
    docs = [(k, t, x) for k, (t, x) in enumerate([("the house", "en"), ("das haus", "de"), ("la maison", "fr"), ("la casa", "es")] * 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    answers = [sorted((r["doc_id"], r["lang_pred"], round(r["score"], 12)) for r in langid.language_id(d).collect())
               for d in (df.coalesce(1), df.repartition(24, "doc_id"))]
    assert answers[0] == answers[1]


# ------------------------------------------------------------------ op2

def typed(text, name_start=False, names=None):
    """(template token, value or None) per word."""
    found = WORD.findall(text or "")
    out, opens = [], True
    for k, word in enumerate(found):
        core = word.lower().strip(template_decontam._EDGE) or word.lower()
        kind = "word"
        if core in template_decontam.UNITS:
            kind = "unit"
        if core in template_decontam.NUMBER_WORDS or re.search(template_decontam.NUMBER, core) or re.search(template_decontam.QUANTITY, core):
            kind = "num"
        capital = kind == "word" and regex.search(r"^[(\[\"'`]*\p{Lu}[\p{Ll}'-]", word) is not None
        if capital and (not opens or (k == 0 and name_start)):
            kind = "name"
        if names is not None and kind == "word" and hashed(core.encode()) >> 42 in names:
            kind = "name"
        out.append([kind, core, capital])
        opens = re.search(r"[.!?][)\]\"'`]*$", word) is not None
    if names is not None:
        here = {core for kind, core, _ in out if kind == "name"}
        out = [["name" if kind == "word" and capital and core in here else kind, core, capital] for kind, core, capital in out]
    return [(core, None) if kind == "word" else (f"<{kind}>", core) for kind, core, _ in out]


def windowed(tokens, length):
    """position -> (template, slot values) of the counting windows."""
    out = {}
    for p in range(len(tokens) - length + 1):
        part = tokens[p:p + length]
        slots = tuple(v for _, v in part if v is not None)
        if length - len(slots) >= min(2, length):
            out[p] = (tuple((t, v is not None) for t, v in part), slots)
    return out


def plain_leaks(docs, items, window=5, similarity=0.8):
    """(doc_id, item_id, matched, of, same values) of (id, text) rows."""
    names = {hashed(v.encode()) >> 42 for _, t in items for tok, v in typed(t) if tok == "<name>"}
    table, size = defaultdict(list), {}
    for k, (_, text) in enumerate(items):
        plain, more = typed(text), typed(text, names=names)
        n = len(plain)
        length = min(window, n)
        if not n:
            continue
        base = windowed(plain, length)
        forms = [("typed", p, w) for p, w in base.items()]
        forms += [("more", p, w) for p, w in windowed(more, length).items() if more[p:p + length] != plain[p:p + length]]
        for other, start, form in ((plain, typed(text, True), "typed"), (more, typed(text, True, names), "more")):
            if start[0] != other[0]:
                forms += [(form, p, w) for p, w in windowed(start, length).items() if p == 0]
        for form, p, w in forms:
            table[length, form == "plain", w[0]].append((k, p, form, w[1]))
        for p in base:
            bare = tuple(c if v is None else v for c, v in plain[p:p + length])
            table[length, True, bare].append((k, p, "plain", base[p][1]))
        size[k] = len({p for _, p, _ in forms})
    out = []
    for i, text in docs:
        plain, more = typed(text), typed(text, names=names)
        lines = defaultdict(lambda: (set(), set()))
        for length in range(1, window + 1):
            if length < window and length < similarity * len(plain):
                continue
            hits = [("typed", p, False, *w) for p, w in windowed(plain, length).items()]
            hits += [("more", p, False, *w) for p, w in windowed(more, length).items() if more[p:p + length] != plain[p:p + length]]
            hits += [("plain", p, True, tuple(c if v is None else v for c, v in plain[p:p + length]), None)
                     for p in range(len(plain) - length + 1)]
            for form, p, bare, key, slots in hits:
                for k, at, item_form, item_slots in table.get((length, bare, key), ()):
                    values = item_slots if slots is None else slots
                    for judged in (0, 1) if form == item_form == "typed" else (1,):
                        places, pairs = lines[k, p - at, judged]
                        places.add(at)
                        pairs.update(zip(item_slots, values, strict=True))
        found = defaultdict(lambda: [set(), True])
        for (k, _, _), (places, pairs) in lines.items():
            if len({a for a, _ in pairs}) == len(pairs):
                found[k][0] |= places
                found[k][1] &= all(a == b for a, b in pairs)
        out += [(i, items[k][0], len(places), size[k], same) for k, (places, same) in found.items() if len(places) >= similarity * size[k]]
    return Counter(out)


def check_leaks(docs, items, out):
    assert Counter((r["doc_id"], r["item_id"], r["matched_windows"], r["item_windows"], r["same_values"]) for r in out) == plain_leaks(docs, items)


def test_leaks_equal_plain_method(spark, table):
    docs, items = (list(table("sf0.01", n)[[c, "text"]].itertuples(index=False, name=None)) for n, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    out = QUERIES["op2_template_decontam"](spark, "/root/testdata/sf0.01").collect()
    assert out
    check_leaks(docs, items, out)


def test_leaks_of_changed_items(spark, table):
    """Items with words, numbers, names and cases exchanged, put into other texts, cut short and doubled."""
    rng = np.random.default_rng(6)
    items = list(table("sf0.01", "benchmark")[["item_id", "text"]].itertuples(index=False, name=None))[:25]
    items += [(900, brute.ITEM), (901, brute.CLIPS), (902, brute.RIVER), (903, "yes"), (904, "two plain words"), (905, None), (906, ""), (907, "5 6 7 8 9 10")]
    docs = [(None, brute.ITEM), (-1, None), (-2, ""), (-3, "yes")]
    for k in range(400):
        words = (items[rng.integers(len(items))][1] or "").split()
        for _ in range(rng.integers(5)):
            if words:
                words[rng.integers(len(words))] = rng.choice(["Zoe", "Paris", "17", "3", "km", "river", "What", "so."])
        text = " ".join(words[rng.integers(3):])
        text = (text, text.lower(), text.title(), f"it was said {text} by them", f"{text} {text}")[rng.integers(5)]
        docs.append((k, text))
    out = template_decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({r["doc_id"] for r in out}) > 50
    check_leaks(docs, items, out)


# ------------------------------------------------------------------ pipeline

def plain_cut(rows, length=100):
    """Texts of (doc_id, text) rows without the bytes of repeated strings."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                cover[s:s + length] = b"\1" * length
            seen.add(b[s:s + length])
        out[i] = bytes(x for x, c in zip(b, cover, strict=True) if not c).decode("utf-8", "ignore")
    return out


def test_pipeline_equals_plain_stages(spark, table, write_docs):
    """All five stages on sf0.001 with planted copies, passages and items; the
    texts of each stage are what the next one gets. Extra columns have the names the stages use."""
    docs = list(table("sf0.001", "documents")[["doc_id", "text", "lang"]].itertuples(index=False, name=None))
    items = list(table("sf0.001", "benchmark")[["item_id", "text"]].itertuples(index=False, name=None))
    top = max(i for i, _, _ in docs)
    passage = " ".join(docs[3][1].split()[:60]) + " é" * 30
    extra = [docs[0][1], docs[1][1] + " tail", "start of it " + passage, passage + " and its end", "one more é" + passage,
             "they asked " + items[0][1] + " and left", items[1][1].lower(), None, "", "12 34 !!", "<|endoftext|> " + docs[2][1][:500]]
    docs += [(top + 1 + k, t, "en" if k % 2 else None) for k, t in enumerate(extra)]
    odd = ["_sd_places", "_sd_doc", "_SD_TIE", "_own_mark", "_kept_mark", "_leak_id", "_leak_mark", "row", "mark", "fp"]
    df = spark.createDataFrame([(i, t, x, "s", None if t is None else len(t), *(f"{c}{i}" for c in odd)) for i, t, x in docs],
                               "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in odd))
    sf = write_docs(documents=df, benchmark=spark.createDataFrame(items, "item_id long, text string"))

    want = [r[:2] for r, (lang, score) in zip(docs, plain_language(docs, 600), strict=True)
            if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert len(want) < len(docs)
    steps = [dict(want)]
    fps = [brute.fingerprint(t) for _, t in want]
    comp = brute.components(len(want), [(a, b) for a in range(len(want)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    want = [r for k, r in enumerate(want) if comp[k] == k]
    steps.append(dict(want))
    steps.append(plain_cut(want))
    leaked = {r[0] for r in plain_leaks(list(steps[2].items()), items)}
    steps.append({i: t for i, t in steps[2].items() if i not in leaked})
    assert all(len(set(a.items()) - set(b.items())) for a, b in itertools.pairwise(steps))

    now = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), step in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        now = corpus_pipeline.materialise(stage(spark, now, sf), name)
        rows = now.collect()
        assert now.columns == df.columns, name
        assert {r["doc_id"]: r["text"] for r in rows} == step and len(rows) == len(step), name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in odd) and all(r["n_chars"] == len(r["text"]) for r in rows)
    brute.check_pieces(list(steps[-1].items()), corpus_pipeline.run(spark, sf).collect())


def test_schema_of_the_pipeline_result(spark, write_docs, empty_docs):
    sf = write_docs(documents=empty_docs, benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).select(F.count("*")).first()[0] == 0
