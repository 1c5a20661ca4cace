"""Text operators against brute force, on whole sf0.001 and on edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vitrine.llm import ftrl_quality, langid, packing, simhash_cover, suffix_dedup, suffix_tree_lm, template_decontam
from vitrine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ op1

def check_lm(rows, out):
    count, train = Counter(), 0
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            w = (t or "").encode().lower().split()
            count.update(w)
            count[b""] += 1
            train += len(w) + 1
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((count[x] + 1) / (train + len(count) + 1)) for x in w)
        known = sum(count[x] > 0 for x in w)
        assert any(r["n_tokens"] == len(w) and r["n_known"] == known and r["train_tokens"] == train
                   and math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
                   and r["score"] <= 1e-9 for r in got[i])


def test_suffix_tree_counts_and_base(spark, table):
    rows = table("sf0.001", "documents")[["doc_id", "text"]].itertuples(index=False, name=None)
    out = QUERIES["op1_suffix_tree_lm"](spark, SF).collect()
    check_lm(list(rows), out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_suffix_tree_edge_rows(repeated_docs, empty_docs, write_docs, spark):
    q = QUERIES["op1_suffix_tree_lm"]
    check_lm(pairs(repeated_docs), q(spark, write_docs(documents=repeated_docs)).collect())
    assert q(spark, write_docs(documents=empty_docs)).count() == 0


def plain_tree(rows, depth, least, min_bits, discount=0.5):
    """Probability function (context, word) of the tree of (tokens, held) rows,
    by dictionaries of tuples; every sequence of the text is counted."""
    n = Counter(tuple(w[k:k + d]) for w, held in rows if not held for d in range(1, depth + 2) for k in range(len(w) - d + 1))
    words = {g[0]: c for g, c in n.items() if len(g) == 1}
    size = sum(words.values()) + len(words) + 1
    after = defaultdict(list)
    for g, c in n.items():
        if len(g) > 1 and c >= least:
            after[g[:-1]].append(g[-1])
    root = lambda w: (words.get(w, 0) + 1) / size
    states = set()
    for s, following in after.items():
        p = [n[(*s, w)] / n[s] for w in following]
        q = [root(w) if len(s) == 1 else n[(*s[1:], w)] / n[s[1:]] for w in following]
        a, b = max(0, 1 - sum(p)), max(1e-12, 1 - sum(q))
        if sum(x * math.log2(x / y) for x, y in zip(p, q, strict=True)) + (a * math.log2(a / b) if a > 1e-15 else 0) >= min_bits:
            states.add(s)

    def prob(s, w):
        if not s:
            return root(w)
        if s not in states:
            return prob(s[1:], w)
        c = n.get((*s, w), 0)
        left = 1 - sum(n[(*s, x)] - discount for x in after[s]) / n[s]
        return (c - discount if c >= least else 0) / n[s] + left * prob(s[1:], w)

    return prob, states, words


def plain_tree_scores(rows, depth, least, min_bits):
    prob, _, _ = plain_tree(rows, depth, least, min_bits)
    return [sum(math.log10(prob(tuple(w[max(0, k - depth):k]), w[k])) for k in range(len(w))) for w, _ in rows]


def check_tree(spark, rows, depth, least=2, min_bits=0.01, **options):
    """Scores of (doc_id, text, held) rows against the plain tree."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    out = {r["doc_id"]: r for r in suffix_tree_lm.score_texts(docs, depth, least, min_bits, **options).collect()}
    want = plain_tree_scores([([*t.lower().split(), ""], held) for _, t, held in rows], depth, least, min_bits)
    for (i, _, _), score in zip(rows, want, strict=True):
        assert math.isclose(out[i]["score"], score, rel_tol=1e-9, abs_tol=1e-9)
    return out


def test_suffix_tree_states_are_distributions():
    """The probabilities of all words after any context, an unknown one
    included, add up to one."""
    rng = random.Random(3)
    text, last = [], "a"
    for _ in range(4000):
        last = rng.choices("abcd", [8 if w == {"a": "b", "b": "c", "c": "a", "d": "d"}[last] else 1 for w in "abcd"])[0]
        text.append(last)
    prob, states, words = plain_tree([([*text, ""], False)], 4, 2, 0.01)
    assert {len(s) for s in states} == {1, 2, 3, 4}
    for s in [*states, ("a",), ("x", "b"), ()]:
        assert math.isclose(sum(prob(s, w) for w in [*words, "unseen"]), 1, rel_tol=1e-9)


def near_copies(rng, n):
    """Texts that share passages of any length, with words exchanged."""
    passage = [f"p{rng.randrange(60)}" for _ in range(60)]
    out = []
    for _ in range(n):
        w = passage[rng.randrange(30):][:rng.randrange(5, 40)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(8)}"
        out.append(" ".join([*w, *(f"w{min(int(rng.expovariate(0.1)), 50)}" for _ in range(rng.randrange(30)))]))
    return out


@pytest.mark.parametrize("depth,least,min_bits", [(1, 2, 0.01), (4, 2, 0.01), (6, 2, 0.2), (5, 3, 1e-9)])
def test_suffix_tree_equals_plain_tree(spark, depth, least, min_bits):
    texts = near_copies(random.Random(depth), 150)
    check_tree(spark, [(i, t, i % 7 == 2) for i, t in enumerate(texts)], depth, least, min_bits, block_bytes=2000, bucket_bytes=3000)


def test_suffix_tree_stops_when_no_sequence_is_left(spark):
    """A depth beyond any repeated sequence costs no further rounds and changes nothing."""
    texts = near_copies(random.Random(1), 25)
    out = check_tree(spark, [(i, t, False) for i, t in enumerate(texts)], 30)
    assert len(out) == 25


def test_suffix_tree_without_training_rows(spark):
    out = check_tree(spark, [(1, "a b", True), (2, "", True)], 3)
    assert {r["score"] for r in out.values()} == {0} and {r["train_tokens"] for r in out.values()} == {0}


def test_suffix_tree_keeps_rare_contexts(spark):
    """Sequences seen twice are states at any corpus size (here over 200,000 tokens)."""
    rng = random.Random(5)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.004)), 3000)}" for _ in range(250)) for _ in range(1000)]
    texts += ["rare0 rare1 rare2", "rare0 rare1 rare2", "Rare0 rare1 rare2"]
    rows = [(i, t, i % 7 == 2) for i, t in enumerate(texts[:-1])] + [(len(texts) - 1, texts[-1], True)]
    out = check_tree(spark, rows, 3, block_bytes=100_000, bucket_bytes=300_000)
    assert out[0]["train_tokens"] > 200_000
    assert out[len(texts) - 1]["score"] > out[len(texts) - 1]["base_score"] + 5


# ------------------------------------------------------------------ op2

def test_leaks_equal_plain_search_on_copies(spark, table):
    docs, items = table("sf0.01", "documents"), table("sf0.01", "benchmark")
    plain = lambda x: " ".join(x.lower().split())
    texts = [(i, plain(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    want = {(i, it) for it, x in zip(items.item_id, items.text, strict=True) for i, t in texts if plain(x) in t}
    out = QUERIES["op2_template_decontam"](spark, "/root/testdata/sf0.01").collect()
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in out}
    assert all(r["coverage"] >= 0.8 for r in out)


ITEM = "If Anna buys 12 apples for 3 dollars and sells 12 pears for 5 dollars, how much does Anna earn in 7 days at the market?"


@pytest.mark.parametrize("text,found", [
    (ITEM, True),
    ("so I said " + ITEM + " and left", True),
    (ITEM.replace("12", "40").replace("3", "9").replace("Anna", "Zoe"), True),          # other numbers, other name
    (ITEM.replace("12 apples", "40 apples"), False),                                       # 12 would be 40 and 12
    ("Apples and pears are sold at the market for 3 dollars.", False),
    (" ".join(ITEM.split()[:9]), False), ("", False), (None, False)])
def test_templates(spark, text, found):
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "5 6 7 8 9")], "item_id long, text string")
    out = template_decontam.leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in out] == ([(7, 1)] if found else [])


def test_leaks_empty_and_short(spark, docs, empty_docs):
    items = spark.createDataFrame([(1, "some words"), (2, "alpha beta gamma")], "item_id long, text string")
    out = template_decontam.leaks(docs, items).select("doc_id", "item_id").collect()
    assert [(r[0], r[1]) for r in out] == [(6, 1)]
    assert template_decontam.leaks(empty_docs, items).count() == 0
    assert template_decontam.leaks(docs, items.limit(0)).count() == 0
    assert template_decontam.clean_documents(docs, items).columns == docs.columns
    assert template_decontam.clean_documents(docs, items).count() == docs.count() - 1


def test_leaks_name_their_documents_in_any_plan(spark):
    """Grouped, shuffled and repeated documents, null ids."""
    filler = [" ".join(random.Random(k).choices("stone river lamp window garden table letter north".split(), k=30)) for k in range(60)]
    rows = [(i, f"{t} {ITEM if i % 9 == 0 else ''} {t}") for i, t in enumerate(filler)]
    rows += [(None, ITEM), (None, "other"), (3, ITEM), (9, rows[9][1]), (9, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, filler[5])], "item_id long, text string")
    distinct = docs.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    for df, kept in ((docs, rows), (docs.repartition(13, "text"), rows), (distinct, list(set(rows)))):
        want = Counter((i, 1) for i, t in kept if ITEM in t) + Counter((i, 2) for i, t in kept if filler[5] in t)
        assert Counter((r["doc_id"], r["item_id"]) for r in template_decontam.leaks(df, items).collect()) == want
        left = [r["text"] for r in template_decontam.clean_documents(df, items).collect()]
        assert sorted(left) == sorted(t for _, t in kept if ITEM not in t and filler[5] not in t)


def test_shared_frame_is_not_multiplied(spark):
    """Items and documents that share a frame: only those with an item's own
    words are candidates."""
    frame = "please answer the following question about the old harbour town with one short sentence"
    own = [f"why did keeper{k} of lamp{k} leave harbour{k} before winter{k} came" for k in range(40)]
    items = spark.createDataFrame([(k, f"{frame} {q}") for k, q in enumerate(own)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{frame} {own[k]}" if k < 20 else f"{frame} and tell no more about {k}") for k in range(300)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in template_decontam.leaks(docs, items).collect()}
    assert got == {(k, k) for k in range(20)}


RIVER = "What river flows through Paris and Rouen before it reaches the Channel near Le Havre?"
CLIPS = ("Natalia sold clips to 48 of her friends in April. Then she met Weng. Natalia sold half as many clips in May. "
         "How many clips did Natalia sell altogether in April and May?")


@pytest.mark.parametrize("item,text,found", [
    (RIVER, RIVER.lower(), True), (RIVER, RIVER.title(), True), (RIVER.lower(), RIVER, True),
    (RIVER, "it was asked: " + RIVER.lower() + " nobody knew", True),
    (CLIPS, CLIPS.replace("Natalia", "Sofia").replace("48", "52"), True),
    (CLIPS, CLIPS.lower().replace("48", "52"), True),
    (RIVER, "what river flows past the town before it reaches the sea?", False)])
def test_names_in_any_case_and_place(spark, item, text, found):
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = template_decontam.leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in out] == ([(7, 1)] if found else [])


def test_short_items_need_the_whole_document(spark):
    docs = spark.createDataFrame([(1, "yes"), (2, "well yes it is so"), (3, "some plain short words indeed"),
                                  (4, "he wrote some plain short words on the wall")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "some plain short words")], "item_id long, text string")
    out = template_decontam.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(1, 1), (3, 2)]
    assert sorted(r["doc_id"] for r in template_decontam.clean_documents(docs, items).collect()) == [2, 4]


# ------------------------------------------------------------------ op3

def check_pieces(rows, out):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for at in range(0, len(ids), 2048):
            p = ids[at:at + 2048]
            want[i, at, len(p), zlib.crc32(p.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    windows = defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(windows)


def test_special_tokens_of_the_vocabulary(spark):
    e = "<|endoftext|>"
    texts = ["a <|endoftext|> b", e, e + e, f"x  {e}  y", f"x\n {e}\n\n y", "<|endof text|>", "<|endof", "text|>", f"é{e}é", f" {e} ", f"{e[:-1]} {e}{e[1:]}",
             f"w {e}" * 900]
    rows = list(enumerate(texts))
    check_pieces(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
                 .withColumn("ids_crc32", F.crc32("ids")).collect())
    ids, size = packing.encode([texts[0].encode()], *packing.default_vocabulary())
    assert ids.tolist() == [64, 220, 50256, 275] and size.tolist() == [4]


def test_packing_round_trip(spark, table, repeated_docs, empty_docs, write_docs):
    out = QUERIES["op3_packing"](spark, SF).collect()
    n = check_pieces(list(table("sf0.001", "documents")[["doc_id", "text"]].itertuples(index=False, name=None)), out)
    assert sum(r["length"] for r in out) / (2048 * n) > 0.97
    check_pieces(pairs(repeated_docs), QUERIES["op3_packing"](spark, write_docs(documents=repeated_docs)).collect())
    assert QUERIES["op3_packing"](spark, write_docs(documents=empty_docs)).count() == 0


def test_pieces_keep_the_ids_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(rng.choices(["a", "the", " ", "  ", "\n", "\u00a0", "é", "'s", "12", "!", "\t", "\x1c", "\u3000", "<|endoftext|>"], k=60))
             for _ in range(400)]
    ids, size = packing.encode([t.encode() for t in texts], *packing.default_vocabulary())
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w]
    assert size.tolist() == [len(w) for w in want]


def test_segment_tree_finds_the_tightest_window():
    rng, tree, rooms = random.Random(2), packing.Windows(64), {}
    for length in [rng.randint(1, 64) for _ in range(3000)]:
        fits = [r for r in rooms.values() if r >= length]
        number, offset = tree.place(length)
        room = rooms.get(number, 64)
        assert 64 - offset == room and room == (min(fits) if fits else 64)
        rooms[number] = room - length


# ------------------------------------------------------------------ op4, op6

def test_quality_held_out(spark, table):
    labels = table("sf0.01", "labels").set_index("doc_id").quality
    out = QUERIES["op4_ftrl_quality"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels.index]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_quality_edge_rows(spark, repeated_docs, empty_docs, write_docs):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 0), (99, 1, 0), (8, 1, 1), (8, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    q = QUERIES["op4_ftrl_quality"]
    out = q(spark, write_docs(documents=repeated_docs, labels=labels)).collect()
    assert len(out) == repeated_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in q(spark, write_docs(documents=repeated_docs, labels=labels.limit(0))).collect()} == {0.5}
    assert q(spark, write_docs(documents=empty_docs, labels=labels)).count() == 0


def test_ftrl_learns_a_line():
    m, rng = ftrl_quality.Ftrl(), random.Random(1)
    for _ in range(400):
        y = rng.random() < 0.5
        m.update(np.array([1 if y else 2, 9]), np.array([1.0, 1.0]), float(y))
    assert m.weights()[1] > 0.5 > -0.5 > m.weights()[2] and m.weights()[3] == 0


def test_language_held_out(spark, table):
    lang = table("sf0.01", "documents").set_index("doc_id").lang
    out = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 1000 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_edge_rows(spark, repeated_docs, empty_docs, write_docs):
    q = QUERIES["op6_language_id"]
    out = q(spark, write_docs(documents=repeated_docs)).collect()
    none = [t for t in pairs(repeated_docs) if not t[1] or not any(c.isalpha() for c in t[1])]
    assert len(out) == repeated_docs.count()
    assert sorted(str(r["doc_id"]) for r in out if r["lang_pred"] == "und") == sorted(str(i) for i, _ in none)
    assert all(0 <= r["score"] <= 1 for r in out) and {r["lang_pred"] for r in out} <= {"und", "en", "fr"}
    assert q(spark, write_docs(documents=empty_docs)).count() == 0
    unknown = repeated_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in q(spark, write_docs(documents=unknown)).collect()} == {"und"}


def test_language_score_does_not_shrink_with_sisters():
    langs = ["en", "es", "fr", "it", "pt"]
    pairs = [(a, b) for k, a in enumerate(langs[1:]) for b in langs[k + 2:]]
    model = {"langs": langs, "families": ["germanic", "romance"], "pairs": pairs}
    margin = {"family:germanic": np.array([-1.0]), "family:romance": np.array([1.0])}
    margin |= {f"pair:{a}:{b}": np.array([0.1 if a == "es" else 0.05]) for a, b in pairs}   # es wins three narrow duels
    answer, score = langid.decide(model, margin, 1)
    duel = 1 / (1 + math.exp(-0.2))
    assert langs[answer[0]] == "es" and score[0] > 0.3
    assert math.isclose(score[0], duel / (1 + math.exp(-4)), rel_tol=1e-9)


def test_word_grams_stay_inside_words():
    owner, feature = langid.word_grams(pa.array(["ab", "c"]))
    two = sorted((o, f) for o, f in zip(owner.tolist(), feature.tolist(), strict=True) if f < 1 << 16)
    pair = lambda a, b: ord(a) << 8 | ord(b)
    assert [t for t in two if t[0] == 0] == sorted([(0, pair(" ", "a")), (0, pair("a", "b")), (0, pair("b", " "))])
    assert sum(o == 0 and f >= 1 << 16 for o, f in zip(owner, feature, strict=True)) == 2      # " ab", "ab "


# ------------------------------------------------------------------ op7

def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def check_simhash(rows, out):
    fps = [fingerprint(t) for _, t in rows]
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    comp = components(len(fps), linked)
    low = {c: min((i for (i, _), d in zip(rows, comp, strict=True) if d == c and i is not None), default=None) for c in comp}
    want = Counter((i, f"{fp:016x}", low[c]) for (i, _), fp, c in zip(rows, fps, comp, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == want


def test_simhash_equals_brute_force(spark, table, repeated_docs, empty_docs, write_docs):
    q = QUERIES["op7_simhash_cover"]
    check_simhash(list(table("sf0.001", "documents")[["doc_id", "text"]].itertuples(index=False, name=None)), q(spark, SF).collect())
    check_simhash(pairs(repeated_docs), q(spark, write_docs(documents=repeated_docs)).collect())
    assert q(spark, write_docs(documents=empty_docs)).count() == 0


@pytest.mark.parametrize("distance,tile", [(3, 1024), (3, 4), (1, 8), (5, 16)])
def test_cover_finds_all_links(spark, distance, tile):
    rng = random.Random(distance * 100 + tile)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fp = centre
            for b in rng.sample(range(64), rng.randint(0, distance)):
                fp ^= 1 << b
            fps.append(fp)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    got = simhash_cover.links(df, distance, tile).collect()
    at = {int(np.uint64(x).view(np.int64)): k for k, x in enumerate(fps)}
    assert all((fps[at[r["a"]]] ^ fps[at[r["b"]]]).bit_count() <= 99 for r in got)
    want = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= distance])
    assert components(len(fps), [(at[r["a"]], at[r["b"]]) for r in got]) == want


# ------------------------------------------------------------------ op8

def check_cut(rows, out, length=100):
    seen, want = {}, Counter()
    distinct = sorted({((i is not None, i or 0), t or "") for i, t in rows}, key=lambda x: (x[0], np.int64(0)))
    by_id = defaultdict(list)
    for k, t in distinct:
        by_id[k].append(t)
    ordered = [(k, t) for k in sorted(by_id) for t in sorted(by_id[k], key=_order)]
    cut = {}
    for k, t in ordered:
        b = t.encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                cover[s:s + length] = b"\1" * length
            else:
                seen[w] = k
        spans = sum(1 for x in range(len(cover)) if cover[x] and (x == 0 or not cover[x - 1]))
        cut[k, t] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    for i, t in rows:
        want[(i, *cut[(i is not None, i or 0), t or ""])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == want


def _order(text):
    return np.uint64(xxhash.xxh64(text.encode(), seed=42).intdigest()).view(np.int64)


def test_suffix_dedup_equals_brute_force(spark, table, docs, repeated_docs, empty_docs, write_docs):
    q = QUERIES["op8_suffix_dedup"]
    check_cut(list(table("sf0.001", "documents")[["doc_id", "text"]].itertuples(index=False, name=None)), q(spark, SF).collect())
    check_cut(pairs(docs), q(spark, write_docs(documents=docs)).collect())
    check_cut(pairs(repeated_docs), q(spark, write_docs(documents=repeated_docs)).collect())
    assert q(spark, write_docs(documents=empty_docs)).count() == 0


def test_suffix_dedup_across_chunks(spark):
    """A common line in many surroundings: chunks of three classes meet by digest."""
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefgh ", k=130))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 200))) + line[rng.randint(0, 20):] + "".join(rng.choices("xyz", k=90)))
            for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (3, 4096):
        out = suffix_dedup.dedup(df, chunk=chunk).withColumn("kept_sha256", F.sha2("kept", 256)).collect()
        check_cut(rows, out)


def test_suffix_order_two_stage():
    rng = random.Random(5)
    for n, letters in ((1, "a"), (200, "ab"), (500, "a"), (800, "abcz\x00")):
        text = "".join(rng.choices(letters, k=n)).encode()
        order = suffix_dedup.suffix_order(np.frombuffer(text, dtype=np.uint8), 1024).tolist()
        assert sorted(order) == list(range(n))
        key = [text[i:] + b"\x00" * (1100 - n + i) for i in order]
        assert key == sorted(key)


def test_cut_documents_keeps_columns(spark, docs, repeated_docs):
    for df in (docs, repeated_docs):
        out = suffix_dedup.cut_documents(df)
        assert out.columns == df.columns and out.count() == df.count()
        assert all((r["text"] is None) or r["n_chars"] == len(r["text"]) for r in out.collect())
