"""Byte-level BPE against the public library, ranked search and source divergence against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tidings.llm import byte_bpe, ranked_search, source_divergence

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(VOCABULARY)
PUBLIC = tiktoken.Encoding("public", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


# --- byte-level BPE ---

@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab ers tion'é\n", max_size=60)))
def test_words_are_merged_like_the_public_library(text):
    for word in re.findall(r"\S+|\s+", text):
        assert byte_bpe.encode_word(word.encode(), RANKS) == PUBLIC._core_bpe.encode_single_piece(word.encode())


EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@pytest.mark.parametrize("kind", [r"\p{L}", r"\p{N}", r"\s"])
def test_classes_hold_the_code_points_of_the_public_library(kind):
    one = tiktoken.Encoding("one", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    assert "".join(byte_bpe.splitter(kind)(EVERY)) == one.decode(one.encode_ordinary(EVERY))


def test_the_pattern_splits_every_code_point_like_the_public_library():
    split = byte_bpe.splitter(P.PATTERN)
    for start in range(0, len(EVERY), 4096):
        text = "".join(f"a{c}{c} b 1{c}2 !{c}?  {c}" for c in EVERY[start:start + 4096])
        assert [i for w in split(text) for i in PUBLIC._core_bpe.encode_single_piece(w.encode())] == PUBLIC.encode_ordinary(text)


def test_long_words():
    for word in (b"a" * 20_000, b"ab" * 9_999 + b"a", bytes(range(256)) * 20, bytes(random.Random(4).choices(b"etaoin", k=20_000))):
        assert byte_bpe.encode_word(word, RANKS) == PUBLIC._core_bpe.encode_single_piece(word)


@given(st.lists(st.integers(0, 30), max_size=80), st.integers(0, 80))
def test_positions_are_packed_and_unpacked(words, cut):
    number = {}
    numbers = np.array([number.setdefault(w, len(number)) for w in words], np.uint32)
    known = len(set(words[:cut]))
    parts = [(numbers[:cut], 0), (numbers[cut:], known)]
    assert [byte_bpe.unpack(byte_bpe.pack(x, k), len(x), k).tolist() for x, k in parts] == [x.tolist() for x, _ in parts]


TEXTS = ["Hello world, it's   a test!\n\n  Ünïcode naïve 漢字かな 🙂🙂 \t x", None, "", " ", "\n", "<|endoftext|> is text", "a" * 5_000, "don't DON'T 'll",
         "Hello world, it's   a test!\n\n  Ünïcode naïve 漢字かな 🙂🙂 \t x", "   wide  blanks　", "1234567890 12", "\x00\x1c\x85 control"]


@pytest.mark.parametrize("block_bytes,piece", [(1, 1), (20_000, 30), (1 << 20, 1), (1 << 20, 1 << 20)])
def test_encode_and_decode(spark, block_bytes, piece):
    texts = TEXTS * 30
    docs = spark.createDataFrame([(k, t, "x", [k], 7) for k, t in enumerate(texts)], "doc_id long, text string, ids string, block array<long>, seq int").repartition(2)
    coded = byte_bpe.encode(docs, VOCABULARY, P.PATTERN, block_bytes=block_bytes, piece=piece)
    assert coded.columns == ["doc_id", "block", "seq", "ids"]
    rows = {r.doc_id: r for r in byte_bpe.decode(coded, VOCABULARY, out="seq").collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert rows[k].ids == PUBLIC.encode_ordinary(t or "") and rows[k].block == [k]
        assert bytes(rows[k].seq) == (t or "").encode()


def test_bpe_empty_tables_nulls_and_unknown_ids(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(none, VOCABULARY, P.PATTERN), VOCABULARY).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.ids for r in byte_bpe.encode(blank, VOCABULARY, P.PATTERN).collect()] == [[], []]
    ids = spark.createDataFrame([(1, None), (2, []), (3, [RANKS[b"a"]])], "doc_id long, ids array<int>").coalesce(1)
    assert [r.bytes if r.bytes is None else bytes(r.bytes) for r in byte_bpe.decode(ids, VOCABULARY).orderBy("doc_id").collect()] == [None, b"", b"a"]
    with pytest.raises(Exception, match="not in the vocabulary|out of bounds"):
        byte_bpe.decode(spark.createDataFrame([([10 ** 6],)], "ids array<int>"), VOCABULARY).collect()
    broken = tmp_path / "broken"
    broken.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(broken))


def test_each_distinct_word_is_encoded_once(spark):
    docs = spark.createDataFrame([(k, f"same words {k % 3}") for k in range(600)], "doc_id long, text string").repartition(2)
    words = byte_bpe._blocks(docs, "text", P.PATTERN, 50, 10).where("words IS NOT NULL").selectExpr("block", "posexplode(words) AS (place, word)")
    assert words.groupBy("block", "word").count().where("count > 1").count() == 0 and words.select("block").distinct().count() >= 8
    calls = spark.sparkContext.accumulator(0)

    class Ranks(dict):
        def get(self, word):
            calls.add(1)
            return 7
    byte_bpe._word_ids(words.repartition("word").sortWithinPartitions("word"), SimpleNamespace(value=Ranks())).collect()
    assert calls.value == 5  # "same", " words", " 0", " 1", " 2"


def test_positions_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = byte_bpe.encode(docs, VOCABULARY, P.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan


def test_op11_against_the_public_library(spark):
    from conftest import SF001
    rows = {r.doc_id: r for r in byte_bpe.op11_byte_bpe(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = PUBLIC.encode_ordinary(d.text or "")
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _brute_search(docs, items, top):
    bags = [(k, Counter(TERM.findall(_lower(t)))) for k, t in docs]
    bags = [(k, b) for k, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(TERM.findall(_lower(t)))
    out = []
    for i, terms in queries.items():
        found = []
        for k, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 20 * m)) for w in terms & b.keys())
            if score > 0:
                found.append((-score, k is None, k or 0))
        out += [(i, r + 1, None if null else k, -s) for r, (s, null, k) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_pairs,top", [(1, 3), (6, 50), (200_000, 3), (200_000, 1)])
def test_search_against_brute_force(spark, slice_pairs, top):
    rnd = random.Random(slice_pairs + top)
    words = ["alpha", "Beta", "gamma", "Élan", "élan", "x1", "the", "rare"]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 8])))) for k in range(60)]
    docs += [(100 + k, "the alpha - BETA") for k in range(40)] + [(5, "the alpha beta"), (5, "rare"), (5, "rare"), (None, "rare"), (None, "rare rare"), (7, None), (8, "..."), (9, "the " * 3000)]
    items = [(1, "The alpha, the beta!"), (2, "Élan x1"), (3, None), (4, "..."), (1, "rare"), (None, "gamma rare"), (6, "unheard of")]
    d = spark.createDataFrame([(k, t, 0, "c") for k, t in docs], "doc_id long, text string, score int, terms string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.search(d, i, top=top, slice_pairs=slice_pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _brute_search(docs, items, top)


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a word")], "item_id long, text string")
    assert ranked_search.search(docs, items).collect() == [] and ranked_search.search(docs, some).collect() == []
    assert ranked_search.search(some.withColumnRenamed("item_id", "doc_id"), items).collect() == []


def test_scores_beyond_what_doubles_hold():
    postings = ranked_search.Postings([[0, 1, 2]], np.array([9_007_199_254, 9_007_199_253, 1], np.int64))
    got = postings.scores(np.zeros(3, np.int64), np.arange(3), np.full(3, 10 ** 9), np.full(3, 50))
    want = sum(w * ((10 ** 9 * 10 ** 9) // (1000 * 10 ** 9 + 1000)) for w in (9_007_199_254, 9_007_199_253, 1))
    assert got.tolist() == [[want]] and want > 2 ** 53


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), max_size=40), st.integers(1, 4))
def test_best_keeps_the_first_by_score_and_id(rows, top):
    best = ranked_search.Best(2, top)
    best.waiting = 10 ** 6  # shrink at each step
    for k, (a, b) in enumerate(rows):
        best.add(np.array([[a, b]]), np.array([100 - k]), np.array([k]))
        best.waiting = 10 ** 6
    got = sorted(zip(*(x.tolist() for x in best.shrink())))
    want = sorted((i, *x) for i in (0, 1) for x in [(s, f, k) for s, f, k in sorted(
        ((r[i], 100 - k, k) for k, r in enumerate(rows) if r[i] > 0), key=lambda x: (-x[0], x[1]))[:top]])
    assert got == want


# --- source divergence ---

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _brute_audit(docs, min_docs, top):
    rows = [(lang or "", source or "", LETTERS.findall(_lower(text))) for lang, source, text in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(w for _, _, ws in mine for w in set(ws))
        kept = sorted((w for w in df if df[w] >= min_docs), key=lambda w: w.encode())
        v = len(kept)
        total = Counter(w for _, _, ws in mine for w in ws if df[w] >= min_docs)
        counts = {s: Counter(w for _, t, ws in mine if t == s for w in ws if df[w] >= min_docs) for s in {r[1] for r in mine}}

        def p(count, w):
            return 1 + 10 ** 9 * (count[w] + 1) // (sum(count.values()) + v)

        def f(a, b):
            return (a - b) ** 2 // b
        for s, c in counts.items():
            pairs = [(sum(f(p(c, w), p(d, w)) for w in kept), o) for o, d in counts.items() if o != s]
            terms = [(f(p(c, w), p(total, w)), w) for w in kept if c[w] and p(c, w) > p(total, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i, x, r + 1) for r, (x, i) in enumerate(sorted(found, key=lambda y: (-y[0], y[1].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize("min_docs,top,gather", [(1, 200, 400_000), (3, 4, 400_000), (2, 1, 5), (3, 200, 5)])
def test_audit_against_brute_force(spark, monkeypatch, min_docs, top, gather):
    monkeypatch.setattr(source_divergence, "GATHER", gather)
    rnd = random.Random(min_docs * 10 + top)
    words = ["the", "The", "tree", "Élan", "é", "zebra", "x1y", "naïve", "ab", "cd", "ef", "gh", "漢字"]
    docs = [(rnd.choice(["en", "en", "de"]), rnd.choice(["s1", "s1", "s2", "s3", "z"]), " ".join(rnd.choices(words, k=rnd.choice([0, 2, 5, 40])))) for _ in range(80)]
    docs += [(None, None, None), ("", "s1", "alone"), (None, "s2", "alone"), ("fr", "s1", "once only"), ("en", "bare", "12 34"), ("en", "s1", "the " * 5000)]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs], "lang string, source string, text string, value int, term string").repartition(4)
    got = source_divergence.audit(frame, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == _brute_audit(docs, min_docs, top)


def test_audit_of_an_empty_table(spark):
    assert source_divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_probability_of_counts_beyond_64_bits(spark):
    count, total, v = 7 * 10 ** 17, 9 * 10 ** 17, 10 ** 12
    row = spark.createDataFrame([(count, total, v)], "c long, n long, v long").select(
        source_divergence.probability("c", "n", "v").alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (count + 1) // (total + v)
