from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001
from tidings.llm import mixing, quality_rules, sharding

GOOD = "one two three four five six seven eight nine ten eleven twelve"
DOCS = "doc_id long, text string, source string, n_words string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], DOCS)


# --- quality rules ---

def test_counts_of_one_text(spark):
    text = "a b c d e f\na b c d e f\n\n#x |y| <z>"
    r = quality_rules.document_features(_docs(spark, [(1, text, "s")])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (15, 20, 5, 1, 12)


def _brute_repeat(text):
    ws = text.split()
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


def test_repeat_words_against_brute_force(spark):
    texts = ["a b c d e " * 4, "a a a a a a", "a a a a a", "x y z " * 30 + "q", " ".join("abcde" + "fghij" + "abcde" + "k"), ""]
    rows = quality_rules.document_features(_docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).select("doc_id", "n_repeat_words").collect()
    assert {r[0]: r[1] for r in rows} == {i: _brute_repeat(t) for i, t in enumerate(texts)}


def test_hosts_nulls_ties_and_clashing_columns(spark):
    bad = [(i, "short", "bad") for i in range(50)]
    good = [(100 + i, GOOD, h) for i in range(60) for h in ("good", None)]
    odd = [(900, None, "good"), (901, "", None), (902, GOOD, "bad"), (902, GOOD, "bad"), (None, GOOD, "good")]
    rows = quality_rules.quality_rules(_docs(spark, bad + good + odd)).collect()
    kept = Counter((r.source, r.kept) for r in rows)
    assert len(rows) == 175 and kept[("bad", True)] == 0  # the host is rejected with its one good text
    assert kept[("good", True)] == 61 and kept[("good", False)] == 1 and kept[(None, True)] == 60
    assert {r.n_words for r in rows if r.source == "bad"} == {1, 12}


def test_small_hosts_are_shrunk_towards_the_corpus(spark):
    rows = [(i, GOOD, f"h{i % 40}") for i in range(400)] + [(1000 + i, "short", "large") for i in range(100)] + [(2000, "short", "tiny")]
    v = {r.host: r for r in quality_rules.host_verdicts(quality_rules.document_features(_docs(spark, rows))).collect()}
    assert v["large"].host_rejected and v["large"].rate_short < 1
    assert v["tiny"].rate_short < v["large"].rate_short


def test_empty_tables(spark):
    none = _docs(spark, [])
    assert quality_rules.quality_rules(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert sharding.shard(none).count() == 0


# --- mixing ---

def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        rest = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else left * w[s] / rest for s in names}
        over = {s for s in names if s not in capped and t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


def test_targets_against_brute_force(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (400, "b"), (300, "c"), (2, "d"), (90, None), (0, "e"), (50, "f")])]
    rows.append((99, None, "a"))
    got = {r.source: r for r in mixing.plan_mix(_docs(spark, rows)).collect()}
    want = _targets({"a": 1, "b": 400, "c": 300, "d": 2, None: 90, "e": 0, "f": 50})
    assert {s: got[s].target for s in want} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(843) and all(r.copies <= 3 for r in got.values())


def test_mix_emits_copies_near_the_target_and_again_the_same(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}") for i in range(3000)]
    docs = _docs(spark, rows).repartition(5)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    again = Counter(r.doc_id for r in mixing.mix(docs.repartition(2)).collect())
    got = Counter(r.doc_id for r in out.collect())
    assert got == again
    planned = {r.source: r.target for r in mixing.plan_mix(docs).collect()}
    for s, target in planned.items():
        taken = sum(n * (i % 7 + 1) for i, n in got.items() if f"s{i % 5}" == s)
        assert abs(taken - target) < 0.1 * target


# --- sharding ---

def _naive_best_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fits = [(free, b) for b, free in enumerate(bins) if free >= s]
        if fits:
            free, b = min(fits)
        else:
            b = len(bins)
            bins.append(max(capacity, s))
        bins[b] -= s
        out.append(b)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 80))
def test_best_fit_against_a_scan_of_all_bins(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    assert sharding.best_fit_decreasing(sizes, capacity) == _naive_best_fit(sizes, capacity)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=200), st.integers(1, 9))
def test_packing_into_a_number_of_shards(sizes, shards):
    sizes = sorted(sizes, reverse=True)
    out = sharding.pack_into(sizes, shards)
    assert len(out) == len(sizes) and max(out) < shards
    load = Counter()
    for s, b in zip(out and sizes, out):
        load[b] += s
    assert max(load.values()) <= max(sizes[0], 2 * -(-sum(sizes) // shards))


def test_shards_are_even_groups_whole_and_slots_gapless(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = [(10_000 + i, "the same text", "en", "s", 1) for i in range(30)] + [(None, None, None, None, None), (20_000, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("shard", F.lit("clash"))
    rows = sharding.shard(docs).collect()
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text].add(r.shard)
    assert len(rows) == docs.count() and set(load) == set(range(8))
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.05 * max(load.values())
    assert {r.text_crc32 for r in rows if not r.text} == {0}


def test_a_huge_group_has_its_own_shard_and_the_rest_is_even(spark):
    rows = [(i, "x" * 50, "s") for i in range(500)] + [(1000 + i, f"text {i} " * 3, "s") for i in range(700)]
    load = Counter()
    for r in sharding.shard(_docs(spark, rows)).collect():
        load[(r.shard, r.text[0] == "x")] += r["size"]
    assert sum(x for _, x in load) == 1 and len(load) == 8
    rest = [v for (_, x), v in load.items() if not x]
    assert max(rest) - min(rest) < 0.05 * max(rest)


def test_fixed_capacity(spark):
    rows = [(i, "abcdefgh"[i] * n, "s") for i, n in enumerate([59, 49, 39, 39, 29, 19, 9, 9])]
    out = sharding.shard(_docs(spark, rows), shards=None, capacity=100).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert sorted(r.n for r in out)[-2:] == [100, 100] and len(out) == 3


@pytest.mark.parametrize("per_range", [512, 4])
def test_fixed_capacity_of_many_small_groups(spark, monkeypatch, per_range):
    """20 shards' worth of groups far below the capacity, some of them repeated, and one group above it."""
    monkeypatch.setattr(sharding, "PIECES", 8)
    monkeypatch.setattr(sharding, "RANGE", per_range, raising=False)
    rows = [(i, f"t{i // 2 if i % 10 == 1 else i}" + "x" * (i % 7), "s") for i in range(2200)] + [(5000, "y" * 1500, "s"), (5001, None, "s")]
    out = sharding.shard(_docs(spark, rows), shards=None, capacity=1000).collect()
    load, where = Counter(), defaultdict(set)
    for r in out:
        load[r.shard] += r["size"]
        where[r.text].add(r.shard)
    assert sorted(r.doc_id for r in out) == sorted(i for i, _, _ in rows)
    assert all(len(s) == 1 for s in where.values()) and set(load) == set(range(len(load)))
    over = [s for s, n in load.items() if n > 1000]
    assert over == list(where["y" * 1500]) and load[over[0]] == 1501
    least = -(-(sum(load.values()) - 1501) // 1000) + 1
    assert len(load) <= least + (2 if per_range == 512 else 8)


def test_a_bundle_over_its_share_is_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS", 1)  # bundles as large as a shard
    rows = [(i, f"t{i}" + "x" * 20, "s") for i in range(300)]
    load = Counter()
    for r in sharding.shard(_docs(spark, rows), shards=None, capacity=200).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) <= 200 and sum(load.values()) == sum(len(t) + 1 for _, t, _ in rows)
