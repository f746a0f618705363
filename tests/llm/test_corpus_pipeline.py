"""The pipeline against its stages written out over rows."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from conftest import SF001
from tidings.llm import decontaminate, mixing, quality_rules
from test_quality_mixing_sharding import _brute_repeat, _targets
from test_text_operators import _brute, _brute_components


def _quality(rows):
    fails = {r: [] for r in ("short", "repetition", "symbols", "lines")}
    for r in rows:
        t = r.text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        fails["short"].append(len(ws) < 10)
        fails["repetition"].append(100 * _brute_repeat(" ".join(ws)) > 20 * len(ws))
        fails["symbols"].append(10 * sum(c in quality_rules.SYMBOLS for c in t) > sum(map(len, ws)))
        fails["lines"].append(100 * (len(lines) - len(set(lines))) > 30 * len(lines))
    n = Counter(r.source for r in rows)
    bad = set()
    for f in fails.values():
        failed = Counter(r.source for r, x in zip(rows, f) if x)
        m = sum(f) / len(rows)
        v = sum(n[h] * (failed[h] / n[h] - m) ** 2 for h in n) / len(rows)
        k = max(quality_rules.MIN_PRIOR, m * (1 - m) / v - 1) if v > 1e-12 else quality_rules.MIN_PRIOR
        bad |= {h for h in n if (failed[h] + m * k) / (n[h] + k) > quality_rules.MAX_HOST_RATE}
    return [r for r, a, b in zip(rows, fails["short"], fails["repetition"]) if not a and not b and r.source not in bad]


def test_pipeline_against_rows(spark):
    rows = _quality(spark.read.parquet(f"{SF001}/documents.parquet").collect())
    comp = {d: c for d, _, c in _brute_components([(r.doc_id, r.text) for r in rows], P.SHINGLE, P.PERCENT)}
    rows = [r for r in rows if comp[r.doc_id] == r.doc_id]
    items = [(str(r.item_id), decontaminate.words(r.text)) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    kept = []
    for r in rows:
        ws = decontaminate.words(r.text)
        hit, _ = _brute(ws, items) if len(ws) < 3000 else (set(), set())
        if len(hit) <= len(ws) * decontaminate.MAX_COVERAGE:
            at = [m.span() for m in decontaminate.WORD.finditer(r.text)]
            gone = set()
            for p in hit:
                gone |= set(range(*at[p])) | (set(range(at[p][1], at[p + 1][0])) if p + 1 in hit else set())
            kept.append((r.doc_id, "".join(c for k, c in enumerate(r.text) if k not in gone), r.source))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = Counter()
    for _, t, s in kept:
        sizes[s] += size(t)
    target = _targets(sizes)
    draws = {r.doc_id: r.u for r in spark.createDataFrame([(d, t) for d, t, _ in kept], "doc_id long, text string").select(
        "doc_id", mixing.draw(mixing.F.col("doc_id"), mixing.F.col("text")).alias("u")).collect()}
    want = Counter()
    for d, t, s in kept:
        rate = target[s] / sizes[s]
        want[(d, t, s)] = int(rate) + (draws[d] < rate - int(rate))
    got = P.run(spark, SF001).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == +want
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        assert r.n_chars == len(r.text) and r["size"] == len(r.text.encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 0.05 * max(load.values())


def test_stages_return_the_columns_of_documents_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for name, step in P.STAGES[:-1]:
        out = step(spark, docs, SF001)
        assert out.columns == docs.columns and out.count() == 0, name
    assert P.STAGES[-1][1](spark, docs, SF001).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_take_nulls_repeated_rows_and_other_columns(spark, k):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1, "x"), (1, words, "en", "a", 1, "x"), (2, None, None, None, None, None), (None, words + " and more", "de", None, 5, "y"),
            (3, "", "en", "a", 0, "z"), (4, " ".join(f"other{i}" for i in range(30_000)), "en", "b", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    out = P.STAGES[k][1](spark, docs, SF001)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert k == 3 or 4 in ids
    if k == 1:
        assert sorted(ids, key=str) == [1, 2, 3, 4]
