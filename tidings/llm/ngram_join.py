"""Operator 2: n-gram Jaccard join by filters under several global token orders.

Tokens are 64-bit hashes of word shingles. Two sets of sizes n and m with
Jaccard similarity of t or more differ in at most ``n - ceil(t n)`` tokens of the
first one, so under *any* global order of tokens they share a token among their
first ``n - ceil(t n) + 1``, and l tokens among their first ``n - ceil(t n) + l``.
The join uses three orders:

1. by hash (order A): documents whose head has too few tokens in common with other
   documents' heads drop out. This needs a fifth of the tokens, and only what is
   left is read again with all its tokens;
2. by document frequency, rare first (order C): pairs must share a token of their
   heads, and have enough tokens that occur elsewhere at all;
3. by hash, from the other end (order B): pairs found under C must also share a
   token of their heads under A and under B. Only then are they verified.

Copies (equal sets) are one class from the start. Within a token's list, classes
are first compared to one hub, the one with the most frequent tokens, and what
turns out linked becomes one component; then pairs of *different* components are
all compared. So a large group of near copies costs a comparison a member
rather than a pair, no link between different components is missed, and nothing
is capped. Intersections are exact up to collisions of 64-bit hashes.

Edge cases: null, empty and blank texts have no tokens and are linked with
nothing; a text shorter than a shingle is one token; rows with equal ids and texts
are copies of each other; a null id never names a component unless it has no other;
extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import small, table
from tidings.llm.graph import components
from tidings.session import stage

#: Shingle length and similarity (percent) of the registered query.
SHINGLE, PERCENT = 4, 85
#: Tokens a head is longer than one common token needs, as a share of the set: 1 / SLACK.
SLACK = 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A random number for every byte, capitals as small letters.
_BYTE = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= _ODD
    h ^= h >> np.uint64(32)
    return h


class Shingles:
    """Distinct 64-bit hashes of a text's shingles of ``k`` words, in ascending
    order. Words are hashed for all bytes at once: a sum over the word of the byte's random number
    times a power of the position, mixed."""

    def __init__(self, k: int):
        self.k = k
        self.power = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            steps = np.full(max(64, 2 * n), _ODD)
            steps[0] = 1
            self.power = np.cumprod(steps)
        return self.power

    def tokens(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        word = ~_BLANK[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
        n = len(edges) // 2
        if not n:
            return np.empty(0, np.uint64)
        lengths = edges[1::2] - edges[::2]
        first = np.cumsum(lengths) - lengths
        at = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
        h = _mixed(np.add.reduceat(_BYTE[raw[word]] * self._powers(int(lengths.max()))[at], first))
        k = min(self.k, n)
        out = h[:n - k + 1].copy()
        for i in range(1, k):
            out *= _ODD
            out += h[i:n - k + 1 + i]
        out = _mixed(out + np.uint64(k))  # a short text isn't the shingle of a longer one
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _need(n, percent: int):
    """Fewest tokens of a set of n that a similar set must hold."""
    return -(-percent * n // 100)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 256 rows."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield b.slice(at, 256)


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id``, ``text_md5``, ``n_shingles``, ``digest`` of the set, and its head under order A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for b in _parts(batches):
            sets = [shingles.tokens(t) for t in b.column("text").to_pylist()]
            heads = [s[:len(s) - _need(len(s), percent) + max(1, len(s) // SLACK)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_md5"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), _lists(heads)],
                ["doc_id", "text_md5", "n_shingles", "digest", "head"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, text_md5 binary, n_shingles long, digest binary, head array<long>")


def _all_tokens(docs: DataFrame, k: int) -> DataFrame:
    """``cid``, ``n`` and all tokens in order of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for b in _parts(batches):
            sets = [shingles.tokens(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["cid", "n", "tokens"])

    return docs.select("cid", "text").mapInArrow(run, "cid long, n long, tokens array<long>")


def _narrow(tokens: DataFrame, percent: int) -> DataFrame:
    """Of rows (``cid``, ``n``, ``hits`` array of (``token``, ``pos``)) those that can have a
    partner: enough of their tokens occur in another row. ``hits`` keeps such
    tokens, now in order of document frequency ``df``."""
    flat = tokens.select("cid", F.explode("hits").alias("x")).select("cid", "x.token", "x.pos")
    shared = flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # two lists of longs, filled row by row alike, take less than half the room of a list of structs
    hits = flat.join(shared, "token").groupBy("cid").agg(
        F.collect_list("token").alias("t"), F.collect_list(F.col("df") * (1 << 32) + F.col("pos")).alias("m"))
    hits = hits.join(tokens.select("cid", "n"), "cid").withColumn("s", F.size("t")).where(F.col("s") * 100 >= F.col("n") * percent)
    mark = lambda t, m: F.struct(F.shiftright(m, 32).alias("df"), t.alias("token"), m.bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))
    return stage(hits.select("cid", "n", "s", F.array_sort(F.zip_with("t", "m", mark)).alias("hits")), "near")


def _similar(percent: int) -> Column:
    both = F.size(F.array_intersect("all_a", "all_b"))
    return both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent


def _verified(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that share head tokens under orders A and B and then
    prove similar."""
    side = lambda x: near.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "all", "head_a", "head_b")])
    # bounded rows: a pair's two sets; neither side is gathered by key
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    filters = F.arrays_overlap("head_a_a", "head_a_b") & F.arrays_overlap("head_b_a", "head_b_b")
    return both.where(F.when(filters, _similar(percent)).otherwise(False)).select("a", "b")


def _enough(percent: int, a: str = "a", b: str = "b") -> Column:
    """Whether the tokens of either that occur elsewhere suffice for the pair."""
    return F.least(F.col(f"s_{a}"), F.col(f"s_{b}")) * (100 + percent) >= (F.col(f"n_{a}") + F.col(f"n_{b}")) * percent


def _links(near: DataFrame, percent: int) -> DataFrame:
    """``node``, ``component`` for classes with a link to another one."""
    p = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    tokens = lambda hits: F.transform(hits, lambda h: h["token"])
    near = stage(near.select(
        "cid", "n", "s", tokens(F.col("hits")).alias("all"),
        # tokens that occur nowhere else come first under order C and match nothing
        F.slice(tokens(F.col("hits")), 1, F.greatest(F.lit(0), p - (F.col("n") - F.col("s"))).cast("int")).alias("head_c"),
        tokens(F.filter("hits", lambda h: h["pos"] < p)).alias("head_a"),
        tokens(F.filter("hits", lambda h: h["pos"] >= F.col("n") - p)).alias("head_b"),
        (F.aggregate("hits", F.lit(0).cast("long"), lambda x, h: x + h["df"]) / F.col("n")).alias("hub")), "join-sets")
    posts = near.select("cid", "n", "s", "hub", F.explode("head_c").alias("token"))
    member = F.struct("cid", "n", "s")
    hubs = posts.groupBy("token").agg(F.max(F.struct("hub", member.alias("m"))).alias("h"))
    stars = posts.select("token", member.alias("m")).join(hubs.select("token", F.col("h.m").alias("h")), "token").where(F.col("m.cid") != F.col("h.cid"))
    stars = stars.select(F.least("m.cid", "h.cid").alias("a"), F.greatest("m.cid", "h.cid").alias("b"),
                         F.col("m.n").alias("n_a"), F.col("m.s").alias("s_a"), F.col("h.n").alias("n_b"), F.col("h.s").alias("s_b"))
    found = stage(_verified(stars.where(_enough(percent)).select("a", "b").distinct(), near, percent), "links")
    part = components(found)
    # pairs of different components: a list's members outside its largest one against all
    rows = _with_component(posts.select("token", "cid"), part)
    inside = rows.groupBy("token", "component").count()
    lists = inside.groupBy("token").agg(F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("k")).where("k > 1")
    mixed = rows.join(lists.select("token", F.col("top.component").alias("main")), "token").select("token", "cid", "component", (F.col("component") != F.col("main")).alias("minor"))
    mixed = stage(mixed.join(near.select("cid", "n", "s", "head_c"), "cid"), "mixed-lists")
    one = mixed.where("minor").select("token", *[F.col(c).alias(f"{c}_a") for c in ("cid", "component", "n", "s", "head_c")])
    two = mixed.select("token", "minor", *[F.col(c).alias(f"{c}_b") for c in ("cid", "component", "n", "s", "head_c")])
    first = F.element_at(F.array_sort(F.array_intersect("head_c_a", "head_c_b")), 1)
    pairs = one.join(two, (one["token"] == two["token"]) & (F.col("component_a") != F.col("component_b"))
                     & (~F.col("minor") | (F.col("cid_a") < F.col("cid_b"))) & _enough(percent)
                     & (first == one["token"]))  # each pair once, at its first common token
    pairs = pairs.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct()
    return components(found.unionByName(_verified(pairs, near, percent)))


def _with_component(rows: DataFrame, part: DataFrame) -> DataFrame:
    out = rows.join(part, F.col("cid") == F.col("node"), "left")
    return out.withColumn("component", F.coalesce("component", "cid")).drop("node")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row ``doc_id``, ``text_md5``, ``n_shingles``, ``component_id`` (the
    smallest id it is linked to by a chain of links, its own included)."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("text_md5"))
    signed = stage(_signatures(keyed, shingle, percent), "signatures")
    # classes of equal sets, with one row to read their tokens from
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("head").alias("head"),
        F.min(F.struct("doc_id", "text_md5")).alias("rep"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # order A
    heads = classes.select("cid", F.explode("head").alias("token"))
    shared = stage(heads.groupBy("token").count().where("count > 1").select("token"), "head-tokens")
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / F.lit(100)) / SLACK))
    kept = heads.join(small(shared), "token").groupBy("cid").agg(F.count("*").alias("s"))
    reps = stage(kept.join(classes.select("cid", "n", "rep"), "cid").where(F.col("s") >= need).select("cid", F.col("rep.doc_id").alias("_id"), F.col("rep.text_md5").alias("_md5")), "candidates")
    again = keyed.join(small(reps), keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["text_md5"] == F.col("_md5")))
    tokens = stage(_all_tokens(again, shingle), "tokens")
    if tokens.count() > reps.count():  # rows repeated with id and text
        tokens = tokens.dropDuplicates(["cid"])
    near = _narrow(_narrow(tokens.select("cid", "n", F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("pos"))).alias("hits")), percent), percent)
    # components: of classes, then named by the smallest id
    parts = stage(classes.select("cid", "digest", "first_id", "rows").join(_links(near, percent), F.col("cid") == F.col("node"), "left"), "class-parts")
    names = parts.where("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = parts.where("component IS NOT NULL").join(names, "component").select("digest", "component_id").unionByName(
        parts.where("component IS NULL AND rows > 1").select("digest", F.col("first_id").alias("component_id")))
    out = signed.select("doc_id", "text_md5", "n_shingles", "digest").join(linked, "digest", "left")
    return out.select("doc_id", "text_md5", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates (the one with the smallest
    id), and every document that is linked with nothing. A group in which no
    document has an id keeps one document of each text."""
    found = stage(near_duplicates(docs, shingle, percent).where("n_shingles > 0"), "near-duplicates")
    kept = found.where("component_id IS NOT NULL").groupBy("component_id").agg(
        F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")).alias("k")).where("rows > 1")
    kept = stage(kept.select(F.col("component_id").alias("_c"), F.col("k.doc_id").alias("_id"), F.col("k.text_md5").alias("_md5")), "kept")
    gone = found.join(small(kept), F.col("component_id") == F.col("_c")).where(
        ~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")))).drop("_id", "_md5")
    gone = stage(gone.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct(), "gone")
    md5 = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    out = docs.withColumn("_text", md5)
    out = out.join(small(gone), out["doc_id"].eqNullSafe(F.col("_id")) & (out["_text"] == F.col("_md5")), "left_anti")
    # rows repeated with id and text are copies, too
    again = stage(found.groupBy("doc_id", "text_md5").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")), "repeated")
    if not again.isEmpty():
        same = out["doc_id"].eqNullSafe(F.col("_id")) & (out["_text"] == F.col("_md5"))
        out = out.join(small(again), same, "left_anti").unionByName(out.join(small(again), same, "left_semi").dropDuplicates(["doc_id", "_text"]))
    return out.drop("_text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


#: All pairs through their common shingles, then labels spread along the links.
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {PERCENT} * (na.n + nb.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
