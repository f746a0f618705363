"""Operator 12: ranked lexical search with deduplicated bags.

For each item (query) the highest-scoring documents by integer term weights and
saturated term frequencies. Documents are restricted to the items' vocabulary:
what remains of one is its term-frequency vector and its length penalty ``m``.
Documents in which both are identical score alike for every item and make one
class (grouped by hash, with every number of the vector compared); each class is
scored once. An item's first 50 classes by (score, smallest doc_id) hold its first 50
documents, so only those are expanded, each to its 50 smallest ids.

Items are read in slices of at most ``SLICE_PAIRS`` distinct (item, term) pairs; a
slice's vocabulary and posting lists are sent to the tasks, and more items mean
more passes over the documents, not larger tables. Within a slice the documents'
vectors and the classes are staged; what each task returns of scores is bounded
by items x 50 rows.

Edge cases: a null or empty text has no terms, is not counted in N and never
ranks; an item without terms has no rows; rows with equal item_id (null
included) are one item with the terms of all of them; repeated documents rank
once for each row; a null doc_id ranks after all others of its score; empty tables
give an empty result; other columns are not read, whatever their names.
``doc_id`` must be an integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import small, table
from tidings.session import stage

TOP = 50
#: Distinct (item, term) pairs whose posting lists a task holds at a time.
SLICE_PAIRS = 200_000
#: Numbers in the chosen classes' vectors up to which they are broadcast; more are joined by shuffle.
CHOSEN_NUMBERS = 2_000_000
#: Numbers that a task adds up at a time.
CELLS = 2_000_000

# bytes of terms stay (letters lower-cased), all others become blanks
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[w.decode() for w in x] for x in lists], pa.list_(pa.string()))], ["item_id", "terms"])


def _slices(items: DataFrame, slice_pairs: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Items with their distinct terms, a bounded number of terms at a time."""
    kind = dict(items.dtypes)["item_id"]
    each = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<string>")
    each = each.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    part: list[tuple[object, list[str]]] = []
    n = 0
    for i, terms in each.where(F.size("terms") > 0).orderBy("item_id").toLocalIterator():
        if part and n + len(terms) > slice_pairs:
            yield part
            part, n = [], 0
        part.append((i, terms))
        n += len(terms)
    if part:
        yield part


def _vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): length, and the vector over the numbered terms."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, terms, tfs = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for t in part.column(1).to_pylist():
                    ws = terms_of(t)
                    ids, many = np.unique(np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws)), return_counts=True)
                    known = int(len(ids) and ids[0] < 0)
                    sizes.append(len(ws))
                    terms.append(ids[known:])
                    tfs.append(many[known:])
                at = pa.array(np.cumsum(list(map(len, terms))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(terms), pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(tfs), pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"), "term-vectors")


class Postings:
    """For each term of a slice its weight and the items that hold it."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        term = np.array([t for x in items for t in x], np.int64)
        item = np.repeat(np.arange(len(items)), list(map(len, items)))
        self.items = item[np.argsort(term, kind="stable")]
        self.size = np.bincount(term, minlength=len(weights))
        self.start = np.cumsum(self.size) - self.size
        self.weights, self.n_items = weights, len(items)

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Exact scores, rows x items, of entries (row, term, tf, m of the row)."""
        value = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        n_rows = int(row[-1]) + 1 if len(row) else 0
        many = self.size[term]
        ends = np.cumsum(many)
        place = np.repeat(self.start[term] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
        cell = np.repeat(row, many) * self.n_items + self.items[place]
        value = np.repeat(value, many)
        total = np.zeros(n_rows * self.n_items, np.int64)
        for shift in (0, 24):  # each half adds up exactly in doubles
            half = (value >> shift) & 0xFFFFFF if not shift else value >> shift
            total += np.bincount(cell, half, len(total)).astype(np.int64) << shift
        return total.reshape(n_rows, self.n_items)


class Best:
    """The ``top`` entries of each item by (score descending, first ascending) among all added."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.parts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, first: np.ndarray, ids: np.ndarray) -> None:
        r, i = np.nonzero(scores >= self.least)
        self.parts.append(np.stack([i, scores[r, i], first[r], ids[r]]))
        self.waiting += len(r)
        if self.waiting > 4 * self.top * len(self.least) + 10_000:
            self.shrink()

    def shrink(self) -> np.ndarray:
        """Rows item, score, first, id of what is kept."""
        every = np.concatenate([np.empty((4, 0), np.int64), *self.parts], 1)
        every = every[:, np.lexsort((every[3], every[2], -every[1], every[0]))]
        start = np.flatnonzero(np.r_[True, every[0, 1:] != every[0, :-1]]) if every.shape[1] else np.empty(0, np.int64)
        place = np.arange(every.shape[1]) - np.repeat(start, np.diff(np.r_[start, every.shape[1]]))
        full = every[:, place == self.top - 1]
        self.least[full[0]] = full[1]
        every = every[:, place < self.top]
        self.parts, self.waiting = [every], 0
        return every


def _score(classes: DataFrame, postings, top: int) -> DataFrame:
    """(item, score, first, class): each task's best classes of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Postings = postings.value
        best = Best(known.n_items, top)
        step = max(1, CELLS // max(len(known.items), known.n_items))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids, m = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                first = part.column(2).fill_null(_LAST).to_numpy(zero_copy_only=False)
                sizes = np.diff(part.column(3).offsets.to_numpy())
                term, tf = (part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
                row = np.repeat(np.arange(len(ids)), sizes)
                best.add(known.scores(row, term, tf, m[row]), first, ids)
        found = best.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["item", "score", "first", "class"])

    return classes.select("class", "m", "first", "terms", "tfs").mapInArrow(run, "item long, score long, first long, class long")


def _best_rows(rows: DataFrame, by: str, order: list, top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)


def _search_slice(docs: DataFrame, part: list[tuple[object, list[str]]], kind: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    number = {w: k for k, w in enumerate(sorted({w for _, terms in part for w in terms}))}
    vectors = _vectors(docs, {w.encode(): k for w, k in number.items()})
    n_docs, length = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most as long as the slice's vocabulary
    weights = np.zeros(len(number), np.int64)
    for term, df in held:
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    postings = spark.sparkContext.broadcast(Postings([[number[w] for w in terms] for _, terms in part], weights))

    bags = vectors.where(F.size("terms") > 0).withColumn("m", F.expr(f"50 + (50 * n * {n_docs}L) div {max(length, 1)}L"))
    bags = bags.withColumn("hash", F.xxhash64("terms", "tfs", "m"))
    same = ["hash", "m", "terms", "tfs"]
    classes = bags.groupBy(*same).agg(F.min("doc_id").alias("first"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "bag-classes")
    chosen = stage(_best_rows(_score(classes, postings, top), "item", [F.desc("score"), "first", "class"], top).drop("rank"), "best-classes")

    wanted = stage(classes.join(small(chosen.select("class").distinct()), "class", "left_semi").select(*same, "class"), "chosen-bags")
    numbers = wanted.agg(F.coalesce(F.sum(F.size("terms") + 3), F.lit(0))).first()[0]
    members = bags.join(F.broadcast(wanted) if numbers <= CHOSEN_NUMBERS else wanted, same).select("class", "doc_id")
    members = _best_rows(members, "class", [F.col("doc_id").asc_nulls_last()], top).drop("rank")
    ranked = members.join(chosen.select("class", "item", "score"), "class")
    ranked = _best_rows(ranked, "item", [F.desc("score"), F.col("doc_id").asc_nulls_last()], top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(part)], f"item long, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    kind = dict(items.dtypes)["item_id"]
    found = None
    for part in _slices(items, slice_pairs):
        rows = _search_slice(docs, part, kind, top)
        found = rows if found is None else stage(found, "ranked").unionByName(rows)
    return found if found is not None else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS ws FROM documents),
size AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS nd, sum(len(ws))::BIGINT AS l FROM d),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term),
m AS (SELECT k, doc_id, 100 - 50 + ((50 * len(ws)::BIGINT * nd) // l) AS m FROM d, size WHERE len(ws) > 0),
s AS (SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}
"""
