"""Operator 5: benchmark decontamination by a generalised suffix automaton.

The words of all test items make one automaton. Documents are streamed through
it word by word; at each word the automaton's state gives the longest run of
words ending there that some item contains. Runs of ``window`` words (or of a
whole shorter item) are matches. Spans of matched words are cut out, and
documents of which too large a share is matched are removed.

Items are read in slices of at most ``SLICE_WORDS`` words; each slice is one
automaton sent to the executors, and with more than one slice the documents
are streamed once per slice and what they found is united by document. After each
slice but the last the documents are staged with what was found, so that a task
and the driver hold one automaton at a time; at most two staged copies exist.
Documents are handled a record batch at a time without any shuffle.

Edge cases: a null or empty text has no words and no match; an item without
words matches nothing; items of equal text all count; an item without id (null)
marks words but is not counted or listed; repeated item rows count once.
Columns of the input that carry the name of a column added here are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import table
from tidings.session import release, stage_at

WINDOW = 10
#: Words of the items in one automaton (about 1 KB of memory a word).
SLICE_WORDS = 300_000
#: Documents of which a larger share of words is matched are removed, not cut.
MAX_COVERAGE = 0.5

# bytes of words stay (letters lower-cased), all others become blanks
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

# the same words in a text as it is
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.ids)}
        coded = [(number.get(i, -1), [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        # per state, from short to long: what its last ``window`` words are, and the nearest suffix that is a whole item
        self.last_window = list(range(len(self.next)))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in order:
            if self.length[self.link[s]] >= window:
                self.last_window[s] = self.last_window[self.link[s]]
        self.shortest = min((min(window, len(ws)) for _, ws in coded), default=0)
        # items by the state that holds their windows; of shorter items by state and length
        self.windows: dict[int, set[int]] = {}
        self.whole: dict[int, dict[int, set[int]]] = {}
        for i, ws in coded:
            for _, state, run in self.stream(ws):
                if run >= window:
                    self.windows.setdefault(self.last_window[state], set()).add(i)
            if len(ws) < window:  # ``state`` is that of all its words
                self.whole.setdefault(state, {}).setdefault(len(ws), set()).add(i)
        self.nearest_whole = [0] * len(self.next)
        for s in order:
            self.nearest_whole[s] = s if s in self.whole else self.nearest_whole[self.link[s]]
        self.pairs = np.unique(np.concatenate([np.empty(0, np.int64), *(np.array(ws[:-1], np.int64) * len(self.vocabulary) + ws[1:] for _, ws in coded)]))

    @classmethod
    def of(cls, state: dict) -> SuffixAutomaton:
        """The automaton with the attributes of another one."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def stream(self, ws: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest run of item words that ends there)."""
        state = run = 0
        for at, w in enumerate(ws):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            else:
                run = 0
            yield at, state, run

    def matches(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of matched words, disjoint and in order, and the numbers of the items found.

        Only stretches whose every pair of neighbours occurs in an item, and
        which are as long as the shortest window, can match; the rest is passed
        over without stepping through it."""
        n, v = len(ws), len(self.vocabulary)
        if not self.shortest or n < self.shortest:
            return [], set()
        codes = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, n)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for left, right in self._runs(codes >= 0):
            pairs = codes[left:right - 1] * v + codes[left + 1:right]
            at = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
            joined = self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)
            # words whose right neighbours are joined, as many as a window has but one
            for a, b in self._runs(joined, self.shortest - 1) if self.shortest > 1 else [(0, right - left - 1)]:
                self._step_through(codes[left + a:left + b + 1].tolist(), left + a, spans, found)
        return spans, found - {-1}

    def _runs(self, flags: np.ndarray, shortest: int | None = None) -> list[tuple[int, int]]:
        """[start, end) of the runs of true flags of at least ``shortest`` (default: the shortest window)."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
        long = edges[1::2] - edges[::2] >= (self.shortest if shortest is None else shortest)
        return list(zip(edges[::2][long].tolist(), edges[1::2][long].tolist(), strict=True))

    def _step_through(self, ws: list[int], start: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        for k, state, run in self.stream(ws):
            reach = 0
            if run >= self.window:
                reach = self.window
                found |= self.windows.get(self.last_window[state], set())
            s = self.nearest_whole[state]
            while s:  # shorter items that end here: fewer than a window has words
                for length, items in self.whole[s].items():
                    if length <= run:
                        reach = max(reach, length)
                        found |= items
                s = self.nearest_whole[self.link[s]]
            if reach:
                left, right = start + k + 1 - reach, start + k + 1
                while spans and spans[-1][1] >= left:
                    left = min(left, spans.pop()[0])
                spans.append((left, right))


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("item_ids", T.ArrayType(T.StringType()))])


def pieces(ws: list[bytes], size: int, window: int) -> Iterator[list[bytes]]:
    """An item's words, those of a longer item than ``size`` in pieces that hold each of its windows once."""
    step = max(size, window) - window + 1
    for a in range(0, max(len(ws) - window + 1, 1), step):
        yield ws[a:a + step + window - 1]


def _slices(items: DataFrame, item_id: str, text: str, slice_words: int, window: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items, a bounded number of words at a time; one longer than that comes in pieces."""
    part: list[tuple[str | None, list[bytes]]] = []
    n = 0
    for i, t in items.select(F.col(item_id).cast("string"), text).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        for ws in pieces(words(t), slice_words, window):
            if part and n + len(ws) > slice_words:
                yield part
                part, n = [], 0
            part.append((i, ws))
            n += len(ws)
    yield part


def unite(found: list[list[int]]) -> list[list[int]]:
    """Spans as disjoint ones in order; those that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if text is None or not spans:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return "".join(kept) + text[last:]


def _scanner(shared, text: int, width: int, again: bool, change: str):
    """A pass over record batches whose first ``width`` columns are the input's.
    ``again``: matches of earlier slices follow them, to be united with; ``change``:
    what becomes of the text (``keep``, ``cut``, ``drop``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton.of(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                texts = b.column(text).to_pylist()
                counts, spans, ids = [], [], []
                for t in texts:
                    ws = words(t) if t else []
                    hits, found = automaton.matches(ws)
                    counts.append(len(ws))
                    spans.append([list(x) for x in hits])
                    ids.append(sorted(automaton.ids[i] for i in found))
                if again:
                    spans = [unite([*x, *y]) for x, y in zip(b.column(width + 1).to_pylist(), spans, strict=True)]
                    ids = [sorted({*x, *y}) for x, y in zip(b.column(width + 2).to_pylist(), ids, strict=True)]
                columns = list(b.columns[:width])
                names = [f"c{k}" for k in range(width)]
                if change == "cut" and any(spans):
                    columns[text] = pa.array([cut(t, x) for t, x in zip(texts, spans, strict=True)], columns[text].type)
                elif change == "drop":
                    del columns[text], names[text]
                columns += [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*names, *FOUND.names])

    return run


def _scan(docs: DataFrame, items: DataFrame, text: str, change: str, item_id: str, item_text: str, window: int, slice_words: int) -> DataFrame:
    """One pass for each slice of the items; columns ``c0``, ``c1`` ... and those of ``FOUND``."""
    sc, at, width = docs.sparkSession.sparkContext, docs.columns.index(text), len(docs.columns)
    out = docs.toDF(*[f"c{k}" for k in range(width)])
    fields, again, before = out.schema.fields, False, None
    parts = _slices(items, item_id, item_text, slice_words, window)
    part = next(parts)
    while part is not None:
        following = next(parts, None)
        shared = sc.broadcast(vars(SuffixAutomaton(part, window)))
        last = change if following is None else "keep"
        kept = [f for k, f in enumerate(fields) if last != "drop" or k != at]
        out = out.mapInArrow(_scanner(shared, at, width, again, last), T.StructType(kept + FOUND.fields))
        if following is not None:
            out, path = stage_at(out, "found-spans")
            shared.destroy()
            if before:
                release(docs.sparkSession, before)
            before = path
        part, again = following, True
    return out


def find_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, slice_words: int = SLICE_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (disjoint [start, end) in words, in
    order) and ``item_ids`` (found, sorted as strings)."""
    out = _scan(docs, items, text, "keep" if keep_text else "drop", item_id, item_text, window, slice_words)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in FOUND.names and (keep_text or c != text)], *FOUND.names)


def n_hit() -> Column:
    """Words in the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.element_at(s, 2) - F.element_at(s, 1))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE, item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The documents with matched spans cut out of their text, without those of
    which more than ``max_coverage`` of the words is matched. Adds ``n_hit``,
    the number of words cut; untouched documents keep their text as it is."""
    out = _scan(docs, items, text, "cut", item_id, item_text, window, slice_words).withColumn("n_hit", n_hit())
    out = out.where(F.col("n_hit") <= F.col("n_words") * max_coverage)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c != "n_hit"], "n_hit")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"), keep_text=False).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.col("spans").cast("string").alias("spans"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS ws FROM benchmark),
k AS (SELECT *, least({WINDOW}, len(ws)) AS n FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS gram
       FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM k)),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS gram
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM k))),
hit AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (n, gram)),
spots AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit),
runs AS (SELECT doc_id, min(q) - 1 AS a, max(q) AS b FROM (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS r FROM spots) GROUP BY doc_id, r),
spans AS (SELECT doc_id, sum(b - a)::BIGINT AS n_hit, '[' || string_agg('[' || a || ', ' || b || ']', ', ' ORDER BY a) || ']' AS spans FROM runs GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(spans, '[]') AS spans
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
