"""Hashed text features and the bounded training sample of the two classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash space of the features.
BITS = 22
MASK = (1 << BITS) - 1
#: Words remembered by a task before it starts again.
MEMO = 500_000

# letters are lower-cased, digits and bytes over 127 stay, all else parts words
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


def word_features(word: bytes) -> tuple[int, ...]:
    """Hash of the word and of its beginnings of four and five characters (as
    stems: inflected forms of a word share them)."""
    ids = [zlib.crc32(word) & MASK]
    if len(word) > 4:
        s = word.decode("utf-8", "replace")
        ids += [zlib.crc32(f"^{n}{s[:n]}".encode()) & MASK for n in (4, 5) if len(s) > n]
    return tuple(ids)


class Memo(dict):
    """Remembers a function of words."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.of(word)
        return value


def in_training(doc_id: Column) -> Column:
    """Rows from which labels may be learned: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def sample_ids(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``ids`` (with ``doc_id``): those whose ids hash lowest."""
    return ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit("sample")), "doc_id").limit(rows)


def sample_features(docs: DataFrame, chosen: DataFrame, features: Callable[[str | None], np.ndarray], label: str) -> DataFrame:
    """(doc_id, label, ids): the feature ids of the chosen documents, one row an id
    (of several that whose text has the smallest hash)."""
    kinds = dict(chosen.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                ids = pa.array([features(t) for t in part.column(3).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], ids], ["doc_id", label, "hash", "ids"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", label, F.xxhash64("text").alias("hash"), "text")
    rows = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, {label} {kinds[label]}, hash long, ids array<int>")
    return rows.groupBy("doc_id", label).agg(F.min_by("ids", "hash").alias("ids"))


def class_counts(sample: DataFrame, weight: str) -> DataFrame:
    """(feature, toxic, clean): on how many rows a feature occurs, weighed by ``weight`` and by what it lacks to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                lists, w = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
                found, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                w = np.repeat(w, np.diff(lists.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int32()), pa.array(np.bincount(at, w, len(found))), pa.array(np.bincount(at, 1 - w, len(found)))], ["feature", "toxic", "clean"])

    rows = sample.select("ids", F.col(weight).cast("double")).mapInArrow(run, "feature int, toxic double, clean double")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def with_odds(sample: DataFrame, name: str, base: float, columns: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``sample`` with the probability of its log odds, ``base`` and the weights of the features it has."""

    def of(ids: pa.Array) -> pa.Array:
        rows = Sparse(ids, columns)
        return pa.array(sigmoid(base + rows.dot(weights)))

    return sample.withColumn(name, F.arrow_udf(of, "double")(F.col("ids")))


def picked_rows(sample: DataFrame, columns: np.ndarray, label: str) -> tuple[pa.ListArray, np.ndarray]:
    """The sample on the driver, by doc_id, reduced to the picked features; and the labels."""

    def of(ids: pa.Array) -> pa.Array:
        rows = Sparse(ids, columns)
        order = np.argsort(rows.rows, kind="stable")
        offsets = np.r_[0, np.cumsum(np.bincount(rows.rows, minlength=rows.n))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(columns[rows.flat[order]], pa.int32()))

    found = sample.select("doc_id", label, F.arrow_udf(of, "array<int>")(F.col("ids")).alias("ids")).toArrow().sort_by("doc_id")
    return joined_lists(found), found.column(label).to_numpy()


class Sparse:
    """Rows of feature ids, restricted to the ``columns`` of a model."""

    def __init__(self, ids: pa.ListArray, columns: np.ndarray | None = None):
        flat = ids.values.to_numpy() if len(ids) else np.empty(0, np.int32)
        offsets = ids.offsets.to_numpy() if len(ids) else np.zeros(1, np.int32)
        flat = flat[offsets[0]:offsets[-1]]
        rows = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
        if columns is not None:
            at = np.searchsorted(columns, flat)
            hit = columns[np.minimum(at, max(len(columns) - 1, 0))] == flat if len(columns) else np.zeros(len(flat), bool)
            flat, rows = at[hit], rows[hit]
        self.rows, self.flat, self.n = rows, flat, len(ids)
        self.width = len(columns) if columns is not None else 1 << BITS

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.flat], self.n)

    def t_dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, v[self.rows], self.width)


def joined_lists(table: pa.Table) -> pa.ListArray:
    ids = table.column("ids").combine_chunks()
    return ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids


def minimise(grad: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rate: float, rounds: int) -> np.ndarray:
    """Adam with a rate that falls to zero."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, rounds + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - (k - 1) / rounds) * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
