"""Operator 9: quality classifier by ordinal cumulative-link regression.

Graded ratings 0 .. K-1 are modelled as ``P(grade <= k) = sigmoid(t_k - w x)``
with one weight vector ``w`` over hashed text features and increasing thresholds
``t_k``. A document's score is its expected grade; it is selected when the
probability of the highest grade is at least ``MIN_TAIL``.

Ratings here are made from the labels: 0 for low quality, 1 for good quality
but toxic, 2 for good quality.

The model is fitted on the driver to at most ``FIT_ROWS`` rated rows (those
whose ids hash lowest); every text is scored whole, by tasks, without a shuffle.

Edge cases: a null or empty text has the features of no words; without rated
rows every document has the highest grade with probability 1/K for each grade;
a grade that never occurs gets a vanishing probability; several ratings of one
id count as the lowest; null ids or labels teach nothing; of several rows of one id
that whose text has the smallest hash teaches; repeated rows are scored alike;
columns named like the added ones are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import features as X
from tidings.llm.common import table

GRADES = 3
#: Rated rows to which the model is fitted, at most.
FIT_ROWS = 8_000
#: Inputs, at most; the rows each must occur on; and by how many standard errors it must tell grades apart.
INPUTS, SUPPORT, MIN_Z = 20_000, 3, 3.5
PENALTY = 1e-4
MIN_TAIL = 0.5

# character classes: capitals, small letters (and all beyond ASCII), digits, the rest as it is
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))


def _id(name: str | bytes) -> int:
    return zlib.crc32(name if isinstance(name, bytes) else name.encode()) & X.MASK


def shape(token: str) -> bytes:
    """The token's character classes, runs as one: ``Word!!`` is ``Aa!``. A feature tells
    apart the first eight classes; the words of the token are features whole."""
    out = bytearray()
    for b in token.encode().translate(_SHAPE):
        if not out or out[-1] != b:
            out.append(b)
    return bytes(out[:8])


def token_features(token: str) -> tuple[bytes, tuple[int, ...]]:
    return shape(token), tuple(i for w in X.split(token) for i in X.word_features(w))


def document_features(text: str | None, known: X.Memo) -> set[int]:
    """Distinct feature ids: words and stems, the share of each token shape among
    the distinct tokens in steps of a tenth, and size, repetition, length of words and of lines in steps."""
    tokens = text.split() if text else []
    distinct = set(tokens)
    ids: set[int] = set()
    shapes: Counter[bytes] = Counter()
    for s, words in map(known.__getitem__, distinct):
        shapes[s] += 1
        if words:
            ids.update(words)
    n = max(len(distinct), 1)
    ids.update(_id(b"shape%d:%b" % (10 * c // n, s)) for s, c in shapes.items() if 20 * c >= n)
    lines = [x for x in (text or "").split("\n") if x]
    for name, value in (("size", len(tokens).bit_length()), ("distinct", 10 * n // max(len(tokens), 1)),
                        ("word", sum(map(len, distinct)) // n), ("line", (len(tokens) // max(len(lines), 1)).bit_length()),
                        ("same", 10 * len(set(lines)) // max(len(lines), 1))):
        ids.add(_id(f"{name}={value}"))
    return ids


def _training_features(text: str | None) -> np.ndarray:
    ids = document_features(text, X.Memo(token_features))
    return np.fromiter(ids, np.int32, len(ids))


def probabilities(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. K-1, rows x (K-1)."""
    return 1 - X.sigmoid(cuts[None, :] - s[:, None])


def fit_grades(ids, grades: np.ndarray, n_grades: int = GRADES) -> dict:
    """Weights and thresholds for lists of feature ids with their grades."""
    if not len(grades):
        tail = 1 - np.arange(1, n_grades) / n_grades
        return {"cuts": np.log((1 - tail) / tail), "columns": np.empty(0, np.int64), "weights": np.empty(0)}
    rows = X.Sparse(ids)
    z = np.zeros(rows.width)
    total = rows.t_dot(np.ones(len(grades)))
    for k in range(1, n_grades):
        high = (grades >= k).astype(float)
        n1, n0 = high.sum(), (1 - high).sum()
        if n1 and n0:
            p = total / (n1 + n0)
            d = rows.t_dot(high) / n1 - rows.t_dot(1 - high) / n0
            z = np.maximum(z, np.abs(d) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12))
    use = np.where((total >= SUPPORT) & (z >= MIN_Z), z, 0)
    columns = np.sort(np.argsort(-use, kind="stable")[:INPUTS])
    columns = columns[use[columns] > 0]
    train = X.Sparse(ids, columns)
    m = n_grades - 1
    share = np.clip([(grades < k).mean() for k in range(1, n_grades)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.maximum(np.diff(first), 1e-2)
    start = np.concatenate([first[:1], np.log(gaps), np.zeros(len(columns))])
    at = np.arange(len(grades))

    def cuts_of(w: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([w[:1], np.exp(w[1:m])]))

    def grad(w: np.ndarray) -> np.ndarray:
        s, cuts = train.dot(w[m:]), cuts_of(w)
        low = np.concatenate([np.zeros((len(s), 1)), X.sigmoid(cuts[None, :] - s[:, None]), np.ones((len(s), 1))], 1)  # P(grade < k)
        slope = low * (1 - low)
        p = np.maximum(low[at, grades + 1] - low[at, grades], 1e-9)
        up, down = slope[at, grades + 1] / p, slope[at, grades] / p
        g_cut = np.array([(np.where(grades == k, down, 0) - np.where(grades == k - 1, up, 0)).mean() for k in range(1, n_grades)])
        # thresholds are sums of positive steps
        steps = np.concatenate([[1.0], np.exp(w[1:m])]) * np.cumsum(g_cut[::-1])[::-1]
        return np.concatenate([steps, train.t_dot(up - down) / len(s) + PENALTY * w[m:]])

    w = X.minimise(grad, start, 0.1, 300)
    return {"cuts": cuts_of(w), "columns": columns, "weights": w[m:]}


def rating(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull() & X.in_training(F.col("doc_id")))
    rated = rated.groupBy("doc_id").agg(F.min(rating(F.col("quality"), F.col("toxic"))).alias("grade"))
    sample = X.sample_features(docs, X.sample_ids(rated, rows), _training_features, "grade").toArrow().sort_by("doc_id")
    return fit_grades(X.joined_lists(sample), sample.column("grade").to_numpy())


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_top`` (probability of the highest grade) and ``selected``."""
    weights = {int(c): float(w) for c, w in zip(model["columns"], model["weights"], strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(model["cuts"], float), weights))

    def of(texts: pd.Series) -> pd.DataFrame:
        cuts, w = shared.value
        known = X.Memo(lambda token: (shape(token), tuple(i for i in token_features(token)[1] if i in w)))
        s = np.array([sum(w[i] for i in sorted(document_features(t, known) & w.keys())) for t in texts], float)
        tail = probabilities(s, cuts)
        return pd.DataFrame({"expected_grade": tail.sum(1), "p_top": tail[:, -1]})

    out = docs.withColumn("_grade", F.pandas_udf(of, "expected_grade double, p_top double")(F.col(text)))
    out = out.withColumns({"expected_grade": F.col("_grade.expected_grade"), "p_top": F.col("_grade.p_top")}).drop("_grade")
    return out.withColumn("selected", F.col("p_top") >= MIN_TAIL)


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
