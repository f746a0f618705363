"""Operator 10: toxicity by weak supervision.

Many voters look at a text: lexicon voters (words and word beginnings that
labelled rows allowed for learning tell apart) and pattern voters. A
generative label model estimates how often each voter fires on either class by
expectation maximisation over all rows allowed for learning, labelled or not;
voters that fire together within a class more than chance explains are correlated
and share their weight. A linear classifier on hashed text features is then fitted
to the posterior labels that the model gives, and scores every text.

What the voters do on a text is staged as the list of those that fire, equal lists
as one row with a count. Every step of the estimation is one Spark aggregate over these
rows: sums by class and voter, and by pairs of voters for the correlations. Class
counts of the features are Spark aggregates too; the driver gets the sums, the
picked features, and, for the classifier, at most ``LABELLED`` labelled rows (those whose
ids hash lowest) reduced to picked features. Every text is scored whole, by tasks, without a shuffle.

Edge cases: without labelled rows, or with one class only, every text gets the
smoothed share of positives; a null or empty text gets the classifier's score of
no words; several labels of one id count as toxic if one of them is; rows with
null id or label teach nothing; of several rows of one id that whose text has the smallest
hash teaches the classifier, and all of them count for the voters; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import features as X
from tidings.llm.common import small, table
from tidings.session import stage

#: Labelled rows to which the classifier is fitted, at most.
LABELLED = 8_000
#: Steps of the estimation before and after the correlations are taken over all rows, at most.
ROUNDS = 12
#: Lexicon voters, at most, and the rows on which one must have been seen.
VOTERS, SUPPORT = 400, 3
#: A lexicon voter must be so many times likelier on toxic rows.
LIFT = 4.0
#: Inputs of the classifier, at most.
INPUTS = 20_000
#: Standard errors by which the classes must differ in how often an input occurs.
MIN_Z = 3.5
PENALTY = 1e-4
THRESHOLD = 0.7

PATTERNS = [re.compile(p) for p in (r"!{2,}", r"\?{2,}", r"\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b){2}", r"[#*$%&]{3,}", r"(?i)\byou(?:r|'re)?\b", r"(?i)\bhate\w*", r"(.)\1{4,}")]
#: Feature ids of the patterns, above those of words.
PATTERN_IDS = [X.MASK + 1 + k for k in range(len(PATTERNS))]


def text_features(text: str | None) -> np.ndarray:
    """Distinct feature ids: words, stems, and a pattern's id if it occurs."""
    ids: set[int] = set()
    for w in set(X.split(text)):
        ids.update(X.word_features(w))
    ids.update(i for i, p in zip(PATTERN_IDS, PATTERNS, strict=True) if text and p.search(text))
    return np.fromiter(ids, np.int32, len(ids))


class Sums(NamedTuple):
    """By class (clean, toxic): rows, rows on which a voter fires, rows on which two voters fire."""

    rows: np.ndarray
    fired: np.ndarray
    both: np.ndarray | None


class LabelModel:
    """Firing rates of binary voters by class, with correlated voters discounted."""

    def __init__(self, fires: np.ndarray, known: np.ndarray, rounds: int = ROUNDS):
        """``fires``: rows x voters, 0 or 1; ``known``: 0, 1 or -1 (no label)."""

        def sums(model: LabelModel | None, pairs: bool) -> Sums:
            toxic = np.where(known >= 0, known, model.posterior(fires) if model else 0).astype(float)
            use = np.ones(len(known)) if model else (known >= 0).astype(float)
            weights = [(1 - toxic) * use, toxic * use]
            return Sums(np.array([w.sum() for w in weights]), np.stack([fires.T @ w for w in weights]),
                        np.stack([(fires * w[:, None]).T @ fires for w in weights]) if pairs else None)

        self.estimate(sums, rounds)

    @classmethod
    def over(cls, sums: Callable[[LabelModel | None, bool], Sums], rounds: int = ROUNDS) -> LabelModel:
        """The model of rows that only ``sums`` can see: sums of rows with known
        class (no model), or of all rows, weighed by the model's posterior."""
        model = cls.__new__(cls)
        model.estimate(sums, rounds)
        return model

    def estimate(self, sums: Callable[[LabelModel | None, bool], Sums], rounds: int) -> None:
        first = sums(None, True)
        self.prior = float(np.clip(first.rows[1] / first.rows.sum(), 1e-3, 1 - 1e-3))
        self.rate, self.share = self._rates(first), self._discount(first)
        for again in (True, False):
            for _ in range(rounds):
                rate = self._rates(sums(self, False))
                moved, self.rate = np.abs(rate - self.rate).max(), rate
                if moved < 1e-4:
                    break
            if again:
                self.share = self._discount(sums(self, True))

    @staticmethod
    def _rates(s: Sums) -> np.ndarray:
        return np.stack([(s.fired[0] + 0.05) / (s.rows[0] + 1), (s.fired[1] + 0.1) / (s.rows[1] + 1)])

    def _discount(self, s: Sums) -> np.ndarray:
        total = np.zeros(s.both.shape[1:])
        for rows, both, rate in zip(s.rows, s.both, self._rates(s), strict=True):
            sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-6))
            total = np.maximum(total, np.clip((both / max(rows, 1e-9) - np.outer(rate, rate)) / np.outer(sd, sd), 0, 1))
        self.correlation = total
        strong = np.where(total > 0.6, total, 0)
        np.fill_diagonal(strong, 0)
        return 1 / (1 + strong.sum(1))

    def weights(self) -> tuple[float, np.ndarray]:
        """Log odds when no voter fires, and what each that fires adds."""
        lo, hi = np.clip(self.rate, 1e-5, 1 - 1e-5)
        on, off = np.log(hi / lo) * self.share, np.log((1 - hi) / (1 - lo)) * self.share
        return float(np.log(self.prior / (1 - self.prior)) + off.sum()), on - off

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        base, add = self.weights()
        return X.sigmoid(base + fires @ add)

    def accuracy(self) -> np.ndarray:
        """Chance that a voter is right, firing or silent."""
        return self.prior * self.rate[1] + (1 - self.prior) * (1 - self.rate[0])


def fire(docs: DataFrame, gold: DataFrame, voters: np.ndarray) -> DataFrame:
    """(known, fires, many): the voters that fire on rows allowed for learning,
    with the label (-1: none) and the number of such rows."""
    place = {int(f): k for k, f in enumerate(voters)}
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        words = X.Memo(lambda word: [at[i] for i in X.word_features(word) if i in at])
        patterns = [(at[i], p) for i, p in zip(PATTERN_IDS, PATTERNS, strict=True) if i in at]
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                hits: set[int] = set()
                for hit in filter(None, map(words.__getitem__, set(X.split(t)))):
                    hits.update(hit)
                hits.update(k for k, p in patterns if t and p.search(t))
                out.append(sorted(hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "fires"])

    rows = docs.select("doc_id", "text").where(X.in_training(F.col("doc_id")))
    rows = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fires array<int>")
    rows = rows.join(small(gold), "doc_id", "left").select(F.coalesce("toxic", F.lit(-1)).alias("known"), "fires")
    return stage(rows.groupBy("known", "fires").agg(F.count("*").alias("many")), "firing-voters")


def spark_sums(fired: DataFrame, n_voters: int) -> Callable[[LabelModel | None, bool], Sums]:
    """Sums over the staged rows: added up by tasks, then by Spark by (class, voter, voter)."""

    def sums(model: LabelModel | None, pairs: bool) -> Sums:
        base, add = model.weights() if model else (0.0, None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    b = batch.slice(start, 1000)
                    known, many = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                    flat, sizes = b.column(1).flatten().to_numpy(zero_copy_only=False), np.diff(b.column(1).offsets.to_numpy())
                    row = np.repeat(np.arange(len(known)), sizes)
                    odds = base + np.bincount(row, add[flat], len(known)) if model else np.zeros(len(known))
                    toxic = np.where(known >= 0, known, X.sigmoid(odds))
                    on = np.zeros((len(known), n_voters), np.float32)
                    on[row, flat] = 1
                    for c, weight in enumerate(((1 - toxic) * many, toxic * many)):
                        # place (0, 0) has the rows, (k + 1, k + 1) those on which k fires, others pairs
                        grid = np.zeros((n_voters + 1, n_voters + 1))
                        grid[0, 0] = weight.sum()
                        if pairs:
                            grid[1:, 1:] = (on * weight[:, None]).T @ on
                        else:
                            grid[range(1, n_voters + 1), range(1, n_voters + 1)] = weight @ on
                        i, j = np.nonzero(grid)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(grid[i, j])], ["c", "i", "j", "n"])

        rows = fired if model else fired.where("known >= 0")
        found = rows.mapInArrow(run, "c int, i int, j int, n double").groupBy("c", "i", "j").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros((2, n_voters + 1, n_voters + 1))
        total[found.c, found.i, found.j] = found.n
        return Sums(total[:, 0, 0], np.stack([np.diagonal(t)[1:] for t in total]), total[:, 1:, 1:] if pairs else None)

    return sums


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict:
    """The linear classifier as a dict of plain arrays."""
    gold = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & X.in_training(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    sample = stage(X.sample_features(docs, X.sample_ids(gold, labelled), text_features, "toxic"), "sample-features")
    clean, toxic = (sample.where(F.col("toxic") == k).count() for k in (0, 1))
    if not toxic or not clean:
        p = (toxic + 1) / (toxic + clean + 2)
        return {"bias": float(np.log(p / (1 - p))), "columns": np.empty(0, np.int64), "weights": np.empty(0)}
    # lexicon voters: the terms that tell most rows apart
    lift = F.expr(f"((toxic + 0.1) / {toxic + 1}) / ((clean + 0.1) / {clean + 1})")
    terms = X.class_counts(sample, "toxic").where(F.col("feature") <= X.MASK).withColumn("lift", lift).where((F.col("toxic") >= SUPPORT) & (F.col("lift") >= LIFT))
    terms = terms.orderBy((-F.col("toxic") * F.log("lift")), "feature").limit(VOTERS).select("feature").toPandas()["feature"]
    voters = np.concatenate([np.sort(terms.to_numpy(np.int64)), PATTERN_IDS])
    model = LabelModel.over(spark_sums(fire(docs, gold, voters), len(voters)))
    base, add = model.weights()
    sample = X.with_odds(sample, "posterior", base, voters, add)
    # inputs: features that the posterior labels separate
    n1, n0 = sample.agg(F.sum("posterior"), F.sum(1 - F.col("posterior"))).first()
    p = F.greatest((F.col("toxic") + F.col("clean")) / (n1 + n0), F.lit(0.0))
    z = F.abs(F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) * (1 / n1 + 1 / n0) + 1e-12)
    inputs = X.class_counts(sample, "posterior").where(F.col("toxic") + F.col("clean") >= SUPPORT).withColumn("z", z).where(F.col("z") >= MIN_Z)
    columns = np.sort(inputs.orderBy(F.desc("z"), "feature").limit(INPUTS).select("feature").toPandas()["feature"].to_numpy(np.int64))
    lists, q = X.picked_rows(sample, columns, "posterior")
    train = X.Sparse(lists, columns)
    balance = q * (0.5 / q.mean()) + (1 - q) * (0.5 / (1 - q).mean())  # both classes weigh the same

    def grad(w: np.ndarray) -> np.ndarray:
        err = balance * (X.sigmoid(train.dot(w[1:]) + w[0]) - q)
        return np.concatenate([[err.mean()], train.t_dot(err) / len(q) + PENALTY * w[1:]])

    start = np.zeros(len(columns) + 1)
    w = X.minimise(grad, start, 0.1, 300)
    return {"bias": float(w[0]), "columns": columns, "weights": w[1:]}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of the toxic label."""
    weights = {int(c): float(w) for c, w in zip(model["columns"], model["weights"], strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast((model["bias"], weights))

    def of(texts: pd.Series) -> pd.Series:
        bias, w = shared.value
        words = X.Memo(lambda word: [i for i in X.word_features(word) if i in w])
        patterns = [(i, p) for i, p in zip(PATTERN_IDS, PATTERNS, strict=True) if i in w]
        out = []
        for t in texts:
            ids: set[int] = set()
            for hit in filter(None, map(words.__getitem__, set(X.split(t)))):
                ids.update(hit)
            ids.update(i for i, p in patterns if t and p.search(t))
            out.append(bias + sum(w[i] for i in sorted(ids)))
        return pd.Series(X.sigmoid(np.array(out, float)))

    return docs.withColumn("score", F.pandas_udf(of, "double")(F.col(text)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
