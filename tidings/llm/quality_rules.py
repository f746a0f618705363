"""Operator 1: host-level quality rules.

Every document is tested against a few rules. Failures are aggregated by host,
each host's failure rate is shrunk towards the corpus by a beta prior fitted to
the hosts themselves, and hosts with a high shrunk rate are rejected with all
their documents. DataFrame functions only.

Edge cases: a null or empty text has no words and fails ``short``; a null host
is a host of its own; without documents there are no hosts; a single host (or
hosts that do not differ) keeps its own rate, which is the corpus's; repeated rows count as often as they occur; columns of the input that
carry the name of a column added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import BLANK, let, small, table, words_of
from tidings.session import stage

SYMBOLS = "#*$%&|<>"
NGRAM = 5
#: A host is rejected when a shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Least weight of the prior, in documents: a host of one document isn't judged by it alone.
MIN_PRIOR = 2.0
RULES = ("short", "repetition", "symbols", "lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of five words that occur twice or more. A text
    whose window hashes all differ has none; only the others compare windows."""
    grams = lambda w, of: F.transform(F.sequence(F.lit(1), F.size(w) - (NGRAM - 1)), of)

    def covered(w: Column) -> Column:
        windows = F.sort_array(grams(w, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, NGRAM)).alias("g"), i.alias("i"))))
        same = lambda s, j, k: F.get(s, j).getField("g") == F.get(s, k).getField("g")
        starts = lambda s: F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                     lambda k: F.coalesce(same(s, k, k - 1), F.lit(False)) | F.coalesce(same(s, k, k + 1), F.lit(False))),
            lambda k: F.get(s, k).getField("i")))
        # a window adds the words up to the next repeated window, five at most
        length = lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1), F.lit(0),
            lambda n, k: n + F.coalesce(F.least(F.lit(NGRAM), F.get(p, k + 1) - F.get(p, k)), F.lit(NGRAM))))
        return let(windows, lambda s: let(starts(s), length))

    return let(words, lambda w: F.when(F.size(w) <= NGRAM, F.lit(0)).otherwise(
        let(grams(w, lambda i: F.xxhash64(F.slice(w, i, NGRAM))),
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(w))))).cast("long")


def document_features(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The input's rows with counts, one ``fails_<rule>`` per rule, ``base_failed``
    and ``host``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("host", F.col(host)).withColumn("_words", words_of(F.col(text)))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
    })
    out = out.withColumns({"n_dup_lines": F.col("_lines.dup").cast("long"), "_n_lines": F.col("_lines.n")})
    out = out.withColumns({
        "fails_short": F.col("n_words") < 10,
        "fails_repetition": F.col("n_repeat_words") * 100 > F.col("n_words") * 20,
        "fails_symbols": F.col("n_symbols") * 10 > F.col("word_chars"),
        "fails_lines": F.col("n_dup_lines") * 100 > F.col("_n_lines") * 30,
    })
    return out.withColumn("base_failed", F.col("fails_short") | F.col("fails_repetition")).drop("_words", "_lines", "_n_lines")


def host_verdicts(features: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate of each rule, and
    whether the host is rejected.

    The prior of a rule is Beta(a, b) with the mean m of all documents and
    ``a + b = m (1 - m) / v - 1`` from the variance v of the hosts' rates about
    m, weighted by documents, ``MIN_PRIOR`` at least; the shrunk rate is (failures + a) / (documents + a + b).
    """
    hosts = stage(features.groupBy("host").agg(
        F.count("*").alias("host_docs"),
        *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES]), "hosts")
    total = hosts.agg(F.sum("host_docs").alias("docs"), *[F.sum(f"n_{r}").alias(r) for r in RULES]).first()
    if not total["docs"]:
        return hosts.select("host", "host_docs", *[F.lit(0.0).alias(f"rate_{r}") for r in RULES], F.lit(False).alias("host_rejected"))
    mean = {r: total[r] / total["docs"] for r in RULES}
    var = hosts.agg(*[
        (F.sum(F.col("host_docs") * F.pow(F.col(f"n_{r}") / F.col("host_docs") - mean[r], 2)) / total["docs"]).alias(r) for r in RULES]).first()
    rates = {}
    for r in RULES:
        m, v = mean[r], var[r]
        prior = max(MIN_PRIOR, m * (1 - m) / v - 1) if v > 1e-12 else MIN_PRIOR
        rates[r] = (F.col(f"n_{r}") + m * prior) / (F.col("host_docs") + prior)
    return hosts.select("host", "host_docs", *[c.alias(f"rate_{r}") for r, c in rates.items()],
                        (F.greatest(*rates.values()) > max_host_rate).alias("host_rejected"))


def apply_verdicts(features: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds ``host_rejected`` and ``kept``. Only rejected hosts are joined: by
    broadcast if they are few, else by shuffle (AQE splits a hot host)."""
    bad = stage(verdicts.where("host_rejected").select(F.col("host").alias("_bad")), "bad-hosts")
    out = features.join(small(bad.withColumn("_hit", F.lit(True))), F.col("host").eqNullSafe(F.col("_bad")), "left")
    out = out.withColumn("host_rejected", F.coalesce("_hit", F.lit(False))).drop("_bad", "_hit")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every input row with its counts, failed rules, ``host_rejected`` and ``kept``.

    The texts are read twice (once for the hosts, once for the rows) rather
    than written in between; use :func:`document_features` on a narrow table
    and stage it where the text is not needed afterwards.
    """
    features = document_features(docs, text, host)
    return apply_verdicts(features, host_verdicts(features, max_host_rate))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    features = stage(document_features(docs).drop("text", "source"), "quality-features")
    return apply_verdicts(features, host_verdicts(features)).select("doc_id", *COUNTS, "base_failed", "kept", "host_rejected")


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, host, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
r AS (
  SELECT *, n_words < 10 AS f1, n_repeat_words * 100 > n_words * 20 AS f2,
         n_symbols * 10 > word_chars AS f3, n_dup_lines * 100 > n_lines * 30 AS f4 FROM f),
long AS (SELECT host, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS failed FROM r),
h AS (SELECT host, rule, count(*) AS docs, count(*) FILTER (failed) AS n FROM long GROUP BY ALL),
m AS (SELECT rule, sum(n) / sum(docs) AS m FROM h GROUP BY rule),
v AS (SELECT h.rule, any_value(m.m) AS m, sum(docs * (n / docs - m.m) ** 2) / sum(docs) AS v FROM h JOIN m USING (rule) GROUP BY h.rule),
s AS (SELECT rule, m, CASE WHEN v > 1e-12 THEN greatest({MIN_PRIOR}, m * (1 - m) / v - 1) ELSE {MIN_PRIOR} END AS k FROM v),
bad AS (SELECT host, bool_or((n + m * k) / (docs + k) > {MAX_HOST_RATE}) AS rejected FROM h JOIN s USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND NOT rejected AS kept, rejected AS host_rejected
FROM r JOIN bad ON r.host IS NOT DISTINCT FROM bad.host
"""
