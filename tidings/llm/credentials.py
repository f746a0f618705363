"""Operator 7: secret scan with linking of multipart credentials.

Strong candidates (assigned values, access ids, long hex runs) are always
reported. Weak candidates are parts of a credential that mean nothing alone:

* ``weak_id``: an identifier such as ``user=...`` or ``client_id: ...``,
* ``weak_secret``: a mixed run of letters and digits of 16 characters or more,
* ``endpoint``: a URL or ``host=...``.

Parts are intervals of the text. An interval join links a secret (weak, or a
strong one that is assigned or a long hex run) to every identifier (weak or
access id) and every endpoint that lie in its scope: the same paragraph (no blank
line in between) and at most ``SCOPE`` characters away. A weak secret is reported
when at least one identifier is in its scope, a weak identifier when a secret is,
and an endpoint when a secret is that has an identifier in its own scope.

The join is a bisection over the sorted intervals of one text: what lies in a
secret's scope is one range of them, and a sweep over the ranges' ends marks the
parts. It costs n log n in the number of parts and makes no pairs; texts are
scanned whole, a record batch at a time, without a shuffle.

Edge cases: a null or empty text has no spans; candidates that overlap a base
span are not reported again; repeated rows are scanned like others.
Columns named as those added here are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import table

SCOPE = 200
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the length can be part of the pattern
WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", re.I | re.A)
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_-]{16,}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.I | re.A)
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")
BASE = ("assign", "access", "hex")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Strong candidates by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(BASE[k], a, b) for a, k, b in sorted(found)]


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


class _Parts:
    """Disjoint intervals of one role, in order."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans, key=lambda s: (s[1], s[2]))
        self.starts = [s[1] for s in self.spans]
        self.ends = [s[2] for s in self.spans]
        self.edges = [0] * (len(spans) + 1)

    def scope(self, a: int, b: int, low: int, high: int) -> tuple[int, int]:
        """The range of the intervals that lie in [low, high) within SCOPE of [a, b)."""
        return (max(bisect_left(self.starts, low), bisect_left(self.ends, a - SCOPE)),
                min(bisect_right(self.ends, high), bisect_right(self.starts, b + SCOPE)))

    def mark(self, first: int, stop: int) -> None:
        if first < stop:
            self.edges[first] += 1
            self.edges[stop] -= 1

    def marked(self) -> list[Span]:
        return [s for s, n in zip(self.spans, accumulate(self.edges)) if n]


class _Covered:
    """The union of intervals."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return not k or self.ends[k - 1] <= a


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that are reported because complementary parts lie in their scope."""
    free = _Covered(base).free
    ids = [("weak_id", m.start(), m.end()) for m in WEAK_ID.finditer(text) if free(m.start(), m.end())]
    ids_all = _Parts(ids + [s for s in base if s[0] == "access"])
    if not ids_all.spans:
        return []  # nothing links without an identifier
    ends = [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text) if free(m.start(), m.end())]
    free = _Covered(base + ids + ends).free
    weak = [("weak_secret", *m.span()) for m in WEAK_SECRET.finditer(text) if _mixed(m[0]) and free(*m.span())]
    endpoints = _Parts(ends)
    breaks = [(m.start(), m.end()) for m in PARAGRAPH.finditer(text)]
    after = [e for _, e in breaks]
    before = [s for s, _ in breaks]
    out: list[Span] = []
    for kind, a, b in weak + [s for s in base if s[0] in ("assign", "hex")]:
        k = bisect_right(after, a)
        low = after[k - 1] if k else 0
        j = bisect_left(before, b)
        high = before[j] if j < len(before) else len(text)
        first, stop = ids_all.scope(a, b, low, high)
        if first >= stop:
            continue
        ids_all.mark(first, stop)
        endpoints.mark(*endpoints.scope(a, b, low, high))
        out.append((kind, a, b))
    return sorted((s for s in out + ids_all.marked() + endpoints.marked() if s[0] not in BASE), key=lambda s: (s[1], s[0]))


FOUND = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("n_linked", T.LongType()), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    order = {k: i for i, k in enumerate((*BASE, "weak_id", "weak_secret", "endpoint"))}
    for t in texts:
        base = base_spans(t) if t else []
        linked = linked_spans(t, base) if t else []
        n = [sum(s[0] == k for s in base) for k in BASE]
        rows.append((*n, len(linked), _join(base), _join(sorted(base + linked, key=lambda s: (s[1], order[s[0]])))))
    return pd.DataFrame(rows, columns=FOUND.names)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the base kinds, ``n_linked``, ``base`` and
    ``spans`` (``kind:start:end`` in code points, by start, then kind)."""
    out = docs.withColumn("_scan", F.pandas_udf(_scan, FOUND)(F.col(text)))
    return out.withColumns({c: F.col("_scan")[c] for c in FOUND.names}).drop("_scan")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_linked")


def redact(text: str | None, spans: str) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, last = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",")):
        if int(a) >= last:
            out += [text[last:int(a)], f"[{kind}]"]
        last = max(last, int(b))
    return "".join(out) + text[last:]


