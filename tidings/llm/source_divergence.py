"""Operator 13: how far the sources of a language diverge in their words.

Every group (lang, source) and every lang gets a smoothed integer probability
for each term kept in the lang: ``p = 1 + floor(10^9 (count + 1) / (N + V))``. The
divergence of a term is ``f = floor((p - q)^2 / q)``. Part ``term`` ranks a
group's terms that it uses more than its lang does; part ``pair`` ranks the
other sources of the lang by the sum of f over all kept terms.

``f`` depends on counts only, so terms are grouped into cells: by (group count,
lang count) for terms, by the counts in both sources for pairs. ``f`` is evaluated once a cell. Term
cells of equal value are merged and ranked by cumulative multiplicity until the
ranks are full; only those are expanded into terms, in UTF-8 order. For pairs only
terms that both sources have are listed by pair; cells in which one or both
counts are 0 follow from each source's own counts.

Tasks count the terms of their documents and send each (lang, source, term) a
bounded number of times; one shuffle by (lang, term) then sums, filters and lists the
sources of a term, of which there are at most as many as the lang has sources.
What one window holds is bounded by the ranks or the sources of a lang.

Edge cases: null text, lang or source count as ''; each row is a document;
a group without terms, or in a lang without kept terms, still has its pairs (value
0 where V is 0) and no term rows; a lang with one source has no pairs; an empty table gives no rows;
other columns are not read, whatever their names; sums beyond 64 bits while dividing are taken in decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import small, table
from tidings.session import stage

MIN_DOCS = 3
TOP_TERMS = 200
#: Distinct (lang, source, term) that a task gathers before it sends them on.
GATHER = 400_000

# bytes of letters stay (lower-cased) and so do bytes beyond ASCII, all others become blanks
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of (lang, source, term) within a task."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    new = 0

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in seen.items():
            words = [w.decode() for w in count]
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                keys = [w.encode() for w in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.string()),
                    pa.array([count[w] for w in keys], pa.int64()), pa.array([docs[w] for w in keys], pa.int64())], ["lang", "source", "term", "count", "docs"])
        seen.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                count, docs = seen[lang, source]
                words = terms_of(text)
                new -= len(count)
                count.update(words)
                docs.update(set(words))
                new += len(count)
            if new > GATHER:
                yield from send()
                new = 0
    yield from send()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, sources): one row for each term that at least
    ``min_docs`` documents of its lang hold; ``sources``: (source, count) of those that use it."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("sources"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", F.sort_array("sources").alias("sources"))


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exactly."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0))) div cast({total} + {terms} as decimal(19, 0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _sizes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, n, n_terms, lang_n, v) of every occurring group, with 0 where there are no terms."""
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v"))
    uses = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(
        F.sum("s.count").alias("n"), F.count("*").alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(uses, ["lang", "source"], "left").join(langs, "lang", "left")
    return stage(groups.na.fill(0, ["n", "n_terms", "lang_n", "v"]), "group-sizes")


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))


def term_part(terms: DataFrame, sizes: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms a group uses more than its lang, cell by cell."""
    uses = terms.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "s.source", "s.count", "total", "term")
    cell = ["lang", "source", "count", "total"]
    cells = uses.groupBy(*cell).agg(F.count("*").alias("many")).join(small(sizes), ["lang", "source"])
    cells = cells.withColumns({"p": probability("count", "n", "v"), "q": probability("total", "lang_n", "v")}).where("p > q")
    cells = stage(cells.withColumn("value", divergence("p", "q")).select(*cell, "many", "value"), "count-cells")
    # equal values are one; a value takes at least one rank, so no more than ``top`` values can matter
    values = _ranked(cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many")), [F.desc("value")]).where(F.col("rank") <= top)
    before = F.sum("many").over(Window.partitionBy("lang", "source").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    wanted = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < top).select("lang", "source", "value")
    rows = uses.join(cells.join(wanted, ["lang", "source", "value"]).select(*cell, "value"), cell)
    return _ranked(rows.select("lang", "source", F.col("term").alias("item"), "value"), [F.desc("value"), "item"]).where(F.col("rank") <= top)


def pair_part(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) for every ordered pair of sources of a lang."""
    near = sizes.select("lang", "source", F.col("n").alias("a_n"), F.col("n_terms").alias("a_terms"), "v")
    far = sizes.select("lang", F.col("source").alias("item"), F.col("n").alias("b_n"), F.col("n_terms").alias("b_terms"))
    pairs = stage(near.join(far, "lang").where("source != item"), "source-pairs")
    zero = F.lit(0).cast("long")

    # terms that both sources have: listed once for each unordered pair
    listed = terms.select("lang", "sources", F.posexplode("sources").alias("k", "x"))
    both = listed.select("lang", "x", F.explode(F.slice("sources", F.col("k") + 2, F.size("sources"))).alias("y"))
    both = both.groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), F.col("x.count").alias("a"), F.col("y.count").alias("b")).agg(
        F.count("*").alias("many"))
    both = stage(both, "pair-cells")
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("a"), F.col("a").alias("b"), "many"))

    # cells with a 0 by inclusion and exclusion: terms of one source, less those that the other has too
    own = stage(terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source"), F.col("s.count").alias("count")).agg(
        F.count("*").alias("many")), "count-histogram")
    key = ["lang", "source", "item"]
    ids = small(pairs.select(*key))
    only_a = own.withColumnRenamed("count", "a").join(ids, ["lang", "source"]).select(*key, "a", zero.alias("b"), "many")
    only_b = own.withColumnsRenamed({"count": "b", "source": "item"}).join(ids, ["lang", "item"]).select(*key, zero.alias("a"), "b", "many")
    corner = pairs.select(*key, zero.alias("a"), zero.alias("b"), (F.col("v") - F.col("a_terms") - F.col("b_terms")).alias("many"))
    less_a = both.select(*key, "a", zero.alias("b"), (-F.col("many")).alias("many"))
    less_b = both.select(*key, zero.alias("a"), "b", (-F.col("many")).alias("many"))
    again = both.select(*key, zero.alias("a"), zero.alias("b"), "many")
    cells = both.select(*key, "a", "b", "many")
    for other in (only_a, only_b, corner, less_a, less_b, again):
        cells = cells.unionByName(other)
    cells = cells.groupBy(*key, "a", "b").agg(F.sum("many").alias("many")).where("many != 0").join(small(pairs), key)
    cells = cells.withColumns({"p": probability("a", "a_n", "v"), "q": probability("b", "b_n", "v")})
    values = cells.groupBy(*key).agg(F.sum(F.col("many") * divergence("p", "q")).alias("value"))
    rows = pairs.select(*key).join(values, key, "left").na.fill(0, ["value"])
    return _ranked(rows, [F.desc("value"), "item"])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term``."""
    blank = F.lit("")
    docs = docs.select(*[F.coalesce(F.col(c), blank).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    terms = stage(kept_terms(docs, min_docs), "kept-terms")
    sizes = _sizes(docs, terms)
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
             for part, rows in (("pair", pair_part(terms, sizes)), ("term", term_part(terms, sizes, top)))]
    return parts[0].unionByName(parts[1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
t AS (SELECT lang, term, count(*)::HUGEINT AS c FROM o GROUP BY ALL HAVING count(DISTINCT k) >= {MIN_DOCS}),
u AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o SEMI JOIN t USING (lang, term) GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n, count(*)::HUGEINT AS v FROM t GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN u USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(u.c, 0) AS c, 1 + (1000000000 * (coalesce(u.c, 0) + 1)) // (gn.n + ln.v) AS p,
             1 + (1000000000 * (t.c + 1)) // (ln.n + ln.v) AS q
      FROM gn JOIN t USING (lang) JOIN ln USING (lang) LEFT JOIN u USING (lang, source, term)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pr UNION ALL FROM tr))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
