"""DuckDB oracle SQL for the registered queries.

Each entry is standalone SQL over the driver's pre-registered views
(``documents``, ``lineitem``, ``orders``, ``customer``, ``events``, ...). The
fixture derivations of :mod:`tidings.sources.views` are repeated here as CTEs
so the oracle shares no code with the Spark side. Floating results are
rounded to 9 places on both sides.
"""

from __future__ import annotations

ARTICLES = """
articles AS (
  SELECT doc_id,
    'business/' || CASE WHEN doc_id % 5 = 0 THEN 'article/' ELSE '' END
      || lower(strftime(DATE '1995-01-01' + CAST(doc_id % 731 AS INTEGER), '%Y/%b/%d'))
      || '/doc-' || CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 10 = 0 THEN 'liveblog' WHEN doc_id % 10 = 1 THEN NULL ELSE 'article' END AS type,
    split_part(text, chr(10), 1) AS webTitle,
    strftime(CAST(DATE '1995-01-01' + CAST(doc_id % 731 AS INTEGER) AS TIMESTAMP)
             + to_seconds(CAST((doc_id * 37) % 86400 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS webPublicationDate,
    split_part(text, chr(10), 1) AS headline,
    '<p>' || source || '</p>' AS standfirst,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS bodyText,
    lang, source, n_chars
  FROM documents)"""

RATER_LABELS = ARTICLES + """,
rater_labels AS (
  SELECT id AS article_id, 'a' AS rater, CAST((doc_id * 7 + n_chars) % 5 AS DOUBLE) AS label
  FROM articles WHERE lang <> 'es'
  UNION ALL
  SELECT id AS article_id, 'b' AS rater, CAST((doc_id * 3 + n_chars) % 5 AS DOUBLE) AS label
  FROM articles WHERE lang <> 'de')"""

CONSENSUS = RATER_LABELS + """,
consensus AS (
  SELECT article_id,
         CAST(CASE WHEN count(label) > 1 THEN round_even(avg(label), 0) ELSE avg(label) END AS DOUBLE) AS label,
         count(label) AS n_raters
  FROM rater_labels WHERE label IS NOT NULL GROUP BY article_id)"""

# strict article date: split on '/', >= 4 parts, int year, month abbreviation, int day
STRICT_DATE = """try_cast(printf('%04d-%02d-%02d',
      try_cast(split_part({c}, '/', 2) AS INTEGER),
      list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'],
                    lower(split_part({c}, '/', 3))),
      try_cast(split_part({c}, '/', 4) AS INTEGER)) AS DATE)"""


def strict_date(col: str) -> str:
    cond = (f"CASE WHEN len(string_split({col}, '/')) >= 4 "
            f"AND try_cast(split_part({col}, '/', 2) AS INTEGER) BETWEEN 1 AND 9999 "
            f"AND try_cast(split_part({col}, '/', 4) AS INTEGER) BETWEEN 0 AND 99 "
            f"AND list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], "
            f"lower(split_part({col}, '/', 3))) IS NOT NULL THEN ")
    return cond + STRICT_DATE.format(c=col) + " END"


def lenient_date(col: str) -> str:
    pat = r"'/(\d{4})/([a-z]{3})/(\d{2})/'"
    low = f"lower({col})"
    y = f"try_cast(nullif(regexp_extract({low}, {pat}, 1), '') AS INTEGER)"
    m = (f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], "
         f"regexp_extract({low}, {pat}, 2))")
    d = f"try_cast(nullif(regexp_extract({low}, {pat}, 3), '') AS INTEGER)"
    return (f"CASE WHEN {y} IS NOT NULL AND {m} IS NOT NULL AND {d} IS NOT NULL "
            f"THEN try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE) END")


DAILY_STRICT = CONSENSUS + f""",
dated AS (SELECT article_id, label, {strict_date('article_id')} AS date FROM consensus),
daily AS (SELECT date, avg(label) AS sentiment, count(*) AS n_articles FROM dated
          WHERE date IS NOT NULL GROUP BY date)"""

ORACLE: dict[str, str] = {}

ORACLE["consensus_labels"] = "WITH" + CONSENSUS + """
SELECT article_id, label, n_raters FROM consensus"""

ORACLE["daily_sentiment"] = "WITH" + DAILY_STRICT + """
SELECT date, round(sentiment, 9) AS sentiment, n_articles FROM daily"""

ORACLE["daily_sentiment_lenient"] = "WITH" + CONSENSUS + f""",
dated AS (SELECT label, {lenient_date('article_id')} AS date FROM consensus)
SELECT date, round(avg(label), 9) AS sentiment, count(*) AS n_articles
FROM dated WHERE date IS NOT NULL GROUP BY date"""

ORACLE["dashboard_kpis"] = "WITH" + DAILY_STRICT + """,
rng AS (SELECT greatest(min(date), CAST(max(date) - INTERVAL 30 DAY AS DATE)) AS range_start,
               max(date) AS range_end FROM daily)
SELECT range_start, range_end,
       round(avg(sentiment), 9) AS mean_sentiment, round(min(sentiment), 9) AS min_sentiment,
       round(max(sentiment), 9) AS max_sentiment,
       round(sum(sentiment * n_articles) / sum(n_articles), 9) AS article_mean,
       CAST(sum(n_articles) AS BIGINT) AS n_articles, count(*) AS n_days
FROM daily, rng WHERE date BETWEEN range_start AND range_end
GROUP BY range_start, range_end"""

ORACLE["dashboard_rollup"] = ORACLE["dashboard_kpis"]

ORACLE["rater_agreement"] = "WITH" + RATER_LABELS + """,
wide AS (SELECT article_id, max(CASE WHEN rater = 'a' THEN label END) AS label_a,
                max(CASE WHEN rater = 'b' THEN label END) AS label_b
         FROM rater_labels GROUP BY article_id)
SELECT count(*) FILTER (WHERE label_a IS NOT NULL AND label_b IS NOT NULL) AS both,
       count(*) FILTER (WHERE label_a IS NOT NULL AND label_b IS NULL) AS only_a,
       count(*) FILTER (WHERE label_a IS NULL AND label_b IS NOT NULL) AS only_b,
       count(*) AS total,
       round(avg(abs(label_a - label_b)), 9) AS mean_abs_diff,
       max(abs(label_a - label_b)) AS max_abs_diff,
       count(*) FILTER (WHERE label_a <> label_b) AS n_differ
FROM wide"""

ORACLE["label_distribution"] = "WITH" + CONSENSUS + """,
classes AS (SELECT * FROM (VALUES (0, 'negative'), (1, 'leaning negative'), (2, 'neutral'),
                                  (3, 'leaning positive'), (4, 'positive')) t(label, name)),
counts AS (SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM consensus
           WHERE label = floor(label) GROUP BY 1),
total AS (SELECT count(*) AS total FROM consensus)
SELECT c.label, c.name, CAST(coalesce(n, 0) AS BIGINT) AS count,
       round(coalesce(100.0 * coalesce(n, 0) / nullif(total, 0), 0.0), 9) AS pct
FROM classes c CROSS JOIN total LEFT JOIN counts k ON k.label = c.label"""

LABEL_BATCHES = ARTICLES + """,
label_batches AS (
  SELECT id AS article_id, CAST((doc_id * 3 + n_chars) % 5 AS DOUBLE) AS label,
         'labels_' || CAST(floor(doc_id / 100) * 100 AS BIGINT) || 'to' || CAST(floor(doc_id / 100) * 100 + 100 AS BIGINT) AS src_file,
         CAST(doc_id - floor(doc_id / 100) * 100 AS INTEGER) AS pos
  FROM articles
  UNION ALL
  SELECT id, CAST(((doc_id * 3 + n_chars) % 5 + 1) % 5 AS DOUBLE),
         'labels_' || CAST(floor(doc_id / 100) * 100 + 100 AS BIGINT) || 'to' || CAST(floor(doc_id / 100) * 100 + 200 AS BIGINT),
         CAST(doc_id - floor(doc_id / 100) * 100 - 100 AS INTEGER)
  FROM articles WHERE doc_id % 100 >= 70)"""

ORACLE["merged_label_batches"] = "WITH" + LABEL_BATCHES + """
SELECT article_id, arg_max(label, src_file) AS label FROM label_batches GROUP BY article_id"""

ORACLE["stream_daily_corrections"] = "WITH" + LABEL_BATCHES + f""",
latest AS (SELECT article_id, arg_max(label, CASE WHEN pos < 0 THEN 2 ELSE 1 END) AS label FROM label_batches GROUP BY article_id),
dated AS (SELECT label, {strict_date('article_id')} AS date FROM latest)
SELECT date, round(avg(label), 9) AS sentiment, count(*) AS n_articles, min(label) AS min_label, max(label) AS max_label
FROM dated WHERE date IS NOT NULL GROUP BY date"""

ORACLE["merge_file_stats"] = "WITH" + LABEL_BATCHES + """,
firsts AS (SELECT article_id, min(src_file) AS file FROM label_batches GROUP BY article_id),
newc AS (SELECT file, count(*) AS new_labels FROM firsts GROUP BY file),
tot AS (SELECT src_file AS file, count(DISTINCT article_id) AS labels_in_file FROM label_batches GROUP BY src_file)
SELECT t.file, t.labels_in_file, CAST(coalesce(n.new_labels, 0) AS BIGINT) AS new_labels,
       t.labels_in_file - coalesce(n.new_labels, 0) AS duplicates
FROM tot t LEFT JOIN newc n ON n.file = t.file"""


# ---------------------------------------------------------------- market series

def corr(x: str, y: str) -> str:
    """Population correlation over pairs with both sides present; NULL when a
    side is constant or fewer than two pairs exist."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    den = f"(stddev_pop({x}) FILTER (WHERE {both}) * stddev_pop({y}) FILTER (WHERE {both}))"
    return f"round(covar_pop({x}, {y}) / CASE WHEN {den} > 0 THEN {den} END, 9)"


def market_ctes(by_segment: bool) -> str:
    if by_segment:
        seg = """
seg AS (SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
signal AS (SELECT c_mktsegment AS series, CAST(l_shipdate AS DATE) AS date,
                  avg(l_linenumber % 5) AS sentiment, count(*) AS n_articles
           FROM lineitem JOIN seg ON l_orderkey = o_orderkey GROUP BY 1, 2),
px AS (SELECT c_mktsegment AS symbol, o_orderdate AS ts,
              CASE WHEN count(*) >= 3 THEN avg(o_totalprice) END AS close
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),"""
    else:
        seg = """
signal AS (SELECT 'all' AS series, CAST(l_shipdate AS DATE) AS date,
                  avg(l_linenumber % 5) AS sentiment, count(*) AS n_articles
           FROM lineitem GROUP BY 1, 2),
px AS (SELECT 'all' AS symbol, o_orderdate AS ts,
              CASE WHEN count(*) >= 3 THEN avg(o_totalprice) END AS close
       FROM orders GROUP BY 1, 2),"""
    return seg + """
filled AS (SELECT symbol, ts, close,
                  last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f
           FROM px),
returns AS (SELECT symbol, CAST(ts AS DATE) AS date, close,
                   f / lag(f) OVER (PARTITION BY symbol ORDER BY ts) - 1.0 AS "return"
            FROM filled),
joined AS (SELECT s.series, s.date, s.sentiment, s.n_articles, r."return"
           FROM signal s JOIN returns r ON r.symbol = s.series AND r.date = s.date),
combined AS (
  SELECT series, date, sentiment, n_articles, "return",
    CASE WHEN count("return") OVER w5 = 5 THEN avg("return") OVER w5 END AS return_smoothed,
    CASE WHEN count(sentiment) OVER w5 = 5 THEN avg(sentiment) OVER w5 END AS sentiment_smoothed,
    lead("return", 1) OVER w AS return_lead1, lead("return", 2) OVER w AS return_lead2,
    lead("return", 3) OVER w AS return_lead3, lead("return", 4) OVER w AS return_lead4,
    lead("return", 5) OVER w AS return_lead5,
    lead("return", 1) OVER w AS next_return,
    CAST(coalesce(sign(sentiment - 2.0), 0) AS INTEGER) AS sentiment_dir,
    CAST(coalesce(sign(lead("return", 1) OVER w), 0) AS INTEGER) AS return_dir
  FROM joined
  WINDOW w AS (PARTITION BY series ORDER BY date),
         w5 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


STATS_SELECT = f"""
SELECT series, count(*) AS n_days,
       {corr('sentiment', '"return"')} AS corr,
       {corr('sentiment_smoothed', 'return_smoothed')} AS corr_smoothed,
       {corr('sentiment', 'return_lead1')} AS corr_lag1, {corr('sentiment', 'return_lead2')} AS corr_lag2,
       {corr('sentiment', 'return_lead3')} AS corr_lag3, {corr('sentiment', 'return_lead4')} AS corr_lag4,
       {corr('sentiment', 'return_lead5')} AS corr_lag5,
       round(avg(CASE WHEN sentiment_dir <> 0 AND return_dir <> 0
                      THEN CAST(sentiment_dir = return_dir AS DOUBLE) END), 9) AS dir_accuracy,
       count(*) FILTER (WHERE sentiment_dir <> 0 AND return_dir <> 0) AS dir_days
FROM combined GROUP BY series"""

ORACLE["market_combined"] = "WITH" + market_ctes(False) + """
SELECT series, date, round(sentiment, 9) AS sentiment, n_articles, round("return", 9) AS "return",
       round(return_smoothed, 9) AS return_smoothed, round(sentiment_smoothed, 9) AS sentiment_smoothed,
       round(return_lead1, 9) AS return_lead1, round(return_lead2, 9) AS return_lead2,
       round(return_lead3, 9) AS return_lead3, round(return_lead4, 9) AS return_lead4,
       round(return_lead5, 9) AS return_lead5, round(next_return, 9) AS next_return,
       sentiment_dir, return_dir
FROM combined"""

ORACLE["market_stats"] = "WITH" + market_ctes(False) + STATS_SELECT
ORACLE["segment_market_stats"] = "WITH" + market_ctes(True) + STATS_SELECT

ORACLE["lag_correlations"] = "WITH" + market_ctes(True) + f""",
st AS (SELECT series, {corr('sentiment', '"return"')} AS lag0,
              {corr('sentiment', 'return_lead1')} AS lag1, {corr('sentiment', 'return_lead2')} AS lag2,
              {corr('sentiment', 'return_lead3')} AS lag3, {corr('sentiment', 'return_lead4')} AS lag4,
              {corr('sentiment', 'return_lead5')} AS lag5
       FROM combined GROUP BY series)
""" + "\nUNION ALL\n".join(f'SELECT series, {k} AS lag, lag{k} AS "corr" FROM st' for k in range(6))

_RET = "WITH" + market_ctes(True).split(",\njoined AS")[0]

ORACLE["segment_returns"] = _RET + """
SELECT symbol, date, round(close, 9) AS close, round("return", 9) AS "return" FROM returns"""

ORACLE["tick_features"] = """
WITH t AS (SELECT o_orderkey, o_orderdate AS ts, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS close, CAST(o_custkey % 5 AS DOUBLE) AS s FROM orders),
f AS (SELECT *, last_value(close IGNORE NULLS) OVER (ORDER BY ts, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM t),
r AS (SELECT *, filled / lag(filled) OVER (ORDER BY ts, o_orderkey) - 1 AS r FROM f)
SELECT o_orderkey, round(r, 9) AS "return",
       round(CASE WHEN count(r) OVER w = 5 THEN avg(r) OVER w END, 9) AS return_smoothed, round(CASE WHEN count(s) OVER w = 5 THEN avg(s) OVER w END, 9) AS sentiment_smoothed,
       round(lead(r, 1) OVER (ORDER BY ts, o_orderkey), 9) AS return_lead1, round(lead(r, 5) OVER (ORDER BY ts, o_orderkey), 9) AS return_lead5
FROM r WINDOW w AS (ORDER BY ts, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""

ORACLE["returns_date_slice"] = _RET + """
SELECT symbol, date, round(close, 9) AS close, round("return", 9) AS "return" FROM returns
WHERE date >= DATE '1996-01-01' AND date < DATE '1997-01-01'"""

ORACLE["returns_trailing_period"] = _RET + """,
mx AS (SELECT symbol, max(date) AS mx FROM returns GROUP BY symbol)
SELECT r.symbol, date, round(close, 9) AS close, round("return", 9) AS "return"
FROM returns r JOIN mx ON mx.symbol = r.symbol WHERE date > CAST(mx - INTERVAL 365 DAY AS DATE)"""


# ---------------------------------------------------------------- evaluation metrics

PREDICTIONS = ARTICLES + """,
predictions AS (
  SELECT 'rater_b' AS model, id AS article_id, CAST((doc_id * 7 + n_chars) % 5 AS INTEGER) AS y_true,
         CASE WHEN doc_id % 17 = 0 THEN -1 ELSE CAST((doc_id * 3 + n_chars) % 5 AS INTEGER) END AS y_pred
  FROM articles WHERE doc_id % 11 <> 3
  UNION ALL
  SELECT 'length', id, CAST((doc_id * 7 + n_chars) % 5 AS INTEGER),
         CAST(least(floor(log10(n_chars + 1)), 4) AS INTEGER)
  FROM articles WHERE doc_id % 13 <> 5)"""

ORACLE["eval_summary"] = "WITH" + PREDICTIONS + """
SELECT model, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 9) AS accuracy,
       round(avg(abs(y_true - y_pred)), 9) AS mae, count(*) FILTER (WHERE y_pred = -1) AS unparseable
FROM predictions GROUP BY model"""

ORACLE["confusion_matrix"] = "WITH" + PREDICTIONS + """,
grid AS (SELECT m.model, t.y_true, p.y_pred FROM (SELECT DISTINCT model FROM predictions) m,
         range(5) t(y_true), range(5) p(y_pred)),
cc AS (SELECT model, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL)
SELECT g.model, CAST(g.y_true AS INTEGER) AS y_true, CAST(g.y_pred AS INTEGER) AS y_pred,
       CAST(coalesce(cc.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cc ON cc.model = g.model AND cc.y_true = g.y_true AND cc.y_pred = g.y_pred"""


def report_sql(fixed: bool) -> str:
    if fixed:
        cls = "cls AS (SELECT DISTINCT model, CAST(c.r AS INTEGER) AS cls FROM predictions, range(5) c(r))"
    else:
        cls = """cls AS (SELECT model, y_true AS cls FROM predictions UNION
                 SELECT model, y_pred AS cls FROM predictions)"""
    return "WITH" + PREDICTIONS + f""",
{cls},
per AS (
  SELECT c.model, c.cls,
    (SELECT count(*) FROM predictions p WHERE p.model = c.model AND p.y_true = c.cls AND p.y_pred = c.cls) AS tp,
    (SELECT count(*) FROM predictions p WHERE p.model = c.model AND p.y_true = c.cls) AS support,
    (SELECT count(*) FROM predictions p WHERE p.model = c.model AND p.y_pred = c.cls) AS predicted
  FROM cls c),
per2 AS (
  SELECT *, coalesce(tp / nullif(CAST(predicted AS DOUBLE), 0), 0.0) AS precision,
         coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0.0) AS recall FROM per),
per3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM per2),
tot AS (SELECT model, count(*) AS n_all, count(*) FILTER (WHERE y_true = y_pred) AS n_ok
        FROM predictions GROUP BY model),
summ AS (
  SELECT model, sum(tp) AS tp_all, sum(predicted) AS pred_all, sum(support) AS sup_all,
         avg(precision) AS macro_p, avg(recall) AS macro_r, avg(f1) AS macro_f1,
         sum(precision * support) / nullif(sum(support), 0) AS w_p,
         sum(recall * support) / nullif(sum(support), 0) AS w_r,
         sum(f1 * support) / nullif(sum(support), 0) AS w_f1
  FROM per3 GROUP BY model),
micro AS (
  SELECT s.*, t.n_all, t.n_ok,
         coalesce(tp_all / nullif(CAST(pred_all AS DOUBLE), 0), 0.0) AS mp,
         coalesce(tp_all / nullif(CAST(sup_all AS DOUBLE), 0), 0.0) AS mr,
         coalesce(n_ok / nullif(CAST(n_all AS DOUBLE), 0), 0.0) AS acc
  FROM summ s JOIN tot t ON t.model = s.model),
rows_ AS (
  SELECT model, CAST(cls AS VARCHAR) AS "row", precision, recall, f1, CAST(support AS BIGINT) AS support FROM per3
  UNION ALL SELECT model, 'accuracy', acc, acc, acc, CAST(n_all AS BIGINT) FROM micro
  UNION ALL SELECT model, 'micro avg', mp, mr, coalesce(2 * mp * mr / nullif(mp + mr, 0), 0.0),
                   CAST(sup_all AS BIGINT) FROM micro
  UNION ALL SELECT model, 'macro avg', macro_p, macro_r, macro_f1, CAST(sup_all AS BIGINT) FROM micro
  UNION ALL SELECT model, 'weighted avg', coalesce(w_p, 0.0), coalesce(w_r, 0.0), coalesce(w_f1, 0.0),
                   CAST(sup_all AS BIGINT) FROM micro)
SELECT model, "row", round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
FROM rows_"""


ORACLE["classification_report"] = report_sql(True)
ORACLE["classification_report_seen"] = report_sql(False)

PAIR = PREDICTIONS + """,
pair AS (SELECT a.article_id, a.y_pred AS pred_a, b.y_pred AS pred_b
         FROM predictions a JOIN predictions b ON a.article_id = b.article_id
         WHERE a.model = 'rater_b' AND b.model = 'length')"""

ORACLE["predictor_agreement"] = "WITH" + PAIR + """
SELECT count(*) AS n, round(avg(CAST(pred_a = pred_b AS DOUBLE)), 9) AS agreement,
       round(covar_pop(pred_a, pred_b) / nullif(stddev_pop(pred_a) * stddev_pop(pred_b), 0), 9) AS correlation
FROM pair"""

ORACLE["prediction_histogram"] = "WITH" + PREDICTIONS + """
SELECT y_pred AS score,
       count(*) FILTER (WHERE model = 'rater_b') AS rater_b,
       count(*) FILTER (WHERE model = 'length') AS length
FROM predictions GROUP BY y_pred"""

ORACLE["class_weights"] = "WITH" + CONSENSUS + """,
l AS (SELECT CAST(trunc(label) AS INTEGER) AS label FROM consensus),
g AS (SELECT label, count(*) AS n_class FROM l GROUP BY label),
t AS (SELECT count(*) AS n_total, count(DISTINCT label) AS n_classes FROM l)
SELECT label, n_class, round(n_total / (n_classes * n_class), 9) AS weight FROM g, t"""


# ---------------------------------------------------------------- article profile

# Python str.split() / Java (?U)\\s whitespace, spelled out for RE2
WS = r"[\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def word_count(col: str) -> str:
    return f"len(list_filter(regexp_split_to_array({col}, '{WS}+'), lambda x: x <> ''))"


STATS_COLS = f"""count(*) AS count,
       min(try_cast(nullif(substr(webPublicationDate, 1, 10), '') AS DATE)) AS min_date,
       max(try_cast(nullif(substr(webPublicationDate, 1, 10), '') AS DATE)) AS max_date,
       round(coalesce(avg({word_count('bodyText')}), 0.0), 9) AS avg_word_count,
       CAST(coalesce(min({word_count('bodyText')}), 0) AS BIGINT) AS min_word_count,
       CAST(coalesce(max({word_count('bodyText')}), 0) AS BIGINT) AS max_word_count"""

ORACLE["article_type_counts"] = "WITH" + ARTICLES + """
SELECT coalesce(type, 'unknown') AS type, count(*) AS count FROM articles GROUP BY 1"""

ORACLE["article_type_stats"] = "WITH" + ARTICLES + f"""
SELECT coalesce(type, 'unknown') AS type, {STATS_COLS}
FROM articles GROUP BY 1"""

ORACLE["article_stats_rollup"] = "WITH" + ARTICLES + f""",
t AS (SELECT *, coalesce(type, 'unknown') AS t FROM articles)
SELECT CASE WHEN grouping(t) = 1 THEN 'all' ELSE t END AS type, {STATS_COLS}
FROM t GROUP BY ROLLUP (t)"""

ORACLE["article_data_check"] = "WITH" + ARTICLES + """
SELECT count(*) AS total, count(bodyText) AS with_body,
       round(count(bodyText) / nullif(CAST(count(*) AS DOUBLE), 0), 9) AS body_share, min(id) AS sample_id
FROM articles"""

NL2 = "chr(10) || chr(10)"
TITLE_BODY = f"coalesce(webTitle, '') || {NL2} || coalesce(bodyText, '')"
TITLE_BODY_2000 = f"coalesce(webTitle, '') || {NL2} || substring(coalesce(bodyText, ''), 1, 2000)"

ORACLE["eval_dataset"] = "WITH" + CONSENSUS + f""",
excl AS (SELECT a.id FROM articles a JOIN labels l ON l.doc_id = a.doc_id WHERE l.toxic = 1)
SELECT a.id, c.label, md5({TITLE_BODY}) AS text_md5, length({TITLE_BODY}) AS text_chars
FROM articles a JOIN consensus c ON c.article_id = a.id
WHERE (a.type IS NULL OR a.type <> 'liveblog') AND a.id NOT IN (SELECT id FROM excl)"""


# ---------------------------------------------------------------- text, prompts, parsing

def sql_literal(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


def _prompt_sql(body="bodyText", title_body=TITLE_BODY):
    from tidings.functions import text as T  # fixed template values only
    sections = (f"'Headline: ' || coalesce(webTitle, '') || {NL2}"
                f" || CASE WHEN coalesce(standfirst, '') <> '' THEN 'Summary: ' || "
                f"regexp_replace(standfirst, '<[^>]+>', '', 'g') || {NL2} ELSE '' END"
                f" || CASE WHEN coalesce(bodyText, '') <> '' THEN 'Excerpt: ' || {body}"
                f" || {NL2} ELSE '' END")
    sect = f"({sql_literal(T.SECTIONED_PROMPT_HEAD)} || {sections} || {sql_literal(T.SECTIONED_PROMPT_TAIL)})"
    simple = f"({sql_literal(T.SIMPLE_PROMPT_HEAD)} || {title_body} || {sql_literal(T.SIMPLE_PROMPT_TAIL)})"
    return sect, simple


SECT_PROMPT, SIMPLE_PROMPT = _prompt_sql()
SECT_PROMPT_1500, SIMPLE_PROMPT_2000 = _prompt_sql("substring(bodyText, 1, 1500)", TITLE_BODY_2000)
PLAIN = "coalesce(headline, '') || ' ' || coalesce(standfirst, '') || ' ' || coalesce(bodyText, '')"
TRIMMED = f"regexp_replace(regexp_replace({PLAIN}, '^{WS}+', ''), '{WS}+$', '')"

ORACLE["labelling_prompts"] = "WITH" + ARTICLES + f"""
SELECT id, md5({SECT_PROMPT}) AS sectioned_md5, CAST(length({SECT_PROMPT}) // 4 AS BIGINT) AS sectioned_tokens,
       md5({SIMPLE_PROMPT}) AS simple_md5, CAST(length({SIMPLE_PROMPT}) // 4 AS BIGINT) AS simple_tokens,
       md5({PLAIN}) AS plain_md5, length({TRIMMED}) AS trimmed_chars,
       md5(coalesce(bodyText, '')) AS body_md5
FROM articles WHERE type IS NULL OR type <> 'liveblog'"""

ORACLE["prompt_prefixes"] = "WITH" + ARTICLES + f"""
SELECT id, md5({TITLE_BODY_2000}) AS title_body_md5, md5(substring(coalesce(bodyText, ''), 1, 2000)) AS body_md5,
       md5({SECT_PROMPT_1500}) AS sectioned_md5, md5({SIMPLE_PROMPT_2000}) AS simple_md5
FROM articles WHERE type IS NULL OR type <> 'liveblog'"""

ORACLE["default_article_ids"] = "WITH" + ARTICLES + """
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN id ELSE 'article_' || (row_number() OVER (ORDER BY doc_id) - 1) END AS id,
       coalesce(type, 'unknown') AS type
FROM articles"""

ORACLE["cost_estimate"] = "WITH" + ARTICLES + f""",
t AS (SELECT count(*) AS num_articles,
             CAST(coalesce(sum(length({SECT_PROMPT}) // 4), 0) AS BIGINT) AS estimated_input_tokens
      FROM articles WHERE type IS NULL OR type <> 'liveblog')
SELECT num_articles, estimated_input_tokens, CAST(num_articles * 30 AS BIGINT) AS estimated_output_tokens,
       estimated_input_tokens + num_articles * 30 AS estimated_total_tokens,
       round(estimated_input_tokens * (0.0025 / 1000), 9) AS estimated_input_cost,
       round(num_articles * 30 * (0.010 / 1000), 9) AS estimated_output_cost,
       round(estimated_input_tokens * (0.0025 / 1000) + num_articles * 30 * (0.010 / 1000), 9) AS estimated_total_cost
FROM t"""

ORACLE["document_word_counts"] = f"""
SELECT doc_id, {word_count('text')} AS n_words, CAST(length(text) // 4 AS BIGINT) AS est_tokens FROM documents"""

STRIPPED = "regexp_replace(html, '<[^>]+>', '', 'g')"
ORACLE["page_text"] = f"""
SELECT page_id, length({STRIPPED}) AS text_chars, {word_count(STRIPPED)} AS n_words, md5({STRIPPED}) AS text_md5
FROM pages"""

U = "upper(trim(coalesce(text, '')))"
LADDER_TAIL = f"""WHEN contains({U}, '3') OR contains({U}, 'LEANING POSITIVE') THEN 'leaning_positive'
       WHEN contains({U}, '2') OR contains({U}, 'NEUTRAL') THEN 'neutral'
       WHEN contains({U}, '1') OR contains({U}, 'LEANING NEGATIVE') THEN 'leaning_negative'
       WHEN contains({U}, '0') OR contains({U}, 'NEGATIVE') THEN 'negative' ELSE 'neutral' END"""
SPACED = f"regexp_replace({U}, 'LEANING_(POSITIVE|NEGATIVE)', 'LEANING \\1', 'g')"
PY_STRIPPED = f"regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')"
STRICT_INT = f"try_cast({PY_STRIPPED} AS INTEGER)"

ORACLE["answer_parsing"] = f"""
SELECT conv_id, turn,
  CASE WHEN regexp_full_match({PY_STRIPPED}, '[+-]?[0-9]+') AND {STRICT_INT} BETWEEN 0 AND 4
       THEN {STRICT_INT} ELSE 2 END AS strict_label,
  CASE WHEN contains({U}, '4') OR (contains({U}, 'POSITIVE') AND NOT contains({SPACED}, 'LEANING POSITIVE'))
       THEN 'positive' {LADDER_TAIL.replace(U, SPACED)} AS ladder,
  CASE WHEN contains({U}, '4') OR contains({U}, 'POSITIVE') THEN 'positive' {LADDER_TAIL} AS ladder_reference,
  CASE WHEN regexp_extract(coalesce(text, ''), '[0-4]', 0) = '' THEN -1
       ELSE CAST(regexp_extract(coalesce(text, ''), '[0-4]', 0) AS INTEGER) END AS first_digit
FROM conversations"""

POL = "(['negative', 'neutral', 'positive', 'Positive', 'mixed'])[doc_id % 5 + 1]"
SCORE = "((n_chars % 100) / 100.0)"
BUCKET = (f"CASE WHEN lower({POL}) = 'negative' THEN CASE WHEN {SCORE} > 0.75 THEN 0 ELSE 1 END "
          f"WHEN lower({POL}) = 'neutral' THEN 2 "
          f"WHEN lower({POL}) = 'positive' THEN CASE WHEN {SCORE} > 0.75 THEN 4 ELSE 3 END END")
ORACLE["polarity_buckets"] = f"""
SELECT doc_id, {POL} AS polarity, round({SCORE}, 9) AS score, CAST({BUCKET} AS INTEGER) AS label,
       (['negative', 'leaning negative', 'neutral', 'leaning positive', 'positive'])[{BUCKET} + 1] AS label_name,
       NOT coalesce(regexp_matches(text, '[^{WS[1:-1]}]'), false) AS blank_text
FROM documents"""


def _chat_sql():
    from tidings.operators.scoring import EVAL_SYSTEM_PROMPT
    sysp = sql_literal(EVAL_SYSTEM_PROMPT)
    content = f"{sysp} || '|' || 'Article:' || chr(10) || text"
    return f"""
SELECT conv_id, turn, 2 AS n_messages, 'system,user' AS roles, md5({content}) AS content_md5
FROM conversations"""


ORACLE["chat_messages"] = _chat_sql()


# ---------------------------------------------------------------- scoring

ORACLE["labelling_usage"] = "WITH" + ARTICLES + f""",
t AS (SELECT count(*) AS calls, CAST(coalesce(sum(length({SIMPLE_PROMPT}) // 4), 0) AS BIGINT) AS inp
      FROM articles WHERE (type IS NULL OR type <> 'liveblog') AND id IS NOT NULL)
SELECT calls AS total_api_calls, CAST(0 AS BIGINT) AS failed_api_calls, inp AS total_input_tokens,
       CAST(0 AS BIGINT) AS total_output_tokens, inp AS total_tokens,
       round(inp * (0.0025 / 1000), 9) AS input_cost, CAST(0.0 AS DOUBLE) AS output_cost,
       round(inp * (0.0025 / 1000), 9) AS total_cost
FROM t"""

ORACLE["labelling_batch_progress"] = "WITH" + ARTICLES + """
SELECT CAST(floor(doc_id / 50) AS BIGINT) AS batch, min(doc_id) AS first_idx, max(doc_id) AS last_idx,
       count(*) AS rows, count(*) AS ok_rows, CAST(0 AS BIGINT) AS failed_rows, true AS batch_ok
FROM articles WHERE type IS NULL OR type <> 'liveblog' GROUP BY 1"""


# ---------------------------------------------------------------- streams

ORACLE["stream_daily_events"] = """
SELECT CAST(ts AS DATE) AS date, event_type, round(avg(value), 9) AS sentiment, count(*) AS n_articles
FROM events GROUP BY 1, 2"""


# ---------------------------------------------------------------- sources and sinks round trips

ORACLE["snapshot_merge"] = "WITH" + ARTICLES + """
SELECT id, type, CASE WHEN lang = 'en' THEN webTitle || ' (updated)' ELSE webTitle END AS webTitle,
       md5(coalesce(bodyText, '')) AS body_md5
FROM articles"""

ORACLE["label_map_roundtrip"] = ORACLE["merged_label_batches"]

ORACLE["price_csv_roundtrip"] = ORACLE["segment_returns"]

ORACLE["assembled_search_pages"] = "WITH" + ARTICLES + """,
p AS (SELECT CAST(floor(doc_id / 50) AS INTEGER) + 1 AS page, id,
             CAST(row_number() OVER (PARTITION BY floor(doc_id / 50)
                                     ORDER BY webPublicationDate DESC, id DESC) - 1 AS INTEGER) AS pos
      FROM articles),
t AS (SELECT max(page) AS total FROM p),
stop AS (SELECT 'error' AS run, CAST(floor(total / 2) AS INTEGER) + 1 AS stop FROM t
         UNION ALL SELECT 'gap', CAST(floor(total * 2 / 3) AS INTEGER) + 1 FROM t
         UNION ALL SELECT 'shrinking', CAST(ceil((total + 3) / 2.0) AS INTEGER) + 1 FROM t
         UNION ALL SELECT 'unnumbered', CAST(floor(total / 4) AS INTEGER) + 2 FROM t)
SELECT run, page, pos, id FROM p, stop WHERE page < stop"""

ORACLE["article_arrays"] = "WITH" + ARTICLES + """
SELECT id, type, webPublicationDate, md5(coalesce(bodyText, '')) AS body_md5 FROM articles"""

ORACLE["article_arrays_split"] = ORACLE["article_arrays"]

ORACLE["label_map_split"] = ORACLE["consensus_labels"]

ORACLE["article_file_index"] = "WITH" + ARTICLES + """,
f AS (SELECT id, 'articles_' || (doc_id % 9) || '.json' AS file, CAST(floor(doc_id / 9) AS BIGINT) AS pos FROM articles)
SELECT id, file, row_number() OVER (ORDER BY file, pos) - 1 AS idx FROM f"""

ORACLE["collection_window"] = "WITH" + ARTICLES + """,
d AS (SELECT try_cast(substr(webPublicationDate, 1, 10) AS DATE) AS day FROM articles)
SELECT day, count(*) AS n FROM d
WHERE day >= CAST(DATE '1996-12-31' - INTERVAL 730 DAY AS DATE) AND day <= DATE '1996-12-31'
GROUP BY day"""

ORACLE["articles_by_type_roundtrip"] = "WITH" + ARTICLES + f"""
SELECT coalesce(type, 'unknown') AS type, {STATS_COLS}
FROM articles GROUP BY 1"""


# ---------------------------------------------------------------- positions, top-k

ORACLE["article_index"] = "WITH" + ARTICLES + """
SELECT id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx FROM articles"""

ORACLE["article_index_range"] = "WITH" + ARTICLES + """
SELECT * FROM (SELECT id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx FROM articles)
WHERE idx >= 100 AND idx < 150"""

ORACLE["article_positions"] = ORACLE["article_index"]

ORACLE["article_position_range"] = "WITH" + ARTICLES + """
SELECT * FROM (SELECT id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, md5(coalesce(bodyText, '')) AS body_md5 FROM articles)
WHERE idx >= 100 AND idx < 150"""

ORACLE["newest_articles"] = "WITH" + ARTICLES + """
SELECT id, webPublicationDate FROM articles ORDER BY webPublicationDate DESC, id DESC LIMIT 50"""

ORACLE["finetune_dataset"] = "WITH" + CONSENSUS + f""",
t AS (SELECT a.id, CAST(trunc(c.label) AS INTEGER) AS label, {TRIMMED} AS text
      FROM articles a JOIN consensus c ON c.article_id = a.id WHERE a.id IS NOT NULL)
SELECT id, label, md5(text) AS text_md5, length(text) AS text_chars FROM t WHERE text <> ''"""

ORACLE["latest_snapshot"] = "WITH" + ARTICLES + """
SELECT id, webTitle FROM articles WHERE lang = 'en'"""


# ---------------------------------------------------------------- E1 on consensus labels

def consensus_market_ctes(lenient: bool) -> str:
    date = lenient_date("article_id") if lenient else strict_date("article_id")
    return CONSENSUS + f""",
dated AS (SELECT label, {date} AS date FROM consensus),
signal AS (SELECT date, avg(label) AS sentiment, count(*) AS n_articles FROM dated
           WHERE date IS NOT NULL GROUP BY date),
px AS (SELECT 'all' AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_orderdate) AS ts,
              CASE WHEN count(*) >= 3 THEN avg(o_totalprice) END AS close
       FROM orders GROUP BY 1, 2),
filled AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM px),
returns AS (SELECT symbol, date, f / lag(f) OVER (PARTITION BY symbol ORDER BY date) - 1.0 AS "return" FROM filled),
joined AS (SELECT r.symbol AS series, s.date, s.sentiment, s.n_articles, r."return"
           FROM signal s JOIN returns r ON r.date = s.date),""" + market_ctes(False).split("joined AS (SELECT s.series, s.date, s.sentiment, s.n_articles, r.\"return\"\n           FROM signal s JOIN returns r ON r.symbol = s.series AND r.date = s.date),")[1]


ORACLE["consensus_market_stats"] = "WITH" + consensus_market_ctes(False) + STATS_SELECT

ORACLE["consensus_market_combined"] = "WITH" + consensus_market_ctes(True) + """
SELECT series, date, round(sentiment, 9) AS sentiment, n_articles, round("return", 9) AS "return",
       round(return_smoothed, 9) AS return_smoothed, round(sentiment_smoothed, 9) AS sentiment_smoothed,
       round(return_lead1, 9) AS return_lead1, round(return_lead2, 9) AS return_lead2,
       round(return_lead3, 9) AS return_lead3, round(return_lead4, 9) AS return_lead4,
       round(return_lead5, 9) AS return_lead5, round(next_return, 9) AS next_return,
       sentiment_dir, return_dir
FROM combined"""

ORACLE["dashboard_range_pruned"] = "WITH" + DAILY_STRICT + """
SELECT round(avg(sentiment), 9) AS mean_sentiment, round(min(sentiment), 9) AS min_sentiment,
       round(max(sentiment), 9) AS max_sentiment,
       round(sum(sentiment * n_articles) / sum(n_articles), 9) AS article_mean,
       CAST(sum(n_articles) AS BIGINT) AS n_articles, count(*) AS n_days
FROM daily WHERE date BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'"""

ORACLE["predictor_comparison"] = "WITH" + PREDICTIONS + """,
common AS (SELECT article_id FROM predictions WHERE model = 'rater_b'
           INTERSECT SELECT article_id FROM predictions WHERE model = 'length')
SELECT model, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 9) AS accuracy,
       round(avg(abs(y_true - y_pred)), 9) AS mae, count(*) FILTER (WHERE y_pred = -1) AS unparseable
FROM predictions WHERE article_id IN (SELECT article_id FROM common) GROUP BY model"""

ORACLE["series_csv_roundtrip"] = ORACLE["consensus_market_combined"]

ORACLE["first_articles"] = "WITH" + ARTICLES + """
SELECT id, type FROM articles ORDER BY doc_id LIMIT 100"""

ORACLE["stream_daily_sentiment"] = "WITH" + CONSENSUS + """
SELECT CAST(substr(a.webPublicationDate, 1, 10) AS DATE) AS date, round(avg(c.label), 9) AS sentiment,
       count(*) AS n_articles
FROM consensus c JOIN articles a ON a.id = c.article_id GROUP BY 1"""

# ---------------------------------------------------------------- the word-list scorer in SQL

def _lexicon_sql(text_expr: str):
    from tidings.operators.lexicon import NEGATIVE_WORDS, POSITIVE_WORDS  # fixed word lists
    pos = "[" + ", ".join(f"'{w}'" for w in sorted(POSITIVE_WORDS)) + "]"
    neg = "[" + ", ".join(f"'{w}'" for w in sorted(NEGATIVE_WORDS)) + "]"
    words = f"regexp_extract_all(lower({text_expr}), '[\\p{{L}}\\p{{N}}_]+')"
    p = f"len(list_filter({words}, lambda w: list_contains({pos}, w)))"
    n = f"len(list_filter({words}, lambda w: list_contains({neg}, w)))"
    return p, n


_P, _N = _lexicon_sql(SIMPLE_PROMPT)

ORACLE["scored_articles"] = "WITH" + ARTICLES + f""",
s AS (SELECT id, {_P} AS p, {_N} AS n, CAST(length({SIMPLE_PROMPT}) // 4 AS BIGINT) AS prompt_tokens
      FROM articles WHERE (type IS NULL OR type <> 'liveblog') AND id IS NOT NULL)
SELECT id, CAST(2 + greatest(-2, least(2, p - n)) AS VARCHAR) AS raw_response, 'ok' AS status,
       CAST(2 + greatest(-2, least(2, p - n)) AS INTEGER) AS label, prompt_tokens
FROM s"""

# After both waves every non-liveblog article is labelled exactly once
ORACLE["incremental_labelling"] = "WITH" + ARTICLES + f"""
SELECT id, 'ok' AS status, CAST(2 + greatest(-2, least(2, {_P} - {_N})) AS INTEGER) AS label
FROM articles WHERE (type IS NULL OR type <> 'liveblog') AND id IS NOT NULL"""

_PT, _NT = _lexicon_sql(PLAIN)
POLARITY_CTES = CONSENSUS + f""",
d AS (SELECT a.id, a.webTitle, CAST(trunc(c.label) AS INTEGER) AS y_true, {_PT} AS p, {_NT} AS n
      FROM articles a JOIN consensus c ON c.article_id = a.id WHERE a.type IS NULL OR a.type <> 'liveblog'),
b AS (SELECT id, webTitle, y_true, CASE WHEN p = n THEN 2
                          WHEN p > n THEN CASE WHEN p / (p + n) > 0.75 THEN 4 ELSE 3 END
                          ELSE CASE WHEN n / (p + n) > 0.75 THEN 0 ELSE 1 END END AS y_pred FROM d)"""

ORACLE["polarity_eval"] = "WITH" + POLARITY_CTES + """
SELECT 'polarity' AS model, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 9) AS accuracy,
       round(avg(abs(y_true - y_pred)), 9) AS mae, count(*) FILTER (WHERE y_pred = -1) AS unparseable
FROM b"""

ORACLE["predictor_articles"] = "WITH" + POLARITY_CTES + PREDICTIONS[len(ARTICLES):] + """
SELECT b.id, b.y_true, z.y_pred AS zero_shot, f.y_pred AS few_shot, CAST(b.y_pred AS INTEGER) AS polarity, md5(b.webTitle) AS title_md5
FROM b JOIN predictions z ON z.article_id = b.id AND z.model = 'rater_b' JOIN predictions f ON f.article_id = b.id AND f.model = 'length'"""


# ---------------------------------------------------------------- seeded md5 hash

def md5_hash(id_expr: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({id_expr} AS VARCHAR)), 1, 8)) AS BIGINT)"


ORACLE["snapshot_merge_incremental"] = "WITH" + ARTICLES + f""",
b AS (SELECT *, {md5_hash('id')} % 64 AS bucket FROM articles)
SELECT id, type, webTitle || CASE WHEN doc_id % 97 = 0 THEN ' (updated)' ELSE '' END AS webTitle, md5(coalesce(bodyText, '')) AS body_md5,
       bucket IN (SELECT bucket FROM b WHERE doc_id % 97 = 0) AS rewritten
FROM b"""

ORACLE["hash_split_sizes"] = f"""
WITH u AS (SELECT {md5_hash('doc_id')} / 4294967296.0 AS u FROM documents)
SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split, count(*) AS n
FROM u GROUP BY 1"""

ORACLE["hash_split"] = f"""
WITH u AS (SELECT doc_id, {md5_hash('doc_id')} / 4294967296.0 AS u FROM documents)
SELECT doc_id AS id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM u"""

ORACLE["few_shot_examples"] = "WITH" + CONSENSUS + f""",
d AS (SELECT a.id, CAST(trunc(c.label) AS INTEGER) AS label
      FROM articles a JOIN consensus c ON c.article_id = a.id WHERE a.type IS NULL OR a.type <> 'liveblog')
SELECT label, arg_min(id, ({md5_hash('id')}, id)) AS id FROM d GROUP BY label"""


def _prompting_eval_sql():
    from tidings.operators.scoring import EVAL_SYSTEM_PROMPT  # fixed prompt text
    sysp = sql_literal(EVAL_SYSTEM_PROMPT)
    ps, ns = _lexicon_sql(sysp)
    msg = "'Article:' || chr(10) || text"
    pm, nm = _lexicon_sql(msg)
    return "WITH" + CONSENSUS + f""",
d AS (SELECT a.id, CAST(trunc(c.label) AS INTEGER) AS label, {TITLE_BODY} AS text
      FROM articles a JOIN consensus c ON c.article_id = a.id WHERE a.type IS NULL OR a.type <> 'liveblog'),
ex AS (SELECT label, arg_min(id, ({md5_hash('id')}, id)) AS id FROM d GROUP BY label),
-- word counts are additive over messages joined by newlines
sc AS (SELECT d.id, d.label, {pm} AS p, {nm} AS n, d.id IN (SELECT id FROM ex) AS is_example FROM d),
exs AS (SELECT coalesce(sum(p), 0) AS p, coalesce(sum(n), 0) AS n FROM sc WHERE is_example),
preds AS (
  SELECT 'zero_shot' AS mode, label AS y_true, 2 + greatest(-2, least(2, ({ps} + p) - ({ns} + n))) AS y_pred
  FROM sc WHERE NOT is_example
  UNION ALL
  SELECT 'few_shot', label, 2 + greatest(-2, least(2, ({ps} + sc.p + exs.p) - ({ns} + sc.n + exs.n)))
  FROM sc, exs WHERE NOT is_example)
SELECT mode, count(*) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 9) AS accuracy,
       round(avg(abs(y_true - y_pred)), 9) AS mae, count(*) FILTER (WHERE y_pred = -1) AS unparseable
FROM preds GROUP BY mode"""


ORACLE["prompting_eval"] = _prompting_eval_sql()

STRATIFIED = "WITH" + CONSENSUS + f""",
d AS (SELECT article_id AS id, CAST(trunc(label) AS INTEGER) AS label, {md5_hash('article_id')} AS h FROM consensus),
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY h, id) - 1 AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM d),
t AS (SELECT id, label, rk, ceil(CAST(0.15 AS DOUBLE) * n) AS n_test, n FROM r),
s AS (SELECT id, label, CASE WHEN rk < n_test THEN 'test'
                         WHEN rk < n_test + ceil(CAST(0.1765 AS DOUBLE) * (n - n_test)) THEN 'val'
                         ELSE 'train' END AS split FROM t)"""

ORACLE["stratified_split"] = STRATIFIED + """
SELECT id, label, split FROM s"""

ORACLE["stratified_split_sizes"] = STRATIFIED + """
SELECT label, split, count(*) AS n FROM s GROUP BY label, split"""

ORACLE["term_statistics"] = r"""
WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}'))) AS term FROM documents),
n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1, 9) AS idf FROM t, n GROUP BY term"""

_STOP = "('the', 'and', 'of', 'to', 'in', 'that', 'with', 'der', 'die', 'und', 'les', 'des', 'los', 'las')"
_TFIDF = rf"""
WITH d AS (SELECT doc_id, {md5_hash('doc_id')} / 4294967296.0 < 0.7 AS train,
                  regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{2,}}') AS ws FROM documents),
o AS (SELECT doc_id, train, term, count(*) AS tf FROM (SELECT doc_id, train, unnest(ws) AS term FROM d) WHERE term NOT IN {_STOP} GROUP BY ALL),
n AS (SELECT count(*) AS n FROM d WHERE train),
v AS (SELECT term, count(*) AS df, CAST(row_number() OVER (ORDER BY sum(tf) DESC, term) - 1 AS INTEGER) AS position,
             ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf
      FROM o, n WHERE train GROUP BY term QUALIFY position < 10000)"""

ORACLE["tfidf_vocabulary"] = _TFIDF + """
SELECT term, position, df, round(idf, 9) AS idf FROM v"""

ORACLE["tfidf_vectors"] = _TFIDF + """,
x AS (SELECT doc_id, tf * idf AS x FROM o JOIN v USING (term)),
l AS (SELECT doc_id, count(*) AS n, sum(x) AS s, max(x) AS m, sqrt(sum(x * x)) AS length FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_terms, round(coalesce(s / length, 0), 6) AS weight_sum, round(coalesce(m / length, 0), 6) AS top_weight
FROM d LEFT JOIN l USING (doc_id)"""

ORACLE["model_certificate"] = f"""
WITH t AS (SELECT lang FROM documents WHERE {md5_hash('doc_id')} / 4294967296.0 < 0.7)
SELECT count(*) AS n_rows, CAST(count(DISTINCT lang) AS INTEGER) AS n_classes, true AS finished, true AS optimal FROM t"""

ORACLE["consensus_unrounded"] = "WITH" + RATER_LABELS + """
SELECT article_id, avg(label) AS label, count(label) AS n_raters FROM rater_labels WHERE label IS NOT NULL GROUP BY article_id"""

ORACLE["argmax_classes"] = """
WITH s AS (SELECT doc_id, [(doc_id * 3 + n_chars) % 7, (doc_id * 4 + n_chars) % 7, (doc_id * 5 + n_chars) % 7,
                           (doc_id * 6 + n_chars) % 7, (doc_id * 7 + n_chars) % 7] AS s FROM documents),
l AS (SELECT doc_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS label FROM s)
SELECT doc_id, label, (['negative', 'leaning_negative', 'neutral', 'leaning_positive', 'positive'])[label + 1] AS ladder, label AS value FROM l"""

ORACLE["scored_with_failures"] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN length(text) % 7 <> 0 THEN CAST(length(text) % 5 AS INTEGER) END AS label,
       CASE WHEN length(text) % 7 = 0 THEN CAST(14 + 600 AS INTEGER) END AS error_chars
FROM documents"""


def _chat_prompts_sql():
    from tidings.operators.scoring import EVAL_SYSTEM_PROMPT  # fixed prompt text
    return "WITH" + CONSENSUS + f""",
d AS (SELECT a.id, CAST(trunc(c.label) AS INTEGER) AS label, {TITLE_BODY} AS text
      FROM articles a JOIN consensus c ON c.article_id = a.id WHERE a.type IS NULL OR a.type <> 'liveblog'),
ex AS (SELECT label, arg_min(id, ({md5_hash('id')}, id)) AS id, arg_min(text, ({md5_hash('id')}, id)) AS text FROM d GROUP BY label),
e AS (SELECT string_agg('user,assistant', ',') AS roles,
             string_agg(md5('Article:' || chr(10) || text) || ',' || md5(CAST(label AS VARCHAR)), ',' ORDER BY label, text) AS hashes FROM ex)
SELECT d.id, 'system,' || e.roles || ',user' AS roles,
       md5({sql_literal(EVAL_SYSTEM_PROMPT)}) || ',' || e.hashes || ',' || md5('Article:' || chr(10) || d.text) AS content_md5
FROM d, e WHERE d.id NOT IN (SELECT id FROM ex)"""


ORACLE["chat_prompts"] = _chat_prompts_sql()


def _message_store_sql():
    from tidings.operators.scoring import EVAL_SYSTEM_PROMPT  # fixed prompt text
    return "WITH" + CONSENSUS + f""",
d AS (SELECT a.id, CAST(trunc(c.label) AS INTEGER) AS label, {TITLE_BODY} AS text
      FROM articles a JOIN consensus c ON c.article_id = a.id WHERE a.type IS NULL OR a.type <> 'liveblog'),
ex AS (SELECT label, arg_min(id, ({md5_hash('id')}, id)) AS id FROM d GROUP BY label),
m AS (SELECT 'system' AS role, {sql_literal(EVAL_SYSTEM_PROMPT)} AS content
      UNION ALL SELECT 'assistant', CAST(label AS VARCHAR) FROM ex
      UNION ALL SELECT 'user', 'Article:' || chr(10) || text FROM d)
SELECT DISTINCT md5(content) AS message_id, role, length(content) AS n_chars FROM m"""


ORACLE["message_store"] = _message_store_sql()

ORACLE["resumed_labelling"] = "WITH" + ARTICLES + f"""
SELECT id, 'ok' AS status, CAST(2 + greatest(-2, least(2, {_P} - {_N})) AS INTEGER) AS label,
       CASE WHEN lang <> 'es' AND {md5_hash('id')} % 11 <> 0 THEN 1 ELSE 2 END AS run
FROM articles WHERE (type IS NULL OR type <> 'liveblog') AND id IS NOT NULL"""

ORACLE["run_record_roundtrip"] = "WITH" + PREDICTIONS + """,
p AS (SELECT CASE WHEN model = 'rater_b' THEN 'zero_shot' ELSE 'few_shot' END AS mode, article_id, y_pred AS pred
      FROM predictions),
t AS (SELECT article_id, y_true AS label FROM predictions WHERE model = 'length')
SELECT 'stand-in' AS model, '1995-01-01T00:00:00' AS timestamp, CAST(32 AS BIGINT) AS batch_size, p.mode,
       round(avg(CAST(p.pred = t.label AS DOUBLE)), 9) AS accuracy, count(*) AS n,
       (SELECT count(*) FROM p p2 WHERE p2.mode = p.mode) AS n_predictions
FROM p JOIN t ON t.article_id = p.article_id GROUP BY p.mode"""

ORACLE["cost_estimate_sampled"] = "WITH" + ARTICLES + f""",
a AS (SELECT * FROM articles WHERE type IS NULL OR type <> 'liveblog'),
h AS (SELECT avg(length({SECT_PROMPT}) // 4) AS m FROM (SELECT * FROM a ORDER BY doc_id LIMIT 5)),
t AS (SELECT count(*) AS num_articles FROM a)
SELECT num_articles, CAST(coalesce(floor(m * num_articles), 0) AS BIGINT) AS estimated_input_tokens,
       CAST(num_articles * 30 AS BIGINT) AS estimated_output_tokens,
       CAST(coalesce(floor(m * num_articles), 0) AS BIGINT) + num_articles * 30 AS estimated_total_tokens,
       round(CAST(coalesce(floor(m * num_articles), 0) AS BIGINT) * (0.0025 / 1000), 9) AS estimated_input_cost,
       round(num_articles * 30 * (0.010 / 1000), 9) AS estimated_output_cost,
       round(CAST(coalesce(floor(m * num_articles), 0) AS BIGINT) * (0.0025 / 1000)
             + num_articles * 30 * (0.010 / 1000), 9) AS estimated_total_cost
FROM t, h"""

ORACLE["nested_run_record"] = "WITH" + PREDICTIONS + """,
r AS (SELECT *, 'stand-in@run-' || CAST(floor(CAST(regexp_extract(article_id, 'doc-([0-9]+)$', 1) AS BIGINT) / 500) AS BIGINT) AS run FROM predictions)
SELECT r.run, CASE WHEN r.model = 'rater_b' THEN 'zero_shot' ELSE 'few_shot' END AS mode, r.article_id, r.y_pred AS pred, t.y_true AS label
FROM r LEFT JOIN r t ON t.run = r.run AND t.article_id = r.article_id AND t.model = 'length'"""
