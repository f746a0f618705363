"""Text projections: article text variants, prompts, HTML strip, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/split() treat all Unicode whitespace plus the ASCII
# separators 0x1c-0x1f as blanks; Spark's trim() only strips spaces.
WS_CLASS = r"[\s\x1c-\x1f]"
_LEAD_WS = r"(?U)^" + WS_CLASS + "+"
_TRAIL_WS = r"(?U)" + WS_CLASS + "+$"
_WS_RUN = r"(?U)" + WS_CLASS + "+"
_NON_WS = r"(?U)[^\s\x1c-\x1f]"
HTML_TAG = r"<[^>]+>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(F.regexp_replace(_col(c), _LEAD_WS, ""), _TRAIL_WS, "")


def plain_text(headline="headline", standfirst="standfirst", body="bodyText") -> Column:
    """Headline + ' ' + standfirst + ' ' + body, missing parts as ''."""
    return F.concat(_blank(headline), F.lit(" "), _blank(standfirst), F.lit(" "), _blank(body))


def trimmed_text(headline="headline", standfirst="standfirst", body="bodyText") -> Column:
    """P3 stripped of surrounding whitespace (rows that end up empty are dropped by F4)."""
    return py_strip(plain_text(headline, standfirst, body))


def _cut(c, n: int | None) -> Column:
    """The first ``n`` code points; the whole text without ``n``."""
    return _col(c) if n is None else F.substring(_col(c), 1, n)


def title_body(title="webTitle", body="bodyText", n: int | None = None) -> Column:
    """P5: title, blank line, body (missing as ''), cut to ``n`` code points if given."""
    return F.concat(_blank(title), F.lit("\n\n"), _cut(_blank(body), n))


def body_prefix(body="bodyText", n: int | None = None) -> Column:
    """The body, missing as '', cut to ``n`` code points if given."""
    return _cut(_blank(body), n)


def strip_html(c) -> Column:
    """Drop ``<...>`` tags."""
    return F.regexp_replace(_col(c), HTML_TAG, "")


# Fixed values that must equal the reference: the sectioned labelling prompt
# (P8). The body of the prompt is split at the place the article sections go.
SECTIONED_PROMPT_HEAD = (
    "Analyze the following article and classify its sentiment/outlook on the US stock market.\n\n"
)
SECTIONED_PROMPT_TAIL = (
    "\n\nTask: Classify the article's sentiment toward the US stock market into one of five categories:\n\n"
    "POSITIVE - The article suggests optimistic outlook, growth, gains, bullish sentiment, or favorable conditions for US stocks\n"
    "LEANING POSITIVE - The article suggests an optimistic outlook, growth, gains, bullish sentiment, or favorable conditions for US stocks, but with some caveats or qualifiers\n"
    "NEUTRAL - The article presents balanced view, mixed signals, or is not directly related to US stock market sentiment\n"
    "LEANING NEGATIVE - The article suggests a pessimistic outlook, losses, bearish sentiment, concerns, or unfavorable conditions for US stocks, but with some caveats or qualifiers\n"
    "NEGATIVE - The article suggests pessimistic outlook, losses, bearish sentiment, concerns, or unfavorable conditions for US stocks\n\n"
    "Important Guidelines:\n"
    "- Focus on implications for US stock market, not just general economic news\n"
    "- Consider the overall tone and market implications\n"
    "- Look for keywords like: stocks, shares, markets, investors, Wall Street, S&P, Dow Jones, Nasdaq, trading, earnings\n\n"
    "Respond with ONLY ONE NUMBER: 4 - POSITIVE, 3 - LEANING POSITIVE, 2 - NEUTRAL, 1 - LEANING NEGATIVE, 0 - NEGATIVE"
)

# Fixed values that must equal the reference: the simple numeric prompt.
SIMPLE_PROMPT_HEAD = (
    "You are a financial sentiment analysis expert. Analyze the following Guardian business article "
    "and classify its sentiment regarding the US stock market.\n\nArticle:\n"
)
SIMPLE_PROMPT_TAIL = (
    "\n\nClassify the sentiment into one of these categories:\n"
    "4 - POSITIVE: Optimistic outlook, growth, gains, bullish sentiment, or favorable conditions for US stocks\n"
    "3 - LEANING POSITIVE: Mostly positive but with some caveats or qualifiers\n"
    "2 - NEUTRAL: Balanced view, mixed signals, or not directly related to US stock market sentiment\n"
    "1 - LEANING NEGATIVE: Mostly negative but with some caveats or qualifiers\n"
    "0 - NEGATIVE: Pessimistic outlook, losses, bearish sentiment, concerns, or unfavorable conditions for US stocks\n\n"
    "Respond with ONLY the number (0, 1, 2, 3, or 4) and nothing else."
)


def prompt_sections(headline="webTitle", standfirst="standfirst", body="bodyText", n: int | None = None) -> Column:
    """P8: 'Headline:' always; 'Summary:' (tags stripped) if a standfirst is
    present and non-empty; 'Excerpt:' with the body (its first ``n`` code points, if given) if there is one."""
    sf, bd = _col(standfirst), _col(body)
    summary = F.when(F.coalesce(sf, F.lit("")) != "",
                     F.concat(F.lit("Summary: "), strip_html(sf), F.lit("\n\n"))).otherwise(F.lit(""))
    excerpt = F.when(F.coalesce(bd, F.lit("")) != "",
                     F.concat(F.lit("Excerpt: "), _cut(bd, n), F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("Headline: "), _blank(headline), F.lit("\n\n"), summary, excerpt)


def sectioned_prompt(headline="webTitle", standfirst="standfirst", body="bodyText", n: int | None = None) -> Column:
    """P8 wrapped in its template."""
    return F.concat(F.lit(SECTIONED_PROMPT_HEAD), prompt_sections(headline, standfirst, body, n),
                    F.lit(SECTIONED_PROMPT_TAIL))


def simple_prompt(title="webTitle", body="bodyText", n: int | None = None) -> Column:
    """Template around P5. Plain concat, so '%' in the text stays data."""
    return F.concat(F.lit(SIMPLE_PROMPT_HEAD), title_body(title, body, n), F.lit(SIMPLE_PROMPT_TAIL))


def word_count(c) -> Column:
    """Number of whitespace-separated tokens (Python ``len(s.split())``);
    empty -> 0, NULL -> NULL."""
    parts = F.split(_col(c), _WS_RUN)
    return F.size(F.filter(parts, lambda x: x != F.lit("")))


def estimate_tokens(c) -> Column:
    """Length in code points, integer-divided by 4."""
    return F.floor(F.length(_col(c)) / 4).cast("long")


def is_blank(c) -> Column:
    """P19 helper: true when the text has no non-whitespace character (or is NULL)."""
    return ~F.coalesce(_col(c).rlike(_NON_WS), F.lit(False))


def default_article_id(id_col="id", index_col="idx") -> Column:
    """A missing id -> ``article_<position>``."""
    return F.coalesce(_col(id_col), F.concat(F.lit("article_"), _col(index_col).cast("string")))


def default_text(c, default: str = "unknown") -> Column:
    """Missing id / type -> ``default``."""
    return F.coalesce(_col(c), F.lit(default))
