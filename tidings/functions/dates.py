"""Date expressions: article-id dates (P1, P2), ISO day prefix (P14), windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: month abbreviations accepted in
# article ids, in calendar order (jan = 1 ... dec = 12).
MONTH_ABBREVIATIONS = ["jan", "feb", "mar", "apr", "may", "jun",
                       "jul", "aug", "sep", "oct", "nov", "dec"]



def _month_map() -> Column:
    return F.create_map(*[x for i, m in enumerate(MONTH_ABBREVIATIONS, 1) for x in (F.lit(m), F.lit(i))])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ymd_to_date(year: Column, month: Column, day: Column) -> Column:
    """Build a date from integer parts; invalid combinations (feb 31) give NULL."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    ok = year.isNotNull() & month.isNotNull() & day.isNotNull() & \
        year.between(1, 9999) & day.between(0, 99)
    return F.when(ok, F.try_to_date(text, "yyyy-MM-dd"))


def strict_article_date(article_id) -> Column:
    """``seg/YYYY/mon/DD/...``. Fewer than 4 segments, a non-integer year or
    day, or an unknown month (any case) give NULL."""
    parts = F.split(_col(article_id), "/")
    year = F.try_element_at(parts, F.lit(2)).try_cast("int")
    month = F.try_element_at(_month_map(), F.lower(F.try_element_at(parts, F.lit(3))))
    day = F.try_element_at(parts, F.lit(4)).try_cast("int")
    return F.when(F.size(parts) >= 4, _ymd_to_date(year, month, day))


LENIENT_PATTERN = r"/(\d{4})/([a-z]{3})/(\d{2})/"


def lenient_article_date(article_id) -> Column:
    """The first ``/YYYY/mon/DD/`` found anywhere in the id (fixes Q1)."""
    low = F.lower(_col(article_id))
    year = F.nullif(F.regexp_extract(low, LENIENT_PATTERN, 1), F.lit("")).try_cast("int")
    month = F.try_element_at(_month_map(), F.regexp_extract(low, LENIENT_PATTERN, 2))
    day = F.nullif(F.regexp_extract(low, LENIENT_PATTERN, 3), F.lit("")).try_cast("int")
    return _ymd_to_date(year, month, day)


def article_date(article_id, lenient: bool = False) -> Column:
    return lenient_article_date(article_id) if lenient else strict_article_date(article_id)


def publication_day(iso_string) -> Column:
    """Calendar day from the first 10 characters of an ISO-8601 string;
    empty or malformed strings give NULL."""
    c = _col(iso_string)
    return F.try_to_date(F.nullif(F.substring(c, 1, 10), F.lit("")), "yyyy-MM-dd")


def utc_date(ts) -> Column:
    """Calendar date of a timestamp in the session time zone (UTC)."""
    return F.to_date(_col(ts))
