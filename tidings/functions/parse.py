"""Answer parsers and label mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import py_strip

# Fixed values that must equal the reference: the five ordinal classes.
LABEL_NAMES = ["negative", "leaning negative", "neutral", "leaning positive", "positive"]
# Underscore spelling used by the sentiment-ladder parser.
LADDER_NAMES = ["negative", "leaning_negative", "neutral", "leaning_positive", "positive"]
NEUTRAL = 2
POLARITY_THRESHOLD = 0.75



def _name_to_value() -> Column:
    pairs = [(n, i) for i, n in enumerate(LABEL_NAMES)] + [(n, i) for i, n in enumerate(LADDER_NAMES) if "_" in n]
    return F.create_map(*[x for n, i in pairs for x in (F.lit(n), F.lit(i))])


def _value_to(names: list[str]) -> Column:
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_label_strict(raw) -> Column:
    """Stripped text (all Unicode blanks) parsed as an integer 0-4, anything else -> 2."""
    x = py_strip(raw).try_cast("int")
    return F.coalesce(F.when(x.between(0, 4), x), F.lit(NEUTRAL))


def parse_sentiment_ladder(raw, mode: str = "default") -> Column:
    """Map a free-text answer to a ladder name.

    ``mode="reference"`` keeps the reference order, where "POSITIVE" is tested
    before "LEANING POSITIVE" (Q4); the default tests the longer phrase first, in
    either spelling (``LEANING POSITIVE``, ``LEANING_POSITIVE``).
    Empty / NULL / unmatched -> neutral.
    """
    u = F.upper(F.trim(F.coalesce(_col(raw), F.lit(""))))
    if mode != "reference":
        u = F.regexp_replace(u, "LEANING_(POSITIVE|NEGATIVE)", "LEANING $1")  # our own spelling
    has = u.contains
    if mode == "reference":
        positive = has("4") | has("POSITIVE")
    else:
        positive = has("4") | (has("POSITIVE") & ~has("LEANING POSITIVE"))
    return (F.when(positive, "positive")
            .when(has("3") | has("LEANING POSITIVE"), "leaning_positive")
            .when(has("2") | has("NEUTRAL"), "neutral")
            .when(has("1") | has("LEANING NEGATIVE"), "leaning_negative")
            .when(has("0") | has("NEGATIVE"), "negative")
            .otherwise("neutral"))


def parse_first_digit(raw) -> Column:
    """First character in 0-4 of the answer, else -1."""
    d = F.regexp_extract(F.coalesce(_col(raw), F.lit("")), "[0-4]", 0)
    return F.when(d == "", F.lit(-1)).otherwise(d.cast("int"))


def bucket_polarity(label, score, threshold: float = POLARITY_THRESHOLD) -> Column:
    """3-class polarity + confidence -> 5-class ordinal; unknown label -> NULL (Q11)."""
    lab = F.lower(_col(label))
    s = _col(score)
    return (F.when(lab == "negative", F.when(s > threshold, 0).otherwise(1))
            .when(lab == "neutral", F.lit(2))
            .when(lab == "positive", F.when(s > threshold, 4).otherwise(3)))


def label_name(value) -> Column:
    """P20: 0-4 -> 'negative' ... 'positive' (space spelling)."""
    return F.try_element_at(_value_to(LABEL_NAMES), _col(value).cast("int"))


def ladder_name(value) -> Column:
    """P20: 0-4 -> underscore spelling used by the ladder parser."""
    return F.try_element_at(_value_to(LADDER_NAMES), _col(value).cast("int"))


def label_value(name) -> Column:
    """P20: either spelling (any case) -> 0-4, unknown -> NULL."""
    return F.try_element_at(_name_to_value(), F.lower(F.trim(_col(name))))


def direction(x, pivot: float = 0.0) -> Column:
    """Sign of (x - pivot) as int; missing -> 0."""
    return F.coalesce(F.signum(_col(x) - F.lit(pivot)), F.lit(0.0)).cast("int")


def argmax_class(scores) -> Column:
    """0-based index of the largest score, first one on ties."""
    a = _col(scores)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def to_int_label(label) -> Column:
    """Truncating cast of a (possibly .5) label."""
    return _col(label).cast("int")
