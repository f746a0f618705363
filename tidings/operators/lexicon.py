"""A small word-list scorer: the stand-in for an external model in tests,
examples and benchmarks (the reference's LLM and transformer clients are not
built; see README). It has the scorer contract ``list[str] -> list[str]`` and
answers with a digit 0-4 like the labelling prompts ask for.
"""

from __future__ import annotations

import re

# Our own illustrative word lists (not taken from any model).
POSITIVE_WORDS = frozenset("""gain gains growth rally record profit profits rise rises rising strong
bullish beat beats upgrade boom recovery surge surged optimism optimistic higher""".split())
NEGATIVE_WORDS = frozenset("""loss losses fall falls falling drop drops weak bearish miss misses downgrade
slump recession crash fear fears lower decline declines plunge plunged pessimism""".split())

_WORD = re.compile(r"\w+", re.UNICODE)


def _score(words: list[str]) -> int:
    return sum(w in POSITIVE_WORDS for w in words) - sum(w in NEGATIVE_WORDS for w in words)


def _answer(score: int) -> str:
    return str(2 + max(-2, min(2, score)))


def lexicon_answer(text: str) -> str:
    return _answer(_score(_WORD.findall(text.lower())))


def lexicon_scorer(texts: list[str]) -> list[str]:
    return [lexicon_answer(t) for t in texts]


def _with_prefix(prefix: str):
    """The scorer of ``prefix + text`` that counts the prefix's words once; a word
    that the prefix ends in is finished by the text."""
    low = prefix.lower()
    tail = re.search(r"\w*\Z", low).group()
    start = _score(_WORD.findall(low[:len(low) - len(tail)]))
    return lambda texts: [_answer(start + _score(_WORD.findall(tail + t.lower()))) for t in texts]


lexicon_scorer.with_prefix = _with_prefix


def lexicon_factory():
    """Scorer factory for :func:`tidings.operators.scoring.score_texts`."""
    return lexicon_scorer


def lexicon_polarity(texts: list[str]) -> list[tuple[str, float]]:
    """3-class polarity with a confidence, the shape P18 buckets into 5 classes."""
    out = []
    for t in texts:
        words = _WORD.findall(t.lower())
        p = sum(w in POSITIVE_WORDS for w in words)
        n = sum(w in NEGATIVE_WORDS for w in words)
        if p == n:
            out.append(("neutral", 1.0))
        else:
            out.append(("positive" if p > n else "negative", max(p, n) / (p + n)))
    return out


def lexicon_polarity_factory():
    """Polarity scorer factory for :func:`tidings.operators.scoring.score_polarity`."""
    return lexicon_polarity
