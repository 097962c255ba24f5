"""Full-text matching: words and phrases inside one column, scored by counting."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of words, and everything else, which separates them (fixed values).
WORD, NOT_WORD = r"[\p{L}\p{N}\p{Co}]", r"[^\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda t: t != "")


def words_of(term: str) -> list[str]:
    """The words of a search term, as ``tokens`` cuts a text."""
    kinds = ((c, unicodedata.category(c)) for c in term.lower())
    return "".join(c if k[0] in "LN" or k == "Co" else " " for c, k in kinds).split()


def once(value: Column, function: Callable[[Column], Column]) -> Column:
    """function of a value that is computed once, however often function uses it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _stands(low: Column, words: list[str]) -> Column:
    """Texts are not cut into words: the first word is looked for, and a pattern looks at what is around it.

    The pattern begins with a letter, so that it is tried at few places; what stands before
    that letter is looked at next.
    """
    first, rest = words[0][0], NOT_WORD.join([words[0][1:], *words[1:]])  # words have no letter that a pattern reads otherwise
    return low.contains(words[0]) & low.rlike(f"{first}(?<!{WORD}{first}){rest}(?!{WORD})")


def lowered(texts: list[Column]) -> Column:
    return F.array(*[F.lower(F.coalesce(t, F.lit(""))) for t in texts])


def matches_of(low: list[Column], term: str) -> Column:
    """As ``matches``, in lower-case texts."""
    words = words_of(term)
    return reduce(or_, [_stands(t, words) for t in low]) if words else F.lit(False)


def score_of(low: list[Column], terms: list[str]) -> Column:
    """As ``score``, in lower-case texts."""
    times = {t: terms.count(t) for t in terms}
    return reduce(add, [F.when(matches_of(low, t), k).otherwise(0) for t, k in times.items()], F.lit(0))


def matches_in(low: Column, n: int, term: str) -> Column:
    """As ``matches``, in an array of n lower-case texts."""
    return matches_of([F.get(low, F.lit(k)) for k in range(n)], term)


def score_in(low: Column, n: int, terms: list[str]) -> Column:
    """As ``score``, in an array of n lower-case texts."""
    return score_of([F.get(low, F.lit(k)) for k in range(n)], terms)


def matches(texts: list[Column], term: str) -> Column:
    """Whether the words of term follow each other in one of the texts; a term without words never does."""
    return once(lowered(texts), lambda low: matches_in(low, len(texts), term))


def score(texts: list[Column], should: list[str], must: list[str] = ()) -> Column:
    """The number of terms that match; repeated terms count again."""
    return once(lowered(texts), lambda low: score_in(low, len(texts), [*should, *must]))
