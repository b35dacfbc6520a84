"""Column functions over single tokens: the feature functions of the feature language."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(tok: Column) -> Column:
    """``-NUMBER-`` for a token that ends in a digit, else the token."""
    return F.when(tok.rlike("[0-9,.]*[0-9]+$"), "-NUMBER-").otherwise(tok)


def caseless(tok: Column) -> Column:
    return F.upper(tok)


def matching(tok: Column, name: str, pattern: str) -> Column:
    """``name`` where the pattern is found anywhere in the token, else null."""
    return F.when(tok.rlike(pattern), F.lit(name))


def shape(tok: Column) -> Column:
    """X, x or d for each upper-case letter, lower-case letter or digit; other characters stay."""
    any_other = F.regexp_replace(F.regexp_replace(F.regexp_replace(tok, "\\p{Lu}", "X"), "\\p{Ll}", "x"), "\\p{Nd}", "d")
    # ASCII needs no regular expressions
    return F.when(F.octet_length(tok) == F.char_length(tok), F.translate(tok, ascii_letters + digits, "x" * 26 + "X" * 26 + "d" * 10)).otherwise(any_other)


def _each(tok: Column, n: int, from_n: Column, body) -> Column:
    counts = F.when(F.char_length(tok) >= n, F.sequence(from_n, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(counts, body)


def _down(tok: Column, n: int, body) -> Column:
    """``body`` of n to 1, nothing for a shorter token; written out where n is small, as lambdas aren't compiled."""
    if n > 8:
        return _each(tok, n, F.lit(n), body)
    return F.when(F.char_length(tok) >= n, F.array(*[body(F.lit(i)) for i in range(n, 0, -1)])).otherwise(F.array().cast("array<string>"))


def prefixes(tok: Column, n: int) -> Column:
    """``PREF:`` and the first n to 1 characters; nothing for a shorter token."""
    return _down(tok, n, lambda i: F.concat(F.lit("PREF:"), F.substring(tok, F.lit(1), i)))


def suffixes(tok: Column, n: int) -> Column:
    """``SUF:`` and the last n to 1 characters; nothing for a shorter token."""
    return _down(tok, n, lambda i: F.concat(F.lit("SUF:"), F.right(tok, i)))


def without_prefixes(tok: Column, n: int) -> Column:
    """``SUF:`` and what is left after dropping n to 1 leading characters (n - 1 to 1 for a token of length n)."""
    most = F.when(F.char_length(tok) == n, n - 1).otherwise(n)
    return F.when(F.char_length(tok) > 1, _each(tok, n, most, lambda i: F.concat(F.lit("SUF:"), F.substring(tok, i + 1, F.char_length(tok))))).otherwise(F.array().cast("array<string>"))


def without_suffixes(tok: Column, n: int) -> Column:
    """``PREF:`` and what is left after dropping n to 1 trailing characters; for a token of length n the first is ``SUF:`` and all of it."""
    left = lambda i: F.char_length(tok) - i
    return _down(tok, n, lambda i: F.when(left(i) == 0, F.concat(F.lit("SUF:"), tok)).otherwise(F.concat(F.lit("PREF:"), F.substring(tok, F.lit(1), left(i)))))


def leading_grams(tok: Column, n: int, r: int) -> Column:
    """All character n-grams within the first r characters."""
    room = F.least(F.char_length(tok), F.lit(r)) - n + 1
    starts = F.when(room >= 1, F.sequence(F.lit(1), room)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(tok, i, F.lit(n)))


def trailing_grams(tok: Column, n: int, r: int) -> Column:
    """The character n-grams within the last r characters, but for the last one."""
    length = F.char_length(tok)
    first, last = F.greatest(length - r, F.lit(0)) + 1, length - n
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(tok, i, F.lit(n)))


def position_weight(pos: Column) -> Column:
    """1 / (position + 1)."""
    return F.lit(1.0) / (pos + 1)


def spaced_lower(text: Column) -> Column:
    """Basic preparation of a sentence: lower case, numbers as ``-NUM-``, punctuation apart."""
    numbers = F.regexp_replace(F.lower(text), "(?<![^ ])[\\p{Punct}0-9]*[0-9][\\p{Punct}0-9]*(?![^ ])", "-NUM-")
    return F.trim(F.regexp_replace(F.regexp_replace(numbers, "([,;:!?()\"])", " $1 "), " +", " "))
