"""Expressions on token lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from origintrace.constants import SHORT_LINK_PREFIXES

# What str.strip() takes off: ASCII and Unicode white space.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def normalized(token: Column) -> Column:
    """Lower case, white space off both ends, then single quotes off both ends."""
    return F.btrim(F.btrim(F.lower(token), F.lit(WHITESPACE)), F.lit("'"))


def normalized_list(text: Column) -> Column:
    """The distinct normalised tokens of a ``", "``-separated list, sorted; null gives an empty list."""
    tokens = F.transform(F.split(text, ", "), normalized)
    kept = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t != "")))
    return F.coalesce(kept, F.array().cast("array<string>"))


def bare_list(text: Column) -> Column:
    """A bracketed list without its brackets; ``[]`` gives null.

    All leading ``[`` and all trailing ``]`` go, but no leading ``]`` or trailing ``[``.
    """
    inner = F.rtrim(F.ltrim(text, F.lit("[")), F.lit("]"))
    return F.when(text == "[]", F.lit(None).cast("string")).otherwise(inner)


def concat_arrays(*arrays: Column) -> Column:
    """Arrays one after the other, duplicates kept, null taken as empty."""
    return F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])


def drop_link_tokens(tokens: Column) -> Column:
    """Token array without the token ``.`` and without shortened links."""

    def wanted(t):
        return reduce(lambda c, p: c & ~F.startswith(t, F.lit(p)), SHORT_LINK_PREFIXES, t != ".")

    return F.filter(tokens, wanted)
